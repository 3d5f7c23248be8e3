"""Best-fit packing of token sequences: a configuration linear program over the histogram of lengths.

A configuration says how many pieces of each length share a sequence. The program covers every length's count with as
few configurations as possible. Multiplicative weights solve it: lengths that lag behind become dearer, and a knapsack
dynamic program finds the best-paid configuration at these prices. The solution is rounded down and the program solved
anew for what is left, until no configuration is used once; best fit places the rest. The same at every size. The driver
sees the histogram (one number a length) and the plan, never the pieces.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, strings, whole_text
from .tokens import CachedEncoder

CAPACITY = 1024
STEP = 1.0  # share of a length that a round covers at most; smaller ones were measured: more rounds and more sequences
RATE = 1.0  # the logarithm by which a wholly covered length is cheaper
FAVOUR_LONG = 0.2  # how much dearer a token of a longer piece is: short pieces fit anywhere later
ROWS_PER_SALT = 50_000  # pieces of one length that one task numbers


# ------------------------------------------------------------------ the linear program

def best_configuration(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: lengths (repeats allowed) of total at most `capacity` with the highest price sum.

    `prices` has an entry for each length 0..capacity; 0 means that the length is not wanted. Returns the value and the
    count of every length.
    """
    paid = np.where(prices > 0, prices, -np.inf)
    paid[1] = max(prices[1], 0.0)  # a token of room may stay empty
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)  # value[capacity - room]: so that slices match
    for room in range(1, capacity + 1):
        offers = paid[1:room + 1] + value[capacity - room + 1:]
        best = offers.argmax()
        value[capacity - room], choice[room] = offers[best], best + 1
    counts, room = np.zeros(capacity + 1, np.int64), capacity
    while room > 0:
        counts[choice[room]] += 1
        room -= int(choice[room])
    if prices[1] <= 0:
        counts[1] = 0
    return float(value[0]), counts


def solve_covering(need: np.ndarray, capacity: int, step: float = STEP, rate: float = RATE, favour_long: float = FAVOUR_LONG) -> tuple[dict[bytes, float], float]:
    """Fractional numbers of configurations that cover all of `need`, by multiplicative weights, and a lower bound.

    Every round prices a token of length l by exp(-rate * covered share of l), so what lags behind pays more, and takes
    the best-paid configuration until one of its lengths has gained the share `step`, but once at least. Prices divided by the best
    configuration's are a solution of the dual program, so what they pay for `need` bounds the sequences from below.
    """
    lengths, total = np.arange(capacity + 1), need.astype(float)
    left = total.copy()
    bound = float((total * lengths).sum() / capacity)
    taken: dict[bytes, float] = {}
    while (open_ := left > 0).any():
        share = np.where(open_, 1 - left / np.maximum(total, 1), 1.0)
        prices = np.where(open_, (lengths / capacity) ** (1 + favour_long) * np.exp(-rate * (share - share[open_].min())), 0.0)
        value, counts = best_configuration(prices, capacity)
        bound = max(bound, float((total * prices).sum() / value))
        used = np.flatnonzero(counts)
        often = float(min((left[used] / counts[used]).min(), max(1.0, (step * total[used] / counts[used]).min())))
        left[used] -= often * counts[used]
        left[left < 1e-6] = 0
        key = counts.astype(np.int32).tobytes()
        taken[key] = taken.get(key, 0.0) + often
    return taken, bound


def best_fit(need: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Best-fit decreasing over a histogram: each piece goes where the least room is left."""
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[np.ndarray] = []
    for length in range(capacity, 0, -1):
        room = length
        for _ in range(int(need[length])):
            while room <= capacity and not room_of[room]:
                room += 1
            if room > capacity:
                bins.append(np.zeros(capacity + 1, np.int64))
                number, free = len(bins) - 1, capacity
            else:
                number, free = room_of[room].pop(), room
            bins[number][length] += 1
            room_of[free - length].append(number)
            if free - length >= length:
                room = min(room, free - length)
    return bins


@dataclass
class Plan:
    """Which piece goes where: for each length, the ranks from `first` on belong to one configuration."""

    key: np.ndarray  # length << 40 | first rank, ascending
    per_copy: np.ndarray  # pieces of that length in one sequence
    sequence: np.ndarray  # number of the configuration's first sequence
    offset: np.ndarray  # place of the first such piece in its sequence
    sequences: int
    bound: float  # no plan has fewer sequences

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = (length.astype(np.int64) << 40) | rank.astype(np.int64)
        at = np.searchsorted(self.key, wanted, side="right") - 1
        past = wanted - self.key[at]
        return self.sequence[at] + past // self.per_copy[at], self.offset[at] + past % self.per_copy[at] * length


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Configurations and how often each is used; every piece of the histogram has exactly one place."""
    need = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        need[length] = n
    use: list[tuple[np.ndarray, int]] = []
    full = np.zeros(capacity + 1, np.int64)
    full[capacity] = 1
    if need[capacity]:
        use.append((full, int(need[capacity])))  # a full piece shares its sequence with nothing
    rest = need.copy()
    rest[capacity] = 0
    before, bound = -1, 0.0
    while rest.sum() != before:
        before = rest.sum()
        taken, least = solve_covering(rest, capacity)
        bound = bound or least + need[capacity]
        for key, often in taken.items():
            counts = np.frombuffer(key, np.int32).astype(np.int64)
            used = np.flatnonzero(counts)
            copies = min(int(often + 1e-6), int((rest[used] // counts[used]).min()))
            if copies:
                rest -= copies * counts
                use.append((counts, copies))
    use += [(counts, 1) for counts in best_fit(rest, capacity)]
    rows, sequence = [], 0
    taken = np.zeros(capacity + 1, np.int64)
    for counts, copies in use:
        place = 0
        for length in np.flatnonzero(counts)[::-1]:
            rows.append(((int(length) << 40) | int(taken[length]), int(counts[length]), sequence, place))
            taken[length] += copies * counts[length]
            place += int(length * counts[length])
        sequence += copies
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return Plan(*[np.ascontiguousarray(x) for x in columns], sequences=sequence, bound=bound)


# ------------------------------------------------------------------ pieces and their places

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, extra: str = "") -> DataFrame:
    """Token pieces of every document: ids with `end_id` behind; longer ones cut into pieces of `capacity`, the first
    of which may be shorter."""
    end = struct.pack("<I", end_id)

    def cut(batches):
        encoder = CachedEncoder(tokenizer)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(strings(batch, "doc_id"), encoder.encode(strings(batch, "text"))):
                ids += end
                n = len(ids) // 4
                start, stop, piece = 0, (n - 1) % capacity + 1, 0
                while start < n:
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(cut, PIECES)


def number_in_group(pieces: DataFrame, salts: int) -> DataFrame:
    """Adds `rank`, from 0 without gaps within a length. A frequent length is numbered in salted parts, whose offsets
    come from the parts' counts."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    within = salted.withColumn("rank", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = salted.groupBy("length", "salt").count().select(
        "length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return within.join(parts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is its end token alone.
    Rows that repeat (also a doc_id that repeats or is null) are packed as often as they occur. An empty table gives an
    empty result. Other columns of `docs` are ignored.
    """
    pieces = stored(cut_documents(docs, tokenizer, end_id, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    plan = make_plan(histogram, capacity)
    numbered = number_in_group(pieces, max(1, sum(histogram.values()) // ROWS_PER_SALT))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]

    def place(batches):
        for batch in batches:
            frame = dict(zip(batch.schema.names, batch.columns))
            sequence, offset = plan.place(frame["length"].to_numpy(zero_copy_only=False), frame["rank"].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [frame["doc_id"], frame["piece"], frame["start"], frame["length"].cast(pa.int64()), frame["ids_crc32"],
                 pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.select(*columns).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
