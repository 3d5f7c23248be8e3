"""Token counts from pre-token frequencies: no ids are made.

Documents are read in blocks. A block yields its distinct pre-tokens, numbered, and for every document how often it has
which. The pre-tokens of all blocks meet in a shuffle, where each distinct one is counted once with the tokenizer; the
counts go back to their blocks and are summed over the documents' frequencies.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, strings, whole_text, without_collection
from .tokens import SIGNS, SPACE, latin_word, load, pieces_with_spaces, with_space

PARTS_PER_PARTITION = 4  # parts of the vocabulary for each shuffle partition
BLOCK_CHARS = 10_000_000  # a block ends with the document that exceeds this, so only a single longer document makes a longer block

LISTS = ("block long, doc_id long, n_bytes long, special long, numbers binary, counts binary, "
         "part int, first int, pretokens array<string>")


def special_strings(path: str) -> list[str]:
    """Strings that the tokenizer takes out of a text before anything else; each is one token."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
        raise ValueError("only added tokens that match as they are written can be counted")
    return [x["content"] for x in added]


class Numbers(dict):
    """Gives every new key the next number."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


def split_stretch(stretch: str, library) -> list[str]:
    """Pre-tokens of a stretch of text. A word, with signs behind it or none, is plain to see; the library splits all else."""
    if stretch[:1] == "\n" and len(stretch) > 1 and not stretch[1].isspace():
        return ["\n", *split_stretch(stretch[1:], library)]
    core = stretch.rstrip(SIGNS)
    if core[core[:1] == " ":].isalpha():
        return [core] if len(core) == len(stretch) else [core, stretch[len(core):]]
    return [stretch[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(stretch)]


class Block:
    """Numbers the distinct pre-tokens of some documents and lists each document's pre-tokens and their counts."""

    def __init__(self, library, special: list[str]):
        self.library, self.special = library, special
        self.chars = 0
        self.stretches = Numbers()  # pieces of text; one at the start of a text in a tuple, as it has no space
        self.rows: list[tuple] = []
        self.held: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str) -> None:
        self.chars += len(text)
        parts, n_special = [text], 0
        for mark in self.special:
            if mark in text:
                cut = [x.split(mark) for x in parts]
                n_special += sum(len(x) - 1 for x in cut)
                parts = [y for x in cut for y in x]
        keys: list = []
        for part in parts:
            first, *rest = pieces_with_spaces(part)
            keys += [(first,)] if first else []
            keys += rest
        self.held.append(np.fromiter(map(self.stretches.__getitem__, keys), np.int64, len(keys)))
        self.rows.append((doc_id, len(text.encode("utf-8", "surrogatepass")), n_special))

    @without_collection
    def finish(self, parts: int) -> tuple[list[bytes], list[bytes], list[tuple[int, int, list[str]]]]:
        """For each document its pre-tokens' numbers (differences, packed) and their counts; for each part its number, its
        first pre-token's number and its pre-tokens. They are numbered by part, which a hash decides, and alphabet."""
        names = Numbers()
        split = [[names[p] for p in split_stretch(x[0] if type(x) is tuple else with_space(x), self.library)] for x in self.stretches]
        size = np.array([len(x) for x in split], np.int64)
        ordered = sorted(names)
        part = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % parts for x in ordered], np.int64)
        order = np.argsort(part, kind="stable")
        ordered, part = [ordered[i] for i in order.tolist()], part[order]
        place = np.zeros(len(names), np.int64)
        place[[names[x] for x in ordered]] = np.arange(len(names))
        flat = place[np.array([p for x in split for p in x], np.int64)]
        first = np.cumsum(size) - size
        every = np.concatenate([np.zeros(0, np.int64), *self.held])
        document = np.repeat(np.arange(len(self.held)), [len(x) for x in self.held])
        times = size[every]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        number = flat[np.repeat(first[every], times) + within] if len(every) else every
        pair, count = np.unique(np.repeat(document, times) * max(1, len(names)) + number, return_counts=True)
        owner, number = pair // max(1, len(names)), pair % max(1, len(names))
        starts = np.searchsorted(owner, np.arange(len(self.held)))
        step = np.diff(number, prepend=0)
        step[starts[starts < len(number)]] = number[starts[starts < len(number)]]
        firsts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        lists = [(int(part[a]), a, ordered[a:b]) for a, b in zip(firsts, [*firsts[1:], len(ordered)])]
        return packed(step, starts), packed(count, starts), lists


def packed(numbers: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Non-negative integers, 7 bits a byte, lowest first, the top bit set on all but the last byte of each; cut at `starts`."""
    if not len(numbers):
        return [b""] * len(starts)
    width = max(1, -(-int(numbers.max()).bit_length() // 7))
    shifted = numbers[:, None] >> (7 * np.arange(width))
    size = np.maximum(1, (shifted > 0).sum(1))
    place = np.arange(width)
    digits = (shifted & 127) | np.where(place < size[:, None] - 1, 128, 0)
    data = digits[place < size[:, None]].astype(np.uint8).tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])
    cuts = ends[np.append(starts, len(numbers))]
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def block_lists(docs: DataFrame, tokenizer: str, parts: int) -> DataFrame:
    """A row for each document (doc_id, n_bytes, special, numbers, counts) and one for each part of each block's
    pre-tokens (part, first, pretokens)."""
    names = ["block", "doc_id", "n_bytes", "special", "numbers", "counts", "part", "first", "pretokens"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.string())]

    def read(batches):
        import random

        library, special = load(tokenizer), special_strings(tokenizer)
        draw = random.SystemRandom()  # a name of its own for each block, also where a task runs again

        def written(block: Block):
            name = draw.getrandbits(63)
            numbers, counts, lists = block.finish(parts)
            for columns in ([*zip(*block.rows), numbers, counts, *[[None] * len(block.rows)] * 3],
                            [*[[None] * len(lists)] * 5, *(zip(*lists) if lists else [[]] * 3)]):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[name] * len(columns[0]), *columns], kinds)], names=names)

        block = Block(library, special)
        for batch in slices(batches):
            for doc_id, text in zip(strings(batch, "doc_id"), strings(batch, "text")):
                block.add(doc_id, text)
            if block.chars > BLOCK_CHARS:
                yield from written(block)
                block = Block(library, special)
        if block.rows:
            yield from written(block)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(read, LISTS)


def piece_counts(vocabularies: DataFrame, tokenizer: str) -> DataFrame:
    """(block, first, sizes): tokens of every pre-token of every block, packed in order. Equal pre-tokens are in the same
    part, which one task reads as a whole, so each is counted once."""

    def count(batches):
        library = load(tokenizer)
        encode_word = library.model.tokenize
        part, known = None, {}
        for batch in batches:
            out = []
            for now, column in zip(strings(batch, "part"), strings(batch, "pretokens")):
                if now != part:
                    part, known = now, {}
                other = []
                for pretoken in column:
                    if pretoken not in known:
                        spaced = pretoken[:1] == " "
                        word = latin_word(pretoken[spaced:])
                        if word is None:
                            other.append(pretoken)
                        else:
                            known[pretoken] = len(encode_word(SPACE + word if spaced else word))
                known |= zip(other, [len(x.ids) for x in library.encode_batch_fast(other, add_special_tokens=False)] if other else [])
                out += packed(np.array([known[x] for x in column], np.int64), np.zeros(1, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["block", "first", "sizes"])

    return vocabularies.select("block", "part", "first", "pretokens").repartition("part").sortWithinPartitions("part").mapInArrow(
        count, "block long, first int, sizes binary")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of `docs` (doc_id, text), as the tokenizers library has it
    without added begin or end tokens, truncation or padding; special strings in a text count as one token each.

    Null texts count as empty: 0 bytes, 0 tokens. Rows that repeat, and null doc_ids, come back as they are. Other
    columns are ignored.
    """
    parts = PARTS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = stored(block_lists(docs, tokenizer, parts), "block_lists")
    vocabularies = lists.where("pretokens is not null")
    counted = piece_counts(vocabularies, tokenizer)
    rows = lists.where("pretokens is null").select("block", "doc_id", "n_bytes", "special", "numbers", "counts")

    def total(documents: pa.Table, pieces: pa.Table) -> pa.Table:
        """One block: its texts are bounded, and so are both sides."""
        ordered = sorted(zip(pieces.column("first").to_pylist(), pieces.column("sizes").to_pylist()))
        sizes = np.concatenate([np.zeros(0, np.int64), *[unpacked(x) for _, x in ordered]])
        sums = [int(sizes[np.cumsum(unpacked(numbers))] @ unpacked(counts)) + special for numbers, counts, special in zip(
            *(documents.column(x).to_pylist() for x in ("numbers", "counts", "special")))]
        return pa.table({"doc_id": documents.column("doc_id"), "n_bytes": documents.column("n_bytes"), "n_tokens": pa.array(sums, pa.int64())})

    return rows.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        total, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
