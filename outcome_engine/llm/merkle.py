"""Merkle manifest of a dataset: coordinates of leaves from bitmap ranks, levels reduced in keyed slot arrays.

The place of a document among those of its group is a rank query, not a sort. Every task folds the doc_ids that it reads into
compressed bitmaps of 65,536 ids; bitmaps of one (group, chunk) are merged and their popcounts form a directory, a tree with
16 bits of the id a level. A leaf's place is what the directory counts before its chunk plus the popcount before its bit.
Places then key slot arrays of 512 nodes, which lose three levels of eight at a time, until a group has one node left. The way
back down hands every array the siblings above it, so each leaf ends up with its whole path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ARITY, BLOCK_LEVELS = 8, 3
BLOCK = ARITY ** BLOCK_LEVELS
CHUNK_BITS = 16
CHUNK = 1 << CHUNK_BITS
NO_ID = -(1 << 47) - 1  # the chunk of rows without a doc_id, before all others
FULL = CHUNK // 8  # bytes of a plain bitmap; shorter containers list the ids
PENDING = 1 << 20  # ids that a task holds before it hands on what it has
HEAVY_SHARE = 1000  # chunks with over one row in so many are dealt to several tasks; there can't be more than that many
STRETCH = 4096
SIBLINGS = "struct<left: string, right: string>"


# ------------------------------------------------------------------ leaves

def framed(column: str | Column) -> Column:
    """`-` for null, else byte count, colon and value."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns) -> Column:
    """SHA-256 of the framed columns in their order, lower-case hex."""
    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def group_key(column: str) -> Column:
    """Text that sorts bytewise as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


# ------------------------------------------------------------------ compressed bitmaps

def packed(low: np.ndarray) -> bytes:
    """Container of distinct ascending ids below CHUNK: a list of 16-bit ids, or a bitmap where that is shorter."""
    if len(low) * 2 < FULL:
        return low.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) < FULL:
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


class RankedContainer:
    """A container with its popcount directory and the ids that occur more than once."""

    def __init__(self, data: bytes, repeated: bytes, extra: bytes):
        self.ids = None
        if len(data) < FULL:
            self.ids = np.frombuffer(data, "<u2").astype(np.int64)
        else:
            self.words = np.frombuffer(data, "<u8")
            self.before_word = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.repeated = np.frombuffer(repeated, "<u2").astype(np.int64)
        self.extra = np.frombuffer(extra, "<i8")
        self.extra_before = np.concatenate([[0], np.cumsum(self.extra)])

    def rank(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows before, rows of) each id."""
        if self.ids is not None:
            before = np.searchsorted(self.ids, low)
        else:
            word, bit = low >> 6, (low & 63).astype(np.uint64)
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            before = self.before_word[word] + np.bitwise_count(below)
        if not len(self.repeated):
            return before, np.ones(len(low), np.int64)
        at = np.searchsorted(self.repeated, low)
        found = self.repeated[np.minimum(at, len(self.repeated) - 1)] == low
        return before + self.extra_before[at], 1 + np.where(found, self.extra[np.minimum(at, len(self.extra) - 1)], 0)


def counted(low: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes, bytes, int]:
    """(container, repeated ids, how often more than once, rows) of ascending distinct ids and their counts."""
    more = times > 1
    return packed(low), low[more].astype("<u2").tobytes(), (times[more] - 1).astype("<i8").tobytes(), int(times.sum())


def bitmap_directory(leaves: DataFrame) -> DataFrame:
    """One container for each (grp, chunk) of `leaves` (grp, chunk, low): members, repeated, extra, n."""
    names = ["grp", "chunk", "members", "repeated", "extra", "n"]
    schema = "grp string, chunk long, members binary, repeated binary, extra binary, n long"

    def emit(rows):
        types = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def collect(batches):
        """Partial containers of what a task reads."""
        held: dict[tuple, list] = {}
        pending = 0

        def flush():
            return emit([(*key, *counted(*np.unique(np.concatenate(parts), return_counts=True))) for key, parts in held.items()])

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            keys, group = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            chunk, low = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            order = np.lexsort((chunk, group))
            group, chunk, low = group[order], chunk[order], low[order]
            cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(chunk) != 0)) + 1
            for a, part in zip([0, *cuts.tolist()], np.split(low, cuts)):
                if len(part):
                    held.setdefault((keys[group[a]], int(chunk[a])), []).append(part)
            pending += len(low)
            if pending >= PENDING:
                yield flush()
                held, pending = {}, 0
        if held:
            yield flush()

    def merge(batches):
        """Containers of one key follow each other; ids that several hold add up."""
        key, lows, times = None, [], []

        def fold():
            """Adds the parts up, so that never more than a few containers are held."""
            low, where = np.unique(np.concatenate(lows), return_inverse=True)
            total = np.zeros(len(low), np.int64)
            np.add.at(total, where, np.concatenate(times))
            return low, total

        for batch in batches:
            out = []
            for grp, chunk, members, repeated, extra, _ in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (grp, chunk) != key:
                    if key is not None:
                        out.append((*key, *counted(*fold())))
                    key, lows, times = (grp, chunk), [], []
                low = unpacked(members)
                count = np.ones(len(low), np.int64)
                count[np.searchsorted(low, np.frombuffer(repeated, "<u2"))] += np.frombuffer(extra, "<i8")
                lows.append(low)
                times.append(count)
                if len(lows) == 64:
                    folded = fold()
                    lows, times = [folded[0]], [folded[1]]
            if out:
                yield emit(out)
        if key is not None:
            yield emit([(*key, *counted(*fold()))])

    partial = leaves.select("grp", "chunk", "low").mapInArrow(collect, schema)
    return partial.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk").mapInArrow(merge, schema)


def with_places_before(containers: DataFrame) -> DataFrame:
    """Adds `base`: the group's rows in smaller chunks. A tree of sums, 16 bits of the chunk number a level, so that no window
    meets more than 65,536 rows, however the ids are spread."""
    low = containers.select("grp", "chunk", "n")
    levels = [low]
    for _ in range(2):
        levels.append(levels[-1].groupBy("grp", F.shiftright("chunk", CHUNK_BITS).alias("chunk")).agg(F.sum("n").alias("n")))
    base = None
    for level in reversed(levels):
        inside = Window.partitionBy("grp", "parent").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        counts = level.withColumn("parent", F.lit(0) if base is None else F.shiftright("chunk", CHUNK_BITS))
        counts = counts.withColumn("base", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        if base is not None:
            above = base.select("grp", F.col("chunk").alias("parent"), F.col("base").alias("above"))
            counts = counts.join(above, ["grp", "parent"]).withColumn("base", F.col("base") + F.col("above"))
        base = counts.select("grp", "chunk", "base")
    return containers.join(base, ["grp", "chunk"])


# ------------------------------------------------------------------ places

def rank_leaves(leaves: DataFrame, share: int = HEAVY_SHARE, chunk_rows: int = 2 * CHUNK) -> DataFrame:
    """`leaves` (grp, doc_id, leaf, claim) with `place`: 0, 1, ... in each group by doc_id (null first); rows of one doc_id by leaf.

    A chunk that holds over one row in `share`, and more than `chunk_rows`, is dealt to several tasks by leaf; there are
    at most `share` of them, so their list is broadcast.
    """
    coded = leaves.select("grp", "doc_id", "leaf", "claim", F.coalesce(F.shiftright("doc_id", CHUNK_BITS), F.lit(NO_ID)).alias("chunk"),
                          F.coalesce(F.col("doc_id").bitwiseAND(CHUNK - 1), F.lit(0)).alias("low"))
    containers = stored(bitmap_directory(coded), "bitmaps")
    directory = stored(with_places_before(containers), "bitmap_directory")
    total = containers.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(containers.where((F.col("n") > chunk_rows) & (F.col("n") * share > total)).select(
        "grp", "chunk", F.ceil(F.col("n") / chunk_rows).cast("int").alias("spread")))
    spread = F.coalesce("spread", F.lit(1))
    indexes = directory.join(heavy, ["grp", "chunk"], "left").select(
        "grp", "chunk", F.explode(F.sequence(F.lit(0), spread - 1)).alias("deal"), F.lit(0).alias("kind"), "base", "members", "repeated", "extra",
        *[F.lit(None).cast(t).alias(n) for n, t in (("low", "long"), ("doc_id", "long"), ("leaf", "string"), ("claim", "string"))])
    asked = coded.join(heavy, ["grp", "chunk"], "left").select(
        "grp", "chunk", F.pmod(F.xxhash64("leaf"), spread).cast("int").alias("deal"), F.lit(1).alias("kind"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("base", "long"), ("members", "binary"), ("repeated", "binary"), ("extra", "binary"))],
        "low", "doc_id", "leaf", "claim")
    fields = {n: i for i, n in enumerate(asked.columns)}

    def answer(batches):
        """Each container is followed by the rows that ask for their rank in it."""
        container, base = None, 0
        for batch in batches:
            kind = batch.column(fields["kind"]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(kind == 0).tolist()
            before, rows = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            low = batch.column(fields["low"]).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in zip([-1, *starts], [*starts, len(kind)]):
                if a >= 0:
                    base, *parts = (batch.column(fields[n])[a].as_py() for n in ("base", "members", "repeated", "extra"))
                    container = RankedContainer(*parts)
                if b > a + 1:
                    at, times = container.rank(low[a + 1:b])
                    before[a + 1:b], rows[a + 1:b] = at + base, times
            mask = pa.array(kind == 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(fields[n]) for n in ("grp", "doc_id", "leaf", "claim")), pa.array(before), pa.array(rows)],
                names=["grp", "doc_id", "leaf", "claim", "place", "rows"]).filter(mask)

    keys = ["grp", "chunk", "deal"]
    met = indexes.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "kind")
    ranked = stored(met.mapInArrow(answer, "grp string, doc_id long, leaf string, claim string, place long, rows long"), "ranked")
    return ranked.where("rows = 1").drop("rows").unionByName(_ranked_repeats(ranked.where("rows > 1")))


def _ranked_repeats(ranked: DataFrame) -> DataFrame:
    """Places of rows that share a doc_id: by leaf. Equal rows travel as a count and are laid out at the end; leaves are
    ranked within 65,536 classes by their first digits, so that no window holds all rows of a doc_id."""
    same = ranked.groupBy("grp", "place", "leaf").agg(
        F.first("doc_id").alias("doc_id"), F.first("claim").alias("claim"), F.count(F.lit(1)).alias("copies"),
    ).withColumn("digits", F.substring("leaf", 1, 4))
    classes = same.groupBy("grp", "place", "digits").agg(F.sum("copies").alias("copies"))
    before_class = F.coalesce(F.sum("copies").over(
        Window.partitionBy("grp", "place").orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before_leaf = F.coalesce(F.sum("copies").over(
        Window.partitionBy("grp", "place", "digits").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    located = same.withColumn("inside", before_leaf).join(
        classes.select("grp", "place", "digits", before_class.alias("before")), ["grp", "place", "digits"]).withColumn(
        "place", F.col("place") + F.col("before") + F.col("inside"))
    stretches = located.withColumn("start", F.explode(F.expr(f"sequence(0L, copies - 1, {STRETCH}L)"))).repartition("grp", "place", "start")
    one = F.explode(F.expr(f"sequence(start, least(start + {STRETCH}, copies) - 1)"))
    return stretches.withColumn("copy", one).select(
        "grp", "doc_id", "leaf", "claim", (F.col("place") + F.col("copy")).alias("place"))


# ------------------------------------------------------------------ levels

def _up(nodes: Column) -> Column:
    """The level above an array of digests: every eight become their digest."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.concat_ws("", F.slice(nodes, i * ARITY + 1, F.lit(ARITY))), 256))


def _siblings(nodes: Column, index: Column) -> Column:
    """What stands left and right of a node in its run."""
    inside = index % ARITY
    return F.struct(F.concat_ws("", F.slice(nodes, index - inside + 1, inside)).alias("left"),
                    F.concat_ws("", F.slice(nodes, index + 2, F.lit(ARITY - 1) - inside)).alias("right"))


def reduce_tree(nodes: DataFrame, counts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(grp, top) of every group, and the slot arrays of each round. `nodes` (grp, place, digest, and what a leaf carries) hold
    each place of a group once; `counts` (grp, n) their number. A round reduces arrays of 512 places by three levels, or
    fewer where one node is left earlier; there is one for every factor of 512 in the largest group."""
    tops, rounds = [], []
    while True:
        largest = counts.agg(F.max("n")).first()[0] or 0
        carried = [c for c in nodes.columns if c not in ("grp", "place")]
        arrays = nodes.groupBy("grp", F.floor(F.col("place") / BLOCK).cast("long").alias("block")).agg(
            F.array_sort(F.collect_list(F.struct(F.pmod("place", F.lit(BLOCK)).cast("int").alias("slot"), *carried))).alias("members"))
        height = F.when(F.col("n") <= 1, 0).when(F.col("n") <= ARITY, 1).when(F.col("n") <= ARITY ** 2, 2).otherwise(BLOCK_LEVELS)
        level = arrays.join(counts, "grp").select(
            "grp", "block", "members", height.alias("height"), (F.col("n") <= BLOCK).alias("last"), F.col("members.digest").alias("level0"))
        for k in range(1, BLOCK_LEVELS):
            level = level.withColumn(f"level{k}", _up(F.col(f"level{k - 1}")))
        top = F.col(f"level{BLOCK_LEVELS - 1}")
        level = stored(level.withColumn("top", F.when(F.col("height") == 0, F.col("level0")[0]).when(F.col("height") == 1, F.col("level1")[0])
                                        .when(F.col("height") == 2, F.col("level2")[0]).otherwise(F.sha2(F.concat_ws("", top), 256))), "slots")
        rounds.append(level)
        tops.append(level.where("last").select("grp", "top"))
        if largest <= BLOCK:
            break
        nodes = level.where("not last").select("grp", F.col("block").alias("place"), F.col("top").alias("digest"))
        counts = counts.where(F.col("n") > BLOCK).select("grp", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"))
    found = tops[0]
    for more in tops[1:]:
        found = found.unionByName(more)
    return found, rounds


def hand_down(rounds: list[DataFrame], heads: DataFrame) -> DataFrame:
    """Every leaf with what it carries, its path (siblings level by level up to the root) and what its group's head holds.
    `heads`: grp, above (path of the group's top), and further columns."""
    kept = [c for c in heads.columns if c not in ("grp", "above")]
    above = None
    for level in reversed(rounds):
        from_head = level.where("last").join(heads, "grp")
        known = from_head
        if above is not None:
            known = from_head.unionByName(level.where("not last").join(above, ["grp", "block"]).select(*from_head.columns))
        own = F.transform(F.col("members"), lambda m: F.struct(m.alias("member"), F.concat(
            F.slice(F.array(*[_siblings(F.col(f"level{k}"), F.floor(m["slot"] / ARITY ** k).cast("int")) for k in range(BLOCK_LEVELS)]),
                    F.lit(1), F.col("height")), F.col("above")).alias("path")))
        one = known.select("grp", "block", *kept, F.explode(own).alias("one"))
        above = one.select("grp", (F.col("block") * BLOCK + F.col("one.member.slot")).alias("block"), F.col("one.path").alias("above"), *kept,
                           "one.member")
        if level is not rounds[0]:
            above = stored(above.drop("member"), "paths")
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda digest, x: F.sha2(F.concat(x["left"], digest, x["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda x: F.concat(x["left"], x["right"]))), 256)


def manifest(docs: DataFrame, columns=("doc_id", "source", "lang", "n_chars", "text"), doc_id: str = "doc_id", group: str = "lang",
             claim: Column | None = None) -> DataFrame:
    """(doc_id, leaf, claim, subroot, root, path) of every row of `docs`.

    A leaf is the digest of `columns`; the leaves of a group ascend by doc_id, and every 8 consecutive ones become their
    digest until one is left: the subroot. Subroots in the order of their groups (null first, then bytewise) give the root
    likewise. `path` holds the siblings (left, right) of each level up to the root; `claim` is any text computed from a row
    that should travel with its leaf. Nulls in columns, group and doc_id count as values of their own: a null doc_id comes
    first, rows that share a doc_id follow by leaf. Rows that repeat are leaves of their own. Empty texts differ from null.
    Other columns are ignored; an empty table gives an empty result.
    """
    leaves = stored(docs.select(group_key(group).alias("grp"), F.col(doc_id).cast("long").alias("doc_id"), leaf_digest(columns).alias("leaf"),
                                (F.lit(None).cast("string") if claim is None else claim).alias("claim")), "leaves")
    placed = rank_leaves(leaves).withColumnRenamed("leaf", "digest")
    counts = stored(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "group_counts")
    subroots, rounds = reduce_tree(placed, counts)

    # groups are numbered in their order without a task that sees them all: sorted in ranges, ranges counted
    ordered = stored(subroots.withColumnRenamed("top", "subroot").orderBy("grp").withColumn("range", F.spark_partition_id()), "subroots")
    ranges = ordered.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    starts = ranges.select("range", F.coalesce(F.sum("n").over(
        Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    numbered = ordered.join(starts, "range").select(
        F.lit("").alias("grp"), (F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy("grp")) - 1).alias("place"),
        F.col("subroot").alias("digest"), F.col("grp").alias("of"))
    head, head_rounds = reduce_tree(numbered, stored(ordered.agg(F.count(F.lit(1)).alias("n")).select(F.lit("").alias("grp"), "n"), "group_count"))
    heads = hand_down(head_rounds, head.select("grp", F.array().cast(f"array<{SIBLINGS}>").alias("above"), F.col("top").alias("root")))
    heads = stored(heads.select(F.col("member.of").alias("grp"), "above", F.col("member.digest").alias("subroot"), "root"), "heads")
    return hand_down(rounds, heads).select("member.doc_id", F.col("member.digest").alias("leaf"), "member.claim", "subroot", "root",
                                           F.col("above").alias("path"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest of `docs` (doc_id, source, lang, n_chars,
    text), and whether each row still leads to the root along its path once the text's A-Z are lower-cased where `tampered`
    is true. Null texts stay null, and so does a row whose `tampered` is null. Else the rules of manifest() hold."""
    columns = ["doc_id", "source", "lang", "n_chars"]
    text = F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    found = manifest(docs, [*columns, "text"], claim=leaf_digest([*columns, text]))
    folds = found.withColumn("folded_root", folded(F.col("claim"), F.col("path")))
    return folds.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
