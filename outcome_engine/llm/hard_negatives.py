"""Hard negatives over a GNAT: for each anchor its best rows of the same label, then for each of those the best rows of other
labels within a window of scores.

The tree is fitted on a bounded sample; every row is routed to a leaf, and the ranges are those of all rows. A leaf is one
cell, or several where it holds more rows than a cell should. Anchors go to the cells that their windows may meet, the most
promising one first: its results narrow the windows before the others are asked, in rounds of ever more cells. In a cell a
tree of its own, down to exact leaves, does the same, so that a task holds one cell and a batch of anchors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .gnat import Gnat, norms, products

SAMPLE = 65_536  # vectors that reach the driver, at most (expected)
SAMPLE_A_LEAF = 16
CELL_FACTOR = 32  # a cell has about so many times the square root of all rows
CELL_NUMBERS = 1 << 24  # components of a cell
ROUND_GROWTH = 32  # a round asks so many times the cells of all rounds before
LEAF_ROWS, ANCHOR_ROWS = 512, 256
ANCHOR = "struct<id: long, mark: long>"
FOUND = f"anchor {ANCHOR}, win int, vec_id long, score long"


def take_part(embeddings: DataFrame, scale: int = 256, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, codes array<double>) of rows that take part: vec_id, label, vector and all components are there and
    finite. Labels of every `shift_every`th vec_id move on by one; a component x becomes floor(scale * x)."""
    label = F.col("label").cast("long")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("codes"))
    inf = float("inf")
    fine = F.forall("codes", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("codes").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        "vec_id", F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).alias("label"),
        F.transform("codes", lambda x: F.floor(x * scale).cast("double")).alias("codes"))


def matrix(vectors: pa.Array, fill: float = 0.0) -> np.ndarray:
    """Rows of a list column as a matrix; shorter ones end in `fill`."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.full((len(lengths), width), fill)
    out[np.arange(width)[None] < lengths[:, None]] = flat
    return out


def padded(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def decoded(codes: pa.Array, kind: str) -> np.ndarray:
    """Packed vectors as a matrix of doubles."""
    raw = codes.to_pylist()
    size = np.dtype(kind).itemsize
    width = max((len(x) for x in raw), default=0) // size
    whole = b"".join(x.ljust(width * size, b"\0") for x in raw)
    return np.frombuffer(whole, kind).reshape(len(raw), width).astype(float)


class VectorIndex:
    """Cells of packed vectors under a fitted tree."""

    def __init__(self, tree: Gnat, cells: np.ndarray, kind: str, rows: DataFrame):
        self.tree, self.cells, self.kind, self.rows = tree, cells, kind, rows

    @staticmethod
    def build(rows: DataFrame, seed: int = 42, sample_rows: int = SAMPLE, cell_rows: int | None = None) -> "VectorIndex":
        """Index of `rows` (vec_id, label, codes): every row is in it. `sample_rows` bounds the fit alone."""
        size = F.array_max(F.transform("codes", lambda x: F.abs(x)))
        count, width, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("codes")), F.max(size)).first()
        width = max(width or 1, 1)
        kind = "<f8"
        for smaller, limit in (("<i4", 1 << 31), ("<i2", 1 << 15)):
            kind = smaller if (largest or 0) < limit else kind
        cell_rows = cell_rows or max(1, min(CELL_NUMBERS // width, math.ceil(CELL_FACTOR * math.sqrt(count))))
        leaves = min(max(1, count // cell_rows), sample_rows // SAMPLE_A_LEAF)
        wanted = SAMPLE_A_LEAF * leaves
        sample = [r.codes for r in rows.where(F.rand(seed) < wanted / max(count, 1)).select("codes").collect()] if leaves > 1 else []
        tree = Gnat(padded([np.array([x], float).reshape(1, -1) for x in sample]) if sample else np.zeros((0, width)), SAMPLE_A_LEAF, seed=seed)

        def survey(batches):
            """Ranges, and rows a leaf as ranges of node -1, of all that a task reads."""
            counts = np.zeros(tree.leaves, np.int64)
            for batch in batches:
                counts += np.bincount(tree.route(matrix(batch.column(0)), measure=True), minlength=tree.leaves)
            rows_of = [(-1, int(leaf), 0, 0.0, float(counts[leaf])) for leaf in np.flatnonzero(counts)]
            if found := tree.measures() + rows_of:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["node", "point", "child", "low", "high"])

        seen = rows.select("codes").mapInArrow(survey, "node long, point long, child long, low double, high double").groupBy(
            "node", "point", "child").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("high").alias("total")).collect()
        tree.take([r[:5] for r in seen if r.node >= 0])
        counts = np.zeros(tree.leaves)
        for r in seen:
            if r.node < 0:
                counts[r.point] = r.total
        parts = np.maximum(1, np.ceil(counts / (2 * cell_rows))).astype(np.int64)
        cells = np.concatenate([[0], np.cumsum(parts)])

        def deal(batches):
            """Leaf and part of each row; equal vec_ids share a part."""
            for batch in batches:
                codes = matrix(batch.column(2))
                leaf = tree.route(codes)
                mixed = (batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                cell = cells[leaf] + (mixed.astype(np.int64) % parts[leaf])
                lengths = batch.column(2).value_lengths().to_pylist()
                packed = [row[:n].astype(kind).tobytes() for row, n in zip(codes, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                                                 names=["cell", "vec_id", "label", "codes"])

        dealt = stored(rows.select("vec_id", "label", "codes").mapInArrow(deal, "cell long, vec_id long, label long, codes binary"), "vector_cells")
        return VectorIndex(tree, cells, kind, dealt)

    # -------------------------------------------------------------- search

    def search(self, queries: DataFrame, same_label: bool, k: int) -> DataFrame:
        """(anchor, win, vec_id, score): for each window of each query the k best rows by (score descending, vec_id).

        `queries`: anchor (its key), vec_id, label, codes, lows array<double>, highs array<double>. A row may be found if it
        has the query's label (or, without `same_label`, another one), its score is within the window, both ends included,
        and it is not the query's own row.
        """
        tree, cells, kind = self.tree, self.cells, self.kind
        cell_count = int(cells[-1])
        best = None
        first = 0
        while first < cell_count:
            last = max(1, first * ROUND_GROWTH)

            def visits(batches, first=first, last=last):
                """The cells that a query's windows may meet, by the best score they may have: of those from `first` to `last`
                the ones that can still better a window."""
                for batch in batches:
                    for start in range(0, batch.num_rows, ANCHOR_ROWS):
                        part = batch.slice(start, ANCHOR_ROWS)
                        lows, highs, floors = matrix(part.column(4), np.inf), matrix(part.column(5), -np.inf), matrix(part.column(6), np.inf)
                        found = [(np.full(len(at), leaf), at, top) for leaf, at, top in tree.survivors(decoded(part.column(3), kind), lows, highs)]
                        if not found:
                            continue
                        leaf, at, top = (np.concatenate(c) for c in zip(*found))
                        split = (cells[leaf + 1] - cells[leaf]).astype(np.int64)
                        leaf, at, top = (np.repeat(x, split) for x in (leaf, at, top))
                        inside = np.arange(len(leaf)) - np.repeat(np.cumsum(split) - split, split)
                        order = np.lexsort((cells[leaf] + inside, -top, at))
                        leaf, at, inside = leaf[order], at[order], inside[order]
                        place = np.arange(len(at)) - np.searchsorted(at, at)
                        now = (place >= first) & (place < last) & (floors[at] <= top[order][:, None]).any(1)
                        if now.any():
                            rows = part.take(pa.array(at[now]))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array((cells[leaf] + inside)[now]), *(rows.column(i) for i in (0, 1, 2, 3, 6, 5))],
                                names=["cell", "anchor", "vec_id", "label", "codes", "lows", "highs"])

            asked = queries.select("anchor", "vec_id", "label", "codes", "lows", "highs", F.col("lows").alias("floors"))
            if best is not None:  # a window that has its k rows starts at the worst of them
                floors = best.groupBy("anchor", "win").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).where(F.col("n") >= k)
                floors = floors.groupBy(F.col("anchor").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("win", F.col("worst").cast("double")))).alias("worst"))
                raised = F.transform("lows", lambda x, i: F.greatest(x, F.element_at("worst", i)))
                asked = asked.join(floors, F.col("anchor") == F.col("of"), "left").withColumn(
                    "floors", F.when(F.col("worst").isNull(), F.col("lows")).otherwise(raised)).drop("of", "worst")
            sent = asked.mapInArrow(visits, f"cell long, anchor {ANCHOR}, vec_id long, label long, codes binary, lows array<double>, highs array<double>")
            none = [F.lit(None).cast(t).alias(n) for n, t in (("anchor", ANCHOR), ("lows", "array<double>"), ("highs", "array<double>"))]
            held = self.rows.select("cell", none[0], "vec_id", "label", "codes", *none[1:], F.lit(0).alias("kind"))
            met = held.unionByName(sent.withColumn("kind", F.lit(1))).repartition(cell_count, "cell").sortWithinPartitions("cell", "kind")
            found = met.mapInArrow(cell_search(kind, same_label, k), FOUND)
            if best is not None:
                found = found.unionByName(best)
            order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "vec_id")
            best = stored(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place"), "best")
            first = last
        return best


def cell_search(kind: str, same_label: bool, k: int):
    """Streams cells, each with its rows before the queries that visit it."""

    def run(batches):
        cell, rows, tree = None, [], None
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            is_query = batch.column(7).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(is_query) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                if a == b:
                    continue
                if at[a] != cell:
                    cell, rows, tree = at[a], [], None
                part = batch.slice(a, b - a)
                if not is_query[a]:
                    rows.append((part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False), decoded(part.column(4), kind)))
                    continue
                if not rows:
                    continue
                if tree is None:
                    tree = Cell(rows)
                for start in range(0, part.num_rows, ANCHOR_ROWS):
                    some = part.slice(start, ANCHOR_ROWS)
                    found = tree.best(some.column(2).to_numpy(zero_copy_only=False), some.column(3).to_numpy(zero_copy_only=False),
                                      decoded(some.column(4), kind), matrix(some.column(5), np.inf), matrix(some.column(6), -np.inf), same_label, k)
                    if found is not None:
                        query, window, vec_id, score = found
                        yield pa.RecordBatch.from_arrays([some.column(1).take(pa.array(query)), pa.array(window.astype(np.int32)), pa.array(vec_id),
                                                          pa.array(score, pa.int64())], names=["anchor", "win", "vec_id", "score"])

    return run


class Cell:
    """Rows of a cell in the order of the leaves of their own tree."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        ids, labels, codes = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), padded([r[2] for r in rows])
        if len(np.unique(ids)) < len(ids):  # rows that repeat count once
            order = np.lexsort((*codes.T, labels, ids))
            ids, labels, codes = ids[order], labels[order], codes[order]
            new = (np.diff(ids) != 0) | (np.diff(labels) != 0) | (np.diff(codes, axis=0) != 0).any(1)
            first = np.concatenate([[True], new])
            ids, labels, codes = ids[first], labels[first], codes[first]
        self.tree = Gnat(codes, LEAF_ROWS)
        leaf = self.tree.route(codes, measure=True)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.labels, self.codes = ids[order], labels[order], codes[order]
        self.starts = np.searchsorted(leaf[order], np.arange(self.tree.leaves + 1))
        self.sizes = norms(self.codes)

    def best(self, ids, labels, codes, lows, highs, same_label: bool, k: int):
        """(query, window, vec_id, score) arrays of the k best rows of each window, or None."""
        lows, own, held = lows.copy(), norms(codes), []
        for leaf, at, top in self.tree.survivors(codes, lows, highs):
            for a in range(self.starts[leaf], self.starts[leaf + 1], 4 * LEAF_ROWS):
                b = min(a + 4 * LEAF_ROWS, self.starts[leaf + 1])
                scores = products(codes[at], self.codes[a:b])
                label_fits = (self.labels[None, a:b] == labels[at, None]) == same_label
                near = label_fits & (scores >= lows[at].min(1)[:, None]) & (scores <= highs[at].max(1)[:, None])
                # the query's own row has its vec_id and, by length and score, its vector
                near &= ~((self.ids[None, a:b] == ids[at, None]) & (scores == own[at, None]) & (self.sizes[None, a:b] == own[at, None]))
                query, row = np.nonzero(near)
                if not len(query):
                    continue
                score, query, vec_id = scores[query, row], at[query], self.ids[a + row]
                for window in range(lows.shape[1]):
                    inside = (score >= lows[query, window]) & (score <= highs[query, window])
                    if inside.any():
                        held.append((query[inside], np.full(int(inside.sum()), window), vec_id[inside], score[inside]))
            if sum(len(h[0]) for h in held) > 16 * k * len(ids):
                held = [self._cut(held, k, lows)]
        return self._cut(held, k, lows) if held else None

    @staticmethod
    def _cut(held, k: int, lows: np.ndarray):
        """The k best of each window; windows that have k start at the worst of them from now on."""
        query, window, vec_id, score = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((vec_id, -score, window, query))
        query, window, vec_id, score = query[order], window[order], vec_id[order], score[order]
        key = query * lows.shape[1] + window
        place = np.arange(len(key)) - np.searchsorted(key, key)
        last = place == k - 1
        lows[query[last], window[last]] = np.maximum(lows[query[last], window[last]], score[last].astype(float))
        kept = place < k
        return query[kept], window[kept], vec_id[kept], score[kept]


def hard_negatives(embeddings: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, low_percent: int = 30,
                   high_percent: int = 90, cell_rows: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    `embeddings` (vec_id, embedding, label) is reduced by take_part(). Anchors are rows whose vec_id is divisible by
    `anchor_every`; scores are integer inner products, the higher the better, ties by smaller vec_id. An anchor's positives
    are its best `positives` other rows of its label; a positive's negatives the best `negatives` rows of other labels with
    low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score. Rows that repeat in vec_id, label and
    vector count once; other rows of one vec_id are rows of their own. Vectors of fewer components end in zeros. Rows
    without vec_id, label or finite vector take no part. Scores must fit a long. An empty table gives an empty result.
    """
    index = VectorIndex.build(stored(take_part(embeddings), "vectors"), cell_rows=cell_rows)
    inf = F.lit(float("inf"))
    anchors = stored(index.rows.where(F.col("vec_id") % anchor_every == 0).select("vec_id", "label", "codes").distinct().select(
        F.struct(F.col("vec_id").alias("id"), F.xxhash64("label", "codes").alias("mark")).alias("anchor"), "vec_id", "label", "codes"), "anchors")
    best = index.search(anchors.withColumns({"lows": F.array(-inf), "highs": F.array(inf)}), True, positives)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    placed = best.select("anchor", (F.row_number().over(order) - 1).alias("win"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    placed = stored(placed, "positives")
    ends = F.struct("win", F.ceil(F.col("positive_score") * low_percent / 100).cast("double").alias("low"),
                    F.floor(F.col("positive_score") * high_percent / 100).cast("double").alias("high"))
    windows = placed.groupBy(F.col("anchor").alias("of")).agg(F.array_sort(F.collect_list(ends)).alias("ends"))
    asked = stored(anchors.join(windows, F.col("anchor") == F.col("of")).select(
        "anchor", "vec_id", "label", "codes", F.col("ends.low").alias("lows"), F.col("ends.high").alias("highs")), "negative_windows")
    found = index.search(asked, False, negatives)
    rank = F.row_number().over(Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "vec_id"))
    ranked = found.select("anchor", "win", rank.alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return ranked.join(placed, ["anchor", "win"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
