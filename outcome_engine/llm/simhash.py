"""SimHash near-deduplication with a Gray-order hierarchical index.

Fingerprints that differ in at most 4 of 64 bits agree wholly on one of 5 blocks of bits. So every fingerprint goes to
5 groups, one for each block and its value; in a group a hierarchical index over the fingerprints, sorted by Gray rank,
finds those within the distance. Its nodes hold the bits that all fingerprints below share and that no node above holds
already; the differences on these bits add up on the way down, and whole groups fall away once they exceed the limit.
Groups pass on links that connect their members, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, strings, whole_text
from .components import connected_components

BITS, DISTANCE, WORDS, SEED = 64, 4, 4, 42
GROUP_ROWS = 8_000  # fingerprints of a group from which it is split; its parts meet two by two
FANOUT = 8


# ------------------------------------------------------------------ fingerprints

def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of a text: a bit is set if it is set in over half the hashes of the word shingles, repeats included."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(x) + 1 for x in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends[min(words, len(tokens)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long): the fingerprint of every whole text; null and wordless texts have 0."""

    def hashed(batches):
        for batch in slices(batches):
            codes = np.array([fingerprint(x, words, seed) for x in strings(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(hashed, "doc_id long, fp long")


# ------------------------------------------------------------------ the index

def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order, in which neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of masked bit patterns over codes in Gray order; level 0 holds the codes themselves."""

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT):
        self.fanout = fanout
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        self.bits = [self.codes]
        shared = [np.full(len(codes), ~np.uint64(0))]
        all_, any_ = self.codes, self.codes
        while len(all_) > fanout:
            starts = np.arange(0, len(all_), fanout)
            all_, any_ = np.bitwise_and.reduceat(all_, starts), np.bitwise_or.reduceat(any_, starts)
            self.bits.append(all_)
            shared.append(~(all_ ^ any_))
        #: bits that a node settles and no node above it
        self.own = [m & ~np.repeat(above, fanout)[:len(m)] for m, above in zip(shared, shared[1:])] + [shared[-1]]

    def connect(self, distance: int = DISTANCE) -> np.ndarray:
        """Root (an index into codes) of each code: codes within the distance are connected, through others as well."""
        n, roots = len(self.codes), np.arange(len(self.codes))
        block = max(1, (1 << 20) // n)
        for start in range(0, n, block):
            single = self._single_roots(roots)
            asked = np.arange(start, min(start + block, n))
            top = len(self.bits) - 1
            query = np.repeat(asked, len(self.bits[top]))
            node = np.tile(np.arange(len(self.bits[top])), len(asked))
            apart = np.zeros(len(query), np.uint8)
            for level in range(top, -1, -1):
                # a node whose codes all come before the query was the query itself before; one component is enough
                width = self.fanout ** level
                useful = ((node + 1) * width > query) & (single[level][node] != roots[query])
                query, node, apart = query[useful], node[useful], apart[useful]
                apart = apart + np.bitwise_count((self.codes[query] ^ self.bits[level][node]) & self.own[level][node])
                near = apart <= distance
                query, node, apart = query[near], node[near], apart[near]
                if level:
                    below = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    query, apart = np.repeat(query, self.fanout), np.repeat(apart, self.fanout)
                    real = below < len(self.bits[level - 1])
                    query, node, apart = query[real], below[real], apart[real]
            merge(roots, query, node)
        return roots

    def _single_roots(self, roots: np.ndarray) -> list[np.ndarray]:
        """For each node the root that all codes below it have, or -1."""
        low, high, found = roots, roots, [roots]
        for level in range(1, len(self.bits)):
            starts = np.arange(0, len(low), self.fanout)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            found.append(np.where(low == high, low, -1))
        return found


def merge(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i], in place; the smallest member is the root."""
    while len(a):
        x, y = roots[a], roots[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = roots[roots]
            if (jumped == roots).all():
                break
            roots[:] = jumped


# ------------------------------------------------------------------ links between fingerprints

def block_edges(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each block of bits."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def link_fingerprints(fps: DataFrame, distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints within the distance, directly or through others."""
    edges = block_edges(distance + 1)
    value = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for low, width in edges]
    grouped = fps.select("fp", F.posexplode(F.array(*value)).alias("block", "value"))
    # at most (distance + 1) * 2^13 groups, so the list of those to split is bounded whatever the input
    large = {(r["block"], r["value"]): -(-r["count"] // (group_rows // 2))
             for r in grouped.groupBy("block", "value").count().where(F.col("count") > group_rows).collect()}

    def deal(batches):
        """Every fingerprint to its groups; in a split group to each pair of parts that holds its own part."""
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False)
            unsigned = codes.view(np.uint64)
            part_hash = ((unsigned * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            out: list[list[np.ndarray]] = []
            for block, (low, width) in enumerate(edges):
                values = ((unsigned >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
                parts = np.array([large.get((block, v), 1) for v in values.tolist()], np.int64)
                plain = np.flatnonzero(parts == 1)
                key = (np.int64(block) << 16) | values
                out.append([key[plain], np.zeros(len(plain), np.int64), codes[plain]])
                for k in np.unique(parts[parts > 1]).tolist():
                    rows = np.flatnonzero(parts == k)
                    own = part_hash[rows] % k
                    for i, j in combinations(range(k), 2):
                        both = rows[(own == i) | (own == j)]
                        out.append([key[both], np.full(len(both), i * k + j + 1), codes[both]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["cell", "pair", "fp"])

    def connect(batches):
        def finish(rows):
            codes = np.concatenate(rows).view(np.uint64)
            index = GrayIndex(codes)
            roots = index.connect(distance)
            signed = index.codes.view(np.int64)
            order = np.lexsort((signed, roots))  # the smallest member of each component is its centre
            first = np.diff(roots[order], prepend=-1) != 0
            centre = signed[order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]]
            return centre[~first], signed[order[~first]]

        held, key = [], None
        for batch in batches:
            cell, pair, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])) + 1
            found = []
            for a, b in zip(np.concatenate([[0], cuts]).tolist(), [*cuts.tolist(), len(cell)]):
                if a == b:
                    continue
                now = (int(cell[a]), int(pair[a]))
                if now != key:
                    if sum(map(len, held)) > 1:
                        found.append(finish(held))
                    held, key = [], now
                held.append(fp[a:b])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"])
        if sum(map(len, held)) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in finish(held)], names=["a", "b"])

    cells = fps.select("fp").mapInArrow(deal, "cell long, pair long, fp long")
    return cells.repartition("cell", "pair").sortWithinPartitions("cell", "pair", "fp").mapInArrow(connect, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs` (doc_id, text).

    component_id is the smallest doc_id that can be reached over fingerprints that differ in at most `distance` bits,
    the document's own included. Null and empty texts have fingerprint zero and link like any other. Rows that repeat
    come back as often as they occur; a null doc_id counts only where its component has no other. An empty table gives
    an empty result. Other columns are ignored.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct_fingerprints")
    roots = stored(connected_components(link_fingerprints(distinct, distance)), "roots")
    rooted = stored(distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = stored(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")), "smallest")
    of_print = stored(rooted.join(smallest, "root").select("fp", "component_id"), "of_fingerprint")
    return prints.join(of_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of their component, with all their columns. Rows without a doc_id
    can't be named, so they stay; so do all rows of a doc_id that stays. The texts are shuffled once, unsorted, at every
    size; columns may have any names."""
    found = near_duplicates(docs, distance)
    gone = stored(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone").hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
