"""Merkle manifest, hard negatives and line deduplication against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from outcome_engine.llm import gnat, hard_negatives, line_dedup, merkle

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


# ------------------------------------------------------------------ manifest

def slow_leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def slow_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def slow_audit(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for row in rows:
        bent = row[1]
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and bent is not None:
            bent = bent.translate(ASCII_LOWER)
        groups[row[2]].append((row[0] is not None, row[0] or 0, slow_leaf(row, row[1]), slow_leaf(row, bent), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: slow_levels([x[2] for x in sorted(groups[g])]) for g in names}
    head = slow_levels([trees[g][-1][0] for g in names])
    out = []
    for number, g in enumerate(names):
        for place, (_, _, leaf, claim, doc) in enumerate(sorted(groups[g])):
            others, now = [], claim
            for levels, at in ((trees[g], place), (head, number)):
                for level in levels[:-1]:
                    run = level[at // 8 * 8:at // 8 * 8 + 8]
                    others += run[:at % 8] + run[at % 8 + 1:]
                    now = digest(*run[:at % 8], now, *run[at % 8 + 1:])
                    at //= 8
            out.append((doc, leaf, trees[g][-1][0], head[-1][0], digest(*others), now, now == head[-1][0]))
    return sorted(out, key=str)


def audited(df):
    return sorted(map(tuple, merkle.audit(df, F.crc32(F.col("doc_id").cast("string")) % 3 == 0).collect()), key=str)


def test_manifest_of_hard_rows(hard, hard_rows):
    assert audited(hard) == slow_audit(hard_rows)


def test_manifest_of_spread_ids_and_groups_beyond_a_block(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-10 ** 6, 10 ** 6), 900) + rng.sample(range(1 << 40, 1 << 62), 300) + [-(1 << 63), (1 << 63) - 1, 0]
    rows = [(i, rng.choice(["Ab", "c", ""]), "big" if k % 9 else f"g{k % 4}", "s", 1) for k, i in enumerate(ids)]
    rows += [(5, f"t{i}", "big", "s", 1) for i in range(40)] + [(5, "same", "big", "s", 1)] * 30 + [(None, None, None, None, None)] * 3
    found = audited(spark.createDataFrame(rows, DOCUMENTS).repartition(7))
    assert found == slow_audit(rows) and {r[-1] for r in found} == {True, False}


def test_a_single_row_and_an_empty_table(spark, empty):
    rows = [(4, "Only One", "en", "s", 8)]
    assert audited(spark.createDataFrame(rows, DOCUMENTS)) == slow_audit(rows)
    assert audited(empty) == []


def test_heavy_chunks_are_dealt_to_several_tasks(spark):
    leaves = spark.range(5000).select(F.lit("=x").alias("grp"), (F.col("id") % 700).alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"),
                                      F.lit(None).cast("string").alias("claim"))
    places = merkle.rank_leaves(leaves, share=10, chunk_rows=600).orderBy("place").collect()
    assert [r.place for r in places] == list(range(5000))
    assert [(r.doc_id, r.leaf) for r in places] == sorted((i % 700, digest(str(i))) for i in range(5000))


def test_containers_rank_lists_and_bitmaps():
    rng = np.random.default_rng(1)
    for size in (1, 50, 4095, 4096, 30_000, 65_536):
        low = np.sort(rng.choice(65_536, size, replace=False))
        times = rng.integers(1, 4, size)
        data, repeated, extra, n = merkle.counted(low, times)
        assert len(data) <= merkle.FULL and n == times.sum() and (merkle.unpacked(data) == low).all()
        before, rows = merkle.RankedContainer(data, repeated, extra).rank(low)
        assert (before == np.cumsum(times) - times).all() and (rows == times).all()


# ------------------------------------------------------------------ lines

def slow_lines(rows, least, least_chars=1, keep_first=False):
    documents = {(r[0], r[1] or "") for r in rows}
    order = sorted(documents, key=lambda d: (d[0] is not None, d[0] or 0, hashlib.md5(d[1].encode()).digest()))
    places = defaultdict(list)
    for doc in order:
        for place, line in enumerate(doc[1].split("\n")):
            key = line.strip(line_dedup.SPACE).translate(ASCII_LOWER)
            if len(key) >= max(1, least_chars):
                places[key].append((doc, place))
    gone = set()
    for found in places.values():
        if len({doc for doc, _ in found}) >= least:
            gone.update(found[1:] if keep_first else found)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [line for place, line in enumerate(lines) if ((r[0], r[1] or ""), place) not in gone]
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def line_rows(hard_rows):
    rng = random.Random(5)
    rows = [(1000 + i, "\n".join(rng.choice(["Hot Line ", "\thot line", f"own {i}", f"rare {i % 40}", "", "  ", f"some {i % 7}"])
                                 for _ in range(rng.randint(1, 12))), "en", "s", 1) for i in range(400)]
    return hard_rows + rows + rows[:5] + [(1001, "hot line\nanother text of the same id", "en", "s", 1)]


@pytest.mark.parametrize("least, chars, first", [(10, 1, False), (2, 1, False), (3, 6, True), (1, 1, True)])
def test_lines_against_brute_force(spark, line_rows, least, chars, first):
    df = spark.createDataFrame(line_rows, DOCUMENTS).withColumns({n: F.lit("clash") for n in ("line", "places", "keep", "n_lines", "text_id")})
    for partitions in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found = line_dedup.deduplicate_lines(df, least, chars, first).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert sorted(map(tuple, found), key=str) == slow_lines(line_rows, least, chars, first)


def test_bitmaps_and_empty_table(spark, empty):
    rows = [(i, "x\n\n" + f"y{i}", "en", "s", 1) for i in range(10)] + [(50, "alone", "en", "s", 1)]
    found = line_dedup.keep_bitmaps(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert sorted(r.doc_id for r in found) == list(range(10))  # documents that lose nothing have no bitmap
    assert {(r.n_lines, r.n_dropped, zlib.decompress(r.keep)) for r in found} == {(3, 1, bytes([0b110]))}
    assert line_dedup.deduplicate_lines(empty).collect() == []


# ------------------------------------------------------------------ hard negatives

def slow_negatives(rows, positives=5, negatives=10, low=30, high=90):
    """Sorted result rows; `rows` (vec_id, vector, label) may hold anything that take_part() leaves out."""
    parts = set()
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        codes = [int(np.floor(256 * float(np.float32(x)))) for x in vector]
        while codes and codes[-1] == 0:
            codes.pop()
        parts.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(codes)))
    out = []
    for me in parts:
        if me[0] % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(me[2], x[2])), x[0], x[1]) for x in parts if x != me)
        for score, positive, _ in [x for x in scored if x[2] == me[1]][:positives]:
            score = -score
            fits = [x for x in scored if x[2] != me[1] and low * score <= -100 * x[0] <= high * score][:negatives]
            out += [(me[0], positive, rank, x[1], score, -x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(out)


EMBEDDINGS = "vec_id long, embedding array<float>, label int, cell string, anchor string"


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], EMBEDDINGS).repartition(5)
    return sorted(map(tuple, hard_negatives.hard_negatives(df, **options).collect()))


def made_vectors(n, width, seed, centres=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    return [(i, [float(x) for x in np.float32(middle[i % centres] + 0.4 * rng.normal(size=width))], int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("cell_rows", [None, 60])
def test_negatives_against_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(hard_negatives, "ROUND_GROWTH", 3)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 16)
    rows = made_vectors(1500, 8, 1)
    assert mined(spark, rows, cell_rows=cell_rows) == slow_negatives(rows)


def test_negatives_of_hard_rows(spark):
    rows = made_vectors(300, 5, 2)
    hot = rows[100][1]
    rows += [(1000 + i, hot, i % 3) for i in range(400)]  # one vector more than half of all rows have: ties by vec_id
    rows += [(None, hot, 1), (2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan")] * 5, 1), (2100, [float("inf")] * 5, 1), (2003, hot, None),
             (2200, [], 1), (2300, [0.0] * 5, 2), (2400, hot[:2], 1), (2500, [90000.0, -70000.0, 3.0, 0.0, 1.0], 1)]
    rows += [rows[0], rows[100], (100, rows[7][1], 2), (100, rows[100][1], 9)]  # repeated rows, and others of the same vec_id
    assert mined(spark, rows) == slow_negatives(rows)
    assert mined(spark, rows, cell_rows=40) == slow_negatives(rows)


def test_negatives_of_an_empty_table(spark):
    assert mined(spark, []) == []


def test_the_tree_eliminates_and_loses_nothing():
    rows = np.array([[round(256 * x) for x in r[1]] for r in made_vectors(4000, 3, 3, centres=40)], float)
    tree = gnat.Gnat(rows[::5], 16)
    leaf = tree.route(rows, measure=True)
    scores = gnat.products(rows[:50], rows)
    lows, highs = np.sort(scores, axis=1)[:, -10:-9], np.full((50, 1), np.inf)
    met = np.zeros((50, tree.leaves), bool)
    for number, at, best in tree.survivors(rows[:50], lows, highs):
        met[at, number] = True
        inside = scores[np.ix_(at, leaf == number)]
        assert not inside.size or (inside.max(1) <= best + 1e-3).all()
    query, row = np.nonzero(scores >= lows)
    assert met[query, leaf[row]].all() and met.mean() < 0.5
