"""Exact and near deduplication and document fingerprints against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from outcome_engine.llm import components, digest_index, fingerprints, simhash


# ------------------------------------------------------------------ exact

def index_at(spark, tmp_path, name):
    return digest_index.DigestIndex(spark, name, f"file://{tmp_path}/{name}", buckets=4)


def test_exact_dedup_of_hard_rows(spark, hard, hard_rows, tmp_path):
    groups = defaultdict(list)
    for doc_id, text, *_ in hard_rows:
        groups[text or ""].append(doc_id)
    found = digest_index.deduplicate(hard, index_at(spark, tmp_path, "hard_index")).collect()
    assert len(found) == len(hard_rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = by_digest[r.text_sha256]
        named = [i for i in ids if i is not None]
        assert r.keep_id == (max(named) if named else None) and r.group_size == len(ids)
        assert r.kept == (r.doc_id == r.keep_id)


def test_later_loads_are_held_against_the_index(spark, tmp_path):
    index = index_at(spark, tmp_path, "two_loads")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (5, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(7, "b"), (8, "c"), (9, "c")], "doc_id long, text string")
    digest_index.deduplicate(first, index).collect()
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in digest_index.deduplicate(second, index).collect()}
    assert found == {7: (5, 1, False), 8: (9, 2, False), 9: (9, 2, True)}
    assert {r.keep_id for r in index.rows().collect()} == {1, 5, 9}
    assert digest_index.DigestIndex(spark, "opened_again", f"file://{tmp_path}/two_loads", buckets=4).rows().count() == 3


def test_the_index_joins_without_a_shuffle_of_its_own(spark, tmp_path):
    index = index_at(spark, tmp_path, "plan_index")
    groups = spark.createDataFrame([("d", 1, 1)], "digest string, keep_id long, group_size long")
    plan = index.unseen(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_heavy_and_rare_digests_join_alike(spark):
    digests = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("digest"))
    groups = digest_index.digest_groups(digests).withColumn("fresh", F.lit(True))
    found = digest_index.with_groups(digests, groups)
    assert found.count() == 5000
    assert found.where("digest = 'hot' and keep_id = 4998 and group_size = 1667").count() == 1667


def test_keep_distinct_keeps_all_columns(spark, hard, hard_rows, tmp_path):
    kept = digest_index.keep_distinct(hard, index_at(spark, tmp_path, "kept_index"))
    assert kept.columns == hard.columns
    assert sorted({r.text or "" for r in kept.collect()}) == sorted({r[1] or "" for r in hard_rows})


def test_removing_copies_moves_texts_once_and_takes_any_names(spark, hard, tmp_path):
    named = hard.withColumns({n: F.lit("clash") for n in ("_gone", "_gone_id", "text_sha256", "component_id", "kept")})
    for kept in (digest_index.keep_distinct(named, index_at(spark, tmp_path, "clash_index")), simhash.keep_one(named)):
        assert kept.columns == named.columns and kept.count() > 50
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan


# ------------------------------------------------------------------ near

def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).translate({i: " " for i in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(codes):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


@pytest.mark.parametrize("text", ["", " \t\n", "One", "One two THREE Ä four\x0bfive", "a b c d a b c d a b c d", "ÄÖ x"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def near_codes(n, seed, flips=3):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(max(1, n // 4))]
    out = []
    for _ in range(n):
        code = rng.choice(base)
        for _ in range(rng.randint(0, flips)):
            code ^= 1 << rng.randrange(64)
        out.append(code)
    return sorted(set(out))


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 65, 300])
@pytest.mark.parametrize("fanout", [2, 8])
def test_gray_index_connects_what_brute_force_does(n, fanout):
    index = simhash.GrayIndex(np.array(near_codes(n, n, 5), np.uint64), fanout)
    assert index.connect().tolist() == brute_components([int(c) for c in index.codes])


def test_gray_order_changes_one_bit_at_a_time():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert all(bin(int(a ^ b)).count("1") == 1 for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("group_rows", [4, 8000])
def test_links_connect_all_and_only_near_fingerprints(spark, group_rows):
    codes = near_codes(250, 3)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.link_fingerprints(spark.createDataFrame([(c,) for c in signed], "fp long"), group_rows=group_rows).collect()
    number = {c: i for i, c in enumerate(signed)}
    root = np.arange(len(codes))
    simhash.merge(root, np.array([number[r.a] for r in links]), np.array([number[r.b] for r in links]))
    assert root.tolist() == brute_components(codes)


def test_components_of_paths_stars_and_repeats(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    links = spark.createDataFrame(path[::-1] + star + star + [(7, 7), (500, 499)], "a long, b long")
    found = {r.node: r.root for r in components.connected_components(links).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {499: 499, 500: 499}


def test_near_duplicates_of_hard_rows(spark, hard, hard_rows):
    found = simhash.near_duplicates(hard).collect()
    assert len(found) == len(hard_rows)
    codes = [slow_fingerprint(r[1] or "") for r in hard_rows]
    roots = brute_components(codes)
    least = {}
    for row, root in zip(hard_rows, roots):
        if row[0] is not None:
            least[root] = min(row[0], least.get(root, row[0]))
    wanted = sorted((str(r[0]), f"{c:016x}", str(least.get(root))) for r, c, root in zip(hard_rows, codes, roots))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == wanted


def test_keep_one_keeps_the_smallest_of_each_component(spark, hard):
    kept = simhash.keep_one(hard)
    assert kept.columns == hard.columns
    found = simhash.near_duplicates(hard).where("doc_id is not null").collect()
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {r.component_id for r in found}


# ------------------------------------------------------------------ fingerprints

def test_edited_texts_and_likeness(spark, hard, hard_rows):
    found = fingerprints.imatch(hard).collect()
    order = sorted(hard_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    wanted = []
    for i, row in enumerate(order):
        text, after = row[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        wanted.append((str(row[0]), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == sorted(wanted)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    assert by_id[105].fingerprint == by_id[106].fingerprint == by_id[3].fingerprint
    assert by_id[105].near_next == 1.0
    assert by_id[102].fingerprint == by_id[101].fingerprint == by_id[100].fingerprint


def test_likeness_falls_with_the_share_of_common_terms(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, texts = [], []
    for i in range(120):
        texts.append(rng.sample(words, 60))
    for i, t in enumerate(texts):
        rows.append((i, " ".join(t)))
    lexicon = fingerprints.lexicon(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 300 < lexicon.count() <= 400
    found = fingerprints.imatch(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    edited, following = (np.mean([r[c] for r in found]) for c in ("near_edited", "near_next"))
    assert edited > following + 0.1


def test_terms_end_at_signs_of_every_script(spark):
    rows = [("«Mot» “word”—next…last\u00a0one。二\u3000三", ["mot", "word", "next", "last", "one", "二", "三"]),
            ("d'été: naïve-1 e\u0301 ٣", ["d", "été", "naïve", "1", "e\u0301", "٣"]), ("»…«", [])]
    found = spark.createDataFrame(rows, "text string, wanted array<string>").select(fingerprints.terms(F.col("text")).alias("found"), "wanted").collect()
    assert all([t for t in r.found if t] == r.wanted for r in found)


def test_rare_and_common_terms_do_not_make_texts_alike(spark):
    """Two languages of a few rows in many, copies in over a third of the rows, texts of signs alone."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.sample([f"w{j}" for j in range(3000)], 12))) for i in range(2600)]
    rows += [(3000, "alpha beta gamma delta"), (3001, "alpha beta gamma delta"), (3002, "eins zwei drei vier"), (3003, "!!"), (3004, "??"), (3005, "")]
    rows += [(4000 + i, "one hot text") for i in range(1700)] + [(6000, "one hot"), (6001, "hot text")]
    found = {r.doc_id: r for r in fingerprints.imatch(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[3000].near_next == 1.0 and found[4000].near_next == 1.0
    assert [found[i].near_next for i in (3001, 3002, 3003, 3004, 3005, 5699, 6000)] == [0.0] * 7
    assert len({found[i].fingerprint for i in (3000, 3002, 3003, 3004, 3005, 4000, 6000, 6001)}) == 8


def test_half_shared_texts_are_alike_at_every_length(spark):
    """Texts of as many other terms each: the edited one has half of its terms from the first text, so a third are common."""
    for terms in (200, 3000):
        rows = [(i, " ".join(f"{i:02d}w{j:04d}" for j in range(terms))) for i in range(40)]
        found = fingerprints.imatch(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert abs(np.mean([r.near_edited for r in found]) - 1 / 3) < 0.03
        assert all(r.near_edited > 0.12 and r.near_next == 0 for r in found)


def test_a_single_document_follows_itself(spark):
    r = fingerprints.imatch(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0


def test_empty_tables(spark, empty, tmp_path):
    assert digest_index.deduplicate(empty, index_at(spark, tmp_path, "empty_index")).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert fingerprints.imatch(empty).count() == 0
