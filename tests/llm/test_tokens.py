"""Packing, token files, token counts and BPE against the tokenizers library, row by row."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from outcome_engine.llm import bpe, packing, records, token_counts, tokens

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def libraries():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@pytest.fixture(scope="module")
def coders():
    return {p: tokens.CachedEncoder(p, cache=500) for p in (BYTE, WORD)} | {"bpe": bpe.TextCoder(WORD)}


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


TEXTS = st.text(alphabet=st.sampled_from(list("ab eEéÉœŒǅʰ'stldm\n\t  .,!#9é̂ßΣİ日😀\x1c\x85 <|>")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_cached_ids_are_the_librarys(libraries, coders, text):
    for path in (BYTE, WORD):
        assert coders[path].encode([text])[0] == tokens.little_endian(ids_of(libraries[path], text))
    ids = ids_of(libraries[WORD], text)
    n, decimal, decoded = coders["bpe"].encode([text])[0]
    assert (n, decimal) == (len(ids), " ".join(map(str, ids)))
    assert decoded == libraries[WORD].decode(ids, skip_special_tokens=False)


MARKED = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endof", "\n", "\n\n", " ", "  ", "\t", "x", "don't", "a!", "É", "\x1c", "9"]),
                  max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(MARKED)
def test_special_strings_among_white_space(libraries, coders, text):
    for path in (BYTE, WORD):
        assert coders[path].encode([text, "b"])[0] == tokens.little_endian(ids_of(libraries[path], text))
    ids = ids_of(libraries[WORD], text)
    assert coders["bpe"].encode([text])[0] == (len(ids), " ".join(map(str, ids)), libraries[WORD].decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("text", ["<|endoftext|>" * 5000, "a\n\n<|startoftext|>" * 5000])
def test_many_special_strings(libraries, coders, text):
    for path in (BYTE, WORD):
        assert coders[path].encode([text])[0] == tokens.little_endian(ids_of(libraries[path], text))
    assert coders["bpe"].encode([text])[0][0] == len(ids_of(libraries[WORD], text))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_block_counts_are_the_librarys(libraries, text):
    library = tokens.load(BYTE)
    block = token_counts.Block(library, token_counts.special_strings(BYTE))
    block.add(1, text)
    block.add(2, text + " the<|endoftext|> end")
    numbers, counts, lists = block.finish(parts=7)
    names = [x for _, _, part in lists for x in part]
    size = np.array([len(ids_of(libraries[BYTE], x)) for x in names])
    for i, whole in enumerate((text, text + " the<|endoftext|> end")):
        total = sum(size[np.cumsum(token_counts.unpacked(numbers[i]))] * token_counts.unpacked(counts[i])) + block.rows[i][2]
        assert total == len(ids_of(libraries[BYTE], whole))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aehinort", min_size=1, max_size=14), min_size=1, max_size=20))
def test_both_kinds_of_merging_agree_with_speculation(coders, words):
    coder = coders["bpe"].bpe
    exact = [coder.merged(w) for w in words]
    assert coder.merged_together(words) == exact
    assert coder.encode_words(words) == exact


def test_packing_places_every_piece_once(spark, hard, hard_rows, libraries):
    found = packing.pack(hard, BYTE, end_id=2, capacity=1024).collect()
    wanted = Counter()
    for doc_id, text, *_ in hard_rows:
        ids = [*ids_of(libraries[BYTE], text), 2]
        start, stop, piece = 0, (len(ids) - 1) % 1024 + 1, 0
        while start < len(ids):
            wanted[doc_id, piece, start, stop - start, crc(ids[start:stop])] += 1
            start, stop, piece = stop, stop + 1024, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in found) // 1024) + 1


def test_packing_is_close_to_the_least_number():
    rng = np.random.default_rng(1)
    lengths = Counter(rng.integers(1, 1025, 30_000).tolist())
    plan = packing.make_plan(lengths)
    assert plan.sequences <= 1.003 * sum(a * n for a, n in lengths.items()) / 1024
    halves = packing.make_plan({513: 1000, 511: 1000, 300: 30, 1024: 5})
    assert halves.sequences == 1015


@pytest.mark.parametrize("times", [100, 700, 5000])
def test_packing_solves_the_program_at_every_size(times):
    plan = packing.make_plan({522: 6 * times, 276: 6 * times, 266: 6 * times, 236: 12 * times})
    assert plan.sequences == 9 * times == round(plan.bound, 6)


def test_packing_of_exact_triples():
    rng = np.random.default_rng(1)
    need = Counter()
    for _ in range(300):
        a, b = sorted(rng.choice(np.arange(100, 924), 2, replace=False).tolist())
        need.update([a, b - a, 1024 - b])
    plan = packing.make_plan(need)
    assert 300 - 1e-6 <= plan.bound <= plan.sequences <= 303


def test_the_bound_is_below_every_plan():
    assert packing.make_plan({700: 10, 1024: 2}).bound == 12  # two pieces of 700 never share a sequence
    assert packing.make_plan({}).sequences == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 24), st.floats(0.1, 5)), min_size=1, max_size=6, unique_by=lambda x: x[0]))
def test_knapsack_against_all_configurations(items):
    prices = np.zeros(25)
    for length, price in items:
        prices[length] = price
    best = [0.0] * 25
    for room in range(1, 25):
        best[room] = max([best[room - 1]] + [best[room - n] + p for n, p in items if n <= room])
    value, counts = packing.best_configuration(prices, 24)
    assert value == pytest.approx(best[24]) and (counts * np.arange(25)).sum() <= 24
    assert (counts * prices).sum() == pytest.approx(value) and not counts[prices == 0].any()


def test_salted_ranks_have_no_gap(spark, hard):
    pieces = packing.cut_documents(hard, BYTE, 2, 64)
    ranks = {}
    for r in packing.number_in_group(pieces, salts=5).collect():
        ranks.setdefault(r.length, []).append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())


def test_token_files_round_trip(spark, hard, hard_rows, libraries, tmp_path):
    folder = f"file://{tmp_path}/files"
    records.write_token_files(hard, folder, WORD, end_id=1, partitions=3)
    read = records.read_in_order(spark, folder).orderBy("start").collect()
    order = sorted(hard_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in read] == [r[0] for r in order]
    start, wanted = 0, Counter()
    for r in read:
        assert r.start == start
        start += r.n_tokens
    for doc_id, text, *_ in hard_rows:
        ids = [*ids_of(libraries[WORD], text), 1]
        wanted[doc_id, len(ids), crc(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in read) == wanted
    shuffled = records.read_shuffled(spark, folder, seed=5).orderBy("draw").collect()
    assert Counter((r.doc_id, len(r.ids), crc(r.ids)) for r in shuffled) == wanted
    assert [r.doc_id for r in shuffled] != [r.doc_id for r in read]


def test_damaged_token_files_are_noticed(spark, hard, tmp_path):
    folder = f"file://{tmp_path}/files"
    records.write_token_files(hard, folder, WORD, end_id=1, partitions=2)
    victim = next(tmp_path.glob("files/*.rec"))
    data = bytearray(victim.read_bytes())
    data[len(data) // 2] ^= 1
    victim.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        records.read_in_order(spark, folder).collect()


def test_counts_and_coding_of_hard_rows(spark, hard, hard_rows, libraries):
    counted = Counter(tuple(r) for r in token_counts.count_tokens(hard, BYTE, 50).collect())
    wanted = Counter()
    for doc_id, text, *_ in hard_rows:
        n = len(ids_of(libraries[BYTE], text))
        wanted[doc_id, len((text or "").encode()), n, n > 50] += 1
    assert counted == wanted
    coded = Counter(tuple(r) for r in bpe.encode_and_decode(hard, WORD).collect())
    wanted = Counter()
    for doc_id, text, *_ in hard_rows:
        ids = ids_of(libraries[WORD], text)
        wanted[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
               hashlib.sha256(libraries[WORD].decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert coded == wanted


def test_empty_tables(spark, empty):
    assert packing.pack(empty, BYTE, 2).count() == 0
    assert records.token_file_digest(empty, WORD, 1).count() == 0
    assert token_counts.count_tokens(empty, BYTE).count() == 0
    assert bpe.encode_and_decode(empty, WORD).count() == 0
