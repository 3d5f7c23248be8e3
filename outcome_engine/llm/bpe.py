"""BPE encoding by speculation and verification, and decoding.

A word is first cut greedily into the longest tokens of the vocabulary. That is the result of the merges exactly if no
merge crosses a boundary between two neighbouring tokens, which depends on the two alone: for many pairs at once, numpy
undoes the later built of the two tokens, step by step, and looks whether their touching parts would have merged first.
Only words with a pair that fails are merged one rule after the other.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, strings, whole_text, without_collection
from .tokens import SIGNS, latin_word, load, pieces_between_spaces, splitter

CACHE = 300_000  # pieces of text remembered by a task before it starts anew
STEM, SHORT = 4, (3, 2, 1)  # characters that look up the lengths of longer tokens; the lengths below
NEVER = np.iinfo(np.int64).max
LONG = 48  # symbols from which a word is merged by itself


class SpeculativeBpe:
    """Merges of a vocabulary file whose words end with a suffix (possibly empty)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.tokens = [""] * (max(self.ids.values()) + 1)
        for token, number in self.ids.items():
            self.tokens[number] = token
        n = len(self.tokens)
        left, right, made = [np.zeros(len(model["merges"]), np.int64) for _ in range(3)]
        for i, (a, b) in enumerate(model["merges"]):
            left[i], right[i] = self.ids[a], self.ids[b]
            made[i] = self.ids[a + b]
        if len(np.unique(made)) < len(made):
            raise ValueError("two merges build the same token")
        self.rank = np.full(n, -1, np.int64)  # when a token is built; -1: it is there from the start
        self.left, self.right = np.arange(n), np.arange(n)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        keys = (left << 20) | right
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks, self.made = keys[order], order, made
        self.merges = {(a, b): (r, t) for r, (a, b, t) in enumerate(zip(left.tolist(), right.tolist(), made.tolist()))}
        # a token that another order of merges preempts can never come out, so it is no candidate
        sound = np.ones(n, bool)
        sound[made] = self.undisturbed(left, right, np.arange(len(made)), np.arange(len(made)))
        self.candidates = {t: i for t, i in self.ids.items() if sound[i]}
        self.longest = max(map(len, self.candidates))
        # lengths of the candidates that begin with each three characters, the longest first
        lengths: dict[str, set[int]] = {}
        for token in self.candidates:
            if len(token) >= STEM:
                lengths.setdefault(token[:STEM], set()).add(len(token))
        self.lengths = {stem: (*sorted(found, reverse=True), *SHORT) for stem, found in lengths.items()}

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == key, self.merge_ranks[at], NEVER)

    def undisturbed(self, a: np.ndarray, b: np.ndarray, until_a: np.ndarray, until_b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the boundary of a[i] and b[i]. until_*: the rank at which each becomes part of more.

        Of two merges of equal rank the left one goes first: a crossing one must come before a's, but may tie with b's.
        """
        good = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        a, b, until_a, until_b = (np.array(x, np.int64) for x in (a, b, until_a, until_b))
        while len(open_):
            crossing = self.merge_rank(a, b)
            bad = (crossing < until_a) & ((crossing < until_b) | (crossing == until_b) & (crossing != NEVER))
            good[open_[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~bad & (np.maximum(ra, rb) >= 0)
            open_, a, b, until_a, until_b, ra, rb = (x[on] for x in (open_, a, b, until_a, until_b, ra, rb))
            first = ra > rb  # the later built one is undone; of equals the right one
            until_a, until_b = np.where(first, ra, until_a), np.where(first, until_b, rb)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return good

    def greedy(self, word: str) -> list[int] | None:
        """Longest tokens from the left; None where none fits."""
        find, lengths, longest, out, at, word = self.candidates.get, self.lengths.get, self.longest, [], 0, word + self.suffix
        end, whole = len(word) - len(self.suffix), len(word)
        last = end - bool(self.suffix)
        while at < whole:
            # a token either ends within the word or takes in its whole suffix
            token = find(word[at:]) if whole - at <= longest else None
            if token is not None:
                out.append(token)
                return out
            for size in lengths(word[at:at + STEM], SHORT):
                stop = at + size
                if stop <= last:
                    token = find(word[at:stop])
                    if token is not None:
                        break
            else:
                return None
            out.append(token)
            at = stop
        return out

    def merged(self, word: str) -> list[int]:
        """Exact merging, rule by rule."""
        parts = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.suffix]]
        while len(parts) > 1:
            best = min((self.merges.get(pair, (NEVER, 0))[0] for pair in zip(parts, parts[1:])))
            if best == NEVER:
                break
            out, i = [], 0
            while i < len(parts):
                rule = self.merges.get((parts[i], parts[i + 1])) if i + 1 < len(parts) else None
                if rule and rule[0] == best:
                    out.append(rule[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def merged_together(self, words: list[str]) -> list[list[int]]:
        """Exact merging of many short words: each step applies every word's best rule at its leftmost place."""
        n, width = len(words), max(map(len, words))
        token = np.zeros((n, width), np.int64)
        rows = np.arange(n)
        for i, word in enumerate(words):
            token[i, :len(word)] = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.suffix]]
        size = np.array([len(w) for w in words])
        after = np.minimum(np.arange(1, width + 1) + 0 * size[:, None], size[:, None])  # next symbol; the size: none
        before = np.arange(-1, width - 1) + 0 * size[:, None]
        rank = np.full((n, width + 1), NEVER)
        if width > 1:
            real = np.arange(width - 1) < size[:, None] - 1
            rank[:, :width - 1][real] = self.merge_rank(token[:, :-1][real], token[:, 1:][real])
        made = self.made
        alive = np.arange(width) < size[:, None]
        live = rows
        while len(live):
            at = rank[live].argmin(axis=1)
            best = rank[live, at]
            live, at, best = live[best != NEVER], at[best != NEVER], best[best != NEVER]
            gone = after[live, at]
            token[live, at] = made[best]
            alive[live, gone] = False
            rank[live, gone] = NEVER
            then = after[live, gone]
            after[live, at] = then
            inside = then < size[live]
            before[live[inside], then[inside]] = at[inside]
            rank[live, at] = NEVER
            rank[live[inside], at[inside]] = self.merge_rank(token[live[inside], at[inside]], token[live[inside], then[inside]])
            ahead = before[live, at]
            inside = ahead >= 0
            rank[live[inside], ahead[inside]] = self.merge_rank(token[live[inside], ahead[inside]], token[live[inside], at[inside]])
        return [row[:k][keep[:k]].tolist() for row, keep, k in zip(token, alive, size)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each non-empty word (in the vocabulary's alphabet)."""
        proposed = [self.greedy(w) or [] for w in words]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = owner[1:] == owner[:-1]
        pair, where = np.unique(((flat[:-1] << 20) | flat[1:])[inside], return_inverse=True)
        never = np.full(len(pair), NEVER)
        sound = self.undisturbed(pair >> 20, pair & 0xFFFFF, never, never)[where]
        failed = np.union1d(owner[1:][inside][~sound], np.flatnonzero(sizes == 0)).tolist()
        short = sorted((i for i in failed if len(words[i]) <= LONG), key=lambda i: len(words[i]))
        for start in range(0, len(short), 2048):
            part = short[start:start + 2048]
            for i, ids in zip(part, self.merged_together([words[i] for i in part])):
                proposed[i] = ids
        for i in failed:
            if len(words[i]) > LONG:
                proposed[i] = self.merged(words[i])
        return proposed


class TextCoder:
    """Encodes and decodes whole texts; the library only normalises and cuts them into words."""

    def __init__(self, path: str):
        self.bpe, self.library = SpeculativeBpe(path), load(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        if content["decoder"] is not None or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in content["added_tokens"]):
            raise ValueError("only vocabularies without decoder, with added tokens that match as written")
        self.added = {x["content"]: x["id"] for x in content["added_tokens"]}
        self.names = {i: t for i, t in enumerate(self.bpe.tokens)} | {i: t for t, i in self.added.items()}
        self.numbers = list(map(str, range(max(self.names) + 1)))
        self.cut = splitter(self.added)
        self.known: dict[str, tuple[int, str, str]] = {}

    def words(self, piece: str) -> list[str | int]:
        """Words of a piece of text in the vocabulary's alphabet, and ids of added tokens in it."""
        core = piece.rstrip(SIGNS)
        if core.isascii() or core.isalpha() and max(core) < "\u0250":
            word = latin_word(core.lower())  # lower case as the library's for these letters
            if word is not None:
                return [word, piece[len(core):]] if len(piece) > len(core) else [word]
        if any(mark in piece for mark in self.added):
            parts = self.cut.split(piece)
            return [w for i, part in enumerate(parts) for w in ([self.added[part]] if i % 2 else self.words(part))]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))] if piece else []

    @without_collection
    def learn(self, wanted: set[str]) -> None:
        if len(self.known) + len(wanted) > CACHE:
            self.known = {x: self.known[x] for x in wanted if x in self.known}
        new = [x for x in wanted if x not in self.known]
        cut = [self.words(x) for x in new]
        distinct = list(dict.fromkeys(w for x in cut for w in x if type(w) is str))
        ids_of = dict(zip(distinct, self.bpe.encode_words(distinct)))
        known, numbers, names = self.known, self.numbers, self.names
        for piece, words in zip(new, cut):
            if len(words) == 1 and type(words[0]) is str:
                ids = ids_of[words[0]]
            else:
                ids = [i for w in words for i in (ids_of[w] if type(w) is str else (w,))]
            known[piece] = (len(ids), " ".join([numbers[i] for i in ids]), " ".join([names[i] for i in ids]))

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text its number of ids, the ids in decimal with spaces between, and the decoded text: as the library
        without a decoder, the tokens with spaces between them."""
        cut = [pieces_between_spaces(x) for x in texts]
        self.learn(set().union(*cut))
        out = []
        for pieces in cut:
            found = [x for x in map(self.known.__getitem__, pieces) if x[0]]
            numbers, ids, decoded = zip(*found) if found else ((), (), ())
            out.append((sum(numbers), " ".join(ids), " ".join(decoded)))
        return out


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_and_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of `docs` (doc_id, text): the digests of the ids in
    decimal, joined by one space, and of the decoded text. Null texts count as empty: no ids, both digests of the empty
    string. Rows that repeat, and null doc_ids, come back as they are. Other columns are ignored."""

    def run(batches):
        coder = TextCoder(tokenizer)
        for batch in slices(batches):
            found = coder.encode(strings(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([sha256(x[1]) for x in found], pa.string()),
                 pa.array([sha256(x[2]) for x in found], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
