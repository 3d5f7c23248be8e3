"""Toxicity: a noisy-channel decoder restores disguised words, a linear model scores the restored text.

A disguised word is a lattice: a digit or sign may stand for a letter or for nothing, a sign also for the end of a word, a long run of one letter for one
or two of it, single letters with spaces between them for a word or several. Viterbi search takes the reading that a
character trigram model and the costs of the channel like best. A word without any of this has one reading, itself.

Every distinct restored word has a toxicity: the largest log-ratio of its features (the word and its beginnings)
between toxic and clean labelled documents. A logistic model turns the strongest words of a document into its score.

All labelled documents outside the held-out fold teach, with their whole texts: tasks count and Spark adds up. The driver
holds the model only: character trigrams, the features that speak for toxic, and seven weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, strings
from .language import fold

CACHE = 300_000  # words whose toxicity a task remembers before it starts anew
COUNTED = 300_000  # counts that a task holds before it hands them on
WORDS = 100_000  # words whose features are counted at a time, and the rest of a text
PARTS = [f"n{p}" for p in range(4)]  # columns of the counts of each part of the labelled documents
BEGINNINGS = (4, 5, 6)
STRONGEST = 5
TELLING = 0.5  # log-ratio above which a word counts

# fixed values: letters that a digit or sign may stand for
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
# signs that stand for no letter; at either end of a token the search would always drop them
EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in STANDS_FOR) + "«»“”„’‘…–—"
READ_COST, DROP_COST, BREAK_COST, DIGIT_DROP_COST, KEEP_COST, SHORTEN_COST, SPACE_COST = 1.0, 2.0, 2.0, 6.0, 4.0, 0.5, 2.5
REPEATED = re.compile(r"([^\W\d_])\1\1")
LETTERS = re.compile(r"[^\W\d_]+")
SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def trigrams_of(words: Counter) -> Counter:
    """Every character of the words and the end of each, after the two before it."""
    found: Counter = Counter()
    for word, n in words.items():
        line = "  " + word + " "
        for i in range(2, len(line)):
            found[line[i - 2:i + 1]] += n
    return found


def plain_words(tokens: Counter) -> Counter:
    """Counts of the words in counts of lower-case tokens, without what may be a disguise."""
    found: Counter = Counter()
    for token, n in tokens.items():
        word = token.strip(EDGE)
        if word.isalpha() and not REPEATED.search(word):
            found[word] += n
    return found


class CharacterModel:
    """Trigram probabilities of characters in words, mixed with those of shorter contexts."""

    def __init__(self, words: Counter, trigrams: Counter | None = None):
        """From counts of words, or of their trigrams."""
        self.grams: tuple[Counter, ...] = (Counter(), Counter(), Counter())
        self.contexts: tuple[Counter, ...] = (Counter(), Counter(), Counter())
        for gram, n in (trigrams_of(words) if trigrams is None else trigrams).items():
            for k in range(3):
                self.grams[k][gram[2 - k:]] += n
                self.contexts[k][gram[2 - k:2]] += n
        self.known: dict[str, float] = {}
        self.moves: dict[str, tuple[float, str]] = {}  # by context and a reading of one character or none
        self.meant: dict[str, set[str]] = {}  # words of the disguised tokens met

    def log(self, context: str, char: str) -> float:
        """log P(char | last two characters)."""
        key = context + char
        if key not in self.known:
            p = 1e-6
            for k, share in ((0, 0.05), (1, 0.25), (2, 0.7)):
                n = self.contexts[k][context[2 - k:]]
                p += share * self.grams[k][key[2 - k:]] / n if n else 0.0
            self.known[key] = math.log(p)
        return self.known[key]

    def move(self, context: str, reading: str) -> tuple[float, str]:
        """log P(reading | context) of one character or none, and the context after it."""
        found = (self.log(context, reading), "  " if reading == " " else context[1] + reading) if reading else (0.0, context)
        self.moves[context + reading] = found
        return found


def lattice(token: str, signs_are_letters: bool = False) -> list[list[tuple[str, float]]]:
    """For each place the possible readings (text, cost). White space marks places where a new word may begin.
    `signs_are_letters` leaves signs that can stand for letters no other reading."""
    steps: list[list[tuple[str, float]]] = []
    for run in re.finditer(r"(\S)\1*|\s+", token):
        char, n = run[0][0], len(run[0])
        if char.isspace():
            steps.append([("", 0.0), (" ", SPACE_COST)])
        elif char.isalpha():
            if n < 3:
                steps.append([(run[0], 0.0)])
            else:
                steps.append([(char, SHORTEN_COST), (char * 2, SHORTEN_COST), (run[0], KEEP_COST)])
        else:
            read = [(x, READ_COST) for x in STANDS_FOR.get(char, "")]
            gone = [("", DIGIT_DROP_COST)] if char.isalnum() else [("", DROP_COST), (" ", BREAK_COST)]
            steps.append(read if signs_are_letters and read and not char.isalnum() else gone + [(char, KEEP_COST)] + read)
            if n > 2 and char in STANDS_FOR:  # a run that may stand for a double letter
                steps[-1] += [(x * 2, READ_COST + SHORTEN_COST) for x in STANDS_FOR[char]]
            elif n == 2:
                steps.append(list(steps[-1]))
    return steps


def decode(token: str, model: CharacterModel, signs_are_letters: bool = False) -> str:
    """The likeliest reading of a lattice, in time linear in its length: readings are kept as chains back to the start."""
    moves = model.moves.get
    head = LETTERS.match(token)
    plain = head[0] if head and head[0].isalpha() and not REPEATED.search(head[0]) else ""
    total, last = 0.0, "  "
    for char in plain:  # one reading
        log, last = moves(last + char) or model.move(last, char)
        total += log
    beams: dict[str, tuple[float, tuple]] = {last: (total, ((), plain) if plain else ())}
    for options in [*lattice(token[len(plain):], signs_are_letters), [(" ", 0.0)]]:
        after: dict[str, tuple[float, tuple]] = {}
        for context, (score, chain) in beams.items():
            for reading, cost in options:
                if len(reading) < 2:
                    log, last = moves(context + reading) or model.move(context, reading)
                    now = score - cost + log
                else:
                    now, last = score - cost, context
                    for char in reading:
                        log, last = moves(last + char) or model.move(last, char)
                        now += log
                best = after.get(last)
                if best is None or now > best[0]:
                    after[last] = (now, (chain, reading))
        beams = after
    chain, parts = max(beams.items(), key=lambda x: (x[1][0], x[0]))[1][1], []
    while chain:
        chain, reading = chain
        parts.append(reading)
    return "".join(reversed(parts)).strip(" ")


def restore(token: str, model: CharacterModel) -> str:
    """A lower-case token without white space, as it was meant: a word, or several with spaces between them."""
    core = token.strip(EDGE)
    if core.isalpha() and not REPEATED.search(core):
        return core
    return decode(core, model)


def meanings(token: str, model: CharacterModel) -> set[str]:
    """The words of a token as it was meant, and of its reading with letters for all signs at its ends: whether these belong
    to the word can't be told from three characters."""
    if token in model.meant:
        return model.meant[token]
    core = token.strip(EDGE)
    found = set(restore(token, model).split())
    if core and any(c in STANDS_FOR and not c.isalnum() for c in (core[0], core[-1])):
        found |= set(decode(core, model, True).split())
    if len(model.meant) >= CACHE:
        model.meant.clear()
    model.meant[token] = found
    return found


def may_spell(tokens: list[str]) -> bool:
    """Whether three tokens in a row have one character; without that nothing is spelled."""
    return b"\1\1\1" in bytes(map((1).__eq__, map(len, tokens)))


def spelled_words(text: str, model: CharacterModel) -> list[str]:
    """Words that stand in a lower-case text letter by letter."""
    found: list[str] = []
    for run in SPELLED.finditer(text):
        found += decode(run[0], model).split()
    return found


def features(word: str) -> list[str]:
    """The word and its beginnings; a beginning ends with a star."""
    return [word] + [word[:n] + "*" for n in BEGINNINGS if len(word) > n]


def strongest(values: list[float]) -> list[float]:
    found = sorted(values, reverse=True)[:STRONGEST]
    return found + [0.0] * (STRONGEST - len(found))


def described(values: list[float], words: int) -> np.ndarray:
    return np.array([*strongest(values), math.log1p(words), 1.0])


@dataclass
class ToxicityModel:
    characters: CharacterModel | None = None
    evidence: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)  # the evidence of beginnings, without their stars
    weights: np.ndarray | None = None  # of strongest words and log length, last the constant
    cache: dict[str, float] = field(default_factory=dict)  # tokens of over TELLING
    harmless: set[str] = field(default_factory=set)  # all others met

    def learn(self, evidence: dict[str, float]) -> None:
        self.evidence, self.cache, self.harmless = evidence, {}, set()
        self.beginnings = {f[:-1]: x for f, x in evidence.items() if f[-1] == "*" and len(f) - 1 in BEGINNINGS}

    def plain_score(self, word: str) -> float:
        """The largest evidence of the word's `features`."""
        best, size = self.evidence.get(word, 0.0), len(word)
        for n in BEGINNINGS:
            if size <= n:
                break
            x = self.beginnings.get(word[:n], 0.0)
            if x > best:
                best = x
        return best

    def word_score(self, token: str) -> float:
        core = token.strip(EDGE)
        if core.isalpha() and not REPEATED.search(core):
            return self.plain_score(core)
        return max([self.plain_score(w) for w in meanings(token, self.characters)], default=0.0)

    def telling(self, tokens: set[str], score: Callable[[str], float]) -> list[float]:
        """The scores of the tokens that tell."""
        if len(self.cache) + len(self.harmless) > CACHE:
            self.cache, self.harmless = {}, set()
        found = []
        for token in tokens - self.harmless:
            x = self.cache.get(token)
            if x is None:
                x = score(token)
                if x <= TELLING:
                    self.harmless.add(token)
                    continue
                self.cache[token] = x
            found.append(x)
        return found

    def describe(self, text: str) -> np.ndarray:
        """Strongest words' toxicity, falling, then log of the number of distinct words, then 1."""
        text = text.lower()
        tokens = text.split()
        words = set(tokens)
        values = self.telling(words, self.word_score)
        if may_spell(tokens):
            values += [x for w in set(spelled_words(text, self.characters)) if (x := self.plain_score(w)) > TELLING]
        return described(values, len(words))

    def score(self, text: str) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.describe(text) @ self.weights, -30, 30))))


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method with a ridge on all but the constant. `sums` gives slope and curvature of the log-likelihood at a point."""
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(size)
    for _ in range(rounds):
        slope, curvature = sums(beta)
        step = np.linalg.solve(curvature + np.diag(penalty), slope - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def derivatives(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return x.T @ (weight * (y - p)), (x * (weight * p * (1 - p))[:, None]).T @ x


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return newton(lambda beta: derivatives(x, y, weight, beta), x.shape[1])


def evidence_of(names: list[str], count: np.ndarray, size: np.ndarray) -> dict[str, float]:
    """Log-ratio of each feature's share among toxic and among clean documents, where it speaks for toxic.
    `count` has a row for clean and one for toxic documents, `size` the numbers of these."""
    size = np.maximum(size, 1)
    ratio = np.log((count[1] + 1) / (size[1] + 2)) - np.log((count[0] + 1) / (size[0] + 2))
    return {names[i]: float(ratio[i]) for i in np.flatnonzero((ratio > TELLING) & (count[1] > 1))}


def gather_evidence(seen: list[np.ndarray], labels: np.ndarray, names: list[str]) -> dict[str, float]:
    """`seen` has the numbers of each document's features."""
    count = np.array([np.bincount(np.concatenate([np.zeros(0, np.int64), *[x for x, y in zip(seen, labels) if y == v]]), minlength=len(names))
                      for v in (0, 1)])
    return evidence_of(names, count, np.array([(labels == v).sum() for v in (0, 1)]))


def train(texts: list[str], labels: list[int], weights: list[float]) -> ToxicityModel:
    """`fit` for a list of texts, with weights. The logistic model sees each half of the documents with the evidence of the
    other half, so that it learns what evidence is worth on new documents; the words' final evidence is that of all documents."""
    if len(set(labels)) < 2:
        return ToxicityModel()
    y, w = np.array(labels), np.array(weights)
    model = ToxicityModel(CharacterModel(plain_words(Counter(t for text in texts for t in text.lower().split()))))
    seen, numbers = [], {}
    for text in texts:
        found = {f for words in restored(text, model.characters, {})[0] for r in words.split(" ") for f in features(r)}
        seen.append(np.array([numbers.setdefault(f, len(numbers)) for f in found], np.int64))
    names = list(numbers)
    half, rows = np.arange(len(texts)) % 2 == 0, np.zeros((len(texts), STRONGEST + 2))
    for mine in (half, ~half):
        model.learn(gather_evidence([x for x, m in zip(seen, mine) if not m], y[~mine], names))
        for i in np.flatnonzero(mine):
            rows[i] = model.describe(texts[i])
    model.weights = logistic(rows, y, w)
    model.learn(gather_evidence(seen, y, names))
    return model


# ---- learning from all labelled documents ----------------------------------------------------------


def restored(text: str, characters: CharacterModel, cache: dict[str, str]) -> tuple[list[str], int]:
    """What each distinct token of a text means, its words with spaces between them, then the words that are spelled; and
    the number of distinct tokens."""
    text = text.lower()
    tokens = text.split()
    distinct = set(tokens)
    if len(cache) > CACHE:
        cache.clear()
    for token in [x for x in distinct if x not in cache]:
        core = token.strip(EDGE)
        plain = core.isalpha() and not REPEATED.search(core)
        cache[token] = core if plain else " ".join(sorted(meanings(token, characters)))
    found = [x for x in map(cache.__getitem__, distinct) if x]
    if may_spell(tokens):
        found += set(spelled_words(text, characters))
    return found, len(distinct)


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, grams = Counter(), Counter()
    for batch in slices(batches):
        for text in strings(batch, "text"):
            tokens.update(text.lower().split())
            if len(tokens) > COUNTED:
                grams.update(trigrams_of(plain_words(tokens)))
                tokens.clear()
            if len(grams) > COUNTED:
                yield pa.RecordBatch.from_pydict({"gram": list(grams), "n": list(grams.values())})
                grams.clear()
    grams.update(trigrams_of(plain_words(tokens)))
    yield pa.RecordBatch.from_pydict({"gram": list(grams), "n": list(grams.values())})


def learn_characters(taught: DataFrame) -> CharacterModel:
    counted = taught.select("text").mapInArrow(count_trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return CharacterModel(Counter(), Counter({r["gram"]: r["n"] for r in counted.collect()}))


def restore_texts(taught: DataFrame, characters: CharacterModel) -> DataFrame:
    """(part, words, tokens): what the texts mean, restored once. A part is twice the half plus the label."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        for batch in slices(batches):
            rows = [restored(x, characters, cache) for x in strings(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in rows], pa.list_(pa.string())),
                                              pa.array([n for _, n in rows], pa.int32())], ["part", "words", "tokens"])

    return taught.select("part", "text").mapInArrow(made, "part int, words array<string>, tokens int")


def distinct_words(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of a batch's lists; for each word of the lists in turn its place among these, and its row."""
    lists = batch.column(batch.schema.get_field_index("words"))
    coded = lists.flatten().dictionary_encode()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.repeat(np.arange(batch.num_rows), lengths)


def few_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where their lists pass multiples of WORDS words."""
    for batch in batches:
        ends = np.cumsum(batch.column(batch.schema.get_field_index("words")).value_lengths().to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(ends // WORDS)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n0 to n3): documents of each part that have a feature."""
    numbers: dict[str, int] = {}
    known: dict[str, int] = {}  # places of words in `sizes`, the numbers of their features, which `listed` has in turn
    sizes, listed, counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.string()), *[pa.array(counts[p:4 * len(numbers):4]) for p in range(4)]],
                                          ["feature", *PARTS])

    for batch in few_words(batches):
        if len(numbers) > COUNTED:
            yield full()
            numbers.clear()
            known.clear()
            sizes, listed, counts = sizes[:0], listed[:0], np.zeros(0, np.int64)
        words, places, rows = distinct_words(batch)
        new_sizes, new = [], []
        for x in words:
            if x not in known:
                known[x] = len(known)
                found = {f for w in x.split(" ") for f in features(w)} if " " in x else set(features(x))
                new_sizes.append(len(found))
                new += [numbers.setdefault(f, len(numbers)) for f in found]
        sizes, listed = np.append(sizes, np.array(new_sizes, np.int64)), np.append(listed, np.array(new, np.int64))
        if 4 * len(numbers) > len(counts):
            counts = np.append(counts, np.zeros(8 * len(numbers) - len(counts), np.int64))
        word = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[places]
        each, starts = sizes[word], (np.cumsum(sizes) - sizes)[word]
        # the features of each word in turn: as many as it has, from its start on
        had = listed[np.repeat(starts - np.cumsum(each) + each, each) + np.arange(each.sum())]
        pairs = np.sort(np.repeat(rows, each) * len(numbers) + had)
        row, feature = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], max(1, len(numbers)))
        np.add.at(counts, 4 * feature + batch.column(0).to_numpy()[row], 1)
    yield full()


def learn_evidence(texts: DataFrame, size: np.ndarray) -> list[dict[str, float]]:
    """The evidence of the first half of the documents, of the second, and of all. Only features that are evidence in
    one of them come to the driver."""
    counted = texts.select("part", "words").mapInArrow(count_features, f"feature string, {', '.join(f'{n} long' for n in PARTS)}").groupBy(
        "feature").agg(*[F.sum(n).alias(n) for n in PARTS])
    views = [([0], [1]), ([2], [3]), ([0, 2], [1, 3])]  # parts of clean and of toxic documents

    def speaks(clean: list[int], toxic: list[int]) -> Column:
        found = [sum(F.col(PARTS[p]) for p in ps) for ps in (clean, toxic)]
        share = [(n + 1) / F.lit(max(1.0, size[ps].sum()) + 2) for n, ps in zip(found, (clean, toxic))]
        # the driver takes the logarithms; a little less is asked here, so that rounding loses nothing
        return (share[1] > share[0] * math.exp(TELLING - 1e-6)) & (found[1] > 1)

    rows = counted.where(speaks(*views[0]) | speaks(*views[1]) | speaks(*views[2])).toArrow()
    names, count = rows.column("feature").to_pylist(), np.array([rows.column(p).to_numpy() for p in PARTS], float)
    return [evidence_of(names, np.array([count[ps].sum(axis=0) for ps in view]), np.array([size[ps].sum() for ps in view]))
            for view in views]


def describe_texts(texts: DataFrame, first: ToxicityModel, second: ToxicityModel) -> DataFrame:
    """(toxic, tokens, s0 to s4, n): the rows of the logistic model, equal ones counted. `first` scores the first half."""
    names = [f"s{i}" for i in range(STRONGEST)]

    def counted(found: Counter) -> pa.RecordBatch:
        columns = list(zip(*[(*row, n) for row, n in found.items()])) or [()] * (STRONGEST + 3)
        types = [pa.int32(), pa.int32(), *[pa.float64()] * STRONGEST, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["toxic", "tokens", *names, "n"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in slices(batches):
            words, places, rows = distinct_words(batch)
            parts = batch.column(0).to_numpy()
            value = np.array([[best(model, w) for w in words] for model in (first, second)]).reshape(2, len(words))
            worth = value[parts[rows] // 2, places]  # tokens of one meaning count one by one
            telling = worth > TELLING
            worths = np.split(worth[telling], np.searchsorted(rows[telling], np.arange(1, batch.num_rows)))
            for part, tokens, values in zip(parts.tolist(), batch.column(2).to_pylist(), worths):
                found[(part % 2, tokens, *strongest(values.tolist()))] += 1
            if len(found) > COUNTED:
                yield counted(found)
                found.clear()
        yield counted(found)

    def best(model: ToxicityModel, words: str) -> float:
        if words in model.harmless:
            return 0.0
        if words not in model.cache:
            if len(model.cache) + len(model.harmless) > CACHE:
                model.cache, model.harmless = {}, set()
            model.cache[words] = max([model.plain_score(w) for w in words.split(" ")])
            if model.cache[words] <= TELLING:
                del model.cache[words]
                model.harmless.add(words)
                return 0.0
        return model.cache[words]

    schema = f"toxic int, tokens int, {', '.join(f'{n} double' for n in names)}, n long"
    return texts.select("part", "words", "tokens").mapInArrow(made, schema).groupBy("toxic", "tokens", *names).agg(F.sum("n").alias("n"))


def learn_weights(rows: DataFrame) -> np.ndarray:
    """One job for each step of Newton's method; the driver gets sums."""
    size = STRONGEST + 2

    def sums(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = np.zeros(size + size * size)
            for pdf in frames:
                x = np.column_stack([pdf[f"s{i}"] for i in range(STRONGEST)] + [np.log1p(pdf["tokens"]), np.ones(len(pdf))])
                slope, curvature = derivatives(x, pdf["toxic"].to_numpy(float), pdf["n"].to_numpy(float), beta)
                found += np.concatenate([slope, curvature.ravel()])
            yield pd.DataFrame({"k": np.arange(len(found)), "s": found})

        added = np.zeros(size + size * size)
        for r in rows.mapInPandas(partial, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
            added[r["k"]] = r["s"]
        return added[:size], added[size:].reshape(size, size)

    return newton(sums, size)


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5) -> ToxicityModel:
    """Learn from the whole texts of all labelled documents outside the held-out fold, as `train` does; a hash deals the halves.

    A document with several labels counts as toxic if one says so. Null labels, doc_ids and texts teach nothing; a doc_id
    that repeats teaches with each of its texts.
    """
    # written first, so that Spark knows how few they are and need not shuffle the texts of all documents
    known = stored(labels.where(F.col("toxic").isNotNull() & (fold(folds) != held_out)).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)"), "labelled")
    half = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).cast("int")
    taught = stored(docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(known, "doc_id").select(
        (2 * half + F.col("toxic")).alias("part"), "text"), "taught")
    size = np.zeros(4)
    for r in taught.groupBy("part").count().collect():
        size[r["part"]] = r["count"]
    if not size[[0, 2]].sum() or not size[[1, 3]].sum():
        return ToxicityModel()
    model = ToxicityModel(learn_characters(taught))
    texts = stored(restore_texts(taught, model.characters), "restored")
    of_first, of_second, of_all = learn_evidence(texts, size)
    halves = [ToxicityModel(), ToxicityModel()]
    halves[0].learn(of_second)
    halves[1].learn(of_first)
    model.weights = learn_weights(stored(describe_texts(texts, *halves), "described"))
    model.learn(of_all)
    return model


def toxicity_of(model: ToxicityModel, text: Column) -> Column:
    """Score (0 to 1) of a text column; null counts as empty."""

    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        return pd.Series([model.score(x) for x in column], dtype="float64")

    return scored(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs` (doc_id, text).

    A null doc_id is in no fold: held_out is false, and it teaches nothing. Without labels of both classes every score
    is 0. Rows that repeat come back as often as they occur; other columns are ignored.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"),
                         toxicity_of(fit(docs, labels), F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The documents that score below `most`, with all their columns."""
    return docs.where(toxicity_of(fit(docs, labels), F.col("text")) < most)
