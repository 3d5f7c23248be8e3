"""Language identification: a byte convolutional network in numpy.

Filters of several widths run over the UTF-8 bytes of fixed-length windows; the largest response of each filter goes
through a softmax layer. A filter over raw bytes is a sum of table entries, one table a position, so there is no
multiplication at run time. A document's windows cover all of its text; their log-probabilities are averaged.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import below, share_of


WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
TRAIN_WINDOWS = 6_000  # bound of the labelled sample the network is fitted on, over all languages
UNKNOWN = "und"


@dataclass
class ByteNetwork:
    """labels: the languages learned; tables[w][j]: what byte values at position j add to the filters of width w."""

    labels: list[str]
    tables: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def responses(self, windows: np.ndarray) -> list[np.ndarray]:
        """For each width the filter responses (windows, places, filters)."""
        out = []
        for table in self.tables:
            width = len(table)
            places = windows.shape[1] - width + 1
            total = table[0].take(windows[:, :places], axis=0)
            for j in range(1, width):
                total += table[j].take(windows[:, j:j + places], axis=0)
            out.append(total)
        return out

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([r.max(axis=1) for r in self.responses(windows)], axis=1)
        return log_softmax(np.maximum(pooled, 0) @ self.weights + self.bias)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and probability of each whole text."""
        labels = [UNKNOWN] * len(texts)
        scores = np.zeros(len(texts))
        if not self.labels:
            return labels, scores
        cut = [windows_of(x) for x in texts]
        sizes = np.array([len(x) for x in cut])
        every = np.concatenate(cut) if cut else np.zeros((0, WINDOW), np.uint8)
        found = np.concatenate([self.log_probabilities(every[i:i + 64]) for i in range(0, len(every), 64)] or [np.zeros((0, len(self.labels)))])
        ends = np.cumsum(sizes)
        for i, (a, b) in enumerate(zip(ends - sizes, ends)):
            mean = np.exp(log_softmax(found[a:b].mean(axis=0)))
            best = int(mean.argmax())
            labels[i], scores[i] = self.labels[best], min(1.0, float(mean[best]))
        return labels, scores


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def windows_of(text: str) -> np.ndarray:
    """The bytes of a whole text in rows of WINDOW bytes, zeros behind the last; a short last row starts earlier."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    rows = max(1, -(-len(data) // WINDOW))
    if len(data) >= WINDOW and len(data) % WINDOW:
        body = data[:(rows - 1) * WINDOW].reshape(-1, WINDOW)
        return np.concatenate([body, data[-WINDOW:][None]])
    out = np.zeros(rows * WINDOW, np.uint8)
    out[:len(data)] = data
    return out.reshape(rows, WINDOW)


def train(texts: list[str], labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 1) -> ByteNetwork:
    """Fit by Adam on one window of each text. Only the place of each filter's largest response gets a gradient."""
    net = ByteNetwork(sorted(set(labels)))
    if not net.labels:
        return net
    rng = np.random.default_rng(seed)
    data = np.stack([windows_of(t)[0] for t in texts])
    target = np.array([net.labels.index(x) for x in labels])
    net.tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    net.weights = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(net.labels))).astype(np.float32)
    net.bias = np.zeros(len(net.labels), np.float32)
    values = [*net.tables, net.weights, net.bias]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    steps = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for start in range(0, len(data), batch):
            rows = order[start:start + batch]
            windows = data[rows]
            responses = net.responses(windows)
            places = [r.argmax(axis=1) for r in responses]
            pooled = np.concatenate([np.take_along_axis(r, p[:, None], 1)[:, 0] for r, p in zip(responses, places)], axis=1)
            hidden = np.maximum(pooled, 0)
            error = np.exp(log_softmax(hidden @ net.weights + net.bias))
            error[np.arange(len(rows)), target[rows]] -= 1
            error /= len(rows)
            back = (error @ net.weights.T) * (pooled > 0)
            grads = []
            for k, (table, place) in enumerate(zip(net.tables, places)):
                grad, mine = np.zeros_like(table), back[:, k * FILTERS:(k + 1) * FILTERS]
                for j in range(len(table)):
                    byte = np.take_along_axis(windows, place + j, axis=1)
                    np.add.at(grad[j], (byte, np.arange(FILTERS)), mine)
                grads.append(grad)
            grads += [hidden.T @ error, error.sum(axis=0)]
            steps += 1
            for value, grad, (first, second) in zip(values, grads, moments):
                first += 0.1 * (grad - first)
                second += 0.001 * (grad * grad - second)
                value -= rate * (first / (1 - 0.9 ** steps)) / (np.sqrt(second / (1 - 0.999 ** steps)) + 1e-8)
    return net


def fold(modulus: int) -> Column:
    """crc32(doc_id as text) mod `modulus`; null where doc_id is null."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def fit(docs: DataFrame, held_out: int = 2, folds: int = 4, bound: int = TRAIN_WINDOWS) -> ByteNetwork:
    """Learn from text and lang of at most `bound` windows of documents outside the held-out fold.

    The sample is spread evenly over the languages, of which the `bound` // 20 most frequent ones are learned, and picked
    by a hash of doc_id; each document lends one window of its text, at a place picked by the same hash. Documents with
    null lang, doc_id or text, or without a letter, teach nothing. All languages are drawn in one scan: a threshold on the
    hash for each, from its number of documents, leaves about twice the sample before it is ranked.
    """
    labelled = docs.where(F.col("lang").isNotNull() & (fold(folds) != held_out)).select(
        F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.col("doc_id").cast("long")).alias("draw"))
    lettered = labelled.where(F.col("text").rlike("\\p{L}"))
    sizes = {r["lang"]: r["count"] for r in lettered.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(bound // 20).collect()}
    if not sizes:
        return train([], [])
    each = bound // len(sizes)
    place = F.pmod(F.shiftright("draw", 8), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1
    ranked = Window.partitionBy("lang").orderBy("draw", "window")
    shares, windows = {name: share_of(each, size) for name, size in sizes.items()}, {}
    while shares:
        drawn = reduce(lambda a, b: a | b, [(F.col("lang") == name) & below(F.col("draw"), share) for name, share in shares.items()])
        rows = lettered.where(drawn).select("lang", "draw", F.substring("text", place, F.lit(WINDOW)).alias("window")).withColumn(
            "rank", F.row_number().over(ranked)).where(F.col("rank") <= each).collect()
        for name in shares:
            windows[name] = [r["window"] for r in sorted((r for r in rows if r["lang"] == name), key=lambda r: r["rank"])]
        shares = {name: share * 4 for name, share in shares.items() if share < 1 and len(windows[name]) < each}
    texts = [w for name in sizes for w in windows[name]]
    labels = [name for name in sizes for _ in windows[name]]
    return train(texts, labels)


def language_of(net: ByteNetwork, text: Column) -> Column:
    """struct(lang_pred, score) of a text column; `und` and 0 where the text is null or has no letter."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(column: pd.Series) -> pd.DataFrame:
        labels, scores = [], []
        for start in range(0, len(column), 128):
            found = net.predict(column.iloc[start:start + 128].tolist())
            labels += found[0]
            scores += found[1].tolist()
        return pd.DataFrame({"lang_pred": labels, "score": scores})

    found = predicted(F.coalesce(text, F.lit("")))
    lettered = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    return F.struct(
        F.when(lettered, found["lang_pred"]).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(lettered, found["score"]).otherwise(0.0).alias("score"))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of `docs` (doc_id, text, lang).

    A null doc_id is in no fold: held_out is false, and it teaches nothing. Without any labelled text everything is
    `und`. Rows that repeat come back as often as they occur; other columns are ignored.
    """
    net = fit(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"),
                       language_of(net, F.col("text")).alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The documents whose language is known with at least `min_score`, with all their columns."""
    net = fit(docs)
    found = language_of(net, F.col("text"))
    return docs.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= min_score))
