"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates and
scored as sparse dot products."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import free_name, small_batches

#: Width of the hashed feature space: it bounds the model (two arrays of doubles), whatever the vocabulary.
BITS = 18
DIM = 1 << BITS
#: At most this many labelled rows are trained on: those with the smallest md5 of their doc_id, and of these, in that
#: order, as many as hold this many features together (8 bytes each in the task that learns).
TRAIN_ROWS, TRAIN_FEATURES = 8_000, 20_000_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 1.0, 1.0, 0.02, 0.1
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Tokens remembered by one Python worker with their hash and shape.
CACHE = 200_000


def _shape(token: str) -> str:
    """Word shape: digits, marks (as they are, doubled at most), or case and length class."""
    if token[0].isdigit():
        return "0"
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:2]
    case = "A" if token.isupper() and len(token) > 1 else "T" if token[0].isupper() else "a"
    return case + str(min(len(token) // 4, 3))


class _Tokens(dict):
    """token -> (hash of the lower-cased token, hash of its shape) in one 64-bit number, computed once."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[token] = found = xxh32_intdigest(token.lower()) << 32 | xxh32_intdigest(_shape(token), 7)
        return found


def features(text: str | None, known: _Tokens, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a whole text: positions (distinct, sorted) and values.

    Hashed unigrams and bigrams of lower-cased words, and unigrams to trigrams of word shapes in which a word equal to
    the one before it has a shape of its own. Values are square roots of relative frequencies, so length alone moves
    nothing. A text without tokens (null, empty) has the bias only.
    """
    found = TOKEN.findall(text) if text else []
    if not found:
        return np.zeros(1, np.int64), np.ones(1)
    both = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    shape[1:][word[1:] == word[:-1]] = 1
    grams = [word * np.uint64(0x9E3779B97F4A7C15), shape * np.uint64(0xC2B2AE3D27D4EB4F)]
    grams.append(grams[0][:-1] * np.uint64(31) + grams[0][1:])
    grams.append(grams[1][:-1] * np.uint64(37) + grams[1][1:])
    grams.append(grams[3][:-1] * np.uint64(41) + grams[1][2:])
    hashed = np.concatenate(grams)
    hashed ^= hashed >> np.uint64(29)
    at = (hashed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64) % dim
    at, counts = np.unique(at, return_counts=True)
    return np.append(at, 0), np.append(np.sqrt(counts / len(found)), 1.0)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows: Iterable[tuple[tuple[np.ndarray, np.ndarray], float]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of follow-the-regularised-leader updates over (features, label), in place."""
    for (at, value), label in rows:
        zi, ni = z[at], n[at]
        w = _weights(zi, ni)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        after = ni + g * g
        z[at] = zi + g - (np.sqrt(after) - np.sqrt(ni)) / ALPHA * w
        n[at] = after


def learn(rows: Iterable[tuple[str | None, float]], epochs: int = EPOCHS, most: int = TRAIN_FEATURES) -> np.ndarray:
    """Weights after some passes of updates over (text, label) in the order given."""
    known, ends, labels = _Tokens(), [0], []
    # two long arrays, which go back to the system as a whole
    places, values = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.float32)
    for text, label in rows:
        at, value = features(text, known)
        end = ends[-1] + len(at)
        if end > most:
            break
        while end > len(places):
            places, values = np.append(places, np.empty_like(places)), np.append(values, np.empty_like(values))
        places[ends[-1] : end], values[ends[-1] : end] = at, value
        ends.append(end)
        labels.append(float(label))
    z, n = np.zeros(DIM), np.zeros(DIM)
    for _ in range(epochs):
        ftrl((((places[a:b], values[a:b]), y) for a, b, y in zip(ends, ends[1:], labels, strict=False)), z, n)
    return _weights(z, n)


def train(labelled: DataFrame, max_rows: int = TRAIN_ROWS, epochs: int = EPOCHS, most: int = TRAIN_FEATURES) -> np.ndarray:
    """Weights from rows (doc_id, text, label): at most max_rows of them, and most features, taken by md5 of doc_id.

    The updates follow each other in the order of the md5, so one task runs them; its input is bounded, whatever the
    table, and only the weights (DIM doubles) come to the driver. A null or empty text trains the bias alone, repeated
    rows train repeatedly, rows with null labels take no part, and without rows the weights are zero.
    """
    sample = (
        labelled.where("label is not null").select("text", F.col("label").cast("double").alias("label"), F.md5(F.col("doc_id").cast("string")).alias("turn"))
        .orderBy("turn", "label", F.md5("text")).limit(max_rows)
    )

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((t if isinstance(t, str) else None, y) for f in frames for t, y in zip(f["text"], f["label"], strict=True))
        yield pd.DataFrame({"weights": [learn(rows, epochs, most).tobytes()]})

    small_batches(labelled.sparkSession)
    found = sample.select("text", "label").coalesce(1).mapInPandas(batches, "weights binary").collect()
    return np.frombuffer(found[0]["weights"]) if found else np.zeros(DIM)


def _scores(sent) -> Callable[[Column], Column]:
    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, w = _Tokens(), sent.value
        for part in texts:
            dots = np.zeros(len(part))
            for i, text in enumerate(part):
                at, value = features(text if isinstance(text, str) else None, known)
                dots[i] = w[at] @ value
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(dots, -35, 35))))

    # not to be run again for each place that names its result
    return F.pandas_udf(batches, "double").asNondeterministic()


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """docs with a score in [0, 1]: the sparse dot product of each whole text's features with the weights, through the
    logistic function. Rows stay, repeated ones too, with equal scores; null and empty texts score by the bias alone; a
    column that has the name of the result already gives way to it; only the text goes to Python."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    return docs.withColumn(name, _scores(sent)(F.col("text")))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_texts(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most max_rows labelled rows that are not held out, by md5 of doc_id: the bound is
    applied to the labels, so the join sends max_rows of them to the documents and moves no text."""
    once = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    taken = once.where(~held_out(F.col("doc_id"))).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold). Labels repeated for a doc_id count once, as the greatest.

    Every row of docs is scored whole, null and empty texts and repeated rows too; without labels every score is 0.5;
    an empty table gives an empty result. Columns of docs named score or predicted give way to the results.
    """
    weights = train(labelled_texts(docs, labels))
    return score(docs, weights).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that judge() predicts as 1, with exactly the columns of docs, whatever their names."""
    name = free_name(docs, "score")
    return score(docs, train(labelled_texts(docs, labels)), name).where(F.col(name) >= threshold).select(*docs.columns)
