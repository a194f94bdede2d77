"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

A text becomes tokens (runs of letters and digits, runs of other signs). Its features are hashed unigrams and bigrams
of the tokens, a mark for a token that repeats the one before, and uni-, bi- and trigrams of token shapes (kind, case,
length class), so that texts of unseen words still have known features. A feature's value is its share of all n-grams
of the text, and the score is the logistic function of the sparse dot product of values and weights.

Training is FTRL-Proximal, one labelled row after the other in the order of a hash, over a bounded sample of labelled
rows (``sample_rows``, expected number; drawn by hash threshold, so that it doesn't depend on partitioning). The
weights are one vector of ``2 ** bits`` floats (1 MB at 18 bits): a fixed size to broadcast. Scoring reads every whole
text once, without a shuffle.

Nulls and edges: a null or empty text (or white space only) has no features and gets the score of the intercept alone.
Labels that are null or not 0/1 aren't learned from. If no labelled rows are left, or only one class, all weights stay
at what was learned (score 0.5 without any). Repeated rows are scored one by one. Extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm import textvec as tv
from terrane.llm.common import arrow_rows, held_out, hash_sample, map_texts

BITS = 18
SAMPLE_ROWS = 8000
THRESHOLD = 0.7

_KINDS = np.full(256, 2, np.uint8)
_KINDS[tv.SPACE] = 0
_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_SALT = tv.rand64(17, 16)
_SHAPES = tv.rand64(19, 512)


def ngrams(raw: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams of all rows, with the row of each."""
    start, end, first = tv.runs(raw, at, _KINDS)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = tv.hash_runs(raw, start, end)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    last = end - 1
    length = np.minimum(end - start, 15)
    head, second, tail = raw[start], raw[np.minimum(start + 1, last)], raw[last]
    shape = ((((_KINDS[head] - 1) * 2 + _UPPER[head]) * 2 + _UPPER[second]) * 2 + _DIGIT[tail]) * 16 + length
    shape = _SHAPES[shape]
    out, rows = [], []

    def add(values, keep, k):
        out.append(values[keep] >> np.uint64(64 - bits))
        rows.append(row[k:][keep])

    every = slice(None)
    add(tv.mix(h ^ _SALT[0]), every, 0)
    add(tv.mix(shape ^ _SALT[1]), every, 0)
    if len(h) > 1:
        within = row[1:] == row[:-1]
        add(np.where(h[1:] == h[:-1], _SALT[2], tv.mix(h[:-1] * _SALT[3] + h[1:])), within, 1)
        add(tv.mix(shape[:-1] * _SALT[4] + shape[1:]), within, 1)
    if len(h) > 2:
        add(tv.mix((shape[:-2] * _SALT[5] + shape[1:-1]) * _SALT[6] + shape[2:]), row[2:] == row[:-2], 2)
    return np.concatenate(out).astype(np.int64), np.concatenate(rows)


def features(raw: np.ndarray, at: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row: distinct feature numbers and their shares."""
    index, row = ngrams(raw, at, bits)
    order = np.argsort(row, kind="stable")
    index, bounds = index[order], np.searchsorted(row[order], np.arange(len(at)))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        i, c = np.unique(index[a:b], return_counts=True)
        out.append((i.astype(np.int32), (c / max(1, b - a)).astype(np.float32)))
    return out


def ftrl(rows, bits: int = BITS, alpha: float = 3.0, beta: float = 0.1, l1: float = 1e-4, l2: float = 1e-4, epochs: int = 3) -> np.ndarray:
    """FTRL-Proximal over (index, value, label) rows. The last of the weights returned is the intercept."""
    dim = 1 << bits
    z, n, w = np.zeros(dim + 1), np.zeros(dim + 1), np.zeros(dim + 1)
    for _ in range(epochs):
        for i, v, y in rows:
            i, v = np.append(i, dim), np.append(v, 1.0).astype(np.float64)
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(wi @ v, -35, 35))) - y) * v
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[i] = ni + g * g
    keep = np.abs(z) > l1
    w[keep] = -(z[keep] - np.sign(z[keep]) * l1) / ((beta + np.sqrt(n[keep])) / alpha + l2)
    return w.astype(np.float32)


def scores(raw: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    bits = (len(weights) - 1).bit_length() - 1
    index, row = ngrams(raw, at, bits)
    n = len(at) - 1
    total = np.bincount(row, weights[index], minlength=n)
    count = np.bincount(row, minlength=n)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + weights[-1], -35, 35)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights learned from labelled documents that aren't held out. At most about sample_rows documents are gathered."""
    spark = docs.sparkSession
    arrow_rows(spark)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = hash_sample(known.select("doc_id", F.col(label).cast("int").alias("__y")), "doc_id", sample_rows)
    known = known.groupBy("doc_id").agg(F.max("__y").alias("__y"))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def featurise(batches):
        for b in batches:
            f = features(*tv.texts(b.column("text")), bits)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__y"), pa.array([i.tobytes() for i, _ in f], pa.binary()), pa.array([v.tobytes() for _, v in f], pa.binary())], ["doc_id", "y", "i", "v"])

    sparse = rows.mapInArrow(featurise, "doc_id long, y int, i binary, v binary")
    sparse = sparse.withColumn("h", F.xxhash64("doc_id", "i")).repartition(1).sortWithinPartitions("h")

    def fit(batches):
        seen = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y) for b in batches for i, v, y in zip(b.column("i").to_pylist(), b.column("v").to_pylist(), b.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([ftrl(seen, bits).tobytes()], pa.binary())], ["w"])

    got = sparse.mapInArrow(fit, "w binary").collect()
    return np.frombuffer(got[0].w, np.float32) if got else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with score double and predicted int; these replace columns of the same names."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def make(raw, at):
        s = scores(raw, at, held.value)
        return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]

    return map_texts(docs, "text", [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, keep)
