"""Language identification by error-correcting output codes over hashed byte n-grams.

Every learned language gets a codeword; each bit of it is predicted by a binary logistic classifier on hashed byte
n-grams (one to three bytes of the lower-cased text). A text's bits are decoded by loss weighting: the language is
that whose codeword has the least sum of logistic losses. ``score`` is the softmax of the negative mean losses, and
``ambiguous`` tells that the second-best language is close.

Codewords are the exhaustive code (all splits of the languages into two) up to six languages and seeded random balanced
words beyond, ``max(31, 8 * ceil(log2(K)))`` bits.

Training takes a bounded sample: about ``per_language`` documents of each language that aren't held out, drawn by hash.
The model, ``2 ** bits`` by the number of code bits, doesn't grow with the corpus. Prediction reads each whole text once,
without a shuffle, counting n-grams into a dense row for each text, in memory bounded by the longest text.

Nulls and edges: a text that is null or has no letter gets ``und`` with score 1 and isn't ambiguous. Null languages aren't
learned from. Without any language to learn, all are ``und`` with score 0. With one language, all texts with a letter get it with
score 1. Ties go to the language that is first by code points. Repeated rows are judged one by one. Extra columns are kept.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm import textvec as tv
from terrane.llm.common import arrow_rows, held_out, map_texts

BITS = 13
PER_LANGUAGE = 1000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = regex.compile(r"\p{L}")
_T1, _T2, _T3 = (tv.rand64(s, 256).astype(np.uint32) for s in (23, 29, 31))


def codebook(k: int) -> np.ndarray:
    """Rows of +1 and -1, one for each of k classes."""
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= 6:
        columns = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(columns, np.float32).T
    rng = np.random.Generator(np.random.PCG64(k))
    width = max(31, 8 * math.ceil(math.log2(k)))
    best, apart = None, -1
    for _ in range(20):  # of some random codes, the one whose nearest words are farthest apart
        half = np.where(np.argsort(rng.random((width, k)), axis=1) < (k + 1) // 2, 1, -1).T.astype(np.float32)
        gram = half @ half.T
        np.fill_diagonal(gram, -width)
        if (d := (width - gram.max()) / 2) > apart:
            best, apart = half, d
    return best


def histograms(raw: np.ndarray, at: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each row, the square roots of the shares of its hashed byte n-grams."""
    n, dim = len(at) - 1, 1 << bits
    out = np.zeros((n, dim), np.float32)
    low = _LOWER[raw]
    accented = np.flatnonzero((low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[:-1] == 0xC3)) + 1 if len(low) > 1 else []
    low[accented] |= 0x20
    a, b, c = _T1[low], _T2[low], _T3[low]
    two = b[:-1] + c[1:]
    three = (a[:-2] * np.uint32(5)) ^ (b[1:-1] * np.uint32(9)) ^ (c[2:] * np.uint32(17))
    shift = np.uint32(32 - bits)
    one, two, three = (((x * np.uint32(0x9E3779B1)) >> shift) for x in (a, two, three))
    for i in range(n):
        s, e = at[i], at[i + 1]
        if e > s:
            h = np.bincount(one[s:e], minlength=dim)
            h += np.bincount(two[s : max(s, e - 1)], minlength=dim)
            h += np.bincount(three[s : max(s, e - 2)], minlength=dim)
            out[i] = h / h.sum()
    return np.sqrt(out, out=out)


def fit(x: np.ndarray, y: np.ndarray, code: np.ndarray, epochs: int = 40, rate: float = 0.5, l2: float = 1e-6) -> np.ndarray:
    """Weights (features + 1, bits) of logistic classifiers of the code bits: mini-batches with per-weight step sizes."""
    target = code[y]
    w = np.zeros((x.shape[1] + 1, code.shape[1]), np.float32)
    g2 = np.full_like(w, 1e-6)
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 256):
            i = order[k : k + 256]
            xi, ti = x[i], target[i]
            r = -ti / (1 + np.exp(np.clip(ti * (xi @ w[:-1] + w[-1]), -30, 30)))
            g = np.vstack([xi.T @ r, r.sum(0, keepdims=True)]) / len(i) + l2 * w
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
    return w


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best class, its softmax score, and the second-best one's."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None]).mean(2)
    p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    top = p[np.arange(len(p)), best]
    rest = p.copy()
    rest[np.arange(len(p)), best] = 0
    return best, top, rest.max(1)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = 8000, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and the classifiers' weights. About ``per_language`` documents of each, ``total`` in all, are gathered."""
    spark = docs.sparkSession
    arrow_rows(spark)
    pool = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).select("doc_id", "lang", "text")
    counts = {r.lang: r.n for r in pool.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((1 + (1 << bits), 1), np.float32)
    each = max(1, min(per_language, total // len(languages)))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(2**62 * min(1.0, each / n)))])
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    h = F.xxhash64(F.lit(0xEC0C), "doc_id", "text").bitwiseAND(F.lit(2**62 - 1))
    sample = pool.select(h.alias("h"), F.element_at(number, F.col("lang")).alias("y"), F.element_at(share, F.col("lang")).alias("s"), "text").where("h <= s")

    def sparse(batches):
        for b in batches:
            raw, at = tv.texts(b.column("text"))
            found = [(i, r[i]) for k in range(b.num_rows) for r in [histograms(raw[at[k] : at[k + 1]], at[k : k + 2] - at[k], bits)[0]] for i in [np.flatnonzero(r)]]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["h", "y", "i", "v"])

    rows = sample.select("h", "y", "text").mapInArrow(sparse, "h long, y int, i binary, v binary").repartition(1).sortWithinPartitions("h", "y", "i")

    def fit_all(batches):
        got = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in ("y", "i", "v")), strict=True)]
        x = np.zeros((len(got), 1 << bits), np.float32)
        for k, (_, i, v) in enumerate(got):
            x[k, np.frombuffer(i, np.int32)] = np.frombuffer(v, np.float32)
        w = fit(x, np.array([r[0] for r in got], np.int64), codebook(len(languages)))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    blob = rows.mapInArrow(fit_all, "w binary").collect()[0].w
    return languages, np.frombuffer(blob, np.float32).reshape(1 + (1 << bits), -1)


def predict(docs: DataFrame, languages: list[str], weights: np.ndarray, margin: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with lang_pred string, score double and ambiguous boolean (second best over ``margin`` of the best)."""
    bits = (len(weights) - 1).bit_length() - 1
    held = docs.sparkSession.sparkContext.broadcast((languages, np.array(weights), codebook(len(languages))))

    def make(raw, at):
        names, w, code = held.value
        n = len(at) - 1
        data = raw.tobytes()
        letter = np.array([bool(_LETTER.search(data[at[k] : at[k + 1]].decode("utf-8", "replace"))) for k in range(n)], bool)
        label, score, close = np.full(n, "und", object), np.where(letter & (not names), 0.0, 1.0), np.zeros(n, bool)
        if names:
            for k in range(0, n, 64):
                rows = slice(k, min(k + 64, n))
                x = histograms(raw[at[rows.start] : at[rows.stop]], at[rows.start : rows.stop + 1] - at[rows.start], bits)
                best, top, second = decode(x @ w[:-1] + w[-1], code)
                known = letter[rows]
                label[rows] = np.where(known, np.array(names, object)[best], "und")
                score[rows] = np.where(known, top, 1.0)
                close[rows] = known & (second > margin * top)
        return [pa.array(label.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())]

    return map_texts(docs, "text", [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())], make, keep)
