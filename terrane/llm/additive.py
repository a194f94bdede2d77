"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of ``BOOKS`` full-dimensional codewords, one from each codebook, and its code keeps the squared norm
of that sum. Codebooks are fitted as residual k-means on a bounded sample (``sample_rows``, by hash) in one task;
codes are found by beam search over the books, ``BEAM`` partial sums at a time. A query scores all codes from a table of its
products with all codewords: norm - 2 * (sum of table entries). The ``SHORTLIST`` distinct vectors of the best scores, over the whole corpus, are then reranked
exactly, in double precision, and the best ``k`` are the result: codes alone decide what is looked at.

Equal vectors are coded once, and stand for the k + 1 least ids that they have, which is all that a result can hold, so that copies can't crowd out others.
Codes (``BOOKS`` bytes and a norm for each vector, without the vectors) fall into at most ``GROUPS`` parts by hash, queries into batches of about ``BATCH``, and each pair of part and batch is one task's; a part is
looked through ``SLICE`` codes at a time. Of each part and query, SHORTLIST rows are shuffled, and of each query SHORTLIST vectors. Nothing but the sample's codebooks and counts comes to
the driver. Vectors that only rows of the query's id have are left out before the shortlist is cut, so that these can't crowd out others either.

Nulls and edges: vectors that are null, zero, hold nulls or non-finite components, or are of another length than most (the most frequent length; ties: the
shorter) take no part. Rows with null ids take no part. Repeated ids are separate candidates, ordered by id; a query excludes every row of its own id, and a repeated query id is one
query (the least vector by its bytes). Fewer candidates than k: all of them. No vectors: no rows. Extra columns play no role.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.common import arrow_rows, grouped, hash_sample, materialise

BOOKS = 40
WORDS = 256
BEAM = 4
SAMPLE_ROWS = 8192
GROUPS = 32
PART = 8192
BATCH = 65_536
SLICE = 8192
SHORTLIST = 128


def vectors(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id long, *keep, v binary of doubles) of all rows; v is null where the vector takes no part."""
    arrow_rows(rows.sparkSession, 4096)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), *keep, F.col("embedding").cast("array<double>").alias("embedding"))
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    sizes = rows.where(sound).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0].d if sizes else 0
    names = ["vec_id", *keep, "v"]
    rows = rows.withColumn("embedding", F.when(F.coalesce(sound & (F.size("embedding") == d), F.lit(False)), F.col("embedding")))

    def pack(batches):
        for b in batches:
            column = b.column("embedding")
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            flat = np.ascontiguousarray(column.drop_null().flatten().to_numpy(zero_copy_only=False), np.float64) + 0.0  # no negative zeros
            at = np.arange(0, len(flat) * 8 + 1, max(d, 1) * 8, dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat.tobytes())])
            packed = packed.take(pa.array(np.where(valid, np.cumsum(valid) - 1, 0), mask=~valid))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed], names)

    return rows.mapInArrow(pack, T.StructType([*rows.schema.fields[:-1], T.StructField("v", T.BinaryType())]))


def matrix(column) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    if len(c) < k:
        c = np.vstack([c, np.zeros((k - len(c), x.shape[1]), x.dtype)])
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = n > 0
        c[full] = sums[full] / n[full, None]
    return c


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS) -> np.ndarray:
    """Codebooks (books, words, dimension) by k-means of residuals."""
    rng = np.random.Generator(np.random.PCG64(7))
    rest, out = x.astype(np.float32).copy(), []
    for _ in range(books):
        c = kmeans(rest, words, rng)
        out.append(c)
        rest -= c[((c * c).sum(1) - 2 * rest @ c.T).argmin(1)]
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, books) and squared norms of the sums of their codewords, by beam search for the least error."""
    x = x.astype(np.float32)
    n, dim = x.shape
    codes, rest = np.zeros((n, 1, 0), np.uint8), x[:, None, :]
    for c in books:
        # Error of adding codeword w to a partial sum with this residual: |rest|^2 - 2 rest.w + |w|^2
        error = (rest * rest).sum(2)[:, :, None] - 2 * rest @ c.T + (c * c).sum(1)
        width = error.shape[1]
        error = error.reshape(n, -1)
        keep = min(beam, error.shape[1])
        best = np.argpartition(error, keep - 1, axis=1)[:, :keep]
        parent, word = best // len(c), best % len(c)
        row = np.arange(n)[:, None]
        codes = np.concatenate([codes[row, parent], word[:, :, None].astype(np.uint8)], 2)
        rest = rest[row, parent] - c[word]
        assert width <= beam
    last = (rest * rest).sum(2).argmin(1)
    codes = codes[np.arange(n), last]
    total = sum(c[codes[:, m]] for m, c in enumerate(books))
    return codes, (total * total).sum(1)


def train(packed: DataFrame, sample_rows: int = SAMPLE_ROWS, books: int = BOOKS, words: int = WORDS) -> np.ndarray | None:
    sample = hash_sample(packed, "vec_id", sample_rows).withColumn("h", F.xxhash64("vec_id")).repartition(1).sortWithinPartitions("h", "v")

    def learn(batches):
        seen = [matrix(b.column("v")) for b in batches if b.num_rows]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([fit(np.vstack(seen), books, words).tobytes()], pa.binary())], ["b"])

    got = sample.select("v", "h").mapInArrow(learn, "b binary").collect()
    return np.frombuffer(got[0].b, np.float32).reshape(books, words, -1) if got else None


def distinct_points(packed: DataFrame, k: int) -> DataFrame:
    """(uid, v, ids array<struct<id, n>>): different vectors, each with its k + 1 least ids and how often (k times at most) each has it."""
    ids = packed.groupBy("v", F.col("vec_id").alias("id")).agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    ids = ids.withColumn("__r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("__r") <= k + 1)
    points = ids.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("ids"))
    return points.select(F.monotonically_increasing_id().alias("uid"), "v", "ids")


def index(points: DataFrame, books: np.ndarray) -> DataFrame:
    """(uid, owner, code, norm) of every point. owner: the id that alone has the vector, else null."""
    held = points.sparkSession.sparkContext.broadcast(books)

    def build(batches):
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v"))
                parts = [encode(v[i : i + 512], held.value) for i in range(0, len(v), 512)]
                codes, norms = np.vstack([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("owner"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32())], ["uid", "owner", "code", "norm"])

    alone = F.when(F.size("ids") == 1, F.col("ids")[0]["id"])
    return points.select("uid", alone.alias("owner"), "v").mapInArrow(build, "uid long, owner long, code binary, norm float")


def best_codes(queries: np.ndarray, query_ids: np.ndarray, books: np.ndarray, uid: np.ndarray, owner: np.ndarray, codes: np.ndarray, norms: np.ndarray, keep: int):
    """(places in uid, scores), one pair for each query: the ``keep`` best of codes by lookup tables, none that the query's id alone has. owner: -1 for none."""
    for s in range(0, len(queries), 32):
        q = queries[s : s + 32].astype(np.float32)
        tables = -2 * np.einsum("qd,mwd->mqw", q, books)
        best, at = np.zeros((len(q), 0), np.float32), np.zeros((len(q), 0), np.int64)
        for k in range(0, len(uid), SLICE):
            part = slice(k, k + SLICE)
            score = np.broadcast_to(norms[part], (len(q), len(norms[part]))).copy()
            for m in range(len(books)):
                score += tables[m][:, codes[part, m]]
            score[query_ids[s : s + 32, None] == owner[None, part]] = np.inf
            best = np.hstack([best, score])
            at = np.hstack([at, np.broadcast_to(np.arange(k, k + score.shape[1]), score.shape)])
            if best.shape[1] > keep:
                near = np.argpartition(best, keep - 1, axis=1)[:, :keep]
                best, at = np.take_along_axis(best, near, 1), np.take_along_axis(at, near, 1)
        for row, places in zip(best, at, strict=True):
            yield places[np.isfinite(row)], row[np.isfinite(row)]


def shortlisted(codes: DataFrame, asked: DataFrame, books: np.ndarray, keep: int) -> DataFrame:
    """(query_id, uid): the ``keep`` points of the best scores of each query, over all codes."""
    spark = codes.sparkSession
    parts = min(GROUPS, max(1, -(-codes.count() // PART)))
    runs = max(1, -(-asked.count() // BATCH))
    held = spark.sparkContext.broadcast(books)
    part = lambda c, n, salt: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    left = asked.select(F.lit(0).alias("kind"), part("vec_id", runs, 71).alias("run"), F.col("vec_id").alias("id"), none("long").alias("owner"), F.col("v").alias("data"), none("float").alias("norm")).withColumn("part", every(parts))
    right = codes.select(F.lit(1).alias("kind"), part("uid", parts, 67).alias("part"), F.col("uid").alias("id"), "owner", F.col("code").alias("data"), "norm").withColumn("run", every(runs))
    rows = left.unionByName(right).withColumn("task", F.col("run") * parts + F.col("part"))
    rows = rows.repartitionById(parts * runs, "task").sortWithinPartitions("task", "kind", "id")

    def look(batches):
        for _, t in grouped(batches, ["task"]):
            kind = t.column("kind").to_numpy()
            cut = int(np.searchsorted(kind, 1))
            if not 0 < cut < len(kind):
                continue
            ids, data = t.column("id").to_numpy(), t.column("data").to_pylist()
            queries = np.frombuffer(b"".join(data[:cut]), np.float64).reshape(cut, -1)
            codes = np.frombuffer(b"".join(data[cut:]), np.uint8).reshape(len(ids) - cut, -1)
            owner = t.column("owner").slice(cut)
            lone = owner.is_valid().to_numpy()
            owner = np.where(lone, owner.fill_null(0).to_numpy(), ids.min() - 1)
            norms = t.column("norm").slice(cut).to_numpy().astype(np.float32)
            del data
            for q, (at, score) in zip(ids[:cut], best_codes(queries, ids[:cut], held.value, ids[cut:], owner, codes, norms, keep), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q)), pa.array(ids[cut:][at]), pa.array(score)], ["query_id", "uid", "near"])

    found = rows.select("task", "kind", "id", "owner", "data", "norm").mapInArrow(look, "query_id long, uid long, near float")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("near", "uid"))
    return found.withColumn("__r", rank).where(F.col("__r") <= keep).select("query_id", "uid")


def exact(pairs: DataFrame) -> DataFrame:
    """pairs (query_id, ids, v, q) as (query_id, ids, score): Euclidean distance in double precision."""

    def measure(batches):
        for b in batches:
            if b.num_rows:
                diff = matrix(b.column("v")) - matrix(b.column("q"))
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("ids"), pa.array(np.sqrt((diff * diff).sum(1)))], ["query_id", "ids", "score"])

    schema = T.StructType([pairs.schema["query_id"], pairs.schema["ids"], T.StructField("score", T.DoubleType())])
    return pairs.select("query_id", "ids", "v", "q").mapInArrow(measure, schema)


def search(rows: DataFrame, k: int = 10, every: int = 100, shortlist: int = SHORTLIST) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``every``, its k nearest others by Euclidean distance."""
    spark = rows.sparkSession
    packed = materialise(vectors(rows).where("vec_id IS NOT NULL AND v IS NOT NULL"), "vectors")
    books = train(packed)
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = materialise(distinct_points(packed, k), "points")
    codes = materialise(index(points, books), "codes")
    asked = materialise(packed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    near = materialise(shortlisted(codes, asked, books, max(shortlist, k)), "shortlist")
    pairs = near.join(points, "uid").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    others = exact(pairs).select("query_id", "score", F.explode("ids").alias("i")).where("i.id <> query_id")
    found = others.select("query_id", "score", F.col("i.id").alias("vec_id"), F.explode(F.sequence(F.lit(1), "i.n")).alias("__n"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
