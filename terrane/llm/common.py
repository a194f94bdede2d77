"""Shared plumbing: scratch tables on storage all executors share, and Arrow batch sizing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm import textvec as tv

_OWN: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; where unset, a temporary folder (local master) or the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="terrane-scratch-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        return f"file://{_OWN[0]}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def materialise(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write df as Parquet on the shared scratch folder and read it back: cuts lineage, survives lost executors.

    The folder is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/terrane-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def arrow_rows(spark: SparkSession, rows: int = 512) -> None:
    """Smaller Arrow batches than Spark's default, so that batches of long texts stay within a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows by the least hashes of key: the same rows however the data are partitioned."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.xxhash64(F.lit(0x5EED), key).bitwiseAND(F.lit(2**62 - 1)) < F.lit(int(2**62 * (rows / n))))


def give_back() -> None:
    """Return what a worker process has freed to the system: workers outlive tasks, and share an executor's memory with the next ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(at: np.ndarray, most: int = 4 << 20):
    """Row ranges of at most ``most`` bytes each; a longer row stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def grouped(batches, key: list[str]):
    """Record batches of rows sorted by key, one table for each key; only the rows of one key and one batch are held."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in key]
        cut = np.zeros(b.num_rows, bool)
        for c in columns:
            cut[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(cut).tolist(), b.num_rows]
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            now = tuple(c[i] for c in columns)
            if held and now != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = now
    if held:
        yield last, pa.Table.from_batches(held)


def map_texts(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[np.ndarray, np.ndarray], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of df (all by default) and new ones that ``make`` computes from the UTF-8 bytes and offsets of a text column.

    New columns replace those of df that have their names (in any case).
    """
    arrow_rows(df.sparkSession)
    new = {f.name.lower() for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    carried = [c.lower() for c in keep]
    source = df.select(*[F.col(f"`{c}`") for c in keep], *([] if text.lower() in carried else [F.col(text).alias("__text")]))
    at_column = carried.index(text.lower()) if text.lower() in carried else len(keep)
    names = [*keep, *[f.name for f in fields]]

    def run(batches):
        for b in batches:
            raw, at = tv.texts(b.column(at_column))
            parts = [make(raw[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in pieces(at)] or [make(raw, at)]
            made = [pa.concat_arrays(p) for p in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names)
        give_back()

    schema = T.StructType([*[source.schema[i] for i in range(len(keep))], *fields])
    return source.mapInArrow(run, schema)
