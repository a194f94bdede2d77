"""Spark sessions as the library expects them, and the folder for tables that jobs share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, ANSI errors, and the charsets that text repair needs."""
    b = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.ansi.enabled", "true").config("spark.sql.legacy.javaCharsets", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's name below spark.checkpoint.dir; where unset, below a temporary folder (local master) or the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local["):
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="terrane-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        root = f"file://{_OWN[0]}"
    root = root or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage of iterative jobs and survives lost executors. Removed when the driver ends."""
    spark = df.sparkSession
    path = shared_folder(spark, tag)
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
