"""Reading and writing tables: CSV with a byte-order mark, unit packets, temporal arrays, station sheets, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.operators.constraints import ConstraintError, nan_to_null
from terrane.operators.ordering import joined

MARK = "﻿"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header; names are stripped of a byte-order mark and blanks; NaN becomes null. Only ``columns`` are read if given."""
    reader = spark.read.option("header", True).option("nanValue", "nan").option("enforceSchema", True)
    if schema is None:
        df = reader.option("inferSchema", True).csv(path)
    else:
        df = reader.schema(schema).csv(path)
    df = nan_to_null(df.toDF(*[c.replace(MARK, "").strip() for c in df.columns]))
    if columns is None:
        return df
    if missing := set(columns) - set(df.columns):
        raise ConstraintError(f"no such columns: {sorted(missing)}")
    return df.select(*columns)


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header, in UTF-8; the first name carries a byte-order mark, so that spreadsheets know it."""
    named = df.toDF(MARK + df.columns[0], *df.columns[1:])
    (named.coalesce(files) if files else named).write.mode("overwrite").option("header", True).csv(path)


def write_packet(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet partitioned by protocol and fold; partitions that are written again replace the old ones alone, so that a rerun is idempotent."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def feature_vector(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and one array of doubles of the named columns."""
    return df.select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))


def checked_arrays(df: DataFrame, key: str, widths: dict[str, int]) -> DataFrame:
    """df unless an id repeats or an array isn't as wide as it must be."""
    bad = df.agg((F.count("*") - F.count_distinct(key)).alias("repeated"), *[F.count_if(~F.coalesce(F.size(c) == w, F.lit(False))).alias(c) for c, w in widths.items()]).first().asDict()
    if broken := {k: v for k, v in bad.items() if v}:
        raise ConstraintError(f"array table: {broken}")
    return df


def wide_to_long(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """(key, year, value) of columns named prefix_YYYY."""
    names = [c for c in df.columns if c.startswith(prefix + "_") and c[len(prefix) + 1 :].isdigit()]
    long = df.unpivot([key], names, "name", "value")
    return long.select(key, F.substring_index("name", "_", -1).cast("int").alias("year"), "value")


def station_daily(raw: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Daily levels from loosely typed rows (station, date, level as strings), and one row of counts of what was dropped.

    Unknown stations and rows whose date or number can't be read are dropped and counted; identical repeats become one; a station and day with two different levels is an error.
    """
    clean = raw.select(F.trim("station").alias("station"), F.expr("try_cast(trim(date) as date)").alias("date"), F.expr("try_cast(trim(level) as double)").alias("level"))
    known = F.col("station").isin(names)
    ok = known & F.col("date").isNotNull() & F.col("level").isNotNull() & ~F.coalesce(F.isnan("level"), F.lit(False))
    audit = clean.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown_station"), F.count_if(known & F.col("date").isNull()).alias("bad_date"), F.count_if(known & F.col("date").isNotNull() & F.col("level").isNull()).alias("bad_level"))
    g = clean.where(ok).groupBy("station", "date").agg(F.min("level").alias("level"), F.count_distinct("level").alias("k"))
    if n := g.where("k > 1").count():
        raise ConstraintError(f"{n} days have two levels")
    return g.drop("k"), audit


def event_points(raw: DataFrame, date: str, lon: str, lat: str, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """Dated points of the years first to last with their year and how many of them share the place, and (year, n, repeated, unreadable) counts; unreadable counts dates of the whole table that can't be read."""
    dated = raw.withColumn("__date", F.expr(f"try_cast(`{date}` as date)"))
    bad = dated.agg(F.count_if(F.col("__date").isNull()).alias("unreadable"))
    kept = dated.where(F.year("__date").between(first, last)).withColumn("year", F.year("__date"))
    places = kept.groupBy(lon, lat).agg(F.count("*").alias("at_place"))
    points = joined(kept.drop("__date"), places, [lon, lat])
    years = points.groupBy("year").agg(F.count("*").alias("n"), F.count_if(F.col("at_place") > 1).alias("repeated"))
    return points, years.crossJoin(F.broadcast(bad))


def ragged_audit(pixels: DataFrame, units: DataFrame, key: str, columns: list[str], weight: str) -> DataFrame:
    """One row of counts: pixels, pixels with a missing or infinite value, with a weight that isn't positive and finite, of unknown units, and units without pixels. One pass, and one join."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    good = F.lit(True)
    for c in columns:
        good = good & finite(c)
    per_unit = pixels.groupBy(key).agg(F.count("*").alias("n"), F.count_if(~good).alias("bad_value"), F.count_if(~F.coalesce(finite(weight) & (F.col(weight) > 0), F.lit(False))).alias("bad_weight"))
    j = per_unit.join(units.select(F.col(key).alias("__unit")).distinct(), F.col(key) == F.col("__unit"), "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    outside = F.sum(F.when(F.col("__unit").isNull(), F.col("n")))
    return j.agg(total("n"), total("bad_value"), total("bad_weight"), F.coalesce(outside, F.lit(0)).alias("unknown_unit"), F.count_if(F.col("n").isNull()).alias("empty_units"))


def checked_pixels(pixels: DataFrame, units: DataFrame, key: str, columns: list[str], weight: str) -> DataFrame:
    """pixels, unless a value or weight is invalid or a unit unknown; units without pixels are allowed."""
    found = ragged_audit(pixels, units, key, columns, weight).first().asDict()
    if broken := {k: found[k] for k in ("bad_value", "bad_weight", "unknown_unit") if found[k]}:
        raise ConstraintError(f"pixels: {broken}")
    return pixels


def seal(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against a manifest (path, sha256); manifest paths outside the folder are an error."""
    root = seal(spark, path)
    if manifest.where(F.col("path").contains("/../")).count():
        raise ConstraintError("a manifest path leaves its folder")
    j = root.join(manifest.withColumnRenamed("sha256", "was"), "path", "full")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("sha256") != F.col("was"), "changed")
    return j.select("path", state.alias("state")).where("state IS NOT NULL")


def strict_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row, without NaN or infinities (null instead)."""
    safe = df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})
    return safe.select(F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"}).alias("json"))
