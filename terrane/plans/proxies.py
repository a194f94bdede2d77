"""Standard tables in the shapes that the operators work on, as DataFrames and as SQL.

``units``: scored, labelled areas (orders with their customer's nation and region). ``pixels``: weighted child records of units (lineitem).
``daily``: daily station levels (the largest event value of a type and day). ``monthly``: monthly amounts of a nation. Areas, weights and
elevations are whole numbers held as doubles, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uniform(token: Column) -> Column:
    """Number in [0, 1) from the first 32 bits of a SHA-256."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_mod(token: Column, n: int) -> Column:
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % n).cast("int")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return joined.select(
        F.col("o_orderkey").alias("unit_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        ((F.floor("o_totalprice") % 100).cast("double") / 100).alias("p"),
        (F.floor(F.col("o_totalprice") / 1000) + 1).cast("double").alias("area"),
        F.to_date("o_orderdate").alias("event_date"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_custkey").alias("site"),
        F.col("n_name").alias("county"),
        F.col("r_name").alias("region"),
        hash_mod(F.concat(F.lit("fold|"), F.col("o_orderkey").cast("string")), 5).alias("fold"),
        F.floor(F.col("c_acctbal") / 10).cast("double").alias("x"),
        F.floor(F.col("o_totalprice") / 500).cast("double").alias("y"),
    )


UNITS = """units AS (
  SELECT o_orderkey AS unit_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
    CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) / 100 AS p,
    CAST(floor(o_totalprice / 1000) + 1 AS DOUBLE) AS area,
    CAST(o_orderdate AS DATE) AS event_date, o_orderpriority AS priority, o_custkey AS site, n_name AS county, r_name AS region,
    CAST(CAST('0x' || substr(sha256('fold|' || o_orderkey), 1, 8) AS UBIGINT) % 5 AS INTEGER) AS fold,
    CAST(floor(c_acctbal / 10) AS DOUBLE) AS x, CAST(floor(o_totalprice / 500) AS DOUBLE) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns pixel_key (a total order up to equal rows), weight, elevation, slope, wet (tenths), class and status."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("unit_id"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").cast("double").alias("weight"),
        F.floor(F.col("l_extendedprice") / 100).cast("double").alias("elevation"),
        F.rint(F.col("l_tax") * 100).alias("slope"),
        F.rint(F.col("l_discount") * 100).alias("wet"),
        F.col("l_returnflag").alias("class"),
        F.col("l_linestatus").alias("status"),
    )


PIXELS = """pixels AS (
  SELECT l_orderkey AS unit_id, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS DOUBLE) AS weight,
    CAST(floor(l_extendedprice / 100) AS DOUBLE) AS elevation, round_even(l_tax * 100, 0) AS slope, round_even(l_discount * 100, 0) AS wet,
    l_returnflag AS class, l_linestatus AS status FROM lineitem)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("station"), F.to_date("ts").alias("date")).agg(F.max("value").alias("level"))


DAILY = "daily AS (SELECT event_type AS station, CAST(ts AS DATE) AS date, max(value) AS level FROM events GROUP BY 1, 2)"


def sparse_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each user, with real gaps."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("station"), F.to_date("ts").alias("date")).agg(F.max("value").alias("level"))


SPARSE = "daily AS (SELECT 'u' || user_id AS station, CAST(ts AS DATE) AS date, max(value) AS level FROM events GROUP BY 1, 2)"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(county, month, rain): whole amounts; months without orders are missing."""
    u = units(spark, sf_dir)
    return u.groupBy("county", F.trunc("event_date", "MM").alias("month")).agg(F.sum("area").alias("rain"))


MONTHLY = UNITS + ",\nmonthly AS (SELECT county, CAST(date_trunc('month', event_date) AS DATE) AS month, sum(area) AS rain FROM units GROUP BY 1, 2)"
