"""Queries of weighted summaries, zonal fractions and scalers (over pixels)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.operators import bags as B
from terrane.operators.ordering import quantiles
from terrane.plans.proxies import PIXELS, UNITS, pixels, units
from terrane.plans.registry import Catalog

C = Catalog()
q = C.query
VALUES = """v AS (SELECT unit_id, elevation AS x, sum(weight) AS w FROM pixels GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY unit_id ORDER BY x ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY unit_id) AS cum, sum(x * w) OVER (PARTITION BY unit_id) / sum(w) OVER (PARTITION BY unit_id) AS m, w / sum(w) OVER (PARTITION BY unit_id) AS share FROM v)"""


@q(f"""WITH {PIXELS}, {VALUES} SELECT unit_id, round(max(m), 6) AS mean, round(sqrt(sum(w * (x - m) ** 2) / sum(w)), 6) AS sd, {", ".join(f"coalesce(min(x) FILTER (cum >= {p}), max(x)) AS p{round(p * 100):02d}" for p in (0.1, 0.5, 0.9))} FROM c GROUP BY 1""")
def bag_weighted_summary(spark, d):
    return B.weighted_summary(pixels(spark, d), "unit_id", "elevation").withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@q(f"""WITH {PIXELS}, s AS (SELECT unit_id, sum(weight * wet) / sum(weight) AS ms, sum(weight * slope) / sum(weight) AS mx, sum(weight * wet * slope) / sum(weight) AS msx FROM pixels GROUP BY 1)
SELECT unit_id, round(msx / greatest(ms, 1e-8), 6) AS weighted_x, round(msx - ms * mx, 6) AS covariance FROM s""")
def bag_joint_stats(spark, d):
    return B.joint_summary(pixels(spark, d), "unit_id", "wet", "slope").withColumns({c: F.round(c, 6) for c in ("weighted_x", "covariance")})


@q(f"""WITH {PIXELS}, {VALUES}, k AS (SELECT unit_id, min(x) FILTER (cum >= 0.1) AS a, min(x) FILTER (cum >= 0.5) AS b, min(x) FILTER (cum >= 0.9) AS z FROM c GROUP BY 1)
SELECT c.unit_id, x AS elevation, round(cum - share / 2, 9) AS mid, round((x - b) / greatest(z - a, 1.0), 9) AS relative FROM c JOIN k ON k.unit_id = c.unit_id""")
def bag_mid_cdf(spark, d):
    return B.mid_cdf(pixels(spark, d), "unit_id", "elevation").withColumns({c: F.round(c, 9) for c in ("mid", "relative")})


@q(f"""WITH {PIXELS}, p AS (SELECT unit_id, CASE WHEN slope < 7 THEN class END AS class FROM pixels)
SELECT unit_id, count(*) AS n, count(class) AS valid, {", ".join(f"count(*) FILTER (class = '{v}')::DOUBLE / count(*) AS {('all_' + v)}, count(*) FILTER (class = '{v}')::DOUBLE / nullif(count(class), 0) AS {('valid_' + v)}" for v in "ANR")} FROM p GROUP BY 1""")
def class_fraction_pivot(spark, d):
    p = pixels(spark, d).select("unit_id", F.when(F.col("slope") < 7, F.col("class")).alias("class"))
    return B.class_fractions(p, "unit_id", "class", ["A", "N", "R"])


@q(f"""WITH {PIXELS}, c AS (SELECT unit_id, class, count(*) AS n FROM pixels GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY n DESC, class) AS rn, sum(n) OVER (PARTITION BY unit_id) AS total FROM c)
SELECT unit_id, class AS dominant, n::DOUBLE / total AS share FROM r WHERE rn = 1""")
def dominant_class(spark, d):
    return B.dominant_class(pixels(spark, d), "unit_id", "class")


EXPOSURE = f"""WITH {PIXELS}, b AS (SELECT o_custkey AS site, CASE WHEN wet / 10 <= 0.1 THEN 'low' WHEN wet / 10 >= 0.9 THEN 'high' ELSE 'middle' END AS band, class, weight FROM pixels JOIN orders ON o_orderkey = unit_id),
e AS (SELECT site, band, class, sum(weight) AS w FROM b GROUP BY GROUPING SETS ((site, band, class), (site, band), (site, class)))"""


def exposure(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("site"))
    return B.exposure_by_class(pixels(spark, d).join(o, "unit_id").withColumn("share", F.col("wet") / 10), "site", "share", "class")


@q(f"{EXPOSURE} SELECT * FROM e")
def exposure_class_grouping_sets(spark, d):
    return exposure(spark, d)


@q(f"""{EXPOSURE}, t AS (SELECT site, sum(w) AS total FROM e WHERE class IS NULL GROUP BY 1)
SELECT a.site, a.band, b.class, round(a.w * b.w / total, 6) AS expected FROM e a JOIN e b ON a.site = b.site AND a.class IS NULL AND b.band IS NULL JOIN t ON t.site = a.site""")
def independence_outer(spark, d):
    return B.independence(exposure(spark, d), "site").withColumn("expected", F.round("expected", 6))


@q(f"""WITH {UNITS} SELECT region, CASE WHEN grouping(county) = 1 THEN NULL ELSE county END AS county, CAST(grouping(county) AS INTEGER) AS rolled, count(*) AS n, sum(area) AS area FROM units GROUP BY ROLLUP (region, county) HAVING region IS NOT NULL""")
def category_rollup(spark, d):
    return units(spark, d).rollup("region", "county").agg(F.grouping("county").cast("int").alias("rolled"), F.count("*").alias("n"), F.sum("area").alias("area")).where("region IS NOT NULL")


@q(f"""WITH {PIXELS}, a(class, age) AS (VALUES ('A', 10), ('N', 25), ('R', 70)), c AS (SELECT unit_id, class, count(*) AS n FROM pixels GROUP BY 1, 2),
m AS (SELECT unit_id, sum(n * age)::DOUBLE / sum(n) AS mean, sum(n * age * age)::DOUBLE / sum(n) AS sq, min(age) AS least, max(age) AS greatest FROM c JOIN a USING (class) GROUP BY 1)
SELECT unit_id, round(mean, 6) AS mean, least, greatest, greatest - least AS span, round(sqrt(greatest(sq - mean * mean, 0)), 4) AS sd FROM m""".replace("greatest(sq", "GREATEST(sq"))
def category_moments(spark, d):
    ages = spark.createDataFrame([("A", 10), ("N", 25), ("R", 70)], "class string, age int")
    out = B.category_moments(pixels(spark, d), "unit_id", "class", ages, "age")
    return out.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 4)})


@q(f"""WITH {PIXELS} SELECT status, {", ".join(f"round(quantile_cont(elevation, {p}), 6) AS p{round(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM pixels GROUP BY 1""")
def zonal_quantiles(spark, d):
    ps = (0.05, 0.25, 0.5, 0.75, 0.95)
    p = quantiles(pixels(spark, d), ["status"], "elevation", list(ps), "p")
    return p.select("status", *[F.round(F.col("p")[i], 6).alias(f"p{round(x * 100):02d}") for i, x in enumerate(ps)])


@q(f"""WITH {PIXELS} SELECT unit_id, count(*) AS n, round(avg(elevation), 6) AS mean_elevation, round(avg(slope), 6) AS mean_slope, count(*) FILTER (elevation BETWEEN 145 AND 175) AS drawdown_band,
  count(*) FILTER (class = 'R' AND elevation BETWEEN 145 AND 175) AS class_in_band, count(*) FILTER (class = 'R' AND slope >= 5) AS steep_class, sum(weight) AS weight, sum(weight * elevation) AS weighted FROM pixels GROUP BY 1""")
def zonal_interactions(spark, d):
    """Zonal means and counts, and counts of conditions that hold together."""
    band = F.col("elevation").between(145, 175)
    return pixels(spark, d).groupBy("unit_id").agg(F.count("*").alias("n"), F.round(F.avg("elevation"), 6).alias("mean_elevation"), F.round(F.avg("slope"), 6).alias("mean_slope"), F.count_if(band).alias("drawdown_band"), F.count_if(band & (F.col("class") == "R")).alias("class_in_band"), F.count_if((F.col("slope") >= 5) & (F.col("class") == "R")).alias("steep_class"), F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("elevation")).alias("weighted"))


@q(f"""WITH {UNITS}, s AS (SELECT unit_id, CASE WHEN area > 50 THEN area END AS a, x, y FROM units), f AS (SELECT count(*) AS n, {", ".join(f"count({c}) AS {c}_n, avg({c}) AS {c}_mean, var_pop({c}) AS {c}_var" for c in "axy")} FROM s)
SELECT unit_id, {", ".join(f"round((coalesce({c}, {c}_mean) - {c}_mean) / CASE WHEN sqrt({c}_var * {c}_n / n) < 1e-6 THEN 1 ELSE sqrt({c}_var * {c}_n / n) END, 6) AS {c}" for c in "axy")} FROM s, f""")
def context_scaler(spark, d):
    """Columns filled with their mean and standardised by the population deviation after filling."""
    s = units(spark, d).select("unit_id", F.when(F.col("area") > 50, F.col("area")).alias("a"), "x", "y")
    return B.scale(s, B.scaler(s, ["a", "x", "y"]), ["a", "x", "y"]).withColumns({c: F.round(c, 6) for c in "axy"})


@q(f"""WITH {UNITS}, m AS (SELECT min(x) AS xl, max(x) AS xh, min(area) AS al, max(area) AS ah FROM units) SELECT unit_id, round((x - xl) / CASE WHEN xh = xl THEN 1 ELSE xh - xl END, 9) AS x, round((area - al) / CASE WHEN ah = al THEN 1 ELSE ah - al END, 9) AS area FROM units, m""")
def min_max_scaler(spark, d):
    u = units(spark, d)
    m = u.agg(*[f(c).alias(f"{c}_{n}") for c in ("x", "area") for n, f in (("l", F.min), ("h", F.max))])
    span = lambda c: F.when(F.col(f"{c}_h") == F.col(f"{c}_l"), 1.0).otherwise(F.col(f"{c}_h") - F.col(f"{c}_l"))
    return u.crossJoin(F.broadcast(m)).select("unit_id", *[F.round((F.col(c) - F.col(f"{c}_l")) / span(c), 9).alias(c) for c in ("x", "area")])


@q(f"""WITH {PIXELS}, s AS (SELECT unit_id % 5 AS fold, sum(elevation) AS s, sum(elevation * elevation) AS ss, count(*) AS n FROM pixels GROUP BY 1)
SELECT f.fold, round(sum(s.s) / sum(n), 6) AS mean, round(sqrt(greatest(sum(ss) / sum(n) - (sum(s.s) / sum(n)) ** 2, 0)), 6) AS sd FROM (SELECT DISTINCT fold FROM s) f JOIN s ON s.fold <> f.fold GROUP BY 1""")
def pixel_scaler_by_fold(spark, d):
    """Mean and deviation of the pixels outside each fold, from sums, squares and counts by fold."""
    s = pixels(spark, d).groupBy((F.col("unit_id") % 5).alias("fold")).agg(F.sum("elevation").alias("s"), F.sum(F.col("elevation") * F.col("elevation")).alias("ss"), F.count("*").alias("n"))
    o = s.select(F.col("fold").alias("outer"))
    m = F.sum("s") / F.sum("n")
    return s.join(F.broadcast(o), F.col("fold") != F.col("outer")).groupBy(F.col("outer").alias("fold")).agg(F.round(m, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.sum("ss") / F.sum("n") - m * m, F.lit(0.0))), 6).alias("sd"))


@q(f"""WITH {PIXELS}, {VALUES} SELECT unit_id, round(1 / sum(share ** 2), 6) AS effective, round(sum(share) FILTER (cum - share >= 0.9), 9) AS top_mass, round(sum(share * x), 6) AS centre FROM c GROUP BY 1""")
def attention_concentration(spark, d):
    """Effective number of values under the weights as attention, the mass of those beyond the 90 % point, and their centre."""
    v = pixels(spark, d).groupBy("unit_id", F.col("elevation").alias("x")).agg(F.sum("weight").alias("w"))
    whole = Window.partitionBy("unit_id")
    v = v.withColumns({"share": F.col("w") / F.sum("w").over(whole), "cum": F.sum("w").over(whole.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(whole)})
    return v.groupBy("unit_id").agg(F.round(1 / F.sum(F.col("share") * F.col("share")), 6).alias("effective"), F.round(F.sum(F.when(F.col("cum") - F.col("share") >= 0.9, F.col("share"))), 9).alias("top_mass"), F.round(F.sum(F.col("share") * F.col("x")), 6).alias("centre"))
