"""Queries of bins, strata, effects and association (over units and pixels)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.operators import assoc as A
from terrane.operators import binning as N
from terrane.operators import scoring as S
from terrane.plans.proxies import UNITS, units
from terrane.plans.registry import Catalog

C = Catalog()
q = C.query
LONG = "long AS (SELECT unit_id, label, fold, county, feature, value FROM (SELECT unit_id, label, fold, county, area, x, y, p FROM units) UNPIVOT (value FOR feature IN (area, x, y, p)))"


def long(spark, d, *more):
    u = units(spark, d).select("unit_id", "label", "fold", "county", "area", "x", "y", "p", *more)
    return u.unpivot(["unit_id", "label", "fold", "county", *more], ["area", "x", "y", "p"], "feature", "value")


@q(f"""WITH {UNITS}, {LONG}, long2 AS (SELECT unit_id, feature, value FROM long UNION ALL SELECT unit_id, 'zero', CASE WHEN unit_id % 3 = 0 THEN 0 ELSE x - y END FROM units UNION ALL SELECT unit_id, 'few', CASE WHEN unit_id % 11 = 0 THEN NULL ELSE unit_id % 4 END FROM units),
ctx AS (SELECT * FROM long2 WHERE unit_id % 5 <> 0 AND value IS NOT NULL),
plan AS (SELECT feature, count(DISTINCT value) AS levels, avg(CAST(value = 0 AS DOUBLE)) AS zeros, list_sort(list_distinct(quantile_cont(value, [0.2, 0.4, 0.6, 0.8]))) AS fifths,
  quantile_cont(value, [1/3::DOUBLE, 2/3::DOUBLE]) FILTER (value > 0) AS up, quantile_cont(value, [1/3::DOUBLE, 2/3::DOUBLE]) FILTER (value < 0) AS down, list_sort(list_distinct(list(value))) AS vals FROM ctx GROUP BY 1),
b AS (SELECT l.feature, CASE WHEN value IS NULL THEN -1 WHEN levels <= 8 THEN coalesce(list_position(vals, value) - 1, len(vals))
  WHEN zeros >= 0.2 THEN CASE WHEN value = 0 THEN 3 WHEN value > 0 THEN 4 + len(list_filter(up, lambda e: e <= value)) ELSE len(list_filter(coalesce(down, []), lambda e: e <= value)) END
  ELSE len(list_filter(fifths, lambda e: e <= value)) END AS bin FROM long2 l JOIN plan USING (feature))
SELECT feature, CAST(bin AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY 1, 2""")
def adaptive_bins(spark, d):
    u = units(spark, d)
    zero = u.select("unit_id", F.lit("zero").alias("feature"), F.when(F.col("unit_id") % 3 == 0, 0.0).otherwise(F.col("x") - F.col("y")).alias("value"))
    few = u.select("unit_id", F.lit("few").alias("feature"), F.when(F.col("unit_id") % 11 != 0, (F.col("unit_id") % 4).cast("double")).alias("value"))
    rows = long(spark, d).select("unit_id", "feature", "value").unionByName(zero).unionByName(few)
    plan = N.adaptive_plan(rows.where("unit_id % 5 <> 0"), "feature", "value")
    return N.adaptive_bins(rows, plan, "feature", "value").groupBy("feature", "bin").agg(F.count("*").alias("n"))


@q(f"""WITH {UNITS}, e AS (SELECT list_sort(list_distinct(quantile_cont(x, [1/3::DOUBLE, 2/3::DOUBLE]))) AS a, list_sort(list_distinct(quantile_cont(y, [1/3::DOUBLE, 2/3::DOUBLE]))) AS b FROM units WHERE fold <> 0)
SELECT unit_id, CAST(len(list_filter(a, lambda z: z <= x)) * 3 + len(list_filter(b, lambda z: z <= y)) AS INTEGER) AS stratum FROM units, e""")
def terrain_terciles(spark, d):
    u = units(spark, d)
    return N.tercile_strata(u, u.where("fold <> 0"), ("x", "y")).select("unit_id", "stratum")


@q(f"""WITH {UNITS}, d AS (SELECT region, CAST(floor(x / 60) AS INTEGER) AS bin, y - x AS delta FROM units), b AS (SELECT region, bin, avg(delta) AS mean, count(*) AS n FROM d GROUP BY 1, 2),
c AS (SELECT *, bin - row_number() OVER (PARTITION BY region ORDER BY bin) AS component FROM b), m AS (SELECT *, sum(mean) OVER (PARTITION BY region, component ORDER BY bin ROWS UNBOUNDED PRECEDING) - mean / 2 AS mid FROM c)
SELECT region, bin, n, round(mean, 6) AS mean, component, round(mid - sum(mid * n) OVER (PARTITION BY region, component) / sum(n) OVER (PARTITION BY region, component), 6) AS effect FROM m""")
def ale_curve(spark, d):
    rows = units(spark, d).select("region", F.floor(F.col("x") / 60).cast("int").alias("bin"), (F.col("y") - F.col("x")).alias("delta"))
    out = N.ale(rows, ["region"])
    return out.withColumns({"mean": F.round("mean", 6), "effect": F.round("effect", 6), "component": F.col("component").cast("long")})


@q(f"""WITH {UNITS}, e AS (SELECT list_sort(list_distinct(quantile_cont(y, [0.2, 0.4, 0.6, 0.8]))) AS edges FROM units) SELECT 1 + len(list_filter(edges, lambda z: z <= y)) AS level, count(*) AS n, min(y) AS low, max(y) AS high FROM units, e GROUP BY 1""")
def quantile_grades(spark, d):
    g = N.break_grades(units(spark, d), "quantile", "y", 5)
    return g.groupBy(F.col("level").cast("long").alias("level")).agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"))


#: The least cost of k classes of the first values, from that of k - 1 and one class more.
CLASSES = ", ".join(f"d{k} AS (SELECT c.region, c.hi, min({{'cost': d.m.cost + c.cost, 'ends': list_append(d.m.ends, c.hi)}}) AS m FROM d{k - 1} d JOIN c ON c.region = d.region AND c.lo = d.hi + 1 GROUP BY 1, 2)" for k in range(2, 6))


@q(f"""WITH {UNITS}, s AS (SELECT region, p, n, row_number() OVER o AS i, sum(n) OVER o AS w, sum(n * p) OVER o AS s, sum(n * p * p) OVER o AS q FROM (SELECT region, p, count(*) AS n FROM units GROUP BY 1, 2) WINDOW o AS (PARTITION BY region ORDER BY p)),
z AS (SELECT region, i, w, s, q FROM s UNION ALL SELECT DISTINCT region, 0, 0, 0, 0 FROM s),
c AS (SELECT b.region, a.i + 1 AS lo, b.i AS hi, b.q - a.q - (b.s - a.s) * (b.s - a.s) / (b.w - a.w) AS cost FROM s b JOIN z a ON a.region = b.region AND a.i < b.i),
d1 AS (SELECT region, hi, {{'cost': cost, 'ends': [hi]}} AS m FROM c WHERE lo = 1), {CLASSES},
best AS (SELECT region, max_by(m, hi).ends AS ends FROM d5 GROUP BY 1)
SELECT region, CAST(1 + len(list_filter(ends, lambda e: e < i)) AS INTEGER) AS level, CAST(sum(n) AS BIGINT) AS n, min(p) AS low, max(p) AS high FROM s JOIN best USING (region) GROUP BY 1, 2""")
def natural_break_grades(spark, d):
    """Natural breaks of each region's scores, and the units of each class."""
    u = units(spark, d)
    g = N.graded_by_breaks(u, N.breaks_by_group(u, "region", "p", 5), "region", "p")
    return g.groupBy("region", "level").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))


@q(f"""WITH {UNITS} SELECT CASE WHEN y < 100 THEN 0 WHEN y < 200 THEN 1 WHEN y < 300 THEN 2 ELSE 3 END AS elevation_band, CASE WHEN area <= 50 THEN 0 WHEN area <= 100 THEN 1 WHEN area <= 200 THEN 2 ELSE 3 END AS size_band, count(*) AS n FROM units GROUP BY 1, 2""")
def banding(spark, d):
    """Left-closed bands of one column and right-closed bands of another."""
    u = units(spark, d)
    return u.groupBy(N.band(F.col("y"), [100, 200, 300]).alias("elevation_band"), N.band(F.col("area"), [50, 100, 200], right=True).alias("size_band")).agg(F.count("*").alias("n"))


@q(f"""WITH {UNITS}, {LONG}, e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [{", ".join(str(i / 10) for i in range(1, 10))}]))) AS edges FROM long GROUP BY 1)
SELECT l.feature, CAST(len(list_filter(edges, lambda z: z <= value)) AS INTEGER) AS bin, count(*) AS n, round(avg(label), 9) AS fraction FROM long l JOIN e ON e.feature = l.feature GROUP BY 1, 2""")
def decile_association(spark, d):
    rows = long(spark, d)
    e = N.edges(rows, ["feature"], "value", [i / 10 for i in range(1, 10)])
    return rows.join(F.broadcast(e), "feature").groupBy("feature", N.above(F.col("edges"), F.col("value")).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("label"), 9).alias("fraction"))


@q(f"""WITH {UNITS}, {LONG}, c AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.2, 0.4, 0.6, 0.8]))) AS edges FROM long WHERE fold <> 0 GROUP BY 1)
SELECT l.feature, CAST(CASE WHEN value > 400 THEN -1 ELSE len(list_filter(edges, lambda z: z <= value)) END AS INTEGER) AS bin, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM long l JOIN c ON c.feature = l.feature WHERE fold = 0 GROUP BY 1, 2""")
def context_quintile_bins(spark, d):
    rows = long(spark, d)
    e = N.edges(rows.where("fold <> 0"), ["feature"], "value", [0.2, 0.4, 0.6, 0.8])
    bin_ = F.when(F.col("value") > 400, -1).otherwise(N.above(F.col("edges"), F.col("value")))
    return rows.where("fold = 0").join(F.broadcast(e), "feature").groupBy("feature", bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


@q(f"""WITH {UNITS}, s AS (SELECT region, CAST(floor(area / 50) AS BIGINT) AS bin, label FROM units), labels AS (SELECT DISTINCT bin FROM s UNION SELECT 99), k AS (SELECT count(*) AS bins FROM labels),
t AS (SELECT region, count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM s GROUP BY 1), c AS (SELECT region, bin, count(*) AS units, CAST(sum(label) AS BIGINT) AS positives FROM s GROUP BY 1, 2),
g AS (SELECT t.region, l.bin, n, p, bins, coalesce(units, 0) AS units, coalesce(positives, 0) AS positives FROM t CROSS JOIN k CROSS JOIN labels l LEFT JOIN c ON c.bin = l.bin AND c.region = t.region)
SELECT region, bin, units, positives, round(CASE WHEN units > 0 THEN (positives / units::DOUBLE) / (p / n::DOUBLE) END, 9) AS fr, round(CASE WHEN positives > 0 THEN ln((positives / units::DOUBLE) / (p / n::DOUBLE)) END, 9) AS iv,
  round(CASE WHEN units > 0 THEN ln(((positives + 0.5::DOUBLE) / (p + 0.5::DOUBLE * bins)) / ((units - positives + 0.5::DOUBLE) / (n - p + 0.5::DOUBLE * bins))) END, 9) AS smooth,
  CASE WHEN units = 0 THEN 'empty' WHEN positives = 0 THEN 'no positives' ELSE 'ok' END AS status, units < 30 OR positives < 5 OR units - positives < 5 AS low_support FROM g""")
def information_value(spark, d):
    s = units(spark, d).select("region", F.floor(F.col("area") / 50).alias("bin"), "label")
    labels = s.select("bin").distinct().unionByName(spark.createDataFrame([(99,)], "bin long"))
    out = A.information_value(s, ["region"], "bin", labels)
    return out.withColumns({c: F.round(c, 9) for c in ("fr", "iv", "smooth")})


RANKS = """gappy AS (SELECT * FROM long WHERE unit_id % 7 <> 0 OR feature <> 'p'),
pairs AS (SELECT l.unit_id, l.feature AS a, r.feature AS b, l.value AS x, r.value AS y FROM gappy l JOIN gappy r ON l.unit_id = r.unit_id AND l.feature < r.feature),
ranks AS (SELECT a, b, x, y, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2::DOUBLE AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2::DOUBLE AS ry FROM pairs)"""


def gappy(spark, d):
    return long(spark, d).withColumn("value", F.when((F.col("unit_id") % 7 != 0) | (F.col("feature") != "p"), F.col("value")))


@q(f"WITH {UNITS}, {LONG}, {RANKS} SELECT a, b, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM ranks GROUP BY 1, 2")
def spearman_pairs(spark, d):
    return A.spearman(gappy(spark, d), "unit_id").withColumn("rho", F.round("rho", 6))


@q(f"""WITH {UNITS}, {LONG}, pairs AS (SELECT l.feature AS a, r.feature AS b, corr(l.value, r.value) AS r FROM long l JOIN long r ON l.unit_id = r.unit_id AND l.feature < r.feature GROUP BY 1, 2),
both_ways AS (SELECT a, b, r FROM pairs UNION ALL SELECT b, a, r FROM pairs)
SELECT a AS feature, round(avg(abs(r)), 6) AS mean_abs, max_by(b, abs(r)) AS partner, count(*) FILTER (abs(r) >= 0.8) AS high FROM both_ways GROUP BY 1""")
def pearson_redundancy(spark, d):
    p = A.pearson(long(spark, d), "unit_id")
    both = p.select("a", "b", "r").unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    return both.groupBy(F.col("a").alias("feature")).agg(F.round(F.avg(F.abs("r")), 6).alias("mean_abs"), F.max_by("b", F.abs(F.col("r"))).alias("partner"), F.count_if(F.abs("r") >= 0.8).alias("high"))


@q(f"""WITH {UNITS}, f AS (SELECT DISTINCT fold AS o FROM units), {LONG}, pairs AS (SELECT l.fold, l.unit_id, l.feature AS a, r.feature AS b, l.value AS x, r.value AS y FROM long l JOIN long r ON l.unit_id = r.unit_id AND (l.feature, r.feature) IN (('area', 'y'), ('x', 'y'), ('p', 'x'))),
r AS (SELECT o, a, b, rank() OVER (PARTITION BY o, a, b ORDER BY x) + (count(*) OVER (PARTITION BY o, a, b, x) - 1) / 2::DOUBLE AS rx, rank() OVER (PARTITION BY o, a, b ORDER BY y) + (count(*) OVER (PARTITION BY o, a, b, y) - 1) / 2::DOUBLE AS ry FROM pairs JOIN f ON o <> fold)
SELECT o AS "outer", a, b, count(*) AS n, round(corr(rx, ry), 6) AS rho, abs(corr(rx, ry)) > 0.9 AS drop_b FROM r GROUP BY 1, 2, 3""")
def correlation_screen(spark, d):
    """Rank correlation of listed pairs over the training folds of each outer fold; a pair beyond 0.9 drops its second feature."""
    rows = long(spark, d)
    listed = spark.createDataFrame([("area", "y"), ("x", "y"), ("p", "x")], "a string, b string")
    p = A.feature_pairs(rows, "unit_id").join(F.broadcast(listed), ["a", "b"]).join(rows.select("unit_id", "fold").distinct(), "unit_id")
    outer = rows.select(F.col("fold").alias("outer")).distinct()
    p = p.join(F.broadcast(outer), F.col("fold") != F.col("outer"))
    by = ["outer", "a", "b"]
    r = A.average_rank(A.average_rank(p, by, "x", "rx"), by, "y", "ry")
    g = r.groupBy(*by).agg(F.count("*").alias("n"), A.correlation("rx", "ry", 3).alias("rho"))
    return g.select(*by, "n", F.round("rho", 6).alias("rho"), (F.abs("rho") > 0.9).alias("drop_b"))


@q(f"""WITH {UNITS}, s AS (SELECT region, county, CAST(floor(x / 200) AS INTEGER) AS sx, area > 150 AS exposed, label FROM units),
t AS (SELECT region, county, sx, count(*) FILTER (exposed AND label = 1) AS a, count(*) FILTER (exposed AND label = 0) AS b, count(*) FILTER (NOT exposed AND label = 1) AS c, count(*) FILTER (NOT exposed AND label = 0) AS d, count(*)::DOUBLE AS n FROM s GROUP BY 1, 2, 3),
g AS (SELECT region, count(*) AS strata, sum(a * d / n) AS r, sum(b * c / n) AS s, sum((a + d) / n * (a * d / n)) AS pr, sum((a + d) / n * (b * c / n) + (b + c) / n * (a * d / n)) AS ps, sum((b + c) / n * (b * c / n)) AS qs FROM t WHERE n >= 8 AND a + b > 0 AND c + d > 0 GROUP BY 1),
z AS (SELECT *, ln(r / s) AS l, sqrt(pr / (2 * r * r) + ps / (2 * r * s) + qs / (2 * s * s)) AS se FROM g)
SELECT region, strata, round(exp(l), 6) AS odds_ratio, round(exp(l - 1.959963984540054::DOUBLE * se), 6) AS low, round(exp(l + 1.959963984540054::DOUBLE * se), 6) AS high FROM z""")
def mh_odds_ratio(spark, d):
    s = units(spark, d).select("region", "county", F.floor(F.col("x") / 200).cast("int").alias("sx"), (F.col("area") > 150).alias("exposed"), "label")
    return A.mantel_haenszel(s, ["region"], ["county", "sx"]).withColumns({c: F.round(c, 6) for c in ("odds_ratio", "low", "high")})


@q(f"""WITH {UNITS}, g AS (SELECT region, CAST(floor(area / 60) AS INTEGER) AS s, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS k FROM units GROUP BY 1, 2), t AS (SELECT region, sum(n) AS n, sum(k) AS k, sum(s * k) AS sk, sum(s * n) AS sn, sum(s * s * n) AS ssn FROM g GROUP BY 1)
SELECT region, round((sk - k / n * sn) / sqrt(k / n * (1 - k / n) * (ssn - sn * sn / n)), 6) AS z FROM t""")
def trend_z(spark, d):
    u = units(spark, d).withColumn("s", F.floor(F.col("area") / 60).cast("int"))
    return A.trend(u, ["region"], "s").withColumn("z", F.round("z", 6))


@q(f"""WITH {UNITS}, {LONG} SELECT feature, round((avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0)) / sqrt((var_pop(value) FILTER (label = 1) + var_pop(value) FILTER (label = 0)) / 2 + 1e-12), 6) AS smd FROM long GROUP BY 1""")
def smd_table(spark, d):
    return A.standardised_difference(long(spark, d), ["feature"]).withColumn("smd", F.round("smd", 6))


@q(f"""WITH {UNITS}, {LONG}, c AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, [0.01, 0.99]) AS q FROM long WHERE fold <> 0 GROUP BY 1)
SELECT l.feature, round((avg(value) - max(m)) / max(sd), 6) AS shift, round(avg(CAST(value < q[1] OR value > q[2] AS DOUBLE)), 9) AS outside FROM long l JOIN c ON c.feature = l.feature WHERE fold = 0 GROUP BY 1""")
def shift_outside_p01_p99(spark, d):
    rows = long(spark, d)
    out = A.shift(rows.where("fold <> 0"), rows.where("fold = 0"), ["feature"])
    return out.select("feature", F.round("shift", 6).alias("shift"), F.round("outside", 9).alias("outside"))


@q(f"""WITH {UNITS}, c AS (SELECT priority, count(*) AS n, CAST(sum(label) AS BIGINT) AS k, sum(area) AS area FROM units GROUP BY 1), t AS (SELECT *, sum(n) OVER () - n AS rn, sum(k) OVER () - k AS rk, k / n::DOUBLE AS p FROM c), z AS (SELECT 1.959963984540054::DOUBLE AS z)
SELECT priority, n, k, p AS rate, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high,
  round(p / (rk / rn::DOUBLE), 9) AS relative_risk, round(100 * k / area, 9) AS density FROM t, z WHERE n >= 20""")
def wilson_rr(spark, d):
    return A.category_risk(units(spark, d), "priority").withColumns({c: F.round(c, 9) for c in ("low", "high", "relative_risk", "density")})


@q(f"""WITH {UNITS}, {LONG}, g AS (SELECT feature, county, count(*) AS n, sum(value) AS s, sum(value * value) AS ss FROM long GROUP BY 1, 2) SELECT feature, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(ss) - sum(s) * sum(s) / sum(n)), 6) AS eta2 FROM g GROUP BY 1""")
def eta_squared(spark, d):
    return A.eta_squared(long(spark, d), "county", ["feature"]).withColumn("eta2", F.round("eta2", 6))


@q(f"""WITH {UNITS}, {LONG}, r AS (SELECT feature, county, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2::DOUBLE AS rk, count(*) OVER (PARTITION BY feature, value)::DOUBLE AS t FROM long),
g AS (SELECT feature, county, sum(rk) AS r, count(*)::DOUBLE AS n, sum(t * t - 1) AS ties FROM r GROUP BY 1, 2), t AS (SELECT feature, sum(r * r / n) AS rr, sum(n) AS n, sum(ties) AS ties, count(*) AS groups FROM g GROUP BY 1)
SELECT feature, groups, round((12 / (n * (n + 1)) * rr - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h FROM t""")
def kruskal_h(spark, d):
    return A.kruskal(long(spark, d), "county", ["feature"]).withColumn("h", F.round("h", 4))


@q(f"""WITH {UNITS}, {LONG}, r AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2::DOUBLE AS rk FROM long),
t AS (SELECT feature, sum(rk) FILTER (label = 1) - sum(label)::DOUBLE * (sum(label) + 1) / 2 AS u, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM r GROUP BY 1)
SELECT feature, u, round((u - p * n / 2) / sqrt(p * n * (p + n + 1) / 12), 6) AS z FROM t""")
def mann_whitney_u(spark, d):
    return A.mann_whitney(long(spark, d), ["feature"]).withColumn("z", F.round("z", 6))


@q(f"""WITH {UNITS} SELECT region, round(regr_slope(y, area), 6) AS slope, round(regr_intercept(y, area), 6) AS intercept, round(regr_r2(y, area), 6) AS r2, round(regr_slope(ln(y + 1), ln(area)), 6) AS power FROM units GROUP BY 1""")
def linear_power_fit(spark, d):
    y, x = F.col("y"), F.col("area")
    return units(spark, d).groupBy("region").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.round(F.regr_slope(F.log(y + 1), F.log(x)), 6).alias("power"))


@q(f"""WITH {UNITS}, {LONG}, s AS (SELECT feature, value AS p, sum(label) AS pos, count(*) - sum(label) AS neg FROM long GROUP BY 1, 2), k AS (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY p) - neg AS below FROM s),
a AS (SELECT feature, abs(sum(pos * (below + neg * 0.5::DOUBLE)) / CAST(sum(pos) * sum(neg) AS DOUBLE) - 0.5) AS strength FROM k GROUP BY 1)
SELECT feature, round(strength, 9) AS strength FROM a WHERE feature <> CASE WHEN (SELECT strength FROM a WHERE feature = 'area') >= (SELECT strength FROM a WHERE feature = 'y') THEN 'y' ELSE 'area' END""")
def redundancy_pruning(spark, d):
    """Features by strength, without those that correlate beyond 0.9 with a stronger one (area and y do here)."""
    rows = long(spark, d)
    a = S.auc(rows.withColumnRenamed("value", "p"), ["feature"]).select("feature", F.abs(F.col("auc") - 0.5).alias("strength"))
    pairs = {(r.a, r.b): r.rho or 0.0 for r in A.spearman(rows, "unit_id").collect()}  # one row for each pair of columns
    kept = A.prune_redundant([(r.feature, r.strength) for r in a.collect()], pairs, 0.9)
    return a.where(F.col("feature").isin(kept)).withColumn("strength", F.round("strength", 9))


@q(f"""WITH {UNITS}, s AS (SELECT concat_ws('|', region, CAST(floor(area / 100) AS BIGINT)) AS stratum, CAST(floor(p * 5) AS BIGINT) AS bin, label, p, fold, area FROM units),
f AS (SELECT stratum, bin, fold, count(*) AS units, CAST(sum(label) AS BIGINT) AS positives, sum(p) AS score_sum, min(area) AS low, max(area) AS high FROM s GROUP BY 1, 2, 3)
SELECT stratum, bin, CAST(sum(units) AS BIGINT) AS units, CAST(sum(positives) AS BIGINT) AS positives, round(sum(score_sum) / sum(units), 9) AS mean_score, min(low) AS low, max(high) AS high, count(DISTINCT fold) AS folds, sum(units) < 30 OR sum(positives) < 5 OR sum(units) - sum(positives) < 5 AS low_support FROM f GROUP BY 1, 2""")
def stratum_bin_profile(spark, d):
    """Profile of bins in strata, from sums of each fold."""
    s = units(spark, d).select(F.concat_ws("|", "region", F.floor(F.col("area") / 100).cast("string")).alias("stratum"), F.floor(F.col("p") * 5).alias("bin"), "label", "p", "fold", "area")
    f = s.groupBy("stratum", "bin", "fold").agg(F.count("*").alias("units"), F.sum("label").alias("positives"), F.sum("p").alias("score_sum"), F.min("area").alias("low"), F.max("area").alias("high"))
    n, k = F.sum("units"), F.sum("positives")
    return f.groupBy("stratum", "bin").agg(n.alias("units"), k.alias("positives"), F.round(F.sum("score_sum") / n, 9).alias("mean_score"), F.min("low").alias("low"), F.max("high").alias("high"), F.count_distinct("fold").alias("folds"), ((n < 30) | (k < 5) | (n - k < 5)).alias("low_support"))
