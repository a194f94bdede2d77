"""Queries of the model's columns and controls, supplements, support, clipped coverage, learned colours and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import scalars as L
from terrane.operators import assoc as A
from terrane.operators import modelling as M
from terrane.operators import sampling as S
from terrane.operators import schema as D
from terrane.operators import spatial as P
from terrane.operators import zonal as Z
from terrane.operators.scoring import auc
from terrane.plans.associations import LONG, long
from terrane.plans.proxies import PIXELS, UNITS, pixels, read, units
from terrane.plans.registry import Catalog
from terrane.plans.scores import AUC_BY
from terrane.plans.spaces import DIST, KNN, POINTS, points
from terrane.plans.zones import RECTS, zones
from terrane.session import cut
from terrane.sources import tables

C = Catalog()
q = C.query


def quoted(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


DICTIONARY = f"""named AS (SELECT unnest({quoted([*D.TABLE, *D.AVAILABILITY])}) AS feature, unnest(range(40)) AS col),
grouped AS ({' UNION ALL '.join(f"SELECT '{g}' AS factor_group, unnest({quoted(n)}) AS feature" for g, n in D.GROUPS.items())}),
summary AS (SELECT 40 + 8 * s + c AS col, ({quoted(D.STATISTICS)})[s + 1] || '_' || ({quoted(D.CHANNELS)})[c + 1] AS feature, CASE WHEN c < 4 THEN 'terrain' ELSE 'water' END AS factor_group, CASE WHEN s = 0 THEN 'means8' ELSE 'distribution32' END AS representation FROM range(5) a(s), range(8) b(c)),
dictionary AS (SELECT CAST(col AS INTEGER) AS "column", feature, factor_group, CASE WHEN col < 38 THEN 'table38' ELSE 'availability2' END AS representation FROM named JOIN grouped USING (feature)
  UNION ALL SELECT CAST(col AS INTEGER), feature, factor_group, representation FROM summary
  UNION ALL SELECT CAST(80 + k AS INTEGER), ({quoted(D.JOINT)})[k + 1], 'water_terrain_joint', 'joint4' FROM range(4) j(k))"""


@q(f"WITH {DICTIONARY} SELECT * FROM dictionary")
def pixel_feature_dictionary(spark, d):
    """Every column of the model with its group and representation."""
    return D.feature_dictionary(spark)


@q(f"""WITH {DICTIONARY}, arms(arm, n) AS (VALUES ('table40', 40), ('means48', 48), ('distribution80', 80), ('stats84', 84)) SELECT arm, factor_group, count(*) AS columns FROM arms JOIN dictionary ON "column" < n GROUP BY 1, 2""")
def column_arms(spark, d):
    """Columns of each group that each nested arm holds."""
    arms = spark.createDataFrame([(a, c) for a in D.ARMS for c in D.arm_columns(a)], "arm string, feature string")
    return arms.join(F.broadcast(D.feature_dictionary(spark)), "feature").groupBy("arm", "factor_group").agg(F.count("*").alias("columns"))


@q(f"""WITH {UNITS}, {DICTIONARY}, m AS (SELECT CAST(unit_id % 84 AS INTEGER) AS "column", fold, avg(p) AS delta FROM units GROUP BY 1, 2), e AS (SELECT "column", avg(delta) AS mean, min(delta) AS low, max(delta) AS high FROM m GROUP BY 1)
SELECT "column", feature, factor_group, representation, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM e JOIN dictionary USING ("column")""")
def contributions_by_dictionary(spark, d):
    """A measure of each column over folds, joined many to one with the dictionary."""
    names = D.feature_dictionary(spark)
    m = units(spark, d).groupBy((F.col("unit_id") % 84).cast("int").alias("column"), "fold").agg(F.avg("p").alias("delta"))
    m = m.join(F.broadcast(names.select("column", "feature")), "column")
    e = D.with_dictionary(m, names).groupBy("column", "feature", "factor_group", "representation").agg(*[F.round(f("delta"), 6).alias(n) for f, n in ((F.avg, "mean"), (F.min, "low"), (F.max, "high"))])
    return e


@q("""SELECT name, mode, CAST(ratio AS VARCHAR) AS ratio, CAST(estimators AS INTEGER) AS estimators, balanced, CAST(size AS INTEGER) AS size FROM (VALUES ('baseline', 'baseline', NULL, 2, false, NULL), ('balanced', 'balanced', NULL, 2, true, NULL), ('ensemble_control', 'ensemble_control', NULL, 8, false, NULL),
('subsample_p1_n1', 'subsample', '1:1', 8, false, NULL), ('subsample_p1_n4', 'subsample', '1:4', 8, false, NULL), ('balanced_subsample_p1_n1', 'balanced_subsample', '1:1', 8, true, NULL), ('balanced_subsample_p1_n4', 'balanced_subsample', '1:4', 8, true, NULL)) t(name, mode, ratio, estimators, balanced, size)""")
def mode_matrix(spark, d):
    return D.mode_matrix(spark, ["baseline", "balanced", "ensemble_control", "subsample", "balanced_subsample"], ["1:1", "1:4"], 8, 3000)


NOISE = "(CAST('0x' || substr(sha256('{part}|5|{i}|' || unit_id), 1, 8) AS UBIGINT)::DOUBLE + 1) / 4294967297.0::DOUBLE"


def gauss(i: int) -> str:
    return f"round(sqrt(-2 * ln({NOISE.format(part='radius', i=i)})) * cos({NOISE.format(part='angle', i=i)} * 6.283185307179586::DOUBLE), 6) AS gz{i}"


@q(f"""WITH {UNITS}, t AS (SELECT *, row_number() OVER (ORDER BY unit_id) AS place, row_number() OVER (ORDER BY sha256('permute|6|' || unit_id), unit_id) AS turn FROM units)
SELECT a.unit_id, b.area, {gauss(1).replace('unit_id', 'a.unit_id')}, {gauss(2).replace('unit_id', 'a.unit_id')} FROM t a JOIN t b ON a.place = b.turn""")
def noise_controls(spark, d):
    """A shuffled column and two of Gaussian noise, as controls."""
    u = S.permuted(units(spark, d).select("unit_id", "area"), "unit_id", ["area"], 6)
    g = D.gaussian_columns(u, "unit_id", 2, 5)
    return g.select("unit_id", "area", *[F.round(c, 6).alias(c) for c in ("gz1", "gz2")])


@q(f"WITH {PIXELS} SELECT unit_id, elevation FROM pixels WHERE elevation IS NOT NULL AND isfinite(elevation)")
def elevation_pairs(spark, d):
    """Unit and elevation of every pixel that has one."""
    return pixels(spark, d).select("unit_id", "elevation").where(F.col("elevation").isNotNull() & ~F.isnan("elevation") & (F.abs("elevation") < float("inf")))


SPEARMAN = """pr AS (SELECT l.feature AS a, r.feature AS b, l.value AS x, r.value AS y FROM long l JOIN long r ON l.unit_id = r.unit_id AND l.feature < r.feature),
rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE AS ry FROM pr)"""


@q(f"WITH {UNITS}, {LONG}, {SPEARMAN} SELECT a, b, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM rk GROUP BY 1, 2 HAVING abs(corr(rx, ry)) >= 0.9")
def strong_pairs(spark, d):
    """Pairs of features that rank units nearly alike."""
    return A.strong_pairs(A.spearman(long(spark, d), "unit_id")).withColumn("rho", F.round("rho", 6))


@q(f"""WITH {UNITS}, s AS (SELECT county, x - y AS diff FROM units WHERE x <> y), r AS (SELECT county, diff, rank() OVER (PARTITION BY county ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY county, abs(diff)) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY county, abs(diff)) AS t FROM s),
t AS (SELECT county, count(*) AS n, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END) AS w, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY 1)
SELECT county, n, w, round((w - n * (n + 1) / 4.0::DOUBLE) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM t""")
def wilcoxon_signed_rank(spark, d):
    """Whether one coordinate exceeds the other, by signed ranks in each county."""
    return A.wilcoxon(units(spark, d).select("county", (F.col("x") - F.col("y")).alias("diff")), ["county"]).withColumn("z", F.round("z", 6))


@q(f"""WITH {UNITS}, m AS (SELECT unit_id AS control_id FROM units WHERE label = 0 AND unit_id % 3 = 0), n AS (SELECT CAST(round(0.1::DOUBLE * 2 * sum(label)) AS BIGINT) AS size FROM units),
r AS (SELECT unit_id AS control_id, row_number() OVER (ORDER BY sha256('far|4|' || unit_id), unit_id) AS k FROM units WHERE label = 0 AND unit_id NOT IN (SELECT control_id FROM m)) SELECT control_id FROM r, n WHERE k <= size""")
def far_negatives(spark, d):
    """A fifth as many further negatives as there are positives, from anywhere."""
    u = units(spark, d)
    matched = u.where("label = 0 AND unit_id % 3 = 0").select(F.col("unit_id").alias("control_id"))
    return S.far_supplement(u.select("unit_id", "label"), matched, F.round(F.lit(0.1) * 2 * F.col("positives")).cast("long"), 4)


@q(f"""WITH {UNITS}, m AS (SELECT a.fold, a.unit_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS dist FROM units a JOIN units b ON a.fold <> b.fold AND b.label = 1 GROUP BY 1, 2)
SELECT fold, count(*) AS n, round(quantile_cont(dist, 0.5), 6) AS median_positive, round(avg(CAST(dist < 6 AS DOUBLE)), 9) AS within FROM m GROUP BY 1""")
def support_profile(spark, d):
    """How near the positives of the other folds are."""
    u = units(spark, d).select(F.col("unit_id").alias("id"), "x", "y", "label", "fold")
    return P.support_profile(u, 6.0).select("fold", "n", F.round("median_positive", 6).alias("median_positive"), F.round("within", 9).alias("within"))


@q(f"""WITH {UNITS}, {POINTS}, {KNN}, nb AS (SELECT k.a_id AS id, round(avg(b.label - b.p) FILTER (floor(a.x / 30) <> floor(b.x / 30) OR floor(a.y / 30) <> floor(b.y / 30)), 6) AS r FROM knn k JOIN pts a ON a.id = k.a_id JOIN pts b ON b.id = k.b_id GROUP BY 1),
al(alpha) AS (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (1.0::DOUBLE), (4.0::DOUBLE)),
s AS (SELECT CAST(CAST('0x' || substr(sha256('block|' || CAST(floor(x / 30) AS BIGINT) || '|' || CAST(floor(y / 30) AS BIGINT)), 1, 8) AS UBIGINT) % 5 AS INTEGER) AS fold, label, alpha,
  round(ln(least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) / (1 - least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE))) + alpha * coalesce(r, 0), 9) AS p FROM pts LEFT JOIN nb USING (id), al),
tr AS (SELECT f.fold AS outer_fold, s.alpha, s.label, s.p FROM s JOIN (SELECT DISTINCT fold FROM s) f ON f.fold <> s.fold WHERE alpha > 0),
{AUC_BY.format(by='outer_fold, alpha', rows='tr')},
b AS (SELECT outer_fold AS fold, alpha, row_number() OVER (PARTITION BY outer_fold ORDER BY round(auc, 12) DESC, alpha) AS k FROM aucs),
{AUC_BY.format(by='fold, alpha', rows='s').replace('scored', 'scored2').replace('ranked', 'ranked2').replace('aucs', 'aucs2')}
SELECT t.fold, t.alpha, round(t.auc, 9) AS auc, round(o.auc, 9) AS plain FROM aucs2 t JOIN b ON b.fold = t.fold AND b.alpha = t.alpha AND b.k = 1 JOIN aucs2 o ON o.fold = t.fold AND o.alpha = 0""")
def residual_alpha(spark, d):
    """Weight of the residuals of neighbours in other blocks, chosen by folds of whole blocks."""
    p = points(spark, d).withColumns({"bx": F.floor(F.col("x") / 30), "by": F.floor(F.col("y") / 30)})
    near = P.nearest(p, p, 8)
    own = p.select(F.col("id").alias("a_id"), F.col("bx").alias("ax"), F.col("by").alias("ay"))
    other = p.select(F.col("id").alias("b_id"), "bx", "by", (F.col("label") - F.col("p")).alias("r"))
    r = near.join(own, "a_id").join(other, "b_id").where("ax <> bx OR ay <> by").groupBy(F.col("a_id").alias("id")).agg(F.round(F.avg("r"), 6).alias("r"))
    fold = (F.conv(F.substring(S.token("block", F.col("bx"), F.col("by")), 1, 8), 16, 10).cast("long") % 5).cast("int")
    scored = p.join(r, "id", "left").withColumn("fold", fold)
    out = M.residual_alpha(scored, "p", "r", [0.25, 1.0, 4.0], "fold")
    return out.select("fold", "alpha", F.round("auc", 9).alias("auc"), F.round("plain", 9).alias("plain"))


@q("""WITH t AS (SELECT *, year(CAST(o_orderdate AS DATE)) AS year, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS at_place FROM orders WHERE year(CAST(o_orderdate AS DATE)) BETWEEN 1993 AND 1996)
SELECT CAST(year AS INTEGER) AS year, count(*) AS n, count(*) FILTER (at_place > 1) AS repeated, CAST(0 AS BIGINT) AS unreadable FROM t GROUP BY 1""")
def event_point_years(spark, d):
    """Dated points by year, and how many of them share their place."""
    raw = read(spark, d, "orders").select(F.col("o_orderdate").cast("string").alias("date"), F.col("o_custkey").alias("lon"), F.col("o_orderpriority").alias("lat"))
    raw = raw.withColumn("date", F.substring("date", 1, 10))
    return tables.event_points(raw, "date", "lon", "lat", 1993, 1996)[1]


@q(f"""WITH {UNITS}, px AS (SELECT l_orderkey AS unit_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS slope, l_quantity - 2 AS weight FROM lineitem WHERE l_orderkey % 10 <> 3), u AS (SELECT unit_id FROM units WHERE area > 20),
j AS (SELECT px.*, u.unit_id AS known FROM px LEFT JOIN u USING (unit_id))
SELECT count(*) AS n, count(*) FILTER (slope IS NULL) AS bad_value, count(*) FILTER (NOT weight > 0) AS bad_weight, count(*) FILTER (known IS NULL) AS unknown_unit, (SELECT count(*) FROM u WHERE unit_id NOT IN (SELECT unit_id FROM px)) AS empty_units FROM j""")
def ragged_audit(spark, d):
    """What is wrong with pixels against the units that they should belong to, with faults made on purpose."""
    px = read(spark, d, "lineitem").where("l_orderkey % 10 <> 3").select(F.col("l_orderkey").alias("unit_id"), F.when(F.col("l_linenumber") != 7, F.col("l_tax").cast("double")).alias("slope"), (F.col("l_quantity").cast("double") - 2).alias("weight"))
    return tables.ragged_audit(px, units(spark, d).where("area > 20").select("unit_id"), "unit_id", ["slope"], "weight")


GRID = "g(unit, x0, y0, x1, y1) AS (SELECT i * 1000 + j, i * 50.0::DOUBLE, j * 50.0::DOUBLE, i * 50.0::DOUBLE + 50, j * 50.0::DOUBLE + 50 FROM range(20) a(i), range(10) b(j))"
PIECES = "pc AS (SELECT zone AS id, unit, (least(z.x1, g.x1) - greatest(z.x0, g.x0)) * (least(z.y1, g.y1) - greatest(z.y0, g.y0)) AS area FROM z JOIN g ON z.x0 < g.x1 AND g.x0 < z.x1 AND z.y0 < g.y1 AND g.y0 < z.y1)"


def grid(spark):
    """Squares as rings."""
    d = spark.range(200).select((F.floor(F.col("id") / 10) * 1000 + F.col("id") % 10).alias("id"), (F.floor(F.col("id") / 10) * 50.0).alias("x0"), (F.col("id") % 10 * 50.0).alias("y0"))
    d = d.withColumns({"x1": F.col("x0") + 50, "y1": F.col("y0") + 50})
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return d.withColumn("ring", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0")))


@q(f"WITH {RECTS}, {GRID}, {PIECES} SELECT id, unit, round(area, 6) AS area, area >= 100 AS kept FROM pc")
def clipped_polygons(spark, d):
    """The zones' pieces in the squares of a grid, and which of them are mere fragments."""
    return Z.clip_to_units(zones(spark, d).withColumnRenamed("zone", "id"), grid(spark), 50.0, 100.0).withColumn("area", F.round("area", 6))


@q(f"""WITH {RECTS}, {GRID}, {PIECES}, k AS (SELECT unit, sum(area) AS covered FROM pc WHERE area >= 100 GROUP BY 1) SELECT unit, 2500.0::DOUBLE AS area, round(coalesce(covered, 0), 6) AS covered, round(2500 - coalesce(covered, 0), 6) AS uncovered FROM g LEFT JOIN k USING (unit)""")
def coverage_gaps(spark, d):
    """How much of each square the kept pieces leave open (negative where zones overlap)."""
    out = Z.coverage_gaps(grid(spark), Z.clip_to_units(zones(spark, d).withColumnRenamed("zone", "id"), grid(spark), 50.0, 100.0))
    return out.select("unit", *[F.round(c, 6).alias(c) for c in ("area", "covered", "uncovered")])


@q()
def learned_colours(spark, d):
    """Share of parts whose colour comes back as the class that its mode was learned from; tests compare with a plain version."""
    k = F.col("p_partkey")
    rgb = read(spark, d, "part").select(k.alias("id"), (k % 4 + 1).cast("int").alias("class"), (k % 4 * 60 + k * 7 % 20).alias("r"), (200 - k % 4 * 50 + k * 13 % 20).alias("g"), (k % 2 * 120 + k * 29 % 20).alias("bl"))
    lab = L.srgb_to_lab("r", "g", "bl")
    px = rgb.select("id", "class", lab[0].alias("l"), lab[1].alias("a"), lab[2].alias("b"))
    px = cut(px, "pixels")
    hit = Z.classify_colours(px, Z.learned_modes(px, support=20, mode_support=10))
    return hit.groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg((F.col("class") == F.col("predicted")).cast("double")), 6).alias("agree"))


@q()
def boosted_tree_auc(spark, d):
    """AUC of boosted trees grown on the other folds; tests hold them to held-out accuracy."""
    u = units(spark, d)
    return auc(M.tree_scores(u, ["area", "x", "y", "p"], "boosted", 5, 3).select("fold", "label", F.round("p", 9).alias("p")), ["fold"]).withColumn("auc", F.round("auc", 6))


@q()
def forest_auc(spark, d):
    """The same of a random forest."""
    u = units(spark, d)
    return auc(M.tree_scores(u, ["area", "x", "y", "p"], "forest", 10, 5).select("fold", "label", F.round("p", 9).alias("p")), ["fold"]).withColumn("auc", F.round("auc", 6))


@q(f"""WITH {UNITS} SELECT county, count(*) AS n, round(sqrt(avg(sin(radians(unit_id * 37 % 360))) ** 2 + avg(cos(radians(unit_id * 37 % 360))) ** 2), 6) AS consistency FROM units GROUP BY 1""")
def direction_consistency(spark, d):
    """How far the directions of a county's units agree."""
    turned = F.radians((F.col("unit_id") * 37 % 360).cast("double"))
    u = units(spark, d).select("county", F.sin(turned).alias("s"), F.cos(turned).alias("c"))
    return u.groupBy("county").agg(F.count("*").alias("n"), F.round(L.direction_consistency("s", "c"), 6).alias("consistency"))


@q(f"""WITH {UNITS}, g AS (SELECT CAST(floor(y / 25) AS BIGINT) AS r, CAST(floor(x / 25) AS BIGINT) AS c, min(area) AS v FROM units GROUP BY 1, 2), e AS (SELECT min(r) AS r0, max(r) - min(r) + 1 AS nr, min(c) AS c0, max(c) - min(c) + 1 AS nc FROM g),
k AS (SELECT r - r0 AS r, c - c0 AS c, v, nr, nc FROM g, e WHERE v % 5 <> 0), a AS (SELECT *, unnest([r, -1 - r, 2 * nr - 1 - r]) AS pr FROM k), i AS (SELECT *, unnest([c, -1 - c, 2 * nc - 1 - c]) AS pc FROM a),
t AS (SELECT tr.x AS r, tc.x AS c FROM (SELECT unnest(range(nr)) AS x FROM e) tr, (SELECT unnest(range(nc)) AS x FROM e) tc),
s AS (SELECT t.r, t.c, sum(v * exp(-((t.r - pr) ** 2 + (t.c - pc) ** 2) / 2)) / sum(exp(-((t.r - pr) ** 2 + (t.c - pc) ** 2) / 2)) AS z FROM t JOIN i ON abs(t.r - pr) <= 4 AND abs(t.c - pc) <= 4 GROUP BY 1, 2),
n AS (SELECT k.r, k.c, CASE WHEN k.c = nc - 1 THEN o.z ELSE coalesce(ea.z, 0) END - CASE WHEN k.c = 0 THEN o.z ELSE coalesce(we.z, 0) END AS dx, CASE WHEN k.r = nr - 1 THEN o.z ELSE coalesce(so.z, 0) END - CASE WHEN k.r = 0 THEN o.z ELSE coalesce(no.z, 0) END AS dy,
  CASE WHEN k.c IN (0, nc - 1) THEN 25.0::DOUBLE ELSE 50 END AS sx, CASE WHEN k.r IN (0, nr - 1) THEN -25.0::DOUBLE ELSE -50 END AS sy
  FROM k JOIN s o ON o.r = k.r AND o.c = k.c LEFT JOIN s ea ON ea.r = k.r AND ea.c = k.c + 1 LEFT JOIN s we ON we.r = k.r AND we.c = k.c - 1 LEFT JOIN s so ON so.r = k.r + 1 AND so.c = k.c LEFT JOIN s no ON no.r = k.r - 1 AND no.c = k.c)
SELECT r + r0 AS row, c + c0 AS col, round(least(greatest((dx / sx * 0.5::DOUBLE - dy / sy * 0.5::DOUBLE + sqrt(0.5::DOUBLE)) / sqrt(1 + (dx / sx) ** 2 + (dy / sy) ** 2), 0), 1), 6) AS shade FROM n, e""")
def shaded_relief(spark, d):
    """Relief of the units' areas on a grid with holes."""
    g = units(spark, d).groupBy(F.floor(F.col("y") / 25).alias("row"), F.floor(F.col("x") / 25).alias("col")).agg(F.min("area").alias("v"))
    return Z.shaded_relief(g.select("row", "col", F.when(F.col("v") % 5 != 0, F.col("v")).alias("value")), 25.0, 25.0).withColumn("shade", F.round("shade", 6))
