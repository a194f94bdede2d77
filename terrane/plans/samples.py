"""Queries of folds, donors, contexts and matched samples (over units)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import sampling as S
from terrane.plans.proxies import PIXELS, UNITS, pixels, units
from terrane.plans.registry import Catalog

C = Catalog()
q = C.query
FOLDS = "folds AS (SELECT DISTINCT fold AS outer_fold FROM units)"


@q(f"""WITH {UNITS}, {FOLDS}, donors AS (SELECT outer_fold, CAST(date_trunc('month', event_date) AS DATE) AS month, row_number() OVER (PARTITION BY outer_fold ORDER BY date_trunc('month', event_date), unit_id) - 1 AS k, count(*) OVER (PARTITION BY outer_fold) AS n
  FROM units JOIN folds ON fold <> outer_fold WHERE label = 1),
pairs AS (SELECT u.*, f.outer_fold, CAST(CAST(CAST('0x' || substr(sha256('42|spatial|' || f.outer_fold || '|' || unit_id), 1, 16) AS UBIGINT) AS HUGEINT) * s.n // 18446744073709551616 AS BIGINT) AS k
  FROM units u, folds f JOIN (SELECT outer_fold, max(n) AS n FROM donors GROUP BY 1) s ON s.outer_fold = f.outer_fold)
SELECT p.outer_fold AS "outer", unit_id, CASE WHEN fold = p.outer_fold THEN 'test' ELSE 'train' END AS role, CASE WHEN label = 1 THEN CAST(date_trunc('month', event_date) AS DATE) ELSE d.month END AS reference_month
FROM pairs p LEFT JOIN donors d ON d.outer_fold = p.outer_fold AND d.k = p.k""")
def reference_month_donor(spark, d):
    return S.reference_months(units(spark, d), 42, "spatial")


@q(f"""WITH {UNITS}, {FOLDS}, t AS (SELECT outer_fold, unit_id, label, row_number() OVER (PARTITION BY outer_fold ORDER BY label DESC, CASE WHEN label = 0 THEN sha256('context|7|' || outer_fold || '|' || unit_id) END, unit_id) AS rank FROM units JOIN folds ON fold <> outer_fold)
SELECT outer_fold AS "outer", unit_id, label FROM t WHERE rank <= 9000""")
def hash_context_fill(spark, d):
    return S.context_fill(units(spark, d), 9000, 7)


@q(f"""WITH {UNITS}, {FOLDS}, t AS (SELECT outer_fold, unit_id, fold, label, row_number() OVER (PARTITION BY outer_fold ORDER BY label DESC, CASE WHEN label = 0 THEN sha256('context|7|' || outer_fold || '|' || unit_id) END, unit_id) AS rank FROM units JOIN folds ON fold <> outer_fold),
c AS (SELECT * FROM t WHERE rank <= 9000)
SELECT outer_fold AS "outer", count(*) AS n, count(DISTINCT unit_id) AS distinct_ids, count(*) FILTER (fold = outer_fold) AS test_ids, CAST(sum(label) AS BIGINT) AS positives, count(DISTINCT label) = 2 AS both_classes FROM c GROUP BY 1""")
def context_validation(spark, d):
    """Counts that a context must satisfy: size, no repeats, no test units, both classes."""
    u = units(spark, d)
    c = S.context_fill(u, 9000, 7).join(u.select("unit_id", "fold"), "unit_id")
    return c.groupBy("outer").agg(F.count("*").alias("n"), F.count_distinct("unit_id").alias("distinct_ids"), F.count_if(F.col("fold") == F.col("outer")).alias("test_ids"), F.sum("label").alias("positives"), (F.count_distinct("label") == 2).alias("both_classes"))


@q(f"WITH {UNITS}, r AS (SELECT unit_id, row_number() OVER (ORDER BY x, y, unit_id) - 1 AS rn, count(*) OVER () AS n FROM units) SELECT unit_id, CAST(floor(rn * 5 / n) AS INTEGER) AS strip FROM r".replace("rn * 5 / n", "rn * 5 / n::DOUBLE"))
def strip_folds(spark, d):
    return S.strip_folds(units(spark, d), 5)


@q(f"""WITH {UNITS}, {FOLDS} SELECT outer_fold AS "outer", unit_id, CASE WHEN fold = outer_fold THEN 'test' ELSE 'train' END AS role FROM units, folds""")
def fold_role_views(spark, d):
    return S.fold_roles(units(spark, d))


ADMIN = f"""WITH RECURSIVE {UNITS}, c AS (SELECT county, CAST(sum(label) AS BIGINT) AS pos, row_number() OVER (ORDER BY sum(label) DESC, county) AS k FROM units GROUP BY 1),
g(k, load, picked) AS (
  SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], -1
  UNION ALL
  SELECT c.k, list_transform(g.load, lambda x, i: CASE WHEN i = list_position(g.load, list_min(g.load)) THEN x + c.pos ELSE x END), CAST(list_position(g.load, list_min(g.load)) - 1 AS INTEGER) FROM g JOIN c ON c.k = g.k + 1)
"""


@q(f"{ADMIN} SELECT unit_id, u.county, picked AS admin_fold FROM units u JOIN c ON c.county = u.county JOIN g ON g.k = c.k")
def admin_folds(spark, d):
    return S.admin_folds(units(spark, d), "county", 5)


@q(f"""WITH {UNITS}, n AS (SELECT CAST(sum(label) AS BIGINT) AS pos, count(*) - CAST(sum(label) AS BIGINT) AS bg FROM units)
SELECT r.ratio, (2 * pos * r.n + r.p) // (2 * r.p) AS size, (2 * pos * r.n + r.p) // (2 * r.p) <= bg AS feasible FROM n, (VALUES ('1:1', 1, 1), ('3:1', 3, 1), ('3:2', 3, 2), ('1:9', 1, 9)) r(ratio, p, n)""")
def ratio_size(spark, d):
    """Background that each ratio of positives to background needs, by whole-number arithmetic with ties up."""
    n = units(spark, d).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("bg"))
    r = spark.createDataFrame([("1:1", 1, 1), ("3:1", 3, 1), ("3:2", 3, 2), ("1:9", 1, 9)], "ratio string, p long, n long")
    size = F.expr("(2 * pos * n + p) div (2 * p)")
    return n.join(F.broadcast(r)).select("ratio", size.alias("size"), (size <= F.col("bg")).alias("feasible"))


@q(f"""WITH {UNITS}, t AS (SELECT m AS member, unit_id, label, row_number() OVER (PARTITION BY m ORDER BY label DESC, CASE WHEN label = 0 THEN sha256('member|3|' || m || '|' || unit_id) END, unit_id) AS rank FROM units, range(4) r(m))
SELECT CAST(member AS INTEGER) AS member, unit_id, label FROM t WHERE rank <= 8000""")
def subsample_plan(spark, d):
    return S.subsample_plan(units(spark, d), 8000, 4, 3)


@q(f"""WITH {UNITS}, s AS (SELECT *, floor(x / 200) AS sx, floor(y / 200) AS sy FROM units), r AS (SELECT *, row_number() OVER (PARTITION BY sx, sy, label ORDER BY sha256('match|11|' || unit_id), unit_id) AS rn FROM s)
SELECT CAST(a.sx AS BIGINT) AS sx, CAST(a.sy AS BIGINT) AS sy, a.unit_id AS case_id, b.unit_id AS control_id FROM r a JOIN r b ON a.label = 1 AND b.label = 0 AND a.sx = b.sx AND a.sy = b.sy AND a.rn = ceil(b.rn / 2.0::DOUBLE)""")
def case_control_match(spark, d):
    u = units(spark, d).withColumns({"sx": F.floor(F.col("x") / 200), "sy": F.floor(F.col("y") / 200)})
    return S.case_control(u, ["sx", "sy"], 2, 11)


@q(f"""WITH {UNITS}, s AS (SELECT unit_id, county, floor(x / 100) AS sx FROM units), t AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY county, sx ORDER BY unit_id) AS place, row_number() OVER (PARTITION BY county, sx ORDER BY sha256('donor|5|' || unit_id), unit_id) AS turn FROM s WINDOW w AS (PARTITION BY county, sx))
SELECT a.unit_id, CASE WHEN a.n >= 8 THEN b.unit_id ELSE a.unit_id END AS donor_id FROM t a JOIN t b ON a.county = b.county AND a.sx = b.sx AND a.place = b.turn""")
def stratified_donor_order(spark, d):
    return S.donor_order(units(spark, d).withColumn("sx", F.floor(F.col("x") / 100)), ["county", "sx"], 8, 5)


@q(f"""WITH {PIXELS}, r AS (SELECT unit_id, line, part, supp, sum(weight) AS weight FROM pixels GROUP BY ALL), c AS (SELECT *, sum(weight) OVER (PARTITION BY unit_id ORDER BY line, part, supp ROWS UNBOUNDED PRECEDING) AS hi, sum(weight) OVER (PARTITION BY unit_id) AS total FROM r),
u AS (SELECT *, i AS draw, CAST('0x' || substr(sha256('bag|9|' || unit_id || '|' || i), 1, 8) AS UBIGINT)::DOUBLE / 4294967296.0::DOUBLE * total AS v FROM c, range(4) t(i))
SELECT unit_id, CAST(draw AS INTEGER) AS draw, line, part, supp FROM u WHERE v >= hi - weight AND v < hi""")
def weighted_bag_draws(spark, d):
    rows = pixels(spark, d).groupBy("unit_id", "line", "part", "supp").agg(F.sum("weight").alias("weight"))
    return S.weighted_draws(rows, "unit_id", ["line", "part", "supp"], 4, 9)


@q(f"""WITH {UNITS}, t AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY unit_id) AS place, row_number() OVER (PARTITION BY fold ORDER BY sha256('permute|2|' || unit_id), unit_id) AS turn FROM units)
SELECT a.unit_id, a.label, b.x, b.y FROM t a JOIN t b ON a.fold = b.fold AND a.place = b.turn""")
def block_permutation(spark, d):
    """A block of features permuted together within folds."""
    return S.permuted(units(spark, d).select("unit_id", "fold", "label", "x", "y"), "unit_id", ["x", "y"], 2, ["fold"]).select("unit_id", "label", "x", "y")


@q(f"""WITH {UNITS}, c AS (SELECT unit_id, greatest(count(*) FILTER (l_quantity > 25), 1) AS n FROM units LEFT JOIN lineitem ON l_orderkey = unit_id GROUP BY 1) SELECT n AS weight, count(*) AS units FROM c GROUP BY 1""")
def frequency_weights(spark, d):
    """Units by the weight that their number of events gives them, one at least."""
    e = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("unit_id")).agg(F.count("*").alias("n"))
    u = units(spark, d).select("unit_id").join(e, "unit_id", "left").withColumn("weight", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).cast("long"))
    return u.groupBy("weight").agg(F.count("*").alias("units"))


@q()
def kmeans_folds(spark, d):
    """Units of each spatial cluster; tests check that clusters are compact."""
    return S.kmeans_folds(units(spark, d), 5, 42).groupBy("fold").agg(F.count("*").alias("n"))
