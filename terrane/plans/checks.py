"""Queries of constraints, joins, sets, scans and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.functions import scalars as L
from terrane.operators import constraints as K
from terrane.plans.proxies import PIXELS, UNITS, pixels, read, units
from terrane.plans.registry import Catalog

C = Catalog()
q = C.query


@q(f"""WITH {UNITS} SELECT count(*) - count(DISTINCT unit_id) AS repeated_ids, count(*) FILTER (p < 0 OR p > 1) AS bad_scores, count(*) FILTER (area <= 0) AS bad_areas, count(*) FILTER (label NOT IN (0, 1)) AS bad_labels, 2 - count(DISTINCT label) AS missing_classes FROM units""")
def prediction_constraints(spark, d):
    return K.prediction_violations(units(spark, d))


GRADED = "g AS (SELECT unit_id, p AS score, 1 + CASE WHEN p > 0.2 THEN 1 ELSE 0 END + CASE WHEN p > 0.4 THEN 1 ELSE 0 END + CASE WHEN p > 0.6 THEN 1 ELSE 0 END + CASE WHEN p > 0.8 AND unit_id % 97 <> 0 THEN 1 ELSE 0 END AS level FROM units WHERE unit_id % 1000 <> 0)"


@q(f"""WITH {UNITS}, {GRADED}, r AS (SELECT level, min(score) AS lo, max(score) AS hi FROM g GROUP BY 1)
SELECT count(*) FILTER (u.unit_id IS NULL OR g.unit_id IS NULL) AS unmatched, count(*) FILTER (coalesce(level NOT BETWEEN 1 AND 5, true)) AS bad_levels, count(*) FILTER (abs(p - score) > 1e-8) AS other_scores,
  (SELECT count(*) FROM (SELECT score FROM g GROUP BY 1 HAVING count(DISTINCT level) > 1)) AS split_ties, (SELECT count(*) FROM r x JOIN r y ON x.level + 1 = y.level WHERE x.hi >= y.lo) AS overlaps
FROM units u FULL JOIN g ON u.unit_id = g.unit_id""")
def grade_constraints(spark, d):
    u = units(spark, d)
    level = F.lit(1) + sum((F.when(F.col("p") > c, 1).otherwise(0) for c in (0.2, 0.4, 0.6)), F.lit(0)) + F.when((F.col("p") > 0.8) & (F.col("unit_id") % 97 != 0), 1).otherwise(0)
    return K.grade_violations(u, u.where("unit_id % 1000 <> 0").select("unit_id", F.col("p").alias("score"), level.alias("level")))


@q(f"""WITH {UNITS}, s AS (SELECT unit_id, p, CAST(1 + floor(p * 4.99) AS INTEGER) AS level, label FROM units WHERE unit_id % 60 <> 0) SELECT u.unit_id, coalesce(s.p, 0) AS p, coalesce(level, 1) AS level, coalesce(s.label, -1) AS label FROM units u LEFT JOIN s USING (unit_id)""")
def population_complete_merge(spark, d):
    u = units(spark, d)
    scores = u.where("unit_id % 60 <> 0").select("unit_id", "p", (1 + F.floor(F.col("p") * 4.99)).cast("int").alias("level"), "label")
    return K.complete_population(u.select("unit_id"), scores)


@q("""WITH raw AS (SELECT event_type AS station, CAST(ts AS DATE) AS date, CAST(floor(value / 40) AS BIGINT) AS level FROM events)
SELECT 'kept' AS kind, count(*) AS n FROM (SELECT 1 FROM raw GROUP BY station, date HAVING count(DISTINCT level) <= 1) UNION ALL SELECT 'conflict', count(*) FROM (SELECT 1 FROM raw GROUP BY station, date HAVING count(DISTINCT level) > 1)""")
def dedup_conflict_check(spark, d):
    """Keys whose rows agree, and keys whose rows don't."""
    raw = read(spark, d, "events").select(F.col("event_type").alias("station"), F.to_date("ts").alias("date"), F.floor(F.col("value") / 40).alias("level"))
    kept, conflict = K.dedup_conflicts(raw, ["station", "date"], "level")
    count = lambda x, n: x.agg(F.lit(n).alias("kind"), F.count("*").alias("n"))
    return count(kept, "kept").unionByName(count(conflict, "conflict"))


@q(f"""WITH {UNITS}, scope AS (SELECT DISTINCT l_orderkey AS unit_id FROM lineitem WHERE l_returnflag = 'R')
SELECT region, count(*) FILTER (unit_id IN (SELECT unit_id FROM scope)) AS inside, count(*) FILTER (unit_id NOT IN (SELECT unit_id FROM scope)) AS outside FROM units GROUP BY 1""")
def left_semi_anti_scope(spark, d):
    u = units(spark, d)
    scope = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("unit_id"))
    inside = u.join(scope, "unit_id", "left_semi").groupBy("region").agg(F.count("*").alias("inside"))
    return inside.join(u.join(scope, "unit_id", "left_anti").groupBy("region").agg(F.count("*").alias("outside")), "region")


@q(f"""WITH {UNITS}, a AS (SELECT unit_id FROM units WHERE p > 0.5), b AS (SELECT unit_id FROM units WHERE area > 150)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'union all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'differ', count(*) FROM (SELECT a.unit_id FROM a FULL JOIN b USING (unit_id) WHERE a.unit_id IS NULL OR b.unit_id IS NULL)""")
def set_operations(spark, d):
    u = units(spark, d)
    a, b = u.where("p > 0.5").select("unit_id"), u.where("area > 150").select("unit_id")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "union all": a.unionByName(b), "differ": K.set_difference(a, b, "unit_id")}
    out = None
    for name, x in parts.items():
        x = x.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = x if out is None else out.unionByName(x)
    return out


@q(f"""WITH {UNITS}, r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY p DESC, unit_id) AS a, row_number() OVER (PARTITION BY region ORDER BY area DESC, unit_id) AS b, count(*) OVER (PARTITION BY region) AS n FROM units)
SELECT region, count(*) FILTER (a <= n // 10 AND b <= n // 10)::DOUBLE / count(*) FILTER (a <= n // 10 OR b <= n // 10) AS jaccard FROM r GROUP BY 1""")
def top_set_jaccard(spark, d):
    """Overlap of the top tenths by two orders."""
    w = Window.partitionBy("region")
    r = units(spark, d).withColumns({"a": F.row_number().over(w.orderBy(F.desc("p"), "unit_id")), "b": F.row_number().over(w.orderBy(F.desc("area"), "unit_id")), "k": F.floor(F.count("*").over(w) / 10)})
    a, b = F.col("a") <= F.col("k"), F.col("b") <= F.col("k")
    return r.groupBy("region").agg((F.count_if(a & b) / F.count_if(a | b)).alias("jaccard"))


@q("""WITH f AS (SELECT 'brand' AS family, p_partkey AS member FROM part UNION ALL SELECT 'size', p_partkey FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT 'size', p_partkey FROM part WHERE p_partkey % 9 = 0),
u AS (SELECT p_partkey AS member FROM part), g AS (SELECT DISTINCT family FROM f), c AS (SELECT family, member, count(*) AS n FROM f GROUP BY 1, 2)
SELECT g.family, u.member, coalesce(n, 0) AS times FROM g CROSS JOIN u LEFT JOIN c ON c.family = g.family AND c.member = u.member WHERE coalesce(n, 0) <> 1""")
def set_ops_partition_check(spark, d):
    """Members that a family covers not exactly once."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("member"))
    f = p.withColumn("family", F.lit("brand")).unionByName(p.where("member % 7 <> 0").withColumn("family", F.lit("size"))).unionByName(p.where("member % 9 = 0").withColumn("family", F.lit("size")))
    return K.partition_check(f, "family", "member", p)


@q(f"""WITH {UNITS}, a AS (SELECT unit_id, area, x FROM units), b AS (SELECT unit_id, CASE WHEN unit_id % 10 = 0 THEN area + 1 ELSE area END AS area, CASE WHEN unit_id % 20 = 0 THEN NULL ELSE x END AS x FROM units),
l AS (SELECT 'area' AS c, a.area AS v, b.area AS w FROM a JOIN b USING (unit_id) UNION ALL SELECT 'x', a.x, b.x FROM a JOIN b USING (unit_id))
SELECT c AS "column", count(abs(v - w)) AS n, max(abs(v - w)) AS max_abs, round(avg(abs(v - w)), 9) AS mean_abs, round(max(abs(v - w) / greatest(abs(v), 1e-12)), 9) AS max_rel, round(avg(CASE WHEN abs(v - w) = 0 THEN 1.0 WHEN w IS NULL OR v IS NULL THEN NULL ELSE 0 END), 9) AS equal, count(*) FILTER (v IS NULL) AS nulls_left, count(*) FILTER (w IS NULL) AS nulls_right FROM l GROUP BY 1""")
def table_reconciliation(spark, d):
    a = units(spark, d).select("unit_id", "area", "x")
    b = a.select("unit_id", F.when(F.col("unit_id") % 10 == 0, F.col("area") + 1).otherwise(F.col("area")).alias("area"), F.when(F.col("unit_id") % 20 != 0, F.col("x")).alias("x"))
    return K.reconcile(a, b, "unit_id", ["area", "x"]).withColumns({c: F.round(c, 9) for c in ("mean_abs", "max_rel", "equal")})


@q(f"""WITH {UNITS} SELECT CAST(date_trunc('month', event_date) AS DATE) AS month, {", ".join(f"count(*) FILTER (priority = '{p}') AS p{p[0]}" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM"))} FROM units GROUP BY 1""")
def crosstab_pivot(spark, d):
    u = units(spark, d).withColumn("month", F.trunc("event_date", "MM"))
    t = u.groupBy("month").pivot("priority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).count()
    return t.select("month", *[F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(f"p{p[0]}") for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")])


@q("""SELECT p_partkey AS host, trim(unnest(string_split(p_name, ' '))) AS child FROM part""")
def inventory_remap(spark, d):
    """Children named in one text column, one row each."""
    return read(spark, d, "part").select(F.col("p_partkey").alias("host"), F.explode(F.split("p_name", " ")).alias("child")).withColumn("child", F.trim("child"))


@q("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) AS INTEGER) AS code, n FROM c""")
def categorical_legend(spark, d):
    c = read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return c.withColumn("code", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("p_brand")))


@q("""SELECT p_partkey, CAST(p_size <= 10 AS INTEGER) AS small, CAST(p_size > 10 AND p_size <= 30 AS INTEGER) AS middle, CAST(p_size > 30 AS INTEGER) AS large, CASE WHEN p_size <= 10 AND p_retailprice > 1000 THEN 'dear' WHEN p_size > 30 THEN 'bulky' ELSE 'other' END AS kind FROM part""")
def one_hot_and_branches(spark, d):
    s, price = F.col("p_size"), F.col("p_retailprice")
    return read(spark, d, "part").select("p_partkey", (s <= 10).cast("int").alias("small"), ((s > 10) & (s <= 30)).cast("int").alias("middle"), (s > 30).cast("int").alias("large"), F.when((s <= 10) & (price > 1000), "dear").when(s > 30, "bulky").otherwise("other").alias("kind"))


@q(f"""WITH {UNITS}, t AS (SELECT region, county, sum(area) AS area FROM units WHERE p > 0.8 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY area DESC, county) AS k FROM t) SELECT DISTINCT county FROM r WHERE k <= 3""")
def top_counties(spark, d):
    """Counties among the first three of any region by area of high scores."""
    t = units(spark, d).where("p > 0.8").groupBy("region", "county").agg(F.sum("area").alias("area"))
    return t.withColumn("k", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("area"), "county"))).where("k <= 3").select("county").distinct()


@q(f"""WITH {UNITS} SELECT fold, count(*) FILTER (region = 'ASIA') AS n, min(unit_id) AS first_id, max_by(unit_id, p * 1000000 + unit_id % 1000) AS top_id FROM units GROUP BY 1""")
def first_per_stratum(spark, d):
    """Equal scores go to the least unit_id; the SQL leaves them open, and DuckDB's choice changes from run to run."""
    score = F.col("p") * 1000000 + F.col("unit_id") % 1000
    order = F.when(score.isNotNull(), F.struct(score, F.bitwise_not("unit_id")))
    return units(spark, d).groupBy("fold").agg(F.count_if(F.col("region") == "ASIA").alias("n"), F.min("unit_id").alias("first_id"), F.max_by("unit_id", order).alias("top_id"))


@q(f"""WITH {PIXELS}, m AS (SELECT unit_id, list_transform(list_sort(list({{'l': line, 'p': part, 's': supp, 'e': elevation}})), lambda z: z.e) AS v FROM pixels GROUP BY 1) SELECT unit_id, len(v) AS n, v[1] AS first, v[len(v)] AS last, list_sum(v) AS total FROM m""")
def array_roundtrip(spark, d):
    """Long rows to one ordered array for each unit, and what it holds."""
    m = pixels(spark, d).groupBy("unit_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("line").alias("l"), F.col("part").alias("p"), F.col("supp").alias("s"), F.col("elevation").alias("e")))), lambda z: z["e"]).alias("v"))
    return m.select("unit_id", F.size("v").cast("long").alias("n"), F.get("v", F.lit(0)).alias("first"), F.element_at("v", -1).alias("last"), F.aggregate("v", F.lit(0.0), lambda a, z: a + z).alias("total"))


@q("""WITH y AS (SELECT o_custkey AS site, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2) SELECT site, coalesce(sum(n) FILTER (year = 1995), 0)::BIGINT AS y1995, coalesce(sum(n) FILTER (year = 1996), 0)::BIGINT AS y1996, coalesce(sum(n) FILTER (year = 1997), 0)::BIGINT AS y1997 FROM y GROUP BY 1""")
def wide_year_matrix(spark, d):
    year = F.year("o_orderdate")
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("site")).agg(*[F.count_if(year == k).alias(f"y{k}") for k in (1995, 1996, 1997)])


@q(f"""WITH {UNITS} SELECT unit_id, sha256('v1|' || unit_id || '|' || county) AS digest, round_even(area / 0.5, 0) * 0.5 AS half, round(abs(((x - y + 180) % 360 + 360) % 360 - 180), 6) AS angle, round(CASE WHEN area % 7 = 0 THEN 0 ELSE degrees(atan(tan(radians(y % 80)) * cos(radians((x % 360 + 360) % 360)))) END, 6) AS dip, round(x / (2 * sqrt(pi() * area)), 6) AS shape, x % 90 + (y % 60) / 60 + (area % 60) / 3600 AS decimal_degrees, trim(regexp_replace(lower(county), '[^a-z0-9]+', '_', 'g'), '_') AS token FROM units""")
def scalar_functions(spark, d):
    a = F.col("area")
    return units(spark, d).select(
        "unit_id",
        F.sha2(F.concat_ws("|", F.lit("v1"), F.col("unit_id").cast("string"), "county"), 256).alias("digest"),
        L.half_even("area", 0.5).alias("half"),
        F.round(L.angle_difference("x", "y"), 6).alias("angle"),
        F.round(L.apparent_dip(F.col("y") % 80, F.when(a % 7 == 0, -1.0).otherwise(F.pmod(F.col("x"), F.lit(360)))), 6).alias("dip"),
        F.round(L.shape_index("x", "area"), 6).alias("shape"),
        L.dms(F.col("x") % 90, F.col("y") % 60, a % 60).alias("decimal_degrees"),
        L.clean_token("county").alias("token"),
    )


@q("""WITH p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 50 AS DOUBLE) AS y FROM part), s(k, ax, ay, ex, ey) AS (VALUES (1, 0.0::DOUBLE, 0.0::DOUBLE, 40.0::DOUBLE, 30.0::DOUBLE), (2, 10.0, 45.0, 50.0, 5.0)),
t AS (SELECT id, k, greatest(0, least(1, ((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / ((ex - ax) ** 2 + (ey - ay) ** 2))) AS t, x, y, ax, ay, ex, ey FROM p, s)
SELECT id, round(min(sqrt((ax + t * (ex - ax) - x) ** 2 + (ay + t * (ey - ay) - y) ** 2)), 6) AS dist FROM t GROUP BY 1""")
def nearest_line(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 50).cast("double").alias("y"))
    s = spark.createDataFrame([(1, 0.0, 0.0, 40.0, 30.0), (2, 10.0, 45.0, 50.0, 5.0)], "k int, ax double, ay double, ex double, ey double")
    return p.crossJoin(F.broadcast(s)).groupBy("id").agg(F.round(F.min(G.segment_distance("x", "y", "ax", "ay", "ex", "ey")), 6).alias("dist"))


@q("""SELECT p_partkey AS id, p_size BETWEEN 11 AND 30 AND p_partkey % 50 BETWEEN 11 AND 20 AS inside FROM part""")
def point_in_polygon(spark, d):
    """Points in a rectangle with its sides off the points, by the crossing rule."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 50).cast("double").alias("y"))
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10.5, 10.5), (30.5, 10.5), (30.5, 20.5), (10.5, 20.5), (10.5, 10.5))])
    return p.select("id", G.contains(ring, "x", "y").alias("inside"))


@q("""SELECT n_name AS county, count(*) FILTER (c_acctbal > 0) AS inside, count(*) FILTER (c_acctbal <= 0) AS outside, round(100 * avg(CAST(c_acctbal > 0 AS DOUBLE)), 6) AS percent FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def many_to_one_join(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("county"))
    j = K.lookup(read(spark, d, "customer"), n, ["c_nationkey"])
    pos = F.col("c_acctbal") > 0
    return j.groupBy("county").agg(F.count_if(pos).alias("inside"), F.count_if(~pos).alias("outside"), F.round(100 * F.avg(pos.cast("double")), 6).alias("percent"))


@q(f"""WITH {UNITS}, m AS (SELECT avg(area) FILTER (fold <> 0) AS m FROM units) SELECT unit_id, CASE WHEN unit_id % 9 = 0 THEN m ELSE area END AS area FROM units, m""")
def train_mean_imputation(spark, d):
    """Missing values filled with the mean of the training folds."""
    u = units(spark, d)
    m = u.where("fold <> 0").agg(F.avg("area").alias("m"))
    return u.withColumn("area", F.when(F.col("unit_id") % 9 != 0, F.col("area"))).crossJoin(F.broadcast(m)).select("unit_id", F.coalesce("area", "m").alias("area"))
