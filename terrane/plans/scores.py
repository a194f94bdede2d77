"""Queries of ranking, coverage, calibration and decisions (over units)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.operators import scoring as S
from terrane.plans.proxies import UNITS, units
from terrane.plans.registry import Catalog

C = Catalog()
q = C.query
CUTS = [0.2, 0.4, 0.6, 0.8]
LEVEL = "1 + " + " + ".join(f"CASE WHEN p > {c} THEN 1 ELSE 0 END" for c in CUTS)


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


AUC_BY = """
scored AS (SELECT {by}, p, sum(label) AS pos, count(*) - sum(label) AS neg FROM {rows} GROUP BY {by}, p),
ranked AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY p) - neg AS below FROM scored),
aucs AS (SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg * 0.5::DOUBLE)) / CAST(sum(pos) * sum(neg) AS DOUBLE) END AS auc FROM ranked GROUP BY {by})"""


@q(f"WITH {UNITS}, {AUC_BY.format(by='region', rows='units')} SELECT region, round(auc, 9) AS auc FROM aucs")
def auc_by_region(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.auc(units(spark, d), ["region"]), "auc")


@q(f"""WITH {UNITS},
scored AS (SELECT region, p, sum(CASE WHEN label = 1 THEN area ELSE 0 END) AS pos, sum(CASE WHEN label = 1 THEN 0 ELSE area END) AS neg FROM units GROUP BY region, p),
ranked AS (SELECT *, sum(neg) OVER (PARTITION BY region ORDER BY p) - neg AS below FROM scored)
SELECT region, round(sum(pos * (below + neg * 0.5::DOUBLE)) / (sum(pos) * sum(neg)), 9) AS auc FROM ranked GROUP BY region""")
def weighted_auc_by_region(spark, d):
    return rounded(S.auc(units(spark, d), ["region"], "area"), "auc")


AP_BY = """
aps AS (SELECT region, sum(pos * CAST(tp AS DOUBLE) / n) / sum(pos) AS ap FROM (
  SELECT region, pos, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS n FROM scored WINDOW w AS (PARTITION BY region ORDER BY p DESC)) GROUP BY region)"""


@q(f"WITH {UNITS}, {AUC_BY.format(by='region', rows='units')}, {AP_BY} SELECT region, round(ap, 9) AS ap FROM aps")
def average_precision_by_region(spark, d):
    return rounded(S.average_precision(units(spark, d), ["region"]), "ap")


PREFIX = """
running AS (SELECT *, sum(area) OVER (PARTITION BY {by} ORDER BY p DESC, unit_id ROWS UNBOUNDED PRECEDING) AS cum, sum(area) OVER (PARTITION BY {by}) AS total FROM units)"""


@q(f"""WITH {UNITS}, {PREFIX.format(by='region')}
SELECT region, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(CASE WHEN cum <= 0.2 * total THEN label ELSE 0 END) AS BIGINT) AS captured, count(*) FILTER (cum <= 0.2 * total) AS n_units,
  coalesce(sum(area) FILTER (cum <= 0.2 * total), 0) AS area_used, sum(CASE WHEN cum <= 0.2 * total THEN label ELSE 0 END)::DOUBLE / sum(label) AS coverage FROM running GROUP BY region""")
def coverage20_prefix(spark, d):
    return S.coverage_prefix(units(spark, d), ["region"])


@q(f"""WITH {UNITS}, {PREFIX.format(by='fold')}, {AUC_BY.format(by='fold', rows='units')}
SELECT r.fold, s.share, round(sum(CASE WHEN cum <= s.share * total THEN label ELSE 0 END)::DOUBLE / sum(label), 9) AS coverage,
  round(coalesce(sum(area) FILTER (cum <= s.share * total), 0) / max(total), 9) AS area_share, round(max(auc), 9) AS auc
FROM running r, (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) s(share), aucs WHERE aucs.fold = r.fold GROUP BY r.fold, s.share""")
def coverage_two_budgets(spark, d):
    u = units(spark, d)
    total = u.groupBy("fold").agg(F.sum("area").alias("total"))
    parts = [S.coverage_prefix(u, ["fold"], s).withColumn("share", F.lit(s)) for s in (0.1, 0.2)]
    out = parts[0].unionByName(parts[1]).join(total, "fold").join(S.auc(u, ["fold"]), "fold")
    return out.select("fold", "share", F.round("coverage", 9).alias("coverage"), F.round(F.col("area_used") / F.col("total"), 9).alias("area_share"), F.round("auc", 9).alias("auc"))


@q(f"""WITH {UNITS}, {PREFIX.format(by='region')}
SELECT region, s.share, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(CASE WHEN cum - area < s.share * total THEN label ELSE 0 END) AS BIGINT) AS captured,
  sum(CASE WHEN cum - area < s.share * total THEN label ELSE 0 END)::DOUBLE / sum(label) AS capture
FROM running, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE)) s(share) GROUP BY region, s.share""")
def capture_inclusive(spark, d):
    return S.capture_inclusive(units(spark, d), ["region"], [0.05, 0.1, 0.2, 0.5])


@q(f"""WITH {UNITS},
s AS (SELECT region, p, sum(label) AS pos, sum(area) AS a FROM units GROUP BY region, p),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(a) OVER w AS cum, sum(pos) OVER (PARTITION BY region) AS positives, sum(a) OVER (PARTITION BY region) AS total FROM s WINDOW w AS (PARTITION BY region ORDER BY p DESC)),
f AS (SELECT *, row_number() OVER (PARTITION BY region, t.target ORDER BY p DESC) AS k FROM c, (VALUES (0.8::DOUBLE), (0.9::DOUBLE)) t(target) WHERE tp >= target * positives)
SELECT region, target, p AS threshold, cum / total AS area_share, tp::DOUBLE / positives AS recall FROM f WHERE k = 1""")
def area_at_recall_ties(spark, d):
    return S.area_at_recall(units(spark, d), ["region"], [0.8, 0.9])


@q(f"""WITH {UNITS}, r AS (SELECT *, row_number() OVER (PARTITION BY county ORDER BY p DESC, unit_id) AS rn, count(*) OVER (PARTITION BY county) AS n FROM units)
SELECT county, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(CASE WHEN rn <= greatest(1, round_even(0.1::DOUBLE * n, 0)) THEN label ELSE 0 END) AS BIGINT) AS captured,
  sum(CASE WHEN rn <= greatest(1, round_even(0.1::DOUBLE * n, 0)) THEN label ELSE 0 END)::DOUBLE / nullif(sum(label), 0) AS recall FROM r GROUP BY county""")
def recall_at_top10(spark, d):
    return S.recall_at_top(units(spark, d), ["county"])


@q(f"""WITH {UNITS}, g AS (SELECT *, {LEVEL} AS level FROM units), c AS (
SELECT region, minimum, count(*) FILTER (level >= minimum AND label = 1) AS tp, count(*) FILTER (level < minimum AND label = 1) AS fn,
  count(*) FILTER (level >= minimum AND label = 0) AS fp, count(*) FILTER (level < minimum AND label = 0) AS tn FROM g, (VALUES (3), (4)) m(minimum) GROUP BY region, minimum)
SELECT *, tp::DOUBLE / (tp + fn) AS recall, tn::DOUBLE / (tn + fp) AS specificity, tp::DOUBLE / nullif(tp + fp, 0) AS precision, (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 AS balanced_accuracy FROM c""")
def grade_confusion_ba(spark, d):
    return S.grade_confusion(S.graded(units(spark, d), CUTS), ["region"], [3, 4])


@q(f"""WITH {UNITS}, g AS (SELECT *, {LEVEL} AS level FROM units),
c AS (SELECT county, grouping(county) AS whole, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(CASE WHEN level >= 4 THEN label ELSE 0 END) AS BIGINT) AS high_positives, sum(area) AS area, sum(CASE WHEN level >= 4 THEN area ELSE 0 END) AS high_area FROM g GROUP BY ROLLUP (county))
SELECT county, CAST(whole AS INTEGER) AS whole, positives, high_positives, area, high_area, high_positives::DOUBLE / nullif(positives, 0) AS recall, high_area / nullif(area, 0) AS area_share,
  round((high_positives::DOUBLE / nullif(positives, 0)) / nullif(high_area / nullif(area, 0), 0), 9) AS enrichment FROM c""")
def region_enrichment_rollup(spark, d):
    g = S.graded(units(spark, d), CUTS)
    high = F.col("level") >= 4
    c = g.rollup("county").agg(F.grouping("county").cast("int").alias("whole"), F.sum("label").alias("positives"), F.sum(F.when(high, F.col("label")).otherwise(0)).alias("high_positives"), F.sum("area").alias("area"), F.sum(F.when(high, F.col("area")).otherwise(0.0)).alias("high_area"))
    c = c.withColumns({"recall": S.ratio("high_positives", "positives"), "area_share": S.ratio("high_area", "area")})
    return c.withColumn("enrichment", F.round(S.ratio("recall", "area_share"), 9))


@q(f"""WITH {UNITS}, g AS (SELECT *, {LEVEL} AS level FROM units)
SELECT level, count(*) AS n, sum(area) AS area, CAST(sum(label) AS BIGINT) AS positives, round(sum(area) / sum(sum(area)) OVER (), 9) AS area_share, round(sum(label)::DOUBLE / sum(sum(label)) OVER (), 9) AS positive_share,
  min(p) AS low, max(p) AS high FROM g GROUP BY level""")
def grade_statistics(spark, d):
    g = S.graded(units(spark, d), CUTS).groupBy("level").agg(F.count("*").alias("n"), F.sum("area").alias("area"), F.sum("label").alias("positives"), F.min("p").alias("low"), F.max("p").alias("high"))
    one = Window.partitionBy(F.lit(1))
    return g.withColumns({"area_share": F.round(F.col("area") / F.sum("area").over(one), 9), "positive_share": F.round(F.col("positives").cast("double") / F.sum("positives").over(one), 9)})


@q(f"""WITH {UNITS},
e AS (SELECT region, list_distinct(quantile_cont(p, [{", ".join(str(i / 10) for i in range(1, 10))}])) AS edges, avg(label) AS base, count(*) AS n FROM units GROUP BY region),
b AS (SELECT u.region, len(list_filter(edges, lambda e: e < p)) AS bin, count(*) AS k, avg(p) AS mp, avg(label) AS my, sum((p - label) ** 2) AS sq, max(base) AS base, max(n) AS n FROM units u JOIN e ON e.region = u.region GROUP BY 1, 2)
SELECT region, round(sum(sq) / max(n), 9) AS brier, round(sum(k::DOUBLE / n * (mp - my) ** 2), 9) AS reliability, round(sum(k::DOUBLE / n * (my - base) ** 2), 9) AS resolution,
  round(max(base) * (1 - max(base)), 9) AS uncertainty, round(sum(k::DOUBLE / n * abs(mp - my)), 9) AS ece FROM b GROUP BY region""")
def brier_decomposition(spark, d):
    return rounded(S.brier(units(spark, d), ["region"]), "brier", "reliability", "resolution", "uncertainty", "ece")


@q(f"""WITH {UNITS} SELECT region, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(label), 9) AS mean_label FROM units GROUP BY 1, 2""")
def reliability_curve(spark, d):
    return rounded(S.reliability_curve(units(spark, d), ["region"]), "mean_p", "mean_label")


@q(f"""WITH {UNITS}, c AS (SELECT region, t.threshold, count(*) AS n, sum(label) AS pos, count(*) FILTER (p >= t.threshold AND label = 1) AS tp, count(*) FILTER (p >= t.threshold AND label = 0) AS fp
  FROM units, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) t(threshold) GROUP BY 1, 2)
SELECT region, threshold, tp, fp, round(tp / n::DOUBLE - fp / n::DOUBLE * (threshold / (1 - threshold)), 9) AS net_benefit, round(pos / n::DOUBLE - (n - pos) / n::DOUBLE * (threshold / (1 - threshold)), 9) AS treat_all FROM c""")
def net_benefit_grid(spark, d):
    return rounded(S.net_benefit(units(spark, d), ["region"], [0.05, 0.1, 0.2, 0.5, 0.8]), "net_benefit", "treat_all")


@q(f"""WITH {UNITS}, cal AS (SELECT o.fold AS outer_fold, 1 - p AS s, row_number() OVER (PARTITION BY o.fold ORDER BY 1 - p, unit_id) AS rn, count(*) OVER (PARTITION BY o.fold) AS n
  FROM units u JOIN (SELECT DISTINCT fold FROM units) o ON u.fold <> o.fold WHERE label = 1),
lim AS (SELECT outer_fold, a.alpha, s AS lim FROM cal, (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) a(alpha) WHERE rn = least(CAST(ceil((n + 1) * (1 - a.alpha)) AS BIGINT), n))
SELECT fold, alpha, max(lim) AS "limit", count(*) FILTER (1 - p <= lim) AS selected, count(*) FILTER (1 - p <= lim AND label = 1)::DOUBLE / sum(label) AS coverage FROM units JOIN lim ON fold = outer_fold GROUP BY 1, 2""")
def conformal_cross_fold(spark, d):
    return S.cross_conformal(units(spark, d), [0.1, 0.2])


@q(f"""WITH {UNITS}, r AS (SELECT unit_id, fold, (rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY fold) AS pct FROM units) SELECT unit_id, round(pct, 9) AS pct FROM r""")
def percent_rank_avg(spark, d):
    return rounded(S.percent_rank_average(units(spark, d), ["fold"]).select("unit_id", "pct"), "pct")


@q(f"""WITH {UNITS}, w AS (SELECT u.*, i / 10.0::DOUBLE AS w, p * (i / 10.0::DOUBLE) + (1 - i / 10.0::DOUBLE) * (CAST('0x' || substr(sha256('alt|' || unit_id), 1, 8) AS UBIGINT)::DOUBLE / 4294967296.0::DOUBLE) AS q FROM units u, range(11) t(i)),
s AS (SELECT w, round(q, 4) AS p, sum(label) AS pos, count(*) - sum(label) AS neg FROM w GROUP BY 1, 2), r AS (SELECT *, sum(neg) OVER (PARTITION BY w ORDER BY p) - neg AS below FROM s)
SELECT w, round(sum(pos * (below + neg * 0.5::DOUBLE)) / CAST(sum(pos) * sum(neg) AS DOUBLE), 9) AS auc FROM r GROUP BY w""")
def blend_weight_scan(spark, d):
    """AUC of blends of two scores over a grid of weights."""
    from terrane.plans.proxies import uniform

    u = units(spark, d).withColumn("alt", uniform(F.concat(F.lit("alt|"), F.col("unit_id").cast("string"))))
    u = u.withColumn("w", F.explode(F.array(*[F.lit(i / 10) for i in range(11)])))
    return rounded(S.auc(u.withColumn("p", F.round(F.col("p") * F.col("w") + (1 - F.col("w")) * F.col("alt"), 4)), ["w"]), "auc")


@q(f"""WITH {UNITS}, s AS (SELECT county, fold, p, sum(label) AS pos, count(*) - sum(label) AS neg FROM units GROUP BY ALL),
r AS (SELECT *, sum(neg) OVER (PARTITION BY county, fold ORDER BY p) - neg AS below FROM s),
a AS (SELECT county, fold, sum(pos) AS np, sum(neg) AS nn, sum(pos * (below + neg * 0.5::DOUBLE)) / CAST(sum(pos) * sum(neg) AS DOUBLE) AS auc FROM r GROUP BY 1, 2 HAVING sum(pos) >= 8 AND sum(neg) >= 8)
SELECT county, count(*) AS blocks, round(sum(np * auc) / sum(np), 9) AS within_auc FROM a GROUP BY county""")
def within_block_auc(spark, d):
    """Mean AUC of blocks with at least 8 of each class, weighted by positives."""
    u = units(spark, d)
    n = u.groupBy("county", "fold").agg(F.sum("label").alias("np"), F.sum(1 - F.col("label")).alias("nn"))
    a = S.auc(u, ["county", "fold"]).join(n, ["county", "fold"]).where("np >= 8 AND nn >= 8")
    return a.groupBy("county").agg(F.count("*").alias("blocks"), F.round(F.sum(F.col("np") * F.col("auc")) / F.sum("np"), 9).alias("within_auc"))


@q(f"""WITH {UNITS}, f AS (SELECT unit_id, label, feature, v AS p FROM (SELECT unit_id, label, p AS score, area, x, y FROM units) UNPIVOT (v FOR feature IN (score, area, x, y))),
{AUC_BY.format(by='feature', rows='f')} SELECT feature, round(auc, 9) AS auc, CAST(row_number() OVER (ORDER BY abs(auc - 0.5) DESC, feature) AS INTEGER) AS place FROM aucs""")
def univariate_auc_scan(spark, d):
    u = units(spark, d).select("unit_id", "label", F.col("p").alias("score"), "area", "x", "y")
    a = S.auc(u.unpivot(["unit_id", "label"], ["score", "area", "x", "y"], "feature", "p"), ["feature"])
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.abs(F.col("auc") - 0.5)), "feature"))
    return a.select("feature", F.round("auc", 9).alias("auc"), place.alias("place"))


@q(f"""WITH {UNITS}, e AS (SELECT unit_id, label, p, domain, f FROM (SELECT unit_id, label, p, 'all' AS domain, fold FROM units UNION ALL SELECT unit_id, label, p, 'large', fold FROM units WHERE area > 200), LATERAL (SELECT unnest([fold, -1]) AS f)),
{AUC_BY.format(by='domain, f', rows='e')} SELECT domain, f AS fold, round(auc, 9) AS auc FROM aucs""")
def metric_table(spark, d):
    """AUC of each fold and of all folds pooled (fold -1), of all units and of a subgroup, in one pass."""
    u = units(spark, d).withColumn("domain", F.explode(F.expr("filter(array('all', if(area > 200, 'large', null)), z -> z is not null)")))
    u = u.withColumn("fold", F.explode(F.array("fold", F.lit(-1))))
    return rounded(S.auc(u, ["domain", "fold"]), "auc")


SEEDED = """seeded AS (SELECT u.*, s AS seed, CAST('0x' || substr(sha256('seed|' || s || '|' || unit_id), 1, 4) AS UBIGINT) % 100 / 100.0::DOUBLE AS q FROM units u, range(3) t(s))"""


def seeded(spark, d):
    """units with a score q for each of three seeds."""
    token = F.concat(F.lit("seed|"), F.col("seed").cast("string"), F.lit("|"), F.col("unit_id").cast("string"))
    u = units(spark, d).withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in range(3)])))
    return u.withColumn("q", (F.conv(F.substring(F.sha2(token, 256), 1, 4), 16, 10).cast("long") % 100) / F.lit(100.0))


@q(f"""WITH {UNITS}, {SEEDED}, rows AS (SELECT CAST(seed AS VARCHAR) AS seed, unit_id, label, q AS p FROM seeded UNION ALL SELECT 'ensemble', unit_id, max(label), round(avg(q), 6) FROM seeded GROUP BY unit_id HAVING count(*) = 3),
{AUC_BY.format(by='seed', rows='rows')} SELECT seed, round(auc, 9) AS auc FROM aucs""")
def seed_ensemble(spark, d):
    s = seeded(spark, d)
    mean = s.groupBy("unit_id").agg(F.max("label").alias("label"), F.round(F.avg("q"), 6).alias("p"), F.count("*").alias("n")).where("n = 3").select(F.lit("ensemble").alias("seed"), "label", "p")
    return rounded(S.auc(s.select(F.col("seed").cast("string").alias("seed"), "label", F.col("q").alias("p")).unionByName(mean), ["seed"]), "auc")


@q(f"""WITH {UNITS}, {SEEDED}, rows AS (SELECT seed, unit_id, label, q AS p FROM seeded), {AUC_BY.format(by='seed', rows='rows')}
SELECT count(*) AS seeds, round(avg(auc), 9) AS mean_auc, round(stddev_samp(auc), 9) AS sd_auc FROM aucs""")
def seed_stability(spark, d):
    a = S.auc(seeded(spark, d).withColumn("p", F.col("q")), ["seed"])
    return a.agg(F.count("*").alias("seeds"), F.round(F.avg("auc"), 9).alias("mean_auc"), F.round(F.stddev_samp("auc"), 9).alias("sd_auc"))


@q(f"""WITH {UNITS}, e AS (SELECT region, label, p, f FROM units, LATERAL (SELECT unnest([fold, -1]) AS f)), {AUC_BY.format(by='region, f', rows='e')}
SELECT region, round(avg(auc) FILTER (f >= 0), 9) AS macro, round(max(auc) FILTER (f = -1), 9) AS pooled FROM aucs GROUP BY region""")
def macro_vs_pooled(spark, d):
    u = units(spark, d).withColumn("fold", F.explode(F.array("fold", F.lit(-1))))
    a = S.auc(u, ["region", "fold"])
    return a.groupBy("region").agg(F.round(F.avg(F.when(F.col("fold") >= 0, F.col("auc"))), 9).alias("macro"), F.round(F.max(F.when(F.col("fold") == -1, F.col("auc"))), 9).alias("pooled"))


@q(f"""WITH {UNITS}, {PREFIX.format(by='region')}, a AS (SELECT unit_id, cum <= 0.2 * total AS top FROM running),
alt AS (SELECT unit_id, sum(area) OVER (PARTITION BY region ORDER BY y DESC, unit_id ROWS UNBOUNDED PRECEDING) <= 0.2 * sum(area) OVER (PARTITION BY region) AS top FROM units)
SELECT county, count(*) FILTER (label = 1 AND a.top AND NOT alt.top) AS lost, count(*) FILTER (label = 1 AND NOT a.top AND alt.top) AS rescued, count(*) FILTER (label = 1 AND NOT alt.top) AS missed
FROM units u JOIN a ON a.unit_id = u.unit_id JOIN alt ON alt.unit_id = u.unit_id GROUP BY county""")
def rescued_lost_by_county(spark, d):
    u = units(spark, d)
    inside = F.col("cum") <= 0.2 * F.col("total")
    a = S.running_area(u, ["region"]).select("unit_id", "county", "label", inside.alias("a"))
    b = S.running_area(u.withColumn("p", F.col("y")), ["region"]).select("unit_id", inside.alias("b"))
    pos = F.col("label") == 1
    return a.join(b, "unit_id").groupBy("county").agg(F.count_if(pos & F.col("a") & ~F.col("b")).alias("lost"), F.count_if(pos & ~F.col("a") & F.col("b")).alias("rescued"), F.count_if(pos & ~F.col("b")).alias("missed"))


@q(f"""WITH {UNITS}, t AS (SELECT avg(label) AS tau, avg(p) AS pbar FROM units),
l AS (SELECT unit_id, ln(least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) / (1 - least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE))) AS z, ln(tau / (1 - tau)) - ln(pbar / (1 - pbar)) AS o FROM units, t)
SELECT unit_id, round(z, 6) AS logit, round(1 / (1 + exp(-(z + o))), 6) AS corrected FROM l""")
def prior_corrected_scores(spark, d):
    u = units(spark, d)
    t = u.agg(F.avg("label").alias("tau"), F.avg("p").alias("pbar"))
    z = u.crossJoin(F.broadcast(t)).select("unit_id", S.logit(F.col("p")).alias("z"), (S.logit(F.col("tau"), 0.0) - S.logit(F.col("pbar"), 0.0)).alias("o"))
    return z.select("unit_id", F.round("z", 6).alias("logit"), F.round(S.sigmoid(F.col("z") + F.col("o")), 6).alias("corrected"))


@q(f"""WITH {UNITS}, {AUC_BY.format(by='region', rows='units')}, {AP_BY}, {PREFIX.format(by='region')},
{'bags AS (SELECT l_orderkey AS unit_id, count(*) AS lines, sum(CAST(l_quantity AS DOUBLE)) AS weight FROM lineitem GROUP BY 1)'},
c AS (SELECT r.region, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, sum(area) AS area, sum(coalesce(lines, 0)) AS lines, sum(coalesce(weight, 0)) AS weight, sum(CASE WHEN cum <= 0.2 * total THEN label ELSE 0 END)::DOUBLE / nullif(sum(label), 0) AS coverage20 FROM running r LEFT JOIN bags USING (unit_id) GROUP BY 1)
SELECT c.region, n, positives, area, CAST(lines AS BIGINT) AS lines, weight, round(coverage20, 9) AS coverage20, round(auc, 9) AS auc, round(ap, 9) AS ap FROM c JOIN aucs USING (region) JOIN aps USING (region)""")
def flagship_region_report(spark, d):
    """Units with their child records' weight, ranked by score: AUC, average precision and coverage of a 20 % area budget by region."""
    u = units(spark, d)
    bags = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("unit_id")).agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("double")).alias("weight"))
    r = S.running_area(u, ["region"]).join(bags, "unit_id", "left")
    c = r.groupBy("region").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.sum("area").alias("area"), F.sum(F.coalesce("lines", F.lit(0))).alias("lines"), F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), S.ratio(F.sum(F.when(F.col("cum") <= 0.2 * F.col("total"), F.col("label")).otherwise(0)), F.sum("label")).alias("coverage20"))
    return rounded(c.join(S.auc(u, ["region"]), "region").join(S.average_precision(u, ["region"]), "region"), "coverage20", "auc", "ap")
