"""Ranking, coverage, calibration and decision metrics over rows of label, score, area and id.

Every function groups by ``by`` (a list of columns, possibly empty) and aggregates by distinct score before any ordered window, so that the ordered
part has as many rows as there are scores. Metrics of a group without both classes are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.ordering import average_rank, cumulative, joined, quantiles, row_numbers, totals

def ratio(a, b) -> Column:
    """a / b as doubles, null where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def by_score(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Weights of positives and negatives at each score."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    return df.groupBy(*by, "p").agg(F.sum(F.when(F.col("label") == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 1, 0).otherwise(w)).alias("neg"))


def auc(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """ROC area with ties counted half."""
    s = by_score(df, by, weight)
    s = cumulative(s, by, [F.col("p")], {"upto": F.col("neg")})
    s = s.withColumn("won", F.col("pos") * (F.col("upto") - F.col("neg") * F.lit(0.5)))
    agg = s.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("pos").alias("p1"), F.sum("neg").alias("n0"))
    return agg.select(*by, F.when((F.col("p1") > 0) & (F.col("n0") > 0), F.col("won") / (F.col("p1") * F.col("n0")).cast("double")).alias("auc"))


def average_precision(df: DataFrame, by: list[str]) -> DataFrame:
    """Sum over distinct scores, from the highest, of precision times the gain in recall."""
    s = by_score(df, by)
    s = cumulative(s, by, [F.desc("p")], {"tp": F.col("pos"), "all": F.col("pos") + F.col("neg")})
    agg = s.groupBy(*by).agg(F.sum(F.col("pos") * F.col("tp").cast("double") / F.col("all")).alias("s"), F.sum("pos").alias("p1"), F.sum("neg").alias("n0"))
    return agg.select(*by, F.when((F.col("p1") > 0) & (F.col("n0") > 0), F.col("s") / F.col("p1")).alias("ap"))


def running_area(df: DataFrame, by: list[str]) -> DataFrame:
    """df with cum (area down to each row, by falling score, then id) and total."""
    return cumulative(totals(df, by, {"total": F.col("area")}), by, [F.desc("p"), F.col("unit_id")], {"cum": F.col("area")})


def coverage_prefix(df: DataFrame, by: list[str], share: float = 0.2) -> DataFrame:
    """Strict budget: units taken while the running area is within the share. Share of positives captured, units and area used."""
    r = running_area(df, by).withColumn("inside", F.col("cum") <= F.lit(share) * F.col("total"))
    agg = r.groupBy(*by).agg(F.sum("label").alias("positives"), F.sum(F.when(F.col("inside"), F.col("label")).otherwise(0)).alias("captured"), F.count_if("inside").alias("n_units"), F.coalesce(F.sum(F.when(F.col("inside"), F.col("area"))), F.lit(0.0)).alias("area_used"))
    return agg.withColumn("coverage", ratio("captured", "positives"))


def capture_inclusive(df: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """Inclusive budget: the unit that crosses the share is taken too."""
    r = running_area(df, by).withColumn("before", F.col("cum") - F.col("area"))
    r = r.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    agg = r.groupBy(*by, "share").agg(F.sum("label").alias("positives"), F.sum(F.when(F.col("before") < F.col("share") * F.col("total"), F.col("label")).otherwise(0)).alias("captured"))
    return agg.withColumn("capture", ratio("captured", "positives"))


def area_at_recall(df: DataFrame, by: list[str], targets: list[float]) -> DataFrame:
    """Least area that holds a share of the positives when units of equal score are taken together."""
    s = df.groupBy(*by, "p").agg(F.sum("label").alias("pos"), F.sum("area").alias("a"))
    s = totals(s, by, {"positives": F.col("pos"), "total": F.col("a")})
    s = cumulative(s, by, [F.desc("p")], {"tp": F.col("pos"), "cum": F.col("a")})
    s = s.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets]))).where(F.col("tp") >= F.col("target") * F.col("positives"))
    first = s.groupBy(*by, "target").agg(F.max_by(F.struct("p", "tp", "cum", "positives", "total"), "p").alias("f"))
    return first.select(*by, "target", F.col("f.p").alias("threshold"), ratio(F.col("f.cum"), F.col("f.total")).alias("area_share"), ratio(F.col("f.tp"), F.col("f.positives")).alias("recall"))


def recall_at_top(df: DataFrame, by: list[str], share: float = 0.1) -> DataFrame:
    """Share of positives among the top share of units: their number rounded half to even, one at least."""
    k = F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("n"), 0).cast("long"))
    r = row_numbers(totals(df, by, {"n": F.lit(1).cast("long"), "positives": F.col("label")}), by, [F.desc("p"), F.col("unit_id")], "rn")
    return r.groupBy(*by).agg(F.max("positives").alias("positives"), F.sum(F.when(F.col("rn") <= k, F.col("label")).otherwise(0)).alias("captured")).withColumn("recall", ratio("captured", "positives"))


def graded(df: DataFrame, cuts: list[float]) -> DataFrame:
    """df with level 1..len(cuts)+1: one more than the number of cuts below the score."""
    level = F.lit(1)
    for c in cuts:
        level = level + F.when(F.col("p") > c, 1).otherwise(0)
    return df.withColumn("level", level.cast("int"))


def grade_confusion(df: DataFrame, by: list[str], minimum: list[int]) -> DataFrame:
    """Confusion of level >= minimum with the label, recall, specificity, precision and balanced accuracy."""
    d = df.withColumn("minimum", F.explode(F.array(*[F.lit(m) for m in minimum]))).withColumn("hit", F.col("level") >= F.col("minimum"))
    pos = F.col("label") == 1
    agg = d.groupBy(*by, "minimum").agg(F.count_if(F.col("hit") & pos).alias("tp"), F.count_if(~F.col("hit") & pos).alias("fn"), F.count_if(F.col("hit") & ~pos).alias("fp"), F.count_if(~F.col("hit") & ~pos).alias("tn"))
    agg = agg.withColumns({"recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "specificity": ratio(F.col("tn"), F.col("tn") + F.col("fp")), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"))})
    return agg.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def brier(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Brier score, reliability, resolution and uncertainty, on equal-frequency bins of the score, and the expected calibration error."""
    edges = quantiles(df, by, "p", [i / bins for i in range(1, bins)], "edges")
    d = joined(df, edges, by)
    means = df.groupBy(*by).agg(F.avg("label").alias("base"), F.count("*").alias("n"))
    d = joined(d, means, by).withColumn("edges", F.array_distinct("edges"))
    d = d.withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("p"))))
    b = d.groupBy(*by, "bin").agg(F.count("*").alias("k"), F.avg("p").alias("mp"), F.avg("label").alias("my"), F.sum(F.pow(F.col("p") - F.col("label"), F.lit(2))).alias("sq"), F.max("base").alias("base"), F.max("n").alias("n"))
    share = F.col("k") / F.col("n")
    return b.groupBy(*by).agg(
        (F.sum("sq") / F.max("n")).alias("brier"),
        F.sum(share * F.pow(F.col("mp") - F.col("my"), F.lit(2))).alias("reliability"),
        F.sum(share * F.pow(F.col("my") - F.col("base"), F.lit(2))).alias("resolution"),
        (F.max("base") * (1 - F.max("base"))).alias("uncertainty"),
        F.sum(share * F.abs(F.col("mp") - F.col("my"))).alias("ece"),
    )


def reliability_curve(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Count, mean score and mean label of equal-width bins."""
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("mean_label"))


def net_benefit(df: DataFrame, by: list[str], thresholds: list[float]) -> DataFrame:
    """Net benefit of treating scores at or above each threshold, and of treating all."""
    d = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    hit = F.col("p") >= F.col("threshold")
    agg = d.groupBy(*by, "threshold").agg(F.count("*").alias("n"), F.sum("label").alias("pos"), F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"))
    odds = F.col("threshold") / (1 - F.col("threshold"))
    return agg.select(*by, "threshold", "tp", "fp", (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * odds).alias("net_benefit"), (F.col("pos") / F.col("n") - (F.col("n") - F.col("pos")) / F.col("n") * odds).alias("treat_all"))


def percent_rank_average(df: DataFrame, by: list[str]) -> DataFrame:
    """df with pct: average rank of the score among its group, as a share of the group."""
    ranked = average_rank(totals(df, by, {"__all": F.lit(1).cast("long")}), by, "p", "__rank")
    return ranked.withColumn("pct", F.col("__rank") / F.col("__all")).drop("__rank", "__all")


def cross_conformal(df: DataFrame, alphas: list[float]) -> DataFrame:
    """For each fold, the score that the positives of the other folds exceed with probability 1 - alpha, and what it selects in the fold."""
    folds = df.select("fold").distinct().withColumnRenamed("fold", "outer")
    calib = df.where("label = 1").select("fold", (1 - F.col("p")).alias("s"), "unit_id").join(F.broadcast(folds), F.col("fold") != F.col("outer"))
    calib = row_numbers(totals(calib, ["outer"], {"n": F.lit(1).cast("long")}), ["outer"], [F.col("s"), F.col("unit_id")], "rn")
    calib = calib.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    k = F.least(F.ceil((F.col("n") + 1) * (1 - F.col("alpha"))), F.col("n"))
    q = calib.where(F.col("rn") == k).select(F.col("outer").alias("fold"), "alpha", F.col("s").alias("limit"))
    d = df.join(F.broadcast(q), "fold").withColumn("in_set", 1 - F.col("p") <= F.col("limit"))
    return d.groupBy("fold", "alpha").agg(F.max("limit").alias("limit"), F.count_if("in_set").alias("selected"), ratio(F.count_if(F.col("in_set") & (F.col("label") == 1)), F.sum("label")).alias("coverage"))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))
