"""Tables that explain scores: grouped permutation deltas, local changes, ranks and report aggregates. Any predictor's long output will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.ordering import joined, quantiles
from terrane.operators.scoring import auc


def permutation_deltas(scores: DataFrame, baseline: str = "baseline") -> DataFrame:
    """AUC of the baseline less AUC of each altered variant, by fold. scores: fold, variant, repeat, label, p."""
    a = auc(scores, ["fold", "variant", "repeat"])
    b = a.where(F.col("variant") == baseline).select("fold", F.col("auc").alias("base"))
    return a.where(F.col("variant") != baseline).join(b, "fold").select("fold", "variant", "repeat", (F.col("base") - F.col("auc")).alias("delta"))


def delta_report(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Mean, least and greatest delta, folds whose mean over repeats is positive, and the rank of the mean among variants."""
    folds = deltas.groupBy(*by, "variant", "fold").agg(F.avg("delta").alias("m"), F.min("delta").alias("lo"), F.max("delta").alias("hi"))
    g = folds.groupBy(*by, "variant").agg(F.avg("m").alias("mean"), F.min("lo").alias("least"), F.max("hi").alias("greatest"), F.count_if(F.col("m") > 0).alias("positive_folds"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return g.withColumn("rank", F.rank().over(w.orderBy(F.desc("mean"))))


def local_changes(scores: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Baseline score less the mean altered one, of each unit and variant. scores: unit_id, variant, repeat, p."""
    m = scores.groupBy("unit_id", "variant").agg(F.avg("p").alias("p"))
    b = m.where(F.col("variant") == baseline).select("unit_id", F.col("p").alias("base"))
    return m.where(F.col("variant") != baseline).join(b, "unit_id").select("unit_id", "variant", (F.col("base") - F.col("p")).alias("change"))


def replay_check(a: DataFrame, b: DataFrame, key: list[str], tolerance: float = 2e-5) -> DataFrame:
    """Largest, mean and 99th-percentile absolute difference of two runs' scores, and rows beyond the tolerance."""
    d = a.join(b.withColumnRenamed("p", "__p"), key).select(F.abs(F.col("p") - F.col("__p")).alias("d"))
    g = d.agg(F.count("*").alias("n"), F.max("d").alias("max_abs"), F.avg("d").alias("mean_abs"), F.count_if(F.col("d") > tolerance).alias("beyond"))
    return g.crossJoin(F.broadcast(quantiles(d, [], "d", [0.99]))).withColumn("p99", F.col("q")[0]).drop("q")


def level_profile(long: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean, 10th percentile, median and 90th percentile of each feature by group."""
    keys = [*by, "feature"]
    g = joined(long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean")), quantiles(long, keys, "value", [0.1, 0.5, 0.9]), keys)
    return g.select(*by, "feature", "n", "mean", *[F.col("q")[i].alias(c) for i, c in enumerate(("p10", "p50", "p90"))])
