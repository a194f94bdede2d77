"""Weighted summaries of child records (bags) by unit, and zonal class fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.scoring import ratio


def weighted_mean(x: str, w: str = "weight") -> Column:
    return F.sum(F.col(x) * F.col(w)) / F.sum(w)


def weighted_summary(df: DataFrame, key: str, x: str, w: str = "weight", quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Weighted mean, population deviation and left-inverse quantiles (the first value whose cumulative weight share reaches q, else the last).

    A bag with a missing value has missing statistics.
    """
    values = df.groupBy(key, x).agg(F.sum(w).alias("w"))
    up = Window.partitionBy(key).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    v = values.withColumns({"cum": F.sum("w").over(up) / F.sum("w").over(whole), "m": F.sum(F.col(x) * F.col("w")).over(whole) / F.sum("w").over(whole)})
    stats = [F.max("m").alias("mean"), F.sqrt(F.sum(F.col("w") * F.pow(F.col(x) - F.col("m"), F.lit(2))) / F.sum("w")).alias("sd")]
    stats += [F.coalesce(F.min(F.when(F.col("cum") >= q, F.col(x))), F.max(x)).alias(f"p{round(q * 100):02d}") for q in quantiles]
    agg = v.groupBy(key).agg(*stats, F.max(F.col(x).isNull()).alias("gap"))
    return agg.select(key, *[F.when(~F.col("gap"), F.col(c)).alias(c) for c in agg.columns[1:-1]])


def joint_summary(df: DataFrame, key: str, share: str, x: str, w: str = "weight", least: float = 1e-8) -> DataFrame:
    """Mean of x under weights of w * share, and the weighted covariance of share and x."""
    sw = F.sum(w)
    ms, mx, msx = F.sum(F.col(w) * F.col(share)) / sw, F.sum(F.col(w) * F.col(x)) / sw, F.sum(F.col(w) * F.col(share) * F.col(x)) / sw
    return df.groupBy(key).agg((msx / F.greatest(ms, F.lit(least))).alias("weighted_x"), (msx - ms * mx).alias("covariance"))


def mid_cdf(df: DataFrame, key: str, x: str, w: str = "weight") -> DataFrame:
    """For each distinct value of a bag: the cumulative weight share at the middle of its own, and its place relative to the 10-90 % range around the median."""
    values = df.groupBy(key, x).agg(F.sum(w).alias("w"))
    up = Window.partitionBy(key).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    v = values.withColumns({"cum": F.sum("w").over(up) / F.sum("w").over(whole), "share": F.col("w") / F.sum("w").over(whole)})
    first = lambda q: F.min(F.when(F.col("cum") >= q, F.col(x))).over(whole)
    return v.select(key, x, (F.col("cum") - F.col("share") / 2).alias("mid"), ((F.col(x) - first(0.5)) / F.greatest(first(0.9) - first(0.1), F.lit(1.0))).alias("relative"))


def class_fractions(df: DataFrame, key: str, category: str, values: list[str]) -> DataFrame:
    """Count and share of each class, of all records and of those with a class."""
    of = {v: F.count_if(F.col(category) == v) for v in values}
    shares = [c for v in values for c in ((of[v] / F.count("*")).alias(f"all_{v}"), ratio(of[v], F.count(category)).alias(f"valid_{v}"))]
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count(category).alias("valid"), *shares)


def dominant_class(df: DataFrame, key: str, category: str) -> DataFrame:
    """The most frequent class, the first by name among equals, and its share."""
    c = df.where(F.col(category).isNotNull()).groupBy(key, category).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    c = c.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("n"), category)), "total": F.sum("n").over(w)})
    return c.where("rn = 1").select(key, F.col(category).alias("dominant"), (F.col("n") / F.col("total")).alias("share"))


def exposure_by_class(df: DataFrame, key: str, share: str, category: str, w: str = "weight") -> DataFrame:
    """Weights by exposure band (<= 0.1, middle, >= 0.9) and class, and both marginals, in one pass. Nulls of band or class mark a marginal."""
    band = F.when(F.col(share) <= 0.1, "low").when(F.col(share) >= 0.9, "high").otherwise("middle")
    d = df.select(key, band.alias("band"), F.col(category).alias("class"), F.col(w).alias("w"))
    sets = f"(({key}, band, class), ({key}, band), ({key}, class))"
    return d.sparkSession.sql(f"SELECT {key}, band, class, sum(w) AS w FROM {{d}} GROUP BY GROUPING SETS {sets}", d=d)


def independence(exposure: DataFrame, key: str) -> DataFrame:
    """Outer product of the two marginals of ``exposure_by_class``: what the joint weights would be without association."""
    bands = exposure.where("class IS NULL").select(key, "band", F.col("w").alias("wb"))
    classes = exposure.where("band IS NULL").select(key, "class", F.col("w").alias("wc"))
    total = bands.groupBy(key).agg(F.sum("wb").alias("total"))
    return bands.join(classes, key).join(total, key).select(key, "band", "class", (F.col("wb") * F.col("wc") / F.col("total")).alias("expected"))


def category_moments(df: DataFrame, key: str, category: str, values: DataFrame, value: str) -> DataFrame:
    """Mean, least, greatest, span and deviation of a class's value over the records of a unit."""
    c = df.groupBy(key, category).agg(F.count("*").alias("n")).join(F.broadcast(values), category)
    m = F.sum(F.col("n") * F.col(value)) / F.sum("n")
    sq = F.sum(F.col("n") * F.col(value) * F.col(value)) / F.sum("n")
    return c.groupBy(key).agg(m.alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"), (F.max(value) - F.min(value)).alias("span"), F.sqrt(F.greatest(sq - m * m, F.lit(0.0))).alias("sd"))


def scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: of each column its mean over finite values, its population deviation after filling the mean (1 where below 1e-6), and its count."""
    finite = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in columns}
    sums = df.agg(F.count("*").alias("n"), *[a for c, f in finite.items() for a in (F.count(f).alias(f"{c}_n"), F.coalesce(F.avg(f), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.var_pop(f), F.lit(0.0)).alias(f"{c}_var"))])
    sd = {c: F.sqrt(F.col(f"{c}_var") * F.col(f"{c}_n") / F.col("n")) for c in columns}
    return sums.select("n", *[x for c in columns for x in (F.col(f"{c}_n"), F.col(f"{c}_mean"), F.when(sd[c] < 1e-6, 1.0).otherwise(sd[c]).alias(f"{c}_sd"))])


def scale(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """df with columns filled by the fitted mean and standardised; rows without any value become 0."""
    d = df.crossJoin(F.broadcast(fitted))
    return d.select(*[c for c in df.columns if c not in columns], *[((F.coalesce(F.when(~F.isnan(c), F.col(c)), F.col(f"{c}_mean")) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")).alias(c) for c in columns])
