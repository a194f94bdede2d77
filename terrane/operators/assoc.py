"""Association of factors with a binary label, and of factors with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.ordering import average_rank, joined, quantiles, totals
from terrane.operators.scoring import ratio


def information_value(df: DataFrame, by: list[str], bin_: str, labels: DataFrame) -> DataFrame:
    """Frequency ratio and information value of each bin of each stratum, raw and smoothed by half a count; every (stratum, bin) of ``labels`` gets a row."""
    n = df.groupBy(*by, bin_).agg(F.count("*").alias("units"), F.sum("label").alias("positives"))
    totals = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    grid = totals.crossJoin(F.broadcast(labels.select(bin_).distinct()))
    bins = labels.select(bin_).distinct().count()
    g = grid.join(n, [*by, bin_], "left").withColumns({"units": F.coalesce("units", F.lit(0)), "positives": F.coalesce("positives", F.lit(0))})
    fr = F.when(F.col("units") > 0, (F.col("positives") / F.col("units")) / (F.col("p") / F.col("n")))
    negatives = F.col("units") - F.col("positives")
    smooth = F.log(((F.col("positives") + 0.5) / (F.col("p") + 0.5 * bins)) / ((negatives + 0.5) / (F.col("n") - F.col("p") + 0.5 * bins)))
    status = F.when(F.col("units") == 0, "empty").when(F.col("positives") == 0, "no positives").otherwise("ok")
    low = (F.col("units") < 30) | (F.col("positives") < 5) | (negatives < 5)
    return g.select(*by, bin_, "units", "positives", fr.alias("fr"), F.when(F.col("positives") > 0, F.log(fr)).alias("iv"), F.when(F.col("units") > 0, smooth).alias("smooth"), status.alias("status"), low.alias("low_support"))


def feature_pairs(long: DataFrame, unit: str) -> DataFrame:
    """(a, b, x, y) of every pair a < b of features, over units with finite values of both. long: unit, feature, value."""
    v = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    left = v.select(unit, F.col("feature").alias("a"), F.col("value").alias("x"))
    right = v.select(unit, F.col("feature").alias("b"), F.col("value").alias("y"))
    return left.join(right, unit).where("a < b").select(unit, "a", "b", "x", "y")


def spearman(long: DataFrame, unit: str, least: int = 3) -> DataFrame:
    """(a, b, n, rho): rank correlation over each pair's own complete rows; null with fewer than ``least`` or a constant."""
    p = feature_pairs(long, unit)
    r = average_rank(average_rank(p, ["a", "b"], "x", "rx"), ["a", "b"], "y", "ry")
    return r.groupBy("a", "b").agg(F.count("*").alias("n"), correlation("rx", "ry", least).alias("rho"))


def pearson(long: DataFrame, unit: str, least: int = 3) -> DataFrame:
    return feature_pairs(long, unit).groupBy("a", "b").agg(F.count("*").alias("n"), correlation("x", "y", least).alias("r"))


def correlation(x: str, y: str, least: int) -> Column:
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y)) & (F.count("*") >= least)
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def standardised_difference(df: DataFrame, long_by: list[str]) -> DataFrame:
    """Difference of means of positives and negatives over the root of the mean of their population variances."""
    one, zero = F.when(F.col("label") == 1, F.col("value")), F.when(F.col("label") == 0, F.col("value"))
    return df.groupBy(*long_by).agg(((F.avg(one) - F.avg(zero)) / F.sqrt((F.var_pop(one) + F.var_pop(zero)) / 2 + 1e-12)).alias("smd"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = k / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)


def category_risk(df: DataFrame, category: str, least: int = 20) -> DataFrame:
    """Each category against the rest: rate, Wilson interval, relative risk, positives per 100 of area."""
    c = df.groupBy(category).agg(F.count("*").alias("n"), F.sum("label").alias("k"), F.sum("area").alias("area"))
    one = Window.partitionBy(F.lit(1))
    c = c.withColumns({"rest_n": F.sum("n").over(one) - F.col("n"), "rest_k": F.sum("k").over(one) - F.col("k")}).where(F.col("n") >= least)
    low, high = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    rest = ratio("rest_k", "rest_n")
    return c.select(category, "n", "k", ratio("k", "n").alias("rate"), low.alias("low"), high.alias("high"), F.when(rest > 0, ratio("k", "n") / rest).alias("relative_risk"), (100 * F.col("k") / F.col("area")).alias("density"))


def mantel_haenszel(df: DataFrame, by: list[str], stratum: list[str], least: int = 8) -> DataFrame:
    """Common odds ratio of exposed and label over strata, and its Robins-Breslow-Greenland interval."""
    e, y = F.col("exposed"), F.col("label") == 1
    t = df.groupBy(*by, *stratum).agg(F.count_if(e & y).alias("a"), F.count_if(e & ~y).alias("b"), F.count_if(~e & y).alias("c"), F.count_if(~e & ~y).alias("d"), F.count("*").cast("double").alias("n"))
    t = t.where((F.col("n") >= least) & (F.col("a") + F.col("b") > 0) & (F.col("c") + F.col("d") > 0))
    a, b, c, d, n = (F.col(x) for x in "abcdn")
    r, s, p, q = a * d / n, b * c / n, (a + d) / n, (b + c) / n
    g = t.groupBy(*by).agg(F.count("*").alias("strata"), F.sum(r).alias("r"), F.sum(s).alias("s"), F.sum(p * r).alias("pr"), F.sum(p * s + q * r).alias("ps"), F.sum(q * s).alias("qs"))
    ok = (F.col("r") > 0) & (F.col("s") > 0)
    log = F.log(F.col("r") / F.col("s"))
    se = F.sqrt(F.col("pr") / (2 * F.col("r") * F.col("r")) + F.col("ps") / (2 * F.col("r") * F.col("s")) + F.col("qs") / (2 * F.col("s") * F.col("s")))
    z = 1.959963984540054
    return g.select(*by, "strata", F.when(ok, F.exp(log)).alias("odds_ratio"), F.when(ok, F.exp(log - z * se)).alias("low"), F.when(ok, F.exp(log + z * se)).alias("high"))


def trend(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Cochran-Armitage z of the label's trend over a score."""
    g = df.groupBy(*by, score).agg(F.count("*").cast("double").alias("n"), F.sum("label").cast("double").alias("k"))
    s = F.col(score).cast("double")
    t = g.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(s * F.col("k")).alias("sk"), F.sum(s * F.col("n")).alias("sn"), F.sum(s * s * F.col("n")).alias("ssn"))
    p = F.col("k") / F.col("n")
    var = p * (1 - p) * (F.col("ssn") - F.col("sn") * F.col("sn") / F.col("n"))
    return t.select(*by, F.when(var > 0, (F.col("sk") - p * F.col("sn")) / F.sqrt(var)).alias("z"))


def eta_squared(df: DataFrame, group: str, by: list[str]) -> DataFrame:
    """Share of a value's variance between groups."""
    g = df.groupBy(*by, group).agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    t = g.groupBy(*by).agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"))
    base = F.col("s") * F.col("s") / F.col("n")
    return t.select(*by, F.when(F.col("ss") > base, (F.col("between") - base) / (F.col("ss") - base)).alias("eta2"))


def kruskal(df: DataFrame, group: str, by: list[str]) -> DataFrame:
    """Kruskal-Wallis H with the correction for ties."""
    ranked = totals(average_rank(df, by, "value", "rk"), [*by, "value"], {"t": F.lit(1.0)})
    g = ranked.groupBy(*by, group).agg(F.sum("rk").alias("r"), F.count("*").cast("double").alias("n"), F.sum(F.col("t") * F.col("t") - 1).alias("ties"))
    t = g.groupBy(*by).agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("rr"), F.sum("n").alias("n"), F.sum("ties").alias("ties"), F.count("*").alias("groups"))
    n = F.col("n")
    h = 12 / (n * (n + 1)) * F.col("rr") - 3 * (n + 1)
    return t.select(*by, "groups", F.when(n * n * n - n > F.col("ties"), h / (1 - F.col("ties") / (n * n * n - n))).alias("h"))


def mann_whitney(df: DataFrame, by: list[str]) -> DataFrame:
    """U of positives over negatives and its normal score without correction for ties."""
    t = average_rank(df, by, "value", "rk").groupBy(*by).agg(F.sum(F.when(F.col("label") == 1, F.col("rk"))).alias("r"), F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("n"))
    u = F.col("r") - F.col("p") * (F.col("p") + 1) / 2
    return t.select(*by, u.alias("u"), ((u - F.col("p") * F.col("n") / 2) / F.sqrt(F.col("p") * F.col("n") * (F.col("p") + F.col("n") + 1) / 12)).alias("z"))


def wilcoxon(df: DataFrame, by: list[str]) -> DataFrame:
    """Signed ranks of ``diff``: rows that aren't zero or null, the sum of positive ranks, and its normal score with the correction for ties; the score is null without rows."""
    d = df.where((F.col("diff") != 0) & F.col("diff").isNotNull()).withColumn("__size", F.abs(F.col("diff")))
    r = totals(average_rank(d, by, "__size", "rk"), [*by, "__size"], {"t": F.lit(1.0)})
    t = r.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("diff") > 0, F.col("rk")).otherwise(0.0)).alias("w"), F.sum(F.col("t") * F.col("t") - 1).alias("ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return t.select(*by, "n", "w", F.when(var > 0, (F.col("w") - n * (n + 1) / 4) / F.sqrt(var)).alias("z"))


def strong_pairs(rho: DataFrame, value: str = "rho", limit: float = 0.9) -> DataFrame:
    """Pairs of features whose correlation is at least the limit, either way."""
    return rho.where(F.abs(F.col(value)) >= limit)


def shift(context: DataFrame, test: DataFrame, by: list[str]) -> DataFrame:
    """Standardised shift of test against context means, and the share of test values outside the context's 1st to 99th percentile."""
    c = joined(context.groupBy(*by).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")), quantiles(context, by, "value", [0.01, 0.99]), by)
    t = test.join(F.broadcast(c), by)
    out = F.avg(((F.col("value") < F.col("q")[0]) | (F.col("value") > F.col("q")[1])).cast("double"))
    return t.groupBy(*by).agg(F.when(F.max("sd") > 0, (F.avg("value") - F.max("m")) / F.max("sd")).alias("shift"), out.alias("outside"))


def prune_redundant(ranked: list[tuple[str, float]], pairs: dict[tuple[str, str], float], limit: float) -> list[str]:
    """Features by strength (first the strongest), each kept unless it correlates at or beyond the limit with one kept before. Features are columns: few."""
    kept: list[str] = []
    for name, _ in sorted(ranked, key=lambda x: (-x[1], x[0])):
        if all(abs(pairs.get((min(name, k), max(name, k)), 0.0)) < limit for k in kept):
            kept.append(name)
    return kept
