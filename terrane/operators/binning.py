"""Bins, strata, natural breaks and accumulated local effects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.ordering import joined, quantiles


def above(edges: Column, x: Column, strict: bool = False) -> Column:
    """How many edges are at most x (below x if strict)."""
    return F.size(F.filter(edges, (lambda e: e < x) if strict else (lambda e: e <= x)))


def edges(df: DataFrame, by: list[str], column: str, qs: list[float]) -> DataFrame:
    """(by, edges): distinct quantiles of each group, ascending."""
    return quantiles(df, by, column, qs, "edges").withColumn("edges", F.array_sort(F.array_distinct("edges")))


def band(x: Column, cuts: list[float], right: bool = False) -> Column:
    """Number of the band: left-closed by default, right-closed if asked for."""
    out = F.lit(0)
    for c in cuts:
        out = out + F.when((x > c) if right else (x >= c), 1).otherwise(0)
    return F.when(x.isNotNull(), out)


def adaptive_plan(context: DataFrame, feature: str, value: str) -> DataFrame:
    """How each feature (long table) is binned, from the context alone: by level if it has up to 8 values; by zero and terciles of each sign if at
    least a fifth is zero; else by quintiles."""
    v = context.where(F.col(value).isNotNull())
    agg = v.groupBy(feature).agg(
        F.count_distinct(value).alias("levels"),
        F.avg((F.col(value) == 0).cast("double")).alias("zeros"),
    )
    agg = joined(agg, edges(v, [feature], value, [0.2, 0.4, 0.6, 0.8]).withColumnRenamed("edges", "fifths"), [feature])
    agg = joined(agg, quantiles(v.where(F.col(value) > 0), [feature], value, [1 / 3, 2 / 3], "up"), [feature])
    agg = joined(agg, quantiles(v.where(F.col(value) < 0), [feature], value, [1 / 3, 2 / 3], "down"), [feature])
    few = v.groupBy(feature, value).agg(F.lit(1).alias("one")).groupBy(feature).agg(F.sort_array(F.collect_list(value)).alias("values"), F.count("*").alias("n")).where("n <= 8").select(feature, "values")
    kind = F.when(F.col("levels") <= 8, "level").when(F.col("zeros") >= 0.2, "zero").otherwise("fifth")
    return agg.join(few, feature, "left").select(feature, kind.alias("kind"), "values", "fifths", "up", "down")


def adaptive_bins(rows: DataFrame, plan: DataFrame, feature: str, value: str) -> DataFrame:
    """rows with bin: -1 where missing; unseen levels are one more than the last."""
    x = F.col(value)
    level = F.array_position(F.col("values"), x) - 1
    signed = F.when(x == 0, 3).when(x > 0, 4 + above(F.coalesce("up", F.array().cast("array<double>")), x)).otherwise(above(F.coalesce("down", F.array().cast("array<double>")), x))
    b = F.when(x.isNull(), -1).when(F.col("kind") == "level", F.when(level >= 0, level).otherwise(F.size("values"))).when(F.col("kind") == "zero", signed).otherwise(above(F.col("fifths"), x))
    return rows.join(F.broadcast(plan), feature).select(*rows.columns, b.cast("int").alias("bin"))


def tercile_strata(df: DataFrame, context: DataFrame, columns: tuple[str, str]) -> DataFrame:
    """df with stratum 0..8 from terciles of two columns of the context; -1 where either is missing."""
    d = df
    for i, c in enumerate(columns):
        d = d.crossJoin(F.broadcast(edges(context, [], c, [1 / 3, 2 / 3]).withColumnRenamed("edges", f"e{i}")))
    a, b = (above(F.col(f"e{i}"), F.col(c)) for i, c in enumerate(columns))
    return d.withColumn("stratum", F.when(F.col(columns[0]).isNull() | F.col(columns[1]).isNull(), -1).otherwise(a * 3 + b).cast("int")).drop("e0", "e1")


def ale(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Accumulated local effect at the middle of each bin. deltas: by, bin (0, 1, ...), delta. An empty bin starts a new component; each
    component is centred to have mean 0 over its rows."""
    b = deltas.groupBy(*by, "bin").agg(F.avg("delta").alias("mean"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("bin")
    b = b.withColumn("component", F.col("bin") - F.row_number().over(w))
    c = Window.partitionBy(*by, "component")
    b = b.withColumn("mid", F.sum("mean").over(c.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("mean") / 2)
    return b.withColumn("effect", F.col("mid") - F.sum(F.col("mid") * F.col("n")).over(c) / F.sum("n").over(c)).select(*by, "bin", "n", "mean", "component", "effect")


def natural_breaks(values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Largest value of each of k classes that minimise the weighted squared deviation from class means (Fisher and Jenks), by divide and conquer over
    the monotone optimal cuts. values: sorted, distinct."""
    n = len(values)
    if n < k:
        raise ValueError(f"{n} distinct values can't make {k} classes")
    # Squared sums lose their digits where values are far from 0, so they are taken of values between 0 and 1.
    x = (values - values[0]) / (values[-1] - values[0]) if n > 1 else np.zeros(1)
    w = np.concatenate([[0.0], np.cumsum(counts, dtype=float)])
    s = np.concatenate([[0.0], np.cumsum(counts * x)])
    q = np.concatenate([[0.0], np.cumsum(counts * x * x)])

    def cost(i, j):  # of one class holding values i..j-1
        weight, total = w[j] - w[i], s[j] - s[i]
        return np.maximum(q[j] - q[i] - total * total / weight, 0.0)

    best = np.array([np.inf, *[cost(0, j) for j in range(1, n + 1)]])
    cuts = np.zeros((k, n + 1), int)
    for c in range(1, k):
        new = np.full(n + 1, np.inf)
        todo = [(c + 1, n, c, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(max(first, c), min(last, mid - 1) + 1)
            total = best[i] + cost(i, mid)
            at = int(total.argmin())
            new[mid], cuts[c, mid] = total[at], i[at]
            todo += [(lo, mid - 1, first, i[at]), (mid + 1, hi, i[at], last)]
        best = new
    ends, j = [], n
    for c in range(k - 1, -1, -1):
        ends.append(values[j - 1])
        j = cuts[c, j]
    return np.array(ends[::-1])


def breaks_by_group(df: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """Natural breaks of each group, over its distinct values and their counts: columns by and breaks."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    kind = dict(df.dtypes)[by]

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(value)
        return pd.DataFrame({by: [group[by].iloc[0]], "breaks": [natural_breaks(group[value].to_numpy(float), group["n"].to_numpy(float), k).tolist()]})

    return counts.groupBy(by).applyInPandas(cut, f"{by} {kind}, breaks array<double>")


def graded_by_breaks(df: DataFrame, breaks: DataFrame, by: str, value: str) -> DataFrame:
    """df with level from 1: breaks are the inclusive upper ends of the classes."""
    k = F.size("breaks")
    return df.join(F.broadcast(breaks), by).withColumn("level", F.least(1 + above(F.col("breaks"), F.col(value), strict=True), k).cast("int")).drop("breaks")


def break_grades(df: DataFrame, method: str, value: str, k: int, fixed: list[float] | None = None) -> DataFrame:
    """df with level by fixed cuts, equal frequency or natural breaks over all rows."""
    if method == "fixed":
        return df.withColumn("level", (band(F.col(value), fixed or []) + 1).cast("int"))
    if method == "quantile":
        cuts = edges(df, [], value, [i / k for i in range(1, k)])
        return df.crossJoin(F.broadcast(cuts)).withColumn("level", (1 + above(F.col("edges"), F.col(value))).cast("int")).drop("edges")
    if method == "natural":
        one = df.withColumn("__all", F.lit(1))
        return graded_by_breaks(one, breaks_by_group(one, "__all", value, k), "__all", value).drop("__all")
    raise ValueError(method)
