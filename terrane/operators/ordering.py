"""Running sums and ranks over groups of any size.

A window over one group runs in one task. Groups of up to ``WINDOW_ROWS`` rows are left to it. Beyond, rows are dealt by range of (group, order), every
partition adds up its own rows, and the sums of the partitions before it are added: a hot group, or no group at all, spreads over all tasks. Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import cut

WINDOW_ROWS = 2_000_000
UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def within(by: list[str]) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def largest_group(df: DataFrame, by: list[str]) -> int:
    return (df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) if by else df.count()


def joined(df: DataFrame, other: DataFrame, by: list[str], more: list[str] = (), how: str = "left") -> DataFrame:
    """Join on columns that may hold nulls; other's key columns are dropped."""
    keys = [*by, *more]
    if not keys:
        return df.crossJoin(F.broadcast(other))
    named = other.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(named, cond, how).drop(*[f"__k_{k}" for k in keys])


def cumulative(df: DataFrame, by: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """df with the running sums, each row included, in a total order within groups."""
    if largest_group(df, by) <= WINDOW_ROWS:
        w = within(by).orderBy(*order).rowsBetween(*UP_TO_HERE)
        return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    valued = df.withColumns({f"__v_{n}": c for n, c in sums.items()})
    parts = cut(valued.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__part", F.spark_partition_id()), "range")
    own = parts.groupBy(*by, "__part").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums])
    before = within(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select(*by, "__part", *[F.sum(f"__s_{n}").over(before).alias(f"__b_{n}") for n in sums])
    w = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(*UP_TO_HERE)
    local = parts.withColumns({n: F.sum(f"__v_{n}").over(w) for n in sums})
    out = joined(local, own, by, ["__part"])
    out = out.withColumns({n: F.col(n) + F.coalesce(F.col(f"__b_{n}"), F.lit(0)) for n in sums})
    return out.drop("__part", *[f"__{k}_{n}" for n in sums for k in "vb"])


def totals(df: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with the sums of each row's group, by an aggregate and a join."""
    return joined(df, df.groupBy(*by).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), by)


def average_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """df with the rank of a value in its group, ties averaged: from counts of each value, so that only distinct values are ordered."""
    counts = df.groupBy(*by, F.col(value)).agg(F.count("*").alias("__n"))
    ranked = cumulative(counts, by, [F.col(value)], {"__c": F.col("__n")})
    ranked = ranked.select(*by, value, (F.col("__c") - (F.col("__n") - 1) / 2).alias(name))
    return joined(df, ranked, by, [value])


def row_numbers(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    return cumulative(df, by, order, {name: F.lit(1).cast("long")})


def quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], name: str = "q", copies: str | None = None) -> DataFrame:
    """(by, name): exact, linearly interpolated quantiles of each group's values as an array; nulls are left out. copies: column that says how often a row counts.

    Values are counted, their counts added up in order, and each quantile's two neighbours picked by place: no task holds a group's values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg((F.sum(copies) if copies else F.count("*")).alias("__n"))
    counts = totals(counts, by, {"__all": F.col("__n")})
    counts = cumulative(counts, by, [F.col("__v")], {"__c": F.col("__n")})
    first = F.col("__c") - F.col("__n")
    picks = []
    for i, q in enumerate(qs):
        place = F.lit(float(q)) * (F.col("__all") - 1)
        for side, at in (("l", F.floor(place)), ("h", F.ceil(place))):
            picks.append(F.max(F.when((first <= at) & (at < F.col("__c")), F.col("__v").cast("double"))).alias(f"{side}{i}"))
    picked = counts.groupBy(*by).agg(F.max("__all").alias("__all"), *picks)
    values = []
    for i, q in enumerate(qs):
        place = F.lit(float(q)) * (F.col("__all") - 1)
        part = place - F.floor(place)
        values.append(F.when(F.col(f"l{i}") == F.col(f"h{i}"), F.col(f"l{i}")).otherwise((F.ceil(place) - place) * F.col(f"l{i}") + part * F.col(f"h{i}")))
    return picked.select(*by, F.array(*values).alias(name))
