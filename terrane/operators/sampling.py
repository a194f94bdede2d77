"""Folds, donors, contexts and matched samples, all drawn from SHA-256, so that any engine gives the same rows in any order.

Draws from an ordered list take the first 64 bits of a hash as a share of the list, in exact decimal arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.ordering import cumulative, joined, row_numbers, totals


def token(*parts) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def draw(hashed: Column, n: Column) -> Column:
    """Whole number in [0, n) from the first 64 bits of a hash."""
    top = F.conv(F.substring(hashed, 1, 16), 16, 10).cast("decimal(20,0)")
    return F.floor(top * n.cast("decimal(10,0)") / F.lit(2**64).cast("decimal(20,0)")).cast("long")


def exact_draw(hashed: str, n: str) -> Column:
    """As ``draw``, by integer division of decimals, named by columns."""
    return F.expr(f"cast(conv(substr({hashed}, 1, 16), 16, 10) as decimal(20,0)) * cast({n} as decimal(10,0)) div 18446744073709551616BD")


def reference_months(df: DataFrame, seed: int, protocol: str) -> DataFrame:
    """One reference month for each unit and outer fold: positives keep their own; negatives draw from the sorted months of positives outside the fold."""
    folds = df.select(F.col("fold").alias("outer")).distinct()
    month = F.trunc("event_date", "MM")
    donors = df.where("label = 1").select("fold", "unit_id", month.alias("month")).join(F.broadcast(folds), F.col("fold") != F.col("outer"))
    donors = row_numbers(totals(donors, ["outer"], {"n": F.lit(1).cast("long")}), ["outer"], [F.col("month"), F.col("unit_id")], "k")
    donors = donors.select("outer", "month", (F.col("k") - 1).alias("k"), "n")
    sizes = donors.groupBy("outer").agg(F.max("n").alias("n"))
    pairs = df.join(F.broadcast(folds)).join(F.broadcast(sizes), "outer").withColumn("h", token(seed, protocol, F.col("outer"), F.col("unit_id")))
    pairs = pairs.withColumn("k", exact_draw("h", "n"))
    out = pairs.join(donors.select("outer", "k", F.col("month").alias("drawn")), ["outer", "k"], "left")
    role = F.when(F.col("fold") == F.col("outer"), "test").otherwise("train")
    return out.select("outer", "unit_id", role.alias("role"), F.when(F.col("label") == 1, month).otherwise(F.col("drawn")).alias("reference_month"))


def context_fill(df: DataFrame, size: int, seed: int) -> DataFrame:
    """For each outer fold a context of ``size`` training units: all positives, and the background of least hash."""
    folds = df.select(F.col("fold").alias("outer")).distinct()
    train = df.join(F.broadcast(folds), F.col("fold") != F.col("outer")).withColumn("h", token("context", seed, F.col("outer"), F.col("unit_id")))
    train = row_numbers(train, ["outer"], [F.desc("label"), F.when(F.col("label") == 0, F.col("h")), F.col("unit_id")], "rank")
    return train.where(F.col("rank") <= size).select("outer", "unit_id", "label")


def strip_folds(df: DataFrame, k: int) -> DataFrame:
    """Contiguous strips by (x, y, id), as equal in number as can be."""
    d = row_numbers(totals(df.select("unit_id", "x", "y"), [], {"n": F.lit(1).cast("long")}), [], [F.col("x"), F.col("y"), F.col("unit_id")], "rn")
    return d.select("unit_id", F.floor((F.col("rn") - 1) * k / F.col("n")).cast("int").alias("strip"))


def fold_roles(df: DataFrame) -> DataFrame:
    """Every unit in every outer view, as test in its own fold's and train in the others."""
    folds = df.select(F.col("fold").alias("outer")).distinct()
    return df.join(F.broadcast(folds)).select("outer", "unit_id", F.when(F.col("fold") == F.col("outer"), "test").otherwise("train").alias("role"))


def balanced_groups(counts: list[tuple[str, int]], k: int) -> dict[str, int]:
    """Groups by falling number of positives, then name, each to the fold with the fewest so far."""
    load, out = [0] * k, {}
    for name, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        fold = min(range(k), key=lambda i: (load[i], i))
        out[name] = fold
        load[fold] += n
    return out


def admin_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Folds of whole groups balanced by positives. The groups are administrative: few; their counts come to the driver."""
    counts = [(r[0], r[1]) for r in df.groupBy(group).agg(F.sum("label")).collect()]
    table = df.sparkSession.createDataFrame(sorted(balanced_groups(counts, k).items()), f"{group} string, admin_fold int")
    return df.join(F.broadcast(table), group).select("unit_id", group, "admin_fold")


def ratio_sizes(positives: int, background: int, ratio: str) -> tuple[str, int]:
    """Canonical ratio p:n and the background it needs for all positives: nearest whole number, ties up. Never clipped: too large is an error."""
    p, n = (int(x) for x in ratio.split(":"))
    if p <= 0 or n <= 0:
        raise ValueError("a ratio has two positive parts")
    g = math.gcd(p, n)
    p, n = p // g, n // g
    size = (2 * positives * n + p) // (2 * p)
    if size > background:
        raise ValueError(f"{p}:{n} needs {size} background rows; there are {background}")
    return f"{p}:{n}", size


def subsample_plan(df: DataFrame, size: int, members: int, seed: int) -> DataFrame:
    """For each member all positives and other background without replacement, up to size."""
    d = df.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1)))).withColumn("h", token("member", seed, F.col("member"), F.col("unit_id")))
    d = row_numbers(d, ["member"], [F.desc("label"), F.when(F.col("label") == 0, F.col("h")), F.col("unit_id")], "rank")
    return d.where(F.col("rank") <= size).select("member", "unit_id", "label")


def case_control(df: DataFrame, stratum: list[str], k: int, seed: int) -> DataFrame:
    """Each positive with up to k negatives of its stratum, dealt in hash order without replacement."""
    d = df.withColumn("h", token("match", seed, F.col("unit_id")))
    d = row_numbers(d, [*stratum, "label"], [F.col("h"), F.col("unit_id")], "rn")
    pos = d.where("label = 1").select(*stratum, F.col("unit_id").alias("case_id"), F.col("rn").alias("turn"))
    neg = d.where("label = 0").select(*stratum, F.col("unit_id").alias("control_id"), F.ceil(F.col("rn") / k).alias("turn"))
    return pos.join(neg, [*stratum, "turn"]).select(*stratum, "case_id", "control_id")


def far_supplement(df: DataFrame, matched: DataFrame, size: Column, seed: int) -> DataFrame:
    """(control_id): further negatives from anywhere, those of least hash among the ones not matched (control_id). size: how many, of the table's own counts positives and matched."""
    counts = df.agg(F.sum("label").alias("positives")).crossJoin(F.broadcast(matched.agg(F.count_distinct("control_id").alias("matched"))))
    free = df.where("label = 0").select(F.col("unit_id").alias("control_id")).join(matched.select("control_id").distinct(), "control_id", "left_anti")
    ranked = row_numbers(free.withColumn("__h", token("far", seed, F.col("control_id"))), [], [F.col("__h"), F.col("control_id")], "__rank")
    return ranked.crossJoin(F.broadcast(counts.select(size.alias("__size")))).where(F.col("__rank") <= F.col("__size")).select("control_id")


def donor_order(df: DataFrame, stratum: list[str], least: int, seed: int) -> DataFrame:
    """A permutation of units within strata of at least ``least`` units; others keep themselves."""
    d = totals(df.select("unit_id", *stratum, token("donor", seed, F.col("unit_id")).alias("h")), stratum, {"n": F.lit(1).cast("long")})
    d = row_numbers(row_numbers(d, stratum, [F.col("unit_id")], "place"), stratum, [F.col("h"), F.col("unit_id")], "turn")
    donors = d.select(*stratum, F.col("turn").alias("place"), F.col("unit_id").alias("donor"))
    return d.join(donors, [*stratum, "place"]).select("unit_id", F.when(F.col("n") >= least, F.col("donor")).otherwise(F.col("unit_id")).alias("donor_id"))


def weighted_draws(df: DataFrame, key: str, order: list[str], k: int, seed: int) -> DataFrame:
    """k draws with replacement from each bag in proportion to weight: hash numbers against the running weight. (key, draw, the drawn row's order columns).

    A bag's k numbers are hashed once and go with its total to its rows; running weights are dealt by range where a bag is large.
    """
    number = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("bag"), F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    draws = F.sequence(F.lit(0), F.lit(k - 1))
    bags = df.groupBy(key).agg(F.sum("weight").alias("total")).withColumn("at", F.transform(draws, lambda i: number(i) * F.col("total")))
    d = cumulative(df, [key], [F.col(c) for c in order], {"hi": F.col("weight")}).withColumn("lo", F.col("hi") - F.col("weight"))
    hits = F.filter(draws, lambda i: (F.get("at", i) >= F.col("lo")) & (F.get("at", i) < F.col("hi")))
    return joined(d, bags, [key], how="inner").withColumn("draw", F.explode(hits)).select(key, "draw", *order)


def permuted(df: DataFrame, key: str, columns: list[str], seed: int, by: list[str] | None = None) -> DataFrame:
    """df with a block of columns permuted together by hash order."""
    by = by or []
    d = row_numbers(df.withColumn("__h", token("permute", seed, F.col(key))), by, [F.col(key)], "__place")
    d = row_numbers(d, by, [F.col("__h"), F.col(key)], "__turn").drop("__h")
    block = d.select(*by, F.col("__turn").alias("__place"), *columns)
    return d.drop(*columns, "__turn").join(block, [*by, "__place"]).drop("__place")


def kmeans_folds(df: DataFrame, k: int, seed: int) -> DataFrame:
    """Folds by k-means of (x, y), numbered by their centres from left to right."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    d = VectorAssembler(inputCols=["x", "y"], outputCol="__xy").transform(df.select("unit_id", "x", "y"))
    model = KMeans(k=k, seed=seed, featuresCol="__xy", predictionCol="__c").fit(d)
    order = sorted(range(len(model.clusterCenters())), key=lambda i: tuple(model.clusterCenters()[i]))
    number = F.create_map(*[F.lit(v) for new, old in enumerate(order) for v in (old, new)])
    return model.transform(d).select("unit_id", F.element_at(number, F.col("__c")).alias("fold"))
