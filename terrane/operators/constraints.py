"""Checks that must hold before anything is computed, as queries of violations, and joins that state their cardinality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A table breaks a rule; the message names the rules and how many rows break each."""


def finite(c: str):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating columns with NaN as null."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def prediction_violations(df: DataFrame, key: str = "unit_id") -> DataFrame:
    """One row of counts: repeated ids, scores outside [0, 1] or missing, areas that aren't positive, labels other than 0 and 1, and missing classes."""
    p = df.agg(
        (F.count("*") - F.count_distinct(key)).alias("repeated_ids"),
        F.count_if(~F.coalesce(finite("p") & F.col("p").between(0, 1), F.lit(False))).alias("bad_scores"),
        F.count_if(~F.coalesce(finite("area") & (F.col("area") > 0), F.lit(False))).alias("bad_areas"),
        F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("bad_labels"),
        (2 - F.count_distinct(F.when(F.col("label").isin(0, 1), F.col("label")))).alias("missing_classes"),
    )
    return p


def grade_violations(scores: DataFrame, grades: DataFrame, key: str = "unit_id") -> DataFrame:
    """One row of counts: ids of one side alone, levels outside 1..5, scores that differ, tied scores of two levels, and levels whose ranges overlap."""
    j = scores.select(F.col(key).alias("a"), "p").join(grades.select(F.col(key).alias("b"), F.col("score").alias("s"), "level"), F.col("a") == F.col("b"), "full")
    base = j.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"), F.count_if(~F.coalesce(F.col("level").between(1, 5), F.lit(False))).alias("bad_levels"), F.count_if(F.abs(F.col("p") - F.col("s")) > 1e-8).alias("other_scores"))
    tied = grades.groupBy("score").agg(F.count_distinct("level").alias("k")).agg(F.count_if(F.col("k") > 1).alias("split_ties"))
    r = grades.groupBy("level").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    over = r.alias("x").join(F.broadcast(r.alias("y")), F.col("x.level") + 1 == F.col("y.level")).agg(F.count_if(F.col("x.hi") >= F.col("y.lo")).alias("overlaps"))
    return base.crossJoin(tied).crossJoin(over)


def require(violations: DataFrame) -> None:
    """Raise unless all counts of the one row are 0."""
    row = violations.first().asDict()
    if broken := {k: v for k, v in row.items() if v}:
        raise ConstraintError(", ".join(f"{k}: {v}" for k, v in broken.items()))


def key_violations(df: DataFrame, on: list[str]) -> int:
    return df.groupBy(*on).count().where("count > 1").count()


def checked_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner", cardinality: str = "one_to_one") -> DataFrame:
    """Join that raises if a side that must be unique on the key isn't."""
    left, right = cardinality.split("_to_")
    for side, name, rule in ((a, "left", left), (b, "right", right)):
        if rule == "one" and (n := key_violations(side, on)):
            raise ConstraintError(f"{n} keys repeat on the {name} side of a {cardinality} join")
    return a.join(b, on, how)


def lookup(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which every row of a must find one of b."""
    if n := a.join(b, on, "left_anti").count():
        raise ConstraintError(f"{n} rows find nothing")
    return checked_join(a, b, on, cardinality="many_to_one")


def set_difference(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Ids of one side alone, with that side's name; none if the sets are equal."""
    x, y = a.select(on).distinct(), b.select(on).distinct()
    return x.join(y, on, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, on, "left_anti").withColumn("side", F.lit("right")))


def dedup_conflicts(df: DataFrame, key: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(one row of each key, keys that hold different values). The rows kept have the least value."""
    g = df.groupBy(*key).agg(F.min(value).alias(value), F.count("*").alias("rows"), F.count_distinct(value).alias("values"))
    return g.where("values <= 1").drop("values", "rows"), g.where("values > 1").select(*key, "rows", "values")


def complete_population(all_ids: DataFrame, scores: DataFrame, key: str = "unit_id") -> DataFrame:
    """Every id of the population: those without a score get score 0, level 1 and label -1."""
    j = all_ids.join(scores.withColumn("__there", F.lit(True)), key, "left")
    there = F.col("__there").isNotNull()
    return j.select(key, F.when(there, F.col("p")).otherwise(0.0).alias("p"), F.when(there, F.col("level")).otherwise(1).alias("level"), F.when(there, F.col("label")).otherwise(-1).alias("label"))


def reconcile(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Of each column in two tables: comparable rows, largest and mean absolute difference, largest relative one, share equal, nulls on either side."""
    j = a.select(key, *columns).join(b.select(key, *[F.col(c).alias(f"__{c}") for c in columns]), key)
    long = j.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), F.col(f"__{c}").cast("double").alias("y")) for c in columns])).alias("v")).select("v.*")
    d = F.abs(F.col("x") - F.col("y"))
    return long.groupBy("column").agg(F.count(d).alias("n"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), F.max(d / F.greatest(F.abs("x"), F.lit(1e-12))).alias("max_rel"), F.avg(F.when(d.isNotNull(), (d == 0).cast("double"))).alias("equal"), F.count_if(F.col("x").isNull()).alias("nulls_left"), F.count_if(F.col("y").isNull()).alias("nulls_right"))


def partition_check(families: DataFrame, by: str, member: str, universe: DataFrame) -> DataFrame:
    """(by, member, times): members of the universe that a family covers not exactly once. Families are few; universe holds a member once.

    Every member gathers the families that it is in, so only violations are listed, never all pairs of family and member.
    """
    names = families.select(by).distinct().agg(F.collect_list(by).alias("__all"))
    n = families.groupBy(by, member).agg(F.count("*").alias("times"))
    seen = n.groupBy(member).agg(F.collect_list(F.struct(by, "times")).alias("__seen"))
    j = universe.select(member).join(seen, member, "left").crossJoin(F.broadcast(names))
    held = F.coalesce("__seen", F.array().cast(seen.schema["__seen"].dataType))
    absent = F.transform(F.array_except("__all", F.transform(held, lambda x: x[by])), lambda x: F.struct(x.alias(by), F.lit(0).cast("long").alias("times")))
    wrong = F.concat(F.filter(held, lambda x: x["times"] != 1), absent)
    return j.select(member, F.explode(wrong).alias("w")).select(F.col(f"w.{by}").alias(by), member, F.col("w.times").alias("times"))
