"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import materialise


def with_least(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with m, the least b of each a. Least ones are combined before they are shuffled; a node of very many pairs is split by Spark's skew join."""
    return pairs.join(pairs.groupBy("a").agg(F.min("b").alias("m")), "a")


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): for every node of an edge, the least node that it is connected with.

    Nodes are of any type with an order, structs too. Null ends and loops are left out. Each round is written to the shared scratch
    folder; the driver sees a count and a checksum only. The number of rounds grows with the logarithm of the diameter.
    """
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"), F.col(u).isNotNull().alias("x"), F.col(v).isNotNull().alias("y"))
    e = materialise(e.where("x AND y AND a > b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        both = with_least(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = both.select(F.greatest("a", "b").alias("a"), F.least("a", "m").alias("b")).where("a > b").distinct()
        small = with_least(large)
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        e = materialise(small.where("a > b").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now[0] == 0 or now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
