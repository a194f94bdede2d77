"""Nearest, radius and k-nearest joins on plane coordinates by grid cells, and neighbour statistics.

Points meet through equal cells (a grid's, or a quadtree's), never through a bare distance condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.ordering import joined, quantiles
from terrane.session import cut

EARTH_KM = 6371.0088
#: Points that a cell of the last level may hold, and how many levels there may be.
FULL = 4
DEPTH = 20


def distance(x1, y1, x2, y2) -> Column:
    """Plane distance of two points, of columns or names."""
    x1, y1, x2, y2 = (F.col(c) if isinstance(c, str) else c for c in (x1, y1, x2, y2))
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle kilometres."""
    lon1, lat1, lon2, lat2 = (F.radians(c) for c in (lon1, lat1, lon2, lat2))
    s = F.pow(F.sin((lat2 - lat1) / 2), F.lit(2)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(s, F.lit(1.0))))


def cell(x, size: float) -> Column:
    return F.floor(F.col(x) / size) if isinstance(x, str) else F.floor(x / size)


def around(df: DataFrame, size: float, rings: int = 1) -> DataFrame:
    """df once for each cell within so many rings of its own: columns cx, cy."""
    steps = F.sequence(F.lit(-rings), F.lit(rings))
    return df.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).withColumns({"cx": cell("x", size) + F.col("dx"), "cy": cell("y", size) + F.col("dy")}).drop("dx", "dy")


def radius_join(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs (a_id, b_id, dist) within a radius, of different ids. a, b: id, x, y."""
    left = around(a, radius).select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy")
    right = b.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x", radius).alias("cx"), cell("y", radius).alias("cy"))
    pairs = left.join(right, ["cx", "cy"]).where("a_id <> b_id").withColumn("dist", distance("ax", "ay", "bx", "by"))
    return pairs.where(F.col("dist") <= radius).select("a_id", "b_id", "dist")


def nearest(a: DataFrame, b: DataFrame, k: int = 1, other: bool = True) -> DataFrame:
    """The k nearest of b (id, x, y) for each row of a, by distance and then id: (a_id, b_id, dist, rank). other: never the row of the same id.

    Work is done once for each place of a, and of b only the least ids of a place take part (as many as a result can hold), so that a third of all rows at one place cost no more than a few.
    Both sides fall into the cells of a quadtree, and go down it at once: of a cell's children and those of the cells that it still has to do with, pairs are dropped whose least distance exceeds the
    largest one within which enough points lie for sure. Cells of the last level hold ``FULL`` points of b and a few at most, unless ``DEPTH`` levels don't suffice, and only points of the pairs left are compared.
    So dense and empty regions cost about the same, wherever the points of a lie.
    """
    want = k + 1 if other else k
    least = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    b = cut(b.select("id", "x", "y").withColumn("__n", least).where(F.col("__n") <= want).drop("__n"), "places")
    ends = a.select("x", "y").unionByName(b.select("x", "y")).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span")).first()
    span = max(ends.span or 0.0, 1e-300) * 1.000001
    index = lambda c, low: F.floor((F.col(c) - F.lit(float(low or 0.0))) / F.lit(span) * F.lit(float(1 << DEPTH))).cast("long")
    b = b.withColumns({"cx": index("x", ends.x), "cy": index("y", ends.y)})
    places = cut(a.select("x", "y").distinct().withColumns({"cx": index("x", ends.x), "cy": index("y", ends.y)}), "places")
    steps = b.select("cx", "cy", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("step"))
    full = steps.groupBy("step", F.expr("shiftright(cx, step)").alias("cx"), F.expr("shiftright(cy, step)").alias("cy")).count().groupBy("step").agg(F.max("count").alias("n"))
    counts = {r.step: r.n for r in full.collect()}
    last = max((i for i, n in counts.items() if n <= FULL + 2 * want), default=0 if counts else DEPTH)
    level = lambda df, step, n: df.groupBy(F.shiftright("cx", step).alias(f"{n}x"), F.shiftright("cy", step).alias(f"{n}y"))
    up = DEPTH
    pairs = a.sparkSession.createDataFrame([(0, 0, 0, 0)], "ax long, ay long, bx long, by long")
    while up > last:
        step = max(last, up - (4 if up == DEPTH else 1))
        own = level(places, step, "a").agg(F.lit(1)).select("ax", "ay", F.shiftright("ax", up - step).alias("pax"), F.shiftright("ay", up - step).alias("pay"))
        others = level(b, step, "b").agg(F.count("*").alias("n")).withColumns({"pbx": F.shiftright("bx", up - step), "pby": F.shiftright("by", up - step)})
        pairs = pairs.toDF("pax", "pay", "pbx", "pby").join(own, ["pax", "pay"]).join(others, ["pbx", "pby"])
        dx, dy = F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))
        gx, gy = F.greatest(dx - 1, F.lit(0)), F.greatest(dy - 1, F.lit(0))
        pairs = pairs.withColumns({"near": gx * gx + gy * gy, "far": (dx + 1) * (dx + 1) + (dy + 1) * (dy + 1)})
        w = Window.partitionBy("ax", "ay")
        pairs = pairs.withColumn("sure", F.sum("n").over(w.orderBy("far")))
        pairs = pairs.withColumn("bound", F.min(F.when(F.col("sure") >= want, F.col("far"))).over(w))
        pairs = pairs.where(F.col("bound").isNull() | (F.col("near") <= F.col("bound"))).select("ax", "ay", "bx", "by")
        up = step
        if (DEPTH - up) % 4 == 0 and up > last:
            pairs = cut(pairs, "pairs")
    at = lambda df, n: df.withColumns({f"{n}x": F.shiftright("cx", last), f"{n}y": F.shiftright("cy", last)}).drop("cx", "cy")
    met = at(places.withColumnsRenamed({"x": "px", "y": "py"}), "a").join(pairs, ["ax", "ay"])
    met = met.join(at(b.withColumnsRenamed({"id": "b_id", "x": "qx", "y": "qy"}), "b"), ["bx", "by"]).withColumn("dist", distance("px", "py", "qx", "qy"))
    rank = F.row_number().over(Window.partitionBy("px", "py").orderBy("dist", "b_id"))
    found = met.withColumn("rank", rank).where(F.col("rank") <= want)
    near = found.groupBy("px", "py").agg(F.sort_array(F.collect_list(F.struct("dist", "b_id"))).alias("near"))
    out = a.select(F.col("id").alias("a_id"), F.col("x").alias("px"), F.col("y").alias("py")).join(near, ["px", "py"])
    kept = F.filter("near", lambda m: m["b_id"] != F.col("a_id")) if other else F.col("near")
    out = out.select("a_id", F.posexplode(F.slice(kept, 1, k)).alias("at", "m"))
    return cut(out.select("a_id", F.col("m.b_id").alias("b_id"), F.col("m.dist").alias("dist"), (F.col("at") + 1).alias("rank")), "nearest")


def morans_i(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Moran's I of values (id, z) under row-normalised, symmetrised neighbour edges (a_id, b_id)."""
    both = edges.select("a_id", "b_id").unionByName(edges.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))).distinct()
    mean = values.agg(F.avg("z").alias("m"))
    v = values.crossJoin(F.broadcast(mean)).select("id", (F.col("z") - F.col("m")).alias("c"))
    lag = both.join(v.withColumnRenamed("id", "b_id"), "b_id").groupBy(F.col("a_id").alias("id")).agg(F.avg("c").alias("lag"))
    joined = v.join(lag, "id", "left")
    s = joined.agg(F.sum(F.col("c") * F.coalesce("lag", F.lit(0.0))).alias("num"), F.sum(F.col("c") * F.col("c")).alias("den"), F.count("*").alias("n"), F.count("lag").alias("w"))
    return s.select("n", F.when((F.col("den") > 0) & (F.col("w") > 0), F.col("n") / F.col("w") * F.col("num") / F.col("den")).alias("moran"))


def support_profile(df: DataFrame, radius: float) -> DataFrame:
    """(fold, n, median_positive, within): how far the units of each fold (id, x, y, label, fold) are from the nearest positive of the other folds, and the share of them within a radius.

    All folds are searched at once: each has a copy of the plane, so far from the others' that its own positives are always nearer. A fold without positives elsewhere has nulls.
    """
    edge = df.agg(F.max("x").alias("x1"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.min("y").alias("y0")).first()
    if edge.x0 is None:
        return df.groupBy("fold").agg(F.count("*").alias("n")).select("fold", "n", F.lit(None).cast("double").alias("median_positive"), F.lit(None).cast("double").alias("within"))
    step = 2.0 * (edge.x1 - edge.x0) + (edge.y1 - edge.y0) + 1  # other planes lie farther away than any two points of one plane
    folds = df.select(F.col("fold").alias("plane")).distinct()
    planes = folds.withColumn("shift", F.row_number().over(Window.orderBy("plane")) * F.lit(step))  # folds are few
    at = lambda d: d.select(F.struct("plane", "id").alias("id"), (F.col("x") + F.col("shift")).alias("x"), "y")
    own = df.join(F.broadcast(planes), F.col("fold") == F.col("plane"))
    positives = df.where("label = 1").join(F.broadcast(planes), F.col("fold") != F.col("plane"))
    near = nearest(at(own), at(positives), other=False).where("a_id.plane = b_id.plane").select(F.col("a_id.id").alias("id"), F.col("b_id.id").alias("b_id"))
    ends = near.join(df.select("id", "fold", "x", "y"), "id").join(df.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by")), "b_id")
    out = cut(ends.select("fold", distance("x", "y", "bx", "by").alias("dist")), "support")
    share = out.groupBy("fold").agg(F.avg((F.col("dist") < radius).cast("double")).alias("within"))
    found = joined(share, quantiles(out, ["fold"], "dist", [0.5]), ["fold"])
    return joined(df.groupBy("fold").agg(F.count("*").alias("n")), found, ["fold"]).select("fold", "n", F.col("q")[0].alias("median_positive"), "within")


def neighbour_mean(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Mean of the values of a node's sources (src -> dst); 0 without any."""
    m = edges.join(values.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.avg("z").alias("mean"))
    return values.select("id").join(m, "id", "left").select("id", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def boxes_overlap(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs (a_id, b_id) of boxes (id, x0, y0, x1, y1) that touch or overlap. Boxes meet in grid cells; a pair counts in the first cell they share."""
    grid = lambda d, p: d.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor(F.col("y1") / size)))).select("cx", "cy", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "x0", "y0", "x1", "y1")])
    pairs = grid(a, "a").join(grid(b, "b"), ["cx", "cy"])
    meet = (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
    first = (F.col("cx") == F.floor(F.greatest("a_x0", "b_x0") / size)) & (F.col("cy") == F.floor(F.greatest("a_y0", "b_y0") / size))
    return pairs.where(meet & first).select("a_id", "b_id")
