"""Embedding near-duplicates by dual traversal of cover trees: exact pairs of cosine similarity at least ``threshold``.

Vectors are scaled to length one, where cosine s is Euclidean distance sqrt(2 - 2 s). Each label is a space of its own. Equal vectors of
a label are one point with a count.

The upper levels of the tree are distributed. A label is one cell at first; every cell of more than ``BLOCK`` points is split, in rounds: centres are chosen farthest-first from a bounded
sample of the cell's points, every point joins its nearest centre's cell, and a cell keeps the radius that covers all its points. Cells that are smaller, or tight, are
leaves. The traversal goes down from the pairs of roots, level by level, as joins of pairs of cells with their children: a pair of cells is dropped if the distance of their centres exceeds
the sum of their radii and the threshold's distance, as then no pair of theirs can be near (triangle inequality). A pair of leaves whose distance and radii together stay within the threshold's
distance is linked as a whole, without looking at its points, so that large groups of near copies cost no more than their number. The points of all other pairs of leaves meet, in blocks of bounded size.

Within a task, both blocks grow the lower levels: radii are halved from level to level, every level holds the centres of the one above and more, a node keeps the radius that covers its points.
The traversal goes on from the pair of roots to pairs of children, drops pairs by the same bound, and computes the cosines of the points of pairs of leaves that are left, in double precision.

Tasks yield, for each point, its count of links, and a spanning forest of the links, never pairs. Components are found by distributed rounds. The driver sees counts only.

Vectors that no radius separates (random directions, whose distances are all alike) leave all pairs of leaves of their label to be compared, in blocks: exactness then costs work with the square of
a label's points.

Nulls and edges: vectors that are null, zero, hold nulls or non-finite components, or are of another length than most, or have no label, link with nothing and are their own component. Rows
that repeat an id are separate vectors of one point or of several; each gets a row. Null ids get component null unless linked with others. Extra columns play no role.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.additive import matrix, vectors
from terrane.llm.chosenpath import forest
from terrane.llm.common import grouped, materialise
from terrane.llm.components import components

THRESHOLD = 0.93
#: Points of a leaf of the distributed levels, and of a block.
BLOCK = 2048
#: Expected number of points of a cell that its centres are chosen from, and most centres of a cell.
SAMPLE = 2048
FAN = 32
#: Points of a cell that one task deals to its children.
DEAL = 32_768
#: Distributed levels at most; cells that are still larger are cut into blocks.
DEPTH = 9
_SLACK = 1e-7


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]


def apart(cosine: np.ndarray) -> np.ndarray:
    """Distance of unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def farthest_first(x: np.ndarray):
    """Rows of unit vectors, each the farthest from those before it: (distance from them, row, owner). owner: of every point the number of the nearest row before this one; changes afterwards."""
    near, owner = np.full(len(x), -2.0), np.zeros(len(x), np.int64)
    gap, i = math.inf, 0
    for k in range(len(x)):
        yield gap, i, owner
        s = x @ x[i]
        closer = s > near
        closer[i] = True
        owner[closer], near[closer] = k, s[closer]
        near[i] = 2.0  # never another's, whatever is rounded
        i = int(near.argmin())
        gap = float(apart(near[i]))


class Tree:
    """Levels over unit vectors, the root first, with radii halved from level to level. Of each level: the rows of its nodes' centres, their covering radii, and their children's numbers in the
    next level. Of each leaf (node of the last level): its points. Ends at ``finest``, or where a fourth of the points are centres, as nothing is gained below."""

    def __init__(self, x: np.ndarray, finest: float):
        self.x = x
        most, limit = max(1, len(x) // 4), 1.0
        centres: list[int] = []
        cuts: list[tuple[int, np.ndarray]] = []
        for gap, i, owner in farthest_first(x):
            last = len(centres) == most or gap <= finest
            if len(centres) == 1 or centres and gap <= limit or last:
                if not cuts or cuts[-1][0] < len(centres):
                    cuts.append((len(centres), owner.copy()))
            if last:
                break
            while gap <= limit:  # which ends, as gap is above finest here
                limit /= 2
            centres.append(i)
        else:
            cuts.append((len(centres), np.zeros(len(x), np.int64)))  # a single point
        ids, place = np.array(centres), cuts[-1][1]
        self.points = _members(place, cuts[-1][0])
        self.levels: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        kids: list[np.ndarray] = []
        for depth in range(len(cuts) - 1, -1, -1):
            n = cuts[depth][0]
            radius = np.zeros(n)
            np.maximum.at(radius, place, apart(np.einsum("nd,nd->n", x, x[ids[place]])))
            self.levels.insert(0, (ids[:n], radius, kids))
            if depth:
                up = cuts[depth - 1][1][ids[:n]]
                kids, place = _members(up, cuts[depth - 1][0]), up[place]


def _members(owner: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(owner, kind="stable")
    return np.split(order, np.searchsorted(owner[order], np.arange(1, n)))


def descend(a: Tree, b: Tree, reach: float) -> tuple[list[np.ndarray], int]:
    """Of each leaf of a, the leaves of b that may hold points within reach of its own; and the number of pairs of nodes looked at."""
    partners, seen = [np.zeros(1, np.int64)], 1
    for depth in range(1, max(len(a.levels), len(b.levels))):
        fresh_a, fresh_b = depth < len(a.levels), depth < len(b.levels)
        ia, ra = a.levels[min(depth, len(a.levels) - 1)][:2]
        ib, rb = b.levels[min(depth, len(b.levels) - 1)][:2]
        below: list = [None] * len(ia)
        for parent, others in enumerate(partners):
            mine = a.levels[depth - 1][2][parent] if fresh_a else np.array([parent])
            theirs = np.concatenate([b.levels[depth - 1][2][j] for j in others]) if fresh_b and len(others) else others
            near = apart(a.x[ia[mine]] @ b.x[ib[theirs]].T) <= ra[mine][:, None] + rb[theirs] + reach + _SLACK
            seen += near.size
            for i, row in zip(mine, near, strict=True):
                below[i] = theirs[row]
        partners = below
    return partners, seen


def linked(va: np.ndarray, vb: np.ndarray | None, threshold: float) -> tuple[np.ndarray, int]:
    """Which pairs of rows of va and vb (or of va alone, not of a row with itself) have cosine >= threshold; and the number of pairs of nodes and points looked at."""
    norm = lambda v: np.sqrt(np.einsum("nd,nd->n", v, v))
    reach = math.sqrt(2 - 2 * threshold)
    na = norm(va)
    a = Tree(va / na[:, None], reach / 4)
    b, nb, wb = (a, na, va) if vb is None else (Tree(vb / norm(vb)[:, None], reach / 4), norm(vb), vb)
    ok = np.zeros((len(va), len(wb)), bool)
    partners, seen = descend(a, b, reach)
    for mine, others in zip(a.points, partners, strict=True):
        if not len(others):
            continue
        theirs = np.concatenate([b.points[j] for j in others])
        close = a.x[mine] @ b.x[theirs].T >= threshold - 1e-9
        seen += close.size
        i, j = np.nonzero(close)
        p, q = mine[i], theirs[j]
        hit = np.einsum("nd,nd->n", va[p], wb[q]) / (na[p] * nb[q]) >= threshold
        ok[p[hit], q[hit]] = True
    if vb is None:
        np.fill_diagonal(ok, False)
    return ok, seen


def split(live: DataFrame, big: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children of big cells: their centres (label, cell, child, v), and live's points dealt to them (label, cell, pid, copies, v, dist)."""
    drawn = F.xxhash64(F.lit(73), "pid").bitwiseAND(F.lit(2**62 - 1)) < F.lit(float(2**62) * SAMPLE) / F.col("n")
    sampled = live.join(big, ["label", "cell"]).where(drawn | (F.col("pid") == F.col("first")))
    sampled = sampled.select("label", "cell", "n", "pid", "v").repartition("label", "cell").sortWithinPartitions("label", "cell", "pid")

    def choose(batches):
        for (label, cell), t in grouped(batches, ["label", "cell"]):
            v = matrix(t.column("v"))
            most = min(FAN, 2 * -(-t.column("n")[0].as_py() // BLOCK))
            rows = [i for gap, i, _ in itertools.islice(farthest_first(unit(v)), most) if gap > 1e-6]
            n = len(rows)
            key = t.column("label").slice(0, 1).combine_chunks().take(pa.array([0] * n))
            yield pa.RecordBatch.from_arrays([key, pa.array([cell] * n, pa.int64()), pa.array([cell * 64 + k + 1 for k in range(n)], pa.int64()), pa.array([v[i].tobytes() for i in rows], pa.binary())], ["label", "cell", "child", "v"])

    kind = live.schema["label"].dataType
    centres = sampled.mapInArrow(choose, T.StructType([T.StructField("label", kind), T.StructField("cell", T.LongType()), T.StructField("child", T.LongType()), T.StructField("v", T.BinaryType())]))
    centres = materialise(centres, "centres")
    deals = big.select("label", "cell", F.ceil(F.col("n") / DEAL).cast("int").alias("deals"))
    dealt = centres.join(deals, ["label", "cell"]).select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(0).alias("kind"), F.col("child").alias("pid"), F.lit(0).cast("long").alias("copies"), "v")
    mine = live.join(deals, ["label", "cell"]).select("label", "cell", F.pmod(F.xxhash64(F.lit(79), "pid"), F.col("deals")).cast("int").alias("deal"), F.lit(1).alias("kind"), "pid", "copies", "v")
    rows = dealt.unionByName(mine).repartition("label", "cell", "deal").sortWithinPartitions("label", "cell", "deal", "kind", "pid")

    def deal(batches):
        for _, t in grouped(batches, ["label", "cell", "deal"]):
            cut = int(np.searchsorted(t.column("kind").to_numpy(), 1))
            child, v = t.column("pid").to_numpy()[:cut], unit(matrix(t.column("v")))
            s = v[cut:] @ v[:cut].T
            own = t.slice(cut)
            out = pa.table([own.column("label"), pa.array(child[s.argmax(1)] if len(s) else child[:0]), own.column("pid"), own.column("copies"), own.column("v"), pa.array(apart(s.max(1)) if len(s) else np.zeros(0))], ["label", "cell", "pid", "copies", "v", "dist"])
            yield from out.to_batches(4096)

    placed = rows.mapInArrow(deal, T.StructType([live.schema["label"], live.schema["cell"], live.schema["pid"], live.schema["copies"], live.schema["v"], T.StructField("dist", T.DoubleType())]))
    return centres, materialise(placed, "cells")


def grown(points: DataFrame, reach: float) -> tuple[DataFrame, list[DataFrame]]:
    """Points in their leaves (label, cell, pid, copies, v), and for each level that was split the children (label, parent, cell, c, r): their centres and covering radii."""
    live = points.withColumns({"cell": F.lit(0).cast("long"), "dist": F.lit(2.0)}).select("label", "cell", "pid", "copies", "v", "dist")
    leaves, levels, centres = [], [], None
    for depth in range(DEPTH + 1):
        sizes = live.groupBy("label", "cell").agg(F.count("*").alias("n"), F.max("dist").alias("r"), F.min("pid").alias("first"))
        sizes = materialise(sizes, "sizes")
        if centres is not None:
            levels.append(materialise(centres.join(sizes.withColumnRenamed("cell", "child"), ["label", "child"]).select("label", F.col("cell").alias("parent"), F.col("child").alias("cell"), F.col("v").alias("c"), "r"), "level"))
        big = sizes.where((F.col("n") > BLOCK) & (F.col("r") > reach / 4)).select("label", "cell", "n", "first")
        if depth == DEPTH or big.isEmpty():
            leaves.append(live)
            break
        leaves.append(live.join(big, ["label", "cell"], "left_anti"))
        centres, live = split(live.join(big, ["label", "cell"], "left_semi"), big)
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out.drop("dist"), levels


def leaf_pairs(points: DataFrame, levels: list[DataFrame], reach: float) -> DataFrame:
    """(label, a, b, whole): pairs of leaves that may hold near points, a = b too, each once; whole: all their points are near each other."""
    pairs = points.select("label").distinct().select("label", *[F.lit(0).cast("long").alias(x) for x in "ab"], *[F.lit(None).cast(t).alias(f"{n}{x}") for x in "ab" for n, t in (("c", "binary"), ("r", "double"))])
    pairs = pairs.withColumn("whole", F.lit(False))

    def bound(batches):
        for b in batches:
            if not b.num_rows:
                continue
            known = np.flatnonzero(b.column("ca").is_valid().to_numpy(zero_copy_only=False) & b.column("cb").is_valid().to_numpy(zero_copy_only=False))
            keep, whole = np.ones(b.num_rows, bool), np.zeros(b.num_rows, bool)
            if len(known):
                t = b.take(pa.array(known))
                d = apart(np.einsum("nd,nd->n", unit(matrix(t.column("ca"))), unit(matrix(t.column("cb")))))
                d[t.column("a").to_numpy() == t.column("b").to_numpy()] = 0
                r = t.column("ra").to_numpy() + t.column("rb").to_numpy()
                keep[known], whole[known] = d <= r + reach + _SLACK, d + r <= reach - _SLACK
            out = b.set_column(b.schema.get_field_index("whole"), "whole", pa.array(whole))
            yield out.filter(pa.array(keep))

    for level in levels:
        kids = lambda x: level.select("label", F.col("parent").alias(f"{x}0"), F.col("cell").alias(f"{x}1"), F.col("c").alias(f"c{x}1"), F.col("r").alias(f"r{x}1"))  # noqa: E731, B023
        wide = pairs.withColumnsRenamed({"a": "a0", "b": "b0"}).join(kids("a"), ["label", "a0"], "left").join(kids("b"), ["label", "b0"], "left")
        wide = wide.withColumns({x: F.coalesce(f"{x}1", f"{x}0") for x in "ab"}).where("a0 <> b0 OR a <= b")
        wide = wide.select("label", "a", "b", *[F.coalesce(f"{n}{x}1", f"{n}{x}").alias(f"{n}{x}") for x in "ab" for n in "cr"], "whole")
        pairs = materialise(wide.select(pairs.columns).mapInArrow(bound, pairs.schema), "pairs")
    return pairs.select("label", "a", "b", "whole")


def links(points: DataFrame, threshold: float) -> DataFrame:
    """(u, v, n): rows with v null give the links n that point u has in one task; others are edges of spanning forests."""
    reach = math.sqrt(2 - 2 * threshold)
    placed, levels = grown(points, reach)
    pairs = leaf_pairs(placed, levels, reach)
    cells = placed.groupBy("label", "cell").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.min("pid").alias("rep"))
    cells = materialise(cells.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "leaves")
    own = lambda x: cells.select("label", *[F.col(c).alias(f"{x}_{c}") for c in ("cell", "copies", "rep", "blocks")])
    pairs = materialise(pairs.join(own("a").withColumnRenamed("a_cell", "a"), ["label", "a"]).join(own("b").withColumnRenamed("b_cell", "b"), ["label", "b"]), "leafpairs")

    # Pairs of leaves that are near as a whole: every point gets the partner's copies, and an edge to the partner's least point.
    whole = pairs.where("whole")
    gains = whole.select("label", F.col("a").alias("cell"), F.col("b_copies").alias("n"), F.col("b_rep").alias("hub"), (F.col("a") == F.col("b")).alias("self"))
    gains = gains.unionByName(whole.where("a <> b").select("label", F.col("b").alias("cell"), F.col("a_copies").alias("n"), F.col("a_rep").alias("hub"), F.lit(False).alias("self")))
    gains = gains.groupBy("label", "cell").agg(F.sum("n").alias("n"), F.min("hub").alias("hub"), F.max("self").alias("self"))
    gained = placed.drop("v").join(gains, ["label", "cell"])
    counted = gained.select(F.col("pid").alias("u"), F.lit(None).cast("long").alias("v"), (F.col("n") - F.when(F.col("self"), F.col("copies")).otherwise(0)).alias("n")).where("n > 0")
    joined = gained.where("pid <> hub").select(F.col("pid").alias("u"), F.col("hub").alias("v"), F.lit(0).cast("long").alias("n"))
    joined = joined.unionByName(whole.where("a <> b").select(F.col("a_rep").alias("u"), F.col("b_rep").alias("v"), F.lit(0).cast("long").alias("n")))

    # The others' points meet, block by block.
    some = pairs.where("NOT whole").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1)))
    low = F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(F.lit(0))
    some = some.withColumn("j", F.explode(F.sequence(low, F.col("b_blocks") - 1))).select("label", "a", "b", "i", "j")
    blocked = placed.join(cells.select("label", "cell", "blocks"), ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64(F.lit(83), "pid"), F.col("blocks")).cast("int"))
    side = lambda x, k, n: blocked.select("label", F.col("cell").alias(x), F.col("block").alias(k), F.lit(n).alias("side"), "pid", "copies", "v").join(some, ["label", x, k])
    key = ["label", "a", "b", "i", "j"]
    rows = side("a", "i", 0).unionByName(side("b", "j", 1).where("a <> b OR i <> j")).select(*key, "side", "pid", "copies", "v")
    rows = rows.repartition(*key).sortWithinPartitions(*key, "side", "pid")

    def compare(batches):
        for (_, a, b, i, j), t in grouped(batches, key):
            pid, copies = (t.column(c).to_numpy() for c in ("pid", "copies"))
            v = matrix(t.column("v"))
            cut, one = int(np.searchsorted(t.column("side").to_numpy(), 1)), a == b and i == j
            if not cut or not one and cut == len(pid):
                continue
            left, right = slice(0, cut), slice(0, cut) if one else slice(cut, None)
            ok, _ = linked(v[left], None if one else v[right], threshold)
            if not ok.any():
                continue
            counts = [(pid[left], ok @ copies[right].astype(np.float64))] + ([] if one else [(pid[right], ok.T @ copies[left].astype(np.float64))])
            n = len(pid)
            every = ok if one else np.zeros((n, n), bool)
            if not one:
                every[:cut, cut:], every[cut:, :cut] = ok, ok.T
            u, w = np.array(forest(every)).T
            counted = np.concatenate([p[x > 0] for p, x in counts])
            total = np.concatenate([x[x > 0] for _, x in counts]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[counted, pid[u]]), pa.concat_arrays([pa.nulls(len(total), pa.int64()), pa.array(pid[w], pa.int64())]), pa.array(np.r_[total, np.zeros(len(u), np.int64)])], ["u", "v", "n"])

    return rows.mapInArrow(compare, "u long, v long, n long").unionByName(counted).unionByName(joined)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of rows (vec_id, embedding, label)."""
    every = materialise(vectors(rows, ("label",)).withColumn("v", F.when(F.col("label").isNotNull(), F.col("v"))), "vectors")
    points = every.where("v IS NOT NULL").groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    points = materialise(points.withColumn("pid", F.monotonically_increasing_id()), "points")
    found = materialise(links(points.select("pid", "label", "v", "copies"), threshold), "links")
    roots = components(found.where("v IS NOT NULL").select("u", "v")).select(F.col("node").alias("pid"), "root")
    counts = found.where("v IS NULL").groupBy(F.col("u").alias("pid")).agg(F.sum("n").alias("n"))
    joined = points.select("pid", "label", "v", "copies", "least").join(roots, "pid", "left").join(counts, "pid", "left")
    joined = materialise(joined.select("label", "v", "least", F.coalesce("root", "pid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links")), "joined")
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component")), "root").select("label", "v", "links", "component")
    out = every.join(named, ["label", "v"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("links").isNotNull(), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
