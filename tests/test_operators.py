"""Hand-computed and metamorphic tests of the library's operators."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.functions import scalars as L
from terrane.operators import assoc, bags, binning, constraints, explain, inference, sampling, scoring, spatial, timefeat, zonal
from terrane.sources import tables, vector
from terrane.streaming import daily as stream

D = dt.date


def scored(spark):
    labels, ps = [0, 0, 0, 0, 1, 0, 1, 0, 1, 1], [0.01, 0.02, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9]
    return spark.createDataFrame([(i, y, p, 1.0, lv, 0) for i, (y, p, lv) in enumerate(zip(labels, ps, [1, 1, 2, 2, 3, 3, 4, 4, 5, 5], strict=True))], "unit_id long, label int, p double, area double, level int, fold int")


def test_grades(spark):
    got = {r.minimum: r for r in scoring.grade_confusion(scored(spark), [], [3, 4]).collect()}
    assert got[3].recall == 1 and got[3].balanced_accuracy == pytest.approx((1 + 4 / 6) / 2) and got[4].recall == 0.75


def test_ties_stay_together(spark):
    tied = scored(spark).withColumn("p", F.when(F.col("unit_id") >= 4, 0.9).otherwise(F.col("p")))
    r = scoring.area_at_recall(tied, [], [0.8]).first()
    assert (r.area_share, r.recall) == (0.6, 1.0)


def test_strict_and_inclusive_budgets(spark):
    d = spark.createDataFrame([(1, 1, 0.9, 1.0), (2, 0, 0.8, 2.0), (3, 1, 0.7, 6.0), (4, 0, 0.6, 1.0)], "unit_id long, label int, p double, area double")
    assert scoring.coverage_prefix(d, []).first().n_units == 1
    assert scoring.capture_inclusive(d, [], [0.2]).first().captured == 1
    assert scoring.capture_inclusive(d, [], [0.35]).first().captured == 2


def test_one_class_has_no_auc(spark):
    d = scored(spark).withColumn("label", F.lit(0))
    assert scoring.auc(d, []).first().auc is None and scoring.average_precision(d, []).first().ap is None
    assert scoring.coverage_prefix(d, []).first().coverage is None


def test_auc_equals_pair_counts(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(2), rng.randrange(8) / 8) for i in range(60)]
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert scoring.auc(spark.createDataFrame(rows, "unit_id long, label int, p double"), []).first().auc == pytest.approx(want)


def test_seed_ensemble_differs_from_mean_of_seeds(spark):
    rows = [(u, y, s, p) for s, ps in enumerate(((0.1, 0.9, 0.6, 0.4), (0.6, 0.4, 0.1, 0.9))) for u, (y, p) in enumerate(zip((0, 1, 0, 1), ps, strict=True))]
    d = spark.createDataFrame(rows, "unit_id long, label int, seed int, p double")
    assert scoring.auc(d, ["seed"]).agg(F.avg("auc")).first()[0] == pytest.approx(0.75)
    assert scoring.auc(d.groupBy("unit_id", "label").agg(F.avg("p").alias("p")), []).first().auc == 1


# --- time --------------------------------------------------------------------------------------------------------------------------------


def series(spark, levels, start=D(2001, 1, 1)):
    return spark.createDataFrame([("A", start + dt.timedelta(i), v) for i, v in enumerate(levels) if v is not None], "station string, date date, level double")


def test_transitions_equal_brute_force(spark):
    levels, elevations = [0.0, 2.0, 0.0, 3.0, 3.0, 1.0], [-1, 0, 1, 2, 3, 4]
    got = {r.elevation: r.transitions for r in timefeat.transitions(series(spark, levels), elevations).collect()}
    assert got == {float(e): sum((a >= e) != (b >= e) for a, b in itertools.pairwise(levels)) for e in elevations}


def test_gaps_and_holding(spark):
    s = timefeat.spine(series(spark, [1.0, None, None, None, None, None, 2.0, None, 3.0]))
    held = [r.held for r in timefeat.bounded_hold(s).orderBy("date").collect()]
    assert held == [1, 1, 1, 1, None, None, 2, 2, 3]
    a = timefeat.gap_audit(s).first()
    assert (a.expected, a.observed, a.held, a.missing, a.longest_gap) == (9, 3, 4, 2, 5)


def test_no_feature_sees_its_future(spark):
    base = [float(round(math.sin(i) * 5)) for i in range(60)]
    cut = spark.createDataFrame([("A", D(2001, 2, 10))], "station string, cutoff date")
    late = [v if i < 40 else 99.0 for i, v in enumerate(base)]
    for f in (lambda s: timefeat.as_of_history(cut, s, "2001-01-01"), lambda s: timefeat.antecedent(cut, s, 7), lambda s: timefeat.seasonal_control(cut, s, 7, 10)):
        assert f(series(spark, base)).collect() == f(series(spark, late)).collect()
    assert timefeat.as_of_history(cut, series(spark, base), "2001-01-01").first().last_day == D(2001, 2, 9)


def test_incomplete_windows_are_null(spark):
    d = spark.createDataFrame([(i, None if i == 3 else float(i)) for i in range(8)], "i int, v double")
    got = [r.s for r in d.select("i", timefeat.complete_sum("v", 2, Window.partitionBy(F.lit(1)).orderBy("i")).alias("s")).orderBy("i").collect()]
    assert got == [None, None, 1.0, 3.0, None, None, 9.0, 11.0]
    assert timefeat.antecedent(spark.createDataFrame([("A", D(2001, 1, 6))], "station string, cutoff date"), series(spark, [5.0, None, 4.0, 3.0, 1.0]), 5).first().drawdown is None


def test_wet_days_of_the_previous_month(spark):
    """A constant level of 2 with one day of 0: 31 days in January, 29 in November; a month that lacks a day gives null."""
    days = [D(2002, 11, 1) + dt.timedelta(i) for i in range(92)]
    rows = [("A", d, 0.0 if d == D(2002, 11, 1) else 2.0) for d in days] + [("B", d, 2.0) for d in days if d != D(2003, 1, 7)] + [("B", D(2003, 1, 7), None)]
    points = [(s, m, e) for s in "AB" for m in (D(2002, 12, 1), D(2003, 2, 1)) for e in (1.0, 2.0, 2.5)]
    got = timefeat.previous_month_wet_days(spark.createDataFrame(points, "station string, month date, elevation double"), spark.createDataFrame(rows, "station string, date date, level double")).collect()
    assert {(r.station, r.month.month, r.elevation): r.wet for r in got} == {
        **{("A", 2, 1.0): 31, ("A", 2, 2.0): 31, ("A", 2, 2.5): 0, ("A", 12, 1.0): 29, ("A", 12, 2.0): 29, ("A", 12, 2.5): 0},
        **{("B", 2, e): None for e in (1.0, 2.0, 2.5)}, ("B", 12, 1.0): 30, ("B", 12, 2.0): 30, ("B", 12, 2.5): 0,
    }


def test_wet_counts_form_no_pairs(spark):
    rng = random.Random(3)
    levels, points = [float(rng.randrange(10)) for _ in range(50)], [float(rng.randrange(12)) for _ in range(30)]
    got = timefeat.wet_counts(series(spark, levels), spark.createDataFrame([("A", i, e) for i, e in enumerate(points)], "station string, id int, elevation double"), ["station"])
    assert {r.id: r.wet for r in got.collect()} == {i: sum(v >= e for v in levels) for i, e in enumerate(points)}


# --- bags, samples, bins -----------------------------------------------------------------------------------------------------------------


def test_weighted_quantiles_are_left_inverse(spark):
    d = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0), (1, 9.0, 2.0), (2, None, 1.0), (2, 1.0, 1.0)], "unit_id long, x double, weight double")
    got = {r.unit_id: r for r in bags.weighted_summary(d, "unit_id", "x", quantiles=(0.25, 0.5, 0.9)).collect()}
    assert (got[1].mean, got[1].p25, got[1].p50, got[1].p90) == (5.25, 1, 2, 9) and got[2].mean is None and got[2].p50 is None


def test_scaler(spark):
    d = spark.createDataFrame([(0, 1.0, None), (1, 3.0, None)], "id int, a double, b double")
    fit = bags.scaler(d, ["a", "b"])
    r = fit.first()
    assert (r.a_mean, r.a_n, r.b_mean, r.b_n, r.b_sd) == (2, 2, 0, 0, 1)
    empty = bags.scale(spark.createDataFrame([(9, None, None)], "id int, a double, b double"), fit, ["a", "b"]).first()
    assert (empty.a, empty.b) == (0, 0)


def test_draws_are_exact(spark):
    import hashlib

    d = spark.createDataFrame([(i,) for i in range(200)], "unit_id long").withColumn("h", sampling.token(42, "spatial", F.lit(1), F.col("unit_id"))).withColumn("n", F.lit(37).cast("long"))
    for r in d.withColumn("k", sampling.exact_draw("h", "n")).collect():
        top = int.from_bytes(hashlib.sha256(f"42|spatial|1|{r.unit_id}".encode()).digest()[:8], "big")
        assert r.k == top * 37 // 2**64


def test_reference_months_ignore_order_and_test_dates(spark):
    rows = [(i, int(i % 2 == 0), D(2003 + i % 5, 1 + i % 8, 15), i % 5) for i in range(20)]
    make = lambda rs: {(r.outer, r.unit_id): r.reference_month for r in sampling.reference_months(spark.createDataFrame(rs, "unit_id long, label int, event_date date, fold int"), 1, "s").collect()}
    base = make(rows)
    assert make(rows[::-1]) == base
    moved = make([(i, y, D(1990, 1, 1) if f == 0 else d, f) for i, y, d, f in rows])
    negatives = {i for i, y, _, _ in rows if not y}
    assert all(base[0, i] == moved[0, i] for i in negatives)
    donors = {d.replace(day=1) for _, y, d, f in rows if y and f != 0}
    assert all(base[0, i] in donors for i in negatives)


def test_ratios():
    assert sampling.ratio_sizes(550, 3450, "1:2") == ("1:2", 1100) and sampling.ratio_sizes(550, 3450, "6:14") == ("3:7", 1283)
    assert sampling.ratio_sizes(1, 10, "2:3")[1] == 2
    with pytest.raises(ValueError, match="background"):
        sampling.ratio_sizes(550, 3450, "1:7")


def test_donors_stay_in_their_stratum(spark):
    rows = [(i, i // 20) for i in range(43)]
    d = spark.createDataFrame(rows, "unit_id long, s int")
    got = {r.unit_id: r.donor_id for r in sampling.donor_order(d, ["s"], 8, 1).collect()}
    assert sorted(got.values()) == list(range(43)) and all(a // 20 == b // 20 for a, b in got.items()) and all(got[i] == i for i in (40, 41, 42)) and any(a != b for a, b in got.items())


def test_balanced_groups():
    assert sampling.balanced_groups([("a", 5), ("b", 5), ("c", 3), ("d", 2), ("e", 1)], 2) == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 1}


def test_natural_breaks_keep_their_digits_far_from_zero():
    v = np.array([0.0, 1.0, 2.0, 10.0, 11.0, 30.0, 31.0, 33.0])
    n = np.array([3.0, 1.0, 2.0, 5.0, 1.0, 1.0, 1.0, 4.0])
    near = binning.natural_breaks(v, n, 3)
    assert near.tolist() == [2.0, 11.0, 33.0]
    assert (binning.natural_breaks(v * 1e-3 + 1e8, n, 3) == near * 1e-3 + 1e8).all()


def test_natural_breaks_are_least_squares():
    rng = np.random.default_rng(2)
    for _ in range(20):
        v, n = np.sort(rng.random(8)), rng.integers(1, 7, 8).astype(float)

        def sse(cut, v=v, n=n):
            out = 0.0
            for a, b in itertools.pairwise([0, *cut, 8]):
                m = (v[a:b] * n[a:b]).sum() / n[a:b].sum()
                out += (n[a:b] * (v[a:b] - m) ** 2).sum()
            return out

        best = min(itertools.combinations(range(1, 8), 4), key=sse)
        assert binning.natural_breaks(v, n, 5).tolist() == [v[c - 1] for c in (*best, 8)]
    with pytest.raises(ValueError, match="distinct"):
        binning.natural_breaks(np.array([1.0]), np.array([1.0]), 2)


def test_ale_and_its_gaps(spark):
    d = spark.createDataFrame([(b, 2.0) for b in (0, 1, 2) for _ in range(4)], "bin int, delta double")
    assert [r.effect for r in binning.ale(d, []).orderBy("bin").collect()] == [-2, 0, 2]
    gap = {r.bin: r for r in binning.ale(d.where("bin <> 1"), []).collect()}
    assert gap[0].component != gap[2].component and gap[0].effect == gap[2].effect == 0


def test_break_methods(spark):
    d = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, v double")
    for method in ("fixed", "quantile", "natural"):
        got = [r.level for r in binning.break_grades(d, method, "v", 2, [5.0]).orderBy("id").collect()]
        assert got == [1] * 5 + [2] * 5
    with pytest.raises(ValueError):
        binning.break_grades(d, "other", "v", 2)


# --- association and inference -----------------------------------------------------------------------------------------------------------


def test_information_value(spark):
    d = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (1, 0), (-1, 1)], "bin int, label int")
    labels = spark.createDataFrame([(-1,), (0,), (1,), (2,)], "bin int")
    got = {r.bin: r for r in assoc.information_value(d, [], "bin", labels).collect()}
    assert got[0].fr == pytest.approx(1.25) and got[0].iv == pytest.approx(math.log(1.25)) and got[1].status == "no positives" and got[2].fr is None and got[2].status == "empty"
    assert sum(r.units for r in got.values()) == 5 and sum(r.positives for r in got.values()) == 2
    assert got[1].smooth == pytest.approx(math.log((0.5 / 4) / (2.5 / 5)))


def test_spearman_uses_each_pairs_complete_rows(spark):
    rows = [(1, 1.0, 4.0, 1.0), (2, 2.0, 3.0, 1.0), (3, 3.0, math.inf, 1.0), (4, 4.0, 1.0, 1.0), (5, None, 0.0, 1.0)]
    long = spark.createDataFrame(rows, "unit_id long, a double, b double, c double").unpivot(["unit_id"], ["a", "b", "c"], "feature", "value")
    got = {(r.a, r.b): r for r in assoc.spearman(long, "unit_id").collect()}
    assert got["a", "b"].n == 3 and got["a", "b"].rho == pytest.approx(-1) and got["a", "c"].rho is None


def test_distributions():
    assert inference.student_two_sided(2.776445105, 4) == pytest.approx(0.05, abs=1e-8)
    assert inference.student_two_sided(12.7062047, 1) == pytest.approx(0.05, abs=1e-8)
    assert inference.normal_cdf(1.959963985) == pytest.approx(0.975, abs=1e-9)
    assert inference.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert inference.fisher_exact(10, 0, 0, 10) == pytest.approx(2 / math.comb(20, 10))


def test_p_value_functions(spark):
    d = spark.createDataFrame([(2.776445105, 4.0, 3, 1, 1, 3), (None, 4.0, 1, 1, 1, 1)], "t double, df double, a int, b int, c int, d int")
    r = d.select(inference.student_p("t", "df").alias("p"), inference.fisher_p("a", "b", "c", "d").alias("f"), inference.normal_p("t").alias("z")).collect()
    assert r[0].p == pytest.approx(0.05, abs=1e-8) and r[1].p is None and r[0].f == pytest.approx(0.4857142857) and 0 < r[0].z < 0.01


def test_holm(spark):
    d = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "name string, p double")
    got = {r["name"]: r.holm for r in inference.holm(d, []).collect()}
    assert got == {"a": pytest.approx(0.04), "c": pytest.approx(0.09), "b": pytest.approx(0.09), "d": pytest.approx(0.5)}


def test_poisson_counts_have_mean_one(spark):
    n = spark.range(20000).select(inference.poisson_one(inference.hash_uniform("t", F.col("id"))).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert n[0] == pytest.approx(1, abs=0.03) and n[1] == pytest.approx(1, abs=0.06)


def test_pruning():
    assert assoc.prune_redundant([("a", 0.3), ("b", 0.2), ("c", 0.1)], {("a", "b"): -0.95, ("b", "c"): 0.99}, 0.9) == ["a", "c"]


def test_replay(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.5)], "unit_id long, p double")
    r = explain.replay_check(a, a.withColumn("p", F.col("p") + F.when(F.col("unit_id") == 2, 1e-4).otherwise(0.0)), ["unit_id"]).first()
    assert r.beyond == 1 and r.n == 2


# --- space -------------------------------------------------------------------------------------------------------------------------------


def test_nearest_and_radius_equal_brute_force(spark):
    rng = random.Random(5)
    pts = [(i, rng.random() * 100, rng.random() * 100) for i in range(80)] + [(100, 5000.0, 5000.0)]
    d = spark.createDataFrame(pts, "id long, x double, y double")
    got = {(r.a_id, r["rank"]): r.b_id for r in spatial.nearest(d, d, 2).collect()}
    for i, x, y in pts:
        order = sorted((math.hypot(x - u, y - v), j) for j, u, v in pts if j != i)
        assert [got[i, 1], got[i, 2]] == [j for _, j in order[:2]]
    pairs = {(r.a_id, r.b_id) for r in spatial.radius_join(d, d, 9.0).collect()}
    assert pairs == {(i, j) for i, x, y in pts for j, u, v in pts if i != j and math.hypot(x - u, y - v) <= 9}
    few = d.where("id < 2")
    assert spatial.nearest(few, few, 5).count() == 2
    assert spatial.nearest(few, few.where("id < 0")).count() == 0
    # A third of all points at one place, and others that are far from all: exact, by distance and then id.
    hot = pts + [(200 + i, 7.0, 7.0) for i in range(40)] + [(300 + i, 1e6 + i * 1e5, -1e6) for i in range(3)]
    h = spark.createDataFrame(hot, "id long, x double, y double")
    got = {(r.a_id, r["rank"]): r.b_id for r in spatial.nearest(h, h, 3).collect()}
    for i, x, y in hot:
        order = sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, u, v in hot if j != i)
        assert [got[i, r] for r in (1, 2, 3)] == [j for _, j in order[:3]]
    own = {r.a_id: r.b_id for r in spatial.nearest(d, h, 1, other=False).collect()}
    assert own == {i: i for i, _, _ in pts}


def test_haversine(spark):
    r = spark.createDataFrame([(111.0, 31.0, 111.0, 29.1)], "a double, b double, c double, d double").select(spatial.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert r == pytest.approx(211.27, abs=0.05)


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]
    d = spark.createDataFrame([(ring, 0.5, 1.0), (ring, 2.0, 2.0), (ring, 5.0, 1.0)], "ring array<struct<x:double,y:double>>, x double, y double")
    got = d.select(G.contains(F.col("ring"), "x", "y").alias("c"), G.signed_area(F.col("ring")).alias("a"), G.length(F.col("ring")).alias("l")).collect()
    assert [r.c for r in got] == [True, False, False] and got[0].a == 10 and got[0].l == pytest.approx(12 + 2 * math.sqrt(13))
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)
    assert G.ring_area(G.clip_convex(square + 1, square)) == pytest.approx(1) and len(G.clip_convex(square + 9, square)) == 0
    assert G.smallest_container([square * 0.2 + 0.5, square + 50], [square * 10 - 5, square]) == [1, -1]


def test_zones_without_cells_take_the_nearest(spark):
    cells = spark.createDataFrame([(i, float(i % 10), float(i // 10)) for i in range(100)], "id long, x double, y double")
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    zones = spark.createDataFrame([(1, box(0.5, 0.5, 2.5, 2.5), 0.5, 0.5, 2.5, 2.5, 1.5, 1.5), (2, box(4.1, 4.1, 4.4, 4.4), 4.1, 4.1, 4.4, 4.4, 4.25, 4.25)], "zone long, ring array<struct<x:double,y:double>>, x0 double, y0 double, x1 double, y1 double, cx double, cy double")
    a = zonal.assign_cells(cells, zones, 2.0)
    got = zonal.with_fallback(a, zones, cells).groupBy("zone").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert {r.zone: r.ids for r in got} == {1: [11, 12, 21, 22], 2: [44]}
    assert zonal.zonal_stats(a.withColumn("v", F.col("x")), "zone", ["v"]).where("zone = 1").first().v_mean == 1.5


def test_colours(spark):
    lab = L.srgb_to_lab(F.lit(255), F.lit(0), F.lit(0))
    r = spark.range(1).select(*lab, L.delta_e(lab, lab)).first()
    assert r[0] == pytest.approx(53.24, abs=0.02) and r[1] == pytest.approx(80.09, abs=0.05) and r[2] == pytest.approx(67.20, abs=0.05) and r[3] == 0


# --- constraints, sources, streams -------------------------------------------------------------------------------------------------------


def test_constraints(spark):
    good = scored(spark)
    constraints.require(constraints.prediction_violations(good))
    bad = good.unionByName(good.limit(1)).withColumn("p", F.when(F.col("unit_id") == 3, 1.5).otherwise(F.col("p")))
    with pytest.raises(constraints.ConstraintError, match="repeated_ids: 1, bad_scores: 1"):
        constraints.require(constraints.prediction_violations(bad))
    with pytest.raises(constraints.ConstraintError, match="repeat"):
        constraints.checked_join(good, bad, ["unit_id"])
    with pytest.raises(constraints.ConstraintError, match="find nothing"):
        constraints.lookup(good, good.where("unit_id < 5").select("unit_id", F.lit(1).alias("z")), ["unit_id"])
    grades = good.select("unit_id", F.col("p").alias("score"), "level")
    constraints.require(constraints.grade_violations(good, grades))
    with pytest.raises(constraints.ConstraintError, match="overlaps"):
        constraints.require(constraints.grade_violations(good, grades.withColumn("level", F.when(F.col("unit_id") == 9, 1).otherwise(F.col("level")))))
    merged = constraints.complete_population(spark.range(12).withColumnRenamed("id", "unit_id"), good)
    assert merged.where("label = -1").collect()[0].asDict() == {"unit_id": 10, "p": 0.0, "level": 1, "label": -1}


def test_csv_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, 2.5, "é"), (2, None, "b")], "unit_id long, v double, name string")
    tables.write_csv(d, str(tmp_path / "t"), 1)
    back = tables.read_csv(spark, f"file://{tmp_path}/t", columns=["unit_id", "name"])
    assert sorted(map(tuple, back.collect())) == [(1, "é"), (2, "b")]
    with pytest.raises(constraints.ConstraintError):
        tables.read_csv(spark, f"file://{tmp_path}/t", columns=["nothing"])
    manifest = tables.seal(spark, f"file://{tmp_path}/t").cache()
    assert manifest.count() >= 1 and tables.verify(spark, f"file://{tmp_path}/t", manifest).count() == 0
    assert tables.verify(spark, f"file://{tmp_path}/t", manifest.withColumn("sha256", F.lit("x"))).where("state = 'changed'").count() == manifest.count()


def test_station_sheets(spark):
    raw = spark.createDataFrame([(" A ", "2001-01-01", "1.5"), ("A", "2001-01-01", "1.5"), ("A", "nope", "1"), ("A", "2001-01-02", "x"), ("Z", "2001-01-01", "1")], "station string, date string, level string")
    clean, audit = tables.station_daily(raw, ["A"])
    assert [tuple(r) for r in clean.collect()] == [("A", D(2001, 1, 1), 1.5)]
    assert audit.first().asDict() == {"rows": 5, "unknown_station": 1, "bad_date": 1, "bad_level": 1}
    with pytest.raises(constraints.ConstraintError):
        tables.station_daily(raw.unionByName(spark.createDataFrame([("A", "2001-01-01", "9")], raw.schema)), ["A"])


def test_arrays_and_json(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "unit_id long, a array<double>")
    with pytest.raises(constraints.ConstraintError):
        tables.checked_arrays(d, "unit_id", {"a": 2})
    assert tables.checked_arrays(d.where("unit_id = 1"), "unit_id", {"a": 2}).count() == 1
    wide = spark.createDataFrame([(1, 5.0, 6.0)], "unit_id long, ndvi_2000 double, ndvi_2001 double")
    assert sorted(map(tuple, tables.wide_to_long(wide, "unit_id", "ndvi").collect())) == [(1, 2000, 5.0), (1, 2001, 6.0)]
    assert tables.strict_json(spark.createDataFrame([(1, float("nan"))], "a int, b double")).first().json == '{"a":1,"b":null}'
    assert tables.feature_vector(wide, "unit_id", ["ndvi_2001"]).first().features == [6.0]


def test_dbf_shp_and_grid(spark, tmp_path):
    rows = [(b" ", b"abc  ", b"  1.5"), (b"*", b"gone ", b"  9.0"), (b" ", "é".encode().ljust(5), b"     ")]
    fields = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([5, d]) + b"\0" * 14 for n, k, d in ((b"NAME", b"C", 0), (b"V", b"N", 1)))
    (tmp_path / "t.dbf").write_bytes(struct.pack("<B3xIHH20x", 3, len(rows), 32 + len(fields) + 1, 11) + fields + b"\r" + b"".join(b"".join(r) for r in rows) + b"\x1a")
    vector.register(spark)
    assert [tuple(r) for r in spark.read.format("dbf").load(str(tmp_path / "t.dbf")).collect()] == [("abc", 1.5), ("é", None)]
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    body = struct.pack("<i4dii", 5, 0, 0, 2, 2, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<dd", *p) for p in ring)
    point = struct.pack("<idd", 1, 7.0, 8.0)
    data = b"".join(struct.pack(">ii", i + 1, len(x) // 2) + x for i, x in enumerate((body, point)))
    (tmp_path / "t.shp").write_bytes(b"\0" * 100 + data)
    got = spark.read.format("shp").load(str(tmp_path / "t.shp")).collect()
    assert [(r.row, r.kind, r.x0, r.y1, len(r.parts[0])) for r in got] == [(0, 5, 0.0, 2.0, 4), (1, 1, 7.0, 8.0, 1)]
    offsets, at = [], 100
    for x in (body, point):
        offsets.append((at // 2, len(x) // 2))
        at += 8 + len(x)
    (tmp_path / "t.shx").write_bytes(b"\0" * 100 + b"".join(struct.pack(">ii", *o) for o in offsets))
    assert spark.read.format("shp").load(str(tmp_path / "t.shp")).collect() == got
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9\n1 2 -9\n4 5 6\n")
    cells = spark.read.format("grid").option("rows", 1).load(str(tmp_path / "g.asc")).orderBy("row", "col").collect()
    assert [(r.row, r.col, r.x, r.y, r.value) for r in cells] == [(0, 0, 11, 23, 1), (0, 1, 13, 23, 2), (1, 0, 11, 21, 4), (1, 1, 13, 21, 5), (1, 2, 15, 21, 6)]


def test_charset_repair(spark):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    good = "重庆市"
    d = spark.createDataFrame([(good.encode("gb18030").decode("latin-1"),), (good,), ("plain",)], "t string")
    assert [r[0] for r in d.select(L.repaired("t")).collect()] == [good, good, "plain"]
    spark.conf.unset("spark.sql.legacy.javaCharsets")


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i // 10, i % 24), i % 7, ("a", "b")[i % 2], float(i * 37 % 101), "") for i in range(200)]
    d = spark.createDataFrame(rows, stream.EVENT)
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    incoming = stream.events(spark, str(tmp_path / "in"))
    run = stream.complete_windows(stream.before_cutoff(incoming, "2024-01-15"), "7 days", 7).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination()
    want = {(w, e): (sum(v), len(days)) for (w, e), (v, days) in _windows(rows).items()}
    got = {(r.start.date(), r.event_type): r for r in spark.table("windows").collect()}
    assert {k: (r.total, r.days) for k, r in got.items()} == {k: (s if n >= 7 else None, n) for k, (s, n) in want.items()}
    q = stream.idempotent_append(incoming, str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def _windows(rows):
    out = {}
    for _, ts, _, e, v, _ in rows:
        if ts < dt.datetime(2024, 1, 15):
            day = (ts.date() - D(1970, 1, 1)).days
            k = (D(1970, 1, 1) + dt.timedelta(day - day % 7), e)
            vals, days = out.setdefault(k, ([], set()))
            vals.append(v)
            days.add(ts.date())
    return {k: (v, d) for k, (v, d) in out.items()}


def test_stateful_hold(spark, tmp_path):
    rows = [("A", D(2001, 1, 1), 1.0), ("A", D(2001, 1, 2), None), ("A", D(2001, 1, 4), None), ("A", D(2001, 1, 5), None), ("B", D(2001, 1, 1), None)]
    spark.createDataFrame(rows, "station string, date date, level double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("station string, date date, level double").parquet(str(tmp_path / "in"))
    run = stream.bounded_hold(s).writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.station, r.date.day): r.held for r in spark.table("held").collect()}
    assert got == {("A", 1): 1.0, ("A", 2): 1.0, ("A", 4): 1.0, ("A", 5): None, ("B", 1): None}


def test_large_groups_are_dealt_by_range(spark, monkeypatch):
    from terrane.operators import ordering

    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(40), rng.randrange(5)) for i in range(500)]
    d = spark.createDataFrame(rows, "unit_id long, g string, v int, w int")
    for by in (["g"], []):
        run = lambda by=by: sorted(map(str, ordering.average_rank(ordering.cumulative(d, by, [F.col("v"), F.col("unit_id")], {"s": F.col("w")}), by, "v", "rk").select("unit_id", "s", "rk").collect()))
        monkeypatch.setattr(ordering, "WINDOW_ROWS", 10**9)
        plain = run()
        monkeypatch.setattr(ordering, "WINDOW_ROWS", 0)
        assert run() == plain


def test_quantiles_are_exact(spark, monkeypatch):
    from terrane.operators import ordering

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *[rng.randrange(9) / 3 for _ in range(5)]])) for _ in range(300)]
    d = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    for limit in (10**9, 0):
        monkeypatch.setattr(ordering, "WINDOW_ROWS", limit)
        got = {r.g: r.q for r in ordering.quantiles(d, ["g"], "v", qs).collect()}
        assert got == {g: pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], qs)) for g in ("a", "b", None)}
