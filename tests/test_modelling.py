"""The operators around models."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrane.operators import modelling as M
from terrane.operators import schema
from terrane.operators.proximity import proximity_sample


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        p = rng.uniform(0.02, 0.98)
        z = 0.5 + 0.8 * math.log(p / (1 - p))
        rows.append((i, int(rng.random() < 1 / (1 + math.exp(-z))), p, rng.choice("abcdefgh"), i % 5, rng.random() * 50, rng.random() * 50, 1.0))
    return spark.createDataFrame(rows, "unit_id long, label int, p double, county string, fold int, x double, y double, area double")


def test_calibration_slope_recovers_the_model(scored):
    slope, intercept = M.calibration_slope(scored)
    assert slope == pytest.approx(0.8, abs=0.1) and intercept == pytest.approx(0.5, abs=0.12)


def test_out_of_fold_never_sees_its_fold(scored):
    def fit(rows, seed):
        return set(rows["unit_id"])

    def score(seen, rows):
        return [float(u in seen) for u in rows["unit_id"]]

    out = M.out_of_fold(scored, ["x"], fit, score, [1, 2], 2500).collect()
    assert len(out) == 8000 and sum(r.p for r in out) == 0
    assert Counter((r.unit_id, r.seed) for r in out).most_common(1)[0][1] == 1


def test_region_holdouts_hold_their_share(scored):
    counts = {r.county: r.n for r in scored.groupBy("county").agg(F.sum("label").alias("n")).collect()}
    held = M.region_holdout(scored, "county", 0.3, 0.1, 3, 200, 1)
    assert len(held) == 3 and all(abs(sum(counts[c] for c in h) / sum(counts.values()) - 0.3) <= 0.1 for h in held)
    assert M.region_holdout(scored, "county", 0.3, 0.1, 3, 200, 1) == held


def test_proximity_negatives(spark):
    rng = random.Random(1)
    pairs = {(rng.randrange(30), 100 + rng.randrange(40)) for _ in range(200)}
    got = M.proximity_negatives(spark.createDataFrame(sorted(pairs), "case_id long, control_id long"), 2, 1).collect()
    assert {(r.case_id, r.control_id) for r in got} <= pairs
    controls, cases = Counter(r.control_id for r in got), Counter(r.case_id for r in got)
    assert max(controls.values()) == 1 and max(cases.values()) <= 2
    # No case with room is left beside a control that nobody has.
    assert not [(a, b) for a, b in pairs if cases[a] < 2 and b not in controls]
    assert M.proximity_negatives(spark.createDataFrame([], "case_id long, control_id long"), 2, 1).count() == 0


def test_proximity_negatives_use_all_units(spark):
    from terrane.plans import catalog
    from terrane.plans.proxies import units

    folder = "/root/testdata/sf0.001"
    rows = units(spark, folder).select("unit_id", "x", "y", "label").collect()
    pairs = {(a.unit_id, b.unit_id) for a in rows if a.label == 1 for b in rows if b.label == 0 and math.dist((a.x, a.y), (b.x, b.y)) <= 12}
    got = catalog.QUERIES["proximity_negatives"](spark, folder).collect()
    assert {(r.case_id, r.control_id) for r in got} <= pairs
    controls, cases = Counter(r.control_id for r in got), Counter(r.case_id for r in got)
    assert max(controls.values()) == 1 and max(cases.values()) <= 2
    assert not [(a, b) for a, b in pairs if cases[a] < 2 and b not in controls]


def rules_hold(points, got, radius, k):
    """points: id -> (x, y, label). Pairs lie within the radius, no control is taken twice, no case has over k, and none with room is left beside a free control."""
    near = lambda a, b: math.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) <= radius
    assert all(points[a][2] == 1 and points[b][2] == 0 and near(points[a], points[b]) for a, b in got)
    cases, controls = Counter(a for a, _ in got), Counter(b for _, b in got)
    assert max(controls.values(), default=0) <= 1 and max(cases.values(), default=0) <= k
    open_cases = [p for i, p in points.items() if p[2] == 1 and cases[i] < k]
    free = [p for i, p in points.items() if p[2] == 0 and i not in controls]
    assert not [1 for a in open_cases for b in free if near(a, b)]


@pytest.mark.parametrize(("n", "span", "grid", "share", "radius", "k"), [(3000, 60, None, 0.3, 4.0, 2), (3000, 20, 1, 0.5, 6.0, 2), (2000, 9, 3, 0.1, 5.0, 3), (2000, 2000, None, 0.5, 15.0, 1), (900, 8, 1, 0.5, 0.0, 2), (1500, 30, 1, 0.9, 12.0, 2)])
def test_proximity_sample_keeps_the_rules(spark, n, span, grid, share, radius, k):
    rng = random.Random(n + span)
    at = lambda: rng.uniform(-span / 2, span) if grid is None else float(rng.randrange(-span, span, grid))
    points = {7 * i - 500: (at(), at(), int(rng.random() < share)) for i in range(n)}
    rows = [(i, *p) for i, p in points.items()]
    odd = [(None, 0.0, 0.0, 0), (10**9, None, 1.0, 0), (10**9 + 1, math.nan, 1.0, 0), (10**9 + 2, math.inf, 1.0, 1), (10**9 + 3, 0.0, 0.0, None)]
    kinds = "id long, x double, y double, label int"
    got = sorted(map(tuple, proximity_sample(spark.createDataFrame(rows + odd, kinds), radius, k, 1).collect()))
    rules_hold(points, got, radius, k)
    rng.shuffle(rows)
    assert got == sorted(map(tuple, proximity_sample(spark.createDataFrame(odd + rows + rows[:200], kinds).repartition(7), radius, k, 1).collect()))


def test_proximity_sample_draws_all_alike(spark):
    """One case in 3000 controls: over many seeds' draws the squared distances are even over the disc, so their mean is half the radius squared."""
    rng = random.Random(5)
    points = spark.createDataFrame([(0, 0.0, 0.0, 1)] + [(i, rng.uniform(-12, 12), rng.uniform(-12, 12), 0) for i in range(1, 3001)], "id long, x double, y double, label int")
    got = proximity_sample(points, 10.0, 600, 1).join(points.withColumnRenamed("id", "control_id"), "control_id").collect()
    assert len(got) == 600 and sum(r.x**2 + r.y**2 for r in got) / 600 / 100 == pytest.approx(0.5, abs=0.06)
    assert abs(sum(r.x for r in got) / 600) < 1 and abs(sum(r.y for r in got) / 600) < 1
    none = points.where("id < 0")
    assert proximity_sample(none, 10.0, 2, 1).count() == 0 and proximity_sample(points.where("label = 0"), 10.0, 2, 1).count() == 0


def test_proximity_negatives_form_no_pairs(spark, tmp_path, monkeypatch):
    """3,000 units at one place have over a million pairs within reach: nothing that is kept between steps may grow with them."""
    import duckdb

    from terrane import session
    from terrane.plans import catalog

    con, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("customer", "nation", "region"):
        con.execute(f"COPY (SELECT * FROM '{folder}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT o.* REPLACE (k AS o_orderkey, CASE WHEN k % 3 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus) FROM (SELECT * FROM '{folder}/orders.parquet' ORDER BY o_orderkey LIMIT 1) o, range(3000) r(k)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    kept, cut = [], session.cut
    monkeypatch.setattr(session, "cut", lambda df, tag="cut": (kept.append((out := cut(df, tag)).count()), out)[1])
    got = catalog.QUERIES["proximity_negatives"](spark, str(tmp_path)).collect()
    assert len(got) == len({r.control_id for r in got}) == 2000 and set(Counter(r.case_id for r in got).values()) == {2}
    assert max(kept, default=0) <= 6000


def test_near_constant_columns(scored):
    d = scored.withColumns({"flat": F.lit(2.0), "rare": F.when(F.col("unit_id") == 0, 1.0).otherwise(0.0)})
    assert M.near_constant(d, ["x", "flat", "rare"]) == ["flat", "rare"]


def test_soft_context_order(scored):
    got = M.soft_context(scored, F.col("x") > 25, 0.5, 3500, 1)
    by = {r.tier: r.n for r in got.groupBy("tier").agg(F.count("*").alias("n")).collect()}
    assert by[0] == scored.where("label = 1").count() and by[1] == scored.where("label = 0 AND x > 25").count()


def test_dictionary_counts():
    names = schema.feature_columns()
    assert len(schema.pixel_columns()) == 44 and len(names) == len(set(names)) == 84
    assert [len(schema.arm_columns(a)) for a in schema.ARMS] == [40, 48, 80, 84]
    grouped = [c for g in schema.GROUPS.values() for c in g]
    assert sorted(grouped) == sorted(names[:40])


def test_alpha_prefers_the_smaller_of_equals(scored):
    d = scored.withColumns({"own": F.col("p"), "alt": F.col("p")})
    assert M.choose_alpha(d, "own", "alt", [0.5, 1.0], "county").first().alpha == 0.0


def test_extended_folds(scored):
    some = scored.where("unit_id < 300")
    got = {r.unit_id: r.fold for r in M.extended_folds(some, some.where("unit_id % 2 = 0")).collect()}
    rows = some.select("unit_id", "x", "y", "fold").collect()
    own = [r for r in rows if r.unit_id % 2 == 0]
    for r in rows:
        best = min(own, key=lambda o, r=r: (math.hypot(r.x - o.x, r.y - o.y), o.unit_id))
        assert got[r.unit_id] == (r.fold if r.unit_id % 2 == 0 else best.fold)


def test_clusters_are_compact(spark):
    from terrane.operators import sampling

    rng = random.Random(2)
    rows = [(i, (i % 3) * 100 + rng.random(), rng.random()) for i in range(90)]
    got = {r.unit_id: r.fold for r in sampling.kmeans_folds(spark.createDataFrame(rows, "unit_id long, x double, y double"), 3, 1).collect()}
    assert got == {i: i % 3 for i in range(90)}


def test_permutations_of_equal_values_are_never_extreme(spark):
    from terrane.operators import inference

    d = spark.createDataFrame([(i, i % 2, 1.0) for i in range(20)], "unit_id long, label int, value double")
    assert inference.permutation_test(d, [], 9, 1).first().p == 1
    apart = spark.createDataFrame([(i, int(i < 10), float(i >= 10)) for i in range(20)], "unit_id long, label int, value double")
    assert inference.permutation_test(apart, [], 9, 1).first().p == pytest.approx(0.1)
