"""Columns, controls, supplements, clipped coverage, learned colours, trees and layers, against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import assoc, constraints, modelling, sampling, schema, spatial, zonal
from terrane.sources import tables, vector


def test_projection_names_what_it_lacks(spark):
    d = spark.createDataFrame([(1, 2.0, 3.0)], "unit_id long, a double, b double")
    assert schema.projected(d, exclude=["b"], keys=["unit_id"]).columns == ["unit_id", "a"]
    assert schema.projected(d, ["b", "a"]).columns == ["b", "a"]
    for wrong in ({"include": ["c"]}, {"exclude": ["c"]}, {"keys": ["c"]}, {"include": ["a", "a"]}):
        with pytest.raises(constraints.ConstraintError):
            schema.projected(d, **wrong)


def test_dictionary_join_is_many_to_one(spark):
    names = schema.feature_dictionary(spark)
    m = spark.createDataFrame([(0, "elevation_mean", 1.0), (0, "elevation_mean", 2.0)], "column int, feature string, v double")
    assert schema.with_dictionary(m, names).count() == 2
    with pytest.raises(constraints.ConstraintError):
        schema.with_dictionary(m.withColumn("feature", F.lit("none")), names)
    with pytest.raises(constraints.ConstraintError):
        schema.with_dictionary(m, names.unionByName(names))


def test_noise_is_normal_and_repeats(spark):
    d = schema.gaussian_columns(spark.range(20_000).withColumnRenamed("id", "k"), "k", 2, 1).agg(F.avg("gz1"), F.stddev("gz1"), F.corr("gz1", "gz2")).first()
    assert abs(d[0]) < 0.03 and abs(d[1] - 1) < 0.03 and abs(d[2]) < 0.03
    again = lambda n: sorted(map(tuple, schema.gaussian_columns(spark.range(50).withColumnRenamed("id", "k").repartition(n), "k", 1, 1).collect()))
    assert again(1) == again(7)


def test_wilcoxon_by_hand(spark):
    diffs = [1.0, -2.0, 2.0, 3.0, 0.0, None, -1.0, 4.0]
    got = assoc.wilcoxon(spark.createDataFrame([(d,) for d in diffs], "diff double"), []).first()
    sizes = sorted(abs(d) for d in diffs if d)
    rank = {s: np.mean([i + 1 for i, x in enumerate(sizes) if x == s]) for s in sizes}
    w = sum(rank[abs(d)] for d in diffs if d and d > 0)
    ties = sum(c**3 - c for c in (sizes.count(s) for s in set(sizes)))
    n = len(sizes)
    assert (got.n, got.w) == (n, w) and got.z == pytest.approx((w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48))


def test_far_supplement(spark):
    d = spark.createDataFrame([(i, int(i < 10)) for i in range(100)], "unit_id long, label int")
    matched = spark.createDataFrame([(i,) for i in range(10, 40)], "control_id long")
    got = [r[0] for r in sampling.far_supplement(d, matched, F.col("positives") * 2, 1).collect()]
    assert len(got) == len(set(got)) == 20 and min(got) >= 40


def test_support_of_each_fold(spark):
    rng = random.Random(4)
    rows = [(i, float(rng.randrange(40)), float(rng.randrange(40)), int(rng.random() < 0.2), i % 3) for i in range(300)]
    got = {r.fold: (r.n, r.median_positive, r.within) for r in spatial.support_profile(spark.createDataFrame(rows, "id long, x double, y double, label int, fold int"), 3.0).collect()}
    for fold in range(3):
        near = [min(math.hypot(a[1] - b[1], a[2] - b[2]) for b in rows if b[3] and b[4] != fold) for a in rows if a[4] == fold]
        assert got[fold] == pytest.approx((len(near), float(np.median(near)), np.mean([n < 3 for n in near])))


def test_clip_drops_fragments_and_outside(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in [*p, p[0]]]
    kind = "id long, x0 double, y0 double, x1 double, y1 double, ring array<struct<x:double,y:double>>"
    square = (0, 0.0, 0.0, 4.0, 4.0, ring((0, 0), (4, 0), (4, 4), (0, 4)))
    polygons = [(1, -2.0, -2.0, 2.0, 2.0, ring((-2, -2), (2, -2), (2, 2), (-2, 2))), (2, 3.9, 3.9, 6.0, 6.0, ring((3.9, 3.9), (3.9, 6), (6, 6), (6, 3.9))), (3, 9.0, 9.0, 10.0, 10.0, ring((9, 9), (10, 9), (10, 10)))]
    units = spark.createDataFrame([square], kind)
    pieces = zonal.clip_to_units(spark.createDataFrame(polygons, kind), units, 5.0, 0.5)
    assert sorted((r.id, round(r.area, 9), r.kept) for r in pieces.collect()) == [(1, 4.0, True), (2, 0.01, False)]
    assert tuple(zonal.coverage_gaps(units, pieces).first()) == (0, 16.0, 4.0, 12.0)


def test_learned_colours_by_plain_version(spark):
    rng = np.random.default_rng(1)
    centres = {1: [(30.0, 20.0, 20.0)], 2: [(70.0, -30.0, 30.0), (40.0, -60.0, -40.0)]}
    rows = [(c, *map(float, np.array(m) + rng.normal(0, 1.5, 3))) for c, ms in centres.items() for m in ms for _ in range(300)] + [(3, 50.0, 0.0, 0.0)] * 5 + [(None, None, None, None)]
    d = spark.createDataFrame(rows, "class int, l double, a double, b double")
    modes = zonal.learned_modes(d, modes=3).collect()
    assert sorted((m["class"], m.n) for m in modes) == [(1, 300), (2, 300), (2, 300)] and all(5.0 <= m.radius <= 35.0 for m in modes)
    for m in modes:
        members = np.array([r[1:] for r in rows if r[0] == m["class"] and math.dist(r[1:], (m.l, m.a, m.b)) < 20])
        assert np.allclose(members.mean(0), (m.l, m.a, m.b))
        assert m.radius == pytest.approx(max(5.0, np.percentile(np.linalg.norm(members - members.mean(0), axis=1), 95)))
    found = zonal.classify_colours(spark.createDataFrame([(1, 30.0, 20.0, 20.0), (2, 0.0, 0.0, 90.0), (2, 0.0, 0.0, 90.0), (3, None, None, None)], "id int, l double, a double, b double"), spark.createDataFrame(modes))
    assert sorted((r.id, r.predicted) for r in found.collect()) == [(1, 1), (2, 0), (2, 0), (3, None)]


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_trees_score_held_out_units(spark, kind):
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        x, y = rng.random(), rng.random()
        rows.append((i, i % 3, int((x > 0.5) != (y > 0.5)), x, y if i % 50 else None))
    got = modelling.tree_scores(spark.createDataFrame(rows, "unit_id long, fold int, label int, x double, y double"), ["x", "y"], kind, 10, 4).collect()
    assert len(got) == 1200 and np.mean([(r.p > 0.5) == r.label for r in got]) > 0.9


def test_event_points_and_ragged_pixels(spark):
    raw = spark.createDataFrame([("2001-05-01", 1.0, 2.0), ("2001-06-01", 1.0, 2.0), ("2002-01-01", 3.0, 4.0), ("never", 1.0, 2.0), (None, None, None), ("1999-01-01", 1.0, 2.0)], "date string, lon double, lat double")
    points, years = tables.event_points(raw, "date", "lon", "lat", 2001, 2002)
    assert points.count() == 3 and sorted(map(tuple, years.collect())) == [(2001, 2, 2, 2), (2002, 1, 0, 2)]
    units = spark.createDataFrame([(1,), (2,)], "unit_id long")
    good = spark.createDataFrame([(1, 1.0, 2.0)], "unit_id long, slope double, weight double")
    assert tables.checked_pixels(good, units, "unit_id", ["slope"], "weight").count() == 1
    for bad in ((1, float("nan"), 1.0), (1, 1.0, 0.0), (9, 1.0, 1.0), (1, None, 1.0), (1, 1.0, None)):
        with pytest.raises(constraints.ConstraintError):
            tables.checked_pixels(good.unionByName(spark.createDataFrame([bad], good.schema)), units, "unit_id", ["slope"], "weight")


def test_layers_round_trip(spark, tmp_path):
    vector.register(spark)
    shell, hole = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)], [(2.0, 2.0), (3.0, 2.0), (3.0, 3.0), (2.0, 3.0), (2.0, 2.0)]
    rows = [(1, "重庆", 1.25, True, [shell, hole]), (2, None, None, None, None), (3, "x" * 300, -1e-7, False, [shell[:3]])]
    d = spark.createDataFrame(rows, "id long, name string, v double, flag boolean, parts array<array<struct<x:double,y:double>>>")
    for _ in range(2):
        d.repartition(2).write.format("shp").mode("overwrite").save(str(tmp_path / "layer"))
    attributes = {r.id: r for r in spark.read.format("dbf").load(str(tmp_path / "layer")).collect()}
    assert dict(spark.read.format("dbf").load(str(tmp_path / "layer")).dtypes) == {"id": "bigint", "name": "string", "v": "double", "flag": "string"}
    assert {k: (r.name, r.v, r.flag) for k, r in attributes.items()} == {1: ("重庆", 1.25, "true"), 2: (None, None, None), 3: ("x" * 254, -1e-7, "false")}
    shapes = spark.read.format("shp").load(str(tmp_path / "layer")).collect()
    assert sorted((r.kind, len(r.parts)) for r in shapes) == [(0, 0), (5, 1), (5, 2)]
    holed = next(r for r in shapes if len(r.parts) == 2)
    area = lambda ring: sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:], strict=False)) / 2
    assert [area(p) for p in holed.parts] == [-81.0, 1.0]


def test_code_page_beside_a_table(spark, tmp_path):
    import struct

    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6, 0]) + b"\0" * 14
    (tmp_path / "t.dbf").write_bytes(struct.pack("<B3xIHH20x", 3, 1, 32 + 33, 7) + field + b"\r" + b" " + "重庆".encode("gb18030").ljust(6) + b"\x1a")
    (tmp_path / "t.cpg").write_text("GB18030")
    vector.register(spark)
    assert spark.read.format("dbf").load(str(tmp_path / "t.dbf")).first().NAME == "重庆"


@pytest.mark.parametrize("shape", [(9, 7), (6, 1)])
def test_relief_by_plain_version(spark, shape):
    rng = np.random.default_rng(2)
    dem = rng.normal(100, 5, shape)
    dem[rng.random(shape) < 0.2] = np.nan
    valid = np.isfinite(dem)
    kernel = np.exp(-np.arange(-4, 5) ** 2 / 2)

    def smoothed(a):
        for axis in range(2):
            wide = np.apply_along_axis(lambda v: np.pad(v, 4, "symmetric"), axis, a)
            a = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), axis, wide)
        return a

    z = smoothed(np.where(valid, dem, 0)) / smoothed(valid.astype(float))
    gy = np.gradient(z, -30.0, axis=0)
    gx = np.gradient(z, 20.0, axis=1) if shape[1] > 1 else np.zeros(shape)
    want = np.clip((gx / 2 - gy / 2 + np.sqrt(0.5)) / np.sqrt(1 + gx * gx + gy * gy), 0, 1)
    rows = [(i, j, float(dem[i, j]) if valid[i, j] else None) for i in range(shape[0]) for j in range(shape[1])]
    got = {(r.row, r.col): r.shade for r in zonal.shaded_relief(spark.createDataFrame(rows, "row long, col long, value double"), 20.0, 30.0).collect()}
    assert set(got) == set(zip(*np.nonzero(valid))) and all(got[k] == pytest.approx(want[k]) for k in got)
