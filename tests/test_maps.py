"""Analytic surfaces, lattice and state properties of the map operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazgrid.functions import lattice as L
from hazgrid.functions import poses as P
from hazgrid.functions.parameters import GLOBAL, KEYS, LOCAL, ONE_SHOT, Parameters
from hazgrid.operators import asof, feed, hazard, keyframes, moments, outputs, points
from hazgrid.operators.moments import CELL

LAT = L.Lattice(0.25)
FIT = hazard.Fit(radius=0.25, ground_clearance=0.15, max_slope=0.4, min_points=3)


def field(spark, f, noise=0.0, per_cell=20, cells=1, seed=1, skip=()):
    r = random.Random(seed)
    rows = []
    for i in range(-cells, cells + 1):
        for j in range(-cells, cells + 1):
            if (i, j) in skip:
                continue
            for _ in range(per_cell):
                x, y = i * 0.25 + r.uniform(-0.1, 0.1), j * 0.25 + r.uniform(-0.1, 0.1)
                rows.append((0, 1, x, y, f(x, y) + r.uniform(-noise, noise)))
    return spark.createDataFrame(rows, "map_id long, kf_id long, x double, y double, z double")


def center(spark, df, fit=FIT):
    cells = moments.fuse(moments.rebin(df, LAT))
    return hazard.hazards(cells, LAT, fit).where("ci = 0 and cj = 0").first()


def test_flat(spark):
    r = center(spark, field(spark, lambda x, y: 2.0, noise=1e-4))
    assert r["slope"] < 0.01 and r["roughness"] < 0.01 and r["step"] < 0.01 and r["border"] == 1.0 and r["elevation"] == pytest.approx(2.0, abs=1e-3)


@pytest.mark.parametrize("degrees", [10, 15, 20])
def test_ramp(spark, degrees):
    t = math.tan(math.radians(degrees))
    r = center(spark, field(spark, lambda x, y: t * x, noise=1e-4))
    assert math.degrees(r["slope"] * 0.4) == pytest.approx(degrees, abs=2)
    assert r["normal_x"] == pytest.approx(-math.sin(math.radians(degrees)), abs=0.02) and r["normal_z"] == pytest.approx(math.cos(math.radians(degrees)), abs=0.02)


def test_rough_and_step(spark):
    flat, rough = center(spark, field(spark, lambda x, y: 0.0, noise=1e-4)), center(spark, field(spark, lambda x, y: 0.0, noise=0.05))
    assert rough["roughness"] > flat["roughness"]
    s = center(spark, field(spark, lambda x, y: 0.0 if x < 0 else 0.4))
    assert s["step"] > 0.3 and s["hazard"] == max(s["slope"], s["step"], s["roughness"])


def test_gates(spark):
    r = center(spark, field(spark, lambda x, y: 1.0, skip=[(1, 0)]))
    assert r["border"] == 1.0 and all(r[c] is None for c in ("elevation", "hazard", "slope", "step", "roughness", "normal_z"))
    r = center(spark, field(spark, lambda x, y: 1.0), hazard.Fit(radius=0.25, min_points=100000))
    assert r["border"] == pytest.approx(20 / 100000) and r["hazard"] is None
    same = spark.createDataFrame([(0, 1, i * 0.25, j * 0.25, 1.0) for i in (-1, 0, 1) for j in (-1, 0, 1) for _ in range(3) if j == 0 or i == 0], "map_id long, kf_id long, x double, y double, z double")
    assert center(spark, same)["border"] == 1.0


def test_fit_equals_numpy(spark):
    df = field(spark, lambda x, y: 0.3 * x - 0.2 * y + 0.1 * math.sin(9 * x), noise=0.02, cells=3)
    got = {(r["ci"], r["cj"]): r for r in hazard.hazards(moments.fuse(moments.rebin(df, LAT)), LAT, hazard.Fit(radius=0.25)).collect()}
    xyz = np.array([(r["x"], r["y"], r["z"]) for r in df.collect()])
    cell = np.stack([np.sign(xyz[:, k] / 0.25) * np.floor(np.abs(xyz[:, k] / 0.25) + 0.5) for k in (0, 1)], 1).astype(int)
    seen = 0
    for (i, j), r in got.items():
        if r["hazard"] is None:
            continue
        near = [(i + a, j + b) for a, b in L.disc(0.25, 0.25)]
        mine = [xyz[(cell == c).all(1)] for c in near]
        q = np.array([i * 0.25, j * 0.25, 0])
        every = np.concatenate(mine) - q
        mu = every.mean(0)
        low, vectors = np.linalg.eigh(np.cov(every.T, bias=True))
        n = vectors[:, 0] * np.sign(vectors[2, 0])
        along = [(m.mean(0) - q - mu) @ n for m in mine]
        assert [r["slope"], r["roughness"], r["step"]] == pytest.approx([min(math.acos(min(1, abs(n[2]))) / 0.4, 1), min(math.sqrt(low[0]) / 0.15, 1), min((max(along) - min(along)) / 0.15, 1)], abs=1e-7)
        assert [r["normal_x"], r["normal_y"], r["normal_z"]] == pytest.approx(n.tolist(), abs=1e-6)
        seen += 1
    assert seen == 37 - 12 or seen > 20


@pytest.mark.parametrize("x, y, cell", [(1.04, -0.36, (4, -1)), (0.125, -0.125, (1, -1)), (0.0, 0.0, (0, 0)), (20.0, 0.0, (80, 0))])
def test_cells(spark, x, y, cell):
    ci, cj = LAT.cell_of(F.lit(x), F.lit(y))
    k = L.pack(ci, cj)
    r = spark.range(1).select(ci.alias("i"), cj.alias("j"), L.unpack(k)[0].alias("a"), L.unpack(k)[1].alias("b")).first()
    assert (r["i"], r["j"]) == cell == (r["a"], r["b"])


@settings(max_examples=30, deadline=None)
@given(st.integers(-(2**31), 2**31 - 1), st.integers(-(2**31), 2**31 - 1))
def test_keys_are_twos_complement(i, j):
    key = i * 4294967296 + j + (4294967296 if j < 0 else 0)
    assert (key >> 32, ((key & 0xFFFFFFFF) ^ 0x80000000) - 0x80000000) == (i, j) and -(2**63) <= key < 2**63


def test_discs_and_grids():
    assert [len(L.disc(r, s)) for r, s in ((0.2, 0.05), (0.4, 0.25), (0.5, 0.05), (1.5, 0.05), (0.01, 0.25))] == [49, 9, 317, 2821, 5]
    assert all((-i, -j) in set(L.disc(0.5, 0.05)) for i, j in L.disc(0.5, 0.05))
    assert [L.cells_per_axis(h, 0.25) for h in (1, 2, 5)] == [9, 17, 41]
    assert L.grown_half(5, (0, 0), (-1, 1, -1, 4), 10, 0.25) == 5 and L.grown_half(5, (0, 0), (-1, 20, -1, 4), 10, 0.25) == 25
    assert L.kernel(0.5, 0.25, 3.0)[6] == (0, 0, 1.0)


def test_fuse_equals_one_insert_and_shift_equals_another_origin(spark):
    df = field(spark, lambda x, y: x * y, noise=0.1, cells=1)
    two = df.withColumn("kf_id", F.when(F.rand(3) < 0.5, 1).otherwise(2).cast("long"))
    a = {tuple(r[c] for c in CELL): r for r in moments.fuse(moments.rebin(two, LAT)).collect()}
    b = {tuple(r[c] for c in CELL): r for r in moments.fuse(moments.rebin(df, LAT)).collect()}
    assert a.keys() == b.keys() and all(list(a[k]) == pytest.approx(list(b[k])) for k in a)
    shifted = moments.fuse(moments.rebin(df, LAT)).withColumns(moments.shifted(F.lit(0.5), F.lit(-0.25))).where("ci = 0 and cj = 0").first()
    moved = moments.binned(df, LAT).where("ci = 0 and cj = 0").agg(*[F.sum(e).alias(k) for k, e in {"sx": F.col("lx") + 0.5, "syy": (F.col("ly") - 0.25) ** 2, "sxy": (F.col("lx") + 0.5) * (F.col("ly") - 0.25), "sxz": (F.col("lx") + 0.5) * F.col("z")}.items()]).first()
    assert [shifted[k] for k in ("sx", "syy", "sxy", "sxz")] == pytest.approx(list(moved))


def test_pruning(spark):
    rows = [(1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (float("nan"), 1.0, 0.0), (float("inf"), 1.0, 0.0), (None, 1.0, 0.0), (1.0, 1.0, 9.0), (6.0, 0.0, 0.0), (6.1, 0.0, 0.0), (0.5, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    assert sorted(tuple(r) for r in points.prune(df, 3.5, 6.0, 1.0).collect()) == [(1.0, 0.0, 0.0), (6.0, 0.0, 0.0)]
    up = P.matrix((0.0, 0.0, 3.0), (1.0, 0.0, 0.0, 0.0))
    assert sorted(tuple(r) for r in points.prune(df, 3.5, 7.0, 1.0, up).collect()) == [(0.5, 0.0, 3.0), (1.0, 0.0, 3.0), (6.0, 0.0, 3.0), (6.1, 0.0, 3.0)]


def test_quarter_turn_and_voxels(spark):
    s = math.sqrt(0.5)
    pose = P.with_affine(spark.createDataFrame([(1, 7, s, 0.0, 0.0, s, 5.0, -3.0, 2.0)], "kf_id long, map_id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double"))
    cloud = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0)], "kf_id long, x double, y double, z double")
    got = sorted(tuple(round(v, 9) for v in r) for r in points.stitched(cloud, pose).collect())
    assert got == [(7, 4.0, -3.0, 2.0), (7, 5.0, -2.0, 2.0)]
    near = spark.createDataFrame([(0, 0.001 * i, 0.0, 0.0) for i in range(10)], "map_id long, x double, y double, z double")
    assert points.voxel_downsample(near, 1.0, 1.0, 1.0).count() == 1 and points.voxel_downsample(near, 1.0, 0.0, 1.0).count() == 10
    yaw = spark.range(1).select(P.yaw_of(F.lit(s), F.lit(0.0), F.lit(0.0), F.lit(s)).alias("y"), P.ns_to_sec(F.lit(1_700_000_000_123_456_789).cast("long")).alias("t")).first()
    assert yaw["y"] == pytest.approx(math.pi / 2) and yaw["t"] == pytest.approx(1_700_000_000.1234567)


def test_inflation_equals_brute_force(spark):
    r = random.Random(2)
    cells = {(r.randrange(-9, 9), r.randrange(-9, 9)): r.choice([None, 0.2, 0.95, 1.0, 0.97]) for _ in range(150)}
    df = spark.createDataFrame([(0, i, j, s) for (i, j), s in cells.items()], "map_id long, ci int, cj int, step double")
    taps = L.kernel(0.6, 0.25, 2.0)
    got = {(x["ci"], x["cj"]): x["step_inflated"] for x in hazard.inflated(df, taps, 0.95).collect()}
    for i, j in cells:
        near = [cells[i + a, j + b] * d for a, b, d in taps if (cells.get((i + a, j + b)) or 0) >= 0.95]
        assert got[i, j] == pytest.approx(max(near, default=0.0))


def test_outputs(spark):
    v = spark.createDataFrame([(None,), (float("nan"),), (-0.5,), (0.0,), (0.555,), (1.0,), (2.0,)], "v double")
    assert [r[0] for r in v.select(outputs.occupancy(F.col("v"))).collect()] == [-1, -1, 0, 0, 55, 100, 100]
    o = spark.createDataFrame([(-1,), (0,), (54,), (55,), (99,), (100,)], "o int")
    got = o.select(outputs.trinarised(F.col("o"), 55), outputs.palette(F.col("o"))).collect()
    assert [tuple(r) for r in got] == [(-1, -1), (0, -128), (0, -60), (100, -59), (100, -3), (100, 113)]
    assert outputs.pool_factor(0.25, 0.05) == 5 and outputs.pool_factor(0.25, 1.0) == 1
    cells = spark.createDataFrame([(0, 0, 0, 5), (0, 1, 1, -1), (0, 1, 0, 9), (0, 2, 0, -1)], "map_id long, ci int, cj int, occ int")
    assert sorted(tuple(r) for r in outputs.min_pooled(cells, "occ", 2, 0, 0).collect()) == [(0, 0, 0, 5), (0, 1, 0, -1)]
    a = spark.createDataFrame([(0, 0, 90, 1), (1, 0, 10, 1), (2, 0, 70, 1)], "ci int, cj int, occ int, stamp int")
    b = spark.createDataFrame([(0, 0, -1, 2), (1, 0, 61, 2)], a.schema)
    assert sorted(tuple(r) for r in outputs.merged([a, b]).collect()) == [(0, 0, 100), (1, 0, 100), (2, 0, 100)]


@pytest.mark.parametrize("span", [asof.SPAN, 7, 1])
def test_time_joins_equal_brute_force(spark, span):
    r = random.Random(span)
    left = [(r.randrange(3), r.randrange(40), i) for i in range(60)]
    right = [(r.randrange(2), r.randrange(40), 100 + i) for i in range(25)]
    kind = "source long, t long, seq long"
    l, q = spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)
    for x in asof.nearest(l, q, span=span).collect():
        want = min(((abs(t - x["t"]), s) for o, t, s in right if o == x["source"]), default=(None, None))[1]
        assert x["hit_seq"] == want
    for x in asof.latest_before(l, q, span=span).collect():
        mine = [(t, s) for o, t, s in right if o == x["source"]]
        assert x["hit_seq"] == max([m for m in mine if m[0] <= x["t"]] or mine, default=(None, None))[1]
    pairs = asof.mutual_nearest(l, q, 3).collect()
    assert len({x["seq"] for x in pairs}) == len({x["hit_seq"] for x in pairs}) == len(pairs) > 0 and all(abs(x["t"] - x["hit_t"]) <= 3 for x in pairs)


def test_keyframes(spark):
    u = spark.createDataFrame([(1, 1, 5.0), (1, 3, 7.0), (1, 2, 6.0), (2, 1, 1.0)], "kf_id long, seq long, tx double")
    assert sorted(tuple(r) for r in keyframes.latest_poses(u).select("kf_id", "tx").collect()) == [(1, 7.0), (2, 1.0)]
    k = spark.createDataFrame([(0, i) for i in (1, 2, 5, 9)] + [(1, 3)], "map_id long, kf_id long")
    assert sorted(tuple(r) for r in keyframes.last_n(k, 5).collect()) == [(0, 5), (0, 9), (1, 3)]
    assert keyframes.obstacle_ids(3, [4, 6]) == [6, 4, 2**63 - 1]
    with pytest.raises(Exception, match="keyframe ids"):
        spark.createDataFrame([(-1,)], "kf_id long").select(keyframes.valid(F.col("kf_id"))).collect()
    rows = [(0, i, i, x, 0.0, 0.0) for i, x in enumerate([0.0, 0.5, 1.0, 1.4, 3.0, 2.2, 2.0])]
    gated = keyframes.displacement_gate(spark.createDataFrame(rows, "source long, t long, seq long, x double, y double, z double"), 1.0)
    assert sorted(r["x"] for r in gated.collect()) == [0.0, 1.0, 2.0, 3.0]
    rate = keyframes.rate_gate(spark.createDataFrame([(0, t, t) for t in (0, 4, 10, 19, 20, 29, 31)], "source long, t long, seq long"), 10)
    assert sorted(r["t"] for r in rate.collect()) == [0, 10, 20, 31]


def update(seq, full, cells, layers=("hazard", "n"), res=0.25):
    return (0, seq, full, res, 0.0, 0.0, list(layers), [i * 4294967296 + j + (4294967296 if j < 0 else 0) for i, j in cells], [float(v) for vs in cells.values() for v in vs])


def test_updates(spark):
    from hazgrid.sources.readers import UPDATES

    nan = float("nan")
    history = [update(1, True, {(0, 0): (1, 2), (1, -1): (3, 4)}), update(2, False, {(1, -1): (nan, nan), (2, 2): (5, nan)}), (0, 3, False, 0.25, 0.0, 0.0, ["hazard", "n"], [7], [1.0])]
    df = spark.createDataFrame(history, UPDATES)
    got = sorted(tuple(r) for r in feed.applied(df).collect())
    assert got == [(0, 0, 0, "hazard", 1.0), (0, 0, 0, "n", 2.0), (0, 2, 2, "hazard", 5.0)] and feed.invalid(df).count() == 1
    anew = spark.createDataFrame([*history, update(4, False, {(9, 9): (1,)}, layers=("n",))], UPDATES)
    assert [tuple(r) for r in feed.applied(anew).collect()] == [(0, 9, 9, "n", 1.0)]
    cells = spark.createDataFrame([(0, 2, -3, 0.5), (0, -1, 4, None)], "map_id long, ci int, cj int, hazard double")
    back = feed.decoded(feed.encoded(cells, ["hazard"], LAT, True)).select("ci", "cj", "cell").collect()
    assert sorted((r["ci"], r["cj"], str(r["cell"][0])) for r in back) == [(-1, 4, "nan"), (2, -3, "0.5")]
    assert feed.described(df).first()["layers"] == ["hazard", "n"]


def test_parameters(tmp_path):
    assert len(KEYS) == 22 and LOCAL.get("traversability/min_points_per_grid") == 5 and ONE_SHOT.get("pointcloud/max_range") == 1e9
    assert Parameters().with_values({"grid/grid_center_x": 2}).grid_center_x == 2.0
    for bad, error in (({"no/key": 1}, KeyError), ({"inflation/enabled": 1}, TypeError), ({"traversability/min_points_per_grid": 1.5}, TypeError)):
        with pytest.raises(error):
            GLOBAL.with_values(bad)
    yaml = pytest.importorskip("yaml")
    from hazgrid.sources.readers import parameters

    (tmp_path / "p.yaml").write_text(yaml.safe_dump(LOCAL.items()))
    assert parameters(str(tmp_path / "p.yaml")) == LOCAL
    (tmp_path / "q.yaml").write_text("grid:\n  grid_center_x: 1.0\n")
    with pytest.raises(KeyError):
        parameters(str(tmp_path / "q.yaml"))


def test_ply_and_sinks(spark, tmp_path):
    from hazgrid.sources import readers, sinks

    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n-1.5 0 2e-1\nnan 1 1\n")
    got = sorted((str(r["x"]), r["y"]) for r in readers.ply(spark, str(tmp_path / "a.ply")).collect())
    assert got == [("-1.5", 0.0), ("1.0", 2.0), ("nan", 1.0)]
    (tmp_path / "b.ply").write_text("ply\nformat binary_little_endian 1.0\nend_header\n")
    with pytest.raises(ValueError):
        readers.ply(spark, str(tmp_path / "b.ply"))
    seg = keyframes.segments(spark.createDataFrame([(0, i, float(i), 0.0, 1.0) for i in range(5)], "source long, seq long, x double, y double, z double"))
    sinks.append_segments(seg, str(tmp_path / "s"))
    sinks.append_segments(seg, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s")).count() == 4
    cells = moments.fuse(moments.rebin(field(spark, lambda x, y: 0.1 * x, noise=0.01), LAT))
    sinks.write_occupancy(hazard.hazards(cells, LAT, FIT), str(tmp_path / "o"))
    sinks.write_grid(hazard.hazards(cells, LAT, FIT), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == spark.read.parquet(str(tmp_path / "g")).count() == 9


def test_gates_carry_state_over_batches(spark):
    """One source with many rows, in small batches; and sources that share a partition."""
    r = random.Random(3)
    at, rows = 0.0, []
    for t in range(5000):
        at += r.choice([0.0, 0.125, 0.5])
        rows.append((1, t * 3, t, at, 0.0, 0.0))
    rows += [(None, 1, 1, 0.0, 0.0, 0.0), (None, 2, 2, None, 0.0, 0.0), (None, 3, 3, 5.0, 0.0, 0.0), (2, None, 1, 0.0, 0.0, 0.0), (2, 4, 2, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "source long, t long, seq long, x double, y double, z double").repartition(4)
    want, last = [], None
    for _, _, k, x, *_ in rows[:5000]:
        if last is None or x - last >= 1.0:
            want.append((1, k))
            last = x
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = sorted(((x["source"] or 0, x["seq"]) for x in keyframes.displacement_gate(df, 1.0).collect()))
        rate = sorted(((x["source"] or 0, x["seq"]) for x in keyframes.rate_gate(df, 10).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted([*want, (0, 1), (0, 3), (2, 1)])
    assert rate == sorted([*((1, k) for k in range(0, 5000, 4)), (0, 1), (2, 1), (2, 2)])


def test_discs_over_many_tiles(spark):
    """Sums over discs of 30 cells' radius, over tile edges, against direct sums."""
    lat = L.Lattice(0.05)
    r = random.Random(9)
    at = sorted({(r.randrange(-300, 300), r.randrange(-20, 20)) for _ in range(400)})
    cells = spark.createDataFrame([(0, i, j, 2, *[1.0] * 9) for i, j in at], "map_id long, ci int, cj int, n long, " + ", ".join(f"{c} double" for c in moments.SUMS))
    got = {(x["ci"], x["cj"]): (x["n_cells"], x["n"], x["own_n"]) for x in hazard.vicinity(cells, lat, 1.5).collect()}
    want = {}
    for i, j in at:
        k = sum((i - a) ** 2 + (j - b) ** 2 <= 900 for a, b in at)
        want[i, j] = (k, 2 * k, 2)
    assert got == want


def test_large_maps_are_encoded_in_tiles(spark):
    cells = spark.createDataFrame([(0, i, j, float(i)) for i in (-600, -512, -1, 0, 511, 512, 5000) for j in (0, 700)], "map_id long, ci int, cj int, hazard double")
    updates = feed.encoded(cells, ["hazard"], LAT, True).withColumn("seq", F.lit(1).cast("long"))
    assert updates.count() == 8 and {(x["ci"], x["cj"], x["value"]) for x in feed.applied(updates).collect()} == {(x["ci"], x["cj"], x["hazard"]) for x in cells.collect()}
    assert feed.encoded(cells, ["hazard"], LAT, True, side=1 << 14).count() == 1
