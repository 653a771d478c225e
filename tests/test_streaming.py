"""Any history of poses, deletions and re-parenting ends in the cells of one batch run over the final state."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from hazgrid.functions.lattice import Lattice, kernel
from hazgrid.functions.poses import AFFINE
from hazgrid.operators import hazard, moments
from hazgrid.operators.hazard import Fit
from hazgrid.streaming import engine as E

LAT, FIT = Lattice(0.25), Fit(radius=0.25)


def pose(tx=0.0, ty=0.0):
    return dict(zip(AFFINE, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, tx, ty, 0.0), strict=True))


def event(kf, seq, op="pose", map_id=0, **at):
    p = pose(**at)
    return (kf, seq, op, map_id, *[p[c] for c in AFFINE])


def made(spark, folder, **how):
    r = random.Random(5)
    cloud = spark.createDataFrame([(k, r.randrange(-48, 48) / 64, r.randrange(-48, 48) / 64, r.randrange(8) / 64) for k in range(5) for _ in range(250)], "kf_id long, x double, y double, z double").cache()
    return E.MapEngine(spark, str(folder), cloud, LAT, FIT, **{"buckets": 8} | how)


def rows(df):
    return sorted(df.collect(), key=lambda r: tuple(r)[:3])


def same(a, b):
    a, b = rows(a), rows(b.select(*a.columns))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or (p is not None and q is not None and p == pytest.approx(q, abs=1e-9))


def test_history_equals_batch_run(spark, tmp_path):
    engine = made(spark, tmp_path / "state", keep=9)
    batches = [
        [event(0, 1), event(1, 1, tx=0.5), event(0, 2, tx=-0.25)],
        [event(2, 1, ty=1.0), event(1, 2, tx=0.75, ty=0.25)],
        [event(0, 3, op="delete"), event(3, 1, map_id=1)],
        [event(3, 2, map_id=0, tx=0.25), event(4, 1, map_id=1)],
        [event(0, 4, tx=1.0), event(9, 1)],  # 9 has no cloud
    ]
    for k, b in enumerate(batches):
        (tmp_path / "in").mkdir(exist_ok=True)
        spark.createDataFrame(b, E.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = engine.start(spark.readStream.schema(E.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
        assert q.exception() is None and engine.latest() == k
    last = [(0, 0, pose(tx=1.0)), (1, 0, pose(tx=0.75, ty=0.25)), (2, 0, pose(ty=1.0)), (3, 0, pose(tx=0.25)), (4, 1, pose())]
    final = spark.createDataFrame([(k, m, *[p[c] for c in AFFINE]) for k, m, p in last], "kf_id long, map_id long, " + ", ".join(f"{c} double" for c in AFFINE))
    whole = engine.rebuild(final)
    same(engine.cells(), whole)
    same(engine.hazards(), hazard.hazards(whole, LAT, FIT))
    # A batch that runs again gives the same state.
    engine.process(spark.createDataFrame(batches[-1], E.EVENTS), len(batches) - 1)
    same(engine.cells(), whole)
    gone = engine.changes(2).where("not observed")
    assert gone.count() > 0 and gone.join(engine.state(2, "cells"), ["map_id", "ci", "cj"]).count() == 0
    assert engine.changes(1).where("observed").count() > 0


def test_dropped_clouds_and_expiry(spark, tmp_path):
    engine = made(spark, tmp_path / "state", keep_clouds=False)
    seen = []
    engine.on_update = seen.append
    engine.process(spark.createDataFrame([event(0, 1)], E.EVENTS), 0)
    first = rows(engine.cells())
    engine.process(spark.createDataFrame([event(0, 2, tx=9.0)], E.EVENTS), 1)
    assert rows(engine.cells()) == first and seen == [0, 1]
    obstacles = spark.createDataFrame([(0, 0, 10.0), (7, 0, 99.0)], "kf_id long, map_id long, recv double")
    engine.process(engine.expire(obstacles, now=20.0, ttl=5.0, seq=3), 2)
    assert engine.cells().count() == 0


def test_buffer(spark):
    rows_of = [(0, t, t) for t in range(0, 40, 4)] + [(1, t, t) for t in range(0, 20, 4)]
    kept = E.buffered(spark.createDataFrame(rows_of, "source long, t long, seq long"), 25, 5)
    assert sorted((r["source"], r["t"]) for r in kept.collect()) == [(0, 32), (0, 36), *[(1, t) for t in range(0, 20, 4)]]


def test_publishing(spark, tmp_path):
    engine = made(spark, tmp_path / "state")
    publisher = E.Publisher(engine, layers=("n", "border"))
    send = lambda batch, *events: engine.process(spark.createDataFrame(list(events), E.EVENTS), batch)
    consumer = []

    def take():
        u = publisher.publish()
        if u is None:
            return None
        consumer.append(u.selectExpr("map_id", f"cast({len(consumer)} as long) seq", "is_full", "resolution", "origin_x", "origin_y", "layers", "cell_keys", "`values`").collect()[0])
        return consumer[-1]

    def held():
        from hazgrid.operators import feed
        from hazgrid.sources.readers import UPDATES

        grid = feed.applied(spark.createDataFrame([tuple(c) for c in consumer], UPDATES))
        return sorted((r["ci"], r["cj"], r["value"]) for r in grid.where("layer = 'n'").collect())

    now = lambda: sorted((r["ci"], r["cj"], float(r["n"])) for r in engine.cells().collect())
    send(0, event(0, 1), event(1, 1, tx=1.0))
    assert take()["is_full"] and held() == now()
    assert not take()["is_full"] and held() == now()  # the snapshot did not drain
    assert take() is None
    send(1, event(1, 2, op="delete"))
    send(2, event(0, 2, tx=0.5))
    u = take()
    assert not u["is_full"] and held() == now()
    assert publisher.publish(consumers=False) is None
    send(3, event(2, 1))
    assert take()["is_full"] and held() == now()
    engine.loop_closed(4)
    assert engine.changes(4).where("observed").count() >= engine.cells().count() and held() == now()


def test_clouds_that_arrive_between_batches(spark, tmp_path):
    """Keyframes are registered, turned away, moved, expired and deleted; what is left equals one batch run, and old state goes."""
    r, now = random.Random(6), [100.0]
    base_from_sensor = np.eye(4)
    base_from_sensor[0, 3] = 0.5
    taps = kernel(0.5, LAT.res, 3.0)
    lidar = E.Sensor(str(tmp_path / "lidar"), robot_height=2.0, max_range=3.0, min_range=0.1)
    obstacle = E.Sensor(str(tmp_path / "obstacle"), max_range=2.0, base_from_sensor=base_from_sensor, ttl=5.0)
    engine = E.MapEngine(spark, str(tmp_path / "state"), None, LAT, FIT, sensors={"add": lidar, "obstacle": obstacle}, maps=(0, 1), taps=taps, lethal=0.5, buckets=8, clock=lambda: now[0])
    drawn = {}

    def send(sensor, kf, high=0):
        drawn[kf] = [(kf, r.randrange(-64, 64) / 64, r.randrange(-64, 64) / 64, r.randrange(40) / 64 + high) for _ in range(150)]
        spark.createDataFrame(drawn[kf], E.POINTS).coalesce(1).write.mode("append").parquet(sensor.folder)

    top = 2**63 - 1
    for s, kf, high in ((lidar, 0, 0), (lidar, 1, 0), (lidar, 2, 9), (obstacle, top, 0)):
        send(s, kf, high)
    go = lambda batch, *events: engine.process(spark.createDataFrame(list(events), E.EVENTS), batch)
    why = lambda batch: sorted((x["kf_id"] if x["kf_id"] is not None else -9, x["reason"]) for x in engine.rejected(batch).collect())
    go(0, event(0, 1, "add"), event(1, 1, "add", tx=0.5), event(1, 3, "add", tx=7.0), event(2, 1, "add"), event(-1, 1, "add"), (None, *event(0, 1, "add")[1:]), event(top, 1, "obstacle", map_id=1), event(5, 1, "add", map_id=8))
    assert why(0) == [(-9, "id"), (-1, "id"), (1, "known"), (2, "empty"), (5, "map")]
    send(lidar, 3)  # after the first batch has read the folder
    send(lidar, 4)
    now[0] = 102.0
    go(1, event(3, 1, "add", map_id=1), event(0, 2, "add", tx=3.0), event(1, 4, tx=0.75))
    assert why(1) == [(0, "known")] and engine.cells().where("map_id = 1").count() > 20
    gated = lambda s, kf: E.points.prune(spark.createDataFrame(drawn[kf], E.POINTS), s.robot_height, s.max_range, s.min_range, s.base_from_sensor)

    def equals(*last):
        cloud = gated(lidar, last[0][0])
        for kf, *_ in last[1:]:
            cloud = cloud.unionByName(gated(obstacle if kf == top else lidar, kf))
        poses = spark.createDataFrame([(k, m, *[p[c] for c in AFFINE]) for k, m, p in last], "kf_id long, map_id long, " + ", ".join(f"{c} double" for c in AFFINE))
        whole = moments.fuse(moments.rebin(E.points.to_map(cloud, poses), LAT))
        same(engine.cells(), whole)
        fits = hazard.hazards(whole, LAT, FIT)
        same(engine.hazards().drop("step_inflated"), fits)
        inflated = hazard.inflated(fits, taps, 0.5).select("map_id", "ci", "cj", "step_inflated")
        same(engine.hazards().select("map_id", "ci", "cj", "step_inflated"), inflated)
        assert inflated.where("step_inflated > 0").count() > 0

    equals((0, 0, pose()), (1, 0, pose(tx=0.75)), (3, 1, pose()), (top, 1, pose()))
    now[0] = 106.0  # the obstacle's time is over
    go(2, event(4, 1, "add", ty=0.25), event(3, 2, map_id=0, ty=-0.5))
    equals((0, 0, pose()), (1, 0, pose(tx=0.75)), (3, 0, pose(ty=-0.5)), (4, 0, pose(ty=0.25)))
    go(3, event(0, 5, "delete"))
    last = ((1, 0, pose(tx=0.75)), (3, 0, pose(ty=-0.5)), (4, 0, pose(ty=0.25)))
    equals(*last)
    assert engine.changes(3).where("observed and step_inflated is not null").count() > 0
    # Of the first batches only what is still current is left.
    left = {p.name for p in (tmp_path / "state" / "0").iterdir()}
    assert not left & {"given", "new", "delta", "dirty", "cells-manifest", "poses-manifest"} and "feed" in left
    assert engine.state(2, "cells").count() > 0 and not (tmp_path / "state" / "1" / "cells-manifest").exists()


def test_a_timer_expires_without_events(spark, tmp_path):
    now = [10.0]
    (tmp_path / "in").mkdir()
    near = E.Sensor(str(tmp_path / "near"), ttl=5.0)
    spark.createDataFrame([(7, i / 16, j / 16, 0.0) for i in range(9) for j in range(9) if i + j], E.POINTS).write.parquet(near.folder)
    engine = E.MapEngine(spark, str(tmp_path / "state"), None, LAT, FIT, sensors={"obstacle": near}, buckets=2, clock=lambda: now[0])
    spark.createDataFrame([event(7, 1, "obstacle")], E.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = engine.start(spark.readStream.schema(E.EVENTS).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint"), {"processingTime": "1 second"}, timer=True)
    try:
        end = time.time() + 200
        while time.time() < end and (engine.latest() < 0 or (now[0] == 10.0 and not engine.cells().count())):
            time.sleep(0.5)
        assert engine.cells().count() > 0
        now[0] = 16.0
        at = engine.latest()
        while time.time() < end and engine.latest() < at + 2:
            time.sleep(0.5)
    finally:
        q.stop()
    assert engine.cells().count() == 0
