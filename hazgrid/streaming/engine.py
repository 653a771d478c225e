"""Incremental maps: a stream of keyframe events keeps partials, cells, hazards and inflated steps up to date.

Each micro-batch registers new keyframes, takes the latest event of each, turns old partials into new ones by signed sums, and refits only cells within a disc
of those that changed. State is in buckets (see `state`): by keyframe, or by tile of the map, so a batch reads and writes the buckets that it changes, and versions that
are no longer needed are deleted. A batch reads the version before and writes its own, so one that runs again
gives the same state. Any history ends in the cells of one batch run over the final poses.

Events: kf_id, seq, op, map_id and the twelve pose columns. Ops: pose (for another map it re-parents), delete, and a sensor's name, which registers a keyframe
whose points that sensor has. Registering needs an id from 0 to 2^63 - 1 that isn't known, a known map, and a point that pruning leaves; of equal ids the first counts.
What is turned away is in the batch's table of rejected events. The pruned cloud is stored once, under the batch that registered it, so a later pose reads that batch's clouds only.
Keyframes of a sensor with a time to live are deleted by the first batch after it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hazgrid.functions.lattice import Lattice, disc
from hazgrid.functions.poses import AFFINE
from hazgrid.operators import feed, hazard, keyframes, moments, points
from hazgrid.operators.moments import CELL, MOMENTS
from hazgrid.streaming.state import Buckets, by_keyframe, by_tile, deleted, exists, note, noted

EVENTS = "kf_id long, seq long, op string, map_id long, " + ", ".join(f"{c} double" for c in AFFINE)
POINTS = "kf_id long, x double, y double, z double"
KEYFRAMES = "kf_id long, sensor string, stored int, due double"
PARTIALS = "map_id long, kf_id long, ci int, cj int, n long, " + ", ".join(f"{c} double" for c in moments.SUMS)
CELLS = "map_id long, ci int, cj int, n long, " + ", ".join(f"{c} double" for c in moments.SUMS)
HAZARDS = "map_id long, ci int, cj int, n long, " + ", ".join(f"{c} double" for c in ("border", "elevation", "slope", "step", "roughness", "hazard", "normal_x", "normal_y", "normal_z"))
INFLATED = "map_id long, ci int, cj int, step_inflated double"
FEED = HAZARDS + ", step_inflated double, observed boolean"
TABLES = {"poses": (EVENTS, by_keyframe), "keyframes": (KEYFRAMES, by_keyframe), "partials": (PARTIALS, by_keyframe), "cells": (CELLS, by_tile), "hazards": (HAZARDS, by_tile), "inflated": (INFLATED, by_tile)}
PASSING = ("events", "registered", "new", "delta", "dirty", "refit", "affected", "reached")
#: Later than any event of a batch.
LAST = 2**62


@dataclass(frozen=True)
class Sensor:
    """Where a sensor's points are (Parquet files of kf_id, x, y, z, listed anew for each batch), its extrinsic and gates, and how many seconds its keyframes live."""

    folder: str
    robot_height: float = 1e9
    max_range: float = 1e9
    min_range: float = 0.0
    base_from_sensor: np.ndarray | None = None
    ttl: float | None = None


@dataclass
class MapEngine:
    spark: SparkSession
    folder: str
    #: kf_id, x, y, z in the base frame, of keyframes that need no registering; None where all come from sensors.
    cloud: DataFrame | None
    lattice: Lattice
    fit: hazard.Fit
    #: Whether a keyframe's cloud stays for later poses; without, events of keyframes that are binned are skipped.
    keep_clouds: bool = True
    #: Called after each batch with its id.
    on_update: object = None
    #: By the op that registers.
    sensors: dict[str, Sensor] = field(default_factory=dict)
    #: Maps that keyframes may be registered in; None for any.
    maps: tuple[int, ...] | None = None
    #: Kernel by which lethal steps inflate, and from which step on; without, there are no inflated steps.
    taps: list[tuple[int, int, float]] | None = None
    lethal: float = 0.95
    buckets: int = 64
    #: Batches whose state stays.
    keep: int = 2
    clock: Callable[[], float] = time.time

    def table(self, name: str) -> Buckets:
        return Buckets(self.spark, self.folder, name, *TABLES[name], self.buckets)

    def state(self, batch: int, name: str) -> DataFrame:
        return self.table(name).read(batch)

    def latest(self) -> int:
        """The last finished batch; -1 before any."""
        return int(note(self.spark, f"{self.folder}/done")) if exists(self.spark, f"{self.folder}/done") else -1

    def cells(self) -> DataFrame:
        return self.state(self.latest(), "cells")

    def hazards(self) -> DataFrame:
        """Hazards of all cells; with step_inflated where steps inflate."""
        found = self.state(self.latest(), "hazards")
        return found if self.taps is None else found.join(self.state(self.latest(), "inflated"), CELL, "left")

    def changes(self, batch: int) -> DataFrame:
        """The feed of a batch: refitted cells, and cells that went (observed is false)."""
        return self.spark.read.schema(FEED).parquet(f"{self.folder}/{batch}/feed") if batch >= 0 else self.spark.createDataFrame([], FEED)

    def rejected(self, batch: int) -> DataFrame:
        """Events of a batch that registered nothing, and why: id, map, known or empty."""
        return self.spark.read.schema(EVENTS + ", reason string").parquet(f"{self.folder}/{batch}/rejected")

    def clouds(self, of: DataFrame | None = None) -> DataFrame:
        """Base-frame points of keyframes: those of `of` (rows of the table keyframes), by default all."""
        of = self.state(self.latest(), "keyframes") if of is None else of
        out = self.spark.createDataFrame([], POINTS) if self.cloud is None else self.cloud.select("kf_id", "x", "y", "z")
        stored = sorted(r[0] for r in of.select("stored").distinct().collect())  # batches that registered one of them
        if stored:
            held = self.spark.read.schema(POINTS).parquet(*[f"{self.folder}/clouds/{b}" for b in stored])
            out = out.unionByName(held.join(of.select("kf_id"), "kf_id", "left_semi"))
        return out

    def register(self, events: DataFrame, batch: int, before: int, now: float) -> DataFrame:
        """Stores the pruned clouds of new keyframes; their rows of the table keyframes, written."""
        base = f"{self.folder}/{batch}"
        asked = events.where(F.col("op").isin(*self.sensors))
        known = self.table("keyframes").read(before, self.table("keyframes").of(asked.where("kf_id >= 0")))
        in_map = F.lit(True) if self.maps is None else F.coalesce(F.col("map_id").isin(*self.maps), F.lit(False))
        first = asked.where("kf_id >= 0").groupBy("kf_id").agg(F.min("seq").alias("first"))
        seen = asked.join(first, "kf_id", "left").join(known.select("kf_id", F.lit(True).alias("known")), "kf_id", "left")
        seen = seen.withColumn("reason", F.when(F.coalesce(F.col("kf_id") < 0, F.lit(True)), "id").when(~in_map, "map").when(F.col("known") | (F.col("seq") > F.col("first")), "known"))
        fine = seen.where("reason is null")
        span = fine.agg(F.min("kf_id"), F.max("kf_id")).first()
        kept = self.spark.createDataFrame([], POINTS)
        for name, s in self.sensors.items():
            if span[0] is not None:
                # The span of ids is pushed down to the scan of files as they are by now.
                raw = self.spark.read.schema(POINTS).parquet(s.folder).where(F.col("kf_id").between(*span)).join(fine.where(F.col("op") == name).select("kf_id"), "kf_id", "left_semi")
                kept = kept.unionByName(points.prune(raw, s.robot_height, s.max_range, s.min_range, s.base_from_sensor).select("kf_id", "x", "y", "z"))
        kept.write.mode("overwrite").parquet(f"{self.folder}/clouds/{batch}")
        there = self.spark.read.schema(POINTS).parquet(f"{self.folder}/clouds/{batch}").select("kf_id").distinct().withColumn("full", F.lit(True))
        seen = seen.join(there, "kf_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("full").isNull(), "empty")))
        seen.where("reason is not null").select(*events.columns, "reason").write.mode("overwrite").parquet(f"{base}/rejected")
        due = F.lit(None).cast("double")
        for name, s in self.sensors.items():
            due = due if s.ttl is None else F.when(F.col("op") == name, F.lit(now + s.ttl)).otherwise(due)
        seen.where("reason is null").select("kf_id", F.col("op").alias("sensor"), F.lit(batch).alias("stored"), due.alias("due")).write.mode("overwrite").parquet(f"{base}/registered")
        return self.spark.read.schema(KEYFRAMES).parquet(f"{base}/registered")

    def process(self, events: DataFrame, batch: int) -> None:
        latest = self.latest()
        before = batch - 1 if latest >= batch else max((b for b in [latest] if b < batch), default=-1)
        base, now_s = f"{self.folder}/{batch}", self.clock()
        tables = {name: self.table(name) for name in TABLES}

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{base}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{base}/{name}")

        events = events.select(*self.spark.createDataFrame([], EVENTS).columns)
        added = self.spark.createDataFrame([], KEYFRAMES)
        if self.sensors:
            events = kept(events, "given")
            added = self.register(events, batch, before, now_s)
            old = tables["keyframes"].read(before).where(F.col("due") <= now_s)
            expired = old.select("kf_id", F.lit(LAST).alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast("long").alias("map_id"), *[F.lit(0.0).alias(c) for c in AFFINE])
            # The event that registered is the first pose; others of its kind were turned away.
            sets = events.where(F.col("op").isin(*self.sensors)).join(added.select("kf_id"), "kf_id", "left_semi")
            sets = sets.groupBy("kf_id").agg(F.min_by(F.struct(*[c for c in events.columns if c != "kf_id"]), "seq").alias("r")).select("kf_id", "r.*").withColumn("op", F.lit("pose"))
            events = events.where(~F.col("op").isin(*self.sensors)).unionByName(sets.select(*events.columns)).unionByName(expired)
        now = keyframes.latest_poses(events)
        if not self.keep_clouds:
            binned = tables["partials"].read(before, tables["partials"].of(now)).select("kf_id").distinct()
            now = now.join(binned, "kf_id", "left_anti").unionByName(now.where("op = 'delete'")).distinct()
        now = kept(now, "events")
        touched = tables["poses"].of(now)
        ids = now.select("kf_id")
        known = tables["poses"].read(before, touched)
        tables["poses"].put(batch, before, known.join(ids, "kf_id", "left_anti").select(*known.columns).unionByName(now.where("op = 'pose'").select(*known.columns)), touched)
        mine = tables["keyframes"].read(before, touched).unionByName(added)
        tables["keyframes"].put(batch, before, mine.join(now.where("op = 'delete'").select("kf_id"), "kf_id", "left_anti"), touched)
        posed = now.where("op = 'pose'").select("kf_id", "map_id", *AFFINE)
        partials = tables["partials"].read(before, touched)
        cloud = self.clouds(mine.join(posed.select("kf_id"), "kf_id", "left_semi"))
        new = kept(moments.rebin(points.to_map(cloud, posed), self.lattice).select(*partials.columns), "new")
        delta = kept(keyframes.change(partials.join(ids, "kf_id", "left_semi").select(*new.columns), new).groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in MOMENTS]), "delta")
        tables["partials"].put(batch, before, partials.join(ids, "kf_id", "left_anti").select(*new.columns).unionByName(new), touched)
        in_cells = tables["cells"].of(delta)
        tables["cells"].put(batch, before, moments.fuse(tables["cells"].read(before, in_cells).select(*delta.columns).unionByName(delta)), in_cells)
        offsets = disc(self.fit.radius, self.lattice.res)
        # The disc is symmetric: a cell sees a changed one if and only if that one sees it.
        dirty = kept(feed.dilated(delta, offsets), "dirty")
        around = feed.dilated(dirty, offsets)
        near = tables["cells"].read(batch, tables["cells"].of(around)).join(around, CELL, "left_semi")
        refit = kept(hazard.hazards(near, self.lattice, self.fit).join(dirty, CELL, "left_semi"), "refit")
        in_dirty = tables["hazards"].of(dirty)
        fits = tables["hazards"].read(before, in_dirty)
        tables["hazards"].put(batch, before, fits.join(dirty, CELL, "left_anti").select(*refit.columns).unionByName(refit), in_dirty)
        if self.taps is None:
            tables["inflated"].put(batch, before, self.spark.createDataFrame([], INFLATED), [])
            fed = refit.withColumn("step_inflated", F.lit(None).cast("double"))
        else:
            fed = self.inflate(dirty, batch, before, tables, kept)
        gone = delta.select(*CELL).join(tables["cells"].read(batch, in_cells), CELL, "left_anti")
        kept(fed.withColumn("observed", F.lit(True)).unionByName(gone.withColumn("observed", F.lit(False)), allowMissingColumns=True), "feed")
        noted(self.spark, f"{self.folder}/done", str(max(batch, latest)))
        self.clean(batch)
        if self.on_update is not None:
            self.on_update(batch)

    def inflate(self, dirty: DataFrame, batch: int, before: int, tables: dict[str, Buckets], kept: Callable) -> DataFrame:
        """Inflates anew what a changed cell may reach; those cells' rows for the feed."""
        reach = [(i, j) for i, j, _ in self.taps]
        affected = kept(feed.dilated(dirty, reach), "affected")
        near = feed.dilated(affected, reach)
        steps = tables["hazards"].read(batch, tables["hazards"].of(near)).join(near, CELL, "left_semi")
        reached = kept(hazard.inflated(steps, self.taps, self.lethal).join(affected, CELL, "left_semi"), "reached")
        touched = tables["inflated"].of(affected)
        old = tables["inflated"].read(before, touched)
        tables["inflated"].put(batch, before, old.join(affected, CELL, "left_anti").select(*old.columns).unionByName(reached.select(*old.columns)), touched)
        return reached.select(*self.spark.createDataFrame([], HAZARDS).columns, "step_inflated")

    def clean(self, batch: int) -> None:
        """Deletes state that only batches before the kept ones need, and what passes between the steps of one."""
        kept = list(range(max(0, batch - self.keep + 1), batch + 1))
        if kept[0] > 0:
            for name in TABLES:
                table = self.table(name)
                if exists(self.spark, f"{table.path(kept[0] - 1)}-manifest"):
                    table.forget(kept[0] - 1, kept)
            for name in (*PASSING, "given"):
                deleted(self.spark, f"{self.folder}/{kept[0] - 1}/{name}")

    def loop_closed(self, batch: int, map_id: int = 0) -> None:
        """A batch that bins all keyframes of a map anew at their latest poses, so that all of its cells are in the feed."""
        poses = self.state(self.latest(), "poses").where(F.col("map_id") == map_id)
        self.process(poses.withColumn("seq", F.col("seq") + 1), batch)

    def rebuild(self, poses: DataFrame) -> DataFrame:
        """The cells of one batch run over poses (kf_id, map_id and pose columns)."""
        return moments.fuse(moments.rebin(points.to_map(self.clouds(), poses), self.lattice))

    def start(self, events: DataFrame, checkpoint: str, trigger: dict | None = None, timer: bool = False) -> StreamingQuery:
        """Follows a stream of events; trigger as for writeStream (all available rows, then stop, by default). With the timer, triggers
        without events are batches too, so that keyframes expire in time."""
        if timer:
            ticks = self.spark.readStream.format("rate").load().where("value < 0")
            events = events.unionByName(ticks.selectExpr(*[f"cast(null as {kind}) as {name}" for name, kind in events.dtypes]))
        return events.writeStream.foreachBatch(lambda df, batch: self.process(df, batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def expire(self, obstacles: DataFrame, now: float, ttl: float, seq: int) -> DataFrame:
        """Delete events for obstacle keyframes (kf_id, map_id, recv in seconds) whose time has run out."""
        old = obstacles.where(F.col("recv") + ttl <= now)
        return old.select("kf_id", F.lit(seq).cast("long").alias("seq"), F.lit("delete").alias("op"), "map_id", *[F.lit(0.0).alias(c) for c in AFFINE])


@dataclass
class Publisher:
    """Sparse updates for consumers: what changed since the last drain, or a snapshot once armed.

    It starts armed. Without consumers a publish drains and arms again; a snapshot does not drain, so the next delta may repeat cells.
    """

    engine: MapEngine
    layers: tuple[str, ...] = ("hazard", "elevation")
    #: Cells along a tile; an update has a row for each.
    side: int = 1024
    drained: int = -1
    armed: bool = True

    def publish(self, consumers: bool = True) -> DataFrame | None:
        latest = self.engine.latest()
        if not consumers:
            self.drained, self.armed = latest, True
            return None
        if self.armed:
            self.armed = False
            return feed.encoded(self.engine.hazards(), list(self.layers), self.engine.lattice, is_full=True, side=self.side)
        begin, self.drained = self.drained + 1, latest
        changed = None
        for batch in range(begin, latest + 1):
            now = self.engine.changes(batch).select(*CELL).distinct()
            changed = now if changed is None else changed.union(now).distinct()
        if changed is None or changed.isEmpty():
            return None
        # The state as of now, whatever it was when the cell changed; cells that went have no values.
        return feed.encoded(changed.join(self.engine.hazards(), CELL, "left"), list(self.layers), self.engine.lattice, is_full=False, side=self.side)


def buffered(clouds: DataFrame, span_us: int = 25_000_000, keep_us: int = 5_000_000) -> DataFrame:
    """What a source's buffer keeps: once it spans more than span_us, rows of the last keep_us only."""
    ends = clouds.groupBy("source").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    return clouds.join(ends, "source").where((F.col("_b") - F.col("_a") <= span_us) | (F.col("t") >= F.col("_b") - keep_us)).drop("_a", "_b")
