"""Keyframes: registering, latest poses, rolling windows, signed changes, gates, drift and paired clicks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazgrid.operators.moments import signed

LARGEST_ID = 2**63 - 1


def valid(kf_id: Column) -> Column:
    """The id, or an error where it is null or negative (beyond a signed 64-bit number)."""
    return F.when(kf_id >= 0, kf_id).otherwise(F.raise_error(F.lit("keyframe ids are from 0 to 2^63 - 1")).cast("long"))


def registered(new: DataFrame, known: DataFrame, clouds: DataFrame) -> DataFrame:
    """New keyframes that aren't known and have a point left; the first of equal ids by seq.

    Points become one row a keyframe where they are read, so no task sorts all points of one.
    """
    first = new.groupBy("kf_id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "kf_id"]), "seq").alias("r")).select("kf_id", "r.*")
    return first.join(known, "kf_id", "left_anti").join(clouds.select("kf_id").distinct(), "kf_id", "left_semi")


def latest_poses(updates: DataFrame) -> DataFrame:
    """The pose of each keyframe with the greatest seq."""
    rest = [c for c in updates.columns if c != "kf_id"]
    return updates.groupBy("kf_id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("kf_id", "r.*")


def with_updates(poses: DataFrame, updates: DataFrame) -> DataFrame:
    """Poses with those that were updated replaced by their latest."""
    new = latest_poses(updates).join(poses.select("kf_id"), "kf_id", "left_semi")
    return poses.join(new, "kf_id", "left_anti").unionByName(new.select(*poses.columns))


def last_n(keyframes: DataFrame, n: int) -> DataFrame:
    """Those whose id is above the greatest id less n, by map. Ids count, whether or not their clouds had points."""
    top = keyframes.groupBy("map_id").agg(F.max("kf_id").alias("_top"))
    return keyframes.join(top, "map_id").where(F.col("kf_id") > F.col("_top") - n).drop("_top")


def change(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed partials that turn a map with the old partials into one with the new."""
    return signed(old, -1).unionByName(new)


def live_obstacles(obstacles: DataFrame, now: Column, ttl: Column) -> DataFrame:
    """Those whose deadline, receipt and time to live, is still ahead."""
    return obstacles.where(F.col("recv") + ttl > now)


def obstacle_ids(n: int, free: list[int] | None = None) -> list[int]:
    """Ids for obstacles from the largest down; freed ones are used first, the last freed before others."""
    free = list(free or [])
    out, down = [], LARGEST_ID
    while len(out) < n:
        if free:
            out.append(free.pop())
        else:
            out.append(down)
            down -= 1
    return out


def _gated(rows: DataFrame, source: str, order: list[str], state: list[str], accepts: Callable) -> DataFrame:
    """Rows that a gate accepts, by its state, the values of the last accepted row.

    A source's rows are sorted in one partition (disk serves where memory doesn't) and pass in batches; only the state is carried from one to the next.
    """
    rest = [c for c in rows.columns if c not in (source, *order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last, begun = None, None, False
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            names = batch.column(source).to_pylist()
            for i, x in enumerate(zip(*(batch.column(c).to_pylist() for c in state), strict=True)):
                if not begun or names[i] != of:
                    of, last, begun = names[i], None, True
                if accepts(last, x):
                    keep[i], last = True, x
            yield batch.filter(pa.array(keep))

    return rows.repartition(source).sortWithinPartitions(source, *order, *rest).mapInArrow(run, rows.schema)


def displacement_gate(rows: DataFrame, threshold: float, source: str = "source") -> DataFrame:
    """Rows (source, t, seq, x, y, z) that moved by the threshold or more from the last accepted one; the first is accepted. A row without a place has not moved."""
    return _gated(rows, source, ["t", "seq"], ["x", "y", "z"], lambda last, x: last is None or (None not in last and None not in x and math.dist(last, x) >= threshold))


def rate_gate(rows: DataFrame, period: int, source: str = "source") -> DataFrame:
    """Rows (source, t, seq) a period or more after the last accepted one; the first is accepted, and so is the next after one without a time."""
    return _gated(rows, source, ["t", "seq"], ["t"], lambda last, x: last is None or last[0] is None or (x[0] is not None and x[0] - last[0] >= period))


def drifted(poses: DataFrame, step: float, turn: float) -> DataFrame:
    """Poses (source, epoch, seq, x, y, yaw) with drift that grows by a step along the yaw and by a turn with each kept one; a new epoch (loop closure) begins at none."""
    w = Window.partitionBy("source", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = poses.withColumns({"dx": F.sum(step * F.cos("yaw")).over(w), "dy": F.sum(step * F.sin("yaw")).over(w), "dyaw": F.count("*").over(w) * turn})
    return moved.withColumns({"drift_x": F.col("x") + F.col("dx"), "drift_y": F.col("y") + F.col("dy"), "drift_yaw": F.col("yaw") + F.col("dyaw")}).drop("dx", "dy", "dyaw")


def segments(clicks: DataFrame) -> DataFrame:
    """Consecutive clicks of a source as segments: first and second, third and fourth; a last one without a second is dropped."""
    w = Window.partitionBy("source").orderBy("seq")
    ends = {f"{c}2": F.lead(c).over(w) for c in "xyz"}
    return clicks.withColumns(ends | {"rank": F.row_number().over(w)}).where((F.col("rank") % 2 == 1) & F.col("x2").isNotNull()).select("source", F.expr("cast((rank + 1) div 2 as int)").alias("segment"), *[F.col(c).alias(f"{c}1") for c in "xyz"], "x2", "y2", "z2")
