"""Points: pruning, transforms, stitching and voxel downsampling. All in built-in expressions, so filters reach the scan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazgrid.functions.poses import AFFINE, transformed


def finite(*columns: Column) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


def prune(points: DataFrame, robot_height: float, max_range: float, min_range: float, base_from_sensor: np.ndarray | None = None) -> DataFrame:
    """Points in the base frame that are finite, no ego return, not above the robot, and in range (bounds kept).

    Ego returns are those on the sensor's own axis, so they go before the extrinsic applies.
    """
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    kept = points.where(finite(x, y, z) & ~((x == 0) & (y == 0)))
    if base_from_sensor is not None:
        m = base_from_sensor
        kept = kept.withColumns({n: float(m[i, 0]) * x + float(m[i, 1]) * y + float(m[i, 2]) * z + float(m[i, 3]) for i, n in enumerate("xyz")})
    norm = F.sqrt(x * x + y * y + z * z)
    return kept.where((z <= robot_height) & (norm <= max_range) & (norm >= min_range))


def to_map(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Points (kf_id, x, y, z in the base frame) in the map frame of their keyframe's pose.

    An equi-join on kf_id: poses are one row a keyframe, so AQE broadcasts them when their measured size allows, and splits a keyframe with very many points.
    """
    moved = points.join(poses.select("kf_id", *[c for c in poses.columns if c == "map_id"], *AFFINE), "kf_id")
    x, y, z = transformed(F.col("x"), F.col("y"), F.col("z"))
    return moved.withColumns({"x": x, "y": y, "z": z}).drop(*AFFINE)


def stitched(points: DataFrame, poses: DataFrame) -> DataFrame:
    """The union of all keyframes' clouds in their maps."""
    return to_map(points, poses).select("map_id", "x", "y", "z")


def voxel_downsample(points: DataFrame, vx: float, vy: float, vz: float) -> DataFrame:
    """The centroid of each voxel of each map; unless all sizes are positive, the points as they are."""
    if min(vx, vy, vz) <= 0:
        return points.select("map_id", "x", "y", "z")
    keys = [F.floor(F.col(c) / v).cast("long").alias(f"v{c}") for c, v in (("x", vx), ("y", vy), ("z", vz))]
    return points.groupBy("map_id", *keys).agg(*[(F.sum(c) / F.count("*")).alias(c) for c in "xyz"])
