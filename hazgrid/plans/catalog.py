"""Queries over the driver's tables, one for each operator, with SQL (in `oracle`) that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazgrid.functions import poses as pose_functions
from hazgrid.functions.lattice import disc, kernel, pack
from hazgrid.operators import asof, feed, hazard, keyframes, moments, outputs, points
from hazgrid.operators.moments import CELL, MOMENTS
from hazgrid.plans import fixtures as X
from hazgrid.plans.oracle import ORACLES

__all__ = ["ORACLES", "QUERIES"]

TAPS = kernel(0.5, X.LATTICE.res, 3.0)
FITTED = ["border", "elevation", "slope", "step", "roughness", "hazard", "normal_x", "normal_y", "normal_z"]
MINUTE = 60_000_000


def six(c: str) -> Column:
    """Six decimals, without a negative zero."""
    return (F.round(c, 6) + 0.0).alias(c)


def in_map(spark: SparkSession, sf_dir: str, moved: bool = False, map_id: Column | None = None) -> DataFrame:
    posed = X.poses(spark, moved).withColumn("map_id", F.lit(0).cast("long") if map_id is None else map_id)
    return points.to_map(X.cloud(spark, sf_dir), posed)


def partials(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return moments.rebin(in_map(spark, sf_dir, **how), X.LATTICE)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.cells_of(in_map(spark, sf_dir), X.LATTICE)


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hazard.hazards(cells(spark, sf_dir), X.LATTICE, X.FIT)


def prune_points(spark, sf_dir):
    return points.prune(X.cloud(spark, sf_dir), robot_height=0.4, max_range=3.5, min_range=0.5)


def bin_points(spark, sf_dir):
    return moments.binned(in_map(spark, sf_dir), X.LATTICE).select("kf_id", "ci", "cj", pack(F.col("ci"), F.col("cj")).alias("cell_key"), "lx", "ly", "z")


def rebin_partials(spark, sf_dir):
    return partials(spark, sf_dir).select("map_id", "kf_id", "ci", "cj", *MOMENTS)


def fuse_moments(spark, sf_dir):
    return moments.fuse(partials(spark, sf_dir)).select(*CELL, *MOMENTS)


def retract_keyframe(spark, sf_dir):
    p = partials(spark, sf_dir)
    return moments.fuse(p.unionByName(moments.signed(p.where("kf_id = 7"), -1))).select(*CELL, *MOMENTS)


def pose_update_rebin(spark, sf_dir):
    """Keyframes with a corrected pose: their old partials go, their new ones come."""
    updates = X.poses(spark, moved=True).where("kf_id % 5 = 0").withColumn("seq", F.lit(2)).unionByName(X.poses(spark).where("kf_id % 10 = 0").withColumn("seq", F.lit(1)))
    latest = keyframes.latest_poses(updates).drop("seq").withColumn("map_id", F.lit(0).cast("long"))
    old = partials(spark, sf_dir)
    new = moments.rebin(points.to_map(X.cloud(spark, sf_dir), latest), X.LATTICE)
    return moments.fuse(old.unionByName(keyframes.change(old.join(latest.select("kf_id"), "kf_id", "left_semi"), new))).select(*CELL, *MOMENTS)


def reparent_keyframe(spark, sf_dir):
    """Keyframes that move to the other map."""
    p = partials(spark, sf_dir, map_id=F.col("kf_id") % 2)
    moving = p.where("kf_id % 10 = 3")
    return moments.fuse(p.unionByName(keyframes.change(moving, moving.withColumn("map_id", 1 - F.col("map_id"))))).select(*CELL, *MOMENTS)


def rolling_last_n(spark, sf_dir):
    return moments.fuse(keyframes.last_n(partials(spark, sf_dir), 15)).select(*CELL, *MOMENTS)


def route_keyframes(spark, sf_dir):
    """Points of keyframes that a registry knows, by map, and those it rejects."""
    registry = X.poses(spark).where("kf_id < 30").select("kf_id", (F.col("kf_id") % 3).alias("map_id"))
    known, unknown = asof.routed(X.cloud(spark, sf_dir), registry)
    return known.groupBy("map_id").agg(F.count("*").alias("n_points")).unionByName(unknown.agg(F.count("*").alias("n_points")).select(F.lit(-1).cast("long").alias("map_id"), "n_points"))


def register_keyframes(spark, sf_dir):
    """New keyframes with points left after pruning that aren't known."""
    new = X.poses(spark).select("kf_id", (100 - F.col("kf_id")).alias("seq")).unionByName(X.poses(spark).select("kf_id", F.col("kf_id").alias("seq")))
    clouds = points.prune(X.cloud(spark, sf_dir).where("kf_id % 7 <> 1"), robot_height=0.4, max_range=3.5, min_range=0.5)
    return keyframes.registered(new, X.poses(spark).where("kf_id % 4 = 0").select("kf_id"), clouds)


def vicinity_fuse(spark, sf_dir):
    return hazard.vicinity(cells(spark, sf_dir), X.LATTICE, X.FIT.radius).select(*CELL, "own_n", "n_cells", "least_n", *MOMENTS)


def cell_hazards(spark, sf_dir):
    return fitted(spark, sf_dir).select(*CELL, "n", *map(six, FITTED))


def inflated_step(spark, sf_dir):
    return hazard.inflated(fitted(spark, sf_dir), TAPS, lethal=0.95).select(*CELL, six("step"), six("step_inflated"))


def with_occupancy(df: DataFrame, column: str = "hazard") -> DataFrame:
    return df.withColumn("occ", outputs.occupancy(F.round(column, 6)))


def occupancy(spark, sf_dir):
    return with_occupancy(fitted(spark, sf_dir)).select(*CELL, "occ")


def threshold(spark, sf_dir):
    return with_occupancy(fitted(spark, sf_dir)).select(*CELL, outputs.trinarised(F.col("occ"), 55).alias("state"))


def completeness_pool(spark, sf_dir):
    done = with_occupancy(fitted(spark, sf_dir).withColumn("border", F.least(F.col("n") / 40.0, F.lit(1.0))), "border")
    return outputs.min_pooled(done, "occ", 3, -30, -30).withColumn("byte", outputs.palette(F.col("occ")))


def crop_window(spark, sf_dir):
    center = X.poses(spark).select(F.lit(0).cast("long").alias("map_id"), F.col("tx").alias("x"), F.col("ty").alias("y"), "kf_id").where(F.col("kf_id") == X.N_KEYFRAMES - 1)
    return outputs.crop(fitted(spark, sf_dir), center, X.LATTICE, 3.0, 2.5).select(*CELL, "n", six("border"))


def dense_raster(spark, sf_dir):
    raster = outputs.dense(with_occupancy(fitted(spark, sf_dir)), "occ", (-8, 8, -8, 8))
    return raster.select("map_id", "cj", F.posexplode("row").alias("k", "occ")).select("map_id", (F.col("k") - 8).alias("ci"), "cj", "occ")


def update_of(df: DataFrame, seq: int, full: bool) -> DataFrame:
    return feed.encoded(df, ["n", "border"], X.LATTICE, full).withColumn("seq", F.lit(seq).cast("long"))


def sparse_update(spark, sf_dir):
    """The values of an encoded update, one row each, by place."""
    u = update_of(fitted(spark, sf_dir), 0, True)
    return u.select("map_id", "layers", "cell_keys", F.posexplode("values").alias("k", "v")).select("map_id", F.col("k").cast("long").alias("place"), F.element_at("cell_keys", F.floor(F.col("k") / 2).cast("int") + 1).alias("cell_key"), F.element_at("layers", F.col("k") % 2 + 1).alias("layer"), F.round(F.col("v").cast("double"), 4).alias("value"))


def apply_sparse_update(spark, sf_dir):
    """A snapshot of early keyframes, then changed cells of all of them; some cells are cleared."""
    early = moments.cells_of(in_map(spark, sf_dir).where("kf_id < 20"), X.LATTICE).withColumn("border", F.least(F.col("n") / 3, F.lit(1.0)))
    late = cells(spark, sf_dir).where("ci % 3 = 0").withColumn("border", F.least(F.col("n") / 3, F.lit(1.0)))
    cleared = late.withColumns({"n": F.when(F.col("cj") % 5 != 0, F.col("n")), "border": F.when(F.col("cj") % 5 != 0, F.col("border"))})
    grid = feed.applied(update_of(early, 1, True).unionByName(update_of(cleared, 2, False)))
    return grid.select(*CELL, "layer", F.round(F.col("value").cast("double"), 4).alias("value"))


def changed_cells(spark, sf_dir):
    """Cells that a correction touches, and whether their count changed."""
    old, new = partials(spark, sf_dir), partials(spark, sf_dir, moved=True)
    a, b = moments.fuse(old).select(*CELL, F.col("n").alias("old_n")), moments.fuse(new).select(*CELL, F.col("n").alias("new_n"))
    t = feed.touched(old.where("kf_id % 5 = 0"), new.where("kf_id % 5 = 0"))
    return t.join(a, CELL, "left").join(b, CELL, "left").select(*CELL, (~F.col("old_n").eqNullSafe(F.col("new_n"))).alias("count_changed"), F.col("new_n").isNotNull().alias("observed"))


def dilate_cells(spark, sf_dir):
    return feed.dilated(cells(spark, sf_dir).where("n >= 5"), disc(0.5, X.LATTICE.res))


def grid_bounds(spark, sf_dir):
    return feed.bounds(cells(spark, sf_dir), X.LATTICE)


def stitched_voxel_cloud(spark, sf_dir):
    return points.voxel_downsample(in_map(spark, sf_dir, map_id=F.col("kf_id") % 2).select("map_id", "x", "y", "z"), 0.5, 0.5, 0.25).select("map_id", "vx", "vy", "vz", *map(six, "xyz"))


def kind(spark, sf_dir, name: str) -> DataFrame:
    return X.events(spark, sf_dir).where(F.col("kind") == name).select("source", "t", "seq")


def nearest_cloud(spark, sf_dir):
    return asof.nearest(kind(spark, sf_dir, "click"), kind(spark, sf_dir, "view"))


def pose_lookup(spark, sf_dir):
    return asof.latest_before(kind(spark, sf_dir, "click"), kind(spark, sf_dir, "view"))


def approximate_pairs(spark, sf_dir):
    return asof.mutual_nearest(kind(spark, sf_dir, "click"), kind(spark, sf_dir, "view"), 600 * MINUTE)


def displacement_gate(spark, sf_dir):
    return keyframes.displacement_gate(X.events(spark, sf_dir).select("source", "t", "seq", "x", "y", "z"), 4.0).select("source", "t", "seq", "x", "y")


def rate_gate(spark, sf_dir):
    return keyframes.rate_gate(X.events(spark, sf_dir).select("source", "t", "seq"), 1440 * MINUTE)


def drift_poses(spark, sf_dir):
    p = X.events(spark, sf_dir).select("source", F.floor(F.col("t") / (10 * 1440 * MINUTE)).cast("long").alias("epoch"), "seq", "x", "y", ((F.col("seq") % 8) * 0.25).alias("yaw"))
    return keyframes.drifted(p, step=0.125, turn=0.015625).select("source", "epoch", "seq", *map(six, ("drift_x", "drift_y", "drift_yaw")))


def pair_segments(spark, sf_dir):
    return keyframes.segments(X.events(spark, sf_dir).where("kind = 'click'").select("source", "seq", "x", "y", "z"))


def merge_maps(spark, sf_dir):
    one = lambda keep, stamp: moments.fuse(partials(spark, sf_dir).where(keep)).select("ci", "cj", F.when(F.col("n") < 4, outputs.UNKNOWN).otherwise(F.least(F.col("n") * 5, F.lit(100)).cast("int")).alias("occ"), F.lit(stamp).alias("stamp"))
    return outputs.merged([one("kf_id < 25", 1), one("kf_id >= 20 and ci < 5", 2)])


def obstacle_ttl(spark, sf_dir):
    return keyframes.live_obstacles(X.events(spark, sf_dir).where("kind = 'error'").withColumn("recv", F.col("t") / 1e6), F.lit(1705000000.0), F.lit(432000.0)).select("source", "seq", six("recv"))


def buffer_retention(spark, sf_dir):
    from hazgrid.streaming.engine import buffered

    return buffered(kind(spark, sf_dir, "view"), 20 * 1440 * MINUTE, 5 * 1440 * MINUTE)


def seconds_and_yaw(spark, sf_dir):
    """Times in seconds, and the yaw of quaternions about the vertical."""
    e = X.events(spark, sf_dir).withColumn("half", (F.col("seq") % 16) * 0.1875)
    zero = F.lit(0.0)
    return e.select("seq", pose_functions.ns_to_sec(F.col("t") * 1000).alias("sec"), F.round(pose_functions.yaw_of(F.cos("half"), zero, zero, F.sin("half")), 6).alias("yaw")).select("seq", F.round("sec", 3).alias("sec"), (F.col("yaw") + 0.0).alias("yaw"))


def one_shot_cloud(spark, sf_dir):
    """A static cloud as one keyframe at the origin: pruning off, binned once."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit(0).cast("long").alias("kf_id"), *[(F.floor(F.element_at("embedding", i + 1).cast("double") * 640) / 64.0).alias(c) for i, c in enumerate("xyz")])
    kept = points.prune(e, robot_height=1e9, max_range=1e9, min_range=0.0).withColumn("map_id", F.lit(0).cast("long"))
    return moments.cells_of(kept, X.LATTICE).select(*CELL, *MOMENTS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        cell_hazards, prune_points, bin_points, rebin_partials, fuse_moments, retract_keyframe, pose_update_rebin, reparent_keyframe, rolling_last_n, route_keyframes, register_keyframes, vicinity_fuse, inflated_step, occupancy, threshold, completeness_pool, crop_window, dense_raster,
        sparse_update, apply_sparse_update, changed_cells, dilate_cells, grid_bounds, stitched_voxel_cloud, nearest_cloud, pose_lookup, approximate_pairs, displacement_gate, rate_gate, drift_poses, pair_segments, merge_maps, obstacle_ttl, buffer_retention, seconds_and_yaw, one_shot_cloud,
    )
}
