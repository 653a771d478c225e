"""Inputs derived from the driver's tables. Coordinates are multiples of 1/64 on a lattice of 1/4, so sums are exact in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazgrid.functions.lattice import Lattice
from hazgrid.functions.poses import AFFINE
from hazgrid.operators.hazard import Fit

LATTICE = Lattice(0.25)
FIT = Fit(radius=0.4, ground_clearance=0.15, max_slope=0.4, min_points=3)
N_KEYFRAMES = 40


def poses(spark: SparkSession, moved: bool = False) -> DataFrame:
    """kf_id and pose of the 40 keyframes: quarter turns and half metres; moved: every fifth is a cell further in x."""
    k = spark.range(N_KEYFRAMES).withColumnRenamed("id", "kf_id")
    turn = F.col("kf_id") % 4
    cos, sin = F.element_at(F.array(*map(F.lit, (1.0, 0.0, -1.0, 0.0))), (turn + 1).cast("int")), F.element_at(F.array(*map(F.lit, (0.0, 1.0, 0.0, -1.0))), (turn + 1).cast("int"))
    tx = (F.col("kf_id") % 8) * 0.5 - 2.0 + (F.when(F.col("kf_id") % 5 == 0, 0.25).otherwise(0.0) if moved else F.lit(0.0))
    zero, one = F.lit(0.0), F.lit(1.0)
    columns = {"r00": cos, "r01": -sin, "r02": zero, "r10": sin, "r11": cos, "r12": zero, "r20": zero, "r21": zero, "r22": one, "tx": tx, "ty": ((F.col("kf_id") * 3) % 8) * 0.5 - 2.0, "tz": zero}
    return k.withColumns(columns).select("kf_id", *AFFINE)


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kf_id, x, y, z in the base frame; z follows the terrain at the point's place in the map."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    base = li.select(
        (F.col("l_orderkey") % N_KEYFRAMES).alias("kf_id"), (((F.col("l_partkey") * 37 + F.col("l_linenumber") * 11 + F.col("l_orderkey") * 101) % 512 - 256) / 64.0).alias("x"),
        (((F.col("l_suppkey") * 53 + F.col("l_orderkey") * 7 + F.col("l_linenumber") * 29) % 512 - 256) / 64.0).alias("y"), F.col("l_quantity").alias("q"),
    )
    k, x, y = F.col("kf_id") % 4, F.col("x"), F.col("y")
    mx = F.when(k == 0, x).when(k == 1, -y).when(k == 2, -x).otherwise(y) + (F.col("kf_id") % 8) * 0.5 - 2.0
    my = F.when(k == 0, y).when(k == 1, x).when(k == 2, -y).otherwise(-x) + ((F.col("kf_id") * 3) % 8) * 0.5 - 2.0
    z = F.floor(mx * 8) / 64.0 + F.when(my > 1.5, 0.5).otherwise(0.0) + (F.col("q") % 4) / 64.0
    return base.select("kf_id", "x", "y", z.alias("z"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, t (microseconds), seq, kind, value, and a place."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("source"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), "value", (F.floor(F.col("value") * 4) / 64.0).alias("x"), ((F.col("event_id") % 97) / 8.0).alias("y"), F.lit(0.0).alias("z"))
