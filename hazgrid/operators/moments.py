"""Mergeable and retractable moments of cells: counts and sums up to the second order.

x and y are relative to the cell's centre, z is absolute. All aggregates are sums, so Spark combines them before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazgrid.functions.lattice import Lattice

SUMS = ["sx", "sy", "sz", "sxx", "syy", "szz", "sxy", "sxz", "syz"]
MOMENTS = ["n", *SUMS]
CELL = ["map_id", "ci", "cj"]


def binned(points: DataFrame, lattice: Lattice) -> DataFrame:
    """Points with their cell, and x and y relative to its centre."""
    ci, cj = lattice.cell_of(F.col("x"), F.col("y"))
    cells = points.withColumns({"ci": ci, "cj": cj})
    cx, cy = lattice.center_of(F.col("ci"), F.col("cj"))
    return cells.withColumns({"lx": F.col("x") - cx, "ly": F.col("y") - cy})


def _summed(points: DataFrame, lattice: Lattice, *keys: str) -> DataFrame:
    x, y, z = F.col("lx"), F.col("ly"), F.col("z")
    sums = {"sx": x, "sy": y, "sz": z, "sxx": x * x, "syy": y * y, "szz": z * z, "sxy": x * y, "sxz": x * z, "syz": y * z}
    return binned(points, lattice).groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in sums.items()])


def rebin(points: DataFrame, lattice: Lattice) -> DataFrame:
    """Partials: the moments of each cell of each keyframe."""
    return _summed(points, lattice, "map_id", "kf_id", "ci", "cj")


def cells_of(points: DataFrame, lattice: Lattice) -> DataFrame:
    """Moments of each cell at once, in one shuffle, where nothing needs the keyframes' partials."""
    return _summed(points, lattice, *CELL)


def signed(partials: DataFrame, sign: int) -> DataFrame:
    return partials.withColumns({c: F.col(c) * sign for c in MOMENTS})


def fuse(partials: DataFrame) -> DataFrame:
    """Moments of each cell over its keyframes; signed partials retract. Cells that nothing is left of disappear."""
    return partials.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in MOMENTS]).where("n >= 1")


def shifted(dx: Column, dy: Column) -> dict[str, Column]:
    """The moment columns about an origin that lies (-dx, -dy, 0) off."""
    n, sx, sy, sz = (F.col(c) for c in ("n", "sx", "sy", "sz"))
    return {
        "sx": sx + n * dx, "sy": sy + n * dy, "sz": sz, "sxx": F.col("sxx") + 2 * sx * dx + n * dx * dx, "syy": F.col("syy") + 2 * sy * dy + n * dy * dy, "szz": F.col("szz"),
        "sxy": F.col("sxy") + sx * dy + sy * dx + n * dx * dy, "sxz": F.col("sxz") + sz * dx, "syz": F.col("syz") + sz * dy,
    }
