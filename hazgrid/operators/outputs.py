"""What maps are published as: occupancy, completeness, crops, merged maps and dense rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazgrid.functions.lattice import Lattice

UNKNOWN = -1


def occupancy(value: Column) -> Column:
    """[0, 1] to whole hundredths, clamped; unknown is -1."""
    return F.when(value.isNull() | F.isnan(value), UNKNOWN).otherwise(F.floor(100.0 * F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).cast("int"))


def trinarised(occ: Column, threshold: int = 85) -> Column:
    """100 from the threshold on; unknown stays; the rest is free. In that order."""
    return F.when(occ >= threshold, 100).when(occ == UNKNOWN, UNKNOWN).otherwise(0)


def binarised(occ: Column) -> Column:
    return F.when(occ > 60, 100).otherwise(0)


def palette(occ: Column) -> Column:
    """Completeness as a signed byte of a display's palette: done 113, else 128 to 254 wrapped, unknown as it is."""
    byte = 128 + F.round(occ / 100.0 * 126).cast("int")
    return F.when(occ == UNKNOWN, UNKNOWN).when(occ >= 100, 113).otherwise(F.when(byte > 127, byte - 256).otherwise(byte))


def pool_factor(target: float, res: float) -> int:
    return max(1, int(target / res + 0.5))


def min_pooled(cells: DataFrame, column: str, factor: int, i0: int, j0: int) -> DataFrame:
    """The least known value of each block of factor x factor cells from the grid's lower left (i0, j0); -1 if none is known."""
    known = F.when(F.col(column) != UNKNOWN, F.col(column))
    block = [F.floor((F.col(c) - o) / factor).cast("int").alias(b) for c, o, b in (("ci", i0, "bi"), ("cj", j0, "bj"))]
    return cells.groupBy("map_id", *block).agg(F.coalesce(F.min(known), F.lit(UNKNOWN)).alias(column))


def crop(cells: DataFrame, centers: DataFrame, lattice: Lattice, width: float, height: float) -> DataFrame:
    """Cells whose centres lie in a rectangle about each map's point (map_id, x, y); edges belong to it.

    One point a map: an equi-join that AQE broadcasts by measured size.
    """
    cx, cy = lattice.center_of(F.col("ci"), F.col("cj"))
    near = cells.join(centers.select("map_id", F.col("x").alias("_x"), F.col("y").alias("_y")), "map_id")
    return near.where(cx.between(F.col("_x") - width / 2, F.col("_x") + width / 2) & cy.between(F.col("_y") - height / 2, F.col("_y") + height / 2)).drop("_x", "_y")


def merged(maps: list[DataFrame]) -> DataFrame:
    """Maps (ci, cj, occ, stamp) in one: binarised, unknown never overwrites, the last writer wins (of equal stamps the larger value)."""
    out = maps[0].select("ci", "cj", "occ", "stamp")
    for m in maps[1:]:
        out = out.unionByName(m.select("ci", "cj", "occ", "stamp"))
    known = out.where(F.col("occ") != UNKNOWN).withColumn("occ", binarised(F.col("occ")))
    return known.groupBy("ci", "cj").agg(F.max_by("occ", F.struct("stamp", "occ")).alias("occ"))


def dense(cells: DataFrame, column: str, bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Rows of a raster (map_id, cj, values from i0 to i1), -1 where nothing is known. The bounds bound a row's array.

    With bounds, rows without a cell are left out. Without, each map's own extent bounds it (i0 is a column then), and every row is there.
    """
    value = lambda i: F.coalesce(F.element_at("m", i.cast("int")), F.lit(UNKNOWN))
    row = F.map_from_entries(F.collect_list(F.struct("ci", column))).alias("m")
    if bounds is None:
        extent = cells.groupBy("map_id").agg(F.min("ci").alias("i0"), F.max("ci").alias("i1"), F.min("cj").alias("j0"), F.max("cj").alias("j1"))
        rows = extent.select("map_id", "i0", "i1", F.explode(F.sequence("j0", "j1")).alias("cj"))
        held = rows.join(cells.groupBy("map_id", "cj").agg(row), ["map_id", "cj"], "left")
        return held.select("map_id", "cj", "i0", F.transform(F.sequence("i0", "i1"), value).alias("row"))
    i0, i1, j0, j1 = bounds
    within = cells.where(F.col("ci").between(i0, i1) & F.col("cj").between(j0, j1))
    held = within.groupBy("map_id", "cj").agg(row)
    return held.select("map_id", "cj", F.transform(F.sequence(F.lit(i0), F.lit(i1)), value).alias("row"))
