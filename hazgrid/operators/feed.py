"""Sparse updates: encoding cells, applying updates to a consumer's grid, dilation and bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazgrid.functions.lattice import Lattice, exploded, pack, unpack
from hazgrid.operators.moments import CELL


def encoded(cells: DataFrame, layers: list[str], lattice: Lattice, is_full: bool, side: int = 1024) -> DataFrame:
    """One update a map and tile of side x side cells: layers, keys in order, and values row by row (NaN for unknown).

    The middle tile lies about the origin, so a map within it is one row, as on the wire; a larger one has more rows, none of which outgrows
    a tile. A full update of several rows is one if they have one seq.
    """
    value = F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(float("nan")).cast("float")) for c in layers])
    tile = [F.floor((F.col(c) + side // 2) / side).cast("int").alias(f"tile_{c}") for c in ("ci", "cj")]
    rows = cells.select("map_id", *tile, pack(F.col("ci"), F.col("cj")).alias("key"), value.alias("values")).groupBy("map_id", "tile_ci", "tile_cj").agg(F.array_sort(F.collect_list(F.struct("key", "values"))).alias("rows"))
    return rows.select("map_id", F.lit(is_full).alias("is_full"), F.lit(lattice.res).alias("resolution"), F.lit(lattice.x0).alias("origin_x"), F.lit(lattice.y0).alias("origin_y"), F.array(*map(F.lit, layers)).alias("layers"), F.col("rows.key").alias("cell_keys"), F.flatten("rows.values").alias("values"))


def invalid(updates: DataFrame) -> DataFrame:
    """Updates that a consumer refuses: no layers, no resolution, or another number of values than keys times layers."""
    return updates.where((F.size("layers") == 0) | ~(F.col("resolution") > 0) | (F.size("values") != F.size("cell_keys") * F.size("layers")))


def decoded(updates: DataFrame) -> DataFrame:
    """Cells of valid updates: map_id, seq if there is one, ci, cj and a map of known layer values."""
    keep = [c for c in ("map_id", "seq", "is_full", "resolution", "origin_x", "origin_y", "layers") if c in updates.columns]
    ok = updates.where((F.size("layers") > 0) & (F.col("resolution") > 0) & (F.size("values") == F.size("cell_keys") * F.size("layers")))
    cells = ok.select(*keep, "values", F.posexplode("cell_keys").alias("k", "key"))
    ci, cj = unpack(F.col("key"))
    return cells.withColumns({"ci": ci, "cj": cj, "cell": F.slice("values", F.col("k") * F.size("layers") + 1, F.size("layers"))}).drop("values", "k", "key")


def applied(updates: DataFrame) -> DataFrame:
    """The grid that a consumer holds after updates (map_id, seq, ...) in order of seq.

    A full update, or one with other geometry or layers than the one before, starts anew; then the last value of a cell holds. Cells whose values are all unknown are clear.
    """
    geometry = F.struct("resolution", "origin_x", "origin_y", "layers")
    heads = updates.where((F.size("layers") > 0) & (F.col("resolution") > 0) & (F.size("values") == F.size("cell_keys") * F.size("layers")))
    from pyspark.sql.window import Window

    w = Window.partitionBy("map_id").orderBy("seq")
    # One row an update, without its cells.
    starts = heads.select("map_id", "seq", "is_full", geometry.alias("g")).distinct().withColumn("anew", F.col("is_full") | ~F.col("g").eqNullSafe(F.lag("g").over(w)))
    begin = starts.where("anew").groupBy("map_id").agg(F.max("seq").alias("begin"))
    cells = decoded(heads).join(begin, "map_id").where(F.col("seq") >= F.col("begin"))
    last = cells.groupBy(*CELL).agg(F.max_by(F.struct("layers", "cell"), "seq").alias("r"))
    return last.where(F.exists("r.cell", lambda v: ~F.isnan(v))).select(*CELL, F.posexplode(F.arrays_zip("r.layers", "r.cell")).alias("k", "v")).where(~F.isnan("v.cell")).select(*CELL, F.col("v.layers").alias("layer"), F.col("v.cell").alias("value"))


def dilated(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """The distinct cells within an offset of a cell."""
    return cells.select("map_id", "ci", "cj", exploded(offsets).alias("o")).select("map_id", (F.col("ci") + F.col("o.di")).alias("ci"), (F.col("cj") + F.col("o.dj")).alias("cj")).distinct()


def touched(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select(*CELL).union(new.select(*CELL)).distinct()


def bounds(cells: DataFrame, lattice: Lattice) -> DataFrame:
    """The least and greatest centres of each map's cells."""
    cx, cy = lattice.center_of(F.col("ci"), F.col("cj"))
    return cells.groupBy("map_id").agg(F.min(cx).alias("min_x"), F.max(cx).alias("max_x"), F.min(cy).alias("min_y"), F.max(cy).alias("max_y"), F.count("*").alias("n_cells"))


def described(updates: DataFrame) -> DataFrame:
    """What a consumer's grid is: resolution, origin and layers of its last update."""
    return updates.groupBy("map_id").agg(F.max_by(F.struct("resolution", "origin_x", "origin_y", "layers"), "seq").alias("g")).select("map_id", "g.*")
