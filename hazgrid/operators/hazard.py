"""Hazard metrics of cells from a plane fit over the disc around them.

Cells are dealt to square tiles with a halo as wide as the disc, so a cell is shuffled once, or up to four times near a tile's edge, whatever the disc's size. Within its
tile it sends its moments, shifted to the receiver's origin, to the cells whose disc it lies in; these are summed without another shuffle, and a
receiver gets at most one row for each offset of the disc. The eigenvalues of a 3x3
covariance have a closed form, so all stays in JVM expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazgrid.functions.lattice import Lattice, disc, exploded
from hazgrid.operators.moments import CELL, SUMS, shifted


@dataclass(frozen=True)
class Fit:
    radius: float
    ground_clearance: float = 0.15
    max_slope: float = 0.4
    min_points: int = 3


def vicinity(cells: DataFrame, lattice: Lattice, radius: float) -> DataFrame:
    """For each observed cell: the fused moments of its disc about its own centre, how many cells the disc has and the fewest points of one, its own n and sz, and the barycentres (at most one for each offset)."""
    offsets = disc(radius, lattice.res)
    reach = max(i for i, _ in offsets)
    side = max(32, 8 * reach)
    near = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / side).cast("int") for d in (-reach, reach)]))
    dealt = cells.withColumn("tile_i", F.explode(near("ci"))).withColumn("tile_j", F.explode(near("cj"))).withColumn("tile", F.xxhash64("map_id", "tile_i", "tile_j")).repartition("tile")
    sent = dealt.select("*", exploded(offsets).alias("o"))
    dx, dy = F.col("o.di") * lattice.res, F.col("o.dj") * lattice.res
    sent = sent.withColumns(shifted(dx, dy)).withColumns({"ci": F.col("ci") - F.col("o.di"), "cj": F.col("cj") - F.col("o.dj"), "self": (F.col("o.di") == 0) & (F.col("o.dj") == 0)})
    sent = sent.where((F.floor(F.col("ci") / side) == F.col("tile_i")) & (F.floor(F.col("cj") / side) == F.col("tile_j")))
    point = F.struct(*[(F.col(s) / F.col("n")).alias(a) for a, s in (("x", "sx"), ("y", "sy"), ("z", "sz"))])
    return sent.groupBy(*CELL, "tile_i", "tile_j", "tile").agg(
        F.max(F.when(F.col("self"), F.col("n"))).alias("own_n"), F.max(F.when(F.col("self"), F.col("sz"))).alias("own_sz"), F.count("*").alias("n_cells"), F.min("n").alias("least_n"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS], F.collect_list(point).alias("centers"),
    ).where("own_n >= 1").drop("tile_i", "tile_j", "tile")


def named(columns: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body of a struct of the columns, each of which is computed once. Lambda variables aren't inlined, so plans stay as small as the formulas."""
    return F.transform(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])), body)[0]


def plane(v: dict[str, Column], centers: Column) -> Column:
    """Struct of the smallest eigenvalue of a covariance, its unit vector (z up) and the extent of the centres along it; null without one such direction.

    Trigonometric solution of the characteristic polynomial; the vector is the longest cross product of two rows of the matrix less the eigenvalue.
    """
    zero, one = F.lit(0.0), F.lit(1.0)

    def with_trace(c):
        q = (c.axx + c.ayy + c.azz) / 3.0
        off = c.axy * c.axy + c.axz * c.axz + c.ayz * c.ayz
        return named({"q": q, "p": F.sqrt(((c.axx - q) * (c.axx - q) + (c.ayy - q) * (c.ayy - q) + (c.azz - q) * (c.azz - q) + 2.0 * off) / 6.0)}, lambda t: with_root(c, t))

    def with_root(c, t):
        x, y, z = c.axx - t.q, c.ayy - t.q, c.azz - t.q
        det = (x * (y * z - c.ayz * c.ayz) - c.axy * (c.axy * z - c.ayz * c.axz) + c.axz * (c.axy * c.ayz - y * c.axz)) / F.nullif(t.p * t.p * t.p, zero)
        low = t.q + 2.0 * t.p * F.cos(F.acos(F.greatest(F.least(det / 2.0, one), -one)) / 3.0 + F.lit(2.0 * math.pi / 3.0))
        return named({"low": F.when(det.isNotNull(), low)}, lambda e: with_rows(c, e))

    def with_rows(c, e):
        return named({"xx": c.axx - e.low, "yy": c.ayy - e.low, "zz": c.azz - e.low}, lambda d: with_crosses(c, e, d))

    def with_crosses(c, e, d):
        rows = [
            (c.axy * c.ayz - c.axz * d.yy, c.axz * c.axy - d.xx * c.ayz, d.xx * d.yy - c.axy * c.axy),
            (c.axy * d.zz - c.axz * c.ayz, c.axz * c.axz - d.xx * d.zz, d.xx * c.ayz - c.axy * c.axz),
            (d.yy * d.zz - c.ayz * c.ayz, c.ayz * c.axz - c.axy * d.zz, c.axy * c.ayz - d.yy * c.axz),
        ]
        each = F.array(*[F.struct(*[v.alias(a) for v, a in zip(r, "xyz", strict=True)]) for r in rows])
        long = F.transform(each, lambda r: F.struct((r.x * r.x + r.y * r.y + r.z * r.z).alias("w"), r.x.alias("x"), r.y.alias("y"), r.z.alias("z")))
        return named({"best": F.array_max(long)}, lambda m: with_normal(c, e, m.best))

    def with_normal(c, e, m):
        length = F.nullif(F.sqrt(m.w), zero) * F.when(m.z < 0, -1.0).otherwise(1.0)
        return named({"x": m.x / length, "y": m.y / length, "z": m.z / length}, lambda n: with_extent(c, e, n))

    def with_extent(c, e, n):
        along = F.transform(centers, lambda b: (b.x - c.mx) * n.x + (b.y - c.my) * n.y + (b.z - c.mz) * n.z)
        return named({"a": along}, lambda r: F.when(n.x.isNotNull(), F.struct(e.low.alias("low"), n.x.alias("x"), n.y.alias("y"), n.z.alias("z"), (F.array_max(r.a) - F.array_min(r.a)).alias("extent"))))

    return named(v, with_trace)


def hazards(cells: DataFrame, lattice: Lattice, fit: Fit) -> DataFrame:
    """border, elevation, slope, step, roughness, hazard and the normal of each observed cell.

    All but border is null unless the cell and every cell of its disc have enough points, or if the covariance has no one smallest direction.
    """
    k = len(disc(fit.radius, lattice.res))
    v = vicinity(cells, lattice, fit.radius)
    ok = (F.col("n_cells") == k) & (F.col("least_n") >= fit.min_points) & (F.col("own_n") >= fit.min_points)
    n = F.col("n").cast("double")
    mean = {f"m{a}": F.col(f"s{a}") / n for a in "xyz"}
    cov = {f"a{p}": F.col(f"s{p}") / n - mean[f"m{p[0]}"] * mean[f"m{p[1]}"] for p in ("xx", "yy", "zz", "xy", "xz", "yz")}
    one = F.lit(1.0)
    v = v.withColumn("fit", F.when(ok, plane(mean | cov, F.col("centers"))))
    v = v.select(
        *CELL, F.col("own_n").alias("n"), F.least(F.col("own_n") / F.greatest(F.lit(1), F.lit(fit.min_points)), one).alias("border"), F.when(ok, F.col("own_sz") / F.col("own_n")).alias("elevation"),
        F.when(F.col("fit").isNotNull(), F.struct(
            F.least(F.acos(F.least(one, F.abs("fit.z"))) / fit.max_slope, one).alias("slope"), F.least(F.col("fit.extent") / fit.ground_clearance, one).alias("step"), F.least(F.sqrt(F.greatest(F.lit(0.0), F.col("fit.low"))) / fit.ground_clearance, one).alias("roughness"),
            F.col("fit.x").alias("x"), F.col("fit.y").alias("y"), F.col("fit.z").alias("z"),
        )).alias("fit"),
    )
    return v.select(*CELL, "n", "border", "elevation", "fit.slope", "fit.step", "fit.roughness", F.greatest("fit.slope", "fit.step", "fit.roughness").alias("hazard"), *[F.col(f"fit.{a}").alias(f"normal_{a}") for a in "xyz"])


def inflated(cells: DataFrame, taps: list[tuple[int, int, float]], lethal: float) -> DataFrame:
    """Observed cells with the strongest decayed step of a lethal cell near them, 0 where there is none.

    Only lethal cells are exploded by the kernel, so its size does not multiply the map.
    """
    reach = cells.where(F.col("step") >= lethal).select("map_id", "ci", "cj", "step", exploded(taps).alias("o"))
    reach = reach.groupBy("map_id", (F.col("ci") + F.col("o.di")).alias("ci"), (F.col("cj") + F.col("o.dj")).alias("cj")).agg(F.max(F.col("step") * F.col("o.decay")).alias("reached"))
    return cells.join(reach, CELL, "left").withColumn("step_inflated", F.coalesce("reached", F.lit(0.0))).drop("reached")
