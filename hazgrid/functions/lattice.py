"""The absolute lattice: cells of points, centres of cells, wire keys, discs and kernels, and the size of dense grids."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lattice:
    res: float
    x0: float = 0.0
    y0: float = 0.0

    def cell_of(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Indexes of the nearest centre; halves go away from zero."""
        return F.round((x - self.x0) / self.res).cast("int"), F.round((y - self.y0) / self.res).cast("int")

    def center_of(self, ci: Column, cj: Column) -> tuple[Column, Column]:
        return self.x0 + ci * self.res, self.y0 + cj * self.res


def pack(ci: Column, cj: Column) -> Column:
    """Both indexes in one BIGINT: ci above, the bits of cj below."""
    return ci.cast("long") * 4294967296 + cj + F.when(cj < 0, F.lit(4294967296)).otherwise(F.lit(0))


def unpack(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 32).cast("int"), F.shiftright(F.shiftleft(key, 32), 32).cast("int")


def disc(radius: float, res: float) -> list[tuple[int, int]]:
    """Offsets within a radius, one cell at least; symmetric."""
    rc = max(1.0, radius / res)
    n = math.floor(rc)
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= rc * rc]


def kernel(radius: float, res: float, scaling: float) -> list[tuple[int, int, float]]:
    """Offsets within a radius and how much of a seed's value reaches them."""
    return [(i, j, math.exp(-scaling * math.hypot(i, j) * res)) for i, j in disc(radius, res)]


def offsets(spark: SparkSession, cells: list[tuple]) -> DataFrame:
    """A table of a disc or kernel; its size follows from parameters, never from data."""
    return spark.createDataFrame(cells, "di int, dj int" + (", decay double" if cells and len(cells[0]) == 3 else ""))


def exploded(cells: list[tuple]) -> Column:
    """A disc or kernel as an array literal to explode: no join, no shuffle."""
    return F.explode(F.array(*[F.struct(F.lit(c[0]).alias("di"), F.lit(c[1]).alias("dj"), *([F.lit(c[2]).alias("decay")] if len(c) == 3 else [])) for c in cells]))


def cells_per_axis(half: float, res: float) -> int:
    """Always odd, so that a cell lies on the origin."""
    return 2 * math.ceil(half / res) + 1


def grown_half(half: float, origin: tuple[float, float], bounds: tuple[float, float, float, float], extend: float, res: float) -> float:
    """The half size that holds bounds (min x, max x, min y, max y): a pure function of them, in steps of extend, symmetric about the origin."""
    need = max(abs(bounds[0] - origin[0]), abs(bounds[1] - origin[0]), abs(bounds[2] - origin[1]), abs(bounds[3] - origin[1])) + res
    return half if need <= half else half + math.ceil((need - half) / extend) * extend
