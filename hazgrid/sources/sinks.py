"""Sinks: navigation layers, occupancy rasters, change feeds and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazgrid.operators.outputs import occupancy

NAV_LAYERS = ["hazard", "elevation", "slope", "step", "roughness", "border"]


def write_grid(cells: DataFrame, path: str, layers: list[str] = NAV_LAYERS) -> None:
    """The published layers of observed cells, replacing what was there."""
    cells.select("map_id", "ci", "cj", *layers).write.mode("overwrite").parquet(path)


def write_occupancy(cells: DataFrame, path: str, column: str = "hazard") -> None:
    cells.select("map_id", "ci", "cj", occupancy(F.col(column)).cast("tinyint").alias("occ")).write.mode("overwrite").parquet(path)


def append_feed(updates: DataFrame, path: str, batch_id: int) -> None:
    """A batch of a change feed in a folder of its own, so a batch that runs again replaces itself."""
    updates.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def append_segments(segments: DataFrame, path: str) -> None:
    segments.select(*[f"{c}{k}" for k in (1, 2) for c in "xyz"]).write.mode("append").csv(path)


def write_points(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").parquet(path)
