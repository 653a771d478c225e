"""Versioned tables in buckets: a batch writes only the buckets that it changes, and a manifest names the current version of each.

A version is the batch that wrote it, so a batch that runs again replaces its own files and nothing else. Versions that no kept batch
refers to are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def by_keyframe(n: int) -> Column:
    return F.pmod("kf_id", F.lit(n)).cast("int")


def by_tile(n: int) -> Column:
    """Cells by tiles of 32 x 32, so that a change in one place touches few buckets."""
    return F.pmod(F.xxhash64("map_id", F.shiftright("ci", 5), F.shiftright("cj", 5)), F.lit(n)).cast("int")


def place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def note(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, where = place(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def noted(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file, under another name first, so that it is there whole or not at all."""
    fs, where = place(spark, path)
    draft = place(spark, f"{path}.draft")[1]
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(where, True)
    fs.rename(draft, where)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = place(spark, path)
    return fs.exists(where)


def deleted(spark: SparkSession, path: str) -> None:
    fs, where = place(spark, path)
    fs.delete(where, True)


@dataclass(frozen=True)
class Buckets:
    spark: SparkSession
    folder: str
    name: str
    schema: str
    bucket: Callable[[int], Column]
    n: int = 64

    def path(self, version: int, bucket: int | None = None) -> str:
        return f"{self.folder}/{version}/{self.name}" + ("" if bucket is None else f"/_bucket={bucket}")

    def manifest(self, batch: int) -> dict[int, int]:
        """The version of each bucket that has rows: n entries at most."""
        return {} if batch < 0 else {int(k): v for k, v in json.loads(note(self.spark, f"{self.path(batch)}-manifest")).items()}

    def of(self, rows: DataFrame) -> list[int]:
        """The buckets that rows are in: n numbers at most."""
        return sorted(r[0] for r in rows.select(self.bucket(self.n)).distinct().collect())

    def read(self, batch: int, only: list[int] | None = None) -> DataFrame:
        paths = [self.path(v, k) for k, v in sorted(self.manifest(batch).items()) if only is None or k in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def put(self, batch: int, before: int, rows: DataFrame, touched: list[int]) -> None:
        """The version of a batch: rows in the touched buckets, the others as before."""
        columns = self.spark.createDataFrame([], self.schema).columns
        now = {k: v for k, v in self.manifest(before).items() if k not in touched}
        if touched:
            rows.select(*columns, self.bucket(self.n).alias("_bucket")).repartition(F.col("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(self.path(batch))
            now |= dict.fromkeys(self.written(batch), batch)
        noted(self.spark, f"{self.path(batch)}-manifest", json.dumps(now))

    def written(self, batch: int) -> list[int]:
        fs, where = place(self.spark, self.path(batch))
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return [int(x.split("=")[1]) for x in names if x.startswith("_bucket=")]

    def forget(self, batch: int, kept: list[int]) -> None:
        """Deletes what a batch's manifest names and no kept one's does."""
        held = {(k, v) for b in kept for k, v in self.manifest(b).items()}
        for k, v in self.manifest(batch).items():
            if (k, v) not in held:
                deleted(self.spark, self.path(v, k))
        deleted(self.spark, f"{self.path(batch)}-manifest")
