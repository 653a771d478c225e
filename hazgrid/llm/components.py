"""Connected components of links, by alternating large-star and small-star steps.

Links are only ever grouped and joined; none reach the driver. Each round is written to the shared folder, so its lineage
is short and lost executors cost a reread. The rounds end when a step changes nothing, which a count and a checksum of
the links show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazgrid.llm import common as C


def large_star(e: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the least of its neighbours and itself."""
    both = e.union(e.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(e: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours and itself to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node): for every node of a link (columns u and v, longs)."""
    e = C.written(links.select("u", "v").where("u <> v").distinct(), "links")
    seen = None
    while True:
        before, e = e, C.written(small_star(large_star(e)).where("u <> v").distinct(), "links")
        C.discard(links.sparkSession, before.written_at)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
