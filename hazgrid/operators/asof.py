"""Joins by time.

Rows of both sides meet by source and stretch of time, are sorted once there, and see their nearest neighbours in the other side by window functions, so no pair
but the wanted ones is made. What lies beyond a stretch comes from its source's summary: the first and last right row of each stretch, carried over empty ones.
So a source with very many rows is many tasks, and only its stretches (a row each) meet in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _both(left: DataFrame, right: DataFrame, source: str, time: str, seq: str) -> DataFrame:
    """Rows of both sides as one, right ones first at equal times, earlier arrivals last among the right ones before a left one."""
    l = left.select(F.col(source).alias("source"), F.col(time).alias("t"), F.lit(1).alias("side"), F.col(seq).alias("seq"), F.struct(*left.columns).alias("row"), F.lit(None).cast("struct<t:bigint,seq:bigint>").alias("hit"))
    r = right.select(F.col(source).alias("source"), F.col(time).alias("t"), F.lit(0).alias("side"), F.col(seq).alias("seq"), F.lit(None).cast(l.schema["row"].dataType).alias("row"), F.struct(F.col(time).cast("long").alias("t"), F.col(seq).cast("long").alias("seq")).alias("hit"))
    return l.unionByName(r)


SPAN = 3_600_000_000


def _neighbours(both: DataFrame, span: int) -> DataFrame:
    """Left rows with the last right row at or before them (b), the first at or after (a), and the newest of their source (newest)."""
    cut = both.withColumn("stretch", F.floor(F.col("t") / span))
    ends = cut.groupBy("source", "stretch").agg(F.min("hit").alias("first"), F.max("hit").alias("last"))
    line = Window.partitionBy("source").orderBy("stretch")
    ends = ends.select(
        F.col("source").alias("_s"), F.col("stretch").alias("_k"), F.last("last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("first", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("later"), F.max("last").over(Window.partitionBy("source")).alias("newest"),
    )
    own = Window.partitionBy("source", "stretch").orderBy("t", "side", "seq")
    seen = cut.join(ends, F.col("source").eqNullSafe(F.col("_s")) & (F.col("stretch") == F.col("_k")))
    before = F.last("hit", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("hit", ignorenulls=True).over(own.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return seen.withColumns({"b": F.coalesce(before, "earlier"), "a": F.coalesce(after, "later")}).where("side = 1")


def nearest(left: DataFrame, right: DataFrame, source: str = "source", time: str = "t", seq: str = "seq", span: int = SPAN) -> DataFrame:
    """Each left row with the right row nearest in time (hit_seq, hit_t), the earliest arrival of equals, null without any. Times are longs."""
    # One right row for each time: the first to arrive.
    first = right.groupBy(source, time).agg(F.min(seq).alias(seq))
    seen = _neighbours(_both(left, first, source, time, seq), span)
    gap_b, gap_a = F.col("t") - F.col("b.t"), F.col("a.t") - F.col("t")
    pick = F.when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("b")).when((gap_a < gap_b) | ((gap_a == gap_b) & (F.col("a.seq") < F.col("b.seq"))), F.col("a")).otherwise(F.col("b"))
    return seen.withColumn("hit", pick).select("row.*", F.col("hit.seq").alias("hit_seq"), F.col("hit.t").alias("hit_t"))


def latest_before(left: DataFrame, right: DataFrame, source: str = "source", time: str = "t", seq: str = "seq", span: int = SPAN) -> DataFrame:
    """Each left row with the last right row at or before it (of equal times the last to arrive); without one, the latest of all of its source; null without any."""
    last = right.groupBy(source, time).agg(F.max(seq).alias(seq))
    seen = _neighbours(_both(left, last, source, time, seq), span).withColumn("hit", F.coalesce("b", "newest"))
    return seen.select("row.*", F.col("hit.seq").alias("hit_seq"), F.col("hit.t").alias("hit_t"))


def mutual_nearest(left: DataFrame, right: DataFrame, tolerance: int, source: str = "source", time: str = "t", seq: str = "seq") -> DataFrame:
    """One-to-one pairs: each is the other's nearest, within the tolerance. A declared approximation of pairing by approximate time."""
    there = nearest(left, right, source, time, seq)
    back = nearest(right, left, source, time, seq).select(F.col(source).alias("_s"), F.col(seq).alias("_r"), F.col("hit_seq").alias("_l"))
    return there.where(F.abs(F.col(time) - F.col("hit_t")) <= tolerance).join(back, (F.col(source) == F.col("_s")) & (F.col("hit_seq") == F.col("_r")) & (F.col(seq) == F.col("_l"))).drop("_s", "_r", "_l")


def routed(rows: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the map of their keyframe, and those whose keyframe isn't known."""
    return rows.drop("map_id").join(registry.select("kf_id", "map_id"), "kf_id"), rows.join(registry, "kf_id", "left_anti")


