"""Registering keyframes whose clouds have very many points."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazgrid.operators import keyframes


def shuffled(plan) -> int:
    """Rows written by the shuffles of an executed plan."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    written = plan.metrics().get("shuffleRecordsWritten")
    below = plan.children()
    return (written.get().value() if written.isDefined() else 0) + sum(shuffled(below.apply(i)) for i in range(below.size()))


def test_points_are_one_row_a_keyframe_before_they_meet(spark):
    """The points of a keyframe are not sorted in one task: only its id is shuffled, once for each part that is read."""
    new = spark.createDataFrame([(k, s) for k in range(6) for s in (k + 10, k)] + [(None, 1)], "kf_id long, seq long")
    known = spark.createDataFrame([(1,), (4,)], "kf_id long")
    clouds = spark.range(40000, numPartitions=4).select(F.when(F.col("id") % 7 < 6, F.col("id") % 7 % 5).alias("kf_id"), F.lit(1.0).alias("x"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = keyframes.registered(new, known, clouds)
        assert sorted(tuple(r) for r in df.collect()) == [(0, 0), (2, 2), (3, 3)]
        rows = shuffled(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 0 < rows < 200
