"""Rank history of many windows: one job and one pass, whatever the number of chunks."""

from pyspark.sql import functions as F

from loomspark.operators import attention as A


def test_history_is_one_pass(spark):
    """A job or three for each chunk sent megabytes to the driver; batches and chunks now only cut the stream."""
    rows = spark.range(900).select((F.col("id") % 2).alias("head"), F.floor(F.col("id") / 2).alias("win"), F.lit(4).alias("n"), F.array(F.lit(3.0), F.lit(2.0), F.lit(1.0) + F.col("id") % 5, F.lit(0.5)).alias("s"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rank-history", "")
    before = len(tracker.getJobIdsForGroup("rank-history"))
    got = sorted(map(tuple, A.adaptive_rank_history(rows, 1, 3, chunk=7).collect()))
    jobs = len(tracker.getJobIdsForGroup("rank-history")) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 2 and len(got) == 900 and [g[:2] for g in got] == [(h, w) for h in (0, 1) for w in range(450)]
    assert got == sorted(map(tuple, A.adaptive_rank_history(rows, 1, 3, chunk=1000).collect()))
    for a, b in zip(got, got[1:]):
        assert a[0] != b[0] or b[3] == a[4]  # a target is the mean before it


def test_rounding_is_spark_s(spark):
    values = [0.5, 1.0000000005, 2.5e-10, 1.4999999995, 123456.0000000015, 1 / 3, -0.0000000005]
    want = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 9)).collect()]
    assert [A._round9(v) for v in values] == want
