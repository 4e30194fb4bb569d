import time

import pytest

from loomspark.streaming import keyed

TOKENS = "doc_id long, tok_idx long, seg int"
PARAGRAPHS = "doc_id long, ord int, text string"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, keyed.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def feeder(spark, path, schema, make, mode):
    """feed(rows): what one micro-batch gives. Each batch is a query of its own that goes on from the checkpoint, so all state is read back."""
    (path / "in").mkdir()

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
        out = []
        stream = make(spark.readStream.schema(schema).parquet(str(path / "in")))
        keep = lambda df, k: out.extend(tuple(r) for r in df.collect())
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(path / "ck")).trigger(once=True).start()
        try:
            assert query.awaitTermination(60)
        finally:
            query.stop()
        return sorted(out)

    return feed


def test_spans_go_on_after_a_restart_and_close_when_idle(spark, tmp_path):
    feed = feeder(spark, tmp_path, TOKENS, lambda s: keyed.track_open_segments(s, idle_ms=20_000), "update")
    assert feed([(1, 0, None), (1, 1, None), (1, 2, 1)]) == [(1, 0, 0, 2, False), (1, 1, 2, 3, False)]
    got = feed([(1, 3, 1), (1, 4, 3), (1, 5, None), (2, 0, 0)])
    assert got == [(1, 1, 2, 4, False), (1, 2, 4, 4, False), (1, 3, 4, 6, False), (2, 0, 0, 1, False)]
    time.sleep(21)
    closed = [x for x in feed([(9, 0, 0)]) if x[4]]
    assert closed == [(1, 0, 0, 2, True), (1, 1, 2, 4, True), (1, 2, 4, 4, True), (1, 3, 4, 6, True), (2, 0, 0, 1, True)]
    assert [x for x in feed([(1, 7, None)]) if x[0] == 1] == [(1, 0, 0, 8, False)]  # the state has gone


def test_state_expires(spark, tmp_path):
    feed = feeder(spark, tmp_path, TOKENS, lambda s: keyed.track_open_segments(s, ttl_ms=2000), "update")
    feed([(1, 0, 0), (1, 1, 1)])
    time.sleep(3)
    assert feed([(1, 5, None)]) == [(1, 0, 0, 6, False)]


def test_windows_of_paragraphs(spark, tmp_path):
    feed = feeder(spark, tmp_path, PARAGRAPHS, lambda s: keyed.pack_open_paragraphs(s, size=10, idle_ms=20_000), "append")
    assert feed([(1, 0, "aaaa"), (1, 1, " "), (1, 2, "bbbb"), (2, 0, None), (3, 0, "x" * 30), (3, 1, "y")]) == [(3, 0, "x" * 30)]
    assert feed([(1, 3, "cc"), (3, 2, None)]) == [(1, 0, "aaaa\n\nbbbb"), (3, 1, "y")]
    time.sleep(21)
    assert feed([(7, 0, "z")]) == [(1, 1, "cc")]
