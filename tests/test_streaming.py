from pyspark.sql import functions as F

from loomspark.streaming import tracker


def run(spark, tmp_path, rows, schema, make, mode, batches=2):
    """Feed rows in files, one micro-batch each, and return what came out."""
    src = tmp_path / "in"
    src.mkdir()
    step = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{src}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_tracker_grows_over_batches(spark, tmp_path):
    rows = [(1, 0, None), (1, 1, None), (1, 2, 1), (1, 3, 1), (1, 4, 3), (1, 5, None)]
    got = run(spark, tmp_path, rows, "doc_id long, tok_idx long, seg int", tracker.track_segments, "update")
    last = {}
    for r in got:
        last[r.seg] = max(last.get(r.seg, (0, 0)), (r.end, r.begin))
    assert last[0] == (2, 0) and last[1] == (4, 2) and last[3] == (6, 4)


def test_paragraphs_pack_over_batches(spark, tmp_path):
    rows = [(1, k, "p" * 300) for k in range(8)]
    got = run(spark, tmp_path, rows, "doc_id long, ord int, text string", tracker.pack_paragraphs, "append")
    assert sorted(r.win_idx for r in got) == [0, 1] and all(r.text.count("p") == 900 for r in got)


def test_event_windows(spark, tmp_path, sf_dir):
    rows = [(f"2024-01-01 00:{m:02d}:00", "a" if m % 2 else "b", m % 3) for m in range(0, 60, 5)]
    make = lambda s: tracker.tumbling(s.withColumn("ts", F.to_timestamp("ts")), "30 minutes")
    got = run(spark, tmp_path, rows, "ts string, event_type string, user_id long", make, "complete")
    assert sum(r.n for r in got) == len(rows)


def test_an_end_marker_closes_the_last_window(spark, tmp_path):
    rows = [(1, k, "p" * 300) for k in range(4)] + [(1, 9, None), (2, 0, "open")]
    got = run(spark, tmp_path, rows, "doc_id long, ord int, text string", tracker.pack_paragraphs, "append")
    assert sorted((r.doc_id, r.win_idx, r.text.count("p")) for r in got) == [(1, 0, 900), (1, 1, 300)]


def test_sessions_and_boundary_counts(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", u) for u in (1, 2) for h, m in ((0, 0), (0, 10), (2, 0), (9, 0))]
    rows.sort()
    make = lambda s: tracker.sessions(s.withColumn("ts", F.to_timestamp("ts")), "30 minutes", "10 minutes")
    got = run(spark, tmp_path, rows, "ts string, user_id long", make, "append")
    assert sorted((r.user_id, r.n) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]  # the last session waits for the watermark
    b = spark.createDataFrame([(5, 0.2), (5, 0.4), (9, 1.0)], "position long, strength double")
    assert sorted((r.position, round(r.strength, 6), r.n) for r in tracker.boundary_counts(b).collect()) == [(5, 0.3, 2), (9, 1.0, 1)]
