"""Micro-batches run the batch operators; replays change nothing."""

from datetime import datetime, timedelta

from paneflow.sources.captures import read_json
from paneflow.sources.tables import latest
from paneflow.streaming.incremental import delivery_counts, distinct_deliveries, run_batches, stream_tables

SCHEMA = "k string, v int, received_at timestamp"


def test_batches_and_watermarks(spark, tmp_path):
    src = str(tmp_path / "in")
    t0 = datetime(2025, 1, 1)
    rows = [("a", 1, t0), ("a", 2, t0 + timedelta(hours=1)), ("b", 3, t0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(src)
    work = lambda df: latest(df, ["k"], "received_at")
    for _ in range(2):
        run_batches(stream_tables(spark, src, SCHEMA), str(tmp_path / "out"), str(tmp_path / "ckpt"), work).awaitTermination()
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2), ("b", 3)}
    q = delivery_counts(distinct_deliveries(stream_tables(spark, src, SCHEMA), ["k"], "received_at"), late=None).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").columns == ["start", "n"]


def test_json_source_has_a_fixed_schema(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text('{"capture_id":"c","source_id":"t","text":"x","extra":1}\n{broken\n')
    (r,) = read_json(spark, str(p), "text_runs").collect()
    assert (r.capture_id, r.text, r.bounds) == ("c", "x", None)


def test_latest_breaks_ties_by_content(spark):
    t = datetime(2025, 1, 1)
    rows = [("a", 1, t), ("a", 2, t), (None, 3, None), ("c", None, None)]
    one = {(r.k, r.v) for r in latest(spark.createDataFrame(rows, SCHEMA), ["k"], "received_at").collect()}
    two = {(r.k, r.v) for r in latest(spark.createDataFrame(rows[::-1], SCHEMA), ["k"], "received_at").collect()}
    assert one == two and len(one) == 3
    assert latest(spark.createDataFrame([], SCHEMA), ["k"], "received_at").count() == 0
