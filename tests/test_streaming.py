"""Streaming jobs over files that arrive one a batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tradewind.streaming import ingest

ARTICLE = "provider string, provider_article_id string, title string, source_name string, published_at timestamp"


def test_append_absent(spark, tmp_path):
    """Batches and a second run add each key once."""
    src, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for keys in (["a", "b", "b"], ["b", "c"]):
        spark.createDataFrame([(k,) for k in keys], "ingest_hash string").coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        assert ingest.append_absent(ingest.stream_of(spark, src, "ingest_hash string"), out, marks).awaitTermination(60)
    assert sorted(r.ingest_hash for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_append_absent_computes_a_batch_once(spark, tmp_path):
    """Whatever a batch is compared with, its rows are computed once."""
    src, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    counted = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda k: counted.add(1) or True, "boolean")
    for day in (1, 2):
        spark.createDataFrame([(f"{day}", datetime(2024, 1, day)), ("x", datetime(2024, 1, 1))], "ingest_hash string, published_at timestamp").coalesce(1).write.mode("append").parquet(src)
        stream = ingest.stream_of(spark, src, "ingest_hash string, published_at timestamp").where(seen("ingest_hash"))
        assert ingest.append_absent(stream, out, marks, at="published_at").awaitTermination(60)
    assert sorted(r.ingest_hash for r in spark.read.parquet(out).collect()) == ["1", "2", "x"] and counted.value == 4


def test_new_articles(spark, tmp_path):
    src = str(tmp_path / "in")
    at = datetime(2024, 1, 1)
    for titles in (["x", "y"], ["y", "z"]):
        spark.createDataFrame([("rss", "", t, "s", at) for t in titles], ARTICLE).coalesce(1).write.mode("append").parquet(src)
    q = ingest.new_articles(ingest.stream_of(spark, src, ARTICLE)).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(r.title for r in spark.table("fresh").collect()) == ["x", "y", "z"]


def test_failures_by_window(spark):
    at = datetime(2024, 1, 1, 0, 7)
    rows = spark.createDataFrame([(at, 1, "error"), (at, 1, "view")], "ts timestamp, user_id long, event_type string")
    found = ingest.failures_by_window(rows).collect()
    assert len(found) == 3 and all((r.failures, r.events) == (1, 2) for r in found)


def test_circuit_changes(spark, tmp_path):
    """Five failures open a source's circuit, and state outlives a batch."""
    src, schema = str(tmp_path / "in"), "source_id long, ts timestamp, event_id long, ok boolean"
    start = datetime(2024, 1, 1)
    for ids in (range(3), range(3, 5)):
        spark.createDataFrame([(s, start + timedelta(minutes=i), i, s == 2) for i in ids for s in (1, 2)], schema).coalesce(1).write.mode("append").parquet(src)
    q = ingest.circuit_changes(ingest.stream_of(spark, src, schema)).writeStream.format("memory").queryName("circuits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert [(r.source_id, r.state, r.failures) for r in spark.table("circuits").collect()] == [(1, "open", 5)]
