"""Streams over the events give what batch queries give, also in several micro-batches."""

import pytest
from pyspark.sql import functions as F

from fragloom.streaming import events as S

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "events")
    spark.read.parquet(f"{DATA}/events.parquet").repartitionByRange(4, "ts").write.parquet(path)
    return path


def test_cache_state_equals_a_replay(spark, folder, tmp_path):
    ttl = 3 * 86400.0
    out = S.run_once(S.hits_and_misses(S.access_stream(spark, folder), ttl), "cache_state", "update", str(tmp_path / "c"))
    last = {}
    for r in out.collect():
        last[r.content_hash] = max(last.get(r.content_hash, (0, 0, 0)), (r.hits + r.misses, r.hits, r.misses))
    replay = {}
    k = F.get_json_object("props", "$.k")
    for r in spark.read.parquet(folder).select(F.md5(F.concat_ws(":", "event_type", k)).alias("h"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id").orderBy("t", "event_id").collect():
        inserted, hits, misses = replay.get(r.h, (None, 0, 0))
        ts = r.t / 1e6
        replay[r.h] = (inserted, hits + 1, misses) if inserted is not None and ts - inserted <= ttl else (ts, hits, misses + 1)
    # files come in any order: only the totals are fixed by the data
    assert {h: x[0] for h, x in last.items()} == {h: x[1] + x[2] for h, x in replay.items()}


def test_windows_and_sessions(spark, folder, tmp_path):
    counts = S.run_once(S.pattern_windows(S.access_stream(spark, folder), late="60 days"), "patterns", "complete", str(tmp_path / "p"))
    assert counts.agg(F.sum("n")).first()[0] == 1000
    batch = S.sessions(spark.read.parquet(folder).select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts")))
    assert batch.agg(F.sum("n")).first()[0] == 1000


def test_threshold_control(spark, tmp_path):
    path = str(tmp_path / "samples")
    spark.createDataFrame([("a", i, 0.9, 0.0) for i in range(4)], "key string, seq int, utilization double, queue_ratio double").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("key string, seq int, utilization double, queue_ratio double").parquet(path)
    out = S.run_once(S.threshold_control(stream, 1000), "thresholds", "update", str(tmp_path / "t"))
    assert out.first().threshold == int(int(int(1100 * 1.10) * 1.10) * 1.10)


def test_heartbeats(spark, tmp_path):
    path = str(tmp_path / "beats")
    spark.createDataFrame([("a", t) for t in (0, 2, 20, 40, 60)] + [("b", t) for t in (0, 2, 4)], "node_id string, s int").select("node_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("node_id string, ts timestamp").parquet(path)
    out = S.run_once(S.missed_heartbeats(stream, 5.0, 3), "beats", "update", str(tmp_path / "h"))
    assert {r.node_id: r.late for r in out.collect()} == {"a": True, "b": False}
