"""Structured Streaming forms: windowed counts with watermarks, sessions, cache state, heartbeats and threshold control.

Each function takes and returns a streaming (or batch) DataFrame of accesses: (session_id, content_hash, ts timestamp).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def access_stream(spark, path: str, schema=None) -> DataFrame:
    """Events read as a stream of accesses from Parquet files of `path`."""
    schema = schema or "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    k = F.get_json_object("props", "$.k")
    return events.select("event_id", F.col("user_id").alias("session_id"), F.md5(F.concat_ws(":", "event_type", k)).alias("content_hash"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "value")


def pattern_windows(accesses: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, content_hash, n): accesses by tumbling window; rows later than the watermark are left out."""
    w = F.window("ts", width)
    return accesses.withWatermark("ts", late).groupBy(w, "content_hash").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "content_hash", "n")


def sessions(accesses: DataFrame, idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(session_id, start, stop, n): stretches of a session without a pause of `idle`."""
    w = F.session_window("ts", idle)
    return accesses.withWatermark("ts", late).groupBy(w, "session_id").agg(F.count("*").alias("n")).select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def latest_access(accesses: DataFrame) -> DataFrame:
    """(content_hash, last_access, n): the touch times that recency evictions rank by."""
    return accesses.groupBy("content_hash").agg(F.max("ts").alias("last_access"), F.count("*").alias("n"))


def hits_and_misses(accesses: DataFrame, ttl_seconds: float) -> DataFrame:
    """(content_hash, hits, misses, last): per-hash cache state; an access later than the ttl after insertion misses and inserts anew."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        inserted, hits, misses = state.get if state.exists else (None, 0, 0)
        last = None
        for ts in sorted(t.timestamp() for pdf in batches for t in pdf["ts"]):
            if inserted is not None and ts - inserted <= ttl_seconds:
                hits += 1
            else:
                inserted, misses = ts, misses + 1
            last = ts
        state.update((inserted, hits, misses))
        yield pd.DataFrame({"content_hash": [key[0]], "hits": [hits], "misses": [misses], "last": [last]})

    return accesses.groupBy("content_hash").applyInPandasWithState(step, "content_hash string, hits long, misses long, last double", "inserted double, hits long, misses long", "update", GroupStateTimeout.NoTimeout)


def threshold_control(samples: DataFrame, base: int, congestion: float = 0.85, most: int = 131072, window: int = 100) -> DataFrame:
    """(key, threshold): samples (key, seq, utilization, queue_ratio) fold into an effective threshold for each key.

    The state holds the last `window` utilizations and the threshold."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        recent, threshold = (list(state.get[0]), state.get[1]) if state.exists else ([], base)
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            recent = [*recent, row.utilization][-window:]
            if sum(recent) / len(recent) >= congestion or row.queue_ratio >= 1.0:
                threshold = min(int(threshold * 1.10), most)
            elif threshold > base:
                threshold = max(int(threshold * 0.99), base)
        state.update((recent, threshold))
        yield pd.DataFrame({"key": [key[0]], "threshold": [threshold]})

    return samples.groupBy("key").applyInPandasWithState(step, "key string, threshold long", "recent array<double>, threshold long", "update", GroupStateTimeout.NoTimeout)


def missed_heartbeats(beats: DataFrame, interval_seconds: float, most: int) -> DataFrame:
    """(node_id, seen, late): nodes whose observed gaps exceed the interval `most` times in a row, from (node_id, ts)."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        last, late, worst = state.get if state.exists else (None, 0, 0)
        for ts in sorted(t.timestamp() for pdf in batches for t in pdf["ts"]):
            late = late + 1 if last is not None and ts - last > interval_seconds else 0
            worst, last = max(worst, late), ts
        state.update((last, late, worst))
        yield pd.DataFrame({"node_id": [key[0]], "seen": [last], "late": [worst >= most]})

    return beats.groupBy("node_id").applyInPandasWithState(step, "node_id string, seen double, late boolean", "last double, late long, worst long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """The stream's result after all that is there now, as a table in memory (for small results and tests)."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
