"""Tiers, expiry, least-recently-used survivors and eviction orders, as ranked running sums.

State that a store would change call by call is read off the access log: last access is max(ts), insertion min(ts).
Running sums run in key groups (a node, a store shard); `now` is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT, WARM, EPSILON, BROADCAST_ROWS = 60.0, 300.0, 0.01, 10_000


def tier(now: Column, last_access: Column, hot: float = HOT, warm: float = WARM) -> Column:
    age = now - last_access
    return F.when(last_access.isNull(), "missing").when(age <= hot, "hot").when(age <= warm, "warm").otherwise("cold")


def tier_counts(store: DataFrame, now: Column, hot: float = HOT, warm: float = WARM) -> DataFrame:
    """One row: hot, warm, cold."""
    t = tier(now, F.col("last_access"), hot, warm)
    return store.agg(*[F.count_if(t == name).alias(name) for name in ("hot", "warm", "cold")])


def expired(now: Column) -> Column:
    """Older than its time to live, strictly: a ttl of 0 ends at once."""
    return now - F.col("inserted") > F.col("ttl")


def survivors(last_access: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """What a least-recently-used cache of `capacity` keys holds in the end."""
    order = Window.partitionBy(*keys).orderBy(F.col("last_access").desc(), "content_hash")
    return last_access.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= capacity).drop("_r")


def within_capacity(store: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """What a store of `capacity` bytes keeps that takes everything and evicts the least recently used; with the bytes
    held up to each row."""
    aged = leading(store.withColumn("_age", -F.col("last_access")).withColumn("_phase", F.lit(0)), keys, "_phase", "_age", F.lit(capacity))
    order = Window.partitionBy(*keys).orderBy("_age", "content_hash").rowsBetween(Window.unboundedPreceding, 0)
    return aged.withColumn("held", F.sum("size").over(order)).where(F.col("held") <= capacity).drop("_age", "_phase")


def recency_score(reuse: Column, last_access: Column) -> Column:
    """Smaller goes first. As the engine defines it, a high reuse score divides the time, so it goes earlier."""
    return last_access / (reuse + EPSILON)


def node_eviction(store: DataFrame, keys: list[str], now: Column, target: Column) -> DataFrame:
    """Evicted rows with their place: expired ones by insertion, then by recency score, until `target` bytes are freed."""
    rows = store.withColumn("phase", F.when(expired(now), 0).otherwise(1))
    score = F.when(F.col("phase") == 0, F.col("inserted")).otherwise(recency_score(F.col("reuse_score"), F.col("last_access")))
    return freed_until(rows.withColumn("score", score), keys, ["phase", "score", "content_hash"], target)


def store_eviction(store: DataFrame, keys: list[str], now: Column, target: Column, hot: float = HOT, warm: float = WARM) -> DataFrame:
    """Expired first, then cold by value density, then warm and hot by recency score."""
    t = tier(now, F.col("last_access"), hot, warm)
    phase = F.when(expired(now), 0).when(t == "cold", 1).when(t == "warm", 2).otherwise(3)
    score = F.when(phase == 0, F.col("inserted")).when(phase == 1, F.col("reuse_score")).otherwise(recency_score(F.col("reuse_score"), F.col("last_access")))
    return freed_until(store.withColumn("phase", phase).withColumn("score", score), keys, ["phase", "score", "content_hash"], target)


def leading(rows: DataFrame, keys: list[str], phase: str, score: str, target: Column, buckets: int = 1024) -> DataFrame:
    """The rows of each key that can be among the first `target` bytes by (phase, score): bytes are summed by buckets of
    score, and buckets past the one that reaches the target are left out, so that an order by key meets few rows."""
    ends = rows.groupBy(*keys, phase).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
    share = F.coalesce(F.try_divide(F.col(score) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    placed = rows.join(ends, [*keys, phase]).withColumn("_bucket", F.floor(share * (buckets - 1)).cast("int"))
    sums = placed.groupBy(*keys, phase, "_bucket").agg(F.sum("size").alias("_bytes"))
    before = F.sum("_bytes").over(Window.partitionBy(*keys).orderBy(phase, "_bucket").rowsBetween(Window.unboundedPreceding, -1))
    last = sums.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < target).groupBy(*keys).agg(F.max(F.struct(phase, "_bucket")).alias("_last"))
    last = F.broadcast(last) if last.count() <= BROADCAST_ROWS else last
    return placed.join(last, keys).where(F.struct(phase, "_bucket") <= F.col("_last")).drop("_low", "_high", "_bucket", "_last")


def freed_until(rows: DataFrame, keys: list[str], order: list[str], target: Column) -> DataFrame:
    """Rows in order (phase, score, ties) while what the earlier ones free is below the target; with place (from 1) and
    freed so far."""
    rows = leading(rows, keys, order[0], order[1], target)
    w = Window.partitionBy(*keys).orderBy(*order)
    freed = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("place", F.row_number().over(w)).withColumn("freed", freed).where(F.col("freed") - F.col("size") < target)


def neighbour_eviction(evicted: DataFrame, store: DataFrame, edges: DataFrame) -> DataFrame:
    """Stored out-neighbours of evicted fragments that are not themselves evicted."""
    near = evicted.select(F.col("content_hash").alias("src")).join(edges.select("src", "dst"), "src").select(F.col("dst").alias("content_hash")).distinct()
    return store.join(near, "content_hash", "left_semi").join(evicted.select("content_hash"), "content_hash", "left_anti")


def cache_metrics(lookups: DataFrame, keys: list[str]) -> DataFrame:
    """hits, misses, rates and mean missed size over rows (hit boolean, kv_size)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = lookups.groupBy(*keys).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(F.sum(F.when(~F.col("hit"), F.col("kv_size"))), F.lit(0)).alias("missed_size"))
    total = F.col("hits") + F.col("misses")
    return sums.withColumn("hit_rate", zero(F.try_divide("hits", total))).withColumn("miss_rate", zero(F.try_divide("misses", total))).withColumn("size_growth_rate", zero(F.try_divide("missed_size", F.col("misses"))))


def node_stats(store: DataFrame, limit: int) -> DataFrame:
    """(node_id, used, limit, fragments, primaries, load)"""
    used = store.groupBy("node_id").agg(F.sum("size").alias("used"), F.count("*").alias("fragments"), F.count_if("is_primary").alias("primaries"))
    load = F.lit(1.0) if limit == 0 else F.least(F.lit(1.0), F.col("used") / limit)
    return used.withColumn("limit", F.lit(limit).cast("long")).withColumn("load", load)
