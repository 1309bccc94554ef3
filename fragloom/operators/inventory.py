"""Set operations over inventories, directories, gossip and canonical fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.operators.joins import best


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Upsert: the last row of each key."""
    return best(rows, key, order, 1, "_r").drop("_r")


def stale(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(content_hash): what the local inventory lacks or holds in an older version than the remote one."""
    l = local.select("content_hash", F.col("version_id").alias("_v"))
    return remote.join(l, "content_hash", "left").where(F.col("_v").isNull() | (F.col("_v") < F.col("version_id"))).select("content_hash")


def sync_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """(content_hash, status, size): what a target is missing, or holds outdated; the source rows carry size."""
    t = target.select("content_hash", F.col("version_id").alias("_v"))
    status = F.when(F.col("_v").isNull(), "missing").when(F.col("_v") < F.col("version_id"), "outdated")
    return source.join(t, "content_hash", "left").withColumn("status", status).where("status is not null").select("content_hash", "status", "size")


def batch_sync(inventory: DataFrame, source: str) -> DataFrame:
    """(target, content_hash, status) of one source node against every other node of the inventory."""
    mine = inventory.where(F.col("node_id") == source).select("content_hash", F.col("version_id").alias("v"))
    targets = inventory.where(F.col("node_id") != source).select(F.col("node_id").alias("target")).distinct()
    wanted = mine.join(F.broadcast(targets))
    theirs = inventory.select(F.col("node_id").alias("target"), "content_hash", F.col("version_id").alias("_v"))
    status = F.when(F.col("_v").isNull(), "missing").when(F.col("_v") < F.col("v"), "outdated")
    return wanted.join(theirs, ["target", "content_hash"], "left").withColumn("status", status).where("status is not null").select("target", "content_hash", "status")


def merge_gossip(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(content_hash, nodes, version_id): node sets united, their version winning over ours. Both: (content_hash, nodes, version_id)."""
    t = theirs.select("content_hash", F.col("nodes").alias("t_nodes"), F.col("version_id").alias("t_version"))
    none = F.array().cast("array<string>")
    united = F.array_sort(F.array_union(F.coalesce("nodes", none), F.coalesce("t_nodes", none)))
    return ours.join(t, "content_hash", "full").select("content_hash", united.alias("nodes"), F.coalesce("t_version", "version_id").alias("version_id"))


def merge_peers(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(node_id, host, healthy): ours stay unless unhealthy where theirs is healthy."""
    t = theirs.select("node_id", F.col("host").alias("t_host"), F.col("healthy").alias("t_healthy"))
    swap = F.col("healthy").isNull() | (~F.col("healthy") & F.coalesce("t_healthy", F.lit(False)))
    return ours.join(t, "node_id", "full").select("node_id", F.when(swap, F.col("t_host")).otherwise(F.col("host")).alias("host"), F.when(swap, F.col("t_healthy")).otherwise(F.col("healthy")).alias("healthy"))


def canonical(rows: DataFrame, seq: list[str]) -> DataFrame:
    """(content_hash, first, tenants): the first row of each hash wins; tenants in order."""
    return rows.groupBy("content_hash").agg(F.min(F.struct(*seq)).alias("first"), F.array_sort(F.collect_set("tenant")).alias("tenants"))


def holders(inventory: DataFrame) -> DataFrame:
    """(content_hash, nodes)"""
    return inventory.groupBy("content_hash").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))


def primaries(inventory: DataFrame, order: str) -> DataFrame:
    """(content_hash, node_id): the last holder that was declared primary, by `order`; null where none was."""
    declared = F.when(F.col("is_primary"), F.struct(order, "node_id"))
    return inventory.groupBy("content_hash").agg(F.max(declared).alias("_p")).select("content_hash", F.col("_p.node_id").alias("node_id"))


def nearest_holder(keys: DataFrame, inventory: DataFrame) -> DataFrame:
    """keys with `node_id`: the least holder by name, else the key's ring owner (column `fallback`)."""
    least = inventory.groupBy("content_hash").agg(F.min("node_id").alias("_n"))
    return keys.join(least, "content_hash", "left").withColumn("node_id", F.coalesce("_n", "fallback")).drop("_n", "fallback")


def remove(rows: DataFrame, tombstones: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(tombstones.select(*key).distinct(), key, "left_anti")


def present(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(wanted.select(*key).distinct(), key, "left_semi")
