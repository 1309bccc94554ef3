"""The engine's routes as methods that return DataFrames: store, retrieve, replicate, sync, prefill, membership, metrics.

State is tables, not servers: fragments (content_hash, ..., size, ttl, reuse_score, version_id, inserted, last_access),
placements (node_id, content_hash, is_primary) and peers (node_id, host, healthy). Methods that change state return the
new table; the caller keeps or writes it. `now` is a parameter throughout.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.backends import ComputeBackend, LocalBackend, prefill_result
from fragloom.operators import caches, inventory, joins


@dataclass(frozen=True)
class Engine:
    fragments: DataFrame
    placements: DataFrame
    peers: DataFrame
    backend: ComputeBackend = LocalBackend()
    node_limit: int = 1 << 30

    def store(self, rows: DataFrame, node_id: str, is_primary: bool = True) -> "Engine":
        """New hashes are added, known ones kept as they are; the node holds all of them (a primary stays primary)."""
        new = rows.join(self.fragments.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])
        held = rows.select(F.lit(node_id).alias("node_id"), "content_hash", F.lit(is_primary).alias("is_primary")).distinct()
        placed = self.placements.unionByName(held).groupBy("node_id", "content_hash").agg(F.bool_or("is_primary").alias("is_primary"))
        return replace(self, fragments=self.fragments.unionByName(new), placements=placed)

    def retrieve(self, wanted: DataFrame, now: float) -> DataFrame:
        """The wanted (content_hash) fragments that are not expired."""
        return inventory.present(self.fragments, wanted, ["content_hash"]).where(~caches.expired(F.lit(now)))

    def remove(self, gone: DataFrame) -> "Engine":
        """Fragments and all of their placements."""
        return replace(self, fragments=inventory.remove(self.fragments, gone, ["content_hash"]), placements=inventory.remove(self.placements, gone, ["content_hash"]))

    def digest(self, node_id: str) -> DataFrame:
        """(content_hash, version_id) of a node."""
        return self.placements.where(F.col("node_id") == node_id).join(self.fragments.select("content_hash", "version_id", "size"), "content_hash").select("content_hash", "version_id", "size")

    def sync(self, source: str, target: str) -> DataFrame:
        """(content_hash, status, size): what the target would pull."""
        return inventory.sync_plan(self.digest(source), self.digest(target))

    def replicate(self, source: str, target: str, wanted: DataFrame | None = None) -> "Engine":
        """The target gets what it lacks of the source's fragments (of `wanted`, if given), as replicas."""
        moved = self.sync(source, target).where("status = 'missing'").select("content_hash")
        moved = moved if wanted is None else inventory.present(moved, wanted, ["content_hash"])
        return replace(self, placements=self.placements.unionByName(moved.select(F.lit(target).alias("node_id"), "content_hash", F.lit(False).alias("is_primary"))))

    def locate(self, wanted: DataFrame) -> DataFrame:
        """(content_hash, nodes)"""
        return inventory.holders(inventory.present(self.placements, wanted, ["content_hash"]))

    def prefill(self, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(windows, report): the backend's windows of the prompts, and size and latency of each prompt."""
        windows = self.backend.prefill(prompts)
        return windows, prefill_result(prompts, windows)

    def join(self, peers: DataFrame) -> "Engine":
        return replace(self, peers=inventory.merge_peers(self.peers, peers))

    def leave(self, gone: DataFrame) -> "Engine":
        """Nodes leave with their placements."""
        return replace(self, peers=inventory.remove(self.peers, gone, ["node_id"]), placements=inventory.remove(self.placements, gone, ["node_id"]))

    def gossip(self, theirs: DataFrame) -> DataFrame:
        """Our inventory merged with a peer's (content_hash, nodes, version_id)."""
        ours = inventory.holders(self.placements).join(self.fragments.select("content_hash", "version_id"), "content_hash")
        return inventory.merge_gossip(ours, theirs)

    def heartbeat(self) -> DataFrame:
        """(node_id, used, limit, fragments, primaries, load)"""
        return caches.node_stats(self.placements.join(self.fragments.select("content_hash", "size"), "content_hash"), self.node_limit)

    def metrics(self, now: float) -> DataFrame:
        """One row: fragments, bytes, expired, and the counts of the tiers."""
        base = self.fragments.agg(F.count("*").alias("fragments"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(caches.expired(F.lit(now))).alias("expired"))
        return base.crossJoin(caches.tier_counts(self.fragments, F.lit(now)))

    def recent(self, n: int = 20) -> DataFrame:
        """The n fragments touched last."""
        return self.fragments.orderBy(F.col("last_access").desc(), "content_hash").limit(n)

    def nearest_spans(self, spans: DataFrame, position: int, gap: int = 0) -> DataFrame:
        """Spans (start, stop) next to a position."""
        at = spans.sparkSession.createDataFrame([(0, position)], "_g int, position long")
        return joins.adjacent_join(spans.withColumn("_g", F.lit(0)), at, ["_g"], gap).drop("_g", "position")
