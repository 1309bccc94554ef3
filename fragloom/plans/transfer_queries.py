"""Queries over prefill, transfer and the engine's routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragloom.backends import LocalBackend, MeanBackend, prefill_result
from fragloom.engine import Engine
from fragloom.operators import inventory as I
from fragloom.operators import windows as W
from fragloom.plans import sql as S
from fragloom.plans.registry import registry
from fragloom.sources import tables as T

QUERIES, ORACLES, query = registry()
ACC = f"WITH {S.ACCESSES}, {S.STORE}, {S.INVENTORY}"


def _engine(spark, d) -> Engine:
    accessed = T.accesses(spark, d)
    inv = T.inventory(accessed)
    store = T.store(accessed).withColumn("version_id", F.col("n"))
    placements = inv.select("node_id", "content_hash", (F.col("version_id") > 1).alias("is_primary"))
    peers = inv.select("node_id").distinct().select("node_id", F.col("node_id").alias("host"), F.lit(True).alias("healthy"))
    return Engine(store, placements, peers, LocalBackend(), 400_000)


@query("prefill_result", f"WITH {S.PROMPTS} SELECT prompt_id, len(tokens)::INT AS tokens, round({S.kv('len(tokens)')}, 4) AS kv_size_mib, round({S.prefill('len(tokens)')}, 4) AS latency_seconds, ceil(len(tokens) / 128)::BIGINT AS fragments FROM prompts")
def prefill_report(spark, d):
    prompts = T.prompts(spark, d)
    out = prefill_result(prompts, W.token_windows(prompts, 128, "comma"))
    return out.select("prompt_id", "tokens", F.round("kv_size_mib", 4).alias("kv_size_mib"), F.round("latency_seconds", 4).alias("latency_seconds"), "fragments")


@query("backend_windows", f"WITH {S.PROMPTS}, {S.windows(128, S.comma_hash)} SELECT prompt_id, token_start, content_hash, round(part[1] % 1000 / 1000, 6) AS e0 FROM win")
def backend_windows(spark, d):
    """Windows embedded by a plug-in backend, batch by batch."""
    rows = MeanBackend(4).prefill(T.prompts(spark, d))
    return rows.select("prompt_id", "token_start", "content_hash", F.round(F.col("embedding")[0], 6).alias("e0"))


@query("engine_heartbeat", f"{ACC}, u AS (SELECT node_id, sum(size)::BIGINT AS used, count(*) AS fragments, count(*) FILTER (version_id > 1) AS primaries FROM inv JOIN store USING (content_hash) GROUP BY 1) SELECT node_id, used, fragments, primaries, round(least(1, used / 400000), 6) AS load FROM u")
def engine_heartbeat(spark, d):
    return _engine(spark, d).heartbeat().select("node_id", "used", "fragments", "primaries", F.round("load", 6).alias("load"))


@query("engine_replicate", f"{ACC}, a AS (SELECT content_hash FROM inv WHERE node_id = 'n1'), b AS (SELECT content_hash FROM inv WHERE node_id = 'n2') SELECT node_id, count(*) AS held FROM (SELECT node_id, content_hash FROM inv UNION ALL SELECT 'n2', content_hash FROM a WHERE content_hash NOT IN (SELECT content_hash FROM b)) GROUP BY 1")
def engine_replicate(spark, d):
    return _engine(spark, d).replicate("n1", "n2").placements.groupBy("node_id").agg(F.count("*").alias("held"))


@query("engine_leave", f"{ACC} SELECT content_hash, count(*) AS holders FROM inv WHERE node_id NOT IN ('n0', 'n3') GROUP BY 1")
def engine_leave(spark, d):
    e = _engine(spark, d)
    return e.leave(e.peers.where(F.col("node_id").isin("n0", "n3"))).placements.groupBy("content_hash").agg(F.count("*").alias("holders"))


@query("engine_retrieve", f"{ACC} SELECT content_hash, size FROM store WHERE k < 30 AND NOT ((SELECT max(ts) FROM acc) - inserted > ttl)")
def engine_retrieve(spark, d):
    e = _engine(spark, d)
    now = T.accesses(spark, d).agg(F.max("ts")).first()[0]
    return e.retrieve(e.fragments.where("k < 30"), now).select("content_hash", "size")


@query("engine_gossip", f"{ACC}, o AS (SELECT content_hash, list(DISTINCT node_id) AS nodes FROM inv GROUP BY 1) SELECT o.content_hash, array_to_string(list_sort(list_distinct(list_concat(o.nodes, CASE WHEN k < 50 THEN ['far'] ELSE [] END))), ',') AS nodes, CASE WHEN k < 50 THEN 1 ELSE n END AS version_id FROM o JOIN store USING (content_hash)")
def engine_gossip(spark, d):
    e = _engine(spark, d)
    theirs = e.fragments.where("k < 50").select("content_hash", F.array(F.lit("far")).alias("nodes"), F.lit(1).cast("long").alias("version_id"))
    return e.gossip(theirs).withColumn("nodes", F.array_join("nodes", ","))


@query("kv_lookup", f"WITH {S.PROMPTS}, {S.windows(64)}, h AS (SELECT prompt_id, count(*) AS fragments FROM win WHERE prompt_id % 3 = 0 GROUP BY 1) SELECT prompt_id, h.prompt_id IS NOT NULL AS hit, coalesce(fragments, 0) AS fragments FROM prompts LEFT JOIN h USING (prompt_id)")
def kv_lookup(spark, d):
    """Prompts as prefixes: those whose windows are cached hit, and come with the number of their fragments."""
    prompts = T.prompts(spark, d)
    cached = W.token_windows(prompts.where("prompt_id % 3 = 0"), 64).groupBy("prompt_id").agg(F.count("*").alias("fragments"))
    out = T.read(spark, d, "documents").select(F.col("doc_id").alias("prompt_id")).join(cached, "prompt_id", "left")
    return out.select("prompt_id", F.col("fragments").isNotNull().alias("hit"), F.coalesce("fragments", F.lit(0)).alias("fragments"))


@query("chunk_transfer", f"{ACC}, a AS (SELECT content_hash FROM inv WHERE node_id = 'n1'), b AS (SELECT content_hash FROM inv WHERE node_id = 'n2') SELECT content_hash, i AS chunk_index, substr(content_hash, i * 16 + 1, 16) AS chunk FROM a, range(0, 2) t(i) WHERE content_hash NOT IN (SELECT content_hash FROM b)")
def chunk_transfer(spark, d):
    """Chunks of what the source holds and the target lacks: all chunks of a parent or none."""
    inv = T.inventory(T.accesses(spark, d))
    moved = I.remove(inv.where("node_id = 'n1'"), inv.where("node_id = 'n2'"), ["content_hash"])
    return W.hash_chunks(moved, 16)


@query("bulk_promote", f"{ACC}, a AS (SELECT content_hash FROM inv WHERE node_id = 'n4'), w AS (SELECT content_hash FROM store WHERE reuse_score >= 0.7) SELECT content_hash FROM w WHERE content_hash IN (SELECT content_hash FROM a)")
def bulk_promote(spark, d):
    accessed = T.accesses(spark, d)
    inv = T.inventory(accessed).where("node_id = 'n4'")
    return I.present(T.store(accessed).where("reuse_score >= 0.7"), inv, ["content_hash"]).select("content_hash")
