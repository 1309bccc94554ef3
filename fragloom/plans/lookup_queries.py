"""Queries that look things up: objects of fragments, primaries, shards, references, edges, caches and gossip states."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragloom.operators import caches as C
from fragloom.operators import graph as G
from fragloom.operators import inventory as I
from fragloom.operators import objects as O
from fragloom.operators import placement as P
from fragloom.operators import windows as W
from fragloom.operators import workload as L
from fragloom.plans import model
from fragloom.plans import sql as S
from fragloom.plans.registry import registry
from fragloom.plans.store_queries import _RING_KEYS, _VERSIONS, _ring, _versions
from fragloom.sources import tables as T

QUERIES, ORACLES, query = registry()
ACC = f"WITH {S.ACCESSES}"


def _fragments(spark, d):
    return W.token_windows(T.prompts(spark, d), 512).select("prompt_id", "content_hash", "token_start", "token_end", "size", F.lit(2).alias("layer_start"), F.lit(0.5).alias("reuse_score"))


_OBJECTS = f"WITH {S.PROMPTS}, {S.windows(512)}, f AS (SELECT prompt_id, content_hash, token_start, token_end, token_end - token_start + 1 AS n FROM win)"


@query("prefixes_of_fragments", f"{_OBJECTS} SELECT prompt_id, content_hash, content_hash AS semantic_hash, n * 64 AS size_bytes, n AS token_count, n AS tokens, n - 1 AS last_token FROM f")
def prefixes_of_fragments(spark, d):
    rows = _fragments(spark, d)
    made = O.prefixes(rows.withColumn("content_hash", F.concat_ws("@", "content_hash", "prompt_id")))
    parts = F.split("content_hash", "@")
    return made.select(parts[1].cast("long").alias("prompt_id"), parts[0].alias("content_hash"), F.substring_index("semantic_hash", "@", 1).alias("semantic_hash"), "size_bytes", "token_count", F.size("tokens").alias("tokens"), F.element_at("tokens", -1).alias("last_token"))


@query("kv_segments_of_fragments", f"{_OBJECTS} SELECT content_hash, 2 AS layer, 0 AS head, token_start, token_end, 3 AS dims, n * 64 AS size_bytes FROM f")
def kv_segments_of_fragments(spark, d):
    return O.kv_segments(_fragments(spark, d)).select("content_hash", "layer", "head", "token_start", "token_end", F.size("tensor_shape").alias("dims"), "size_bytes")


@query("artifacts_of_fragments", f"{_OBJECTS} SELECT content_hash, content_hash AS text_hash, '' AS source_url, n AS token_count, n * 64 AS size_bytes FROM f")
def artifacts_of_fragments(spark, d):
    return O.artifacts(_fragments(spark, d)).select("content_hash", "text_hash", "source_url", "token_count", "size_bytes")


@query("tool_traces_of_fragments", f"{_OBJECTS} SELECT content_hash, content_hash AS output_hash, '' AS tool_name, n * 64 AS size_bytes, 0.5 AS reuse_score FROM f")
def tool_traces_of_fragments(spark, d):
    return O.tool_traces(_fragments(spark, d)).select("content_hash", "output_hash", "tool_name", "size_bytes", "reuse_score")


# --- inventories and shards

@query("primary_lookup", f"{ACC}, {S.INVENTORY} SELECT content_hash, arg_max(node_id, (version_id, node_id)) FILTER (version_id > 1) AS primary_node FROM inv GROUP BY 1")
def primary_lookup(spark, d):
    """The primary of each hash: the last of its holders that were declared so (by a second version); null for none."""
    inv = T.inventory(T.accesses(spark, d))
    return I.primaries(inv.withColumn("is_primary", F.col("version_id") > 1), "version_id").withColumnRenamed("node_id", "primary_node")


_PLACED = f"""{ACC}, {_RING_KEYS}, two AS (SELECT 0 AS turn, * FROM pts UNION ALL SELECT 1, * FROM pts), near AS (SELECT content_hash, node_id, min((turn, point)) AS nearest FROM keys JOIN two ON turn = 1 OR point >= key GROUP BY ALL),
  o AS (SELECT content_hash, node_id, row_number() OVER (PARTITION BY content_hash ORDER BY nearest) AS place FROM near)"""


@query("replica_shards", f"{_PLACED} SELECT node_id, count(*) AS shards, min(content_hash) AS least FROM o WHERE place BETWEEN 2 AND 3 GROUP BY 1")
def replica_shards(spark, d):
    keys = T.accesses(spark, d).select("content_hash").distinct()
    held = P.replica_shards(P.placement(keys, _ring(spark, d), 2))
    return held.groupBy("node_id").agg(F.count("*").alias("shards"), F.min("content_hash").alias("least"))


@query("shard_roles", f"{_PLACED}, m AS (SELECT min(node_id) AS node_id FROM n) SELECT o.content_hash, max((place = 1)::INT) = 1 AS is_primary, max((place > 1)::INT) = 1 AS is_replica FROM o JOIN m USING (node_id) WHERE place <= 3 GROUP BY 1")
def shard_roles(spark, d):
    """Whether the first node by name is primary or replica of the shards that it holds."""
    keys = T.accesses(spark, d).select("content_hash").distinct()
    ring = _ring(spark, d)
    placed = P.placement(keys, ring, 2).crossJoin(F.broadcast(ring.agg(F.min("node_id").alias("node_id"))))
    roles = placed.select("content_hash", (F.col("primary") == F.col("node_id")).alias("is_primary"), F.array_contains("replicas", F.col("node_id")).alias("is_replica"))
    return roles.where("is_primary or is_replica")


@query("canonical_lookup", f"WITH {S.PROMPTS}, {S.windows(64)}, pool AS (SELECT content_hash, min(prompt_id) AS prompt_id FROM win WHERE prompt_id % 4 <> 3 GROUP BY 1), refs AS (SELECT DISTINCT tenant, content_hash FROM win) SELECT tenant, content_hash, prompt_id FROM refs LEFT JOIN pool USING (content_hash)")
def canonical_lookup(spark, d):
    """References of tenants with the canonical fragment's origin; null where the pool no longer holds it."""
    rows = W.token_windows(T.prompts(spark, d), 64).select("content_hash", "tenant", "prompt_id")
    pool = I.canonical(rows.where("prompt_id % 4 <> 3"), ["prompt_id"]).select("content_hash", F.col("first.prompt_id").alias("prompt_id"))
    return rows.select("tenant", "content_hash").distinct().join(pool, "content_hash", "left").select("tenant", "content_hash", "prompt_id")


@query("delete_fragments", f"{ACC}, {S.STORE}, {S.INVENTORY} SELECT node_id, count(*) AS fragments, sum(size)::BIGINT AS size FROM inv JOIN store USING (content_hash) WHERE k % 5 <> 0 GROUP BY 1")
def delete_fragments(spark, d):
    """What nodes hold after fragments are deleted everywhere: from the store and from all placements."""
    accessed = T.accesses(spark, d)
    fragments = T.store(accessed)
    gone = fragments.where("k % 5 = 0")
    kept, placed = I.remove(fragments, gone, ["content_hash"]), I.remove(T.inventory(accessed), gone, ["content_hash"])
    return placed.join(kept.select("content_hash", "size"), "content_hash").groupBy("node_id").agg(F.count("*").alias("fragments"), F.sum("size").alias("size"))


@query("prefix_cache", f"{ACC}, l AS (SELECT session_id, content_hash, max(k) AS k, count(*) AS fragments, max(ts) AS last_access FROM acc GROUP BY ALL), kept AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY last_access DESC, content_hash) <= 16) SELECT session_id, content_hash, fragments FROM kept WHERE k % 7 <> 0")
def prefix_cache(spark, d):
    """Each session caches the fragments of at most 16 prefixes, the last touched ones; then some prefixes are removed."""
    touched = T.accesses(spark, d).groupBy("session_id", "content_hash").agg(F.max("k").alias("k"), F.count("*").alias("fragments"), F.max("ts").alias("last_access"))
    kept = C.survivors(touched, ["session_id"], 16)
    return I.remove(kept, kept.where("k % 7 = 0"), ["session_id", "content_hash"]).select("session_id", "content_hash", "fragments")


@query("store_with_eviction", f"""{ACC}, {S.STORE}, q AS (SELECT kind, content_hash, size, sum(size) OVER (PARTITION BY kind ORDER BY last_access DESC, content_hash ROWS UNBOUNDED PRECEDING) AS held FROM store)
  SELECT kind, content_hash, size, held::BIGINT AS held FROM q WHERE held <= 60000""")
def store_with_eviction(spark, d):
    """A store a kind that takes every fragment and evicts the least recently used past its capacity."""
    return C.within_capacity(T.store(T.accesses(spark, d)), ["kind"], 60000).select("kind", "content_hash", "size", "held")


# --- graphs and versions

@query("edge_lookup", f"{ACC}, {S.NEXT}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), pairs AS (SELECT DISTINCT content_hash AS src, lead(content_hash, 2) OVER (PARTITION BY session_id ORDER BY seq) AS dst FROM acc) SELECT p.src, p.dst, round(coalesce(weight, 0), 8) AS weight, weight IS NOT NULL AS has_edge, p.dst IN (SELECT node FROM nodes) AS has_node FROM pairs p LEFT JOIN edges e ON e.src = p.src AND e.dst = p.dst WHERE p.dst IS NOT NULL")
def edge_lookup(spark, d):
    """Pairs two accesses apart: is there an edge, of what weight, and is the second a node at all."""
    from pyspark.sql import Window

    accessed = T.accesses(spark, d)
    edges = G.next_edges(accessed)
    later = F.lead("content_hash", 2).over(Window.partitionBy("session_id").orderBy("seq"))
    pairs = accessed.select(F.col("content_hash").alias("src"), later.alias("dst")).where("dst is not null").distinct()
    nodes = edges.select(F.col("src").alias("dst")).union(edges.select("dst")).distinct().withColumn("has_node", F.lit(True))
    found = G.weights_of(pairs, edges).join(nodes, "dst", "left").withColumn("has_node", F.coalesce("has_node", F.lit(False)))
    return found.select("src", "dst", F.round("weight", 8).alias("weight"), (F.col("weight") > 0).alias("has_edge"), "has_node")


@query("disjoint_clusters")
def disjoint_clusters(spark, d):
    """Clusters of all nodes as seeds, in order of hash; a seed that an earlier cluster reached is skipped."""
    edges = G.next_edges(T.accesses(spark, d))
    seeds = edges.select(F.col("src").alias("seed")).union(edges.select("dst")).distinct()
    reached = G.components(seeds, edges, 0.12, 3)
    return G.disjoint(reached).groupBy("seed").agg(F.count("*").alias("reached"), F.min("node").alias("least"))


@query("refused_versions", f"WITH {_VERSIONS} SELECT version_id FROM (SELECT version_id FROM v UNION ALL SELECT version_id FROM v WHERE turn % 4 = 0) GROUP BY 1 HAVING count(*) > 1")
def refused_versions(spark, d):
    """Appends whose id the chain already holds."""
    v = _versions(spark, d)
    return L.repeated_version_ids(v.union(v.where("turn % 4 = 0")))


@query("version_lookup", f"WITH {_VERSIONS}, w AS (SELECT version_id + turn % 3 AS version_id, conv_id, turn AS asked FROM v) SELECT w.conv_id, asked, w.version_id, v.prefix_hash, v.parent_version FROM w LEFT JOIN v USING (version_id)")
def version_lookup(spark, d):
    """Versions asked for by id, null where the chain has none."""
    v = _versions(spark, d)
    asked = v.select((F.col("version_id") + F.col("turn") % 3).alias("version_id"), "conv_id", F.col("turn").alias("asked"))
    return asked.join(v.select("version_id", "prefix_hash", "parent_version"), "version_id", "left").select("conv_id", "asked", "version_id", "prefix_hash", "parent_version")


@query("gossip_codec", f"{ACC}, {S.INVENTORY} SELECT node_id, count(*) AS digests, sum(version_id)::BIGINT AS versions, 8 AS peers, count(*) FILTER (content_hash < '8') AS located FROM inv GROUP BY 1")
def gossip_codec(spark, d):
    """A state a node and leading digit, written as JSON and read back."""
    inv = T.inventory(T.accesses(spark, d))
    peers = F.array(*[F.struct(F.lit(f"n{i}").alias("node_id"), F.lit("h").alias("host"), F.lit(7000 + i).alias("port"), F.lit(i % 2 == 0).alias("healthy")) for i in range(8)])
    located = F.map_from_entries(F.collect_list(F.when(F.col("content_hash") < "8", F.struct("content_hash", F.array("node_id").alias("nodes")))))
    states = inv.groupBy("node_id", F.substring("content_hash", 1, 1).alias("shard")).agg(F.lit(1.5).alias("timestamp"), located.alias("fragment_locations"), F.map_from_entries(F.collect_list(F.struct("content_hash", F.col("version_id").cast("int")))).alias("inventory_digest"))
    back = T.gossip_from_json(T.gossip_to_json(states.withColumn("peers", peers), "shard"), "shard")
    sums = back.select("node_id", F.size("inventory_digest").alias("n"), F.aggregate(F.map_values("inventory_digest"), F.lit(0), lambda a, x: a + x).alias("v"), F.size("peers").alias("p"), F.size("fragment_locations").alias("l"))
    return sums.groupBy("node_id").agg(F.sum("n").alias("digests"), F.sum("v").alias("versions"), F.max("p").alias("peers"), F.sum("l").alias("located"))


# --- the model, a window of requests at a time

_YEARS = "lengths AS (SELECT year(l_shipdate) AS y, trunc(l_extendedprice)::BIGINT AS length FROM lineitem WHERE trunc(l_extendedprice) BETWEEN 128 AND 131072)"


@query("reoptimize", f"""WITH {_YEARS}, g AS (SELECT unnest(range(1024, 65537, 256)) AS threshold), n AS (SELECT y, length, count(*) AS n FROM lengths GROUP BY ALL),
  st AS (SELECT y, threshold, sum(n) AS all_n, coalesce(sum(n) FILTER (length > threshold), 0) AS n_long, coalesce(sum(n * length) FILTER (length > threshold), 0) AS s_long, coalesce(sum(n * length) FILTER (length <= threshold), 0) AS s_short FROM g, n GROUP BY ALL),
  m AS (SELECT y, threshold, n_long / all_n AS fraction, CASE WHEN n_long = 0 THEN 0 ELSE s_long / n_long END AS mean_long, CASE WHEN n_long = all_n THEN 0 ELSE s_short / (all_n - n_long) END AS mean_short FROM st),
  l AS (SELECT *, CASE WHEN mean_long > 0 THEN round_even(mean_long, 0)::BIGINT ELSE threshold END AS ll, CASE WHEN mean_short > 0 THEN round_even(mean_short, 0)::BIGINT ELSE threshold END AS sl, unnest(range(1, 8)) AS n_p FROM m),
  r AS (SELECT *, 8 - n_p AS n_d, least(4.0::DOUBLE / {S.prefill('ll')}, 100.0::DOUBLE / ({S.kv('ll')} * {S.GBIT})) AS theta_offload, n_p::DOUBLE / ({S.prefill('sl')} * 2.5::DOUBLE) AS theta_local, (8 - n_p)::DOUBLE * 20 / (0.025::DOUBLE * 1024) AS theta_decode FROM l),
  e AS (SELECT *, least(CASE WHEN fraction <= 0 THEN 'inf'::DOUBLE ELSE theta_offload / fraction END, CASE WHEN fraction >= 1 THEN 'inf'::DOUBLE ELSE theta_local / (1.0::DOUBLE - fraction) END, theta_decode) AS rate FROM r)
  SELECT y AS year, threshold, threshold AS effective_threshold, n_p, n_d, round(rate, 6) AS lambda_max FROM e QUALIFY row_number() OVER (PARTITION BY y ORDER BY rate DESC, threshold, n_p) = 1""")
def reoptimize(spark, d):
    """Threshold and split found anew for each year's requests; the effective threshold starts from it."""
    rows = T.read(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_extendedprice").cast("long").alias("length")).where(F.col("length").between(128, 131072))
    return model.windowed_search(rows, "year").select("year", "threshold", F.col("threshold").alias("effective_threshold"), "n_p", "n_d", F.round("lambda", 6).alias("lambda_max"))
