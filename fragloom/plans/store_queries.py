"""Queries over access logs, caches, inventories, graphs and the hash ring."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragloom.operators import caches as C
from fragloom.operators import graph as G
from fragloom.operators import inventory as I
from fragloom.operators import placement as P
from fragloom.operators import workload as L
from fragloom.operators.joins import best
from fragloom.plans import sql as S
from fragloom.plans.registry import registry
from fragloom.sources import tables as T

QUERIES, ORACLES, query = registry()
ACC = f"WITH {S.ACCESSES}"


def _now(accessed):
    return accessed.agg(F.max("ts").alias("now"))


# --- access patterns and sessions

@query("wl_patterns", f"{ACC} SELECT content_hash, count(*) AS n, min(event_id) AS first_seen, round(count(*) / (SELECT count(*) FROM acc), 8) AS frequency FROM acc GROUP BY content_hash")
def wl_patterns(spark, d):
    return L.patterns(T.accesses(spark, d)).select("content_hash", "n", "first_seen", F.round("frequency", 8).alias("frequency"))


@query("wl_top_patterns", f"{ACC} SELECT content_hash, count(*) AS n, min(event_id) AS first_seen FROM acc GROUP BY content_hash ORDER BY n DESC, first_seen LIMIT 5")
def wl_top_patterns(spark, d):
    return L.top_patterns(T.accesses(spark, d)).select("content_hash", "n", "first_seen")


@query("wl_reuse_ratio", f"{ACC} SELECT kind, count(*) AS accesses, count(DISTINCT content_hash) AS distinct_hashes, round((count(*) - count(DISTINCT content_hash)) / count(*), 8) AS reuse_ratio FROM acc GROUP BY kind")
def wl_reuse_ratio(spark, d):
    return L.reuse_ratio(T.accesses(spark, d), ["kind"]).select("kind", "accesses", "distinct_hashes", F.round("reuse_ratio", 8).alias("reuse_ratio"))


@query("wl_mean_p90", "SELECT event_type AS kind, round(avg(value), 6) AS mean, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY 1")
def wl_mean_p90(spark, d):
    rows = T.read(spark, d, "events").select(F.col("event_type").alias("kind"), "value")
    return L.mean_and_p90(rows, ["kind"], "value").select("kind", F.round("mean", 6).alias("mean"), "p90")


@query("conditional_means", f"WITH {S.LENGTHS}, t AS (SELECT unnest([2048, 16384, 50000]) AS threshold) SELECT threshold, round(coalesce(avg((length > threshold)::INT), 0), 8) AS fraction, round(coalesce(avg(length) FILTER (length > threshold), 0), 4) AS mean_long, round(coalesce(avg(length) FILTER (length <= threshold), 0), 4) AS mean_short FROM lengths, t GROUP BY threshold")
def conditional_means(spark, d):
    rows = T.lengths(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (2048, 16384, 50000)])))
    return L.conditional_means(rows, F.col("threshold"), ["threshold"]).select("threshold", F.round("fraction", 8).alias("fraction"), F.round("mean_long", 4).alias("mean_long"), F.round("mean_short", 4).alias("mean_short"))


@query("session_history", f"{ACC} SELECT session_id, count(*) AS n, md5(string_agg(content_hash, ',' ORDER BY seq)) AS history_hash, count(DISTINCT content_hash) AS distinct_hashes FROM acc GROUP BY session_id")
def session_history(spark, d):
    return L.histories(T.accesses(spark, d)).select("session_id", F.size("history").alias("n"), F.md5(F.array_join("history", ",")).alias("history_hash"), F.size(F.array_distinct("history")).alias("distinct_hashes"))


@query("session_unique", f"{ACC} SELECT DISTINCT session_id, content_hash FROM acc")
def session_unique(spark, d):
    return T.accesses(spark, d).select("session_id", "content_hash").distinct()


@query("reuse_probability", f"{ACC} SELECT a.session_id, a.seq, round(count(*) FILTER (b.content_hash = a.content_hash) / count(*), 6) AS probability FROM acc a JOIN acc b ON a.session_id = b.session_id AND b.seq BETWEEN a.seq - 9 AND a.seq GROUP BY ALL")
def reuse_probability(spark, d):
    return L.reuse_probability(T.accesses(spark, d)).select("session_id", "seq", F.round("probability", 6).alias("probability"))


@query("value_density", f"{ACC}, {S.STORE}, c AS (SELECT session_id, content_hash, count(*) AS times FROM acc GROUP BY ALL), l AS (SELECT session_id, arg_max(content_hash, seq) AS last FROM acc GROUP BY 1) SELECT c.session_id, content_hash, round(least(1.0::DOUBLE, reuse_score + times * 0.05::DOUBLE + CASE WHEN content_hash = last THEN 0.1::DOUBLE ELSE 0 END), 6) AS value FROM c JOIN l USING (session_id) JOIN store USING (content_hash) UNION ALL SELECT NULL, content_hash, round(reuse_score, 6) FROM store")
def value_density(spark, d):
    """A fragment's value in each session that accessed it, and in all others (a null session)."""
    accessed = T.accesses(spark, d)
    return L.value_density(T.store(accessed), accessed).select("session_id", "content_hash", F.round("value", 6).alias("value"))


@query("egress_moving_average", f"{ACC} SELECT session_id, seq, round(avg(k) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS average FROM acc")
def egress_moving_average(spark, d):
    rows = T.accesses(spark, d).withColumn("utilization", F.col("k"))  # in per cent
    return L.moving_average(rows, ["session_id"], ["seq"], "utilization").select("session_id", "seq", F.round("average", 6).alias("average"))


@query("adjusted_threshold", f"""WITH RECURSIVE {S.ACCESSES}, s AS (SELECT session_id, seq, k / 100 AS average, (seq % 60) / 50 AS queue_ratio FROM acc),
  r AS (SELECT DISTINCT session_id, 0::BIGINT AS seq, 20000::BIGINT AS t FROM s UNION ALL
  SELECT s.session_id, s.seq, CASE WHEN s.average >= 0.85 OR s.queue_ratio >= 1 THEN least(floor(t * 1.10::DOUBLE)::BIGINT, 131072) WHEN t > 20000 THEN greatest(floor(t * 0.99::DOUBLE)::BIGINT, 20000) ELSE t END FROM r JOIN s ON s.session_id = r.session_id AND s.seq = r.seq + 1)
  SELECT session_id, arg_max(t, seq) AS threshold FROM r GROUP BY 1""")
def adjusted_threshold(spark, d):
    rows = T.accesses(spark, d).select("session_id", "seq", (F.col("k") / 100).alias("average"), (F.col("seq") % 60 / 50).alias("queue_ratio"))
    return L.adjusted_threshold(rows, ["session_id"], ["seq"], 20000)


# --- caches and tiers

@query("tier_counts", f"{ACC}, {S.STORE}, a AS (SELECT (SELECT max(ts) FROM acc) - last_access AS age FROM store) SELECT count(*) FILTER (age <= 3600) AS hot, count(*) FILTER (age > 3600 AND age <= 86400) AS warm, count(*) FILTER (age > 86400) AS cold FROM a")
def tier_counts(spark, d):
    accessed = T.accesses(spark, d)
    rows = T.store(accessed).crossJoin(F.broadcast(_now(accessed)))
    return C.tier_counts(rows, F.col("now"), 3600.0, 86400.0)


@query("ttl_expired", f"{ACC}, {S.STORE} SELECT content_hash, size, (SELECT max(ts) FROM acc) - inserted > ttl AS expired FROM store")
def ttl_expired(spark, d):
    accessed = T.accesses(spark, d)
    rows = T.store(accessed).crossJoin(F.broadcast(_now(accessed)))
    return rows.select("content_hash", "size", C.expired(F.col("now")).alias("expired"))


@query("lru_survivors", f"{ACC}, l AS (SELECT session_id, content_hash, max(ts) AS last_access FROM acc GROUP BY ALL) SELECT session_id, content_hash FROM l QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY last_access DESC, content_hash) <= 8")
def lru_survivors(spark, d):
    last = T.accesses(spark, d).groupBy("session_id", "content_hash").agg(F.max("ts").alias("last_access"))
    return C.survivors(last, ["session_id"], 8).select("session_id", "content_hash")


def _eviction_sql(score: str, phase: str, target: int) -> str:
    return f"""{ACC}, {S.STORE}, n AS (SELECT *, (SELECT max(ts) FROM acc) AS now FROM store), p AS (SELECT *, {phase} AS phase FROM n), q AS (SELECT *, {score} AS score FROM p),
  r AS (SELECT kind, content_hash, phase, row_number() OVER w AS place, sum(size) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS freed, size FROM q WINDOW w AS (PARTITION BY kind ORDER BY phase, score, content_hash))
  SELECT kind, content_hash, phase, place, freed FROM r WHERE freed - size < {target}"""


@query("node_eviction", _eviction_sql("CASE WHEN phase = 0 THEN inserted ELSE last_access / (reuse_score + 0.01::DOUBLE) END", "CASE WHEN now - inserted > ttl THEN 0 ELSE 1 END", 200000))
def node_eviction(spark, d):
    accessed = T.accesses(spark, d)
    rows = T.store(accessed).crossJoin(F.broadcast(_now(accessed)))
    return C.node_eviction(rows, ["kind"], F.col("now"), F.lit(200000)).select("kind", "content_hash", "phase", "place", "freed")


@query("store_eviction", _eviction_sql("CASE WHEN phase = 0 THEN inserted WHEN phase = 1 THEN reuse_score ELSE last_access / (reuse_score + 0.01::DOUBLE) END", "CASE WHEN now - inserted > ttl THEN 0 WHEN now - last_access > 86400 THEN 1 WHEN now - last_access > 3600 THEN 2 ELSE 3 END", 250000))
def store_eviction(spark, d):
    accessed = T.accesses(spark, d)
    rows = T.store(accessed).crossJoin(F.broadcast(_now(accessed)))
    return C.store_eviction(rows, ["kind"], F.col("now"), F.lit(250000), 3600.0, 86400.0).select("kind", "content_hash", "phase", "place", "freed")


@query("neighbour_eviction", f"""{ACC}, {S.STORE}, {S.NEXT}, e AS (SELECT content_hash FROM store WHERE reuse_score >= 0.9) SELECT content_hash, size FROM store WHERE content_hash IN (SELECT dst FROM edges WHERE src IN (SELECT content_hash FROM e)) AND content_hash NOT IN (SELECT content_hash FROM e)""")
def neighbour_eviction(spark, d):
    accessed = T.accesses(spark, d)
    store = T.store(accessed)
    return C.neighbour_eviction(store.where("reuse_score >= 0.9"), store, G.next_edges(accessed)).select("content_hash", "size")


@query("cache_hit_rate", f"{ACC}, h AS (SELECT kind, k, row_number() OVER (PARTITION BY content_hash ORDER BY event_id) > 1 AS hit FROM acc), s AS (SELECT kind, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, coalesce(sum(k) FILTER (NOT hit), 0)::BIGINT AS missed_size FROM h GROUP BY kind) SELECT kind, hits, misses, missed_size, round(hits / (hits + misses), 8) AS hit_rate, round(misses / (hits + misses), 8) AS miss_rate, round(CASE WHEN misses = 0 THEN 0 ELSE missed_size / misses END, 6) AS size_growth_rate FROM s")
def cache_hit_rate(spark, d):
    """The first access to a hash misses, later ones hit; no access order within a hash need be gathered."""
    accessed = T.accesses(spark, d)
    first = accessed.groupBy("content_hash").agg(F.min("event_id").alias("first"))
    rows = accessed.join(first, "content_hash").select("kind", F.col("k").alias("kv_size"), (F.col("event_id") != F.col("first")).alias("hit"))
    out = C.cache_metrics(rows, ["kind"])
    return out.select("kind", "hits", "misses", "missed_size", *[F.round(c, 8 if c != "size_growth_rate" else 6).alias(c) for c in ("hit_rate", "miss_rate", "size_growth_rate")])


@query("node_stats", f"{ACC}, {S.INVENTORY}, u AS (SELECT node_id, sum(version_id * 64)::BIGINT AS used, count(*) AS fragments, count(*) FILTER (version_id > 1) AS primaries FROM inv GROUP BY 1) SELECT node_id, used, 100000::BIGINT AS \"limit\", fragments, primaries, round(least(1, used / 100000), 6) AS load FROM u")
def node_stats(spark, d):
    rows = T.inventory(T.accesses(spark, d)).select("node_id", (F.col("version_id") * 64).alias("size"), (F.col("version_id") > 1).alias("is_primary"))
    return C.node_stats(rows, 100000).select("node_id", "used", "limit", "fragments", "primaries", F.round("load", 6).alias("load"))


@query("recent_events", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_events(spark, d):
    return T.read(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20).select("event_id", "user_id", "event_type")


@query("lru_candidates", f"{ACC}, {S.STORE} SELECT content_hash, last_access FROM store ORDER BY last_access, content_hash LIMIT 10")
def lru_candidates(spark, d):
    return T.store(T.accesses(spark, d)).orderBy("last_access", "content_hash").limit(10).select("content_hash", "last_access")


# --- inventories and directories

_PAIR = f"{ACC}, {S.INVENTORY}, l AS (SELECT * FROM inv WHERE node_id = 'n0'), r AS (SELECT * FROM inv WHERE node_id = 'n1')"


@query("inventory_diff", f"{_PAIR} SELECT r.content_hash FROM r LEFT JOIN l USING (content_hash) WHERE l.version_id IS NULL OR l.version_id < r.version_id")
def inventory_diff(spark, d):
    inv = T.inventory(T.accesses(spark, d))
    return I.stale(inv.where("node_id = 'n0'"), inv.where("node_id = 'n1'"))


@query("sync_plan", f"{_PAIR} SELECT r.content_hash, CASE WHEN l.version_id IS NULL THEN 'missing' ELSE 'outdated' END AS status, r.version_id * 64 AS size FROM r LEFT JOIN l USING (content_hash) WHERE l.version_id IS NULL OR l.version_id < r.version_id")
def sync_plan(spark, d):
    inv = T.inventory(T.accesses(spark, d)).withColumn("size", F.col("version_id") * 64)
    return I.sync_plan(inv.where("node_id = 'n1'"), inv.where("node_id = 'n0'"))


@query("batch_sync", f"{ACC}, {S.INVENTORY}, s AS (SELECT content_hash, version_id AS v FROM inv WHERE node_id = 'n0'), t AS (SELECT DISTINCT node_id AS target FROM inv WHERE node_id <> 'n0') SELECT target, s.content_hash, CASE WHEN i.version_id IS NULL THEN 'missing' ELSE 'outdated' END AS status FROM s CROSS JOIN t LEFT JOIN inv i ON i.node_id = target AND i.content_hash = s.content_hash WHERE i.version_id IS NULL OR i.version_id < v")
def batch_sync(spark, d):
    return I.batch_sync(T.inventory(T.accesses(spark, d)), "n0")


@query("gossip_merge", f"{ACC}, {S.INVENTORY}, o AS (SELECT content_hash, list(DISTINCT node_id) AS nodes, max(version_id) AS version_id FROM inv WHERE node_id < 'n4' GROUP BY 1), t AS (SELECT content_hash, list(DISTINCT node_id) AS nodes, max(version_id) AS version_id FROM inv WHERE node_id >= 'n3' GROUP BY 1) SELECT content_hash, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.nodes, []), coalesce(t.nodes, [])))), ',') AS nodes, coalesce(t.version_id, o.version_id) AS version_id FROM o FULL JOIN t USING (content_hash)")
def gossip_merge(spark, d):
    inv = T.inventory(T.accesses(spark, d))
    state = lambda rows: rows.groupBy("content_hash").agg(F.collect_set("node_id").alias("nodes"), F.max("version_id").alias("version_id"))
    out = I.merge_gossip(state(inv.where("node_id < 'n4'")), state(inv.where("node_id >= 'n3'")))
    return out.withColumn("nodes", F.array_join("nodes", ","))


@query("peer_merge", "WITH o AS (SELECT s_name AS node_id, 'a' || s_suppkey AS host, s_suppkey % 3 <> 0 AS healthy FROM supplier WHERE s_suppkey % 5 <> 0), t AS (SELECT s_name AS node_id, 'b' || s_suppkey AS host, s_suppkey % 2 = 0 AS healthy FROM supplier WHERE s_suppkey % 7 <> 0) SELECT node_id, CASE WHEN o.node_id IS NULL OR (NOT o.healthy AND coalesce(t.healthy, false)) THEN t.host ELSE o.host END AS host, CASE WHEN o.node_id IS NULL OR (NOT o.healthy AND coalesce(t.healthy, false)) THEN t.healthy ELSE o.healthy END AS healthy FROM o FULL JOIN t USING (node_id)")
def peer_merge(spark, d):
    s = T.read(spark, d, "supplier")
    peers = lambda letter, ok: s.select(F.col("s_name").alias("node_id"), F.concat(F.lit(letter), F.col("s_suppkey").cast("string")).alias("host"), ok.alias("healthy"), "s_suppkey")
    return I.merge_peers(peers("a", F.col("s_suppkey") % 3 != 0).where("s_suppkey % 5 <> 0"), peers("b", F.col("s_suppkey") % 2 == 0).where("s_suppkey % 7 <> 0"))


@query("directory_locate", f"{ACC}, {S.INVENTORY} SELECT content_hash, array_to_string(list_sort(list(DISTINCT node_id)), ',') AS nodes FROM inv GROUP BY 1")
def directory_locate(spark, d):
    return I.holders(T.inventory(T.accesses(spark, d))).select("content_hash", F.array_join("nodes", ",").alias("nodes"))


@query("directory_unregister", f"{ACC}, {S.INVENTORY} SELECT content_hash, count(*) AS holders FROM inv WHERE node_id NOT IN ('n2', 'n5') GROUP BY 1")
def directory_unregister(spark, d):
    inv = T.inventory(T.accesses(spark, d))
    gone = inv.where(F.col("node_id").isin("n2", "n5")).select("node_id")
    return I.remove(inv, gone, ["node_id"]).groupBy("content_hash").agg(F.count("*").alias("holders"))


@query("tenant_shared", f"WITH {S.PROMPTS}, {S.windows(64)}, s AS (SELECT content_hash FROM win GROUP BY 1 HAVING count(DISTINCT tenant) > 1) SELECT tenant, count(DISTINCT content_hash) AS shared FROM win WHERE content_hash IN (SELECT content_hash FROM s) GROUP BY 1")
def tenant_shared(spark, d):
    from fragloom.operators.windows import token_windows

    pairs = token_windows(T.prompts(spark, d), 64).select("content_hash", "tenant").distinct()
    shared = pairs.groupBy("content_hash").count().where("count > 1").select("content_hash")
    return I.present(pairs, shared, ["content_hash"]).groupBy("tenant").agg(F.count("*").alias("shared"))


@query("deduplicated_spans", f"WITH {S.PROMPTS}, {S.windows(64)} SELECT content_hash, min(prompt_id) AS prompt_id, arg_min(token_start, prompt_id * 1000000 + token_start) AS token_start FROM win GROUP BY 1")
def deduplicated_spans(spark, d):
    from fragloom.operators.windows import token_windows

    rows = token_windows(T.prompts(spark, d), 64)
    return rows.groupBy("content_hash").agg(F.min(F.struct("prompt_id", "token_start")).alias("x")).select("content_hash", "x.prompt_id", "x.token_start")


# --- graphs

@query("co_access_pairs", f"{ACC}, e AS (SELECT DISTINCT session_id * 1000 + seq // 6 AS request_id, content_hash FROM acc) SELECT DISTINCT a.content_hash AS a, b.content_hash AS b FROM e a JOIN e b ON a.request_id = b.request_id AND a.content_hash < b.content_hash")
def co_access_pairs(spark, d):
    """Requests are six accesses of a session, so pairs grow with the accesses."""
    rows = T.accesses(spark, d).select((F.col("session_id") * 1000 + F.floor(F.col("seq") / 6)).alias("request_id"), "content_hash")
    return G.batch_pairs(rows)


@query("strong_neighbours", f"{ACC}, {S.NEXT} SELECT src, dst, round(weight, 8) AS weight FROM edges WHERE weight >= 0.1")
def strong_neighbours(spark, d):
    edges = G.next_edges(T.accesses(spark, d))
    return edges.where("weight >= 0.1").select("src", "dst", F.round("weight", 8).alias("weight"))


@query("bfs_components", f"""{ACC}, {S.NEXT}, strong AS (SELECT src, dst FROM edges WHERE weight >= 0.12), seeds AS (SELECT src AS seed FROM edges UNION SELECT dst FROM edges),
  d1 AS (SELECT seed, seed AS node FROM seeds UNION SELECT seed, dst FROM seeds JOIN strong ON src = seed), d2 AS (SELECT seed, node FROM d1 UNION SELECT seed, dst FROM d1 JOIN strong ON src = node), d3 AS (SELECT seed, node FROM d2 UNION SELECT seed, dst FROM d2 JOIN strong ON src = node)
  SELECT seed, count(*) AS reached, min(node) AS least FROM d3 GROUP BY seed""")
def bfs_components(spark, d):
    edges = G.next_edges(T.accesses(spark, d))
    seeds = edges.select(F.col("src").alias("seed")).union(edges.select("dst"))
    return G.components(seeds, edges, 0.12, 3).groupBy("seed").agg(F.count("*").alias("reached"), F.min("node").alias("least"))


@query("prefetch", f"{ACC}, {S.NEXT} SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rank FROM edges QUALIFY rank <= 10")
def prefetch(spark, d):
    edges = G.neighbours(G.next_edges(T.accesses(spark, d)))
    return best(edges, ["src"], [F.col("dst")], 10)


@query("graph_without_node", f"{ACC}, {S.STORE}, {S.NEXT}, g AS (SELECT content_hash FROM store WHERE kind = 'error') SELECT count(*) AS edges, count(DISTINCT src) AS sources FROM edges WHERE src NOT IN (SELECT content_hash FROM g) AND dst NOT IN (SELECT content_hash FROM g)")
def graph_without_node(spark, d):
    accessed = T.accesses(spark, d)
    left = G.without_node(G.next_edges(accessed), T.store(accessed).where("kind = 'error'"))
    return left.agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"))


@query("replicate_component", f"{ACC}, {S.INVENTORY}, c AS (SELECT DISTINCT content_hash FROM acc WHERE k < 20), h AS (SELECT content_hash FROM inv WHERE node_id = 'n0'), t AS (SELECT DISTINCT node_id AS target FROM inv WHERE node_id <> 'n0') SELECT target, count(*) AS moved FROM c JOIN h USING (content_hash) CROSS JOIN t GROUP BY 1")
def replicate_component(spark, d):
    accessed = T.accesses(spark, d)
    inv = T.inventory(accessed)
    moved = G.replicate(accessed.where("k < 20"), inv.where("node_id = 'n0'"), inv.where("node_id <> 'n0'"))
    return moved.groupBy("target").agg(F.count("*").alias("moved"))


_VERSIONS = "v AS (SELECT conv_id * 100 + turn AS version_id, CASE WHEN turn % 3 = 0 AND turn > 1 THEN conv_id * 100 + turn - 2 WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS parent_version, md5(text) AS prefix_hash, conv_id, turn FROM conversations)"


def _versions(spark, d):
    conv, turn = F.col("conv_id"), F.col("turn")
    parent = F.when((turn % 3 == 0) & (turn > 1), conv * 100 + turn - 2).when(turn > 0, conv * 100 + turn - 1)
    return T.read(spark, d, "conversations").select((conv * 100 + turn).alias("version_id"), parent.alias("parent_version"), F.md5("text").alias("prefix_hash"), "conv_id", "turn")


@query("latest_version", f"WITH {_VERSIONS} SELECT prefix_hash, max(version_id) AS version_id FROM v GROUP BY 1")
def latest_version(spark, d):
    return L.latest_versions(_versions(spark, d))


@query("version_ancestor", f"""WITH RECURSIVE {_VERSIONS}, up AS (SELECT version_id, version_id AS ancestor, 0 AS steps, parent_version FROM v UNION ALL SELECT up.version_id, up.parent_version, steps + 1, v.parent_version FROM up LEFT JOIN v ON v.version_id = up.parent_version WHERE up.parent_version IS NOT NULL AND steps < 8),
  p AS (SELECT a.version_id AS v1, b.version_id AS v2 FROM v a JOIN v b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT v1, v2, arg_min(x.ancestor, x.steps) AS ancestor FROM p JOIN up x ON x.version_id = v2 JOIN up y ON y.version_id = v1 AND y.ancestor = x.ancestor GROUP BY v1, v2""")
def version_ancestor(spark, d):
    v = _versions(spark, d)
    pairs = v.select(F.col("version_id").alias("v1"), "conv_id", (F.col("turn") + 1).alias("turn")).join(v.select(F.col("version_id").alias("v2"), "conv_id", "turn"), ["conv_id", "turn"]).select("v1", "v2")
    return G.common_ancestor(pairs, v, 8)


# --- the ring

_RING_KEYS = "n AS (SELECT s_name AS node_id FROM supplier WHERE s_suppkey < 10), pts AS (SELECT md5(node_id || ':' || i) AS point, node_id FROM n, range(0, 150) t(i)), keys AS (SELECT DISTINCT content_hash, md5(content_hash) AS key FROM acc)"


def _ring(spark, d, condition="s_suppkey < 10"):
    return T.read(spark, d, "supplier").where(condition).select(F.col("s_name").alias("node_id"))


@query("ring_primary", f"{ACC}, {_RING_KEYS} SELECT content_hash, coalesce((SELECT arg_min(node_id, point) FROM pts WHERE point >= key), (SELECT arg_min(node_id, point) FROM pts)) AS node_id FROM keys")
def ring_primary(spark, d):
    keys = T.accesses(spark, d).select("content_hash").distinct()
    return P.owners(keys, _ring(spark, d)).select("content_hash", F.col("owners")[0].alias("node_id"))


@query("ring_replicas", f"""{ACC}, {_RING_KEYS}, two AS (SELECT 0 AS turn, * FROM pts UNION ALL SELECT 1, * FROM pts), r AS (SELECT content_hash, node_id, min((turn, point)) AS nearest FROM keys JOIN two ON turn = 1 OR point >= key GROUP BY ALL),
  o AS (SELECT content_hash, node_id, row_number() OVER (PARTITION BY content_hash ORDER BY nearest) AS place FROM r) SELECT content_hash, max(node_id) FILTER (place = 1) AS "primary", string_agg(node_id, ',' ORDER BY place) FILTER (place BETWEEN 2 AND 3) AS replicas FROM o GROUP BY 1""")
def ring_replicas(spark, d):
    keys = T.accesses(spark, d).select("content_hash").distinct()
    return P.placement(keys, _ring(spark, d), 2).select("content_hash", "primary", F.array_join("replicas", ",").alias("replicas"))


@query("ring_rebalance", f"""{ACC}, {_RING_KEYS}, q AS (SELECT * FROM pts WHERE node_id <> (SELECT min(node_id) FROM n)), o AS (SELECT content_hash, coalesce((SELECT arg_min(node_id, point) FROM pts WHERE point >= key), (SELECT arg_min(node_id, point) FROM pts)) AS old_node, coalesce((SELECT arg_min(node_id, point) FROM q WHERE point >= key), (SELECT arg_min(node_id, point) FROM q)) AS new_node FROM keys) SELECT * FROM o WHERE old_node <> new_node""")
def ring_rebalance(spark, d):
    keys = T.accesses(spark, d).select("content_hash").distinct()
    return P.migrations(keys, _ring(spark, d), _ring(spark, d, "s_suppkey between 1 and 9"))


@query("node_shards", f"{ACC}, {_RING_KEYS}, o AS (SELECT coalesce((SELECT arg_min(node_id, point) FROM pts WHERE point >= key), (SELECT arg_min(node_id, point) FROM pts)) AS node_id FROM keys) SELECT node_id, count(*) AS shards FROM o GROUP BY 1")
def node_shards(spark, d):
    keys = T.accesses(spark, d).select("content_hash").distinct()
    return P.owners(keys, _ring(spark, d)).groupBy(F.col("owners")[0].alias("node_id")).agg(F.count("*").alias("shards"))


@query("nearest_holder", f"{ACC}, {S.INVENTORY}, {_RING_KEYS}, h AS (SELECT content_hash, min(node_id) AS h FROM inv WHERE node_id >= 'n6' GROUP BY 1) SELECT content_hash, coalesce(h, (SELECT arg_min(node_id, point) FROM pts WHERE point >= key), (SELECT arg_min(node_id, point) FROM pts)) AS node_id FROM keys LEFT JOIN h USING (content_hash)")
def nearest_holder(spark, d):
    accessed = T.accesses(spark, d)
    keys = P.owners(accessed.select("content_hash").distinct(), _ring(spark, d)).select("content_hash", F.col("owners")[0].alias("fallback"))
    return I.nearest_holder(keys, T.inventory(accessed).where("node_id >= 'n6'"))
