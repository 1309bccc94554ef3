"""Queries over spans, vectors, routing decisions, the throughput model and reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragloom.functions import throughput as M
from fragloom.functions.hashing import cosine
from fragloom.operators import decisions as D
from fragloom.operators import joins as J
from fragloom.operators import reconstruct as R
from fragloom.operators import vectors as V
from fragloom.operators import windows as W
from fragloom.plans import model
from fragloom.plans import sql as S
from fragloom.plans.registry import registry
from fragloom.sources import tables as T
from fragloom.sources.checkpoints import cut

QUERIES, ORACLES, query = registry()

# --- spans

_SPANS = "spans AS (SELECT l_orderkey AS id, l_linenumber AS line, l_suppkey % 50 AS grp, epoch(l_shipdate)::BIGINT // 86400 AS start, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS stop FROM lineitem), probes AS (SELECT o_orderkey AS probe, o_custkey % 50 AS grp, epoch(o_orderdate)::BIGINT // 86400 AS q_start, epoch(o_orderdate)::BIGINT // 86400 + 3 AS q_stop FROM orders)"


def _day(c):
    return F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 86400)


def _spans(spark, d):
    start = _day("l_shipdate")
    return T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 50).alias("grp"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("stop"))


def _probes(spark, d):
    start = _day("o_orderdate")
    return T.read(spark, d, "orders").select(F.col("o_orderkey").alias("probe"), (F.col("o_custkey") % 50).alias("grp"), start.alias("q_start"), (start + 3).alias("q_stop"))


@query("span_overlap", f"WITH {_SPANS} SELECT probe, count(*) AS hits, min(start) AS least, max(stop) AS most FROM probes JOIN spans ON spans.grp = probes.grp AND start <= q_stop AND stop >= q_start GROUP BY probe")
def span_overlap(spark, d):
    met = J.overlap_counts(_spans(spark, d), _probes(spark, d), ["grp"])
    return met.groupBy("probe").agg(F.sum("hits").alias("hits"), F.min("least").alias("least"), F.max("most").alias("most"))


@query("span_adjacent", f"WITH {_SPANS} SELECT probe, count(*) AS hits FROM (SELECT DISTINCT probe, id, line, start, stop FROM probes JOIN spans ON spans.grp = probes.grp AND ((start - q_start BETWEEN 0 AND 1) OR (q_start - stop BETWEEN 0 AND 1))) GROUP BY probe")
def span_adjacent(spark, d):
    points = _probes(spark, d).select("probe", "grp", F.col("q_start").alias("position"))
    return J.adjacent_counts(_spans(spark, d), points, ["grp"], "probe", 1)


_COVER = "raw AS (SELECT l_partkey AS part, epoch(l_shipdate)::BIGINT // 86400 AS start, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS stop FROM lineitem), ends AS (SELECT min(start) AS lo, max(stop) + 1 - min(start) AS length FROM raw), s AS (SELECT part, start - lo AS a, stop - lo AS b FROM raw, ends), m AS (SELECT part, a, b, coalesce(max(b) OVER (PARTITION BY part ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS open FROM (SELECT * FROM s UNION ALL SELECT DISTINCT part, length, length FROM s, ends))"


def _placed(spark, d):
    """Each part's shipments as spans of days, from the first day of all to the last."""
    start = _day("l_shipdate")
    rows = T.read(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("stop"))
    ends = rows.agg(F.min("start").alias("lo"), (F.max("stop") + 1 - F.min("start")).alias("length"))  # one row
    return rows.crossJoin(F.broadcast(ends)).select("part", (F.col("start") - F.col("lo")).alias("start"), (F.col("stop") - F.col("lo")).alias("stop"), "length")


@query("span_gaps", f"WITH {_COVER} SELECT part, open + 1 AS gap_start, a - 1 AS gap_end FROM m WHERE open + 1 < a")
def span_gaps(spark, d):
    return J.gaps(_placed(spark, d), ["part"], "length")


@query("coverage_ratio", f"WITH {_COVER}, g AS (SELECT part, sum(CASE WHEN open + 1 < a THEN a - open - 1 ELSE 0 END) AS missing FROM m GROUP BY part) SELECT part, length, (length - missing)::BIGINT AS covered, round((length - missing) / length, 6) AS ratio FROM g, ends")
def coverage_ratio(spark, d):
    return J.covered(_placed(spark, d), ["part"], "length").select("part", "length", "covered", F.round("ratio", 6).alias("ratio"))


# --- vectors

@query("cosine_topk", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
  s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS score FROM q, e) SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""")
def cosine_topk(spark, d):
    rows = T.vectors(spark, d)
    return V.top_neighbours(rows, rows.where("vec_id % 20 = 0"), 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("label_cosine", "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), f AS (SELECT label, arg_min(v, vec_id) AS f FROM e GROUP BY label) SELECT vec_id, round(list_cosine_similarity(v, f), 6) AS score FROM e JOIN f USING (label)")
def label_cosine(spark, d):
    rows = T.vectors(spark, d)
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("f"))
    return rows.join(first, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("f")), 6).alias("score"))


@query("leader_clusters", """WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings),
  near AS (SELECT b.label, b.vec_id, list(a.vec_id) AS leads FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id AND round(list_cosine_similarity(a.v, b.v), 12) >= 0.6 GROUP BY 1, 2),
  o AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, coalesce(leads, []::BIGINT[]) AS leads FROM e LEFT JOIN near USING (label, vec_id)),
  walk AS (SELECT DISTINCT label, 0::BIGINT AS r, []::BIGINT[] AS leaders FROM e UNION ALL SELECT walk.label, o.r, CASE WHEN list_has_any(leaders, leads) THEN leaders ELSE list_append(leaders, vec_id) END FROM walk JOIN o ON o.label = walk.label AND o.r = walk.r + 1)
  SELECT label, vec_id, coalesce(list_min(list_intersect(leads, leaders)), vec_id) AS leader FROM o JOIN walk USING (label, r)""")
def leader_clusters(spark, d):
    return V.leader_clusters(T.vectors(spark, d), "label", 0.6)


# --- decisions

N = f"WITH {S.NODES}"
_COST = "(least(1.0::DOUBLE, latency_ms / 5000.0) + least(1.0::DOUBLE, bandwidth_cost) + least(1.0::DOUBLE, gpu_load) + least(1.0::DOUBLE, memory_pressure))"
_OK = "gpu_load <= 0.95 AND memory_pressure <= 0.95 AND bandwidth_cost <= 0.95 AND latency_ms / 5000.0 <= 0.95"


@query("economic_route", f"{N}, {S.ACCESSES}, {S.STORE}, c AS (SELECT region, arg_min(node_id, (round({_COST}, 9), seq)) AS node_id, min(round({_COST}, 9)) AS cost FROM nodes GROUP BY region) SELECT content_hash, (k % 25)::INT AS region, node_id, round(reuse_score - cost, 6) AS net_value FROM store JOIN c ON c.region = k % 25")
def economic_route(spark, d):
    fragments = T.store(T.accesses(spark, d)).select("content_hash", F.col("reuse_score").alias("value"), (F.col("k") % 25).cast("int").alias("region"))
    cheapest = D.argmin(T.nodes(spark, d), ["region"], F.round(D.telemetry_cost(), 9))
    return fragments.join(cheapest, "region").select("content_hash", "region", "node_id", F.round(F.col("value") - F.col("score"), 6).alias("net_value"))


@query("healthy_nodes", f"{N} SELECT node_id FROM nodes WHERE {_OK}")
def healthy_nodes(spark, d):
    return T.nodes(spark, d).where(D.is_healthy()).select("node_id")


@query("select_top_nodes", f"{N} SELECT region, node_id, round({_COST}, 6) AS score, row_number() OVER (PARTITION BY region ORDER BY round({_COST}, 9), seq) AS rank FROM nodes WHERE {_OK} QUALIFY rank <= 3")
def select_top_nodes(spark, d):
    rows = T.nodes(spark, d).where(D.is_healthy()).withColumn("score", F.round(D.telemetry_cost(), 9))
    return J.best(rows, ["region"], [F.col("score"), F.col("seq")], 3).select("region", "node_id", F.round("score", 6).alias("score"), "rank")


@query("latency_route", f"""WITH {S.ACCESSES}, {S.INVENTORY}, {S.NODES}, lat AS (SELECT 'n' || seq AS node_id, seq, latency_ms FROM nodes WHERE seq < 6), req AS (SELECT DISTINCT content_hash, 'n' || (k % 8) AS local_node FROM acc),
  near AS (SELECT inv.content_hash, arg_min(inv.node_id, (coalesce(latency_ms, 'inf'::DOUBLE), coalesce(seq, 99))) AS near FROM inv LEFT JOIN lat USING (node_id) WHERE inv.version_id > 1 GROUP BY 1)
  SELECT req.content_hash, local_node, CASE WHEN i.node_id IS NOT NULL THEN local_node ELSE coalesce(near, local_node) END AS target FROM req LEFT JOIN inv i ON i.content_hash = req.content_hash AND i.node_id = local_node AND i.version_id > 1 LEFT JOIN near ON near.content_hash = req.content_hash""")
def latency_route(spark, d):
    accessed = T.accesses(spark, d)
    lat = T.nodes(spark, d).where("seq < 6").select(F.concat(F.lit("n"), F.col("seq").cast("string")).alias("node_id"), "seq", "latency_ms")
    requests = accessed.select("content_hash", F.concat(F.lit("n"), (F.col("k") % 8).cast("string")).alias("local_node")).distinct()
    return D.latency_route(requests, T.inventory(accessed).where("version_id > 1").select("content_hash", "node_id"), lat).select("content_hash", "local_node", "target")


@query("joint_placement", f"""{N}, c AS (SELECT region, arg_min(node_id, (round(gpu_load + latency_ms / 1000.0, 9), seq)) AS compute_node FROM nodes GROUP BY region), m AS (SELECT region, node_id, row_number() OVER (PARTITION BY region ORDER BY memory_pressure, seq) AS r FROM nodes),
  j AS (SELECT c.region, compute_node, n.load, n.latency_ms, m1.node_id AS first, m2.node_id AS second FROM c JOIN nodes n ON n.node_id = compute_node JOIN m m1 ON m1.region = c.region AND m1.r = 1 LEFT JOIN m m2 ON m2.region = c.region AND m2.r = 2)
  SELECT region, compute_node, CASE WHEN first = compute_node AND load > 0.8 THEN coalesce(second, first) ELSE first END AS memory_node, round(latency_ms / 1000, 6) AS latency_seconds FROM j""")
def joint_placement(spark, d):
    nodes = T.nodes(spark, d)
    return D.joint_placement(nodes, "region").select("region", "compute_node", "memory_node", F.round("latency_seconds", 6).alias("latency_seconds"))


@query("offload_decide", f"""{N}, {S.PROMPTS}, c AS (SELECT node_id, load, seq FROM nodes WHERE seq < 40), req AS (SELECT prompt_id AS request_id, len(tokens) AS length, 'local' AS local_node, (prompt_id % 11) / 10 AS local_load FROM prompts),
  b AS (SELECT length, arg_min(node_id, (round({S.prefill('length')} * load + 1 / (1 - load + 0.01::DOUBLE), 9), seq)) AS best FROM (SELECT DISTINCT length FROM req), c GROUP BY length)
  SELECT request_id, length, CASE WHEN length <= 512 AND local_load < 0.8 THEN local_node ELSE best END AS target_node, length <= 512 AND local_load < 0.8 AS local_compute, round({S.prefill('length')}, 6) AS cost_seconds, CASE WHEN length <= 512 AND local_load < 0.8 THEN 'short prompt and low local load' ELSE 'offloaded to lower-load node' END AS reason FROM req JOIN b USING (length)""")
def offload_decide(spark, d):
    requests = T.prompt_sizes(spark, d).select(F.col("prompt_id").alias("request_id"), "length", F.lit("local").alias("local_node"), (F.col("prompt_id") % 11 / 10).alias("local_load"))
    out = D.offload(requests, T.nodes(spark, d).where("seq < 40"))
    return out.withColumn("cost_seconds", F.round("cost_seconds", 6))


@query("promotion", f"""WITH {S.ACCESSES}, {S.STORE}, dem AS (SELECT content_hash, 'r' || (session_id % 5) AS region, count(*) AS n FROM acc GROUP BY ALL), rep AS (SELECT DISTINCT content_hash, 'r' || (event_id % 5) AS region FROM acc WHERE event_id % 4 = 0),
  t AS (SELECT content_hash, sum(n) AS total FROM dem GROUP BY 1), h AS (SELECT content_hash, count(*) AS held FROM rep GROUP BY 1),
  o AS (SELECT content_hash, region, row_number() OVER (PARTITION BY content_hash ORDER BY n DESC, region) AS r FROM dem ANTI JOIN rep USING (content_hash, region)),
  g AS (SELECT s.content_hash, reuse_score, coalesce(total, 0) AS total, coalesce(held, 0) AS held, (SELECT string_agg(region, ',' ORDER BY r) FROM o WHERE o.content_hash = s.content_hash AND r <= 3 - coalesce(h.held, 0)) AS targets FROM store s LEFT JOIN t USING (content_hash) LEFT JOIN h USING (content_hash))
  SELECT content_hash, CASE WHEN reuse_score < 0.7 THEN 'reuse_score below threshold' WHEN total < 3 THEN 'demand below threshold' WHEN held >= 3 THEN 'max replicas reached' WHEN targets IS NULL THEN 'no suitable regions' ELSE 'high reuse and multi-region demand' END AS reason,
  reuse_score >= 0.7 AND total >= 3 AND held < 3 AND targets IS NOT NULL AS promote, CASE WHEN reuse_score >= 0.7 AND total >= 3 AND held < 3 THEN coalesce(targets, '') ELSE '' END AS targets FROM g""")
def promotion(spark, d):
    accessed = T.accesses(spark, d)
    region = lambda c: F.concat(F.lit("r"), (F.col(c) % 5).cast("string"))
    demand = accessed.groupBy("content_hash", region("session_id").alias("region")).agg(F.count("*").alias("n"))
    replicas = accessed.where("event_id % 4 = 0").select("content_hash", region("event_id").alias("region")).distinct()
    return D.promotion(T.store(accessed), demand, replicas).withColumn("targets", F.array_join("targets", ","))


@query("node_roles", f"{N}, s AS (SELECT region, avg(gpu_load) AS gpu, sum(gpu_load) AS c, sum(memory_pressure) AS m FROM nodes GROUP BY region) SELECT node_id, CASE WHEN load < 0.3 AND round(gpu, 6) > 0.7 THEN 'prefill_worker' WHEN load > 0.7 AND round(gpu, 6) < 0.3 THEN 'memory_host' WHEN round(c, 6) > round(m, 6) THEN 'decode_worker' ELSE 'memory_host' END AS role FROM nodes JOIN s USING (region)")
def node_roles(spark, d):
    nodes = T.nodes(spark, d)
    state = nodes.groupBy("region").agg(F.round(F.avg("gpu_load"), 6).alias("gpu"), F.round(F.sum("gpu_load"), 6).alias("c"), F.round(F.sum("memory_pressure"), 6).alias("m"))
    return nodes.join(state, "region").select("node_id", D.node_role(F.col("load"), F.col("gpu"), F.col("c"), F.col("m")).alias("role"))


@query("least_pressed_node", f"{N} SELECT region, arg_min(node_id, (memory_pressure, seq)) AS node_id, min(memory_pressure) AS score FROM nodes GROUP BY region")
def least_pressed_node(spark, d):
    return D.argmin(T.nodes(spark, d), ["region"], F.col("memory_pressure"))


@query("tenant_can_share", f"WITH {S.ACCESSES}, {S.STORE}, t AS (SELECT unnest(['a', 'b']) AS tenant), s AS (SELECT content_hash, reuse_score, ['prefix', 'tool', 'artifact', 'kv'][(k % 4 + 1)::INT] AS model_id FROM store) SELECT content_hash, t.tenant = 'a' OR (reuse_score >= 0.6 AND model_id <> 'tool') AS shares, t.tenant FROM s, t")
def tenant_can_share(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("prefix", "tool", "artifact", "kv")])
    rows = T.store(T.accesses(spark, d)).select("content_hash", "reuse_score", F.get(kinds, (F.col("k") % 4).cast("int")).alias("model_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("tenant"))
    return rows.select("content_hash", D.can_share(F.col("model_id"), F.col("reuse_score"), F.lit("a"), F.col("tenant"), tools=False).alias("shares"), "tenant")


_ROUTED = "r AS (SELECT l_orderkey AS o, l_linenumber AS l, trunc(l_extendedprice)::BIGINT AS total, l_partkey * 7 % 30000 AS a, l_suppkey * 11 % 30000 AS b FROM lineitem)"


def _routed(spark, d):
    return T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_extendedprice").cast("long").alias("total"), (F.col("l_partkey") * 7 % 30000).alias("a"), (F.col("l_suppkey") * 11 % 30000).alias("b"))


@query("length_route", f"WITH {_ROUTED} SELECT o, l, CASE WHEN total - b <= 19400 THEN 'pd-p' ELSE 'offload' END AS target, greatest(0, CASE WHEN total - b <= 19400 THEN total - b ELSE total - a END) AS incremental, CASE WHEN total - b <= 19400 THEN b ELSE a END AS cached FROM r")
def length_route(spark, d):
    x = D.length_route(F.col("total"), F.col("a"), F.col("b"), F.lit(19400))
    return _routed(spark, d).select("o", "l", x.alias("x")).select("o", "l", "x.target", "x.incremental", "x.cached")


@query("length_route_abundant", f"WITH {_ROUTED}, s AS (SELECT *, greatest(a, b) AS p, total - greatest(a, b) <= 19400 AS near FROM r) SELECT o, l, CASE WHEN near THEN 'pd-p' ELSE 'offload' END AS target, greatest(0, total - p) AS incremental, p AS cached, (near AND p = a) OR (NOT near AND p = b) AS crosses FROM s")
def length_route_abundant(spark, d):
    x = D.length_route(F.col("total"), F.col("a"), F.col("b"), F.lit(19400), abundant=True)
    return _routed(spark, d).select("o", "l", x.alias("x")).select("o", "l", "x.*")


@query("prefill_race", f"{N}, w AS (SELECT region, arg_min(node_id, (latency_ms, seq)) AS w FROM nodes WHERE latency_ms <= 2500 GROUP BY region) SELECT c_custkey AS request_id, coalesce(w, 'local') AS winner FROM customer LEFT JOIN w ON w.region = c_nationkey")
def prefill_race(spark, d):
    requests = T.read(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("region"), F.lit("local").alias("local_node"))
    return D.race(requests, T.nodes(spark, d), 2500.0).select("request_id", "winner")


@query("reuse_or_recompute", f"WITH {S.LENGTHS}, n AS (SELECT length, count(*) AS n FROM lengths GROUP BY 1) SELECT length, n, round({S.kv('length')} * 8.388608::DOUBLE / 100, 6) AS retrieval, {S.kv('length')} * 8.388608::DOUBLE / 100 < {S.prefill('length')} AS cheaper FROM n")
def reuse_or_recompute(spark, d):
    rows = T.lengths(spark, d).groupBy("length").agg(F.count("*").alias("n"))
    kv = M.kv_size_mib(F.col("length"))
    return rows.select("length", "n", F.round(M.retrieval_seconds(kv), 6).alias("retrieval"), M.reuse_is_cheaper(F.col("length"), kv).alias("cheaper"))


# --- the throughput model

@query("kv_profile", f"WITH {S.LENGTHS}, n AS (SELECT DISTINCT length FROM lengths) SELECT length, {S.kv('length')} AS kv_mib, {S.prefill('length')} AS prefill, {S.kv('length')} * {S.GBIT} / {S.prefill('length')} AS gbps FROM n")
def kv_profile(spark, d):
    n = F.col("length")
    return T.lengths(spark, d).distinct().select(n, M.kv_size_mib(n).alias("kv_mib"), M.prefill_seconds(n).alias("prefill"), M.kv_gbps(n).alias("gbps"))


_TTFT_LOCAL, _TTFT_FAR = f"{S.prefill('length')} * 2.5::DOUBLE", f"{S.prefill('length')} + {S.kv('length')} * {S.GBIT} / 100"


@query("ttft_summary", f"WITH {S.LENGTHS}, t AS (SELECT CASE WHEN length <= 19400 THEN 'pd-p' ELSE 'offload' END AS target, CASE WHEN length <= 19400 THEN {_TTFT_LOCAL} ELSE {_TTFT_FAR} END AS t FROM lengths) SELECT target, round(avg(t), 6) AS mean, round(quantile_disc(t, 0.9), 6) AS p90 FROM t GROUP BY target")
def ttft_summary(spark, d):
    from fragloom.operators.workload import mean_and_p90

    target = F.when(F.col("length") <= 19400, "pd-p").otherwise("offload")
    rows = T.lengths(spark, d).select(target.alias("target"), M.first_token_seconds(F.col("length"), target).alias("t"))
    return mean_and_p90(rows, ["target"], "t").select("target", F.round("mean", 6).alias("mean"), F.round("p90", 6).alias("p90"))


_GRID = f"""{S.LENGTHS}, g AS (SELECT unnest(range(1024, 65537, 256)) AS threshold), n AS (SELECT length, count(*) AS n FROM lengths GROUP BY 1),
  st AS (SELECT threshold, sum(n) AS all_n, coalesce(sum(n) FILTER (length > threshold), 0) AS n_long, coalesce(sum(n * length) FILTER (length > threshold), 0) AS s_long, coalesce(sum(n * length) FILTER (length <= threshold), 0) AS s_short FROM g, n GROUP BY threshold),
  m AS (SELECT threshold, n_long / all_n AS fraction, CASE WHEN n_long = 0 THEN 0 ELSE s_long / n_long END AS mean_long, CASE WHEN n_long = all_n THEN 0 ELSE s_short / (all_n - n_long) END AS mean_short FROM st),
  l AS (SELECT *, CASE WHEN mean_long > 0 THEN round_even(mean_long, 0)::BIGINT ELSE threshold END AS ll, CASE WHEN mean_short > 0 THEN round_even(mean_short, 0)::BIGINT ELSE threshold END AS sl, unnest(range(1, 8)) AS n_p FROM m),
  r AS (SELECT *, 8 - n_p AS n_d, least(4.0::DOUBLE / {S.prefill('ll')}, 100.0::DOUBLE / ({S.kv('ll')} * {S.GBIT})) AS theta_offload, n_p::DOUBLE / ({S.prefill('sl')} * 2.5::DOUBLE) AS theta_local, (8 - n_p)::DOUBLE * 20 / (0.025::DOUBLE * 1024) AS theta_decode FROM l),
  e AS (SELECT *, least(CASE WHEN fraction <= 0 THEN 'inf'::DOUBLE ELSE theta_offload / fraction END, CASE WHEN fraction >= 1 THEN 'inf'::DOUBLE ELSE theta_local / (1.0::DOUBLE - fraction) END, theta_decode) AS rate FROM r),
  best AS (SELECT * FROM e ORDER BY rate DESC, threshold, n_p LIMIT 1)"""


@query("grid_search", f"WITH {_GRID} SELECT threshold, n_p, n_d, round(rate, 6) AS lambda_max, round(fraction, 6) AS fraction, round(mean_long, 3) AS mean_long, round(mean_short, 3) AS mean_short FROM best")
def grid_search(spark, d):
    return model.grid_search(T.lengths(spark, d)).select("threshold", "n_p", "n_d", F.round("lambda", 6).alias("lambda_max"), *[F.round(c, n).alias(c) for c, n in (("fraction", 6), ("mean_long", 3), ("mean_short", 3))])


@query("grid_surface", f"WITH {_GRID} SELECT threshold, n_p, round(rate, 6) AS rate, round(theta_offload, 6) AS theta_offload, round(theta_local, 6) AS theta_local FROM e")
def grid_surface(spark, d):
    """Every configuration's rate: 253 thresholds by 7 splits."""
    rows = model.threshold_stats(T.lengths(spark, d)).withColumn("n_p", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("n_d", 8 - F.col("n_p"))
    return model.with_stages(rows).select("threshold", "n_p", F.round("lambda", 6).alias("rate"), *[F.round(c, 6).alias(c) for c in ("theta_offload", "theta_local")])


_HOMOGENEOUS = f"mean AS (SELECT avg(length) AS mean, round_even(avg(length), 0)::BIGINT AS length FROM lengths), h AS (SELECT mean, length, n_p, 12 - n_p AS n_d, n_p / ({S.prefill('length')} * 2.5::DOUBLE) AS theta_local, (12 - n_p) * 20 / (0.025::DOUBLE * 1024) AS theta_decode FROM mean, range(1, 12) t(n_p)), hb AS (SELECT *, least(theta_local, theta_decode) AS rate FROM h ORDER BY rate DESC, n_p LIMIT 1)"
_NAIVE = f"nv AS (SELECT mean, length, least(4.0::DOUBLE / {S.prefill('length')}, 100.0::DOUBLE / ({S.kv('length')} * {S.GBIT})) AS theta_offload, 8 * 20 / (0.025::DOUBLE * 1024) AS theta_decode FROM mean)"


@query("homogeneous_pd", f"WITH {S.LENGTHS}, {_HOMOGENEOUS} SELECT n_p, n_d, round(rate, 6) AS lambda_max, length FROM hb")
def homogeneous_pd(spark, d):
    return model.homogeneous(T.lengths(spark, d)).select("n_p", "n_d", F.round("lambda", 6).alias("lambda_max"), "length")


@query("naive_pd", f"WITH {S.LENGTHS}, mean AS (SELECT avg(length) AS mean, round_even(avg(length), 0)::BIGINT AS length FROM lengths), {_NAIVE} SELECT round(least(theta_offload, theta_decode), 6) AS lambda_max, length FROM nv")
def naive_pd(spark, d):
    return model.naive(T.lengths(spark, d)).select(F.round("lambda", 6).alias("lambda_max"), "length")


_EGRESS = lambda lam, p, n: f"{lam} * {p} * {S.kv(n)} / {S.prefill(n)} * {S.GBIT}"


@query("simulate", f"""WITH {_GRID}, {_HOMOGENEOUS}, {_NAIVE}, t AS (SELECT CASE WHEN length <= threshold THEN {S.prefill('length')} * 2.5::DOUBLE ELSE {S.prefill('length')} + {S.kv('length')} * {S.GBIT} / 100 END AS t FROM (SELECT lengths.length, best.threshold FROM lengths, best)), tt AS (SELECT avg(t) AS mean_ttft, quantile_disc(t, 0.9) AS p90_ttft FROM t)
  SELECT 'selective' AS config_name, round(rate, 5) AS lambda_max, threshold, n_p, n_d, round(mean_ttft, 5) AS mean_ttft, round(p90_ttft, 5) AS p90_ttft, round({_EGRESS('rate', 'fraction', 'll')}, 5) AS bandwidth_gbps, round(fraction, 5) AS fraction FROM best, tt
  UNION ALL SELECT 'homogeneous', round(rate, 5), 0, n_p, n_d, round({_TTFT_LOCAL}, 5), round({_TTFT_LOCAL}, 5), 0, 0 FROM hb
  UNION ALL SELECT 'naive', round(least(theta_offload, theta_decode), 5), 0, 0, 8, round({_TTFT_FAR}, 5), round({_TTFT_FAR}, 5), round({_EGRESS('least(theta_offload, theta_decode)', '1.0::DOUBLE', 'length')}, 5), 1 FROM nv""")
def simulate(spark, d):
    rows = model.simulate(T.lengths(spark, d))
    return rows.select("config_name", F.round("lambda_max", 5).alias("lambda_max"), "threshold", "n_p", "n_d", *[F.round(c, 5).alias(c) for c in ("mean_ttft", "p90_ttft", "bandwidth_gbps", "fraction")])


_UNIFORM = "((('0x' || substr(md5('42:' || o_orderkey || ':' || i), {0}, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)"
_DRAW = f"floor(exp(9.9::DOUBLE + sqrt(-2.0::DOUBLE * ln({_UNIFORM.format(1)})) * cos(2.0::DOUBLE * pi() * {_UNIFORM.format(17)})))::BIGINT"


@query("random_lengths", f"WITH x AS (SELECT o_orderkey, i, {_DRAW} AS length FROM orders, range(0, 8) t(i)) SELECT o_orderkey, coalesce(arg_min(length, i) FILTER (length BETWEEN 128 AND 131072), greatest(128, least(131072, arg_min(length, i)))) AS length FROM x GROUP BY 1")
def random_lengths(spark, d):
    """A log-normal request length for each order."""
    return T.random_lengths(T.read(spark, d, "orders").select("o_orderkey"), "o_orderkey")


# --- reconstruction

_PREFIX = f"{S.PROMPTS}, p AS (SELECT *, greatest(1, len(tokens) // 128) AS step FROM prompts WHERE len(tokens) > 0)"
_STORED = f"st AS (SELECT DISTINCT model_id, {S.tuple_hash('tokens[1:48]')} AS content_hash FROM prompts WHERE prompt_id % 3 <> 0 AND len(tokens) > 0)"


def _stored_prefixes(spark, d):
    from fragloom.functions.hashing import tuple_hash

    rows = T.prompts(spark, d).where("prompt_id % 3 != 0")
    held = rows.select("model_id", tuple_hash(F.slice("tokens", 1, 48)).alias("content_hash"), F.least(F.size("tokens"), F.lit(48)).alias("n")).distinct()
    # cut first, as a filter would make the tokens once more, and each of the two uses would make them again
    return cut(held).where("n > 0 and content_hash is not null")


@query("longest_prefix", f"WITH {S.PROMPTS}, {_STORED}, x AS (SELECT prompt_id, model_id, n, {S.tuple_hash('tokens[1:n]')} AS content_hash FROM (SELECT *, unnest(range(len(tokens), 0, -1)) AS n FROM prompts)) SELECT prompt_id, max(n)::INT AS n, arg_max(content_hash, n) AS content_hash FROM x JOIN st USING (content_hash, model_id) GROUP BY prompt_id")
def longest_prefix(spark, d):
    return R.longest_prefix(T.prompts(spark, d), _stored_prefixes(spark, d))


@query("optimal_nodes", f"""WITH {_PREFIX}, n AS (SELECT s_name AS node_id, s_suppkey AS seq, (s_suppkey * 3 % 4) / 40 AS load FROM supplier WHERE s_suppkey < 10), x AS (SELECT DISTINCT prompt_id, {S.tuple_hash('tokens[1:n]')} AS content_hash FROM (SELECT *, unnest(range(1, len(tokens) + 1, step)) AS n FROM p)),
  h AS (SELECT DISTINCT content_hash, (SELECT s_name FROM supplier WHERE s_suppkey = prompt_id % 10) AS node_id FROM x WHERE prompt_id % 2 = 0), sc AS (SELECT x.prompt_id, n.node_id, n.seq, greatest(0, count(*) - floor(load * 10)::BIGINT) AS score FROM x JOIN h USING (content_hash) JOIN n USING (node_id) GROUP BY x.prompt_id, n.node_id, n.seq, load)
  SELECT prompt_id, node_id, score, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, seq) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 3""")
def optimal_nodes(spark, d):
    prompts = T.prompts(spark, d)
    names = T.read(spark, d, "supplier").where("s_suppkey < 10").select(F.col("s_name").alias("node_id"), F.col("s_suppkey").alias("seq"))
    held = R.prefix_hashes(prompts.where("prompt_id % 2 = 0"), ascending=True).select("content_hash", (F.col("prompt_id") % 10).alias("seq")).distinct()
    holders = held.join(F.broadcast(names), "seq").select("content_hash", "node_id")
    loads = names.withColumn("load", F.col("seq") * 3 % 4 / 40)
    return R.best_nodes(prompts, holders, loads)


@query("reconstruct", f"""WITH RECURSIVE {_PREFIX}, {S.windows(48)}, size AS (SELECT prompt_id, model_id, len(tokens) AS length FROM prompts),
  x AS (SELECT prompt_id, model_id, n, {S.tuple_hash('tokens[1:n]')} AS content_hash FROM (SELECT *, unnest(range(len(tokens), 0, -step)) AS n FROM p) WHERE n <= 48),
  hit AS (SELECT x.prompt_id, min({{'less': -n, 's': token_start, 'e': token_end}}) AS h FROM x JOIN win ON win.content_hash = x.content_hash AND win.model_id = x.model_id AND win.prompt_id <> x.prompt_id GROUP BY 1),
  spans AS (SELECT model_id, token_start, token_end, prompt_id AS owner, min(content_hash) AS content_hash FROM win GROUP BY model_id, token_start, token_end, prompt_id QUALIFY row_number() OVER (PARTITION BY model_id, token_start, token_end ORDER BY min(content_hash), prompt_id) <= 2),
  walk AS (SELECT size.prompt_id, model_id, length, CASE WHEN h.e IS NULL THEN -1 ELSE least(h.e, length - 1) END::BIGINT AS stop, h.s::BIGINT AS s FROM size LEFT JOIN hit ON hit.prompt_id = size.prompt_id AND h.s < length
    UNION ALL SELECT prompt_id, model_id, length, x.e::BIGINT, x.s::BIGINT FROM (SELECT w.prompt_id, w.model_id, w.length, min({{'s': token_start, 'h': content_hash, 'e': token_end}}) AS x
      FROM walk w JOIN spans v ON v.model_id = w.model_id AND v.token_start > w.stop AND v.token_start <= w.stop + 256 AND v.token_end < w.length AND v.owner <> w.prompt_id GROUP BY 1, 2, 3)),
  iv AS (SELECT prompt_id, length, s AS a, stop AS b FROM walk WHERE s IS NOT NULL UNION ALL SELECT prompt_id, length, length, length FROM size),
  m AS (SELECT prompt_id, length, a, coalesce(max(b) OVER (PARTITION BY prompt_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 AS open FROM iv),
  g AS (SELECT prompt_id, length, coalesce(sum(a - open) FILTER (open < a), 0)::BIGINT AS missing, count(*) FILTER (open < a) AS gaps, count(*) FILTER (a - open > 256) AS prefilled FROM m GROUP BY 1, 2)
  SELECT prompt_id, length, length - missing AS covered, round(CASE WHEN length > 0 THEN (length - missing) / length ELSE 1 END, 6) AS ratio, gaps, prefilled FROM g""")
def reconstruct(spark, d):
    """Context of each prompt rebuilt from the windows of its model's other prompts: the longest stored prefix, what
    follows it, coverage and missing stretches."""
    prompts = T.prompts(spark, d)
    stored = cut(W.token_windows(prompts, 48).select("prompt_id", "model_id", "token_start", "token_end", "content_hash"))
    sizes = T.prompt_sizes(spark, d)
    first = R.prefix_fragments(prompts, stored, owner="prompt_id")
    begun = sizes.join(first, "prompt_id", "left").withColumn("within", F.coalesce(F.col("token_start") < F.col("length"), F.lit(False)))
    ends = begun.select("prompt_id", "model_id", "length", F.when(F.col("within"), F.least("token_end", F.col("length") - 1)).otherwise(-1).alias("at"))
    spans = R.extend(stored, ends, owner="prompt_id").union(begun.where("within").select("prompt_id", "token_start", "token_end", "content_hash"))
    got, missing = R.coverage(sizes, cut(spans))
    holes = missing.groupBy("prompt_id").agg(F.count("*").alias("gaps"), F.count_if("prefill").alias("prefilled"))
    return got.join(holes, "prompt_id", "left").select("prompt_id", "length", "covered", F.round("ratio", 6).alias("ratio"), F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("prefilled", F.lit(0)).alias("prefilled"))
