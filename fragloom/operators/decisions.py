"""Routing, placement, promotion and role decisions as column expressions and argmin aggregates.

Candidates carry `seq`, their order of registration, which breaks ties. Missing telemetry costs infinity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragloom.functions.throughput import prefill_seconds

MAX_LATENCY, HEALTH, SHORT_PROMPT, BUSY = 5000.0, 0.95, 512, 0.8


def infinite() -> Column:
    return F.lit(float("inf"))


def telemetry_cost(max_latency: float = MAX_LATENCY) -> Column:
    """Sum of the four loads, each at most 1."""
    parts = [F.col("latency_ms") / max_latency, F.col("bandwidth_cost"), F.col("gpu_load"), F.col("memory_pressure")]
    total = sum((F.least(F.lit(1.0), p) for p in parts[1:]), F.least(F.lit(1.0), parts[0]))
    return F.coalesce(total, infinite())


def is_healthy(max_latency: float = MAX_LATENCY, most: float = HEALTH) -> Column:
    return (F.col("gpu_load") <= most) & (F.col("memory_pressure") <= most) & (F.col("bandwidth_cost") <= most) & (F.col("latency_ms") / max_latency <= most)


def argmin(rows: DataFrame, group: list[str], score: Column, name: str = "node_id") -> DataFrame:
    """group with the name of the smallest score, the earliest seq among equals, and that score."""
    return rows.withColumn("_score", score).groupBy(*group).agg(F.min_by(name, F.struct("_score", "seq")).alias(name), F.min("_score").alias("score"))


def economic_route(fragments: DataFrame, nodes: DataFrame, group: str = "region") -> DataFrame:
    """Each fragment (content_hash, value, region) to the candidate of its region with the largest value less cost.

    The value is the same for all candidates, so each region's cheapest node is found once."""
    cheapest = argmin(nodes, [group], telemetry_cost())
    return fragments.join(cheapest, group).select("content_hash", group, "node_id", (F.col("value") - F.col("score")).alias("net_value"))


def select_nodes(nodes: DataFrame, group: str, n: int = 3) -> DataFrame:
    """The n cheapest healthy nodes of each group."""
    from fragloom.operators.joins import best

    return best(nodes.where(is_healthy()).withColumn("score", telemetry_cost()), [group], [F.col("score"), F.col("seq")], n)


def latency_route(requests: DataFrame, holders: DataFrame, latencies: DataFrame) -> DataFrame:
    """requests (content_hash, local_node) with `target`: local if it holds the hash, else the nearest holder, else local."""
    local = holders.select("content_hash", F.col("node_id").alias("local_node"), F.lit(True).alias("_here"))
    timed = holders.join(latencies.select("node_id", "latency_ms", "seq"), "node_id", "left").withColumn("latency_ms", F.coalesce("latency_ms", infinite())).withColumn("seq", F.coalesce("seq", F.lit(2**62)))
    nearest = argmin(timed, ["content_hash"], F.col("latency_ms")).select("content_hash", F.col("node_id").alias("_near"))
    out = requests.join(local, ["content_hash", "local_node"], "left").join(nearest, "content_hash", "left")
    return out.withColumn("target", F.when(F.col("_here"), F.col("local_node")).otherwise(F.coalesce("_near", "local_node"))).drop("_here", "_near")


def joint_placement(nodes: DataFrame, group: str) -> DataFrame:
    """group with compute_node, memory_node and the compute node's latency in seconds.

    A compute node loaded above BUSY leaves memory to the best other node."""
    score = F.coalesce(F.col("gpu_load") + F.col("latency_ms") / 1000.0, infinite())
    memory = F.coalesce(F.col("memory_pressure"), infinite())
    compute = nodes.withColumn("_s", score).groupBy(group).agg(F.min_by(F.struct("node_id", "load", "latency_ms"), F.struct("_s", "seq")).alias("c"))
    ranked = nodes.select(group, F.struct(memory.alias("m"), "seq", "node_id").alias("m")).groupBy(group).agg(F.array_sort(F.collect_list("m")).alias("ms"))
    first = F.col("ms")[0]["node_id"]
    second = F.get("ms", F.lit(1))["node_id"]
    node = F.when((first == F.col("c.node_id")) & (F.col("c.load") > BUSY), F.coalesce(second, first)).otherwise(first)
    return compute.join(ranked, group).select(group, F.col("c.node_id").alias("compute_node"), node.alias("memory_node"), (F.coalesce("c.latency_ms", F.lit(0.0)) / 1000.0).alias("latency_seconds"))


def offload(requests: DataFrame, candidates: DataFrame, scale: float = 1.0) -> DataFrame:
    """requests (request_id, length, local_node, local_load) with target_node, local_compute, cost and reason.

    The remote score cost * load + 1 / (1 - load + 0.01) depends on the length, so each length is scored once."""
    cost = prefill_seconds(F.col("length"), scale)
    lengths = requests.select("length").distinct()
    score = cost * F.col("load") + 1.0 / (1.0 - F.col("load") + 0.01)
    chosen = argmin(lengths.join(F.broadcast(candidates.select("node_id", "load", "seq"))), ["length"], score).select("length", F.col("node_id").alias("_best"))
    out = requests.join(chosen, "length", "left")
    local = (F.col("length") <= SHORT_PROMPT) & (F.col("local_load") < BUSY)
    reason = F.when(local, "short prompt and low local load").when(F.col("_best").isNull(), "no candidate nodes available").otherwise("offloaded to lower-load node")
    stays = local | F.col("_best").isNull()
    return out.select("request_id", "length", F.when(stays, F.col("local_node")).otherwise(F.col("_best")).alias("target_node"), stays.alias("local_compute"), cost.alias("cost_seconds"), reason.alias("reason"))


def promotion(fragments: DataFrame, demand: DataFrame, replicas: DataFrame, least_reuse: float = 0.7, least_demand: int = 3, most: int = 3) -> DataFrame:
    """fragments (content_hash, reuse_score) with promote, targets and reason; demand (content_hash, region, n), replicas (content_hash, region)."""
    asked = demand.groupBy("content_hash").agg(F.sum("n").alias("total"), F.collect_list(F.struct((-F.col("n")).alias("o"), "region", "n")).alias("regions"))
    held = replicas.groupBy("content_hash").agg(F.collect_set("region").alias("held"))
    rows = fragments.join(asked, "content_hash", "left").join(held, "content_hash", "left")
    have = F.coalesce("held", F.array().cast("array<string>"))
    open_regions = F.transform(F.filter(F.array_sort("regions"), lambda r: ~F.array_contains(have, r["region"]) & (r["n"] > 0)), lambda r: r["region"])
    slots = F.greatest(F.lit(0), F.lit(most) - F.size(have))
    targets = F.slice(F.coalesce(open_regions, F.array().cast("array<string>")), F.lit(1), slots)
    reason = (
        F.when(F.col("reuse_score") < least_reuse, "reuse_score below threshold").when(F.coalesce("total", F.lit(0)) < least_demand, "demand below threshold")
        .when(F.size(have) >= most, "max replicas reached").when(F.size(targets) == 0, "no suitable regions").otherwise("high reuse and multi-region demand")
    )
    yes = reason == "high reuse and multi-region demand"
    return rows.select("content_hash", yes.alias("promote"), F.when(yes, targets).otherwise(F.array().cast("array<string>")).alias("targets"), reason.alias("reason"))


def node_role(load: Column, gpu: Column, compute_demand: Column, memory_demand: Column) -> Column:
    return F.when((load < 0.3) & (gpu > 0.7), "prefill_worker").when((load > 0.7) & (gpu < 0.3), "memory_host").when(compute_demand > memory_demand, "decode_worker").otherwise("memory_host")


def can_share(model_id: Column, reuse: Column, tenant_a: Column, tenant_b: Column, prefixes: bool = True, tools: bool = True, artifacts: bool = True, least: float = 0.6) -> Column:
    barred = [k for k, ok in (("prefix", prefixes), ("tool", tools), ("artifact", artifacts)) if not ok]
    return (tenant_a == tenant_b) | ((reuse >= least) & (~model_id.isin(barred) if barred else F.lit(True)))


def length_route(total: Column, offload_prefix: Column, local_prefix: Column, threshold: Column, abundant: bool = False) -> Column:
    """struct(target, incremental, cached, crosses): where a request is prefilled."""
    made = lambda target, left, cached, crosses: F.struct(target.alias("target"), F.greatest(F.lit(0), left).alias("incremental"), cached.alias("cached"), crosses.alias("crosses"))
    if abundant:
        prefix = F.greatest(offload_prefix, local_prefix)
        target = F.when(total - prefix <= threshold, "pd-p").otherwise("offload")
        return made(target, total - prefix, prefix, ((target == "pd-p") & (prefix == offload_prefix)) | ((target == "offload") & (prefix == local_prefix)))
    local = total - local_prefix <= threshold
    return made(F.when(local, "pd-p").otherwise("offload"), F.when(local, total - local_prefix).otherwise(total - offload_prefix), F.when(local, local_prefix).otherwise(offload_prefix), F.lit(False))


def race(requests: DataFrame, candidates: DataFrame, timeout_ms: float = 5000.0) -> DataFrame:
    """requests (request_id, region, local_node) with `winner`: the first candidate to answer within the timeout, else the local node."""
    first = argmin(candidates.where(F.col("latency_ms") <= timeout_ms), ["region"], F.col("latency_ms")).select("region", F.col("node_id").alias("_w"))
    return requests.join(first, "region", "left").withColumn("winner", F.coalesce("_w", "local_node")).drop("_w")
