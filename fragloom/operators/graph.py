"""Co-access and typed weighted graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragloom.sources.checkpoints import cut


def next_edges(accessed: DataFrame) -> DataFrame:
    """(src, dst, edge_type, weight): consecutive accesses of a session; weight is the share of the source's successors."""
    follow = F.lead("content_hash").over(Window.partitionBy("session_id").orderBy("seq"))
    pairs = accessed.select(F.col("content_hash").alias("src"), follow.alias("dst")).where("dst is not null and src <> dst")
    counted = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = counted.groupBy("src").agg(F.sum("n").alias("all"))
    return counted.join(total, "src").select("src", "dst", F.lit("next").alias("edge_type"), (F.col("n") / F.col("all")).alias("weight"))


def batch_pairs(requests: DataFrame, request: str = "request_id") -> DataFrame:
    """(a, b): unordered pairs of different hashes of one request, each once. Requests are bounded by their maker."""
    one = requests.select(request, "content_hash").distinct()
    other = one.withColumnRenamed("content_hash", "b")
    return one.withColumnRenamed("content_hash", "a").join(other, request).where("a < b").select("a", "b").distinct()


def neighbours(edges: DataFrame, least: float | None = None, edge_type: str | None = None) -> DataFrame:
    """(src, dst): out-neighbours, with a weight of at least `least`, of one type or of all."""
    rows = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    rows = rows if least is None else rows.where(F.col("weight") >= least)
    return rows.select("src", "dst").distinct()


def without_node(edges: DataFrame, gone: DataFrame) -> DataFrame:
    g = gone.select("content_hash").distinct()
    return edges.join(g, edges["src"] == g["content_hash"], "left_anti").join(g, edges["dst"] == g["content_hash"], "left_anti")


def weights_of(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (src, dst) with their weight, 0 where there is no edge."""
    return pairs.join(edges.groupBy("src", "dst").agg(F.max("weight").alias("weight")), ["src", "dst"], "left").fillna(0.0, ["weight"])


def components(seeds: DataFrame, edges: DataFrame, least: float = 0.5, depth: int = 3) -> DataFrame:
    """(seed, node): what each seed reaches within `depth` steps along out-edges of weight `least` or more, itself included.

    A seed that is no node of the graph reaches nothing. All seeds advance together; one join a step."""
    edges = cut(edges.select("src", "dst", "weight"))
    strong = neighbours(edges, least)
    known = edges.select(F.col("src").alias("seed")).union(edges.select("dst")).distinct()
    reached = seeds.select("seed").distinct().join(known, "seed", "left_semi").select("seed", F.col("seed").alias("node"))
    for _ in range(depth):  # few steps over cut edges: exchanges are reused, and distinct keeps the walk a set
        step = reached.join(strong, reached["node"] == strong["src"]).select("seed", F.col("dst").alias("node"))
        reached = reached.union(step).distinct()
    return reached


def disjoint(reached: DataFrame) -> DataFrame:
    """The rows of reached (seed, node) whose seed is kept: seeds go in order, and one that a kept earlier one reaches is
    skipped. Each round settles the seeds that no unsettled earlier one reaches, at least the first of all."""
    reached = cut(reached)
    seeds = reached.select("seed").distinct()
    earlier = cut(reached.where("seed < node").join(seeds.withColumnRenamed("seed", "node"), "node", "left_semi").select(F.col("seed").alias("by"), F.col("node").alias("seed")))
    state = cut(seeds.withColumn("kept", F.lit(None).cast("boolean")))
    while not state.where("kept is null").isEmpty():
        near = earlier.join(state.withColumnRenamed("seed", "by"), "by").groupBy("seed").agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.bool_or(F.col("kept").isNull()).alias("waits"))
        ruled = F.when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True)
        state = cut(state.join(near, "seed", "left").select("seed", F.coalesce("kept", ruled).alias("kept")))
    return reached.join(state.where("kept").select("seed"), "seed")


def ancestors(versions: DataFrame, depth: int) -> DataFrame:
    """(version_id, ancestor, steps): each version's own path of parents, itself at 0 steps."""
    paths = versions.select("version_id", F.col("version_id").alias("ancestor"), F.lit(0).alias("steps"), F.col("parent_version").alias("_next"))
    parents = versions.select(F.col("version_id").alias("_next"), F.col("parent_version").alias("_up"))
    out, at = paths, paths
    for i in range(depth):
        at = at.where("_next is not null").join(parents, "_next", "left").select("version_id", F.col("_next").alias("ancestor"), F.lit(i + 1).alias("steps"), F.col("_up").alias("_next"))
        out = out.union(at)
    return out.drop("_next")


def common_ancestor(pairs: DataFrame, versions: DataFrame, depth: int) -> DataFrame:
    """pairs (v1, v2) with `ancestor`: the first id of v2's path that lies on v1's path, null if none."""
    up = ancestors(versions, depth)
    one = up.select(F.col("version_id").alias("v1"), "ancestor")
    two = up.select(F.col("version_id").alias("v2"), "ancestor", "steps")
    met = pairs.join(two, "v2").join(one, ["v1", "ancestor"]).groupBy("v1", "v2").agg(F.min_by("ancestor", "steps").alias("ancestor"))
    return pairs.join(met, ["v1", "v2"], "left")


def replicate(component: DataFrame, source: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, content_hash): what each target receives of a component that the source holds."""
    held = component.select("content_hash").distinct().join(source.select("content_hash").distinct(), "content_hash", "left_semi")
    return held.join(F.broadcast(targets.select(F.col("node_id").alias("target")).distinct()))
