"""Consistent hashing: ring points, owners and replicas of keys, and what moves when nodes change.

The ring is a table of some hundred points a node, known from the node list alone; a key's owner is the next point
clockwise. Points and keys are cut into arcs by the leading hex digits of their hashes, so that keys meet only the
points of their arc (and the arc's successor, added as its last point) and no global sort is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINTS, DIGITS = 150, 2


def ring_points(nodes: DataFrame, points: int = POINTS) -> DataFrame:
    """(point, node_id): the virtual points md5("node:i")."""
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    return nodes.select("node_id", i).select(F.md5(F.concat_ws(":", "node_id", F.col("i").cast("string"))).alias("point"), "node_id")


def successor_lists(ring: DataFrame, n: int) -> DataFrame:
    """(point, owners): for each point the first n different nodes clockwise from it, wrapping once.

    Fixed by the node list (points times nodes rows), never by the data."""
    twice = ring.withColumn("turn", F.lit(0)).union(ring.withColumn("turn", F.lit(1)))
    # the next place of each node at or after a point, then the n nearest nodes
    nodes = ring.select("node_id").distinct()
    numbered = twice.withColumn("place", F.row_number().over(Window.orderBy("turn", "point")))
    grid = numbered.where("turn = 0").select("point", "place").join(nodes)
    own = numbered.select(F.col("node_id"), F.col("place").alias("at"))
    ahead = grid.join(own, "node_id").where(F.col("at") >= F.col("place")).groupBy("point", "node_id").agg(F.min("at").alias("at"))
    return ahead.groupBy("point").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "node_id"))), lambda x: x["node_id"]), 1, n).alias("owners"))


def owners(keys: DataFrame, nodes: DataFrame, n: int = 1, points: int = POINTS, digits: int = DIGITS) -> DataFrame:
    """keys (content_hash, ...) with `owners`: the first n different nodes clockwise from md5(content_hash)."""
    ring = ring_points(nodes, points)
    lists = successor_lists(ring, n) if n > 1 else ring.groupBy("point").agg(F.min("node_id").alias("o")).select("point", F.array("o").alias("owners"))
    arcs = keys.sparkSession.range(16**digits).select(F.lower(F.lpad(F.hex("id"), digits, "0")).alias("arc"))
    # an arc's last candidate is the first point of any later arc, or the ring's first point
    minima = lists.groupBy(F.substring("point", 1, digits).alias("arc")).agg(F.min(F.struct("point", "owners")).alias("least"))
    later = Window.orderBy("arc").rowsBetween(1, Window.unboundedFollowing)  # over the 16^digits arcs
    every = Window.partitionBy(F.lit(0))
    ahead = arcs.join(minima, "arc", "left").select("arc", F.first("least", ignorenulls=True).over(later).alias("next"), F.min("least").over(every).alias("first"))
    last = ahead.select("arc", F.coalesce(F.col("next")["owners"], F.col("first")["owners"]).alias("beyond"))
    held = lists.groupBy(F.substring("point", 1, digits).alias("arc")).agg(F.array_sort(F.collect_list(F.struct("point", "owners"))).alias("points"))
    table = last.join(held, "arc", "left")
    placed = keys.withColumn("key", F.md5("content_hash")).withColumn("arc", F.substring("key", 1, digits)).join(F.broadcast(table), "arc")
    here = F.filter("points", lambda p: p["point"] >= F.col("key"))
    return placed.withColumn("owners", F.coalesce(F.get(here, F.lit(0))["owners"], F.col("beyond"))).drop("key", "arc", "points", "beyond")


def placement(keys: DataFrame, nodes: DataFrame, replicas: int = 2) -> DataFrame:
    """keys with primary and the replicas that follow it."""
    return owners(keys, nodes, replicas + 1).withColumn("primary", F.col("owners")[0]).withColumn("replicas", F.slice("owners", 2, replicas)).drop("owners")


def replica_shards(placed: DataFrame) -> DataFrame:
    """(node_id, content_hash) of placed keys: what each node holds as a replica."""
    return placed.select(F.explode("replicas").alias("node_id"), "content_hash")


def migrations(keys: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(content_hash, old_node, new_node) for keys whose primary changes from one node list to the other."""
    old = owners(keys.select("content_hash"), before).select("content_hash", F.col("owners")[0].alias("old_node"))
    new = owners(keys.select("content_hash"), after).select("content_hash", F.col("owners")[0].alias("new_node"))
    return old.join(new, "content_hash").where("old_node <> new_node")
