"""Nearest neighbours by cosine and leader clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.functions.hashing import norm
from fragloom.operators.joins import best
from fragloom.sources.checkpoints import cut, shared_path

#: Queries and rows that are scored at once: 4 MB of scores.
TILE_QUERIES, TILE_ROWS = 512, 1024


def top_neighbours(rows: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, score): each query's k largest cosines over all rows (vec_id, embedding); ties by vec_id.

    A stated query set goes over the rows in blocks: each task holds `block` queries at most as a matrix and scores them
    in tiles of TILE_QUERIES by TILE_ROWS. A row that scores below a query's k-th best of the tiles before cannot be
    among its k best; the others, ties included, meet in the ranking. Zero vectors score 0."""
    unit = lambda c: F.transform(c, lambda v: v / norm(c))
    asked = queries.select(F.col("vec_id").alias("query_id"), unit(F.col("embedding")).alias("q"))
    n = asked.count()
    blocks = max(1, -(-n // block))
    dealt = asked.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    base = rows.select("vec_id", unit(F.col("embedding")).alias("v"))
    parts = []
    for b in range(blocks):
        held = dealt.where(F.col("_b") == b).select("query_id", "q").collect()
        if not held:
            continue
        ids, matrix = np.array([r.query_id for r in held]), np.array([r.q for r in held])

        def score(batches, ids=ids, matrix=matrix):
            least = np.full(len(ids), -np.inf)  # each query's k-th best so far in this task
            for batch in batches:
                for low in range(0, batch.num_rows, TILE_ROWS):
                    part = batch.slice(low, TILE_ROWS)
                    names = part.column(0).to_numpy(zero_copy_only=False)
                    vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1).T
                    for first in range(0, len(ids), TILE_QUERIES):
                        to = slice(first, first + TILE_QUERIES)
                        sims = matrix[to] @ vectors
                        if sims.shape[1] >= k:
                            least[to] = np.maximum(least[to], np.partition(sims, -k, axis=1)[:, -k])
                        at, row = np.nonzero(sims >= least[to][:, None])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[first + at], pa.int64()), pa.array(names[row], pa.int64()), pa.array(sims[at, row], pa.float64())], ["query_id", "vec_id", "score"])

        parts.append(base.mapInArrow(score, "query_id long, vec_id long, score double"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return best(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)


def first_leaders(v: np.ndarray, threshold: float) -> np.ndarray:
    """For unit vectors in order: the place of the first leader that takes each; those that none takes lead themselves."""
    lead, held = np.arange(len(v)), np.zeros(0, np.int64)
    for low in range(0, len(v), TILE_QUERIES):
        part = v[low : low + TILE_QUERIES]
        taken, by = first_taker(part, v[held], threshold)
        lead[low : low + len(part)][taken] = held[by[taken]]
        alike, new = np.round(part @ part.T, 12) >= threshold, []
        for i in range(len(part)):
            if not taken[i]:
                mine = np.flatnonzero(alike[i, i:] & ~taken[i:]) + i
                taken[mine], lead[low + mine] = True, low + i
                new.append(low + i)
        held = np.append(held, np.array(new, np.int64))
    return lead


def first_taker(v: np.ndarray, leaders: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(taken, place of the first leader that takes it) for each of v, scored in tiles."""
    taken, by = np.zeros(len(v), bool), np.zeros(len(v), np.int64)
    for at in range(0, len(leaders), TILE_ROWS):
        for low in range(0, len(v), TILE_QUERIES):
            left = np.flatnonzero(~taken[low : low + TILE_QUERIES]) + low
            sims = v[left] @ leaders[at : at + TILE_ROWS].T
            some = (sims >= threshold - 1e-9).any(axis=1)  # few are near enough to be rounded
            left, fits = left[some], np.round(sims[some], 12) >= threshold
            hit = fits.any(axis=1)
            taken[left[hit]], by[left[hit]] = True, at + fits[hit].argmax(axis=1)
    return taken, by


def leader_clusters(rows: DataFrame, key: str, threshold: float = 0.95, block: int = 16384) -> DataFrame:
    """(key, vec_id, leader): the first unassigned vector of a key leads; others join it at a cosine of `threshold` or
    more (to 12 places). Keys are the caller's partition of the vectors; each is taken in order of vec_id.

    A key of `block` rows at most is settled in one task. The rows of larger keys are laid out in order and taken in
    rounds: the next rows meet all leaders so far, in groups of about `block` rows by `block` leaders at most; of those
    that none takes, the first `block` at most are settled, a key in a task. Where leaders take most rows, the next
    round takes more. Rows and leaders lie in the checkpoint folder, each written once; only counts reach the driver.
    Rows without a key, id or vector take no part; a zero vector leads itself."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)[key]
    length = norm(F.col("embedding"))
    lengths = F.array_repeat(F.when(length == 0, 1.0).otherwise(length), F.size("embedding"))  # in a lambda it would be made once a component
    unit = F.zip_with("embedding", lengths, lambda v, n: v / n)
    given = rows.where(F.col(key).isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    given = given.select(F.col(key).alias("k"), F.col("vec_id").cast("long").alias("vec_id"), unit.alias("v"))
    large = cut(given.groupBy("k").count().where(F.col("count") > block).select("k"))
    shape = f"k {kind}, at long, vec_id long, leader long, v array<double>"  # v only of leaders

    def settle(pdf):
        v, ids = np.stack(pdf["v"].to_numpy()), pdf["vec_id"].to_numpy()
        order = np.lexsort((*v.T[::-1], ids)) if len(set(ids)) < len(ids) else np.argsort(ids)
        lead = np.empty(len(ids), np.int64)
        lead[order] = order[first_leaders(v[order], threshold)]
        return pdf.assign(leader=ids[lead], v=[x if i == at else None for i, (at, x) in enumerate(zip(lead, pdf["v"]))])

    def meet(pdf, leads):
        leads = leads.sort_values("at")
        if len(pdf) and len(leads):
            taken, by = first_taker(np.stack(pdf["v"].to_numpy()), np.stack(leads["v"].to_numpy()), threshold)
        else:
            taken, by = np.zeros(len(pdf), bool), np.zeros(len(pdf), np.int64)
        by = by[taken]
        return pdf[taken].assign(leader=leads["vec_id"].to_numpy()[by], first=leads["at"].to_numpy()[by])[["k", "at", "vec_id", "leader", "first"]]

    none = large.isEmpty()
    small = given if none else given.join(F.broadcast(large), "k", "left_anti")  # a row for `block` given ones at most
    out = small.groupBy("k").applyInPandas(lambda pdf: settle(pdf)[["k", "vec_id", "leader"]], f"k {kind}, vec_id long, leader long").withColumnRenamed("k", key)
    if none:
        return out
    place = shared_path(spark, "leaders")
    laid = given.join(F.broadcast(large), "k", "left_semi").repartitionByRange("vec_id", "k").sortWithinPartitions("vec_id", "k", "v")
    laid.withColumn("at", F.monotonically_increasing_id()).withColumn("p", F.shiftright("at", 33)).write.partitionBy("p").parquet(f"{place}/rows")
    laid = spark.read.schema(f"k {kind}, vec_id long, v array<double>, at long, p long").parquet(f"{place}/rows")
    few = 2 * spark.sparkContext.defaultParallelism  # tasks that read leaders, whatever their number
    settled = lambda: spark.read.schema(shape).parquet(f"{place}/settled")
    width = 1 << max(0, (block // 8).bit_length() - 1)  # rows are counted by stretches of so many places
    counted = lambda df: {r[0]: r[1] for r in df.groupBy(F.expr(f"at div {width}")).count().collect()}

    def reach(sizes, most):
        """How many of the stretches, one at least, hold `most` rows together."""
        return max(1, int(np.searchsorted(np.cumsum(sizes), most, "right")))

    todo, step, leaders = sorted(counted(laid).items()), block, 0  # leaders: at most so many so far
    while todo:
        part = todo[: reach([n for _, n in todo], step)]
        low, high = part[0][0] * width, (part[-1][0] + 1) * width - 1
        now, taken = laid.where(F.col("p").between(low >> 33, high >> 33) & F.col("at").between(low, high)).drop("p"), None
        free = total = sum(n for _, n in part)
        if leaders:
            parts = -(-total // block), max(-(-leaders // block), min(-(-leaders // 1024), spark.sparkContext.defaultParallelism))
            own = [F.pmod(F.xxhash64("at"), F.lit(p)).cast("long") for p in parts]
            each = [F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p - 1).cast("long"))) for p in parts]
            asked = now.withColumn("a", own[0]).withColumn("b", each[1]).groupBy("k", "a", "b")
            asking = settled().where("v is not null").select("k", "at", "vec_id", "v").coalesce(few).withColumn("b", own[1]).withColumn("a", each[0]).groupBy("k", "a", "b")
            met = asked.cogroup(asking).applyInPandas(meet, f"k {kind}, at long, vec_id long, leader long, first long")
            met = met.groupBy("at").agg(F.min(F.struct("first", "k", "vec_id", "leader")).alias("f"))
            taken = cut(met.select("f.k", "at", "f.vec_id", "f.leader", F.lit(None).cast("array<double>").alias("v")))
            now = now.join(taken, "at", "left_anti")
            left = counted(now)
            free = [left.get(w, 0) for w, _ in part]
            step = max(block, min(4 * step, int(0.9 * block * total / max(1, sum(free)))))
            part = part[: reach(free, block)]
            free = sum(free[: len(part)])
        within = F.col("at") < (part[-1][0] + 1) * width
        done = now.where(within).withColumn("leader", F.lit(0).cast("long")).select("k", "at", "vec_id", "leader", "v").groupBy("k").applyInPandas(settle, shape)
        (done.union(taken.where(within)) if taken is not None else done).write.mode("append").parquet(f"{place}/settled")
        todo, leaders = todo[len(part) :], leaders + free
    return out.union(settled().select("k", "vec_id", "leader"))
