"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search over it.

Equal vectors are one node (it answers for all its ids), so thousands of copies make no hub. Nodes carry one more
component, sqrt(M^2 - |x|^2) with M the largest norm, which makes the largest inner product the nearest vector. The
graph starts from neighbours within short stretches of sorted random projections. Each round of NN-descent joins every
node's neighbours (both directions) with one another at that node: the pairs are neighbours of neighbours, and each
keeps its best; rounds go on until few neighbours change. Reverse neighbours and pairs are sampled as the method has it.
A query walks the graph greedily: it keeps a pool of the best nodes seen and in each hop expands the best not yet
expanded, until its pool holds none. Degree and pool are fixed, so recall falls slowly as the table grows (README).
All hops are joins on node. Graph and walk compare codes, a byte a component, so that what rounds and hops copy is a
quarter of the vectors; scores of the answers are taken again in double precision from the given vectors.

Defined cases: vectors that are null, empty, zero, of another length than most, or that hold a null or non-finite
component take no part; null ids take no part; an id given twice takes part with each of its different vectors; with
fewer candidates than k, all come back; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragloom.llm.common import cut, slices

DEGREE, BACK, PAIRS, SETTLED, PLANES, STRETCH, POOL, EXPAND, PIVOTS, SEED = 32, 32, 16, 0.05, 4, 128, 300, 50, 1024, 11
LISTS = "id long, ids array<long>, sims array<float>"


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(id, vec): vec as array<double>, only vectors that take part."""
    vec = F.col(vector).cast("array<double>")
    fine = F.forall(vec, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(vec, lambda x: x != 0)
    some = rows.where(fine).select(F.col("vec_id").cast("long").alias("id"), vec.alias("vec")).where("id is not null")
    sizes = some.groupBy(F.size("vec").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return some.where(F.size("vec") == (sizes.d if sizes else 0)).distinct()


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["id", "ids", "sims"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<float> column without nulls."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _codes(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a column of codes (a signed byte a component) without nulls."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.int8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.int8)
    return data.reshape(-1, dims).astype(np.float32)


def coded(nodes: DataFrame, most: float) -> DataFrame:
    """nodes (id, v) with v as codes: components in 127ths of `most`, the largest one."""

    def run(batches):
        for batch in slices(batches, 4096):
            if batch.num_rows:
                codes = np.rint(_matrix(batch.column(1)) * (127 / most)).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in codes], pa.binary())], ["id", "v"])

    return nodes.select("id", "v").mapInArrow(run, "id long, v binary")


def _flat(lists: pa.ListScalar) -> np.ndarray:
    """The numbers of a list of lists."""
    return lists.values.flatten().to_numpy()


def freed(spark) -> None:
    """Has Spark drop the shuffles and checkpoints that nothing refers to any more, as each round writes as much again."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of distinct ids."""
    _, first = np.unique(ids, return_index=True)
    ids, sims = ids[first], sims[first]
    order = np.argsort(-sims, kind="stable")[:k]
    return ids[order], sims[order]


def merge_lists(lists: DataFrame, k: int) -> DataFrame:
    """The k best of all lists of an id."""

    def run(batches):
        for batch in slices(batches, 4096):
            rows = []
            for i, ids, sims in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                rows.append((i, *_best(_flat(ids), _flat(sims), k)))
            yield _lists(rows)

    return lists.groupBy("id").agg(F.collect_list("ids").alias("ids"), F.collect_list("sims").alias("sims")).mapInArrow(run, LISTS)


def starting_lists(nodes: DataFrame, dims: int, k: int = DEGREE, rounds: int = PLANES, seed: int = SEED) -> DataFrame:
    """First neighbours: nodes sorted by the signs of random projections, compared within stretches of the order."""
    out = None
    for turn in range(rounds):
        planes = np.random.default_rng([seed, turn]).standard_normal((12, dims)).astype(np.float32)

        def code(batches, planes=planes):
            for batch in slices(batches, 4096):
                if batch.num_rows:
                    v = _codes(batch.column(1), dims) @ planes.T
                    bits = (v[:, :-1] > 0) @ (1 << np.arange(planes.shape[0] - 2, -1, -1))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits + 0.5 + np.arctan(v[:, -1] / 127.0) / np.pi)], ["id", "v", "key"])

        def compare(batches):
            ids, held = np.zeros(0, np.int64), None

            def judged(ids, x):
                sims = x @ x.T
                np.fill_diagonal(sims, -np.inf)
                n = min(k, len(ids) - 1)
                top = np.argpartition(-sims, n - 1, axis=1)[:, :n] if n > 0 else np.zeros((len(ids), 0), int)
                return _lists([(int(i), ids[t], s[t]) for i, t, s in zip(ids, top, sims)])

            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = np.concatenate([ids, batch.column(0).to_numpy()])
                new = _codes(batch.column(1), dims)
                held = new if held is None else np.concatenate([held, new])
                while len(ids) >= 2 * STRETCH:
                    yield judged(ids[:STRETCH], held[:STRETCH])
                    ids, held = ids[STRETCH:], held[STRETCH:]
            if len(ids):
                yield judged(ids, held)

        sorted_rows = nodes.select("id", "v").mapInArrow(code, "id long, v binary, key double").repartitionByRange("key", "id").sortWithinPartitions("key", "id").select("id", "v")
        lists = sorted_rows.mapInArrow(compare, LISTS)
        out = lists if out is None else out.union(lists)
    return cut(merge_lists(cut(out), k))


def members(graph: DataFrame, back: int, turn: int) -> DataFrame:
    """(center, id): each node's neighbours and a sample of at most `back` nodes that have it as a neighbour."""
    forward = graph.select(F.col("id").alias("center"), F.explode("ids").alias("id"))
    order = Window.partitionBy("id").orderBy(F.xxhash64("center", F.lit(turn)), "center")
    backward = forward.withColumn("r", F.row_number().over(order)).where(F.col("r") <= back).select(F.col("id").alias("center"), F.col("center").alias("id"))
    return forward.union(backward).distinct()


def around(graph: DataFrame, nodes: DataFrame, back: int, turn: int) -> DataFrame:
    """(center, ids, vs): each node with its members and their codes."""
    joined = members(graph, back, turn).join(nodes.select("id", "v"), "id")
    return joined.groupBy("center").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"))


def descend(graph: DataFrame, nodes: DataFrame, dims: int, k: int = DEGREE, back: int = BACK, pairs: int = PAIRS, turn: int = 0) -> DataFrame:
    """One round: the members of each node meet one another, and each node keeps its k best.

    A pair that is no better than the worst of a full list is not sent, as it could not enter."""

    def run(batches):
        for batch in slices(batches, 1024):
            rows = []
            for ids, vs, worst in zip(batch.column(0), batch.column(1), batch.column(2)):
                ids, worst = ids.values.to_numpy(), worst.values.to_numpy()
                if len(ids) < 2:
                    continue
                x = _codes(vs.values, dims)
                sims = x @ x.T
                np.fill_diagonal(sims, -np.inf)
                n = min(pairs, len(ids) - 1)
                top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                near = np.take_along_axis(sims, top, axis=1)
                better = near > worst[:, None]
                rows += ((i, ids[t[b]], s[b]) for i, t, s, b in zip(ids.tolist(), top, near, better) if b.any())
            yield _lists(rows)

    worst = F.when(F.size("sims") >= k, F.element_at("sims", -1)).otherwise(F.lit(float("-inf"))).cast("float")
    limits = nodes.join(graph.select("id", worst.alias("worst")), "id", "left").select("id", "v", F.coalesce("worst", F.lit(float("-inf")).cast("float")).alias("worst"))
    joined = members(graph, back, turn).join(limits, "id").groupBy("center")
    met = joined.agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"), F.collect_list("worst").alias("worst"))
    return cut(merge_lists(graph.union(met.select("ids", "vs", "worst").mapInArrow(run, LISTS)), k))


def build_graph(nodes: DataFrame, dims: int, k: int = DEGREE, settled: float = SETTLED) -> DataFrame:
    """(id, ids, sims): NN-descent over nodes (id, v), until a round changes at most the share `settled` of neighbours."""
    graph, turn = starting_lists(nodes, dims, k), 0
    while True:
        freed(nodes.sparkSession)
        before, graph = graph, descend(graph, nodes, dims, k, turn=turn)
        new = graph.join(before.select("id", F.col("ids").alias("was")), "id", "left").select(F.size("ids").alias("n"), F.size(F.array_except("ids", F.coalesce("was", F.array().cast("array<long>")))).alias("m"))
        n, changed = new.agg(F.sum("n"), F.sum("m")).first()
        if (changed or 0) <= settled * (n or 0):
            return graph
        turn += 1


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, dims: int, pool: int = POOL, expand: int = EXPAND, pivots: int = PIVOTS) -> DataFrame:
    """(q, ids, sims): the pool of each query (q, v, at): v with the extra component, at: a node to start from or null.

    Searches start from that node and from the best of `pivots` nodes that every task holds (a fixed number)."""
    held = nodes.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(pivots).collect()
    pivot_ids, pivot_vs = np.array([r.id for r in held], np.int64), np.frombuffer(b"".join(bytes(r.v) for r in held), np.int8).reshape(-1, dims).astype(np.float32)
    state_schema = "q long, v array<float>, ids array<long>, sims array<float>, done array<boolean>, next array<long>"
    kinds = (pa.int64(), pa.list_(pa.float32()), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int64()))

    def state(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["q", "v", "ids", "sims", "done", "next"])

    def start(batches):
        for batch in slices(batches, 1024):
            rows = []
            for q, v, at, av in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                v = np.array(v, np.float32)
                ids, sims = pivot_ids, pivot_vs @ v
                if av is not None:
                    ids, sims = np.append(ids, at), np.append(sims, np.float32(np.frombuffer(av, np.int8).astype(np.float32) @ v))
                ids, sims = _best(ids, sims, pool)
                first = ids[:expand] if av is None or at in ids[:expand] else np.append(ids[: expand - 1], at)
                rows.append((q, v, ids, sims, np.isin(ids, first), first))
            yield state(rows)

    def score(batches):
        for batch in slices(batches, 2048):
            rows = []
            for q, v, ids, vs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                ids, v = ids.values.to_numpy(), v.values.to_numpy()
                rows.append((q, ids, _codes(vs.values, dims) @ v))
            yield _lists(rows)

    def merge(batches):
        for batch in slices(batches, 1024):
            rows = []
            for q, v, ids, sims, done, more, more_sims in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in range(1, 7))):
                v, best, near = v.values.to_numpy(), ids.values.to_numpy(), sims.values.to_numpy()
                was = best[done.values.to_numpy(zero_copy_only=False)]
                if more.is_valid:
                    best, near = _best(np.concatenate([best, _flat(more)]), np.concatenate([near, _flat(more_sims)]), pool)
                ahead = best[~np.isin(best, was)][:expand]
                rows.append((q, v, best, near, np.isin(best, was) | np.isin(best, ahead), ahead))
            yield state(rows)

    own = nodes.select(F.col("id").alias("at"), F.col("v").alias("av"))
    states = cut(queries.join(own, "at", "left").select("q", "v", "at", "av").mapInArrow(start, state_schema))
    near = cut(around(graph, nodes, BACK, -1))
    while not states.where(F.size("next") > 0).isEmpty():
        freed(nodes.sparkSession)
        frontier = states.select("q", "v", F.explode("next").alias("center"))
        found = frontier.join(near, "center").select("q", "v", "ids", "vs").mapInArrow(score, LISTS)
        gathered = found.groupBy("id").agg(F.collect_list("ids").alias("more"), F.collect_list("sims").alias("more_sims"))
        joined = states.join(gathered, states["q"] == gathered["id"], "left").select("q", "v", "ids", "sims", "done", "more", "more_sims")
        states = cut(joined.mapInArrow(merge, state_schema))
    return states.select("q", "ids", "sims")


def nearest(rows: DataFrame, wanted, k: int = 20, vector: str = "embedding", **how) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for the rows that `wanted` (a condition on id) picks."""
    given = cut(usable(rows, vector))
    sized = given.select(F.size("vec").alias("d"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("s")).agg(F.max("d"), F.max("s")).first()
    dims, most = (sized[0] or 0) + 1, sized[1] or 0.0
    order = Window.partitionBy("vec").orderBy("id")
    few = given.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    extra = F.sqrt(F.greatest(F.lit(0.0), F.lit(most) - F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))
    same = few.groupBy("vec").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("same"))
    nodes = cut(same.select("id", "same", "vec", F.concat("vec", F.array(extra)).cast("array<float>").alias("v")).repartition("id"))
    asked = given.where(wanted).join(nodes.select(F.col("id").alias("node"), "vec"), "vec").select(F.col("id").alias("query_id"), "node")
    asked = cut(asked)
    queries = asked.select(F.col("node").alias("id")).distinct().join(nodes, "id").select(F.col("id").alias("q"), F.concat("vec", F.array(F.lit(0.0))).cast("array<float>").alias("v"), F.col("id").alias("at"))
    largest = nodes.select(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] or 1.0
    codes = cut(coded(nodes, largest))
    pools = search(queries, build_graph(codes, dims, **how), codes, dims)
    pairs = pools.select("q", F.explode("ids").alias("id")).join(nodes.select("id", "vec", "same"), "id")
    pairs = pairs.join(nodes.select(F.col("id").alias("q"), F.col("vec").alias("qv")), "q")

    def exact(batches):
        for batch in slices(batches, 4096):
            if batch.num_rows:
                a, b = _matrix(batch.column(2)), _matrix(batch.column(3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.einsum("ij,ij->i", a, b))], ["q", "same", "score"])

    scored = pairs.select("q", "same", "vec", "qv").mapInArrow(exact, "q long, same array<long>, score double")
    top = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    ranked = scored.select("q", "score", F.explode("same").alias("vec_id")).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    answers = ranked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.join(answers, asked["node"] == answers["q"]).select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
