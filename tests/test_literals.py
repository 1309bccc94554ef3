"""Small literal cases of the operators."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragloom.functions import hashing as H
from fragloom.functions import throughput as T
from fragloom.operators import caches, decisions, graph, inventory, joins, placement, reconstruct, vectors, windows, workload
from fragloom.plans import decision_queries, model
from fragloom.sources import tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def prompt(spark, n, width):
    rows = spark.createDataFrame([(1, "m", "t", list(range(n)))], "prompt_id long, model_id string, tenant string, tokens array<long>")
    return windows.token_windows(rows, width)


def test_windows_and_hashes(spark):
    got = [(r.token_start, r.token_end, r.size) for r in prompt(spark, 10, 4).orderBy("token_start").collect()]
    assert got == [(0, 3, 256), (4, 7, 256), (8, 9, 128)]
    for tokens in ((), (7,), (1, 2, 3)):
        a = F.array(*[F.lit(x) for x in tokens]).cast("array<long>")
        r = one(spark, H.tuple_hash(a).alias("t"), H.comma_hash(a).alias("c"))
        assert r.t == hashlib.md5(str(tokens).encode()).hexdigest() and r.c == hashlib.md5(",".join(map(str, tokens)).encode()).hexdigest()
    assert prompt(spark, 0, 4).count() == 0


def test_embedding_follows_the_generator(spark):
    h = hashlib.md5(b"(1, 2, 3)").hexdigest()
    s, out = int(h, 16), []
    for _ in range(16):
        s = (s * 9301 + 49297) % 233280
        out.append(s / 233280.0 * 2.0 - 1.0)
    length = math.sqrt(sum(x * x for x in out))
    got = one(spark, H.embedding(F.lit(h), 16).alias("e")).e
    assert all(abs(a - b / length) < 1e-9 for a, b in zip(got, out))


def test_split_and_merge(spark):
    parent = prompt(spark, 8, 8)
    got = sorted((r.token_start, r.token_end) for r in windows.split_windows(parent, F.array(F.lit(3), F.lit(0), F.lit(7), F.lit(99))).collect())
    assert got == [(0, 3), (4, 7)]
    parts = prompt(spark, 8, 4).withColumn("ttl", F.lit(1.0)).withColumn("version_id", F.lit(1)).withColumn("reuse_score", F.lit(0.5))
    merged = windows.merge_windows(parts, ["prompt_id"], ["token_start"]).collect()
    assert [(m.token_start, m.token_end, m.size) for m in merged] == [(0, 7, 512)] and merged[0].content_hash == hashlib.md5(str(tuple(range(8))).encode()).hexdigest()
    assert windows.merge_windows(parts.withColumn("reuse_score", F.lit(0.9)), ["prompt_id"], ["token_start"]).count() == 0
    assert windows.merge_windows(prompt(spark, 12, 4).where("token_start <> 4").withColumn("ttl", F.lit(1.0)).withColumn("version_id", F.lit(1)).withColumn("reuse_score", F.lit(0.5)), ["prompt_id"], ["token_start"]).count() == 0


def test_semantic_hash_distance_and_cosine(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x]) if x else F.array().cast("array<double>")
    r = one(spark, H.semantic_hash(arr(-1, 0, 1, 5)).alias("a"), H.semantic_hash(arr()).alias("b"), H.semantic_hash(arr(1), 12).alias("c"), H.hash_distance(F.lit("00ff"), F.lit("00fe01")).alias("d"), H.hash_distance(F.lit("0"), F.lit("0")).alias("e"),
            H.cosine(arr(1, 0), arr(0, 1)).alias("f"), H.cosine(arr(1, 2), arr(1, 2)).alias("g"), H.cosine(arr(0, 0), arr(1, 0)).alias("h"))
    assert (r.a, r.b, r.c) == ("007fffff", "0", "0fff")
    assert abs(r.d - 2 / 3) < 1e-12 and r.e == 0 and r.f == 0 and abs(r.g - 1) < 1e-12 and r.h == 0
    with pytest.raises(Exception, match="odd number"):
        one(spark, H.hash_distance(F.lit("0"), F.lit("00")).alias("x"))


def test_delta(spark):
    base, new = list(range(10)), [*range(7), 99, 100]
    rows = spark.createDataFrame([(base, new)], "b array<long>, n array<long>").withColumn("d", H.delta(F.col("b"), F.col("n")))
    r = rows.select("d.*", H.apply_delta(F.col("b"), F.col("d.removed_tail"), F.col("d.appended")).alias("back")).first()
    assert (r.removed_tail, r.appended, r.back) == (3, [99, 100], new)
    with pytest.raises(Exception, match="out of range"):
        rows.select(H.apply_delta(F.col("b"), F.lit(11), F.col("n"))).collect()


def test_spans(spark):
    spans = spark.createDataFrame([(1, 10, 20), (1, 0, 100), (1, 40, 60)], "g int, start long, stop long")
    ask = lambda a, b: {(r.start, r.stop) for r in joins.overlap_join(spans, spark.createDataFrame([(1, a, b)], "g int, q_start long, q_stop long"), ["g"], 7).collect()}
    assert ask(20, 30) == {(10, 20), (0, 100)} and ask(21, 30) == {(0, 100)} and ask(45, 55) == {(0, 100), (40, 60)}
    near = lambda p, gap: {(r.start, r.stop) for r in joins.adjacent_join(spans.where("start = 10"), spark.createDataFrame([(1, p)], "g int, position long"), ["g"], gap).collect()}
    assert near(20, 0) and not near(22, 1) and near(21, 1)
    rows = spark.createDataFrame([(1, 5, 9, 100), (1, 8, 20, 100), (1, 40, 99, 100)], "k int, start long, stop long, length int")
    assert sorted((r.gap_start, r.gap_end) for r in joins.gaps(rows, ["k"], "length").collect()) == [(0, 4), (21, 39)]
    half = spark.createDataFrame([(1, 0, 49, 100)], "k int, start long, stop long, length int")
    assert joins.covered(half, ["k"], "length").first().ratio == 0.5


def test_clusters(spark):
    rows = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.8, 0.2])], "g int, vec_id long, embedding array<double>")
    count = lambda t: vectors.leader_clusters(rows, "g", t).select("leader").distinct().count()
    assert count(0.8) == 1 and count(0.99) == 2


def test_cluster_blocks_do_not_change_the_leaders(spark):
    """Against one vector at a time; with a zero vector, a repeated row, rows that take no part, and no rows."""
    rng = np.random.default_rng(3)
    made = [(int(g), i, [float(x) for x in v]) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 90), rng.standard_normal((90, 3))))]
    given = made + [(0, 90, [0.0, 0.0, 0.0]), made[5], (1, None, [1.0, 0.0, 0.0]), (None, 91, [1.0, 0.0, 0.0]), (2, 92, None)]
    want, leads = set(), {}
    for g, i, v in made + [given[90]]:
        unit = np.array(v) / (np.linalg.norm(v) or 1)
        first = next((j for j, u in leads.get(g, []) if u @ unit >= 0.9), None)
        if first is None:
            leads.setdefault(g, []).append((i, unit))
        want.add((g, i, i if first is None else first))
    rows = spark.createDataFrame(given, "g int, vec_id long, embedding array<double>")
    for block in (7, 2048):
        got = vectors.leader_clusters(rows, "g", 0.9, block).collect()
        assert len(got) == 92 and {tuple(r) for r in got} == want
    assert vectors.leader_clusters(rows.where("false"), "g").count() == 0


def test_clusters_of_few_leaders_and_of_small_keys(spark):
    """Where few vectors lead, rounds take more rows than `block`; a key of few rows is settled beside."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 8)) * 20
    near = rng.integers(0, 3, 700) + np.where(np.arange(700) < 500, 0, 3)  # new clusters begin late
    made = [(0, i, [float(x) for x in centres[c] + rng.standard_normal(8)]) for i, c in enumerate(near)]
    made += [(1, i, [1.0, float(i % 2)] + [0.0] * 6) for i in range(5)]
    want, leads = set(), {}
    for g, i, v in made:
        unit = np.array(v) / np.linalg.norm(v)
        first = next((j for j, u in leads.get(g, []) if u @ unit >= 0.9), None)
        if first is None:
            leads.setdefault(g, []).append((i, unit))
        want.add((g, i, i if first is None else first))
    got = vectors.leader_clusters(spark.createDataFrame(made, "g int, vec_id long, embedding array<double>"), "g", 0.9, 16).collect()
    assert len(got) == len(made) and {tuple(r) for r in got} == want and len(leads[0]) < 16


def test_clusters_send_no_vectors_to_the_driver(spark):
    """What all tasks return is less than a quarter of the vectors, each of which leads."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(0, i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((1000, 512)))], "g int, vec_id long, embedding array<double>")
    context, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
    none, empty = context._jvm.java.util.ArrayList(), context._gateway.new_array(context._jvm.double, 0)
    sent = lambda: {(x.stageId(), x.attemptId()): x.resultSize() for x in (lambda seq: [seq.apply(i) for i in range(seq.size())])(store.stageList(none, False, False, empty, none))}
    before = sent()
    assert vectors.leader_clusters(rows, "g", 0.9, 128).where("leader = vec_id").count() == 1000
    assert sum(n for stage, n in sent().items() if stage not in before) < 1000 * 512 * 8 / 4


def test_graph_walks(spark):
    edges = spark.createDataFrame([("a", "b", "next", 0.9), ("b", "c", "next", 0.9), ("c", "d", "next", 0.4), ("c", "a", "next", 0.9)], "src string, dst string, edge_type string, weight double")
    seeds = spark.createDataFrame([("a",), ("zz",)], "seed string")
    assert {r.node for r in graph.components(seeds, edges, 0.5, 2).collect()} == {"a", "b", "c"}
    versions = spark.createDataFrame([(1, None), (2, 1), (3, 1), (9, 8)], "version_id int, parent_version int")
    pairs = spark.createDataFrame([(2, 3), (2, 9)], "v1 int, v2 int")
    assert {(r.v1, r.v2): r.ancestor for r in graph.common_ancestor(pairs, versions, 5).collect()} == {(2, 3): 1, (2, 9): None}


def test_ring_matches_bisection(spark):
    import bisect

    nodes = [f"n{i}" for i in range(4)]
    ring = sorted((hashlib.md5(f"{n}:{i}".encode()).hexdigest(), n) for n in nodes for i in range(20))
    keys = [f"k{i}" for i in range(200)]
    got = {r.content_hash: r.owners for r in placement.owners(spark.createDataFrame([(k,) for k in keys], "content_hash string"), spark.createDataFrame([(n,) for n in nodes], "node_id string"), 3, 20).collect()}
    for k in keys:
        at = bisect.bisect_left(ring, (hashlib.md5(k.encode()).hexdigest(),))
        want = list(dict.fromkeys(n for _, n in ring[at:] + ring[:at]))[:3]
        assert got[k] == want


def test_caches(spark):
    last = spark.createDataFrame([(0, "a", 3.0), (0, "b", 2.0), (0, "c", 4.0)], "g int, content_hash string, last_access double")
    assert {r.content_hash for r in caches.survivors(last, ["g"], 2).collect()} == {"a", "c"}
    store = spark.createDataFrame([(0, "x", 10, 0.0, 0.0, 5.0, 0.5), (0, "y", 10, 0.0, 99.0, 9.0, 0.1), (0, "z", 10, 0.0, 99.0, 9.0, 0.9)], "g int, content_hash string, size long, inserted double, ttl double, last_access double, reuse_score double")
    freed = caches.node_eviction(store, ["g"], F.lit(10.0), F.lit(15)).orderBy("place").collect()
    assert [r.content_hash for r in freed] == ["x", "z"]


def test_decisions(spark):
    nodes = spark.createDataFrame([("n1", 0, 1, 5000.0, 0.0, 0.0, 0.0), ("n2", 1, 1, 100.0, 0.5, 0.5, 0.5)], "node_id string, seq int, region int, latency_ms double, bandwidth_cost double, gpu_load double, memory_pressure double")
    fragment = spark.createDataFrame([("h", 0.5, 1)], "content_hash string, value double, region int")
    assert decisions.economic_route(fragment, nodes).first().node_id == "n1"
    route = lambda total, local, t: one(spark, decisions.length_route(F.lit(total), F.lit(0), F.lit(local), F.lit(t)).alias("x")).x
    assert route(800, 0, 1000).target == "pd-p" and route(1200, 0, 1000).target == "offload"
    assert (route(2000, 1500, 1000).target, route(2000, 1500, 1000).incremental) == ("pd-p", 500)


def test_model_equations(spark):
    d = lambda x: F.lit(float(x))
    r = one(spark, T.end_to_end(d(10), d(5), d(3), d(0)).alias("a"), T.end_to_end(d(10), d(5), d(3), d(1)).alias("b"), T.end_to_end(d(10), d(10), d(10), d(0.5)).alias("c"), T.offload_rate(d(4), d(1e6), F.lit(32768)).alias("e"), T.local_rate(d(3), F.lit(8192), 1.0).alias("f"), T.decode_rate(d(5)).alias("g"),
            T.kv_size_mib(F.lit(64)).alias("h"), T.prefill_seconds(F.lit(200000)).alias("i"), T.kv_gbps(F.lit(8192)).alias("j"))
    assert (r.a, r.b, r.c) == (3, 3, 10) and abs(r.e - 4 / 1.84) < 1e-9 and abs(r.f - 3 / 0.72) < 1e-9 and abs(r.g - 3.90625) < 1e-9 and (r.h, r.i) == (190.8, 7.40) and abs(r.j - 3.59) < 0.04
    lengths = spark.createDataFrame([(x,) for x in (100, 500, 1000, 5000, 10000, 50000)], "length long")
    m = workload.conditional_means(lengths, F.lit(1000), []).first()
    assert (m.fraction, round(m.mean_long, 2), round(m.mean_short, 2)) == (0.5, 21666.67, 533.33)
    p = workload.mean_and_p90(spark.range(1, 11).withColumn("v", F.col("id").cast("double")), [], "v").first()
    assert (p["mean"], p.p90) == (5.5, 9.0)


def test_grid_search_matches_a_plain_scan(spark):
    rows = tables.random_lengths(spark.range(3000), "id")
    lengths = [r.length for r in rows.collect()]
    assert len(lengths) == 3000 and all(128 <= x <= 131072 for x in lengths)

    def interp(x, ys):
        xs = T.LENGTHS
        if x <= xs[0]:
            return ys[0]
        for a, b, c, e in zip(xs, xs[1:], ys, ys[1:]):
            if x <= b:
                return c + (x - a) / (b - a) * (e - c)
        return ys[-1]

    best = (-1.0,)
    for t in range(1024, 65537, 256):
        long, short = [x for x in lengths if x > t], [x for x in lengths if x <= t]
        p = len(long) / len(lengths)
        ll, sl = round(sum(long) / len(long)) if long else t, round(sum(short) / len(short)) if short else t
        for n in range(1, 8):
            far = min(4 / interp(ll, T.PREFILL), 100 / (interp(ll, T.KV_MIB) * T.GBIT_PER_MIB))
            rate = min(far / p if p > 0 else math.inf, n / (interp(sl, T.PREFILL) * 2.5) / (1 - p) if p < 1 else math.inf, (8 - n) * 20 / 25.6)
            if rate > best[0] + 1e-12:
                best = (rate, t, n)
    got = model.grid_search(spark.createDataFrame([(x,) for x in lengths], "length long")).first()
    assert (got.threshold, got.n_p) == best[1:] and abs(got["lambda"] - best[0]) < 1e-9


def test_scheduler_and_sessions(spark):
    rows = spark.createDataFrame([("s", i, 0.9 if i < 3 else 0.1, 0.0) for i in range(6)], "k string, seq int, average double, queue_ratio double")
    t = 1000
    for i in range(6):
        t = min(int(t * 1.10), 131072) if i < 3 else max(int(t * 0.99), 1000) if t > 1000 else t
    assert workload.adjusted_threshold(rows, ["k"], ["seq"], 1000).first().threshold == t
    log = spark.createDataFrame([("s1", 1, "h1"), ("s1", 2, "h2"), ("s1", 3, "h1")], "session_id string, seq int, content_hash string")
    assert workload.histories(log).first().history == ["h1", "h2", "h1"]
    assert {r.seq: round(r.probability, 4) for r in workload.reuse_probability(log).collect()} == {1: 1.0, 2: 0.5, 3: 0.6667}


def test_canonical_and_gossip(spark):
    rows = spark.createDataFrame([("h1", "t1", 1), ("h1", "t2", 2), ("h1", "t3", 3)], "content_hash string, tenant string, seq int")
    r = inventory.canonical(rows, ["seq"]).first()
    assert (r.first.seq, r.tenants) == (1, ["t1", "t2", "t3"])
    ours, theirs = spark.createDataFrame([("h", ["a"], 5)], "content_hash string, nodes array<string>, version_id int"), spark.createDataFrame([("h", ["b"], 2), ("i", ["c"], 1)], "content_hash string, nodes array<string>, version_id int")
    assert {r.content_hash: (r.nodes, r.version_id) for r in inventory.merge_gossip(ours, theirs).collect()} == {"h": (["a", "b"], 2), "i": (["c"], 1)}


def test_reconstruction(spark):
    prompts = spark.createDataFrame([(1, "m", "t", list(range(700)))], "prompt_id long, model_id string, tenant string, tokens array<long>")
    stored = spark.createDataFrame([("m", 0, 39, "a"), ("m", 40, 99, "b"), ("m", 60, 80, "x"), ("m", 300, 340, "c"), ("o", 100, 120, "d"), ("m", 690, 720, "e")], "model_id string, token_start int, token_end int, content_hash string")
    ends = prompts.select("prompt_id", "model_id", F.size("tokens").alias("length"), F.lit(-1).alias("at"))
    found = reconstruct.extend(stored, ends)
    assert [r.content_hash for r in found.orderBy("token_start").collect()] == ["a", "b", "c"]
    got, missing = reconstruct.coverage(prompts, found)
    assert got.first().covered == 141
    assert sorted((r.gap_start, r.gap_end, r.prefill) for r in missing.collect()) == [(100, 299, False), (341, 699, True)]


def test_reconstruct_takes_every_prompt_and_the_windows_of_all_others(spark, tmp_path):
    long, short = " ".join(f"a{i}" for i in range(130)), " ".join(f"b{i}" for i in range(96))
    docs = [(1, long, "en", "s"), (2, short, "en", "s"), (3, short, "de", "s"), (4, long + " end", "de", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.prompt_id: (r.length, r.covered, r.gaps) for r in decision_queries.reconstruct(spark, str(tmp_path)).collect()}
    # the tail of the longer prompt of each model is held by no other prompt
    assert got == {1: (130, 96, 1), 2: (96, 96, 0), 3: (96, 96, 0), 4: (131, 96, 1)}


def test_prefix_fragments(spark):
    """The longest prefix that another prompt's fragment holds, of equal ones the smallest span; model and owner count."""
    prompts = spark.createDataFrame([(1, "m", list(range(9))), (2, "m", [0, 1, 2, 7]), (3, "o", [0, 1, 2]), (4, "m", [])], "prompt_id long, model_id string, tokens array<long>")
    name = lambda *x: hashlib.md5(str(tuple(x)).encode()).hexdigest()
    stored = [("m", 0, 2, name(0, 1, 2), 2), ("m", 6, 8, name(0, 1, 2), 5), ("m", 3, 5, name(0, 1, 2), 5), ("m", 0, 0, name(0), 1), ("m", 0, 8, name(*range(9)), 1), ("m", 0, 3, name(5, 5, 5, 5), 7)]
    held = spark.createDataFrame(stored, "model_id string, token_start int, token_end int, content_hash string, prompt_id long")
    found = lambda **how: {r.prompt_id: (r.token_start, r.token_end) for r in reconstruct.prefix_fragments(prompts, held, **how).collect()}
    assert found() == {1: (0, 8), 2: (0, 2)}
    assert found(owner="prompt_id") == {1: (0, 2), 2: (3, 5)}


def test_own_fragments_do_not_extend_a_prompt(spark):
    stored = spark.createDataFrame([("m", 0, 9, "a", 1), ("m", 0, 9, "b", 2), ("m", 0, 9, "c", 3), ("m", 10, 19, "d", 1)], "model_id string, token_start int, token_end int, content_hash string, prompt_id long")
    ends = spark.createDataFrame([(i, "m", 20, -1) for i in (1, 2, 3)], "prompt_id long, model_id string, length int, at int")
    found = {(r.prompt_id, r.content_hash) for r in reconstruct.extend(stored, ends, owner="prompt_id").collect()}
    assert found == {(1, "b"), (2, "a"), (2, "d"), (3, "a"), (3, "d")}


def test_fragment_checks_and_codecs(spark):
    rows = spark.createDataFrame([("h", "m", 0, 1, 0, 9, 10, 1.0, 0.5, 1), ("i", "m", 0, 1, 0, 9, -1, 1.0, 0.5, 1), ("j", "m", 0, 1, 0, 9, 1, 1.0, None, 1)], tables.FRAGMENT_SCHEMA)
    fine, bad = tables.valid_fragments(rows)
    assert [r.content_hash for r in fine.collect()] == ["h"] and {r.content_hash for r in bad.collect()} == {"i", "j"}
    assert tables.from_map(tables.to_map(fine)).collect() == fine.collect()
    assert tables.from_json(tables.to_json(fine)).first().token_end == 9
    r = one(spark, H.byte_units(F.lit(1536)).alias("a"), H.duration_units(F.lit(150.0)).alias("b"), H.duration_units(F.lit(5400.0)).alias("c"))
    assert (r.a, r.b, r.c) == ("1.5 KiB", "2m", "1.5h")
