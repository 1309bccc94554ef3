"""Counts of met spans against the joins that make the pairs; what plans must not do."""

import hashlib
import random

from pyspark.sql import functions as F

from fragloom.llm import mixing
from fragloom.operators import joins, reconstruct, vectors
from fragloom.plans import decision_queries, fragment_queries


def spans_and_probes(spark):
    rng = random.Random(5)
    some = lambda low, high: None if rng.random() < 0.03 else rng.randint(low, high)
    spans = [(rng.choice([0, 1, None]), i % 150, some(-40, 40), some(-40, 45)) for i in range(200)] + [(0, 7, 3, 9)] * 3 + [(1, 400 + i, 12, 12 + i) for i in range(-4, 5)]
    probes = [(i % 90, rng.choice([0, 1, None]), some(-40, 40), some(-35, 45)) for i in range(120)] + [(None, 0, 3, 6), (500, 1, 1000, 1003), (7, 0, 3, 6), (7, 0, 3, 6)]
    return spark.createDataFrame(spans, "grp int, id long, start long, stop long"), spark.createDataFrame(probes, "probe long, grp int, q_start long, q_stop long")


def test_overlap_counts_are_those_of_the_pairs(spark):
    spans, probes = spans_and_probes(spark)
    pairs = spans.join(probes, "grp").where("start <= q_stop and stop >= q_start")  # every pair, also of what is no interval
    sums = lambda met, *how: sorted(map(tuple, met.groupBy("probe").agg(*how).collect()), key=str)
    want = sums(pairs, F.count("*"), F.min("start"), F.max("stop"))
    found = joins.overlap_counts(spans, probes, ["grp"])
    assert len(want) > 50 and sums(found, F.sum("hits"), F.min("least"), F.max("most")) == want
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_adjacent_counts_are_those_of_the_pairs(spark):
    spans, probes = spans_and_probes(spark)
    points = probes.select("probe", "grp", F.col("q_start").alias("position"))
    for gap in (0, 1, 5):
        after, before = F.col("start") - F.col("position"), F.col("position") - F.col("stop")
        pairs = spans.join(points, "grp").where(after.between(0, gap) | before.between(0, gap)).select("probe", "id", "start", "stop").distinct()
        want = sorted(map(tuple, pairs.groupBy("probe").agg(F.count("*")).collect()), key=str)
        got = joins.adjacent_counts(spans, points, ["grp"], "probe", gap).select("probe", "hits")
        assert len(want) > 20 and sorted(map(tuple, got.collect()), key=str) == want


def test_short_last_blocks_do_not_keep_a_source_below_its_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 64)
    docs = [(i, " ".join(["w"] * (1 + i % 40)), "ab"[i % 7 > 0]) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    full = got.where("target = 2 * source_size").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert full and all(r.taken == r.target for r in full)


def test_embeddings_are_not_made_below_distinct(spark):
    plan = fragment_queries.embedding_states(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "9301" not in plan.split("Aggregate")[-1].split("\n", 1)[1]


def test_tokens_are_not_made_again_by_a_filter_below_the_windows(spark):
    plan = fragment_queries.token_windows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "conv(" in line for line in plan.split("\n"))


def test_short_prefixes_reach_no_further_tokens_and_walks_do_not_stall(spark):
    prompts = spark.createDataFrame([(1, "m", list(range(500))), (2, "m", []), (3, "m", None)], "prompt_id long, model_id string, tokens array<long>")
    whole = {(r.n, r.content_hash) for r in reconstruct.prefix_hashes(prompts).collect()}
    some = {(r.n, r.content_hash) for r in reconstruct.prefix_hashes(prompts, most=48).collect()}
    assert some == {x for x in whole if x[0] <= 48} and len(some) == 16
    stored = spark.createDataFrame([("m", 5, 2, "a", 9), ("m", 6, 8, "b", None), ("m", 7, 9, "c", 2**53 + 1)], "model_id string, token_start int, token_end int, content_hash string, owner long")
    ends = spark.createDataFrame([(2**53 + 1, "m", 20, -1), (2**53, "m", 20, -1)], "prompt_id long, model_id string, length int, at int")
    for group in (1, 100):
        got = sorted((r.prompt_id, r.content_hash) for r in reconstruct.extend(stored, ends, owner="owner", group=group).collect())
        assert got == [(2**53, "a"), (2**53, "b"), (2**53 + 1, "a"), (2**53 + 1, "b")]


def test_longest_prefix_looks_at_every_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reconstruct, "BATCH", 7)
    name = lambda n: hashlib.md5(str(tuple(range(n))).encode()).hexdigest()
    prompts = spark.createDataFrame([(1, "m", list(range(500))), (2, "m", list(range(30))), (3, "o", list(range(500))), (4, "m", [7]), (5, "m", []), (6, "m", None)], "prompt_id long, model_id string, tokens array<long>")
    held = [("m", name(n), n) for n in (1, 21, 22, 48, 331)] + [("o", name(499), 499)]
    want = {1: (331, name(331)), 2: (22, name(22)), 3: (499, name(499))}
    stored = spark.createDataFrame(held, "model_id string, content_hash string, n int")
    one_unknown = stored.withColumn("n", F.expr("if(n = 499, null, n)"))
    for rows in (stored, stored.drop("n"), one_unknown):
        assert {r.prompt_id: (r.n, r.content_hash) for r in reconstruct.longest_prefix(prompts, rows).collect()} == want
    assert reconstruct.longest_prefix(prompts, stored.where("n < 0")).count() == 0

    text = " ".join(f"w{i}" for i in range(5_000))
    docs = [(1, text, "en", "s"), (3, text[: text.index(" w301")], "en", "s"), (4, "", "en", "s"), (5, None, "en", "s"), (6, "", "en", "s"), (7, "w0 w1", "en", "s"), (9, "w0 w1 x", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.prompt_id: r.n for r in decision_queries.longest_prefix(spark, str(tmp_path)).collect()} == {1: 48, 3: 48, 7: 2, 9: 2}


def test_neighbours_do_not_depend_on_tiles(spark, monkeypatch):
    rng = random.Random(2)
    data = spark.createDataFrame([(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(60)], "vec_id long, embedding array<double>")
    ask = lambda: sorted((r.query_id, r["rank"], round(r.score, 9)) for r in vectors.top_neighbours(data, data.where("vec_id < 30"), 3).collect())
    whole = ask()
    monkeypatch.setattr(vectors, "TILE_QUERIES", 7)
    monkeypatch.setattr(vectors, "TILE_ROWS", 2)
    assert len(whole) == 90 and ask() == whole
