"""The engine's routes and the compute plug-ins."""

import pytest

from fragloom.backends import LocalBackend, MeanBackend
from fragloom.engine import Engine

FRAGMENT = "content_hash string, size long, ttl double, reuse_score double, version_id long, inserted double, last_access double"


@pytest.fixture
def engine(spark):
    fragments = spark.createDataFrame([("a", 10, 100.0, 0.5, 1, 0.0, 5.0), ("b", 20, 1.0, 0.5, 2, 0.0, 6.0)], FRAGMENT)
    placements = spark.createDataFrame([("n0", "a", True), ("n0", "b", True), ("n1", "a", False)], "node_id string, content_hash string, is_primary boolean")
    peers = spark.createDataFrame([("n0", "h0", True), ("n1", "h1", False)], "node_id string, host string, healthy boolean")
    return Engine(fragments, placements, peers, node_limit=40)


def test_store_keeps_known_fragments(spark, engine):
    rows = spark.createDataFrame([("a", 99, 1.0, 0.1, 7, 9.0, 9.0), ("c", 5, 1.0, 0.1, 1, 9.0, 9.0), ("c", 5, 1.0, 0.1, 1, 9.0, 9.0)], FRAGMENT)
    after = engine.store(rows, "n1")
    assert {r.content_hash: r.size for r in after.fragments.collect()} == {"a": 10, "b": 20, "c": 5}
    assert {(r.node_id, r.content_hash): r.is_primary for r in after.placements.collect()} == {("n0", "a"): True, ("n0", "b"): True, ("n1", "a"): True, ("n1", "c"): True}


def test_retrieve_remove_and_metrics(spark, engine):
    wanted = spark.createDataFrame([("a",), ("b",), ("x",)], "content_hash string")
    assert [r.content_hash for r in engine.retrieve(wanted, 50.0).collect()] == ["a"]
    gone = engine.remove(wanted.where("content_hash = 'b'"))
    assert gone.fragments.count() == 1 and gone.placements.count() == 2
    m = engine.metrics(50.0).first()
    assert (m.fragments, m.bytes, m.expired, m.hot, m.warm, m.cold) == (2, 30, 1, 2, 0, 0)
    assert [r.content_hash for r in engine.recent(1).collect()] == ["b"]
    assert {r.node_id: r.load for r in engine.heartbeat().collect()} == {"n0": 0.75, "n1": 0.25}


def test_sync_replicate_and_membership(spark, engine):
    assert [(r.content_hash, r.status, r["size"]) for r in engine.sync("n0", "n1").collect()] == [("b", "missing", 20)]
    assert engine.replicate("n0", "n1").placements.where("node_id = 'n1'").count() == 2
    assert {r.content_hash: r.nodes for r in engine.locate(engine.fragments.select("content_hash")).collect()} == {"a": ["n0", "n1"], "b": ["n0"]}
    joined = engine.join(spark.createDataFrame([("n1", "new", True), ("n2", "h2", True), ("n0", "other", True)], "node_id string, host string, healthy boolean"))
    assert {r.node_id: r.host for r in joined.peers.collect()} == {"n0": "h0", "n1": "new", "n2": "h2"}
    assert engine.leave(spark.createDataFrame([("n0",)], "node_id string")).placements.count() == 1
    merged = engine.gossip(spark.createDataFrame([("a", ["z"], 9), ("q", ["y"], 1)], "content_hash string, nodes array<string>, version_id long"))
    assert {r.content_hash: (r.nodes, r.version_id) for r in merged.collect()} == {"a": (["n0", "n1", "z"], 9), "b": (["n0"], 2), "q": (["y"], 1)}
    spans = spark.createDataFrame([(10, 20)], "start long, stop long")
    assert engine.nearest_spans(spans, 21, 1).count() == 1 and engine.nearest_spans(spans, 22, 1).count() == 0


def test_backends(spark, engine):
    class Broken(LocalBackend):  # here, so that it is sent to the tasks by value
        def embed(self, batch):
            raise ValueError("no model")

    prompts = spark.createDataFrame([(1, "m", "t", list(range(300)))], "prompt_id long, model_id string, tenant string, tokens array<long>")
    windows, report = engine.prefill(prompts)
    assert sorted((r.token_start, r.embedding) for r in windows.collect()) == [(0, [0.0, 128.0]), (128, [128.0, 128.0]), (256, [256.0, 44.0])]
    assert (report.first().tokens, report.first().fragments, report.first().latency_seconds) == (300, 3, 0.44)
    assert [r.embedding for r in MeanBackend(3).prefill(prompts.limit(1)).where("token_start = 0").collect()] == [[0.0, 0.001, 0.002]]
    assert Broken().prefill(prompts).where("token_start = 0").first().embedding == [0.0, 128.0]
    assert LocalBackend().complete(prompts).first().text == "" and LocalBackend().available()
