"""Formats, percentiles, evictions and clusters against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from fragloom.functions import hashing
from fragloom.operators import caches, graph, objects, workload


def test_hours_round_as_the_exact_value_does(spark):
    seconds = [*range(3600, 90_000, 90), 4500, 5220, 8100, 9180, 3600.1, 6660, 86399]
    got = spark.createDataFrame([(float(s),) for s in seconds], "s double").select("s", hashing.duration_units(F.col("s")).alias("t")).collect()
    assert all(r.t == f"{r.s / 3600:.1f}h" for r in got)


@pytest.mark.parametrize("few", [1, 7, 100_000])
def test_nearest_rank_is_exact(spark, few):
    rng = random.Random(few)
    rows = [(g, rng.choice([rng.random() * 10 ** rng.randint(0, 9), 5.0, 5.0])) for g in "abc" for _ in range(300)] + [("d", 1.0), ("e", None), (None, 2.0)]
    data = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.v for r in workload.nearest_rank(data.where("g is not null"), ["g"], "v", 0.9, few, 8).collect()}
    for g in "abcd":
        values = sorted(v for x, v in rows if x == g)
        assert got[g] == values[-(-len(values) * 9 // 10) - 1]
    assert "e" not in got


def test_eviction_order_is_that_of_all_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xxxy"), rng.randint(0, 2), rng.choice([rng.random(), 0.5]), f"{i:04}", rng.randint(1, 50)) for i in range(800)]
    data = spark.createDataFrame(rows, "g string, phase int, score double, content_hash string, size long")
    for target in (1, 700, 10**6):
        want = []
        for g in "xy":
            freed = 0
            for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:4]), 1):
                if freed >= target:
                    break
                freed += r[4]
                want.append((g, r[3], place, freed))
        got = caches.freed_until(data, ["g"], ["phase", "score", "content_hash"], F.lit(target)).select("g", "content_hash", "place", "freed")
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_clusters_skip_seeds_that_earlier_ones_reached(spark):
    rng = random.Random(9)
    reach = {s: {s} | {rng.randrange(60) for _ in range(rng.randint(0, 3))} for s in range(60)}
    rows = [(f"{s:02}", f"{n:02}") for s, nodes in reach.items() for n in nodes]
    seen, want = set(), []
    for s in range(60):
        if s not in seen:
            want += [(f"{s:02}", f"{n:02}") for n in reach[s]]
            seen |= reach[s]
    assert sorted(map(tuple, graph.disjoint(spark.createDataFrame(rows, "seed string, node string")).collect())) == sorted(want)


def test_objects_come_back_with_placeholders(spark):
    one = spark.createDataFrame([("h", 3, 8, 17, 640, 0.5), ("g", 0, 4, 3, 0, 0.1)], "content_hash string, layer_start int, token_start int, token_end int, size long, reuse_score double")
    assert [r.tokens for r in objects.prefixes(one).collect()] == [list(range(10)), []]
    seg = objects.kv_segments(one).first()
    assert (seg.layer, seg["head"], seg.tensor_shape, seg.semantic_hash) == (3, 0, [1, 1, 1], "h")
    assert objects.artifacts(one).first().source_url == "" and objects.tool_traces(one).first().output_hash == "h"


def test_bytes_stay_in_the_largest_unit_and_round_as_the_exact_value_does(spark):
    sizes = [0, 1023, 1536, 1075, 1280, 1331, 1048575, 2**40 - 1, 2**40, 7 * 396_325**2 + 13, 3 * 2**50, 2**53 + 4096, -1536]
    rows = spark.createDataFrame([(s,) for s in sizes], "s long")
    got = rows.select("s", hashing.byte_units(F.col("s"), "GiB").alias("g"), hashing.byte_units(F.col("s")).alias("p")).collect()

    def want(s, units):
        power = next((i for i in range(len(units) - 1) if abs(s) < 1024 ** (i + 1)), len(units) - 1)
        return f"{s / 1024**power:.1f} {units[power]}"

    for r in got:
        assert (r.g, r.p) == (want(r.s, ["B", "KiB", "MiB", "GiB"]), want(r.s, ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]))
