"""Line dedup, SimHash, substring dedup, mixing, licenses and token counts against brute force on small fixtures."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from fragloom.llm import common, decontamination, licenses, line_dedup, mixing, simhash, substring_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, gone string, fp long"


def frame(spark, rows):
    """Documents, with extra columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 5, 6, "x", 7) for i, t, s in rows], SCHEMA)


def samples(seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Éta", "ßeta", "eta", "the", "of", "MIT", "License", "apache"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [line(9) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [line(rng.randint(1, 12)) for _ in range(rng.randint(1, 5))] + rng.sample(shared, rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((i * 3 % 41, "\n".join(parts), f"s{i % 4}"))
    rows += [(100, None, "s1"), (101, "", None), (102, rows[0][1], "s0"), (103, "  \t" + shared[0].upper() + " \x0b\n" + shared[0], "s2"), (None, shared[1] + "\nshort", "s1"), rows[5], (104, "x " * 3000, "s3"), (105, "\n\n", "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, samples())


def key(line):
    k = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)


def test_line_dedup_matches_brute_force(spark, docs):
    rows = samples()
    big = lambda i: 2**63 - 1 if i is None else i
    holders = {}
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(big(i))
    want = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != big(i))]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [tuple(r) for r in line_dedup.line_report(docs).collect()]
    order = lambda r: (big(r[0]), r[3])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_line_dedup_by_shards_and_stage(spark, docs):
    want = sorted(map(tuple, line_dedup.line_report(docs).collect()), key=str)
    # no broadcast: probes go to their shards, each of which is copied to a task for every third probe
    assert sorted(map(tuple, line_dedup.line_report(docs, limit=0, part_probes=3).collect()), key=str) == want
    clashing = docs.withColumns({c: F.lit(1) for c in ("_id", "_gone", "shard", "part", "first", "n")})
    for how in ({}, {"limit": 0, "part_probes": 3}):
        out = line_dedup.drop_repeated_lines(clashing, **how)
        assert out.columns == clashing.columns and out.schema["h"].dataType == docs.schema["h"].dataType
        assert sorted((r.doc_id, r.text, r.n_chars) for r in out.where("doc_id is not null").collect()) == sorted((w[0], w[3], len(w[3])) for w in want if w[0] is not None)
        assert line_dedup.drop_repeated_lines(clashing.limit(0), **how).count() == 0


def test_perfect_hash_is_minimal():
    import numpy as np

    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(-2**62, 2**62, 5000), rng.integers(-2**62, 2**62, 5000)
    h1[:50] = h1[0]  # equal halves must not matter
    slots = line_dedup.mph_slots(line_dedup.mph_build(h1, h2), h1, h2)
    assert sorted(slots.tolist()) == list(range(5000))
    made = line_dedup.index_arrays(h1, h2, np.arange(5000), 1 + np.arange(5000) % 400)
    index = line_dedup.Index(*(made[c] for c in line_dedup.ARRAYS))
    count, first = index.counted(h1, h2)
    assert (count == np.minimum(255, 1 + np.arange(5000) % 400)).all() and (first == np.where(count > 1, np.arange(5000), -1)).all()
    assert not index.counted(h1 + (1 << 40), h2 + 1)[0].any()


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def near_rows():
    rng = random.Random(4)
    base = " ".join(f"w{rng.randint(0, 999)}" for _ in range(300)).split()
    rows = []
    for i in range(30):
        words = list(base)
        for _ in range(i % 5):
            words[rng.randrange(300)] = f"v{rng.randint(0, 99)}"
        rows.append((200 + i, " ".join(words), "s"))
    return rows + samples()


@pytest.mark.parametrize("tile, split", [(4096, 15), (2, 15), (2, 1)])  # whole buckets, tiles, further blocks and tiles
def test_simhash_groups_match_all_pairs(spark, monkeypatch, tile, split):
    rows = near_rows()
    fps = {t: slow_fingerprint(t) for _, t, _ in rows}
    distinct = sorted(set(fps.values()))
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda d, k: links(d, k, tile, split))
    root = components(distinct, lambda a, b: (a ^ b).bit_count() <= 4)
    big = lambda i: 2**63 - 1 if i is None else i
    least = {}
    for i, t, _ in rows:
        r = root[fps[t]]
        least[r] = min(least.get(r, 2**63 - 1), big(i))
    want = sorted(((big(i), fps[t], least[root[fps[t]]]) for i, t, _ in rows))
    got = sorted((big(r.doc_id), r.fp % 2**64, big(r.component_id)) for r in simhash.simhash_groups(frame(spark, rows)).collect())
    assert got == want


def test_simhash_keeps_one_of_each_group(spark):
    out = simhash.keep_one_per_group(frame(spark, near_rows()))
    groups = {r.component_id for r in simhash.simhash_groups(frame(spark, near_rows())).collect()}
    assert {r.doc_id for r in out.select("doc_id").collect()} == groups
    assert out.columns == frame(spark, []).columns


def slow_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((len(t), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(t, mark) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [2048, 2])
def test_repeated_substrings_match_brute_force(spark, docs, crowd):
    texts = [(t or "").encode() for _, t, _ in samples()]
    want = sorted(slow_repeats(texts, 40))
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, 40, 12, crowd).collect())
    assert got == want


def test_repeated_substrings_of_long_and_periodic_texts(spark, monkeypatch):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = noise(150)
    rows = [(1, noise(3000) + passage + noise(500), "s"), (2, passage, "s"), (3, noise(100) + passage[:90] + noise(60), "s"), (4, "ab" * 300, "s"), (5, noise(99), "s"), (6, noise(99) + "é" * 70, "s")]
    monkeypatch.setattr(substring_dedup, "CHUNK", 256)
    texts = [t.encode() for _, t, _ in rows]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows), 100, 16).collect())
    assert got == sorted(slow_repeats(texts, 100))


@pytest.mark.parametrize("size, gone", [(399, 0), (400, 400)])
def test_shared_passages_of_over_50_words_go_from_400_bytes_on(spark, size, gone):
    """The contract counts bytes, not words: 60 shared words of 399 bytes stay in every document."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = " ".join(noise(5) for _ in range(59)) + " "
    passage += noise(size - len(passage))
    assert len(passage) == size and len(passage.split()) == 60
    rows = [(i, f"{noise(700)}{i}{passage}{i}{noise(700)}", "s") for i in range(5)]
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {(i, 1402 + size, gone, gone // 400) for i in range(5)}


def test_equal_pieces_are_counted_before_they_are_joined(spark, monkeypatch):
    """Of 60 equal texts only the first table of pieces holds all rows of a gram; those after it hold a piece once."""
    rng, tables, cut = random.Random(10), [], substring_dedup.cut
    text, other = ("".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(2))
    monkeypatch.setattr(substring_dedup, "cut", lambda df: tables.append(cut(df)) or tables[-1])
    got = substring_dedup.remove_repeats(frame(spark, [(i, text, "s") for i in range(60)] + [(60, other, "s")]), 100, 16).collect()
    assert {(r.doc_id, r.n_removed, r.n_spans) for r in got} == {(i, 400, 1) for i in range(60)} | {(60, 0, 0)}
    first, *later = [t.count() for t in tables]
    assert first > 60 * max(later) and max(later) > 0


def test_places_of_a_crowded_piece_are_not_gathered(spark):
    """Where nothing else is broadcast, pieces with more than crowd places are, and the others leave them out."""
    rng = random.Random(12)
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    own.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    text, twice = ("".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(2))
    docs = own.createDataFrame([(i, text if i < 60 else twice) for i in range(62)], "doc_id long, text string")
    spans = substring_dedup.covered(docs, 100, 16, 30)
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin .*LeftAnti", plan) and re.search(r"BroadcastHashJoin .*Inner", plan)
    assert sorted((r.id, substring_dedup.merged(r.spans)) for r in spans.collect()) == [(i, [(0, 400)]) for i in range(62)]


def test_mixing_reaches_its_targets(spark, docs):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(samples())
    sizes = {}
    for _, t, s in samples():
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    level, total = 0.0, 1.5 * sum(sizes.values())
    full = set()
    while True:
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and weight[s] * level > 2 * sizes[s]}
        if not more:
            break
        full |= more
    for s in names:
        rows = [r for r in got if r.source == s]
        assert {round(r.target, 6) for r in rows} == {round(min(2 * sizes[s], weight[s] * level), 6)}
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 2 * mixing.BLOCK
        assert all(0 <= r.taken <= 2 * r.size and r.source_size == sizes[s] for r in rows)


def test_apportionment_is_highest_quotients(spark):
    rng = random.Random(2)
    for seats, n in ((0, 4), (7, 5), (1000, 13), (3, 40)):
        weights = [rng.choice([0, 1, 1, 5, 7.5, 90]) for _ in range(n)]
        rows = spark.createDataFrame([(0, i, float(w), seats) for i, w in enumerate(weights)], "g int, m int, w double, seats long")
        quotients = sorted(((-w / (2 * s - 1), i) for i, w in enumerate(weights) for s in range(1, seats + 1) if w), key=lambda x: (round(x[0], 12), x[1]))[:seats]
        want = Counter(i for _, i in quotients)
        got = {r.m: r.quota for r in mixing.apportion(rows, ["g"], ["m"], "w", "seats").collect()}
        assert {m: q for m, q in got.items() if q} == dict(want)


def test_licenses_base_places_and_labels(spark):
    rows = [
        (1, "Released under the MIT License. mit LICENSE and MIT, license", "s"), (2, "the Apache-License! GNU general\npublic license", "s"), (3, "mit x license", "s"), (4, None, "s"), (5, "", "s"),
        (6, "words before Permission is hereby granted, free of charge, to any person obtaining a copy of this softwares and associated documentation files, to deal in the Software without restriction and after", "s"),
        (7, "émit licensé mit license", "s"), (8, "Licensed under CC BY-NC 4.0.", "s"), (1, "Released under the MIT License. mit LICENSE and MIT, license", "s"), (None, "mit license", "s"),
    ]
    got = {r.doc_id: r for r in licenses.license_report(frame(spark, rows)).collect()}
    assert len(licenses.license_report(frame(spark, rows)).collect()) == len(rows)
    for i, t, _ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[6].labels == "mit" and got[6].n_base == 0 and got[8].labels == "cc-by-nc" and got[3].labels == ""


def test_token_counts_sum_and_follow_the_rule(spark, docs):
    with open(token_counts.VOCABULARY, "rb") as f:
        encoding, sizes = token_counts.encoder(f.read())
    texts = {i: t for i, t, _ in samples()}
    for rule in ("first", "most"):
        got = {}
        for r in token_counts.token_counts(docs, rule=rule).collect():
            got.setdefault((r.doc_id, r.doc_tokens), []).append((r.section, r.start_byte, r.stop_byte, r.tokens))
            text = texts[r.doc_id] or ""
            assert (len(text[: r.start].encode()), len(text[: r.stop].encode())) == (r.start_byte, r.stop_byte)
        for i, t, _ in samples():
            ids = encoding.encode_ordinary(t or "")
            parts = sorted(set(got[i, len(ids)]))
            assert sum(p[3] for p in parts) == len(ids) and len(parts) == (t or "").count("\n") + 1
            at, want = 0, Counter()
            for token in ids:
                span = range(at, at + int(sizes[token]))
                over = [(sum(p[1] <= x < p[2] for x in span), -p[0]) for p in parts]
                want[next(p[0] for p in parts if p[1] <= at < p[2]) if rule == "first" else -max(over)[1]] += 1
                at = span.stop
            assert {p[0]: p[3] for p in parts if p[3]} == dict(want)


def test_token_counts_of_given_fields(spark):
    rows = spark.createDataFrame([(1, "öne two three", [4, 8, 99, None]), (2, "abc", None)], "doc_id long, text string, cuts array<long>")
    got = sorted((r.doc_id, r.section, r.start, r.stop) for r in token_counts.token_counts(rows, bounds="cuts").collect())
    assert got == [(1, 0, 0, 4), (1, 1, 4, 8), (1, 2, 8, 13), (2, 0, 0, 3)]


def edit_distance_within(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i - 1] + (x != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_finds_all_within_the_budget(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "kst" for b in ("ala", "emo", "iru", "otter")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(12).capitalize() + ".") for i in range(8)] + [(50, "short"), (51, None), (3, None)]
    rows = []
    for i in range(40):
        passage = list(items[i % 8][1])
        for _ in range(rng.randint(0, 9)):
            passage[rng.randrange(len(passage))] = rng.choice("abcxyz")
        rows.append((i, text(20) + "\n" + "".join(passage).upper() + "  " + text(15), "s"))
    rows += [(90, None, "s"), (91, "", "s"), (None, items[0][1], "s"), (1, rows[1][1], "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size, passes in ((10**6, 4), (150, 100), (150, 0)):  # one block, several blocks, joined
        got = sorted(((r.doc_id is None, r.doc_id or 0), r.item_id, r.distance) for r in decontamination.contaminated(frame(spark, rows), bench, block_chars=size, passes=passes).collect())
        want = []
        for i, t, _ in rows:
            for j, item in items[:8]:
                plain = decontamination.plain(item)
                d = edit_distance_within(plain, decontamination.plain(t or ""))
                if d <= int(len(plain) * decontamination.RATE):
                    want.append(((i is None, i or 0), j, d))
        assert got == sorted(want)
    kept = decontamination.drop_contaminated(frame(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows} - {w[0][1] if not w[0][0] else None for w in want}


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.line_report(none).count() == 0
    assert simhash.simhash_groups(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert licenses.license_report(none).count() == 0
    assert token_counts.token_counts(none).count() == 0
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(frame(spark, samples()), bench).count() == 0


def test_connected_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_a_component_of_many_nodes_and_facts_of_one_key(spark):
    edges = [(0, i) for i in range(1, 300)] + [(500, 501)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(300)} | {500: 500, 501: 500}
    rows = spark.createDataFrame([(0, i) for i in range(200)] + [(1, 7), (2, 8), (1, 7)], "k long, x long")
    facts = spark.createDataFrame([(0, "a"), (1, "b")], "k long, f string")
    got = Counter((r.k, r.x, r.f) for r in common.with_facts(rows, facts, "k", "x").collect())
    assert got == Counter([(0, i, "a") for i in range(200)] + [(1, 7, "b")] * 2)


def test_decontamination_by_joins_equals_blocks(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 12, 30]))) for i in range(40)] + [(None, "ab ab"), (3, "ab ab"), (7, None), (8, " .. ")]
    rows = []
    for i in range(60):
        passage = list(items[i % 40][1])
        for _ in range(rng.randint(0, 3)):
            passage[rng.randrange(len(passage))] = rng.choice("ab ")
        rows.append((i, text(rng.randint(0, 10)) + "".join(passage) + "\n " + text(5) + "".join(passage), "s"))
    rows += [(None, "ab ab", "s"), (2, rows[2][1], "s"), (2, "ab", "s"), (90, None, "s"), (91, "", "s"), (92, items[3][1] * 400, "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda passes: Counter(map(tuple, decontamination.contaminated(frame(spark, rows), bench, passes=passes).collect()))
    assert found(4) == Counter(map(tuple, decontamination.joined(frame(spark, rows), bench).collect()))
    assert decontamination.joined(frame(spark, []), bench).count() == 0 == decontamination.joined(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).count()
