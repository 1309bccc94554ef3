"""Nearest neighbours, main text, toxicity and the pipeline on small fixtures."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragloom.llm import ann, html_text, toxicity

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, same int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "x", 2) for i, v in rows], VECTORS)


def brute(rows, k):
    fine = {}
    for i, v in rows:
        if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine.setdefault(i, np.array(v, np.float32).astype(float))
    out = {}
    for q in fine:
        if q % 20 == 0:
            scored = sorted(((-float(fine[q] @ v), i) for i, v in fine.items() if i != q))
            out[q] = [(-s, i) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("n", [400, 9])
def test_neighbours_recall_ties_and_unusable_vectors(spark, n):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] * (1 + i % 3) + 0.4 * rng.standard_normal(8)).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # copies: ties to the smaller id
    rows += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [float("nan")] * 8), (2080, [1.0] * 7), (2100, [None] + [1.0] * 7), (None, [1.0] * 8), (2120, [float("inf")] + [0.0] * 7)]
    want = brute(rows, 20)
    found = {}
    for r in ann.nearest(vector_frame(spark, rows), F.col("id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(found) == set(want)
    hits = total = 0
    for q, best in want.items():
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, len(got) + 1)) and len(got) == len(best)
        assert all(a[1] > b[1] or abs(a[1] - b[1]) < 1e-12 and a[2] < b[2] for a, b in zip(got, got[1:]))
        hits += len({g[2] for g in got} & {i for _, i in best})
        total += len(best)
    assert hits >= 0.9 * total


def test_neighbours_recall_of_even_vectors_when_few_nodes_are_pivots(spark):
    x = np.random.default_rng(8).standard_normal((6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in ann.nearest(vector_frame(spark, list(enumerate(x.tolist()))), F.col("id") % 60 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    sims = x[::60].astype(float) @ x.T.astype(float)
    want = {60 * i: set(np.argsort(-row)[:21].tolist()) - {60 * i} for i, row in enumerate(sims)}
    assert sum(len(want[q] & found[q]) for q in want) >= 0.98 * 20 * len(want)


def test_no_vectors(spark):
    assert ann.nearest(vector_frame(spark, []), F.col("id") % 20 == 0).count() == 0
    assert ann.nearest(vector_frame(spark, [(0, [1.0, 0.0])]), F.col("id") % 20 == 0).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body>
<header class="site-header"><a href="/">Home &amp; more</a></header><nav><ul><li><a href="/x">menu</a><li>two</ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<article class="post"><header><h1>Head {0}</h1></header><p>First &eacute;t&eacute; <b>bo</b>ld&nbsp; line<br>after<p>Second {0} {1}
<div class='ad box'>Buy now</div><p>Share this article</p><ul><li>one<li>two</ul><form><input name=q>Search</form>
<section id="comments"><p>a reader said</p></section><p hidden>secret</p></article>
<aside>side</aside><footer>&copy; foot</footer>"""


def page_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, blocks int")


def story(i):
    return " ".join(f"w{i}x{j}" for j in range(40))


def test_main_text_of_pages(spark):
    rows = [(i, "http://Host.example/p", PAGE.format(f"number {i}", story(i))) for i in range(8)]
    rows += [(20, "http://other/", PAGE.format("alone", "end")), (21, None, "<p>no host</p><nav>menu</nav>"), (22, "http://e/", None), (23, "http://e/", ""), (24, "http://e/", "plain text \n\t here & there"), (None, "http://e/", "<main>a<div>b</div></main>c"), (20, "http://other/", PAGE.format("alone", "end"))]
    got = {}
    for r in html_text.extract(page_frame(spark, rows)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    body = "Head {0} First été bold line after Second {0} end Share this article one two"
    assert got[20] == [body.format("alone")] * 2
    # short lines that all of a host's different pages repeat are its template
    assert got[3] == [f"Head number 3 Second number 3 {story(3)} one two"] or got[3] == [f"Head number 3 Second number 3 {story(3)}"]
    assert got[21] == ["no host"] and got[22] == [""] and got[23] == [""] and got[24] == ["plain text here & there"] and got[None] == ["a b"]
    assert sum(map(len, got.values())) == len(rows)
    assert html_text.extract(page_frame(spark, [])).count() == 0


def test_copied_articles_are_no_template(spark):
    same = "<article><h1>One title</h1><p>" + " ".join(f"word{i}" for i in range(400)) + " {0}</p><p>short end {0}</p></article>"
    rows = [(i, "http://h/", same.format(i)) for i in range(9)]
    assert all(r.text.startswith("One title word0 word1") and r.text.endswith(f"short end {r.page_id}") for r in html_text.extract(page_frame(spark, rows)).collect())


def test_tree_matching_is_the_largest_common_ordered_tree():
    rng = random.Random(6)

    def tree(depth):
        return (rng.choice("ab"), tuple(tree(depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)))

    def size(a, b):
        if a[0] != b[0]:
            return 0
        best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
        for i, x in enumerate(a[1]):
            for j, y in enumerate(b[1]):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size(x, y))
        return 1 + best[-1][-1]

    def flat(t, up=-1, parents=None, tags=None):
        parents, tags = ([], []) if parents is None else (parents, tags)
        me = len(parents)
        parents.append(up)
        tags.append(ord(t[0]))
        for c in t[1]:
            flat(c, me, parents, tags)
        return parents, tags

    matcher = html_text.Matcher()
    for _ in range(200):
        a, b = tree(3), tree(3)
        pairs = matcher.pairs(matcher.shape(*flat(a)), matcher.shape(*flat(b)))
        assert len(pairs) == size(a, b)


def toxic_rows(n=900, seed=3):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    bad = ["vileword", "vileness", "rottenly"]
    rows = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(3, 120))]
        if i % 5 == 0:
            for _ in range(1 + len(words) // 30):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


def test_toxicity_held_out_accuracy_and_contract(spark):
    rows = toxic_rows()
    extra = [(5000, None), (5001, ""), (None, "vileword " * 9), (3, rows[3][1]), (5002, "fine words " * 20000)]
    docs = spark.createDataFrame([(i, t, 1.0, False) for i, t, _ in rows] + [(i, t, 0.5, True) for i, t in extra], "doc_id long, text string, score double, held_out boolean")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in got if not r.predicted)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, none).count() == 2
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_gradients_match_finite_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "WINDOW", 6)
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity.init(rng).items()}
    pre = rng.standard_normal((6, 3, 3 * toxicity.HIDDEN))
    mask = np.ones((6, 3))
    mask[4:, 1] = 0
    weight = rng.standard_normal((6, 3, toxicity.HIDDEN))
    kept = []
    loss = lambda pre, U: float((toxicity.run_side(pre.astype(np.float32), U.astype(np.float32), mask.astype(np.float32)) * weight).sum())
    toxicity.run_side(pre, p["Uf"], mask, kept)
    grad = np.empty_like(pre)
    dU = toxicity.side_gradient(p, "f", kept, mask, weight, grad)
    for at in [(0, 0, 1), (3, 2, 9), (5, 0, 20), (2, 1, 17)]:
        moved = pre.copy()
        moved[at] += 1e-2
        less = pre.copy()
        less[at] -= 1e-2
        assert abs((loss(moved, p["Uf"]) - loss(less, p["Uf"])) / 2e-2 - grad[at]) < 2e-2
    for at in [(0, 3), (5, 12), (2, 20)]:
        U, V = p["Uf"].copy(), p["Uf"].copy()
        U[at] += 1e-2
        V[at] -= 1e-2
        assert abs((loss(pre, U) - loss(pre, V)) / 2e-2 - dU[at]) < 3e-2


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = toxic_rows(300)
    item = "the secret benchmark passage about seven quiet rivers and nine loud mountains in winter"
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in rows]
    docs += [(900, "intro words here " + item.upper() + " closing words", "en", "s0", 1), (901, docs[1][1], "en", "s1", 1), (902, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    clean = {i for i, _, y in rows if not y}
    assert 900 not in kept and 901 not in kept and len(kept - clean) <= 0.05 * len(clean) + 3
    assert len(kept & clean) >= 0.85 * len(clean)
