"""Cases with defined results: clashing names, limits, short items, repeated rows, empty tables, broken pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from fragloom.llm import decontamination, html_text, licenses, line_dedup, mixing, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


def test_seats_past_a_limit_go_to_the_next_quotients(spark):
    rows = spark.createDataFrame([(0, 1, 90.0, 10, 3), (0, 2, 5.0, 10, 4), (0, 3, 4.0, 10, 9)], "g int, m int, w double, seats long, most long")
    got = {r.m: r.quota for r in mixing.apportion(rows, ["g"], ["m"], "w", "seats", "most").collect()}
    quotients = sorted(((-w / (2 * s - 1), m) for m, w, most in ((1, 90.0, 3), (2, 5.0, 4), (3, 4.0, 9)) for s in range(1, most + 1)))[:10]
    assert got == {m: sum(1 for _, x in quotients if x == m) for m in (1, 2, 3)} and sum(got.values()) == 10
    less = {r.m: r.quota for r in mixing.apportion(rows.withColumn("seats", F.lit(99)), ["g"], ["m"], "w", "seats", "most").collect()}
    assert less == {1: 3, 2: 4, 3: 9}  # no more than all limits


@pytest.mark.parametrize("names", [["taken"], ["size", "source_size", "target", "taken"], ["Taken", "_id", "id"]])
def test_the_mix_decides_whatever_columns_are_called(spark, names):
    docs = documents(spark, [(i, "w " * (30 + i % 7), ) for i in range(60)] + [(99, ""), (None, "a b c"), (5, "w " * 35)])
    plain = mixing.mix_documents(docs)
    out = mixing.mix_documents(docs.withColumns({n: F.lit(0) for n in names}))
    key = lambda r: (r.doc_id is None, r.doc_id, r.text, r.size, r.source_size, r.target, r.taken)
    assert sorted(map(key, out.collect()), key=str) == sorted(map(key, plain.collect()), key=str)
    assert 99 not in {r.doc_id for r in out.collect()} and out.where("taken <= 0").isEmpty()
    assert mixing.mix_documents(docs.limit(0)).isEmpty()


def test_short_items_are_found_between_word_bounds(spark):
    bench = spark.createDataFrame([(1, "Q: yes!"), (2, "..."), (3, None), (4, "")], "item_id long, text string")
    docs = documents(spark, [(1, "well, q yes"), (2, "faq yes"), (3, "q yesterday"), (4, "Q -- YES. q yes"), (5, None), (6, "...")])
    assert sorted((r.doc_id, r.item_id, r.distance, r.start, r.stop) for r in decontamination.contaminated(docs, bench).collect()) == [(1, 1, 0, 5, 10), (4, 1, 0, 0, 5)]


def test_stages_keep_columns_rows_and_clashing_names(spark):
    texts = [(i, f"line number {i} of its own\nshared by all of them here") for i in range(8)] + [(3, "line number 3 of its own\nshared by all of them here"), (None, None), (9, "")]
    docs = documents(spark, texts).withColumns({c: F.lit("x") for c in ("_id", "_gone", "_found", "_kept", "fp", "root", "score", "gone", "id", "row")})
    bench = spark.createDataFrame([(1, "nothing like any of these documents at all")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    stages = [line_dedup.drop_repeated_lines, simhash.keep_one_per_group, lambda d: decontamination.drop_contaminated(d, bench), lambda d: toxicity.drop_toxic(d, labels)]
    for stage, rows in zip(stages, (11, None, 11, 11)):
        out = stage(docs)
        assert out.columns == docs.columns and out.where("_id <> 'x' or row <> 'x'").isEmpty()
        assert rows is None or out.count() == rows
        assert stage(docs.limit(0)).isEmpty()
    kept = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert kept[0].count("\n") == 1 and kept[4] == "line number 4 of its own" and kept[9] == ""


def test_all_windows_of_labelled_documents_are_trained_on(spark):
    docs = documents(spark, [(i, f"word{i} " * 4000) for i in range(6)])
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels).collect()
    assert rows and all(len(r.parts) == len(toxicity.windows(4000)) for r in rows)


def pages(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def story(i, n=40):
    return " ".join(f"w{i}x{j}" for j in range(n))


def test_classes_that_only_resemble_page_parts_stay(spark):
    page = '<article><h1>T</h1><section id="discussion"><p>Our findings matter.</p></section><p class="notice">A legal notice text.</p><div class="share-price"><p>Prices rose.</p></div><div class="related-work">Others too.</div><div class="cookie-notice">We use cookies</div><ol class="comment-list"><li>mine</ol></article>'
    assert pages(spark, [(1, "http://a/", page)]) == {1: "T Our findings matter. A legal notice text. Prices rose. Others too."}


@pytest.mark.parametrize("n", [2, 8, 60])
def test_lines_that_different_pages_share_are_template(spark, n):
    long = "This long notice of more than twelve words stands on top of each and every page of the site."
    page = "<body><div><p>Top line of the site</p><article><p>" + long + "</p><p>{}</p></article></div>"
    got = pages(spark, [(i if i else None, "http://a/x", page.format(story(i))) for i in range(n)])
    assert got == {i if i else None: story(i) for i in range(n)}


def test_template_is_found_beside_many_copies_and_copies_stay(spark):
    page = "<body><article><h1>Site name</h1><p>{}</p><p>{}</p></article>"
    rows = [(i, "http://a/x", page.format(story(i if i < 12 else 99), story(1000 + (i if i < 12 else 99)))) for i in range(40)]
    got = pages(spark, rows)
    assert got == {i: f"{story(i if i < 12 else 99)} {story(1000 + (i if i < 12 else 99))}" for i in range(40)}


def test_layouts_have_their_own_template(spark):
    rows = [(i, "http://a/x", f"<body><article><p>Line of the first kind</p><p>{story(i)}</p></article>") for i in range(5)]
    rows += [(10 + i, "http://a/x", f"<body><main><section><h2>Line of the second kind</h2><p>{story(10 + i)}</p></section></main>") for i in range(5)]
    assert pages(spark, rows) == {r[0]: story(r[0]) for r in rows}


@pytest.mark.parametrize("html", ['"<a ' * 250_000, "<" + "a" * 1_000_000, "<a '>'" * 170_000, "<div>" * 100_000 + "</x>" * 100_000, "<b>" * 150_000 + "x<br>" * 100_000, "<!--" * 250_000, "</script " * 110_000])
def test_broken_markup_is_read_in_one_pass(html):
    start = time.time()
    html_text.compact(html_text.Tree(html))
    assert time.time() - start < 5


def test_deep_trees_are_aligned(spark):
    rows = [(i, "http://a/x", "<body>" + "<div>" * 3000 + f"<p>Top line</p><p>{story(i)}</p>") for i in range(3)]
    assert pages(spark, rows) == {i: story(i) for i in range(3)}


def voted_labels(words, templates, k=licenses.K):
    """Brute force: every gram of a text against every gram of every template."""
    found = set()
    for label, text in templates:
        wanted = licenses._words_of(text)
        grams = len(wanted) - k + 1
        diagonals = {}
        for pos in range(len(words) - k + 1):
            for tpos in range(grams):
                if words[pos : pos + k] == wanted[tpos : tpos + k]:
                    diagonals.setdefault(pos - tpos, []).append((pos, tpos))
        runs = []
        for d in sorted(diagonals):
            if runs and d - runs[-1][0] <= licenses.SLIP:
                runs[-1] = (d, runs[-1][1] + diagonals[d])
            else:
                runs.append((d, diagonals[d]))
        for _, hits in runs:
            stop, start = max(p for p, _ in hits) + k, min(p for p, _ in hits)
            if len({t for _, t in hits}) >= licenses.COVER * grams and stop - start <= licenses.STRETCH * (grams + k - 1) + licenses.SLIP:
                found.add((label, start, stop))
    return found


def test_license_spans_match_brute_force_over_all_documents(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        _, text = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        words = licenses._words_of(text)
        for _ in range(rng.choice([0, 1, 2, 5, 20])):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["word", words[at]], ["other"], ["the"]])
        rows.append((i, " ".join(["of", "the"] * rng.randint(0, 5) + words + [rng.choice(["general", "public", "x"]) for _ in range(9)] + (words if i % 4 == 0 else []))))
    docs = documents(spark, rows + [(None, rows[1][1]), (5, rows[5][1])])
    got = {r.doc_id: {(s.label, s.start, s.stop) for s in r.spans or []} for r in licenses.license_report(docs).collect()}
    for i, text in rows:
        assert got[i] == voted_labels(licenses._words_of(text), licenses.TEMPLATES), i
    assert got[None] == got[1] and sum(map(bool, got.values())) > 30
