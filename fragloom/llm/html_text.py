"""Main text of web pages by wrapper induction.

Pages of one host and layout (a hash of the tags of the tree's two upper levels) are aligned by simple tree matching:
the layout's reference page, its smallest page_id, against each other page, on the trees of their tags. Aligned nodes
whose text stays the same are template; the others are slots that hold content. A page keeps the text blocks of its
article (the marked one, or else the whole body) that are not template and not in a menu, header, footer, sidebar,
notice, advert, form or reader comment. Only elements whose tag, role or whole class name says so are such parts; in an
article that goes for containers, not for paragraphs.

What is shuffled is a compact tree of tags and text hashes, not html; only lists of template blocks come back to the
pages. A block repeated at its node by TEMPLATE_SHARE of the aligned pages is a candidate. Copies and near copies of
an article share its blocks too, so pages are counted once a story: the smallest hash of the word triples of what is no
candidate (near copies share it), for pages where that is at least a third of the words. A candidate is template where
two stories or more, and TEMPLATE_SHARE of the stories at its node, hold it.

Defined cases: null or empty html gives an empty text; a page without a host stands alone; null page_ids are kept (the
largest, as reference); repeated rows come back as often as they came in; broken markup is read in one pass, and where
a quote in a tag never closes, tags end at the next ">" from there on; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.llm.common import byte_rows, cut, id_of, slices

TEMPLATE_SHARE, STORIES, OWN_SHARE, LARGE_HOSTS, BROADCAST_ROWS = 0.6, 2, 3, 256, 100_000
# Element and class names of HTML and of common page layouts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}}
SKIPPED = frozenset("script style noscript template nav footer aside form button select textarea iframe svg object canvas dialog head title menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promoted banner popup modal overlay notice site-notice"
    " cookie cookies cookie-notice cookie-banner cookie-bar cookie-consent cookie-message consent gdpr gdpr-banner newsletter newsletter-signup newsletter-box subscribe subscribe-box signup login"
    " sidebar side-bar menu main-menu nav navbar navigation main-navigation breadcrumb breadcrumbs toolbar footer site-footer page-footer site-header masthead"
    " comments comment comment-list comments-area comments-section comment-section reader-comments user-comments comment-form disqus disqus_thread respond replies"
    " share-buttons share-links social-share social-links social-media related-posts related-articles related-links recommended-articles widget pagination pager skip-link".split()
)
#: Parts of text; in an article their class says nothing about whether they belong to it.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr caption figcaption q".split()) | INLINE
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _role(tag: str, raw: str, inside: bool) -> bool:
    """Whether an element is one of the parts that are not the article."""
    if tag in SKIPPED or tag == "header" and not inside:
        return True
    if len(raw) < 4:
        return False
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    if a.get("role", "").lower() in ROLES and tag not in ("html", "body", "main", "article"):
        return True
    if tag in ("html", "body", "main", "article") or inside and tag in TEXTUAL:
        return False
    names = set(f"{a.get('class', '')} {a.get('id', '')}".lower().split())
    return bool(names & MARKS) or not inside and bool(names & {"header", "page-header"})


class Tree:
    """Elements in page order: tag, parent, whether skipped, whether in a marked article; and text blocks.

    blocks: (element, text): what stands between two block boundaries, white space as one space."""

    def __init__(self, page: str):
        self.tags, self.parents, self.skipped, self.inside, self.holder = ["#"], [-1], [False], [False], [0]
        self.blocks: list[tuple[int, str]] = []
        self._open: Counter = Counter()
        stack, self._text, tag_at = [0], [], TAG
        at, end = 0, len(page)
        no_more = page.rfind(">")
        while at < end:
            start = page.find("<", at)
            if start < 0 or start > no_more:
                self._text.append((stack[-1], page[at:]))
                break
            if start > at:
                self._text.append((stack[-1], page[at:start]))
            mark = page[start + 1 : start + 2]
            if mark in ("!", "?"):
                comment = page.startswith("<!--", start)
                close = page.find("-->" if comment else ">", start + (4 if comment else 2))
                at = end if close < 0 else close + (3 if comment else 1)
                continue
            if not (mark.isascii() and mark.isalpha() or mark == "/" and page[start + 2 : start + 3].isascii() and page[start + 2 : start + 3].isalpha()):
                self._text.append((stack[-1], "<"))
                at = start + 1
                continue
            m = tag_at.match(page, start)
            if not m:  # a quote that never closes: from here on a tag ends at the next ">"
                tag_at = LOOSE_TAG
                m = tag_at.match(page, start)
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                self._close(stack, tag)
                continue
            self._imply(stack, tag)
            if tag not in INLINE:
                self._flush()
            up = stack[-1]
            i = len(self.tags)
            inside = self.inside[up] or tag in ("article", "main")
            self.tags.append(tag)
            self.parents.append(up)
            self.inside.append(inside)
            self.holder.append(self.holder[up] if tag in INLINE else i)
            self.skipped.append(self.skipped[up] or _role(tag, m[3] or "", inside))
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
                at = close.end() if close else end
            elif tag not in VOID and not (m[3] or "").endswith("/"):
                stack.append(i)
                self._open[tag] += 1
        self._flush()

    def _cut(self, stack: list[int], k: int) -> None:
        for i in stack[k:]:
            self._open[self.tags[i]] -= 1
        del stack[k:]

    def _imply(self, stack: list[int], tag: str) -> None:
        if tag in CLOSES_P and self._open["p"]:
            for k in range(len(stack) - 1, 0, -1):
                name = self.tags[stack[k]]
                if name == "p":
                    self._flush()
                    self._cut(stack, k)
                    break
                if name not in INLINE:
                    break
        if tag in SAME and any(self._open[x] for x in SAME[tag]):
            for k in range(len(stack) - 1, 0, -1):
                name = self.tags[stack[k]]
                if name in HOLDS.get(tag, ()):
                    break
                if name in SAME[tag]:
                    self._flush()
                    self._cut(stack, k)
                    if tag in ("li", "dt", "dd", "td", "th", "option"):
                        break

    def _close(self, stack: list[int], tag: str) -> None:
        if self._open[tag]:
            for k in range(len(stack) - 1, 0, -1):
                if self.tags[stack[k]] == tag:
                    if tag not in INLINE or any(self.tags[x] not in INLINE for x in stack[k:]):
                        self._flush()
                    self._cut(stack, k)
                    return
        if tag not in INLINE:
            self._flush()

    def _flush(self) -> None:
        if self._text:
            shown = [(i, t) for i, t in self._text if not self.skipped[i]]
            text = " ".join(entities.unescape("".join(t for _, t in shown)).split())
            if text:
                self.blocks.append((self.holder[shown[0][0]], text))
            self._text = []

    def kept(self) -> list[int]:
        """Numbers of the blocks outside all skipped parts, of the marked article if that has text."""
        marked = [k for k, (i, _) in enumerate(self.blocks) if self.inside[i]]
        return marked or list(range(len(self.blocks)))


# --- compact trees and their alignment

def _triple(text: str) -> int:
    """The smallest hash of the word triples."""
    words = text.encode().split()
    return min(xxhash.xxh32_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2)))


def compact(tree: Tree) -> dict:
    """Elements that are not inline, with their parents' numbers and tag hashes, and of each kept block its element, hash,
    number of words and smallest triple; layout: a hash of the tags of the two upper levels, each run of equals once."""
    number, parents, tags, depth, upper = {}, [], [], [], []
    for i, tag in enumerate(tree.tags):
        if tag not in INLINE and tag != "br":
            number[i] = len(parents)
            up = number[tree.holder[tree.parents[i]]] if i else -1
            parents.append(up)
            tags.append(xxhash.xxh32_intdigest(tag) & 0x7FFF)
            depth.append(depth[up] + 1 if i else 0)
            if depth[-1] <= 2 and upper[-1:] != [tag]:
                upper.append(tag)
    kept = tree.kept()
    texts = [tree.blocks[k][1] for k in kept]
    return {
        "layout": xxhash.xxh64_intdigest(" ".join(upper)) - (1 << 63), "parents": parents, "tags": tags, "blocks": kept, "places": [number[tree.blocks[k][0]] for k in kept],
        "hashes": [xxhash.xxh64_intdigest(t.encode()) - (1 << 63) for t in texts], "words": [len(t.split()) for t in texts], "triples": [_triple(t) for t in texts],
    }


class Matcher:
    """Simple tree matching: the most nodes that two ordered trees share with parents and order kept."""

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.trees: list[tuple] = []
        self.sizes: dict[tuple[int, int], int] = {}

    def shape(self, parents: list[int], tags: list[int]) -> tuple[list[list[int]], list[int]]:
        """Children of each node, and the number of each node's shape (equal shapes share it)."""
        children: list[list[int]] = [[] for _ in parents]
        for i, up in enumerate(parents):
            if up >= 0:
                children[up].append(i)
        shapes = [0] * len(parents)
        for i in range(len(parents) - 1, -1, -1):
            key = (tags[i], tuple(shapes[c] for c in children[i]))
            if key not in self.shapes:
                self.shapes[key] = len(self.trees)
                self.trees.append(key)
            shapes[i] = self.shapes[key]
        return children, shapes

    def table(self, a: tuple, b: tuple) -> np.ndarray:
        """The dynamic program over two child lists: rows by a, columns by b."""
        left, right = dict.fromkeys(a), dict.fromkeys(b)
        for shapes in (left, right):
            shapes.update({x: i for i, x in enumerate(shapes)})
        known = np.array([[self.size(x, y) for y in right] for x in left], np.int32).reshape(len(left), len(right))
        rows, columns = [left[x] for x in a], np.array([right[y] for y in b], np.int64)
        best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
        for i, row in enumerate(rows):
            np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + known[row][columns]), out=best[i + 1, 1:])
        return best

    def size(self, x: int, y: int) -> int:
        """Nodes matched between two shapes, 0 where their roots differ."""
        if self.trees[x][0] != self.trees[y][0]:
            return 0
        got = self.sizes.get((x, y))
        if got is None:
            a, b = self.trees[x][1], self.trees[y][1]
            same = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
            got = 1 + sum(self.size(p, p) for p in a[:same])  # equal first subtrees are best matched with each other
            got += int(self.table(a[same:], b[same:])[-1, -1]) if a[same:] and b[same:] else 0
            self.sizes[x, y] = got
        return got

    def pairs(self, left, right) -> list[tuple[int, int]]:
        """Matched (left node, right node) of two shaped trees, by tracing the programs back."""
        (ca, sa), (cb, sb) = left, right
        out, todo = [], [(0, 0)] if sa and sb and self.size(sa[0], sb[0]) else []
        while todo:
            i, j = todo.pop()
            out.append((i, j))
            a, b = ca[i], cb[j]
            if not a or not b:
                continue
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if sa[x] != sb[y]), min(len(a), len(b)))
            todo += zip(a[:same], b[:same])
            a, b = a[same:], b[same:]
            best = self.table(tuple(sa[x] for x in a), tuple(sb[y] for y in b))
            p, q = len(a), len(b)
            while p and q:
                if best[p, q] == best[p - 1, q]:
                    p -= 1
                elif best[p, q] == best[p, q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    todo.append((a[p], b[q]))
        return out


def aligned_blocks(matcher: Matcher, reference: dict, page: dict) -> list[tuple[int, int]]:
    """(block of the page, block of the reference, place among its node's blocks) for blocks at matched nodes."""
    by_node: dict[tuple[int, int], int] = {}
    seen: Counter = Counter()
    for k, place in enumerate(reference["places"]):
        by_node[place, seen[place]] = k
        seen[place] += 1
    mate = {j: i for i, j in matcher.pairs(reference["shaped"], page["shaped"])}
    out, seen = [], Counter()
    for k, place in enumerate(page["places"]):
        if place in mate and (mate[place], seen[place]) in by_node:
            out.append((k, by_node[mate[place], seen[place]]))
        seen[place] += 1
    return out


def with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


COMPACT = "parents array<int>, tags array<int>, blocks array<int>, places array<int>, hashes array<long>, words array<int>, triples array<long>"
KINDS = {"parents": pa.int32(), "tags": pa.int32(), "blocks": pa.int32(), "places": pa.int32(), "hashes": pa.int64(), "words": pa.int32(), "triples": pa.int64()}
REFERENCE = ("parents", "tags", "places")


def compact_trees(hosted: DataFrame) -> DataFrame:
    """(g, pid, page_id, page_hash, ...): g numbers host and layout, pid is never null."""

    def run(batches):
        for batch in slices(batches, 256):
            rows = [compact(Tree(x.decode("utf-8", "replace"))) for x in byte_rows(batch, "html")]
            g = [xxhash.xxh64_intdigest(host, r["layout"] & 0xFFFFFFFFFFFFFFFF) - (1 << 63) for host, r in zip(batch.column(0).to_pylist(), rows)]
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), *(batch.column(i) for i in (1, 2)), *(pa.array([r[f] for r in rows], pa.list_(t)) for f, t in KINDS.items())], ["g", "page_id", "page_hash", *KINDS])

    texts = hosted.where("host <> '' and html <> ''").select("host", "page_id", F.xxhash64("html").alias("page_hash"), "html")
    return texts.mapInArrow(run, f"g long, page_id long, page_hash long, {COMPACT}").withColumn("pid", id_of("page_id"))


def aligned(dealt: DataFrame, references: DataFrame) -> DataFrame:
    """The pages with `nodes`: for each kept block the reference's block it stands for, -1 for none."""

    def run(batches):
        sys.setrecursionlimit(1_000_000)  # trees may be as deep as pages are long
        matcher, held, reference = Matcher(), None, None
        for batch in slices(batches, 256):
            if len(matcher.trees) > 200_000 or len(matcher.sizes) > 1_000_000:
                matcher, held = Matcher(), None
            nodes = []
            for row in batch.to_pylist():
                if row["g"] != held:
                    held, reference = row["g"], {f: row["ref_" + f] for f in REFERENCE}
                    reference["shaped"] = matcher.shape(reference["parents"], reference["tags"])
                row["shaped"] = matcher.shape(row["parents"], row["tags"])
                mates = dict(aligned_blocks(matcher, reference, row))
                nodes.append([mates.get(k, -1) for k in range(len(row["places"]))])
            names = ["g", "part", "page_id", "page_hash", "blocks", "hashes", "words", "triples"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(nodes, pa.list_(pa.int32()))], [*names, "nodes"])

    schema = "g long, part int, page_id long, page_hash long, blocks array<int>, hashes array<long>, words array<int>, triples array<long>, nodes array<int>"
    return dealt.join(references, ["g", "part"]).mapInArrow(run, schema)


def template_blocks(hosted: DataFrame, share: float = TEMPLATE_SHARE, least: int = STORIES) -> DataFrame:
    """(page_id, page_hash, gone): the blocks of each page that are template, for pages that have any."""
    trees = cut(compact_trees(hosted))
    counted = cut(trees.groupBy("g").agg(F.min(F.struct("pid", "page_hash")).alias("at"), F.count("*").alias("pages")).where("pages > 1"))
    total = counted.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    # a layout with more than one in LARGE_HOSTS of all pages (there are fewer than that) is dealt out in as many parts as its share holds
    large = F.broadcast(counted.where(F.col("pages") * LARGE_HOSTS > total).select("g", F.ceil(F.col("pages") * LARGE_HOSTS / max(1, total)).cast("int").alias("parts")))
    parted = lambda rows: rows.join(large, "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    in_all_parts = lambda rows: parted(rows).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    first = trees.join(counted.select("g", "at.*"), ["g", "pid", "page_hash"], "left_semi").dropDuplicates(["g"])
    references = in_all_parts(first.select("g", *[F.col(f).alias("ref_" + f) for f in REFERENCE]))
    dealt = parted(trees).withColumn("part", F.pmod(F.xxhash64("page_id", "page_hash"), "parts").cast("int"))
    pages = cut(aligned(dealt.drop("parts", "pid"), references))

    def listed(blocks: DataFrame) -> DataFrame:
        """pages with `known`: those of their layout's (node, hash) in blocks; a layout has at most its nodes / share of them."""
        lists = blocks.groupBy("g").agg(F.collect_list(F.struct("node", "hash")).alias("known"))
        return pages.join(in_all_parts(lists), ["g", "part"])

    own = F.arrays_zip(F.col("nodes").alias("node"), F.col("hashes").alias("hash"))
    texts = cut(pages.select("g", F.explode(own).alias("b")).where("b.node >= 0").groupBy("g", "b.node", "b.hash").count())
    nodes = texts.groupBy("g", "node").agg(F.sum("count").alias("all"))
    maybe = cut(texts.where("count > 1").join(nodes, ["g", "node"]).where(F.col("count") >= share * F.col("all")).select("g", "node", "hash"))

    whole = F.arrays_zip("nodes", "hashes", "blocks", "words", "triples")
    hit = lambda b: F.array_contains("known", F.struct(b["nodes"].alias("node"), b["hashes"].alias("hash")))
    split = listed(maybe).withColumn("fixed", F.filter(whole, hit)).withColumn("free", F.filter(whole, lambda b: ~hit(b)))
    words = lambda name: F.aggregate(name, F.lit(0), lambda n, b: n + b["words"])
    told = split.where((words("free") > 0) & (words("free") * OWN_SHARE >= words("free") + words("fixed")))
    told = cut(told.select("g", F.array_min(F.col("free")["triples"]).alias("story"), F.array_distinct(F.transform("fixed", lambda b: F.struct(b["nodes"].alias("node"), b["hashes"].alias("hash")))).alias("fixed"), F.array_intersect("nodes", F.col("known")["node"]).alias("met")))
    stories = told.select("g", "story", F.explode("fixed").alias("b")).select("g", "b.*", "story").distinct().groupBy("g", "node", "hash").agg(F.count("*").alias("stories"))
    met = told.select("g", "story", F.explode("met").alias("node")).distinct().groupBy("g", "node").agg(F.count("*").alias("of"))
    template = cut(stories.join(met, ["g", "node"]).where(F.col("stories") >= F.greatest(F.lit(least), share * F.col("of"))).select("g", "node", "hash"))
    gone = F.transform(F.filter(F.arrays_zip("nodes", "hashes", "blocks"), hit), lambda b: b["blocks"])
    return listed(template).select("page_id", "page_hash", gone.alias("gone")).where(F.size("gone") > 0).dropDuplicates(["page_id", "page_hash"])


def extract(pages: DataFrame, share: float = TEMPLATE_SHARE, least: int = STORIES) -> DataFrame:
    """(page_id, url, text, blocks): blocks are the kept text blocks, joined by a space in text."""
    hosted = with_host(pages)
    gone = cut(template_blocks(hosted, share, least))
    if gone.count() <= BROADCAST_ROWS:  # else pages and blocks meet by a shuffle
        gone = F.broadcast(gone)

    def run(batches):
        for batch in slices(batches, 256):
            out = []
            for page, drop in zip(byte_rows(batch, "html"), batch.column(3).to_pylist()):
                tree, drop = Tree(page.decode("utf-8", "replace")), set(drop or ())
                out.append([tree.blocks[k][1] for k in tree.kept() if k not in drop])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([" ".join(x) for x in out]), pa.array(out, pa.list_(pa.string()))], ["page_id", "url", "text", "blocks"])

    rows = hosted.select("page_id", "url", "html", F.xxhash64("html").alias("h"))
    joined = rows.join(gone, rows["page_id"].eqNullSafe(gone["page_id"]) & (rows["h"] == gone["page_hash"]), "left").select(rows["page_id"], "url", "html", "gone")
    return joined.mapInArrow(run, "page_id long, url string, text string, blocks array<string>")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
