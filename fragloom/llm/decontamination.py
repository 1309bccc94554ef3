"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-cased words joined by single spaces. An item of n characters may differ from a
passage by k = n * RATE edits; cut into k + 1 pieces, at least one piece stands unchanged in the passage. Exact piece
hits (an Aho-Corasick automaton over all pieces) name windows of the document; each window is verified with Myers'
bit-parallel distance, as the least number of edits that turn the item into any part of the window.

A benchmark of at most PASSES blocks of BLOCK_CHARS characters reaches the document tasks block by block, one pass over
the documents a block. A larger one is joined: the first GRAM characters of each piece are hashed, every document looks
its own grams up in a bitmap of 2^BITS bits that all tasks hold, those found are joined with the pieces by hash, and the
texts meet only their own candidates, in one pass whatever the benchmark's size. Both ways give the same rows.

An item of fewer than MIN_CHARS characters is looked for as it is (k = 0), between word bounds.

Defined cases: a null text matches nothing; an item that is null or holds no word cannot be found; of several nearest
passages the first counts; null ids are kept; repeated rows are judged each; an empty table on either side gives an
empty result; other columns are ignored (kept by drop_contaminated).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.llm.common import byte_rows, cut, id_back, id_of, slices

RATE, MIN_CHARS, BLOCK_CHARS, PASSES = 0.08, 24, 1_000_000, 4
GRAM, BITS, CHUNK = 8, 27, 1 << 16
WORDS = re.compile(r"\w+")


def plain(text: str) -> str:
    return " ".join(WORDS.findall(text.lower()))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 nearly equal parts."""
    n, parts = len(item), k + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks_of(item: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(item):
        found[c] = found.get(c, 0) | 1 << i
    return found


def myers(masks: dict[str, int], n: int, window: str, k: int) -> tuple[int, int]:
    """(distance, end): the least edits between the item and any part of the window; (k + 1, -1) where more than k."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, k + 1, -1
    for at, c in enumerate(window):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1, mh << 1
        up, down = (mh | ~(xv | ph)) & full, ph & xv & full
        if score < best:
            best, end = score, at + 1
    return best, end


class Matcher:
    """The pieces of a block of items, ready to scan documents."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, int(len(t) * rate) if len(t) >= MIN_CHARS else 0, masks_of(t)) for i, t in items]
        self.found: dict[str, list[tuple[int, int]]] = {}
        for slot, (_, t, k, _) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                self.found.setdefault(piece, []).append((slot, offset))
        self.scan = ahocorasick.Automaton()
        for piece, at in self.found.items():
            self.scan.add_word(piece, (len(piece), at))
        self.scan.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, start, stop, item_chars) of the nearest passage for each item found; places in the plain text."""
        spots: dict[int, list[int]] = {}
        for end, (size, at) in self.scan.iter(text):
            for slot, offset in at:
                spots.setdefault(slot, []).append(end + 1 - size - offset)
        out = []
        for slot, starts in spots.items():
            item, t, k, masks = self.items[slot]
            if len(t) < MIN_CHARS:
                starts = [s for s in starts if text[max(0, s - 1) : s] in ("", " ") and text[s + len(t) : s + len(t) + 1] in ("", " ")]
                out += [(item, 0, min(starts), min(starts) + len(t), len(t))] if starts else []
                continue
            best, place = k + 1, None
            low = high = None
            for s in [*sorted(starts), None]:
                if low is not None and (s is None or s - high > 2 * k):
                    a, b = max(0, low - k), min(len(text), high + len(t) + k)
                    d, stop = myers(masks, len(t), text[a:b], k)
                    if d < best:
                        best, place = d, (max(0, a + stop - len(t) - d), a + stop)
                    low = None
                if s is not None:
                    low, high = (s if low is None else low), s
            if place:
                out.append((item, best, *place, len(t)))
        return out


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """Lists of (item_id, plain text) of at most block_chars characters (a longer item alone), one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    held, size = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        text = plain(row.text)
        if not text:
            continue
        if held and size + len(text) > block_chars:
            yield held
            held, size = [], 0
        held.append((row.item_id, text))
        size += len(text)
    if held:
        yield held


def gram_keys(text: str, size: int) -> np.ndarray:
    """A hash of the `size` characters at each place of the text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.full(max(0, len(c) - size + 1), size, np.uint64)
    for i in range(size):
        h = (h ^ c[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def known_places(text: str, size: int, known: np.ndarray) -> list[tuple[int, int]]:
    """(key, place) of the grams whose bit is set."""
    out = []
    for at in range(0, len(text) - size + 1, CHUNK):
        keys = gram_keys(text[at : at + CHUNK + size - 1], size)
        bit = keys.view(np.uint64) >> np.uint64(64 - BITS)
        hit = np.flatnonzero(known[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
        out += zip(keys[hit].tolist(), (hit + at).tolist())
    return out


def joined(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """What contaminated gives, by joins on hashed grams of the pieces."""
    spark = docs.sparkSession
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    texts = docs.select(id_of().alias("id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("th", F.xxhash64("text"))

    def prepared(batches):
        for batch in slices(batches):
            out = [(i, t, int(len(t) * rate) if len(t) >= MIN_CHARS else 0) for i, t in ((i, plain(x.decode("utf-8", "replace"))) for i, x in zip(batch.column(0).to_pylist(), byte_rows(batch))) if t]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.string(), pa.int32()))], ["item_id", "item", "k"])

    def cut_up(batches):
        for batch in slices(batches):
            out = []
            for slot, item, k in zip(*(batch.column(j).to_pylist() for j in range(3))):
                for shift, piece in pieces(item, k):
                    size = min(GRAM, len(piece))
                    out.append((int(gram_keys(piece[:size], size)[0]), size, slot, shift, piece, len(item), k))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)], ["key", "size", "slot", "shift", "piece", "n", "k"])

    items = cut(given.mapInArrow(prepared, "item_id long, item string, k int").withColumn("slot", F.monotonically_increasing_id()))
    parts = cut(items.select("slot", "item", "k").mapInArrow(cut_up, "key long, size int, slot long, shift long, piece string, n int, k int"))
    sizes = sorted(r.size for r in parts.select(F.col("size").alias("size")).distinct().toLocalIterator())  # at most GRAM of them
    bit = F.shiftrightunsigned("key", 64 - BITS)
    words = parts.select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("at")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, at))").alias("bits")).toArrow()
    known = np.zeros(1 << (BITS - 6), np.uint64)  # 16 MB, whatever the benchmark
    known[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(known)

    def look_up(batches):
        for batch in slices(batches, 64):
            out = []
            for i, th, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_rows(batch)):
                text = plain(x.decode("utf-8", "replace"))
                out += ((i, th, key, at) for size in sizes for key, at in known_places(text, size, shared.value))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(4)], ["id", "th", "key", "at"])

    def made_plain(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([plain(x.decode("utf-8", "replace")) for x in byte_rows(batch)], pa.string())], ["id", "th", "text"])

    spots = texts.select("id", "th", "text").mapInArrow(look_up, "id long, th long, key long, at long").distinct()
    spots = spots.join(parts, "key").select("id", "th", "slot", "shift", "piece", "n", "k", (F.col("at") - F.col("shift")).alias("start"))
    margin = F.when(F.col("n") < MIN_CHARS, F.lit(1)).otherwise(F.col("k"))
    low = F.greatest(F.col("start") - margin, F.lit(0))
    met = spots.join(texts.select("id", "th", "text").mapInArrow(made_plain, "id long, th long, text string"), ["id", "th"])
    met = met.where(F.substring("text", F.col("start") + F.col("shift") + 1, F.length("piece")) == F.col("piece"))
    around = met.select("id", "th", "slot", "start", low.alias("low"), F.substring("text", low + 1, F.col("start") + F.col("n") + margin - low).alias("window"))

    def verify(batches):
        for batch in slices(batches, 4096):
            out = []
            for i, th, slot, start, low, window, item_id, item, k in zip(*(batch.column(j).to_pylist() for j in range(9))):
                n, at = len(item), start - low
                if n < MIN_CHARS:
                    whole = window[at : at + n] == item and window[max(0, at - 1) : at] in ("", " ") and window[at + n : at + n + 1] in ("", " ")
                    d, stop = (0, at + n) if whole else (1, -1)
                else:
                    d, stop = myers(masks_of(item), n, window, k)
                if d <= k:
                    out.append((i, th, slot, item_id, n, d, low + stop))
            kinds = (*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)], ["id", "th", "slot", "item_id", "n", "d", "stop"])

    tried = around.join(items, "slot").select("id", "th", "slot", "start", "low", "window", "item_id", "item", "k")
    found = tried.mapInArrow(verify, "id long, th long, slot long, item_id long, n int, d int, stop long")
    best = found.groupBy("id", "th", "slot").agg(F.min(F.struct("d", "stop")).alias("at"), F.first("item_id").alias("item_id"), F.first("n").alias("n"))
    times = texts.groupBy("id", "th").agg(F.count("*").cast("int").alias("times"))
    each = best.join(times, ["id", "th"]).select("id", "item_id", "n", "at", F.explode(F.sequence(F.lit(1), F.col("times"))))
    start = F.greatest(F.col("at.stop") - F.col("n") - F.col("at.d"), F.lit(0))
    return cut(each.select(id_back("id").alias("doc_id"), "item_id", F.col("at.d").alias("distance"), start.alias("start"), F.col("at.stop").alias("stop"), F.col("n").alias("item_chars")))


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, passes: int = PASSES) -> DataFrame:
    """(doc_id, item_id, distance, start, stop, item_chars): a row for each document and item found in it."""
    if (benchmark.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0) > block_chars * passes:
        return joined(docs, benchmark, rate)
    schema = "doc_id long, item_id long, distance int, start long, stop long, item_chars int"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = []
    for block in benchmark_blocks(benchmark, block_chars):

        def run(batches, block=block):
            matcher = Matcher(block, rate)
            for batch in slices(batches):
                rows = [(i, *m) for i, text in zip(batch.column(0).to_pylist(), byte_rows(batch)) for m in matcher.matches(plain(text.decode("utf-8", "replace")))]
                columns = list(zip(*rows)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "distance", "start", "stop", "item_chars"])

        parts.append(cut(texts.mapInArrow(run, schema)))
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs in which no item was found, in docs' own columns."""
    found = contaminated(docs, benchmark, rate).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_found"]), "left_anti")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
