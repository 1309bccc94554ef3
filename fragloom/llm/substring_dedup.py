"""Suffix-array dedup of long repeated byte strings by column-wise multi-document construction.

Every string of LENGTH bytes that also starts anywhere else loses all bytes that it covers. Building one suffix array
over whole texts takes a round for each byte of the longest text, and each round reads the whole transform; so the
collection is first cut into pieces that can be judged apart. Each window of LENGTH bytes picks the smallest hash among
its GRAM-byte grams (leftmost of equals), which depends on the window alone: equal windows pick the same gram at the
same place. Neighbouring windows with one pick form a piece, and only pieces with the same gram, aligned at it, can
share a window.

The pieces of one gram are a small collection. Columns are inserted from the last to the first, one symbol a piece and
round: the pieces' order by their suffixes (the permutation of the Burrows-Wheeler transform) is refined by a stable
sort of the new symbols, and the common prefixes of neighbours follow from the range minima of the round before. A
window stands elsewhere when its common prefix with a neighbour reaches LENGTH. Equal pieces are counted, not compared.
The pieces lie in checkpointed tables, dealt by gram and read in sequence; a task holds one batch of columns at a time.

A gram with more than CROWD different pieces is not gathered: its pieces are cut again by the narrower WIDTHS, keyed by
the bytes that all windows of a narrow piece share, down to single windows, which are counted.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; a null id comes back null; rows that repeat
a text are elsewhere to each other and each comes back; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragloom.llm.common import byte_rows, cut, id_back, id_of, slices

LENGTH, GRAM, CROWD, WIDTHS, CHUNK = 400, 32, 2048, (64, 8, 1), 1 << 18
BASE, SLOTS = 0x9E3779B97F4A7C15 | 1, 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base & 0xFFFFFFFFFFFFFFFF, np.uint64))])


class Cutter:
    """Cuts texts into pieces: windows that pick the same gram."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.span = length, gram, length - gram + 1
        most = CHUNK + length + 1
        self.up, self.back = _powers(BASE, most), _powers(pow(BASE, -1, 1 << 64), most)

    def grams(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[self.gram :] - sums[: n + 1 - self.gram]) * self.back[: n + 1 - self.gram]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def pieces(self, text: bytes) -> list[tuple[int, int, int, int, int]]:
        """(gram hash, content hash, start, number of windows, start less the gram's place) of each piece."""
        out, last = [], len(text) - self.length
        for at in range(0, last + 1, CHUNK):
            windows = min(CHUNK, last + 1 - at)
            h = self.grams(np.frombuffer(text, np.uint8, windows + self.length - 1, at))
            keyed = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(h), dtype=np.uint64)
            blocks = np.full(-(-len(keyed) // self.span) * self.span, np.uint64(0xFFFFFFFFFFFFFFFF))
            blocks[: len(keyed)] = keyed
            blocks = blocks.reshape(-1, self.span)
            ahead = np.minimum.accumulate(blocks, axis=1).ravel()
            behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
            picks = (np.minimum(behind[:windows], ahead[self.span - 1 : self.span - 1 + windows]) & np.uint64(SLOTS - 1)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], picks[1:] != picks[:-1]]))
            ends = np.append(starts[1:], windows)
            hashes = h[picks[starts]].view(np.int64)
            for g, s, e, p in zip(hashes.tolist(), starts.tolist(), ends.tolist(), picks[starts].tolist()):
                content = xxhash.xxh3_64_intdigest(text[at + s : at + e - 1 + self.length])
                out.append((g, content - (1 << 64) if content >> 63 else content, at + s, e - s, s - p))
        return out


def repeated_windows(group: np.ndarray, low: np.ndarray, count: np.ndarray, data: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which of its windows stand in another piece of its group. Pieces come sorted by group.

    low: the piece's first column in its group's alignment; count: its windows; data: count + length - 1 bytes."""
    m, base = len(group), int(low.min())
    first, last = low - base, low - base + count + length - 2
    columns = np.zeros((m, int(last.max()) + 1), np.uint8)
    for i, x in enumerate(data):
        columns[i, first[i] : last[i] + 1] = np.frombuffer(x, np.uint8)
    columns = np.ascontiguousarray(columns.T)
    found = np.zeros((len(columns), m), bool)
    entering, leaving = {}, {}
    for where, at in ((entering, last), (leaving, first - 1)):
        order = np.argsort(at, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            where[int(at[part[0]])] = part
    alive, order, common = np.zeros(m, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for c in range(len(columns) - 1, -1, -1):
        if (gone := leaving.get(c)) is not None and len(order):
            alive[gone] = False
            stay = np.flatnonzero(alive[order])
            common = np.minimum.reduceat(common[: stay[-1] + 1], np.concatenate([[0], stay[:-1] + 1])) if len(stay) else common[:0]
            order = order[stay]
        if (new := entering.get(c)) is not None:
            alive[new] = True
            order, common = np.concatenate([new, order]), np.concatenate([np.zeros(len(new), np.int64), common])
            by = np.argsort(group[order], kind="stable")
            order, common = order[by], common[by]
        if not len(order):
            continue
        keys = group[order] * 256 + columns[c, order]
        by = np.argsort(keys, kind="stable")
        keys, order = keys[by], order[by]
        same = np.flatnonzero(keys[1:] == keys[:-1])
        grown = np.zeros(len(order), np.int64)
        if len(same):
            spans = np.stack([by[same] + 1, by[same + 1] + 1], axis=1).ravel()
            grown[same + 1] = 1 + np.minimum.reduceat(np.append(common, 0), spans)[::2]
        common = np.minimum(grown, length)
        hit = np.flatnonzero(common >= length)
        found[c, order[hit]] = True
        found[c, order[hit - 1]] = True
    return [found[f : f + n, i] for i, (f, n) in enumerate(zip(first, count))]


def runs(flags: np.ndarray) -> list[int]:
    """Flat (from, to) pairs of the true stretches, to excluded."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).tolist()


def _compare(crowd: DataFrame, length: int) -> DataFrame:
    """(gk, ch, spans) for pieces (gk, ch, low, n, data) that share windows with others of their gk."""

    def judged(rows: list) -> pa.RecordBatch:
        numbers = {k: i for i, k in enumerate(dict.fromkeys(r[0] for r in rows))}
        flags = repeated_windows(np.array([numbers[r[0]] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), [r[4] for r in rows], length) if rows else []
        out = [(r[0], r[1], runs(f)) for r, f in zip(rows, flags) if f.any()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["gk", "ch", "spans"])

    def run(batches):
        held: list = []
        for batch in slices(batches, 8192):
            held += zip(*(batch.column(i).to_pylist() for i in range(5)))
            tail = next((i for i in range(len(held) - 1, -1, -1) if held[i][0] != held[-1][0]), -1) + 1
            if tail:
                yield judged(held[:tail])
                held = held[tail:]
        yield judged(held)

    return crowd.select("gk", "ch", "low", "n", "data").repartition("gk").sortWithinPartitions("gk").mapInArrow(run, "gk long, ch long, spans array<int>")


def _narrower(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """The pieces cut at multiples of width: (pgk, pch, shift, gk, ch, low, n, data); gk knows the bytes that all windows share."""

    def run(batches):
        for batch in slices(batches, 256):
            out = []
            for gk, ch, low, n, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for block in range(low // width, (low + n - 1) // width + 1):
                    a, b = max(low, block * width), min(low + n, (block + 1) * width)
                    s, e = (block + 1) * width - 1 - low, block * width + length - low
                    shared = data[s:e]
                    part = data[a - low : b - low + length - 1]
                    key = xxhash.xxh3_64_intdigest(shared, (gk ^ block * BASE) & 0xFFFFFFFFFFFFFFFF)
                    own = xxhash.xxh3_64_intdigest(part)
                    out.append((gk, ch, a - low, *(x - (1 << 64) if x >> 63 else x for x in (key, own)), a, b - a, part))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["pgk", "pch", "shift", "gk", "ch", "low", "n", "data"])

    return pieces.select("gk", "ch", "low", "n", "data").mapInArrow(run, "pgk long, pch long, shift int, gk long, ch long, low int, n int, data binary")


def _judge(unique: DataFrame, length: int, crowd: int, widths: tuple) -> DataFrame:
    """(gk, ch, spans) over pieces that differ within their gk: (gk, ch, low, n, data)."""
    sizes = unique.groupBy("gk").count().where("count > 1")
    known = cut(unique.join(sizes, "gk"))
    found = _compare(known.where(F.col("count") <= crowd), length)
    packed = known.where(F.col("count") > crowd)
    if not widths or packed.isEmpty():
        return found
    parts = cut(_narrower(packed, widths[0], length))
    kinds = parts.groupBy("gk", "ch").agg(F.count("*").alias("times"), F.first("low").alias("low"), F.first("n").alias("n"), F.first("data").alias("data"))
    kinds = cut(kinds)
    deeper = _judge(kinds, length, crowd, widths[1:]).select("gk", "ch", "spans")
    whole = kinds.where("times > 1").select("gk", "ch", F.array(F.lit(0), F.col("n")).alias("spans"))
    spans = deeper.join(whole, ["gk", "ch"], "left_anti").union(whole)
    shifted = parts.join(spans, ["gk", "ch"]).select("pgk", "pch", F.transform("spans", lambda x: x + F.col("shift")).alias("spans"))
    return found.union(shifted.groupBy(F.col("pgk").alias("gk"), F.col("pch").alias("ch")).agg(F.flatten(F.collect_list("spans")).alias("spans")))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(id_of().alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(id, th, spans): flat (from, to) byte pairs covered by repeated strings, for texts that have any."""
    rows = _rows(docs)

    def cut_up(batches):
        cutter = Cutter(length, gram)
        for batch in slices(batches):
            out = [(*x, i, th) for i, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_rows(batch)) for x in cutter.pieces(text)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["gk", "ch", "start", "n", "low", "id", "th"])

    made = cut(rows.mapInArrow(cut_up, "gk long, ch long, start long, n int, low int, id long, th long"))
    # equal pieces are counted below the shuffle, so that a gram with many of them does not gather their rows
    kinds = made.groupBy("gk", "ch").agg(F.count("*").alias("times"), F.min(F.struct("id", "th", "start", "n", "low")).alias("at"))
    mine = Window.partitionBy("gk")
    kinds = kinds.withColumn("differ", F.count("*").over(mine) > 1).withColumn("often", F.sum("times").over(mine) > 1)
    kinds = cut(kinds.where("often").select("gk", "ch", "times", "differ", "at.*"))
    wanted = kinds.where("differ").groupBy("id", "th").agg(F.collect_list(F.struct("gk", "ch", "low", "n", "start")).alias("wanted"))

    def fetch(batches):
        for batch in slices(batches, 128):
            out = []
            for text, wants in zip(byte_rows(batch), batch.column(1).to_pylist()):
                out += [(w["gk"], w["ch"], w["low"], w["n"], text[w["start"] : w["start"] + w["n"] - 1 + length]) for w in wants]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["gk", "ch", "low", "n", "data"])

    texts = rows.join(wanted, ["id", "th"]).select("text", "wanted").mapInArrow(fetch, "gk long, ch long, low int, n int, data binary").dropDuplicates(["gk", "ch"])
    partly = _judge(texts, length, crowd, tuple(w for w in WIDTHS if 2 * w <= length))
    whole = kinds.where("times > 1").select("gk", "ch", F.array(F.lit(0), F.col("n")).alias("spans"), "times")
    spans = partly.join(whole.select("gk", "ch"), ["gk", "ch"], "left_anti").union(whole.where(F.col("times") <= crowd).drop("times"))
    shift = F.zip_with("spans", F.sequence(F.lit(1), F.size("spans")), lambda x, i: x + F.col("start") + F.when(i % 2 == 0, length - 1).otherwise(0))
    # a piece with more than crowd places is told to its places by broadcast (at most one for every crowd rows), not gathered
    heavy = F.broadcast(whole.where(F.col("times") > crowd).drop("times"))
    light = made.join(heavy.select("gk", "ch"), ["gk", "ch"], "left_anti").join(spans, ["gk", "ch"])
    placed = light.unionByName(made.join(heavy, ["gk", "ch"])).select("id", "th", shift.alias("spans"))
    return placed.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept, kept_sha256): kept holds the remaining bytes."""

    def run(batches):
        for batch in slices(batches, 256):
            out = []
            for i, text, spans in zip(batch.column(0).to_pylist(), byte_rows(batch), batch.column(2).to_pylist()):
                gone, kept, at = merged(spans or []), [], 0
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]])
                out.append((i, len(text), len(text) - len(rest), len(gone), [x for s in gone for x in s], rest, hashlib.sha256(rest).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    joined = _rows(docs).join(covered(docs, length, gram, crowd), ["id", "th"], "left").select("id", "text", "spans")
    out = joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary, kept_sha256 string")
    return out.select(id_back("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans", "kept")
