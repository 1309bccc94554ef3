"""Line dedup through a sharded minimal perfect hash.

A line's key is the line without the six ASCII white-space bytes at both ends, A-Z lower-cased; keys of at least
MIN_CHARS code points that two or more documents hold lose all their lines but those in the smallest doc_id. Keys are
known by 128-bit hashes. All distinct hashes are dealt to shards; each shard builds a minimal perfect hash whose slots
index compact arrays: a 32-bit fingerprint and a document count (one byte, saturating) for each hash, and the first
document for each one that several documents hold. A document's own lines are all in the index, so a probe reads the
slot's count, and its first document where the count says that there are others.

Where the arrays of all shards are at most BROADCAST_BYTES, every document task holds them and probes in the pass that
writes the kept lines: no line is shuffled again. Beyond that, probes go to the tasks of their shard; a shard that
would get more than PART_PROBES probes is copied to as many tasks as that takes, so no line floods one.

Defined cases: null or empty text is one empty line; a null id counts as the largest id and comes back null; rows that
share an id are one document (each comes back by itself); an empty table gives an empty result; other columns are
ignored by line_report and kept by drop_repeated_lines, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.llm.common import byte_rows, cut, id_back, id_of, slices

MIN_CHARS, SHARD_KEYS, BROADCAST_BYTES, PART_PROBES, LOAD = 10, 16_384, 32_000_000, 500_000, 1.5
SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, None where it is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def line_hashes(lines: list[bytes], min_chars: int = MIN_CHARS) -> list[bytes | None]:
    digest = xxhash.xxh3_128_digest
    return [None if (key := line_key(x, min_chars)) is None else digest(key) for x in lines]


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


# --- minimal perfect hash: levels of bit arrays; a key's slot is the rank of its bit

def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    z = h1.view(np.uint64) ^ (h2.view(np.uint64) * np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def mph_build(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """One bit array a level, for distinct key pairs: a key takes its bit where no other key of the level wants it."""
    levels = []
    while len(h1):
        size = max(8, int(LOAD * len(h1)))
        at = (_mixed(h1, h2, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        h1, h2 = h1[~alone[at]], h2[~alone[at]]
    return levels


def mph_ranks(levels: list[np.ndarray]) -> list[np.ndarray]:
    """For each bit of each level, how many set bits of all levels come before and with it."""
    ends = np.cumsum([0, *(len(x) for x in levels)])
    ranks = np.cumsum(np.concatenate([np.zeros(0, bool), *levels]), dtype=np.int32)
    return [ranks[a:b] for a, b in zip(ends, ends[1:])]


def mph_slots(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray, ranks: list[np.ndarray] | None = None) -> np.ndarray:
    """A key's slot; -1 where the key cannot be one that was built in."""
    out, rest, ranks = np.full(len(h1), -1, np.int64), np.arange(len(h1)), ranks or mph_ranks(levels)
    for k, bits in enumerate(levels):
        at = (_mixed(h1[rest], h2[rest], k) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        out[rest[hit]] = ranks[k][at[hit]] - 1
        rest = rest[~hit]
    return out


def index_arrays(h1: np.ndarray, h2: np.ndarray, first: np.ndarray, count: np.ndarray) -> dict:
    """A shard: the bit arrays and their sizes, fingerprints and counts in slot order, first documents of shared lines."""
    levels = mph_build(h1, h2)
    order = np.empty(len(h1), np.int64)
    order[mph_slots(levels, h1, h2)] = np.arange(len(h1))
    counts = np.minimum(count, 255).astype(np.uint8)[order]
    packed = b"".join(np.packbits(x).tobytes() for x in levels)
    return {"sizes": np.array([len(x) for x in levels], np.int64).tobytes(), "bits": packed, "prints": fingerprints_of(h1[order]).tobytes(), "counts": counts.tobytes(), "firsts": first[order][counts > 1].tobytes()}


def fingerprints_of(h1: np.ndarray) -> np.ndarray:
    return (h1.view(np.uint64) >> np.uint64(32)).astype(np.uint32)


class Index:
    """Looks keys up in one shard's arrays."""

    def __init__(self, sizes: bytes, bits: bytes, prints: bytes, counts: bytes, firsts: bytes):
        raw, at, self.levels = np.frombuffer(bits, np.uint8), 0, []
        for size in np.frombuffer(sizes, np.int64):
            to = at + (int(size) + 7) // 8
            self.levels.append(np.unpackbits(raw[at:to], count=int(size)).astype(bool))
            at = to
        self.ranks = mph_ranks(self.levels)
        self.prints, self.counts = np.frombuffer(prints, np.uint32), np.frombuffer(counts, np.uint8)
        self.firsts, self.places = np.frombuffer(firsts, np.int64), np.cumsum(self.counts > 1, dtype=np.int32) - 1

    def counted(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents that hold the key, 0 for an unknown one; the first of them where there are two or more, else -1)."""
        slots = mph_slots(self.levels, h1, h2, self.ranks)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == fingerprints_of(h1[known])
        count, first = np.zeros(len(h1), np.int64), np.full(len(h1), -1, np.int64)
        count[known] = self.counts[slots[known]]
        several = count > 1
        first[several] = self.firsts[self.places[slots[several]]]
        return count, first


class Shards:
    """All shards in one task, opened when they are first probed."""

    def __init__(self, rows: dict[int, tuple], shards: int):
        self.rows, self.shards, self.open = rows, shards, {}

    def gone(self, ids: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which of the (document, line) probes are lines that an earlier document holds."""
        out, shard = np.zeros(len(ids), bool), np.mod(h2, self.shards)
        order = np.argsort(shard, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
            number = int(shard[some[0]])
            if number not in self.open:
                self.open[number] = Index(*self.rows[number])
            count, first = self.open[number].counted(h1[some], h2[some])
            out[some] = (count > 1) & (first != ids[some])
        return out


# --- Spark stages

def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(id_of().alias("id"), F.col("text").cast("string").alias("text"))


def _held(ids: list[int], texts: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, h1, h2) of the distinct lines of each document."""
    owners, digests = [], []
    for i, text in zip(ids, texts):
        own = {x for x in line_hashes(text.split(b"\n"), min_chars) if x}
        digests += own
        owners += [i] * len(own)
    pairs = _pairs(digests)
    return np.array(owners, np.int64), np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def distinct_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, first, n): all distinct line hashes, their smallest document and in how many documents they are."""

    def run(batches):
        for batch in slices(batches):
            ids, h1, h2 = _held(batch.column(0).to_pylist(), byte_rows(batch), min_chars)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(ids)], ["h1", "h2", "id"])

    held = _texts(docs).mapInArrow(run, "h1 long, h2 long, id long").groupBy("h1", "h2")
    return held.agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).select("h1", "h2", "first", F.when(F.col("first") < F.col("last"), F.greatest("n", F.lit(2))).otherwise(1).alias("n"))


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """One row a shard: its perfect hash, its arrays, and the probes that it will get."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = index_arrays(*(pdf[c].to_numpy(np.int64) for c in ("h1", "h2", "first", "n")))
        return pd.DataFrame([{"shard": key[0]} | made | {"probes": int(pdf["n"].sum())}])

    sharded = lines.withColumn("shard", F.pmod("h2", F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInPandas(build, "shard int, sizes binary, bits binary, prints binary, counts binary, firsts binary, probes long")


ARRAYS = ("sizes", "bits", "prints", "counts", "firsts")


def shared_index(docs: DataFrame, min_chars: int, limit: int):
    """(index, shards, broadcast): the index table; broadcast holds a Shards' rows where all arrays are at most `limit` bytes."""
    lines = cut(distinct_lines(docs, min_chars))
    shards = 1 + lines.count() // SHARD_KEYS
    index = cut(build_index(lines, shards))
    size = index.agg(F.sum(sum(F.length(c) for c in ARRAYS))).first()[0] or 0
    if size > limit:
        return index, shards, None
    rows = {r["shard"]: tuple(bytes(r[c]) for c in ARRAYS) for r in index.select("shard", *ARRAYS).collect()}
    return index, shards, docs.sparkSession.sparkContext.broadcast(rows)


def drops(docs: DataFrame, index: DataFrame, shards: int, min_chars: int, part_probes: int) -> DataFrame:
    """(id, gone): for each document that loses lines, the first hash halves of their keys; probes go to their shards."""
    crowded = index.where(F.col("probes") > part_probes).select("shard", F.ceil(F.col("probes") / part_probes).cast("int").alias("parts"))
    parts = dict(crowded.toLocalIterator())  # a pair for each PART_PROBES probes at most

    def probes(batches):
        for batch in slices(batches):
            ids, h1, h2 = _held(batch.column(0).to_pylist(), byte_rows(batch), min_chars)
            shard = np.mod(h2, shards)
            part = np.mod(_mixed(ids, h1, 0), np.array([parts.get(s, 1) for s in shard.tolist()], np.uint64)).astype(np.int32) if parts else np.zeros(len(ids), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard.astype(np.int32), part, ids, h1, h2)], ["shard", "part", "id", "h1", "h2"])

    def probe(probed: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        ids, h1, h2 = (probed[c].to_numpy(np.int64) for c in ("id", "h1", "h2"))
        if not len(shard) or not len(ids):
            return pd.DataFrame({"id": ids[:0], "h1": h1[:0]})
        count, first = Index(*(shard.iloc[0][c] for c in ARRAYS)).counted(h1, h2)
        gone = (count > 1) & (first != ids)
        return pd.DataFrame({"id": ids[gone], "h1": h1[gone]})

    asked = _texts(docs).mapInArrow(probes, "shard int, part int, id long, h1 long, h2 long").groupBy("shard", "part")
    copies = F.greatest(F.lit(1), F.ceil(F.col("probes") / part_probes)).cast("int")
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), copies - 1))).select("shard", "part", *ARRAYS).groupBy("shard", "part")
    found = asked.cogroup(held).applyInPandas(probe, "id long, h1 long")
    return found.groupBy("id").agg(F.collect_set("h1").alias("gone"))


def _kept(text: bytes, gone: set, min_chars: int) -> tuple[list[bytes], int]:
    lines = text.split(b"\n")
    if not gone:
        return lines, len(lines)
    return [x for x, h in zip(lines, line_hashes(lines, min_chars)) if h is None or int.from_bytes(h[:8], "little", signed=True) not in gone], len(lines)


def _filtered(rows: DataFrame, docs: DataFrame, min_chars: int, limit: int, part_probes: int, schema: str, write) -> DataFrame:
    """rows (id, text, ...) through write(batch, [(kept lines, number of lines)]), by either route."""
    index, shards, everywhere = shared_index(docs, min_chars, limit)

    def alone(batches):
        held = Shards(everywhere.value, shards)
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), byte_rows(batch)
            numbers, h1, h2 = _held(list(range(len(ids))), texts, min_chars)
            gone = held.gone(np.array(ids, np.int64)[numbers], h1, h2)
            drop: dict[int, set] = {}
            for n, h in zip(numbers[gone].tolist(), h1[gone].tolist()):
                drop.setdefault(n, set()).add(h)
            yield write(batch, [_kept(t, drop.get(n, ()), min_chars) for n, t in enumerate(texts)])

    def joined(batches):
        for batch in slices(batches):
            lists = batch.column(batch.num_columns - 1).to_pylist()
            yield write(batch, [_kept(t, set(g or ()), min_chars) for t, g in zip(byte_rows(batch), lists)])

    if everywhere:
        return rows.mapInArrow(alone, schema)
    return rows.join(drops(docs, index, shards, min_chars, part_probes), "id", "left").select(*rows.columns, "gone").mapInArrow(joined, schema)


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, limit: int = BROADCAST_BYTES, part_probes: int = PART_PROBES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): kept is the text that stays."""

    def write(batch, rows):
        kept = pa.array([b"\n".join(k) for k, _ in rows], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in rows], pa.int64()), pa.array([n - len(k) for k, n in rows], pa.int64()), kept], ["id", "n_lines", "n_dropped", "kept"])

    out = _filtered(_texts(docs), docs, min_chars, limit, part_probes, "id long, n_lines long, n_dropped long, kept string", write)
    return out.select(id_back("id").alias("doc_id"), "n_lines", "n_dropped", "kept")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, limit: int = BROADCAST_BYTES, part_probes: int = PART_PROBES) -> DataFrame:
    """docs with the lines gone from text (and n_chars, where there is one, counted anew); a text may be left empty."""
    packed = f"row_{uuid.uuid4().hex}"  # the other columns travel as one, so their names cannot clash
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(id_of().alias("id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0), *[F.col(c) for c in rest]).alias(packed))
    schema = rows.select("text", packed).schema

    def write(batch, rows):
        kept = pa.array([b"\n".join(k) for k, _ in rows], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([kept, batch.column(2)], ["text", packed])

    out = _filtered(rows, docs, min_chars, limit, part_probes, schema, write)
    chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in rest else {}
    return out.select(*[F.col("text") if c == "text" else chars.get(c, F.col(packed)[c]).alias(c) for c in docs.columns])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_report(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT keyed.*, first_doc IS NOT NULL AND first_doc <> doc_id AS gone FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
