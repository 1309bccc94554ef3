"""SimHash near-duplicates by pigeonhole blocks.

Fingerprint: the bits set in over half the XXH64 values of a text's word shingles. Two fingerprints at `distance` d or
less agree on all but d of b blocks, so they share b - d whole blocks; fingerprints meet on each choice of b - d blocks
and the Hamming distance decides. Only distinct fingerprints meet, so copies never make pairs. A bucket of more than
TILE fingerprints is dealt out as pairs of tiles, and a tile emits a spanning forest of its links, never all pairs.

Defined cases: null or empty text has fingerprint zero; a text with fewer words than a shingle hashes its whole word
sequence; a null id counts as the largest id and comes back as null; repeated rows come back as often as they came in;
an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.llm.common import byte_rows, connected_components, cut, id_back, id_of, slices, with_facts

WORDS, SEED, DISTANCE, TILE, SPLIT, FAN = 4, 42, 4, 4096, 15, 16
CHUNK = 65_536


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(x) + 1 for x in parts]).tolist()
    starts = [0, *ends[:-1]]
    span = min(words, len(parts))
    n = len(parts) - span + 1
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        h = np.array([digest(joined[i : j - 1], seed) for i, j in zip(starts[at:to], ends[at + span - 1 : to + span - 1])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, fp): a row for each row of docs; fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(x) for x in byte_rows(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select(id_of().alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _blocks(parts: int) -> list[tuple[int, int]]:
    """(shift, bits) of nearly equal blocks of 64 bits."""
    sizes = [64 // parts + (i < 64 % parts) for i in range(parts)]
    return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(parts: int, distance: int) -> list[int]:
    """The bits of each choice of parts - distance blocks."""
    return [sum(((1 << bits) - 1) << shift for shift, bits in chosen) for chosen in combinations(_blocks(parts), parts - distance)]


def _rest_masks(mask: int, distance: int) -> list[int]:
    """The same over the bits that mask leaves: distance + 2 nearly equal parts of them, each choice of two."""
    rest = [i for i in range(64) if not mask >> i & 1]
    parts = distance + 2
    cuts = [len(rest) * i // parts for i in range(parts + 1)]
    return [sum(1 << i for part in chosen for i in part) for chosen in combinations([rest[a:b] for a, b in zip(cuts, cuts[1:])], 2)]


def _keys(distinct: DataFrame, parts: int, distance: int) -> DataFrame:
    """(choice, key, sub, rest, fp): each fingerprint under each choice of blocks; sub is -1 (not cut further)."""
    made = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for i, m in enumerate(_masks(parts, distance))])
    return distinct.select("fp", F.explode(made).alias("k")).select("k.choice", "k.key", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("rest"), "fp")


def _further(keys: DataFrame, parts: int, distance: int) -> DataFrame:
    """keys cut by two further blocks of the bits that their choice leaves: what is linked still shares a key."""
    masks = F.array(*[F.array(*[F.lit(_signed(m)).cast("long") for m in _rest_masks(mask, distance)]) for mask in _masks(parts, distance)])
    made = keys.select("choice", "key", "fp", F.posexplode(masks[F.col("choice")]).alias("sub", "mask"))
    return made.select("choice", "key", "sub", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), "fp")


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join what is linked within fps, each to a node at most FAN-fold shared."""
    left, edges = np.unique(fps.view(np.uint64)), []
    while len(left) > 1:
        found, frontier, left = [left[:1]], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(frontier), 256):
                rest = np.flatnonzero(~near)
                hit = np.bitwise_count(frontier[at : at + 256, None] ^ left[None, rest]) <= distance
                near[rest[hit.any(axis=0)]] = True
            frontier, left = left[near], left[~near]
            found.append(frontier)
        nodes = np.concatenate(found).view(np.int64)
        edges += [(int(nodes[i]), int(nodes[(i - 1) // FAN])) for i in range(1, len(nodes))]
    return edges


def links(distinct: DataFrame, distance: int = DISTANCE, tile: int = TILE, split: int = SPLIT) -> DataFrame:
    """(a, b): edges whose components are those of all links among the distinct fingerprints (fp).

    A bucket of more than split tiles is first cut by two further blocks (as many copies as `split` tiles would make)."""
    n = distinct.count()
    parts = next((p for p in range(distance + 2, distance + 4) if n < 1 << (2 * 64 * (p - distance) // p) // 2), distance + 4)
    bucket = ["choice", "key", "sub", "rest"]

    def crowded(keys: DataFrame) -> DataFrame:
        return keys.groupBy(*bucket).count().where(F.col("count") > tile).select(*bucket, F.ceil(F.col("count") / tile).cast("int").alias("n"))

    keys = _keys(distinct, parts, distance)
    hot = cut(crowded(keys))
    if not (huge := hot.where(F.col("n") > split)).isEmpty():
        further = cut(_further(keys.join(huge.select(*bucket), bucket, "left_semi"), parts, distance))
        keys = keys.join(huge.select(*bucket), bucket, "left_anti").unionByName(further)
        hot = cut(hot.where(F.col("n") <= split).unionByName(crowded(further)))
    if hot.isEmpty():
        dealt = keys.withColumn("tile", F.lit(0).cast("long"))
    else:
        mine = F.pmod(F.xxhash64("fp"), F.col("n"))
        tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.least(i, mine) * 1_000_000 + F.greatest(i, mine))
        dealt = keys.join(hot, bucket, "left").select(*bucket, "fp", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(tiles)).alias("tile"))
    buckets = dealt.groupBy(*bucket, "tile").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy().cumsum()
            edges, at = [], 0
            for end in ends:
                some, at = values[at:end], end
                if len(some) > 2:
                    edges += forest(some, distance)
                elif (int(some[0]) ^ int(some[1])).__and__(0xFFFFFFFFFFFFFFFF).bit_count() <= distance:
                    edges.append((int(some[0]), int(some[1])))
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach, its own included."""
    marked = cut(fingerprints(docs))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(links(distinct.select("fp"), distance))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    classes = with_facts(rooted, least, "root", "fp").select("fp", "component")
    return marked.join(classes, "fp").select(id_back("id").alias("doc_id"), "fp", id_back("component").alias("component_id"))


def keep_one_per_group(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, in docs' own columns."""
    kept = simhash_groups(docs, distance).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
