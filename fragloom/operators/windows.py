"""Fragment windows: creating, splitting, merging and sizing them, and the chunks of a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragloom.functions.hashing import comma_hash, embedding, tuple_hash

BYTES_PER_TOKEN = 64


def slices_of(tokens: Column, width: int) -> Column:
    """array<array>: consecutive parts of `width` tokens, the last as long as what is left; none for no tokens."""
    n = F.size(tokens)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda i: F.slice(tokens, i * width + 1, width))).otherwise(F.array())


def token_windows(prompts: DataFrame, width: int = 1024, dialect: str = "tuple") -> DataFrame:
    """A row for each window: span (both ends within), hash, size. dialect "comma" gives the compute windows."""
    hashed = tuple_hash if dialect == "tuple" else comma_hash
    # outer, and empty ones dropped after it: a filter by tokens or slices would go below the projection that makes the
    # tokens, and there make them again for every slice
    rows = prompts.select("prompt_id", "model_id", "tenant", F.posexplode_outer(slices_of(F.col("tokens"), width)).alias("i", "part")).where("part is not null")
    start = F.col("i") * width
    return rows.select("prompt_id", "model_id", "tenant", start.cast("int").alias("token_start"), (start + F.size("part") - 1).cast("int").alias("token_end"), hashed(F.col("part")).alias("content_hash"), (F.size("part") * BYTES_PER_TOKEN).cast("long").alias("size"), F.col("part").alias("tokens"))


def split_windows(windows: DataFrame, points: Column) -> DataFrame:
    """Each window cut after the points strictly inside its span: a point is the last token of the left child.

    Windows carry their tokens; children hash their own."""
    inside = F.array_sort(F.array_distinct(F.filter(points, lambda p: (p > F.col("token_start")) & (p < F.col("token_end")))))
    starts = F.concat(F.array("token_start"), F.transform(inside, lambda p: p + 1))
    ends = F.concat(inside, F.array("token_end"))
    child = windows.withColumn("x", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))))
    part = F.slice("tokens", F.col("x.s") - F.col("token_start") + 1, F.col("x.e") - F.col("x.s") + 1)
    return child.select("prompt_id", F.col("x.s").alias("token_start"), F.col("x.e").alias("token_end"), tuple_hash(part).alias("content_hash"), ((F.col("x.e") - F.col("x.s") + 1) * BYTES_PER_TOKEN).cast("long").alias("size"))


def merge_windows(rows: DataFrame, group: list[str], order: list[str], most_reuse: float = 0.8) -> DataFrame:
    """Each group of fragments as one, where it may be: at least two, one model and layer range, without gap or
    overlap in order, and a mean reuse not above most_reuse. Other groups give no row."""
    w = Window.partitionBy(*group).orderBy(*order)
    linked = rows.withColumn("_ok", F.coalesce(F.col("token_start") == F.lag("token_end").over(w) + 1, F.lit(True)))
    merged = linked.groupBy(*group).agg(
        F.count("*").alias("parts"), F.count_distinct("model_id").alias("_m"), F.bool_and("_ok").alias("_ok"), F.min("token_start").alias("token_start"), F.max("token_end").alias("token_end"),
        F.sum("size").alias("size"), F.avg("reuse_score").alias("reuse_score"), F.max("version_id").alias("version_id"), F.min_by("ttl", F.struct(*order)).alias("ttl"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, "tokens"))), lambda x: x["tokens"])).alias("tokens"),
    )
    return merged.where("parts >= 2 and _m = 1 and _ok").where(F.col("reuse_score") <= most_reuse).drop("_m", "_ok").withColumn("content_hash", tuple_hash(F.col("tokens")))


def hash_chunks(rows: DataFrame, size: int = 64) -> DataFrame:
    """(content_hash, chunk_index, chunk): the hash text in pieces of `size` bytes."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("content_hash") - 1) / size).cast("int")), lambda i: F.substring(F.col("content_hash"), i * size + 1, F.lit(size)))
    return rows.select("content_hash", F.posexplode(parts).alias("chunk_index", "chunk"))


def sized_windows(windows: DataFrame, kv_size_mib: Column, total_tokens: Column) -> DataFrame:
    """Windows whose size is their tokens' share of the prompt's cache, at least one byte."""
    n = F.col("token_end") - F.col("token_start") + 1
    return windows.withColumn("size", F.greatest(F.lit(1), F.floor(n * (kv_size_mib * 1024.0 * 1024.0 / total_tokens)).cast("long")))


def compute_windows(prompts: DataFrame, embedder=None, width: int = 128) -> DataFrame:
    """Windows of the pluggable compute step: the comma dialect, layers 0 to 1, embedding (offset, length).

    embedder, if given, is a function over batches (mapInPandas) that adds its own embedding column."""
    made = token_windows(prompts, width, "comma").withColumn("embedding", F.array(F.col("token_start").cast("double"), F.size("tokens").cast("double")))
    if embedder is None:
        return made
    return made.mapInPandas(embedder, made.schema)


def as_fragments(rows: DataFrame, kind: str, content_hash: Column, token_start: Column, token_end: Column, size: Column, reuse: Column) -> DataFrame:
    """Prefixes, cache segments, artifacts and tool traces in the fragment's columns (ttl 3600, version 1)."""
    return rows.select(content_hash.alias("content_hash"), F.lit(kind).alias("model_id"), token_start.cast("int").alias("token_start"), token_end.cast("int").alias("token_end"), size.cast("long").alias("size"), F.lit(3600.0).alias("ttl"), reuse.cast("double").alias("reuse_score"), F.lit(1).alias("version_id"))
