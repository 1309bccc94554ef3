"""Fragments back as the objects they were made from. What a fragment does not keep comes back as a placeholder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _count() -> Column:
    return F.col("token_end") - F.col("token_start") + 1


def _known(size: str = "size") -> list[Column]:
    """The identity that all four kinds share; the semantic hash is not kept, so the content hash stands for it."""
    return [F.col("content_hash"), F.col("content_hash").alias("semantic_hash"), F.col(size).alias("size_bytes"), F.col("reuse_score")]


def prefixes(fragments: DataFrame) -> DataFrame:
    """tokens holds the numbers from 0, as many as the span has."""
    places = F.when(_count() > 0, F.sequence(F.lit(0), (_count() - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return fragments.select(*_known(), _count().alias("token_count"), places.alias("tokens"))


def kv_segments(fragments: DataFrame) -> DataFrame:
    return fragments.select(*_known(), F.col("layer_start").alias("layer"), F.lit(0).alias("head"), "token_start", "token_end", F.array(F.lit(1), F.lit(1), F.lit(1)).alias("tensor_shape"))


def artifacts(fragments: DataFrame) -> DataFrame:
    return fragments.select(*_known(), _count().alias("token_count"), F.col("content_hash").alias("text_hash"), F.lit("").alias("source_url"))


def tool_traces(fragments: DataFrame) -> DataFrame:
    return fragments.select(*_known(), F.col("content_hash").alias("output_hash"), *[F.lit("").alias(c) for c in ("tool_name", "input_hash", "structured_output")])
