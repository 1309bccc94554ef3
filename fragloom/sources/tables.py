"""Canonical tables of the engine, derived from the given Parquet tables, and their codecs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a fragment must satisfy to be stored.
FRAGMENT_SCHEMA = "content_hash string, model_id string, layer_start int, layer_end int, token_start int, token_end int, size bigint, ttl double, reuse_score double, version_id int"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokens(text: Column) -> Column:
    """Words between white space, each as the number of the first seven hex digits of its MD5."""
    words = F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("prompt_id"), F.col("lang").alias("model_id"), F.col("source").alias("tenant"), word_tokens(F.col("text")).alias("tokens"))


def prompt_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, model_id, length): prompts with their number of words, which needs no word hashed."""
    n = F.size(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w != ""))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("prompt_id"), F.col("lang").alias("model_id"), n.alias("length"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as token arrays, in order."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", word_tokens(F.col("text")).alias("tokens"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, content_hash, kind, k, ts): events as accesses to fragments; ts in seconds."""
    events = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    rows = events.select(F.col("user_id").alias("session_id"), "event_id", F.col("event_type").alias("kind"), k.alias("k"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("ts"), F.md5(F.concat_ws(":", "event_type", k.cast("string"))).alias("content_hash"))
    return rows.withColumn("seq", F.row_number().over(order))


def store(accessed: DataFrame) -> DataFrame:
    """A row for each fragment: size, times, count, ttl and reuse score."""
    k = F.max("k")
    return accessed.groupBy("content_hash").agg(F.max("kind").alias("kind"), k.alias("k"), F.count("*").alias("n"), F.min("ts").alias("inserted"), F.max("ts").alias("last_access")).select(
        "content_hash", "kind", "k", "n", "inserted", "last_access",
        (64 * (F.col("k") + 1)).alias("size"), (86400.0 * (F.col("k") % 40)).alias("ttl"), ((F.col("k") % 11) / 10).alias("reuse_score"),
    )


def inventory(accessed: DataFrame) -> DataFrame:
    """(node_id, content_hash, version_id): sessions dealt to eight nodes; the version counts accesses."""
    return accessed.groupBy(F.concat(F.lit("n"), F.pmod("session_id", F.lit(8)).cast("string")).alias("node_id"), "content_hash").agg(F.count("*").alias("version_id"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, seq, region, latency_ms, bandwidth_cost, gpu_load, memory_pressure, load): telemetry of suppliers as nodes."""
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("node_id"), key.alias("seq"), F.col("s_nationkey").alias("region"),
        ((key * 37 + 11) % 6000).cast("double").alias("latency_ms"), ((key * 3) % 10 / 10).alias("bandwidth_cost"),
        ((key * 7 + 3) % 100 / 100).alias("gpu_load"), ((key * 13 + 5) % 100 / 100).alias("memory_pressure"), ((key * 29 + 17) % 101 / 100).alias("load"),
    )


def lengths(spark: SparkSession, sf_dir: str, low: int = 128, high: int = 131072) -> DataFrame:
    """(length): request lengths, from prices within the model's range."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("long").alias("length")).where(F.col("length").between(low, high))


def valid_fragments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): sizes and ttls not below 0, reuse within 0 to 1, versions from 1."""
    fine = F.coalesce((F.col("size") >= 0) & (F.col("ttl") >= 0) & F.col("reuse_score").between(0, 1) & (F.col("version_id") >= 1), F.lit(False))
    return rows.where(fine), rows.where(~fine)


def to_json(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and the row as JSON, spans as pairs."""
    spans = [F.array("layer_start", "layer_end").alias("layer_range"), F.array("token_start", "token_end").alias("token_span")]
    return rows.select(*keys, F.to_json(F.struct("content_hash", "model_id", *spans, "size", "ttl", "reuse_score", "version_id")).alias("payload"))


def from_json(rows: DataFrame, *keys: str) -> DataFrame:
    schema = "content_hash string, model_id string, layer_range array<int>, token_span array<int>, size bigint, ttl double, reuse_score double, version_id int"
    x = rows.select(*keys, F.from_json("payload", schema).alias("x"))
    return x.select(*keys, "x.content_hash", "x.model_id", F.col("x.layer_range")[0].alias("layer_start"), F.col("x.layer_range")[1].alias("layer_end"), F.col("x.token_span")[0].alias("token_start"), F.col("x.token_span")[1].alias("token_end"), "x.size", "x.ttl", "x.reuse_score", "x.version_id")


def to_map(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and the row as map<string, string>, as a key-value store holds it."""
    names = [c.split()[0] for c in FRAGMENT_SCHEMA.split(", ")]
    return rows.select(*keys, F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]).alias("fields"))


def from_map(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, *[F.col("fields")[n].cast(t).alias(n) for n, t in (c.split() for c in FRAGMENT_SCHEMA.split(", "))])


GOSSIP = "node_id string, timestamp double, peers array<struct<node_id: string, host: string, port: int, healthy: boolean>>, fragment_locations map<string, array<string>>, inventory_digest map<string, int>"


def gossip_to_json(states: DataFrame, *keys: str) -> DataFrame:
    """keys and the state (node, time, peers, locations, digest) as JSON."""
    return states.select(*keys, F.to_json(F.struct("node_id", "timestamp", "peers", "fragment_locations", "inventory_digest")).alias("payload"))


def gossip_from_json(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.from_json("payload", GOSSIP).alias("x")).select(*keys, "x.*")


def random_lengths(rows: DataFrame, key: str, seed: int = 42, mu: float = 9.9, sigma: float = 1.0, low: int = 128, high: int = 131072, draws: int = 8) -> DataFrame:
    """rows with a log-normal `length` within low and high: the first of the row's draws that is, else its nearest bound.

    A draw turns two uniform numbers, from the MD5 of seed, key and turn, into a normal one."""
    uniform = lambda i, s: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string"))), s, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    normal = lambda i: F.sqrt(-2.0 * F.log(uniform(i, 1))) * F.cos(2.0 * math.pi * uniform(i, 17))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: F.floor(F.exp(F.lit(mu) + F.lit(sigma) * normal(i))).cast("long"))
    first = F.get(F.filter(drawn, lambda x: x.between(low, high)), F.lit(0))
    return rows.withColumn("length", F.coalesce(first, F.greatest(F.lit(low), F.least(F.lit(high), F.get(drawn, F.lit(0))))))
