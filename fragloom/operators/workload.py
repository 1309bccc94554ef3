"""Access patterns, sessions, reuse, versions and request statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragloom.sources.checkpoints import cut

BROADCAST_ROWS = 10_000


def patterns(accessed: DataFrame) -> DataFrame:
    """(content_hash, n, first_seq, frequency)"""
    counted = accessed.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).withColumn("frequency", F.col("n") / F.col("total")).drop("total")


def top_patterns(accessed: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent, ties by first appearance."""
    return patterns(accessed).orderBy(F.col("n").desc(), "first_seen").limit(k)


def reuse_ratio(accessed: DataFrame, keys: list[str]) -> DataFrame:
    """keys with the share of accesses that repeat an earlier one; 0 without accesses."""
    return accessed.groupBy(*keys).agg(F.count("*").alias("accesses"), F.count_distinct("content_hash").alias("distinct_hashes")).withColumn("reuse_ratio", F.coalesce(F.try_divide(F.col("accesses") - F.col("distinct_hashes"), F.col("accesses")), F.lit(0.0)))


def histories(accessed: DataFrame) -> DataFrame:
    """(session_id, history): each session's hashes in order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "content_hash")))
    return accessed.groupBy("session_id").agg(F.transform(ordered, lambda x: x["content_hash"]).alias("history"))


def reuse_probability(accessed: DataFrame, window: int = 10) -> DataFrame:
    """Each access with the share of its session's last `window` accesses, itself included, that are to its hash.

    The window is short, so it is gathered as an array and counted there."""
    recent = Window.partitionBy("session_id").orderBy("seq").rowsBetween(-(window - 1), 0)
    rows = accessed.withColumn("_last", F.collect_list("content_hash").over(recent))
    return rows.withColumn("probability", F.size(F.filter("_last", lambda h: h == F.col("content_hash"))) / F.size("_last")).drop("_last")


def value_density(fragments: DataFrame, accessed: DataFrame, importance: float = 1.0) -> DataFrame:
    """(session_id, content_hash, value): expected reuse of each fragment that a session accessed, in that session; a row
    with a null session gives the fragment's value in all other sessions.

    reuse score, plus 0.05 for each access and 0.1 for the last one, at most 1."""
    counts = accessed.groupBy("session_id", "content_hash").agg(F.count("*").alias("count"), F.max("seq").alias("seq"))
    last = accessed.groupBy("session_id").agg(F.max("seq").alias("seq"), F.lit(0.1).alias("latest"))
    scores = fragments.select("content_hash", "reuse_score")
    touched = counts.join(last, ["session_id", "seq"], "left").join(scores, "content_hash")
    value = F.least(F.lit(1.0), F.col("reuse_score") + F.col("count") * 0.05 + F.coalesce("latest", F.lit(0.0))) * importance
    base = scores.select(F.lit(None).cast(dict(accessed.dtypes)["session_id"]).alias("session_id"), "content_hash", (F.least(F.lit(1.0), F.col("reuse_score")) * importance).alias("value"))
    return touched.select("session_id", "content_hash", value.alias("value")).union(base)


def nearest_rank(rows: DataFrame, keys: list[str], value: str, share: float, few: int = 100_000, buckets: int = 1024) -> DataFrame:
    """keys with the value of rank ceil(share * n), exact. The range that holds it is narrowed by counts in buckets until a
    key has at most `few` rows left there, so no task orders all rows of a key."""
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.lit(0).alias("_all"), F.col(value).alias("_v"))
    keys = [*keys, "_all"]
    state = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    state = cut(state.withColumn("_rank", F.ceil(F.col("_n") * share)))
    near = lambda s: F.broadcast(s) if s.count() <= BROADCAST_ROWS else s
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    wide = (F.col("_low") < F.col("_high")) & (F.col("_n") > few)
    while not state.where(wide).isEmpty():
        bucket = F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * (buckets - 1)).cast("int")
        counts = rows.join(near(state.where(wide).select(*keys, "_low", "_high", "_rank")), keys).where(inside).groupBy(*keys, "_rank", bucket.alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        hit = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
        state = cut(state.where(~wide).unionByName(hit.select(*keys, "_n", "_low", "_high", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))))
    left = rows.join(near(state.where("_low < _high").drop("_n")), keys).where(inside)
    found = left.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_v"))).where("_r = _rank")
    return found.select(*keys, "_v").union(state.where("_low = _high").select(*keys, "_low")).withColumnRenamed("_v", value).drop("_all")


def mean_and_p90(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and nearest-rank 90th percentile."""
    p90 = nearest_rank(rows, keys, value, 0.9).withColumnRenamed(value, "p90")
    means = rows.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return means.join(p90, keys, "left") if keys else means.join(p90, F.lit(True), "left")


def conditional_means(rows: DataFrame, threshold: Column, keys: list[str]) -> DataFrame:
    """(share above, mean above, mean up to the threshold); 0 where nothing is."""
    above = F.col("length") > threshold
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*keys).agg(zero(F.avg(above.cast("int"))).alias("fraction"), zero(F.avg(F.when(above, F.col("length")))).alias("mean_long"), zero(F.avg(F.when(~above, F.col("length")))).alias("mean_short"))


def moving_average(rows: DataFrame, keys: list[str], order: list[str], value: str, window: int = 100) -> DataFrame:
    recent = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(window - 1), 0)
    return rows.withColumn("average", F.avg(value).over(recent))


def adjusted_threshold(rows: DataFrame, keys: list[str], order: list[str], base: int, congestion: float = 0.85, most: int = 131072) -> DataFrame:
    """keys with the threshold after all samples (average, queue_ratio) in order: raised by a tenth under congestion,
    else relaxed by a hundredth down to the base, whole tokens at each step."""
    step = lambda t, x: F.when((x["average"] >= congestion) | (x["queue_ratio"] >= 1.0), F.least(F.floor(t * 1.10), F.lit(most))).when(t > base, F.greatest(F.floor(t * 0.99), F.lit(base))).otherwise(t).cast("long")
    samples = F.array_sort(F.collect_list(F.struct(*order, "average", "queue_ratio")))
    return rows.groupBy(*keys).agg(F.aggregate(samples, F.lit(base).cast("long"), step).alias("threshold"))


def latest_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("prefix_hash").agg(F.max("version_id").alias("version_id"))


def repeated_version_ids(versions: DataFrame) -> DataFrame:
    """Ids that an append-only chain must refuse."""
    return versions.groupBy("version_id").count().where("count > 1").select("version_id")
