"""The model's searches: one pass over the lengths, then some thousand derived rows.

Lengths fall in a bucket of the threshold grid; counts and sums by bucket (aggregated below the shuffle) and their
prefix sums over at most 254 buckets give every threshold's conditional means, and each is combined with the splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragloom.functions import throughput as T
from fragloom.operators.workload import mean_and_p90
from fragloom.sources.checkpoints import cut


def threshold_stats(lengths: DataFrame, keys: list[str] | tuple = ()) -> DataFrame:
    """keys with (threshold, fraction, mean_long, mean_short) for each threshold of the grid."""
    steps = (T.T_MAX - T.T_MIN) // T.T_STEP
    bucket = F.greatest(F.lit(0), F.least(F.lit(steps + 1), F.ceil((F.col("length") - T.T_MIN) / T.T_STEP).cast("int")))
    counted = lengths.groupBy(*keys, bucket.alias("b")).agg(F.count("*").alias("n"), F.sum("length").alias("s"))
    grid = lengths.sparkSession.range(steps + 2).select(F.col("id").cast("int").alias("b"))
    if keys:  # every key with every bucket of the grid
        grid = lengths.select(*keys).distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(steps + 1))))
    grid = grid.join(counted, [*keys, "b"], "left").fillna(0, ["n", "s"])
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = every.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    sums = grid.select(*keys, "b", F.sum("n").over(upto).alias("n"), F.sum("s").over(upto).alias("s"), F.sum("n").over(every).alias("all_n"), F.sum("s").over(every).alias("all_s"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.where(F.col("b") <= steps).select(
        *keys, (F.col("b") * T.T_STEP + T.T_MIN).alias("threshold"), part(F.col("all_n") - F.col("n"), F.col("all_n")).alias("fraction"),
        part(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")).alias("mean_long"), part(F.col("s"), F.col("n")).alias("mean_short"), F.col("all_n").alias("requests"),
    )


def with_stages(rows: DataFrame) -> DataFrame:
    """rows (threshold, fraction, mean_long, mean_short, n_p, n_d) with stage rates and lambda."""
    long = F.when(F.col("mean_long") > 0, F.bround("mean_long", 0)).otherwise(F.col("threshold")).cast("long")
    short = F.when(F.col("mean_short") > 0, F.bround("mean_short", 0)).otherwise(F.col("threshold")).cast("long")
    sized = rows.withColumn("long_length", long).withColumn("short_length", short)
    rated = sized.withColumn("theta_offload", T.offload_rate(F.lit(float(T.OFFLOAD_INSTANCES)), F.lit(T.EGRESS_GBPS), F.col("long_length")))
    rated = rated.withColumn("theta_local", T.local_rate(F.col("n_p").cast("double"), F.col("short_length"))).withColumn("theta_decode", T.decode_rate(F.col("n_d").cast("double")))
    return rated.withColumn("lambda", T.end_to_end(F.col("theta_offload"), F.col("theta_local"), F.col("theta_decode"), F.col("fraction")))


def grid_search(lengths: DataFrame, instances: int = T.LOCAL_INSTANCES) -> DataFrame:
    """The configuration of the highest rate; of equals the smallest threshold, then the smallest n_p."""
    splits = F.explode(F.sequence(F.lit(1), F.lit(instances - 1)))
    rows = threshold_stats(lengths).withColumn("n_p", splits).withColumn("n_d", F.lit(instances) - F.col("n_p"))
    return with_stages(rows).orderBy(F.col("lambda").desc(), "threshold", "n_p").limit(1)


def windowed_search(lengths: DataFrame, key: str, instances: int = T.LOCAL_INSTANCES) -> DataFrame:
    """grid_search for each value of `key` (a window of requests): counts by bucket, prefix sums within 254 buckets a key."""
    splits = F.explode(F.sequence(F.lit(1), F.lit(instances - 1)))
    rows = with_stages(threshold_stats(lengths, [key]).withColumn("n_p", splits).withColumn("n_d", F.lit(instances) - F.col("n_p")))
    found = rows.groupBy(key).agg(F.min(F.struct((-F.col("lambda")).alias("less"), "threshold", "n_p", "n_d", "lambda")).alias("x"))
    return found.select(key, "x.threshold", "x.n_p", "x.n_d", "x.lambda")


def homogeneous(lengths: DataFrame, instances: int = T.LOCAL_INSTANCES + T.OFFLOAD_INSTANCES) -> DataFrame:
    """The best split of local instances alone, at the mean length."""
    mean = lengths.agg(F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"))
    rows = mean.withColumn("length", F.when(F.col("mean") > 0, F.bround("mean", 0)).otherwise(32768).cast("long")).withColumn("n_p", F.explode(F.sequence(F.lit(1), F.lit(instances - 1)))).withColumn("n_d", F.lit(instances) - F.col("n_p"))
    rated = rows.withColumn("theta_local", T.local_rate(F.col("n_p").cast("double"), F.col("length"))).withColumn("theta_decode", T.decode_rate(F.col("n_d").cast("double")))
    return rated.withColumn("lambda", F.least("theta_local", "theta_decode")).orderBy(F.col("lambda").desc(), "n_p").limit(1)


def naive(lengths: DataFrame) -> DataFrame:
    """All requests offloaded, all local instances decoding."""
    mean = lengths.agg(F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"))
    rows = mean.withColumn("length", F.when(F.col("mean") > 0, F.bround("mean", 0)).otherwise(32768).cast("long"))
    rated = rows.withColumn("theta_offload", T.offload_rate(F.lit(float(T.OFFLOAD_INSTANCES)), F.lit(T.EGRESS_GBPS), F.col("length"))).withColumn("theta_decode", T.decode_rate(F.lit(float(T.LOCAL_INSTANCES))))
    return rated.withColumn("lambda", F.least("theta_offload", "theta_decode"))


RESULT = ["config_name", "lambda_max", "theta_offload", "theta_local", "theta_decode", "threshold", "num_offload", "n_p", "n_d", "mean_ttft", "p90_ttft", "bandwidth_gbps", "fraction", "mean_long", "mean_short"]


def simulate(lengths: DataFrame) -> DataFrame:
    """Three rows: selective offloading, local only, all offloaded, with their rates and times to first token."""
    best = cut(grid_search(lengths))
    routed = lengths.crossJoin(F.broadcast(best.select("threshold")))
    times = routed.select(T.first_token_seconds(F.col("length"), F.when(F.col("length") <= F.col("threshold"), "pd-p").otherwise("offload")).alias("t"))
    ttft = mean_and_p90(times, [], "t").select(F.coalesce("mean", F.lit(0.0)).alias("mean_ttft"), F.coalesce("p90", F.lit(0.0)).alias("p90_ttft"))
    zero = F.lit(0.0)
    selective = best.crossJoin(ttft).select(
        F.lit("selective").alias("config_name"), F.col("lambda").alias("lambda_max"), "theta_offload", "theta_local", "theta_decode", F.col("threshold").cast("long").alias("threshold"), F.lit(T.OFFLOAD_INSTANCES).alias("num_offload"), "n_p", "n_d",
        "mean_ttft", "p90_ttft", T.egress_gbps(F.col("lambda"), F.col("fraction"), F.col("long_length")).alias("bandwidth_gbps"), "fraction", "mean_long", "mean_short",
    )
    h = homogeneous(lengths)
    t = T.first_token_seconds(F.col("length"), F.lit("pd-p"))
    local = h.select(F.lit("homogeneous").alias("config_name"), F.col("lambda").alias("lambda_max"), zero.alias("theta_offload"), "theta_local", "theta_decode", F.lit(0).cast("long").alias("threshold"), F.lit(0).alias("num_offload"), "n_p", "n_d", t.alias("mean_ttft"), t.alias("p90_ttft"), zero.alias("bandwidth_gbps"), zero.alias("fraction"), F.col("mean").alias("mean_long"), F.col("mean").alias("mean_short"))
    n = naive(lengths)
    t = T.first_token_seconds(F.col("length"), F.lit("offload"))
    whole = n.select(F.lit("naive").alias("config_name"), F.col("lambda").alias("lambda_max"), "theta_offload", zero.alias("theta_local"), "theta_decode", F.lit(0).cast("long").alias("threshold"), F.lit(T.OFFLOAD_INSTANCES).alias("num_offload"), F.lit(0).alias("n_p"), F.lit(T.LOCAL_INSTANCES).alias("n_d"), t.alias("mean_ttft"), t.alias("p90_ttft"), T.egress_gbps(F.col("lambda"), F.lit(1.0), F.col("length")).alias("bandwidth_gbps"), F.lit(1.0).alias("fraction"), F.col("mean").alias("mean_long"), zero.alias("mean_short"))
    return selective.unionByName(local).unionByName(whole).select(*RESULT)
