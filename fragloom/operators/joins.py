"""The joins that carry the engine's own physics: closed intervals, bands, as-of successors, the best k of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_range(low: Column, high: Column, width: int) -> Column:
    return F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long"))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], width: int, left_span=("start", "stop"), right_span=("q_start", "q_stop")) -> DataFrame:
    """Pairs whose closed intervals meet, with equal `on` columns: an equi-join on buckets of `width`.

    A pair that meets in several buckets is kept in the first one only, so no distinct is needed."""
    a = left.withColumn("_bucket", F.explode(bucket_range(F.col(left_span[0]), F.col(left_span[1]), width)))
    b = right.withColumn("_bucket", F.explode(bucket_range(F.col(right_span[0]), F.col(right_span[1]), width)))
    met = a.join(b, [*on, "_bucket"]).where((F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(left_span[1]) >= F.col(right_span[0])))
    first = F.floor(F.greatest(F.col(left_span[0]), F.col(right_span[0])) / width)
    return met.where(F.col("_bucket") == first).drop("_bucket")


def adjacent_join(spans: DataFrame, points: DataFrame, on: list[str], gap: int = 0) -> DataFrame:
    """Spans that begin within `gap` at or after a point, or end within `gap` at or before it; a span comes once."""
    width = gap + 1
    ends = F.array_distinct(F.array(F.floor(F.col("start") / width), F.floor(F.col("stop") / width)))
    a = spans.withColumn("_bucket", F.explode(ends))
    near = points.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("position") / width) - 1, F.floor(F.col("position") / width) + 1)))
    after, before = F.col("start") - F.col("position"), F.col("position") - F.col("stop")
    hit = a.join(near, [*on, "_bucket"]).where(after.between(0, gap) | before.between(0, gap))
    return hit.drop("_bucket").distinct()


def overlap_counts(spans: DataFrame, probes: DataFrame, on: list[str], width: int = 32) -> DataFrame:
    """probes with `hits`, `least` and `most`: how many spans meet each (as overlap_join has it, with repeats), their
    smallest start and their largest stop. A probe that no span meets gives no row.

    Pairs are counted, not made: of the spans that start by the probe's end, those that stop before it begins do not
    meet it. Running sums go over the different days of a key, however many spans lie on them. A span or probe that ends
    before it begins is not an interval; those few go through overlap_join."""
    probe = ["q_start", "q_stop"]
    asked = probes.select(*on, *probe).distinct()
    spans, odd = spans.where("start <= stop"), spans.where("stop < start")
    at = lambda c, *more: spans.groupBy(*on, F.col(c).alias("_at")).agg(F.count("*").alias("_n"), *more)
    ask = lambda c: asked.where("q_start <= q_stop").select(*on, F.col(c).alias("_at")).distinct()
    up, down = Window.partitionBy(*on).orderBy(F.col("_at")), Window.partitionBy(*on).orderBy(F.col("_at").desc())  # ranges: equal days count together
    before = Window.partitionBy(*on).orderBy("_at", F.col("_n").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)  # a probe's day comes before the stops on it
    begun = at("start", F.max("stop").alias("_most")).unionByName(ask("q_stop"), True).select(*on, "_at", F.sum("_n").over(up).alias("_begun"), F.max("_most").over(up).alias("most"), F.col("_n").isNull().alias("_ask"))
    ends = at("stop", F.min("start").alias("_least")).unionByName(ask("q_start"), True)
    ended = ends.select(*on, "_at", F.sum("_n").over(before).alias("_ended"), F.min("_least").over(down).alias("least"), F.col("_n").isNull().alias("_ask"))
    found = asked.where("q_start <= q_stop")
    found = found.join(begun.where("_ask").select(*on, F.col("_at").alias("q_stop"), "_begun", "most"), [*on, "q_stop"])
    found = found.join(ended.where("_ask").select(*on, F.col("_at").alias("q_start"), "_ended", "least"), [*on, "q_start"])
    found = found.select(*on, *probe, (F.coalesce("_begun", F.lit(0)) - F.coalesce("_ended", F.lit(0))).alias("hits"), "least", "most").where("hits > 0")
    pairs = overlap_join(odd, asked, on, width).unionByName(overlap_join(spans, asked.where("q_stop < q_start"), on, width))
    pairs = pairs.groupBy(*on, *probe).agg(F.count("*").alias("hits"), F.min("start").alias("least"), F.max("stop").alias("most"))
    both = found.unionByName(pairs).groupBy(*on, *probe).agg(F.sum("hits").alias("hits"), F.min("least").alias("least"), F.max("most").alias("most"))
    return probes.join(both, [*on, *probe])


def adjacent_counts(spans: DataFrame, points: DataFrame, on: list[str], probe: str, gap: int = 0) -> DataFrame:
    """(probe, hits): how many different spans adjacent_join finds for each probe; positions are whole numbers.

    Different spans that share key, start and stop are counted first and then stand at the 2 (gap + 1) positions that
    they are adjacent to, so no pair is made. Only probes with several different points go through adjacent_join, as a
    span that two of them reach counts once."""
    own = [c for c in spans.columns if c not in on]
    near = lambda a, b: F.when(a.isNotNull(), F.sequence(a, b)).otherwise(F.array().cast("array<long>"))
    start, stop = F.col("start").cast("long"), F.col("stop").cast("long")
    weights = spans.distinct().groupBy(*on, "start", "stop").agg(F.count("*").alias("_n"))
    places = weights.withColumn("position", F.explode(F.array_distinct(F.concat(near(start - gap, start), near(stop, stop + gap)))))
    counts = places.groupBy(*on, "position").agg(F.sum("_n").alias("hits"))
    point = F.struct(*on, "position")
    per = points.groupBy(probe).agg(F.min(point).alias("_a"), F.max(point).alias("_b"))
    several = per.where("not (_a <=> _b)").select(F.col(probe).alias("_probe"))
    alone = per.where("_a <=> _b").select(probe, "_a.*").join(counts, [*on, "position"]).select(probe, "hits")
    pairs = adjacent_join(spans, points.join(several, points[probe].eqNullSafe(F.col("_probe")), "left_semi"), on, gap).select(probe, *own).distinct()
    return alone.unionByName(pairs.groupBy(probe).agg(F.count("*").alias("hits")))


def gaps(spans: DataFrame, keys: list[str], length: str) -> DataFrame:
    """(keys, gap_start, gap_end): the stretches of 0 .. length-1 that no span covers."""
    ends = spans.groupBy(*keys).agg(F.max(length).alias(length)).select(*keys, length, F.col(length).cast("long").alias("start"), F.col(length).cast("long").alias("stop"))
    rows = spans.select(*keys, length, F.greatest(F.lit(0), F.col("start")).cast("long").alias("start"), F.least(F.col("stop"), F.col(length) - 1).cast("long").alias("stop")).union(ends)
    before = Window.partitionBy(*keys).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    open_at = F.coalesce(F.max("stop").over(before), F.lit(-1)) + 1
    return rows.withColumn("gap_start", open_at).where(F.col("gap_start") < F.col("start")).select(*keys, "gap_start", (F.col("start") - 1).alias("gap_end"))


def covered(spans: DataFrame, keys: list[str], length: str) -> DataFrame:
    """(keys, length, covered, ratio): positions of 0 .. length-1 that spans cover; ratio 1 for an empty length."""
    open_places = gaps(spans, keys, length).groupBy(*keys).agg(F.sum(F.col("gap_end") - F.col("gap_start") + 1).alias("_open"))
    total = spans.groupBy(*keys).agg(F.max(length).alias(length))
    out = total.join(open_places, keys, "left").withColumn("covered", F.col(length) - F.coalesce("_open", F.lit(0)))
    return out.select(*keys, length, "covered", F.when(F.col(length) > 0, F.col("covered") / F.col(length)).otherwise(1.0).alias("ratio"))


def best(rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group (a group limit reaches below the shuffle)."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)
