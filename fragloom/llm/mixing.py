"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations alone.

Targets: sources, ordered by code point (null last), weigh WEIGHTS in turn and share SHARE times all words; no target
passes CAP times its source's size, and what is over goes to the others by weight until none is above. Blocks of BLOCK
words are then allocated by highest quotients: first to sources by target, then within each source to its shards by
size. A shard's last block may be short, so a source gets as many more blocks as its target loses by them: words taken
would else fall short of it by up to two blocks a shard. In a shard, documents lie in a seeded order; a quota of q over n blocks takes every block q div n times and a
seeded q mod n of them once more. A document's taken words are those of its blocks' parts that lie in it.

apportion() finds the same seats as ranking all quotients would: one pass over the members sums the seats under a grid
of divisors, and only the quotients between two neighbouring divisors are ranked, by sorted ranges. No shard is dealt
more than CAP times its blocks; what it cannot take goes to the next quotients. So a source that holds a third of all
rows is many shards, and no task sees all of its documents, shards or quotients.

Defined cases: null text has size 0 and a taken of 0; a null source is a source of its own, last in order; null ids are
kept; repeated rows each have their own place in the order; an empty table gives an empty result; other columns are
ignored (kept by mix_documents, but for those named as the four it makes, which it replaces).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragloom.llm.common import cut, numbered

WEIGHTS, SHARE, CAP, BLOCK, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 16, 20240
SHARD_WORDS, SHARD_ROWS, GRID, BROADCAST_SOURCES = 65_536, 4096, 32, 100_000
SPACE = " \t\n\x0b\x0c\r"
#: A prime above any number of blocks in a shard, so that multiplying by it permutes them.
STEP = 2_654_435_761


def word_count(text):
    """Runs of other bytes than the six ASCII white-space ones; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, source_size, ...), one row each, with src (rank from 0), weight and target.

    The level that weights are multiplied by only rises, so a round needs no more than two sums."""
    ranked = numbered(sources, "src", F.col("source").asc_nulls_last()).withColumn("src", (F.col("src") - 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("src", F.lit(len(weights))) + 1)))
    most = F.col("source_size") * F.lit(float(cap))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > most
        spent, free, n = ranked.agg(F.coalesce(F.sum(F.when(over, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count_if(over)).first()
        if n == full or not free:
            break
        level, full = (share * total - spent) / free, n
    return ranked.withColumn("target", F.least(most, F.col("weight") * F.lit(level)))


def apportion(members: DataFrame, group: list[str], member: list[str], weight: str, seats: str, limit: str | None = None, grid: int = GRID) -> DataFrame:
    """members with `quota`: the group's seats dealt to its members by highest quotients weight / (2 s - 1), s from 1 to
    the member's limit.

    Ties go by the member columns. Every row of a group carries the group's seats. A group without weight gets none."""
    most = F.col(limit).cast("long") if limit else F.lit(1 << 62)
    per = members.groupBy(*group).agg(F.sum(F.col(weight)).cast("double").alias("_w"), F.count("*").alias("_n"), F.max(seats).alias("_h"))
    low, wide = F.greatest(F.lit(0.0), F.col("_h") - F.col("_n") / 2) / F.col("_w"), F.col("_n") / F.col("_w")
    held = lambda rate: F.least(most, F.floor(F.col(weight) * rate + 0.5))
    rated = members.join(per.where("_w > 0").withColumn("_low", low).withColumn("_step", 1.01 * wide / grid).drop("_w", "_n"), group)
    rate = lambda j: F.col("_low") + F.col("_step") * j
    sums = rated.groupBy(*group).agg(F.max("_h").alias("_goal"), *[F.sum(held(rate(j))).alias(f"_s{j}") for j in range(grid + 1)])
    at = F.greatest(F.lit(0), sum(F.when(F.col(f"_s{j}") <= F.col("_goal"), 1).otherwise(0) for j in range(grid + 1)) - 1)
    chosen = sums.select(*group, at.alias("_j"))
    # past the grid's end only limits hold seats back
    top = F.when(F.col("_j") < grid, held(rate(F.col("_j") + 1))).otherwise(most if limit else F.col("_base"))
    placed = cut(rated.join(chosen, group).withColumn("_base", held(rate(F.col("_j")))).withColumn("_top", top))
    short = placed.groupBy(*group).agg((F.max("_h") - F.sum("_base")).alias("_short"))
    extra = placed.where("_top > _base").select(*group, *member, weight, F.explode(F.sequence(F.col("_base") + 1, F.col("_top"))).alias("_s"))
    extra = extra.withColumn("_q", F.col(weight) / (2 * F.col("_s") - 1))
    ranked = cut(numbered(extra, "_r", *group, F.col("_q").desc(), *member, "_s"))
    first = ranked.groupBy(*group).agg(F.min("_r").alias("_first"))
    won = ranked.join(short.join(first, group), group).where("_r - _first < _short").groupBy(*group, *member).agg(F.count("*").alias("_more"))
    out = placed.join(won, [*group, *member], "left").withColumn("quota", F.col("_base") + F.coalesce("_more", F.lit(0)))
    return out.select(*members.columns, "quota")


def mixture(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """rows (id, source, size) with source_size, target and taken."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    targets = with_targets(sources, weights, share, cap)
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("source_rows") / SHARD_ROWS))
    whole = targets.agg(F.coalesce(F.round(F.sum("target") / block), F.lit(0)).cast("long").alias("h"), F.count("*").alias("n")).first()
    quotas = apportion(targets.withColumn("all", F.lit(0)).withColumn("seats", F.lit(whole.h)), ["all"], ["src"], "target", "seats")
    quotas = cut(targets.join(quotas.select("src", "quota"), "src", "left").select("source", "src", "source_size", "target", shards.alias("shards"), F.coalesce("quota", F.lit(0)).alias("source_quota")))
    few = F.broadcast(quotas) if whole.n <= BROADCAST_SOURCES else quotas
    placed = rows.join(few, rows["source"].eqNullSafe(quotas["source"])).drop(quotas["source"])
    placed = cut(placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("shards"))).withColumn("turn", F.xxhash64(F.lit(seed + 1), "id")))
    per = placed.groupBy("src", "shard").agg(F.sum("size").alias("shard_size"), F.max("source_quota").alias("source_quota"))
    blocks = F.ceil(F.col("shard_size") / block)
    per = cut(per.withColumn("n", blocks).withColumn("most", F.floor(blocks * cap)))
    short = per.groupBy("src").agg(F.sum("shard_size").alias("_words"), F.sum("n").alias("_blocks")).where("_words > 0").join(quotas.select("src", "target"), "src")
    short = short.select("src", F.round(F.col("target") * (F.col("_blocks") / F.col("_words") - F.lit(1.0 / block))).cast("long").alias("_short"))
    per = per.join(short, "src", "left").withColumn("source_quota", F.col("source_quota") + F.coalesce("_short", F.lit(0))).drop("_short")
    shares = apportion(per, ["src"], ["shard"], "shard_size", "source_quota", "most").select("src", "shard", "n", F.col("quota").alias("q"))
    order = Window.partitionBy("src", "shard").orderBy("turn", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("end", F.sum("size").over(order)).join(shares, ["src", "shard"], "left")
    start, end = F.col("end") - F.col("size"), F.col("end")
    shift = F.pmod(F.xxhash64(F.lit(seed + 2), "src", "shard"), F.col("n"))
    once_more = F.aggregate(
        F.sequence(F.floor(start / block), F.floor((end - 1) / block)), F.lit(0).cast("long"),
        lambda acc, b: acc + F.when(F.pmod(b * F.lit(STEP) + F.col("shift"), F.col("n")) < F.pmod("q", "n"), F.least(end, (b + 1) * block) - F.greatest(start, b * block)).otherwise(F.lit(0).cast("long")),
    )
    taken = F.when(F.col("size") > 0, F.col("size") * F.floor(F.col("q") / F.col("n")) + once_more).otherwise(F.lit(0))
    return laid.withColumn("shift", shift).withColumn("taken", F.coalesce(taken, F.lit(0)).cast("long"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    return mixture(cut(rows), **how).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


MADE = ("size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes words of: docs' own columns, then size, source_size, target and taken.

    Columns of docs that have one of these four names (in any case) are replaced. Rows that share an id stay together,
    with the largest of their taken words."""
    mixed = f"mix_{uuid.uuid4().hex}"
    share = mix(docs, **how).groupBy(F.col("doc_id").alias(mixed + "_id")).agg(F.struct(*[F.max(c).alias(c) for c in MADE]).alias(mixed))
    own = [F.col(c) for c in docs.columns if c.lower() not in MADE]
    kept = docs.join(share, docs["doc_id"].cast("long").eqNullSafe(share[mixed + "_id"])).where(F.col(mixed)["taken"] > 0)
    return kept.select(*own, *[F.col(mixed)[c].alias(c) for c in MADE])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def mix_targets(spark, sf_dir: str) -> DataFrame:
    """What of the mix SQL can express: each document's size, its source's size and target, and that the words taken of
    the source come within a block a shard of it."""
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sums = found.groupBy("source").agg(F.sum("taken").alias("source_taken"), F.max("target").alias("to"), F.max("source_size").alias("of")).select(F.col("source").alias("_source"), (F.abs(F.col("source_taken") - F.col("to")) <= BLOCK * (2 + F.col("of") / SHARD_WORDS)).alias("near_target"))
    out = found.join(sums, found["source"].eqNullSafe(sums["_source"]))
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 2 * F.col("size")).alias("within_twice"), "near_target")


TARGETS_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST(list_extract([5, 2, 1], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS DOUBLE) AS w FROM sources
), ordered AS (
  -- sources by how early a rising level fills them: those before in this order are full when one is filled
  SELECT *, sum(2.0 * source_size) OVER before AS full_before, sum(w) OVER (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after, 1.5 * sum(source_size) OVER () AS budget
  FROM weighed WINDOW before AS (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT arg_min((budget - coalesce(full_before, 0)) / w_after, 2.0 * source_size / w) FILTER ((budget - coalesce(full_before, 0)) / w_after * w <= 2.0 * source_size) AS level FROM ordered
)
SELECT doc_id, size, source_size, round(least(2.0 * source_size, w * level), 3) AS target, TRUE AS within_twice, TRUE AS near_target
FROM sized JOIN weighed ON sized.source IS NOT DISTINCT FROM weighed.source CROSS JOIN levels
"""
