"""Rebuilding a prompt's context from stored fragments.

Phases, all set-based by prompt: the longest stored prefix, forward extension by adjacent fragments, gaps, and windows
prefilled for long gaps. Extension picks, at each covered end, the fragment with the smallest start and hash, in
one fold over the spans of the prompt's model.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.operators.joins import best, covered, gaps


#: Hashes that a task holds before it hands them on.
BATCH = 16_384


def prefix_hashes(prompts: DataFrame, attempts: int | None = 128, ascending: bool = False, most: int | None = None) -> DataFrame:
    """(prompt_id, model_id, n, content_hash): hashes of about `attempts` prefixes, from the whole down, or from 1 up; of
    every prefix, if attempts is None.

    With `most`, only those of them with at most so many tokens, and no more tokens reach Python.

    Built-in functions would hash every prefix from its start; in Arrow batches one running hash serves all."""

    def made(rows):
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.string()))], ["prompt_id", "model_id", "n", "content_hash"])

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):  # a row at a time: a batch's numbers as Python objects take many times its size
                prompt, model, total = (batch.column(c)[i].as_py() for c in range(3))
                if total is None or total < 1:  # here, as a filter would make the tokens once more
                    continue
                tokens = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                step = max(1, total // attempts) if attempts else 1
                ends = range(1, total + 1, step) if ascending else range(total, 0, -step)[::-1]
                running, at = hashlib.md5(b"("), 0
                for n in ends:  # one pass: each prefix goes on from the hash of the one before
                    if most is not None and n > most:
                        break
                    running.update((", " if at else "").encode() + ", ".join(map(str, tokens[at:n].tolist())).encode())
                    whole, at = running.copy(), n
                    whole.update(b",)" if n == 1 else b")")
                    out.append((prompt, model, n, whole.hexdigest()))
                    if len(out) >= BATCH:
                        yield made(out)
                        out = []
            yield made(out)

    tokens = F.col("tokens") if most is None else F.slice("tokens", 1, most)
    rows = prompts.select(F.col("prompt_id").cast("long").alias("prompt_id"), "model_id", F.size("tokens").alias("total"), tokens.alias("tokens"))
    return rows.mapInArrow(run, "prompt_id long, model_id string, n int, content_hash string")


def longest_prefix(prompts: DataFrame, stored: DataFrame) -> DataFrame:
    """(prompt_id, n, content_hash): the longest prefix that a stored fragment of the prompt's model has.

    stored: (model_id, content_hash), and n, the fragment's number of tokens, if known. Every prefix is looked at that
    can be stored: where n is known of all fragments, those no longer than the longest of them."""
    known = F.when(F.count("*") == F.count("n"), F.coalesce(F.max("n"), F.lit(0)))
    most = stored.agg(known).first()[0] if "n" in stored.columns else None
    hits = prefix_hashes(prompts, None, most=most).join(stored.select("content_hash", "model_id").distinct(), ["content_hash", "model_id"])
    return hits.groupBy("prompt_id").agg(F.max("n").alias("n"), F.max_by("content_hash", "n").alias("content_hash"))


def prefix_fragments(prompts: DataFrame, stored: DataFrame, attempts: int = 128, owner: str | None = None) -> DataFrame:
    """(prompt_id, token_start, token_end, content_hash): the stored fragment that holds each prompt's longest stored
    prefix, of several the one with the smallest span. Its own span counts as covered, wherever it lies. With `owner`
    (as in `extend`) a prompt's own fragments do not count.

    Only prefixes as long as some stored fragment reach the join; there are no more such lengths than the longest
    fragment has tokens."""
    named, span = ["content_hash", "model_id"], F.struct("token_start", "token_end")
    if owner:
        each = stored.groupBy(*named, F.col(owner).cast("long").alias("owner")).agg(F.min(span).alias("span"))
        held = best(each, named, [F.col("span"), F.col("owner")], 2)
    else:
        held = stored.groupBy(*named).agg(F.min(span).alias("span")).withColumn("owner", F.lit(None).cast("long"))
    lengths = stored.select((F.col("token_end") - F.col("token_start") + 1).cast("int").alias("n")).distinct()
    tried = prefix_hashes(prompts, attempts, most=lengths.agg(F.max("n")).first()[0] or 0).join(F.broadcast(lengths), "n", "left_semi")
    hits = tried.join(held, named).where(~F.col("owner").eqNullSafe(F.col("prompt_id")))
    found = hits.groupBy("prompt_id").agg(F.min_by(F.struct("span", "content_hash"), F.struct(-F.col("n"), F.col("span"))).alias("x"))
    return found.select("prompt_id", "x.span.token_start", "x.span.token_end", "x.content_hash")


def extend(stored: DataFrame, ends: DataFrame, gap: int = 256, owner: str | None = None, group: int = 16_384) -> DataFrame:
    """(prompt_id, token_start, token_end, content_hash): fragments found forward of each prompt's covered end.

    ends: (prompt_id, model_id, length, at). A fragment of the prompt's model follows if it starts after the end by at
    most `gap`, and ends within the prompt; of several the smallest start, then hash. A model's different spans (the
    least hash of each stands for it: their number goes with positions, not with fragments) meet its prompts in tasks of
    about `group` prompts; there a walk looks only at the spans that start within `gap` of its end. With `owner` (the column of stored
    that names the prompt a fragment comes from) a prompt's own fragments do not follow in it: a span is then stood for by
    its least hash and by the least of another prompt."""
    at_span = ["model_id", "token_start", "token_end"]
    if owner:
        each = stored.groupBy(*at_span, F.col(owner).alias("owner")).agg(F.min("content_hash").alias("content_hash"))
        spans = best(each, at_span, [F.col("content_hash"), F.col("owner")], 2)
    else:
        spans = stored.groupBy(*at_span).agg(F.min("content_hash").alias("content_hash")).withColumn("owner", F.lit(None).cast("long"))

    def walk(asked: pa.Table, line: pa.Table) -> pa.Table:
        line = line.sort_by([("token_start", "ascending"), ("content_hash", "ascending"), ("token_end", "ascending")])
        starts, stops, owners = (line[c].fill_null(0).to_numpy() for c in ("token_start", "token_end", "owner"))
        named = [] if owner is None else line["owner"].is_valid().to_pylist()
        prompts, places = [], []
        for prompt, length, at in zip(*(asked[c].to_pylist() for c in ("prompt_id", "length", "at"))):
            i, last = np.searchsorted(starts, at, "right"), np.searchsorted(starts, at + gap, "right")
            while i < last:
                own = owner is not None and (owners[i] == prompt if named[i] else prompt is None)
                if own or stops[i] >= length:
                    i += 1
                    continue
                prompts.append(prompt)
                places.append(i)
                at = int(stops[i])
                i, last = max(i + 1, np.searchsorted(starts, at, "right")), np.searchsorted(starts, at + gap, "right")
        found = line.take(pa.array(places, pa.int64()))
        return pa.table({"prompt_id": pa.array(prompts, pa.int64()), "token_start": found["token_start"], "token_end": found["token_end"], "content_hash": found["content_hash"]})

    asked = ends.select(F.col("prompt_id").cast("long").alias("prompt_id"), "model_id", F.col("length").cast("int").alias("length"), F.col("at").cast("int").alias("at")).where("model_id is not null and length is not null and at is not null")
    parts = asked.groupBy("model_id").agg(F.ceil(F.count("*") / group).cast("int").alias("_parts"))  # a row a model
    dealt = asked.join(parts, "model_id").withColumn("_part", F.pmod(F.xxhash64("prompt_id"), F.col("_parts")).cast("int")).drop("_parts")
    lines = spans.join(parts, "model_id").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).where("token_start is not null and token_end is not null")
    lines = lines.select("model_id", "_part", F.col("token_start").cast("int").alias("token_start"), F.col("token_end").cast("int").alias("token_end"), "content_hash", F.col("owner").cast("long").alias("owner"))
    return dealt.groupBy("model_id", "_part").cogroup(lines.groupBy("model_id", "_part")).applyInArrow(walk, "prompt_id long, token_start int, token_end int, content_hash string")


def coverage(prompts: DataFrame, spans: DataFrame, most_gap: int = 256) -> tuple[DataFrame, DataFrame]:
    """(prompt_id, length, covered, ratio) and (prompt_id, gap_start, gap_end, prefill): what is covered and what is
    missing; gaps longer than most_gap are prefilled (and stay listed)."""
    length = prompts.select("prompt_id", "length" if "length" in prompts.columns else F.size("tokens").alias("length"))
    rows = length.join(spans, "prompt_id", "left").select("prompt_id", "length", F.coalesce(F.col("token_start"), F.lit(-2)).alias("start"), F.coalesce(F.col("token_end"), F.lit(-1)).alias("stop"))
    missing = gaps(rows, ["prompt_id"], "length").withColumn("prefill", F.col("gap_end") - F.col("gap_start") + 1 > most_gap)
    return covered(rows, ["prompt_id"], "length"), missing


def best_nodes(prompts: DataFrame, holders: DataFrame, loads: DataFrame, k: int = 3, attempts: int = 128) -> DataFrame:
    """(prompt_id, node_id, score, rank): nodes by prefix hashes held, less a tenth-part load penalty, above 0."""
    hits = prefix_hashes(prompts, attempts, ascending=True).select("prompt_id", "content_hash").distinct().join(holders, "content_hash").groupBy("prompt_id", "node_id").agg(F.count("*").alias("hits"))
    scored = hits.join(loads, "node_id").withColumn("score", F.greatest(F.lit(0), F.col("hits") - F.floor(F.col("load") * 10).cast("long"))).where("score > 0")
    return best(scored, ["prompt_id"], [F.col("score").desc(), F.col("seq")], k).select("prompt_id", "node_id", "score", "rank")
