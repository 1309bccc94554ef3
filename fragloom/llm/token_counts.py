"""Token counts by offset-mapped attribution.

Each whole document is encoded once. Its tokens' byte spans follow from the lengths of the tokens' byte strings, and
their character spans from those; they are merged with the document's section spans (both in order). A token that crosses a boundary goes, by the rule
"first", to the section that holds its first byte, or by "most" to the one that holds most of its bytes (the earlier of
equals). So a document's section counts always sum to its tokens.

Sections are the lines of a text; the newline belongs to the line that it ends. Other fields come in as `bounds`, an
array column of character offsets where sections start (offset 0 is always one).

The tokenizer is a public vocabulary file (ranks of a byte-level BPE), read by the driver from a path that is a
parameter and sent to the tasks; a vocabulary does not grow with the data.

Defined cases: null or empty text is one section without tokens; a null id is kept; repeated rows come back as often
as they came in; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.llm.common import byte_rows, id_back, id_of, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_made: dict[int, tuple] = {}


def encoder(ranks: bytes, pattern: str = PATTERN):
    """(encoding, length in bytes of each token), made once a process."""
    key = hash((ranks, pattern))
    if key not in _made:
        import tiktoken

        pairs = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        sizes = np.zeros(max(pairs.values()) + 1, np.int64)
        for token, rank in pairs.items():
            sizes[rank] = len(token)
        _made[key] = (tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=pairs, special_tokens={}), sizes)
    return _made[key]


def attribute(sizes: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, from token lengths and the sections' first offsets."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    owner = np.searchsorted(starts, begins, side="right") - 1
    if rule == "most":
        crossing = np.flatnonzero(np.searchsorted(starts, ends - 1, side="right") - 1 > owner)
        for t in crossing:
            cuts = [begins[t], *starts[(starts > begins[t]) & (starts < ends[t])], ends[t]]
            owner[t] += int(np.argmax(np.diff(cuts)))
    return np.bincount(owner, minlength=len(starts))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "first", bounds: str | None = None) -> DataFrame:
    """(doc_id, section, start, stop, start_byte, stop_byte, tokens, doc_tokens): a row for each section of each row of docs;
    start and stop count characters."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    if rule not in ("first", "most"):
        raise ValueError(rule)
    fields = [("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("start_byte", pa.int64()), ("stop_byte", pa.int64()), ("tokens", pa.int64()), ("doc_tokens", pa.int64())]

    def run(batches):
        encoding, lengths = encoder(ranks.value, pattern)
        for batch in slices(batches):
            given = batch.column(2).to_pylist() if bounds else [None] * batch.num_rows
            columns = [[] for _ in fields]
            for i, text, cuts in zip(batch.column(0).to_pylist(), byte_rows(batch), given):
                sizes = lengths[np.array(encoding.encode_ordinary(text.decode("utf-8", "replace")), np.int64)]
                data = np.frombuffer(text, np.uint8)
                places = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
                if bounds:
                    firsts = np.array(sorted({0, *(c for c in cuts or () if c is not None and 0 < c < len(places))}), np.int64)
                    starts = places[firsts] if len(places) else firsts
                else:
                    starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
                    firsts = np.searchsorted(places, starts)
                counts = attribute(sizes, starts, rule)
                for column, values in zip(columns, (np.full(len(starts), i), np.arange(len(starts)), firsts, np.append(firsts[1:], len(places)), starts, np.append(starts[1:], len(text)), counts, np.full(len(starts), len(sizes)))):
                    column.append(values)
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, (_, t) in zip(flat, fields)], [n for n, _ in fields])

    given = [F.col(bounds).cast("array<long>").alias("bounds")] if bounds else []
    known = docs.select(id_of().alias("doc_id"), F.col("text").cast("string").alias("text"), *given)
    out = known.mapInArrow(run, "doc_id long, section int, start long, stop long, start_byte long, stop_byte long, tokens long, doc_tokens long")
    return out.withColumn("doc_id", id_back("doc_id"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
