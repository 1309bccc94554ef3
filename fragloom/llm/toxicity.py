"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a step are a word vector (hashed) and a character vector (mean of hashed character 3-, 4- and 5-grams); in
training half of the word vectors of a batch are left out, so that unseen forms are judged by characters. A text is cut
into overlapping windows of WINDOW words, STRIDE apart, up to its end; each window is scored and the text's score is
its highest window's. Labels are document-wide, so training takes, in each round after the first, the window of a
document that scores highest.

Training uses at most SAMPLE labelled documents (a documented bound: the first by a seeded hash) with all their windows,
none of them held out (crc32 of the doc_id as text, mod 3, equal to 1). Scoring covers every window of every text. The weights are a few hundred kB, whatever the input.

Defined cases: null or empty text is one empty window, whose pooled state is zero; a null id is not labelled, counts
as not held out and comes back null; repeated rows come back as often as they came in; without any labelled rows of
both kinds the score is 0 for all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.llm.common import byte_rows, slices

WINDOW, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM, WORD_ROWS, CHAR_ROWS = 48, 40, 8, 8, 16, 1 << 15, 1 << 15
SAMPLE, ROUNDS, STEPS, BATCH, RATE, SEED, THRESHOLD = 2500, 6, 500, 128, 0.01, 7, 0.7
CACHE_WORDS, SCORE_BATCH, MEAN_WORDS, FRESH_WORDS = 200_000, 2048, 16_384, 16_384
GRAMS = (3, 4, 5)
EDGES = b".,;:!?\"'()[]{}|*#-"


def windows(n: int) -> list[tuple[int, int]]:
    """(start, stop) of the windows over n words; one empty window for none."""
    starts = range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else range(1)
    return [(s, min(n, s + WINDOW)) for s in starts]


class Vocabulary:
    """Numbers distinct words and keeps the hashed features of each: a word row and its character gram rows."""

    def __init__(self):
        self.ids: dict[bytes, int] = {b"": 0}
        self.fresh: list[bytes] = [b""]

    def encode(self, text: bytes) -> list[int]:
        ids, fresh, out = self.ids, self.fresh, []
        for word in text.lower().split():
            i = ids.get(word)
            if i is None:
                i = ids[word] = len(ids)
                fresh.append(word)
            out.append(i)
        return out

    def take_fresh(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word rows, gram rows, number of grams) of the words that are new since the last call."""
        words, self.fresh = self.fresh, []
        parts = [self._features(words[i : i + FRESH_WORDS]) for i in range(0, max(1, len(words)), FRESH_WORDS)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    @staticmethod
    def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bare = [w.strip(EDGES) for w in words]
        rows = np.fromiter((zlib.crc32(w) & (WORD_ROWS - 1) for w in bare), np.int64, len(bare))
        sizes = np.fromiter((len(w) for w in bare), np.int64, len(bare)) + 2
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(b"^" + w + b"$" for w in bare) + b"\0" * 5, np.uint8).astype(np.uint32)
        owner = np.repeat(np.arange(len(bare)), sizes)
        left = np.repeat(starts + sizes, sizes) - np.arange(len(owner))
        code, codes, owners = np.zeros(len(owner), np.uint32), [], []
        for n in range(1, GRAMS[-1] + 1):
            code = (code ^ flat[n - 1 : n - 1 + len(owner)]) * np.uint32(16777619) + np.uint32(n)
            if n in GRAMS:
                whole = left >= n
                codes.append((code ^ (code >> np.uint32(15)))[whole] & np.uint32(CHAR_ROWS - 1))
                owners.append(owner[whole])
        owners, codes = np.concatenate(owners), np.concatenate(codes)
        return rows, codes[np.argsort(owners, kind="stable")].astype(np.int32), np.bincount(owners, minlength=len(bare))


def init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    one = {"word": small(WORD_ROWS, WORD_DIM) * 0.5, "char": small(CHAR_ROWS, CHAR_DIM)}
    for side in "fb":
        one |= {f"W{side}": small(d, 3 * h), f"U{side}": small(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}
    return one | {"A": small(2 * h, h), "a": small(h), "v": small(2 * h), "c": np.zeros(1, np.float32)}


def char_means(p, grams, counts) -> np.ndarray:
    """Mean gram vector of each word, MEAN_WORDS words at a time, which bounds what is gathered at once."""
    out, ends = np.zeros((len(counts), CHAR_DIM), np.float32), np.cumsum(counts)
    for at in range(0, len(counts), MEAN_WORDS):
        some = counts[at : at + MEAN_WORDS]
        first = int(ends[at] - counts[at])
        full = some > 0
        if full.any():
            starts = (ends[at : at + MEAN_WORDS] - some)[full] - first
            out[at : at + MEAN_WORDS][full] = np.add.reduceat(p["char"][grams[first : int(ends[at + len(some) - 1])]], starts, axis=0) / some[full, None]
    return out


def summed_at(rows: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(rows, d): the values (n, d) summed by their row."""
    out = np.zeros((rows, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        held = at[order]
        starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        out[held[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_side(pre, U, mask, keep: list | None = None):
    """States (T, n, h) of one direction over pre-activations (T, n, 3h); masked steps carry the state on."""
    h = U.shape[0]
    steps, n, _ = pre.shape
    state, out = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32)
    for t in range(steps):
        gates = sigmoid(pre[t, :, : 2 * h] + state @ U[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        lifted = r * state
        new = np.tanh(pre[t, :, 2 * h :] + lifted @ U[:, 2 * h :])
        if keep is not None:
            keep.append((state, z, r, lifted, new))
        state = state + mask[t][:, None] * z * (new - state)
        out[t] = state
    return out


def side_gradient(p, side, kept, mask, d_out, pre_grad):
    """Gradients of U and of the pre-activations, given those of the states."""
    U, h = p[f"U{side}"], HIDDEN
    dU, carry = np.zeros_like(U), np.zeros_like(d_out[0])
    for t in range(len(kept) - 1, -1, -1):
        state, z, r, lifted, new = kept[t]
        d = carry + d_out[t]
        dm = d * mask[t][:, None]
        d_new = dm * z * (1 - new * new)
        d_lift = d_new @ U[:, 2 * h :].T
        d_gate = np.concatenate([dm * (new - state) * z * (1 - z), d_lift * state * r * (1 - r)], axis=1)
        dU[:, 2 * h :] += lifted.T @ d_new
        dU[:, : 2 * h] += state.T @ d_gate
        pre_grad[t, :, : 2 * h], pre_grad[t, :, 2 * h :] = d_gate, d_new
        carry = d - dm * z + d_lift * r + d_gate @ U[:, : 2 * h].T
    return dU


def pooled(p, states, mask):
    """(logit, attention, hidden, context) from states (T, n, 2h)."""
    hidden = np.tanh(states @ p["A"])
    e = hidden @ p["a"] + (mask - 1) * 1e4
    e = np.exp(e - e.max(axis=0))
    weight = e * mask
    weight = weight / np.maximum(weight.sum(axis=0), 1e-9)
    context = np.einsum("tn,tnh->nh", weight, states)
    return context @ p["v"] + p["c"][0], weight, hidden, context


def scores(p, table_f, table_b, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Scores of windows: ids (n, T) of rows of the pre-activation tables."""
    mask = (np.arange(ids.shape[1])[:, None] < lengths[None, :]).astype(np.float32)
    forward = run_side(table_f[ids.T], p["Uf"], mask)
    backward = run_side(table_b[ids[:, ::-1].T], p["Ub"], mask[::-1])[::-1]
    return sigmoid(pooled(p, np.concatenate([forward, backward], axis=2), mask)[0])


def train(texts: list[list[bytes]], labels: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights from documents (lists of window texts) and their labels, by Adam on the windows' log loss: at least
    `rounds` rounds and STEPS steps, so that few labels are seen often enough."""
    rng, vocabulary = np.random.default_rng(seed), Vocabulary()
    p = init(rng)
    encoded = [[np.array(vocabulary.encode(w)[:WINDOW], np.int32) for w in doc] for doc in texts]
    rows, grams, counts = vocabulary.take_fresh()
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(encoded)), [len(d) for d in encoded])
    flat = [w for d in encoded for w in d]
    ids, lengths = np.zeros((len(flat), WINDOW), np.int32), np.array([len(w) for w in flat])
    for i, w in enumerate(flat):
        ids[i, : len(w)] = w
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = turn = 0
    while turn < rounds or step < STEPS:
        turn += 1
        if turn > 1:
            got = predict(p, rows, grams, counts, ids, lengths)
            order = np.lexsort((-got, owner))
            best = order[np.unique(owner[order], return_index=True)[1]]
            clean = np.flatnonzero(labels[owner] == 0)
            chosen = np.unique(np.concatenate([best, rng.permutation(clean)[: len(best)]]))
        else:
            chosen = np.arange(len(flat))
        for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // BATCH)):
            step += 1
            x, length, y = ids[part], lengths[part], labels[owner[part]].astype(np.float32)
            distinct, where = np.unique(x, return_inverse=True)
            where = where.reshape(x.shape)
            counted = counts[distinct]
            picks = np.repeat(starts[distinct] - (np.cumsum(counted) - counted), counted) + np.arange(counted.sum())
            kept_words = (rng.random(len(distinct)) < 0.5).astype(np.float32)[:, None]
            vectors = np.concatenate([p["word"][rows[distinct]] * kept_words, char_means(p, grams[picks], counted)], axis=1)
            mask = (np.arange(WINDOW)[:, None] < length[None, :]).astype(np.float32)
            at = {"f": where.T, "b": where[:, ::-1].T}
            masks, kept, states = {"f": mask, "b": mask[::-1]}, {"f": [], "b": []}, {}
            for s in "fb":
                states[s] = run_side((vectors @ p[f"W{s}"] + p[f"b{s}"])[at[s]], p[f"U{s}"], masks[s], kept[s])
            both = np.concatenate([states["f"], states["b"][::-1]], axis=2)
            logit, weight, hidden, context = pooled(p, both, mask)
            d_logit = ((sigmoid(logit) - y) * np.where(y > 0, 1.5, 1.0) / len(y)).astype(np.float32)
            d_context = d_logit[:, None] * p["v"]
            d_weight = np.einsum("nh,tnh->tn", d_context, both)
            d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
            d_hidden = d_e[:, :, None] * p["a"] * (1 - hidden * hidden)
            d_both = weight[:, :, None] * d_context + d_hidden @ p["A"].T
            grad = {"v": d_logit @ context, "c": d_logit.sum(keepdims=True), "a": np.einsum("tn,tnh->h", d_e, hidden), "A": np.einsum("tni,tnj->ij", both, d_hidden)}
            d_vectors = np.zeros_like(vectors)
            for s, d_out in (("f", d_both[:, :, :HIDDEN]), ("b", d_both[::-1, :, HIDDEN:])):
                d_pre = np.empty((WINDOW, len(part), 3 * HIDDEN), np.float32)
                grad[f"U{s}"] = side_gradient(p, s, kept[s], masks[s], d_out, d_pre)
                by_word = summed_at(len(distinct), at[s].ravel(), d_pre.reshape(-1, 3 * HIDDEN))
                grad[f"W{s}"], grad[f"b{s}"] = vectors.T @ by_word, by_word.sum(axis=0)
                d_vectors += by_word @ p[f"W{s}"].T
            grad["word"] = summed_at(WORD_ROWS, rows[distinct], d_vectors[:, :WORD_DIM] * kept_words)
            grad["char"] = summed_at(CHAR_ROWS, grams[picks], np.repeat(d_vectors[:, WORD_DIM:] / np.maximum(counted, 1)[:, None], counted, axis=0))
            for k, g in grad.items():
                first, second = moment[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                p[k] -= (RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return p


def tables(p, rows, grams, counts) -> tuple[np.ndarray, np.ndarray]:
    vectors = np.concatenate([p["word"][rows], char_means(p, grams, counts)], axis=1)
    return vectors @ p["Wf"] + p["bf"], vectors @ p["Wb"] + p["bb"]


def predict(p, rows, grams, counts, ids, lengths) -> np.ndarray:
    f, b = tables(p, rows, grams, counts)
    return np.concatenate([scores(p, f, b, ids[i : i + SCORE_BATCH], lengths[i : i + SCORE_BATCH]) for i in range(0, len(ids), SCORE_BATCH)]) if len(ids) else np.zeros(0)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(text, toxic): at most `sample` labelled documents that are not held out, the first by a seeded hash."""
    key = F.col("doc_id").cast("long")
    held = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1
    known = labels.select(key.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)

    def run(batches):
        for batch in slices(batches):
            out = []
            for text in byte_rows(batch):
                words = text.lower().split()
                out.append([b" ".join(words[s:e]) for s, e in windows(len(words))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.binary())), batch.column(2)], ["doc_id", "parts", "toxic"])

    texts = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, parts array<binary>, toxic int")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> dict[str, np.ndarray] | None:
    """Weights; None where the sample lacks one of the two labels."""
    rows = sorted(training_rows(docs, labels, sample, seed).collect(), key=lambda r: (r.doc_id, r.parts))
    marks = np.array([r.toxic for r in rows])
    if len(set(marks.tolist())) < 2:
        return None
    return train([[bytes(x) for x in r.parts] for r in rows], marks, seed=seed)


def score_texts(p, texts: list[bytes], vocabulary: Vocabulary, held: list) -> np.ndarray:
    """The highest window's score of each text; held: the two pre-activation tables of the words known so far."""
    owner, flat = [], []
    for i, text in enumerate(texts):
        ids = vocabulary.encode(text)
        for s, e in windows(len(ids)):
            owner.append(i)
            flat.append(ids[s:e])
    if vocabulary.fresh:
        new = tables(p, *vocabulary.take_fresh())
        held[:] = [np.concatenate([old, x]) for old, x in zip(held, new)] if held else list(new)
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    best = np.zeros(len(texts))
    order = np.argsort(lengths, kind="stable")
    for at in range(0, len(order), SCORE_BATCH):
        part = order[at : at + SCORE_BATCH]
        ids = np.zeros((len(part), max(1, int(lengths[part].max()))), np.int64)
        ids[np.arange(ids.shape[1])[None, :] < lengths[part][:, None]] = np.fromiter((x for j in part for x in flat[j]), np.int64, int(lengths[part].sum()))
        np.maximum.at(best, np.array(owner)[part], scores(p, held[0], held[1], ids, lengths[part]))
    return best


def score_documents(docs: DataFrame, p: dict[str, np.ndarray] | None) -> DataFrame:
    """(doc_id, score) for each row of docs."""

    def run(batches):
        vocabulary, held = Vocabulary(), []
        for batch in slices(batches, 256):
            if len(vocabulary.ids) > CACHE_WORDS:
                vocabulary, held = Vocabulary(), []
            got = score_texts(p, byte_rows(batch), vocabulary, held) if p else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return score_documents(docs, fit(docs, labels)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, in docs' own columns."""
    p = fit(docs, labels)
    at = docs.columns.index("text")
    schema = docs.schema

    def run(batches):
        vocabulary, held = Vocabulary(), []
        for batch in slices(batches, 256):
            if len(vocabulary.ids) > CACHE_WORDS:
                vocabulary, held = Vocabulary(), []
            got = score_texts(p, [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()], vocabulary, held)
            yield batch.filter(pa.array(got < threshold))

    return docs.mapInArrow(run, schema) if p else docs


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
