"""The plug-in point of the compute step: a backend turns windows into embeddings and prompts into text, batch by batch."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.operators.windows import compute_windows


class ComputeBackend(ABC):
    """embed() and generate() run inside tasks on batches of rows (mapInPandas); a backend is sent to them as it is."""

    name = "backend"

    @abstractmethod
    def embed(self, batch: pd.DataFrame) -> list[list[float]]:
        """A vector for each window (columns of compute_windows)."""

    def generate(self, batch: pd.DataFrame, max_tokens: int) -> list[str]:
        """A completion for each prompt (prompt_id, model_id, tokens); local backends complete nothing."""
        return [""] * len(batch)

    def available(self) -> bool:
        return True

    def prefill(self, prompts: DataFrame, width: int = 128) -> DataFrame:
        """Windows with this backend's embeddings; where embed() fails, the deterministic (offset, length)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                try:
                    yield batch.assign(embedding=[list(map(float, v)) for v in self.embed(batch)])
                except (OSError, ValueError):
                    yield batch

        return compute_windows(prompts, run, width)

    def complete(self, prompts: DataFrame, max_tokens: int = 128) -> DataFrame:
        """(prompt_id, text, tokens_generated)"""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = self.generate(batch, max_tokens)
                yield pd.DataFrame({"prompt_id": batch["prompt_id"], "text": texts, "tokens_generated": [len(t.split()) for t in texts]})

        return prompts.select("prompt_id", "model_id", "tokens").mapInPandas(run, "prompt_id long, text string, tokens_generated int")


class LocalBackend(ComputeBackend):
    """The deterministic one: embedding (offset, length)."""

    name = "local"

    def embed(self, batch: pd.DataFrame) -> list[list[float]]:
        return [[float(s), float(len(t))] for s, t in zip(batch["token_start"], batch["tokens"])]


class MeanBackend(ComputeBackend):
    """Embeds a window as the first `dim` of its tokens scaled to 0..1, padded with zeros."""

    name = "mean"

    def __init__(self, dim: int = 8):
        self.dim = dim

    def embed(self, batch: pd.DataFrame) -> list[list[float]]:
        return [([float(t % 1000) / 1000 for t in tokens] + [0.0] * self.dim)[: self.dim] for tokens in batch["tokens"]]


def prefill_result(prompts: DataFrame, windows: DataFrame) -> DataFrame:
    """(prompt_id, tokens, kv_size_mib, latency_seconds, fragments): what a prefill reports."""
    from fragloom.functions.throughput import kv_size_mib, prefill_seconds

    n = F.size("tokens")
    counted = windows.groupBy("prompt_id").agg(F.count("*").alias("fragments"))
    return prompts.select("prompt_id", n.alias("tokens"), kv_size_mib(n).alias("kv_size_mib"), prefill_seconds(n).alias("latency_seconds")).join(counted, "prompt_id", "left").fillna(0, ["fragments"])
