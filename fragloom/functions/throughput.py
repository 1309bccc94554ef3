"""The analytical throughput model as column expressions: profiles, stages, end-to-end rate, time to first token, costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Measured profile points (tokens, cache MiB, prefill seconds) and the modelled hardware.
LENGTHS, KV_MIB, PREFILL = (1024, 8192, 32768, 131072), (190.8, 308.9, 701.3, 2316.3), (0.44, 0.72, 1.84, 7.40)
OFFLOAD_INSTANCES, LOCAL_INSTANCES, EGRESS_GBPS, LOCAL_SCALE = 4, 8, 100.0, 2.5
DECODE_SECONDS, BATCH, OUTPUT_TOKENS = 0.025, 20, 1024
T_MIN, T_MAX, T_STEP = 1024, 65536, 256
GBIT_PER_MIB, COST_GBIT_PER_MIB = 1024.0 * 1024.0 * 8.0 / 1e9, 8.388608


def interpolate(x: Column, xs, ys) -> Column:
    """Piecewise linear through the points, level outside them."""
    if not xs:
        raise ValueError("no points to interpolate")
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - x0) / F.lit(float(x1 - x0)) * F.lit(float(y1) - float(y0)))
    return out.otherwise(F.lit(float(ys[-1])))


def kv_size_mib(length: Column) -> Column:
    return interpolate(length, LENGTHS, KV_MIB)


def prefill_seconds(length: Column, scale: float = 1.0) -> Column:
    return interpolate(length, LENGTHS, PREFILL) * F.lit(float(scale))


def kv_gbps(length: Column) -> Column:
    return kv_size_mib(length) * GBIT_PER_MIB / prefill_seconds(length)


def offload_rate(instances: Column, gbps: Column, length: Column, scale: float = 1.0) -> Column:
    return F.least(instances / prefill_seconds(length, scale), gbps / (kv_size_mib(length) * GBIT_PER_MIB))


def local_rate(instances: Column, length: Column, scale: float = LOCAL_SCALE) -> Column:
    return instances / prefill_seconds(length, scale)


def decode_rate(instances: Column, batch: float = BATCH, seconds: float = DECODE_SECONDS, tokens: float = OUTPUT_TOKENS) -> Column:
    return instances * F.lit(float(batch)) / F.lit(float(seconds) * float(tokens))


def end_to_end(offload: Column, local: Column, decode: Column, fraction: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.least(F.when(fraction <= 0, inf).otherwise(F.try_divide(offload, fraction)), F.when(fraction >= 1, inf).otherwise(F.try_divide(local, 1.0 - fraction)), decode)


def first_token_seconds(length: Column, target: Column, gbps: float = EGRESS_GBPS, local_scale: float = LOCAL_SCALE) -> Column:
    return F.when(target == "pd-p", prefill_seconds(length, local_scale)).otherwise(prefill_seconds(length) + kv_size_mib(length) * GBIT_PER_MIB / gbps)


def egress_gbps(rate: Column, fraction: Column, length: Column) -> Column:
    return F.when(fraction <= 0, F.lit(0.0)).otherwise(rate * fraction * kv_size_mib(length) / prefill_seconds(length) * GBIT_PER_MIB)


def retrieval_seconds(kv_mib: Column, gbps: float = EGRESS_GBPS) -> Column:
    """As the cost model has it: its factor takes MiB to a thousandth of a Gbit's inverse (kept as defined)."""
    return F.lit(float("inf")) if gbps <= 0 else kv_mib * COST_GBIT_PER_MIB / gbps


def reuse_is_cheaper(length: Column, kv_mib: Column, gbps: float = EGRESS_GBPS, scale: float = 1.0, latency: Column | None = None) -> Column:
    return (retrieval_seconds(kv_mib, gbps) if latency is None else latency) < prefill_seconds(length, scale)
