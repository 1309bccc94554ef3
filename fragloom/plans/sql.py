"""DuckDB text that the oracle queries share: the canonical tables and hashes."""

from __future__ import annotations

TOKENS = "list_transform(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT)"
PROMPTS = f"prompts AS (SELECT doc_id AS prompt_id, lang AS model_id, source AS tenant, {TOKENS} AS tokens FROM documents)"
TURNS = f"turns AS (SELECT conv_id, turn, {TOKENS} AS tokens FROM conversations)"
ACCESSES = "acc AS (SELECT user_id AS session_id, event_id, event_type AS kind, (props::JSON->>'k')::BIGINT AS k, epoch_us(ts) / 1000000 AS ts, md5(event_type || ':' || (props::JSON->>'k')) AS content_hash, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"
STORE = "store AS (SELECT content_hash, max(kind) AS kind, max(k) AS k, count(*) AS n, min(ts) AS inserted, max(ts) AS last_access, 64 * (max(k) + 1) AS size, 86400.0::DOUBLE * (max(k) % 40) AS ttl, (max(k) % 11) / 10 AS reuse_score FROM acc GROUP BY content_hash)"
INVENTORY = "inv AS (SELECT 'n' || (session_id % 8) AS node_id, content_hash, count(*) AS version_id FROM acc GROUP BY ALL)"
NODES = "nodes AS (SELECT s_name AS node_id, s_suppkey AS seq, s_nationkey AS region, ((s_suppkey * 37 + 11) % 6000)::DOUBLE AS latency_ms, (s_suppkey * 3) % 10 / 10 AS bandwidth_cost, (s_suppkey * 7 + 3) % 100 / 100 AS gpu_load, (s_suppkey * 13 + 5) % 100 / 100 AS memory_pressure, (s_suppkey * 29 + 17) % 101 / 100 AS load FROM supplier)"
LENGTHS = "lengths AS (SELECT trunc(l_extendedprice)::BIGINT AS length FROM lineitem WHERE trunc(l_extendedprice) BETWEEN 128 AND 131072)"
NEXT = "steps AS (SELECT content_hash AS src, lead(content_hash) OVER (PARTITION BY session_id ORDER BY seq) AS dst FROM acc), counted AS (SELECT src, dst, count(*) AS n FROM steps WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL), edges AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM counted)"


def tuple_hash(x: str) -> str:
    return f"md5(CASE WHEN len({x}) = 1 THEN '(' || {x}[1] || ',)' ELSE '(' || array_to_string({x}, ', ') || ')' END)"


def comma_hash(x: str) -> str:
    return f"md5(array_to_string({x}, ','))"


def windows(width: int, dialect=tuple_hash) -> str:
    return f"win AS (SELECT prompt_id, model_id, tenant, i * {width} AS token_start, least((i + 1) * {width}, len(tokens)) - 1 AS token_end, tokens[i * {width} + 1 : (i + 1) * {width}] AS part, {dialect(f'tokens[i * {width} + 1 : (i + 1) * {width}]')} AS content_hash FROM (SELECT *, unnest(range(0, (len(tokens) - 1) // {width} + 1)) AS i FROM prompts WHERE len(tokens) > 0))"


def interpolate(x: str, ys) -> str:
    xs, out = (1024, 8192, 32768, 131072), f"CASE WHEN {x} <= 1024 THEN {ys[0]}::DOUBLE"
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        out += f" WHEN {x} <= {x1} THEN {y0}::DOUBLE + ({x} - {x0}) / {x1 - x0}::DOUBLE * ({y1}::DOUBLE - {y0}::DOUBLE)"
    return f"({out} ELSE {ys[-1]}::DOUBLE END)"


def kv(x: str) -> str:
    return interpolate(x, (190.8, 308.9, 701.3, 2316.3))


def prefill(x: str) -> str:
    return interpolate(x, (0.44, 0.72, 1.84, 7.40))


GBIT = "(1024.0::DOUBLE * 1024.0 * 8.0 / 1e9)"
