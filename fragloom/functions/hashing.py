"""Column functions for content hashes, derived embeddings, quantised hashes and their distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The generator whose stream makes an embedding from a content hash.
MULTIPLIER, INCREMENT, MODULUS = 9301, 49297, 233280


def tuple_hash(tokens: Column) -> Column:
    """MD5 of "(1, 2, 3)"; one token is "(7,)" and none is "()"."""
    joined = F.array_join(tokens.cast("array<string>"), ", ")
    return F.md5(F.concat(F.lit("("), joined, F.when(F.size(tokens) == 1, F.lit(",)")).otherwise(F.lit(")"))))


def comma_hash(tokens: Column) -> Column:
    """MD5 of "1,2,3": the other dialect, of the compute windows."""
    return F.md5(F.array_join(tokens.cast("array<string>"), ","))


def hash_seed(content_hash: Column) -> Column:
    """The 128-bit hash modulo MODULUS, folded over four groups of eight hex digits."""
    part = lambda p: F.conv(F.substring(content_hash, p, F.lit(8)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(25), F.lit(8)), F.lit(0).cast("long"), lambda a, p: F.pmod(a * F.lit(2**32 % MODULUS) + part(p), F.lit(MODULUS).cast("long")))


def generator_states(content_hash: Column, dim: int) -> Column:
    """The `dim` states that follow the hash's seed, as array<long>."""
    nothing = F.array().cast("array<long>")
    step = lambda s: F.pmod(s * F.lit(MULTIPLIER) + F.lit(INCREMENT), F.lit(MODULUS).cast("long"))
    start = F.struct(hash_seed(content_hash).alias("s"), nothing.alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(dim)), start, lambda a, _: F.struct(step(a["s"]).alias("s"), F.concat(a["out"], F.array(step(a["s"]))).alias("out")), lambda a: a["out"])


def norm(vector: Column) -> Column:
    """Euclidean length; 1 for a zero vector, so that it can divide."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(length == 0, F.lit(1.0)).otherwise(length)


def embedding(content_hash: Column, dim: int) -> Column:
    """Unit vector derived from a content hash."""
    raw = F.transform(generator_states(content_hash, dim), lambda s: s / F.lit(float(MODULUS)) * 2 - 1)
    # bound once by one-element arrays: named again, they would be made again for every component
    scaled = lambda x: F.transform(F.array(norm(x)), lambda n: F.transform(x, lambda v: v / n))[0]
    return F.transform(F.array(raw), scaled)[0]


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; the norms take the whole vectors, and a zero vector gives 0."""
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((length(a) == 0) | (length(b) == 0), F.lit(0.0)).otherwise(dot(a, b) / (length(a) * length(b)))


def semantic_hash(vector: Column, precision: int = 8) -> Column:
    """Hex of each component quantised to 2^precision bins (one byte up to 8 bits, else two); "0" for no components."""
    bins = (1 << precision) - 1
    level = lambda v: F.greatest(F.lit(0), F.least(((v + 1.0) / 2.0 * bins).cast("int"), F.lit(bins)))
    text = F.array_join(F.transform(vector, lambda v: F.lpad(F.lower(F.hex(level(v))), 2 if precision <= 8 else 4, "0")), "")
    return F.when(F.size(vector) == 0, F.lit("0")).otherwise(text)


def hash_distance(a: Column, b: Column) -> Column:
    """Share of bytes that differ, a difference in length counting too; an odd number of digits is an error unless equal."""
    size = lambda h: (F.length(h) / 2).cast("int")
    shared, most = F.least(size(a), size(b)), F.greatest(size(a), size(b))
    part = lambda h, i: F.substring(h, 2 * i - 1, F.lit(2))
    differing = F.aggregate(F.when(shared > 0, F.sequence(F.lit(1), shared)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda s, i: s + (part(a, i) != part(b, i)).cast("int"))
    odd = (F.length(a) % 2 != 0) | (F.length(b) % 2 != 0)
    return F.when(a == b, F.lit(0.0)).when(odd, F.raise_error(F.lit("a semantic hash has an odd number of digits")).cast("double")).otherwise((differing + most - shared) / most)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    shared = F.least(F.size(a), F.size(b))
    differs = F.zip_with(F.slice(a, F.lit(1), shared), F.slice(b, F.lit(1), shared), lambda x, y: x != y)
    at = F.array_position(differs, F.lit(True))
    return F.when(at > 0, at - 1).otherwise(shared).cast("int")


def delta(base: Column, new: Column) -> Column:
    """struct(base_hash, removed_tail, appended): how to come from base to new."""
    kept = common_prefix(base, new)
    return F.struct(tuple_hash(base).alias("base_hash"), (F.size(base) - kept).alias("removed_tail"), F.slice(new, kept + 1, F.size(new)).alias("appended"))


def apply_delta(base: Column, removed: Column, appended: Column) -> Column:
    """Drop `removed` tokens from the end and append; an impossible count is an error."""
    bad = (removed < 0) | (removed > F.size(base))
    return F.when(bad, F.raise_error(F.lit("removed_tail is out of range")).cast("array<bigint>")).otherwise(F.concat(F.slice(base, F.lit(1), F.size(base) - removed), appended))


def byte_units(n: Column, largest: str = "PiB") -> Column:
    """1536 -> "1.5 KiB"; sizes past the largest unit stay in it."""
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    size = F.abs(n.cast("double"))
    scale, name = F.lit(float(1024 ** units.index(largest))), F.lit(" " + largest)
    for power in reversed(range(units.index(largest))):
        below = size < float(1024 ** (power + 1))
        scale, name = F.when(below, float(1024**power)).otherwise(scale), F.when(below, " " + units[power]).otherwise(name)
    return F.concat(F.when(n < 0, "-").otherwise(""), tenths(size / scale), name)


def tenths(x: Column) -> Column:
    """The nearest tenth of a double's exact value as text, halves going to even: 1.25 -> "1.2", 1.35 -> "1.4".

    x times 20 less its nearest whole number is exact when taken in two steps, as both differences are of near numbers."""
    near = F.rint(x * 20.0)
    off, down = (x * 16.0 - near) + x * 4.0, F.floor(near / 2)
    up = (near % 2 != 0) & ((off > 0) | (off == 0) & (down % 2 != 0))
    whole = (down + up.cast("long")).cast("long")
    return F.concat(F.floor(whole / 10).cast("string"), F.lit("."), (whole % 10).cast("string"))


def duration_units(seconds: Column) -> Column:
    """90 -> "2m": seconds below a minute, minutes below an hour, else hours (halves go to even)."""
    return F.when(seconds < 60, F.format_string("%.0fs", F.bround(seconds, 0))).when(seconds < 3600, F.format_string("%.0fm", F.bround(seconds / 60, 0))).otherwise(F.concat(tenths(seconds / 3600), F.lit("h")))
