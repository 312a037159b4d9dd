"""Unsigned 64-bit arithmetic on BIGINT columns, and the counter-based generator built on it.

A u64 is held as the BIGINT of the same bits. Products must wrap, so expressions are built under ``wrapping``: a DataFrame made while ANSI
mode is off keeps wrapping semantics for good, whatever the session says when it runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the published SplitMix64 definition.
GAMMA = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB

MODULUS = 1 << 64


def spare_candidates(bounds: list[int]) -> int:
    """Candidates to draw beyond those needed, so that running out (which raises) is out of the question: rejection odds below 1e-15."""
    worst = max((MODULUS % b / MODULUS for b in bounds), default=0.0)
    return 0 if worst == 0 else 8 if worst < 1e-3 else 24 * len(bounds) + 56


def signed(value: int) -> int:
    """The signed 64-bit integer with the bits of ``value``."""
    value %= MODULUS
    return value - MODULUS if value >> 63 else value


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Expressions analysed inside wrap on overflow; the session's own setting comes back afterwards."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def mix(z: Column) -> Column:
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 30)) * F.lit(signed(MIX_A))
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 27)) * F.lit(signed(MIX_B))
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def stream_seed(prefix: bytes, site: Column) -> Column:
    """First eight bytes, big-endian, of sha256(prefix + site)."""
    digest = F.sha2(F.concat(F.lit(prefix), F.encode(site, "UTF-8")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint")


def outputs(seed: Column, n: int) -> Column:
    """The first n outputs of the stream with this seed, as an array; the k-th is mix(seed + k * GAMMA)."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: mix(seed + k.cast("bigint") * F.lit(signed(GAMMA))))


def output(seed: Column, k: int) -> Column:
    """The k-th output alone, counted from 1."""
    return mix(seed + F.lit(signed(k * GAMMA)))


def as_decimal(z: Column) -> Column:
    d = z.cast("decimal(20,0)")
    return F.when(z < 0, d + F.lit(Decimal(MODULUS))).otherwise(d).cast("decimal(20,0)")


def umod(z: Column, n: int) -> Column:
    """z mod n, z unsigned, 1 <= n <= 2^64."""
    if not 1 <= n <= MODULUS:
        raise ValueError(f"bound {n} is outside 1..2^64")
    if n <= 1 << 62:
        half = F.shiftrightunsigned(z, 1) % F.lit(n)
        return (half * F.lit(2) + z.bitwiseAND(F.lit(1))) % F.lit(n)
    if n == MODULUS:
        return z
    rest = (as_decimal(z) % F.lit(Decimal(n))).cast("decimal(20,0)")
    return F.when(rest >= F.lit(Decimal(1 << 63)), rest - F.lit(Decimal(MODULUS))).otherwise(rest).cast("bigint")


def accepted(z: Column, n: int) -> Column:
    """Whether the candidate z is kept for the bound n: below the greatest multiple of n."""
    limit = MODULUS - MODULUS % n
    if limit == MODULUS:
        return F.lit(True)
    flip = F.lit(signed(1 << 63))
    return z.bitwiseXOR(flip) < F.lit(signed(limit ^ (1 << 63)))


def chosen(candidates: Column, bounds: list[int]) -> Column:
    """Array of accepted candidates for successive bounds (each at least 2): a candidate that a bound rejects is passed over.

    Nearly always the first ones all fit; only else are they walked one by one.
    """
    n = len(bounds)
    if all(MODULUS % b == 0 for b in bounds):
        return F.slice(candidates, 1, n)
    ok = None
    for i, b in enumerate(bounds):
        if MODULUS % b:
            one = accepted(candidates[i], b)
            ok = one if ok is None else ok & one
    limits = F.array(*[F.lit(signed((MODULUS - MODULUS % b - 1) ^ (1 << 63))) for b in bounds])
    flip = F.lit(signed(1 << 63))

    def step(held: Column, z: Column) -> Column:
        fits = (F.size(held) < n) & (z.bitwiseXOR(flip) <= F.get(limits, F.size(held)))
        return F.when(fits, F.concat(held, F.array(z))).otherwise(held)

    walked = F.aggregate(candidates, F.array().cast("array<bigint>"), step)
    checked = F.when(F.size(walked) == n, walked).otherwise(F.raise_error(F.lit("draw candidates ran out")).cast("array<bigint>"))
    return F.when(ok, F.slice(candidates, 1, n)).otherwise(checked)


def with_streams(df: DataFrame, streams: dict[str, tuple[bytes, Column]]) -> DataFrame:
    """Adds a BIGINT seed column for each stream, in one projection of its own, so that no digest is computed twice."""
    return df.select("*", *[stream_seed(prefix, site).alias(name) for name, (prefix, site) in streams.items()])


def with_draws(df: DataFrame, draws: dict[str, tuple[str, list[int]]]) -> DataFrame:
    """For each name -> (seed column, bounds) adds the array of draws below the bounds. Bounds of 1 take no candidate and give 0."""
    raw, cooked = [], []
    for name, (seed, bounds) in draws.items():
        used = [b for b in bounds if b > 1]
        if used:
            raw.append(outputs(F.col(seed), len(used) + spare_candidates(used)).alias(f"__raw_{name}"))
    held = df.select("*", *raw)
    picked = []
    for name, (_, bounds) in draws.items():
        used = [b for b in bounds if b > 1]
        if used:
            picked.append(chosen(F.col(f"__raw_{name}"), used).alias(f"__kept_{name}"))
    held = held.select("*", *picked)
    for name, (_, bounds) in draws.items():
        items, at = [], 0
        for b in bounds:
            if b > 1:
                items.append(umod(F.col(f"__kept_{name}")[at], b))
                at += 1
            else:
                items.append(F.lit(0).cast("bigint"))
        cooked.append((F.array(*items) if items else F.array().cast("array<bigint>")).alias(name))
    # One row in, one row out: a filter above stays above, instead of pulling all draws into its condition.
    names = [F.col(c) for c in df.columns]
    return held.select(*names, F.explode(F.array(F.struct(*cooked))).alias("__draws")).select(*names, *[F.col(f"__draws.{n}").alias(n) for n in draws])
