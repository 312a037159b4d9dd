"""Dealing children to parents under a count distribution, without a global window.

Running totals have two levels: blocks of consecutive parents are summed, a window runs over the few block sums, and within a block a
window of its own runs. So no task holds more than a block's parents, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws as dr
from ..functions import u64

BLOCK = 1 << 16


def running_total(df: DataFrame, order: str, value: Column, out: str, descending: bool = False, block: int = BLOCK) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in the order of the integer column ``order``."""
    df = df.withColumn("__value", value).withColumn("__block", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    sums = df.groupBy("__block").agg(F.sum("__value").alias("__sum"))
    earlier = Window.orderBy(way("__block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    own = Window.partitionBy("__block").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__own", F.coalesce(F.sum("__value").over(own), F.lit(0))).join(starts, "__block")
    return df.withColumn(out, F.col("__start") + F.col("__own")).drop("__value", "__block", "__own", "__start")


def feasible(parents: int, children: int, counts: Sequence[int]) -> bool:
    """Whether so many children can be dealt with every parent's count inside the declared ones."""
    if children == 0:
        return True
    return parents > 0 and parents * min(counts) <= children <= parents * max(counts)


def drawn_counts(parents: DataFrame, prefix: bytes, site: Column, counts: Sequence[int], weights: Sequence[str]) -> DataFrame:
    """Adds ``drawn``: the number of children that each parent's own stream asks for."""
    spark = parents.sparkSession
    plan = dr.Plan()
    pick = dr.pick_weighted(plan, dr.scale_weights(weights))
    with u64.wrapping(spark):
        ready = u64.with_draws(u64.with_streams(parents, {"__seed": (prefix, site)}), {"__d": ("__seed", plan.bounds)})
        held = F.array(*[F.lit(int(c)) for c in counts])
        return ready.withColumn("drawn", F.get(held, pick(F.col("__d"))).cast("bigint")).drop("__seed", "__d")


def fit_counts(df: DataFrame, order: str, children: int, counts: Sequence[int]) -> DataFrame:
    """Adds ``dealt``: drawn counts changed to sum to ``children``; a surplus goes from the last parents, a deficit is filled from the first, in rounds."""
    parents, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum("drawn"), F.lit(0))).first()
    low, high = min(counts), max(counts)
    if not feasible(parents, children, counts):
        raise ValueError(f"{children} children do not fit {parents} parents with {low} to {high} each")
    if children == 0:
        return df.withColumn("dealt", F.lit(0).cast("bigint"))
    if total >= children:
        spare = F.col("drawn") - low
        df = running_total(df, order, spare, "__before", descending=True)
        return df.withColumn("dealt", F.col("drawn") - F.greatest(F.lit(0), F.least(spare, F.lit(total - children) - F.col("__before")))).drop("__before")
    room = F.lit(high) - F.col("drawn")
    left, rounds = children - total, 0
    sizes = {r["room"]: r["count"] for r in df.select(room.alias("room")).groupBy("room").count().collect()}
    while True:
        in_round = sum(n for cap, n in sizes.items() if cap > rounds)
        if left <= in_round:
            break
        left, rounds = left - in_round, rounds + 1
    asks = (room > rounds).cast("bigint")
    df = running_total(df, order, asks, "__before")
    return df.withColumn("dealt", F.col("drawn") + F.least(room, F.lit(rounds)) + F.when((asks == 1) & (F.col("__before") < left), 1).otherwise(0)).drop("__before")


def expand(df: DataFrame, order: str) -> DataFrame:
    """One row per child: (child, parent), children numbered from 0 in the order of parents."""
    df = running_total(df, order, F.col("dealt"), "__offset").filter("dealt > 0")
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("dealt") - 1))
    return df.select(F.col(order).alias("parent"), "__offset", k.alias("__k")).select((F.col("__offset") + F.col("__k")).cast("bigint").alias("child"), "parent")


def assign_children(parents: DataFrame, order: str, prefix: bytes, site: str, children: int, counts: Sequence[int], weights: Sequence[str]) -> DataFrame:
    """(child, parent) for every child; the parent's draw comes from the site ``<site>/<order>/count``."""
    at = F.concat(F.lit(f"{site}/"), F.col(order).cast("string"), F.lit("/count"))
    return expand(fit_counts(drawn_counts(parents, prefix, at, counts, weights), order, children, counts), order)
