"""Joins that compare two sides: what one lacks, what differs, what repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left_value, right_value, finding) of keys on one side only, or with differing values. Each side holds a key once."""
    a = left.select(F.col(key).alias("key"), F.col(value).alias("left_value"), F.lit(True).alias("__in_left"))
    b = right.select(F.col(key).alias("key"), F.col(value).alias("right_value"), F.lit(True).alias("__in_right"))
    joined = a.join(b, "key", "full_outer")
    finding = F.when(F.col("__in_right").isNull(), "missing").when(F.col("__in_left").isNull(), "extra").when(~F.col("left_value").eqNullSafe(F.col("right_value")), "differs")
    return joined.select("key", "left_value", "right_value", finding.alias("finding")).filter("finding is not null")


def one_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has."""
    a, b = left.select(key), right.select(key)
    only = lambda x, y, side: x.join(y, key, "left_anti").select(F.col(key).alias("key"), F.lit(side).alias("side"))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def dangling(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """Children whose reference is not null and leads to no parent."""
    return child.filter(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")


def sidecar_findings(documents: DataFrame, sidecar: DataFrame, key: str) -> DataFrame:
    """(key, finding, n): a sidecar line without its document, a document without its line, and repeats on either side."""
    d = documents.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("nd"))
    s = sidecar.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("ns"))
    joined = d.join(s, "key", "full_outer")
    found = F.array_compact(
        F.array(
            F.when(F.col("nd").isNull(), F.struct(F.lit("no document").alias("finding"), F.col("ns").alias("n"))),
            F.when(F.col("ns").isNull(), F.struct(F.lit("no sidecar").alias("finding"), F.col("nd").alias("n"))),
            F.when(F.col("nd") > 1, F.struct(F.lit("duplicate document").alias("finding"), F.col("nd").alias("n"))),
            F.when(F.col("ns") > 1, F.struct(F.lit("duplicate sidecar").alias("finding"), F.col("ns").alias("n"))),
        )
    )
    return joined.select("key", F.explode(found).alias("f")).select("key", "f.finding", "f.n")


def ordered_digest(df: DataFrame, order: Column, piece: Column) -> DataFrame:
    """sha256 of the pieces joined in the order given; one row. For lists that a driver declares, not for data."""
    held = F.array_sort(F.collect_list(F.struct(order.alias("o"), piece.alias("p"))))
    return df.agg(F.sha2(F.concat_ws("", F.transform(held, lambda x: x["p"])), 256).alias("digest"))
