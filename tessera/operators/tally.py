"""Counts against declared targets: proportions and tolerances in integers, coverage, duplicates, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 10_000


def scaled(text: str) -> int:
    """A decimal string at four places, the rest cut off."""
    whole, _, fraction = text.partition(".")
    return int(whole or "0") * SCALE + int((fraction + "0000")[:4])


def proportion(count: Column, total: Column) -> Column:
    """count / total rounded to four places, as text; "0" of nothing."""
    n = (count * SCALE + F.expr("0").cast("bigint") + F.floor(total / 2)) / total
    n = F.floor(n).cast("bigint")
    return F.when(total == 0, F.lit("0")).otherwise(F.format_string("%d.%04d", F.floor(n / SCALE).cast("bigint"), n % SCALE))


def target_frame(spark: SparkSession, targets: dict[str, str]) -> DataFrame:
    rows = [(k, v, scaled(v)) for k, v in targets.items()]
    return spark.createDataFrame(rows, "value string, target string, target_scaled bigint")


def tally(df: DataFrame, value: Column, targets: dict[str, str]) -> DataFrame:
    """(value, target, n, total, achieved, near) for every target; values outside the targets count in no total."""
    counted = df.select(value.alias("value")).filter(F.col("value").isin(*targets)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    full = F.broadcast(target_frame(df.sparkSession, targets)).join(counted, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = full.agg(F.sum("n").alias("total"))
    full = full.crossJoin(F.broadcast(total))  # one row
    observed = F.floor((F.col("n") * SCALE + F.floor(F.col("total") / 2)) / F.col("total"))
    near = (F.col("total") == 0) | (F.abs(observed - F.col("target_scaled")) <= 200)
    return full.select("value", "target", "n", "total", proportion(F.col("n"), F.col("total")).alias("achieved"), near.alias("near"))


def within_tolerance(tallied: DataFrame) -> DataFrame:
    return tallied.agg(F.bool_and("near").alias("within_tolerance"), F.sum("n").cast("bigint").alias("total"))


def unexpected(df: DataFrame, value: Column, targets: dict[str, str]) -> DataFrame:
    """Observed values that no target names, with their counts; nulls are passed over."""
    seen = df.select(value.alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(F.broadcast(target_frame(df.sparkSession, targets)), "value", "left_anti")


def coverage(labels: DataFrame, label: str, targets: dict[str, int]) -> DataFrame:
    """(label, target, achieved, met) for every targeted label."""
    counted = labels.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("achieved"))
    wanted = labels.sparkSession.createDataFrame(sorted(targets.items()), "label string, target bigint")
    out = F.broadcast(wanted).join(counted, "label", "left").withColumn("achieved", F.coalesce("achieved", F.lit(0)))
    return out.select("label", "target", "achieved", (F.col("achieved") >= F.col("target")).alias("met"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
