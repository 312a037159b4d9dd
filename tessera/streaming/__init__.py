"""The sweep over a stream: the same columns as in batch, plus running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sweep


def violation_stream(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Each candidate of a streamed row with each checksum that it satisfies; stateless, so any output mode but complete."""
    return sweep.violations(rows, keep, [F.col(text)])


def counts_by_window(rows: DataFrame, keep: list[str], text: str, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Candidates and valid ones per window of event time; rows later than ``late`` are left out, as the watermark says."""
    swept = sweep.swept(rows.withWatermark(time, late), [*keep, time], [F.col(text)])
    return swept.groupBy(F.window(time, window).alias("window")).agg(F.count(F.lit(1)).alias("candidates"), F.sum((F.size("valid_under") > 0).cast("bigint")).alias("valid"))
