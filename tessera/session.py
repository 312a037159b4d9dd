"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reach_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, whatever directory they start in."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    held = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in held:
        env["PYTHONPATH"] = os.pathsep.join([root, *held])
    return spark
