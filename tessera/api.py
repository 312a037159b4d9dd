"""Library entry points; the session is the active one unless given."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from .plans import mint as _mint
from .plans import verify as _verify


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.appName("tessera").getOrCreate()


def mint(*, pack: str | Path, recipe: str, seed: int, out: str | Path, identifier_policy: str | None = None, fmt: str = "jsonl", records: dict[str, int] | None = None, invocation: str = "mint", spark: SparkSession | None = None) -> dict[str, Any]:
    """Generates a dataset into ``out`` and returns its manifest."""
    return _mint.mint(_session(spark), pack=_mint.resolve_pack(str(pack)), recipe=recipe, seed=seed, out=out, identifier_policy=identifier_policy, fmt=fmt, records=records, invocation=invocation)


def verify(directory: str | Path, *, trusted_manifest_sha256: str | None = None, spark: SparkSession | None = None) -> _verify.Report:
    """Checks a dataset and returns the report."""
    return _verify.verify(_session(spark), directory, trusted_manifest_sha256=trusted_manifest_sha256)


def reproduce(directory: str | Path, *, pack: str | Path | None = None, spark: SparkSession | None = None) -> _verify.Reproduction:
    """Generates a dataset again and compares."""
    return _verify.reproduce(_session(spark), directory, pack=pack)


def packcheck(pack: str | Path, *, spark: SparkSession | None = None) -> list[str]:
    """Problems of a pack."""
    return _verify.packcheck(_session(spark), _mint.resolve_pack(str(pack)))
