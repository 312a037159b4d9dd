"""Scans of any table for identifiers whose checksum holds, and for phrases that must not occur."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identifiers as ids
from ..functions.text import canonical_for_match, row_candidates, security_fold


def scalar_texts(schema: T.StructType, base: Column | None = None) -> list[Column]:
    """Every text and integer of a row, nested ones too, as text; booleans and other kinds are passed over."""
    out: list[Column] = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if base is None else base[f.name]
        if isinstance(f.dataType, T.StringType):
            out.append(c)
        elif isinstance(f.dataType, T.IntegralType) or isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0:
            out.append(c.cast("string"))
        elif isinstance(f.dataType, T.StructType):
            out.extend(scalar_texts(f.dataType, c))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType | T.IntegralType):
            out.append(F.array_join(F.transform(c, lambda x: x.cast("string")), "\n"))
    return out


def swept(df: DataFrame, keep: list[str], texts: list[Column] | None = None) -> DataFrame:
    """keep columns, each distinct candidate of the row, and the checksums that it satisfies."""
    texts = scalar_texts(df.schema) if texts is None else texts
    found = df.select(*keep, F.explode(row_candidates(texts)).alias("candidate"))
    return found.withColumn("valid_under", ids.valid_under(F.col("candidate")))


def violations(df: DataFrame, keep: list[str], texts: list[Column] | None = None) -> DataFrame:
    """One row for each candidate and checksum that it satisfies: empty for data under the safe policy."""
    return swept(df, keep, texts).select(*keep, "candidate", F.explode("valid_under").alias("family"))


def load_phrases(text: str) -> dict[str, str]:
    """A denylist: one phrase a line, a comment behind # that names its source. Keys are folded for matching."""
    out: dict[str, str] = {}
    for raw in text.splitlines():
        phrase, _, source = raw.partition("#")
        phrase = phrase.strip()
        if not phrase:
            continue
        if len(phrase) < 3:
            raise ValueError(f"phrase {phrase!r} has fewer than three characters")
        out[canonical_for_match(phrase)] = source.strip() or phrase
    if not out:
        raise ValueError("a denylist without phrases permits everything")
    return out


def read_phrases(path: str | Path) -> dict[str, str]:
    return load_phrases(Path(path).read_text(encoding="utf-8"))


def missing_phrases(extension: dict[str, str], core: dict[str, str]) -> set[str]:
    """Phrases of the core that an extension leaves out; it may not."""
    return set(core) - set(extension)


def phrase_hits(df: DataFrame, keep: list[str], text: Column, phrases: dict[str, str]) -> DataFrame:
    """keep columns and each phrase that occurs in the folded text between word boundaries.

    One alternation finds the rows that hold any; only those are tried phrase by phrase.
    """
    edge = r"(?<![\p{L}\p{N}_])(?:%s)(?![\p{L}\p{N}_])"
    quoted = {p: re.escape(p) for p in phrases}
    any_of = edge % "|".join(sorted(quoted.values(), key=len, reverse=True))
    rows = df.select(*keep, security_fold(text).alias("__folded")).filter(F.col("__folded").rlike(any_of))
    each = F.array_compact(F.array(*[F.when(F.col("__folded").rlike(edge % q), F.lit(p)) for p, q in quoted.items()]))
    source = F.create_map(*[F.lit(x) for p in phrases for x in (p, phrases[p])])
    return rows.select(*keep, F.explode(each).alias("phrase")).withColumn("source", F.element_at(source, F.col("phrase")))
