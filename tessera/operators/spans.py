"""Labelled spans: extraction, alignment, shape, overlap. Offsets are code points, end excluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions.text import CANDIDATE, SPACE_CLASS

# The closed set of labels, named entities first, identifiers last.
ENTITY_LABELS = tuple("PERSON ADDRESS ORG DOB HEALTH RELIGION ETHNICITY POLITICAL SEXUAL_LIFE CRIMINAL BIOMETRIC_REF UNION".split())
LABELS = (*ENTITY_LABELS, "TCKN", "VKN", "IBAN", "PAN", "PHONE", "EMAIL")


def extract(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


#: Candidates of a text whose places are summed up at a time.
_STRIDE = 128


def candidate_spans(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep, start, end, surface) of every identifier candidate of a text, repeats too, in order.

    The text is cut at candidates; a candidate ends behind all pieces and candidates so far. These sums are made stride by stride, each from the sum of
    the strides before it, so that a text full of numbers takes time in proportion.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(f"({CANDIDATE})"), 1)
    rows = df.select(*keep, found.alias("__found"), F.split(F.col(text), CANDIDATE).alias("__between")).filter(F.size("__found") > 0)
    rows = rows.withColumn("__steps", F.transform("__found", lambda x, k: F.length(F.get(F.col("__between"), k)) + F.length(x))).drop("__between")
    strides = F.sequence(F.lit(0), F.floor((F.size("__steps") - 1) / _STRIDE).cast("int"))
    part = lambda k: F.slice(F.col("__steps"), k * _STRIDE + 1, _STRIDE)
    rows = rows.withColumn("__sums", F.transform(strides, lambda k: F.aggregate(part(k), F.lit(0), lambda a, x: a + x)))

    def running(steps: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("ends"))
        step = lambda held, x: F.struct((held["at"] + x).alias("at"), F.concat(held["ends"], F.array(held["at"] + x)).alias("ends"))
        return F.aggregate(steps, empty, step, lambda h: h["ends"])

    rows = rows.withColumn("__starts", F.concat(F.array(F.lit(0)), running(F.col("__sums"), F.lit(0))))
    ends = F.flatten(F.transform(strides, lambda k: running(part(k), F.get(F.col("__starts"), k))))
    out = rows.withColumn("__ends", ends).select(*keep, F.explode(F.arrays_zip("__found", "__ends")).alias("s"))
    return out.select(*keep, (F.col("s.__ends") - F.length("s.__found")).alias("start"), F.col("s.__ends").alias("end"), F.col("s.__found").alias("surface"))


def findings(spans: DataFrame, labels: list[str]) -> DataFrame:
    """Adds ``finding`` to rows (text, start, end, label): the first rule that a span breaks, or null.

    Rules: a known label, bounds inside the text, a surface that is not blank, the shape of its identifier label, and no shape of another one.
    """
    surface = extract(F.col("text"), F.col("start"), F.col("end"))
    outside = (F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.length("text"))
    shaped = None
    for name, family in ids.FAMILIES.items():
        wrong = (F.col("label") == name) & ~family.shape(surface)
        shaped = wrong if shaped is None else shaped | wrong
    other = ids.impostor(surface, F.col("label"))
    finding = (
        F.when(F.col("label").isNull() | ~F.col("label").isin(*labels), "unknown label")
        .when(F.coalesce(outside, F.lit(True)), "outside")
        .when(surface.rlike(rf"\A[{SPACE_CLASS}]*\z"), "blank")
        .when(shaped, "shape")
        .when(other.isNotNull(), F.concat(F.lit("impostor "), other))
    )
    return spans.withColumn("finding", finding)


def overlaps(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end, finding): spans that repeat or begin before their predecessor's end."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = spans.withColumn("__start", F.lag("start").over(w)).withColumn("__end", F.lag("end").over(w))
    finding = F.when((F.col("__start") == F.col("start")) & (F.col("__end") == F.col("end")), "duplicate").when(F.col("start") < F.col("__end"), "overlap")
    return before.withColumn("finding", finding).filter("finding is not null").select(key, "start", "end", "finding")
