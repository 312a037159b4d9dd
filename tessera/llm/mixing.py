"""Operator 7: mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words, by weight, at most ``max_repeat`` times its own. Within a source a document's share of the target grows
with the number of binary digits of its size (its class): e = min(max_repeat, c * class) copies are due to it, where c is such that
the words due make up the target. floor(e) whole copies are taken for certain; the rest pi of e is the inclusion probability of
one more. Documents are ranked by (U / (1 - U)) / (pi / (1 - pi)) with U a hash of the document, and the prefix of that ranking is taken
that ends before the first document that would take the words further from what the source still lacks than leaving it out: so the sample is of
fixed size, in words, and documents are in it with unequal probabilities.

No task orders a whole source. A rank's place in (0, 1) is cut into 1024 cells; per source and cell there is one row of sizes, and a running
sum finds the cell in which the prefix ends; that cell alone is cut again, until it holds few rows, which are ordered one by one.

Nulls: a null source is a source of its own, last in order; a null text has size 0. A source without words has target 0
and takes none. Equal ranks are ordered by doc_id and size. Rows repeated in full are drawn as one group, of which as many are taken as fit; which of
them, is decided by their place in the table. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, digest_bits, word_count

#: At most so many rows about sources are broadcast; more are joined by shuffle, where Spark splits a large source.
BROADCAST_ROWS = 50_000
#: Bits of a cell's number, and bits of the place of a rank and of a row in the table.
CELL, PLACE, ROW = 10, 50, 60
#: Rows of a source that one task orders.
FEW_ROWS = 10_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: int = 3) -> DataFrame:
    """From (source, size) to (source, source_size, target): one row for each source.

    Targets are weight shares of all words, none above max_repeat * source_size: sources are walked by the share at
    which they fill up, and the level at which the rest holds everything left is the common share per unit of weight.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = s.withColumn("__rn", F.row_number().over(by_name) - 1)
    s = s.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rn") % len(weights) + 1).cast("int")))
    s = s.withColumn("__cap", (F.col("source_size") * max_repeat).cast("double"))
    by_fill = Window.orderBy(F.col("__cap") / F.col("__w"), "__rn")
    all_rows = Window.partitionBy()
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        F.sum("source_size").over(all_rows).cast("double").alias("__total"),
        F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0)).alias("__full"),
        F.sum("__w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)).alias("__left_w"),
    )
    # With all earlier sources full, the level at this one; the first source that the level does not fill sets it.
    level = (F.col("__total") - F.col("__full")) / F.col("__left_w")
    s = s.withColumn("__level", F.min(F.when(level * F.col("__w") <= F.col("__cap"), F.struct(F.col("__cap") / F.col("__w"), F.col("__rn"), level.alias("level")))).over(all_rows)["level"])
    target = F.when(F.col("__level").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__level") * F.col("__w")))
    return s.select("source", "source_size", target.alias("target"))


def class_shares(sized: DataFrame, targets: DataFrame, max_repeat: int) -> DataFrame:
    """(source, source_size, target, __class, __whole, __pi, need) for each source and class: whole copies, the chance of one more, words the source then lacks."""
    s = sized.groupBy("source", "__class").agg(F.sum("size").cast("long").alias("__words"))
    s = _with(s, targets, False)
    own = Window.partitionBy("source")
    down = own.orderBy(F.desc("__class"))
    full = F.coalesce(F.sum("__words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * max_repeat
    left = F.sum(F.col("__class") * F.col("__words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    # With all larger classes full, the share per digit at this one; the first class that it does not fill sets it.
    s = s.withColumn("__level", F.when(left > 0, (F.col("target") - full) / left))
    s = s.withColumn("__level", F.max(F.when(F.col("__level") * F.col("__class") <= max_repeat, F.struct("__class", F.col("__level").alias("level")))).over(own)["level"])
    due = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("__level").isNull(), F.lit(float(max_repeat))).otherwise(F.least(F.lit(float(max_repeat)), F.col("__level") * F.col("__class")))
    s = s.withColumn("__due", due).withColumn("__whole", F.floor("__due").cast("long")).withColumn("__pi", F.col("__due") - F.col("__whole"))
    need = F.col("target") - F.sum(F.col("__whole") * F.col("__words")).over(own)
    return s.select("source", "source_size", "target", "__class", "__whole", "__pi", need.alias("need"))


def _with(rows: DataFrame, per_source: DataFrame, small: bool, also: str | None = None) -> DataFrame:
    right = per_source.withColumnRenamed("source", "__source")
    on = F.col("source").eqNullSafe(F.col("__source"))
    if also:
        right, on = right.withColumnRenamed(also, "__also"), on & (F.col(also) == F.col("__also"))
    return rows.join(F.broadcast(right) if small else right, on, "left").drop("__source", "__also")


def _boundary(rows: DataFrame, place: str, bits: int, small: bool, enough: int) -> tuple[DataFrame | None, int]:
    """Of rows (source, need, size, place): per source the cell in which a prefix of ``need`` words ends, and what it lacks there (source, __at, __need).

    Cells are narrowed until none holds more than ``enough`` rows or all bits are used; the second value is the bits by which places are shifted
    to give cells. None if no source needs anything.
    """
    at, shift = None, bits
    while shift > 0:
        here = rows if at is None else _with(rows, at, small).filter(F.shiftright(place, shift) == F.col("__at")).withColumn("need", F.col("__need")).drop("__at", "__need")
        shift -= CELL
        sums = here.groupBy("source", F.shiftright(place, shift).alias("__cell")).agg(F.sum("size").alias("__size"), F.count(F.lit(1)).alias("__rows"), F.max("need").alias("need"))
        before = Window.partitionBy("source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).filter(F.col("__before") < F.col("need"))
        last = F.max(F.struct(F.col("__cell").alias("cell"), (F.col("need") - F.col("__before")).alias("need"), F.col("__rows").alias("rows"))).alias("m")
        found = cut(sums.groupBy("source").agg(last).select("source", F.col("m.cell").alias("__at"), F.col("m.need").alias("__need"), F.col("m.rows").alias("__rows")))
        most = found.agg(F.max("__rows")).first()[0]
        if most is None:
            return None, shift
        at = found.drop("__rows")
        if most <= enough:
            break
    return at, shift


def _base(docs: DataFrame, seed: int) -> DataFrame:
    """Adds size, __class, __bits (the draw) and __row, the row's place in the table."""
    docs = docs.withColumn("size", word_count(F.col("text"))).withColumn("__class", F.length(F.bin("size")).cast("long"))
    return docs.withColumn("__bits", digest_bits(F.col("doc_id"), F.lit(seed), F.col("text"))).withColumn("__row", F.monotonically_increasing_id())


def _ranked(base: DataFrame, shares: DataFrame, small: bool) -> DataFrame:
    """Adds source_size, target, __whole, __pi, need, __rank and the rank's place."""
    rows = _with(base, shares, small, "__class")
    u = (F.col("__bits") + 0.5) / float(2**52)
    rows = rows.withColumn("__rank", F.when(F.col("__pi") > 0, (u / (1 - u)) / (F.col("__pi") / (1 - F.col("__pi")))))
    # rank / (1 + rank) maps the ranking onto (0, 1) and keeps its order.
    return rows.withColumn("__place", F.least(F.floor(F.col("__rank") / (1 + F.col("__rank")) * float(1 << PLACE)), F.lit((1 << PLACE) - 1)).cast("long"))


def _group() -> Column:
    return F.struct(F.col("__rank").alias("r"), F.col("doc_id").alias("d"), F.col("size").alias("s"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: int = 3, seed: int = 7, payload: bool = False, few_rows: int = FEW_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of ``docs`` (doc_id, text, source).

    With ``payload`` the rows keep the columns of ``docs`` besides, which are then read once more (and must come in the same order: of a stored
    table); without it only ids and sizes are kept after the first pass.
    """
    names = docs.columns if payload else ["doc_id", "source"]
    sized = cut(_base(docs.select("doc_id", "source", "text"), seed).drop("text"))
    shares = cut(class_shares(sized, source_targets(sized, weights, max_repeat), max_repeat))
    small = shares.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    drawn = _ranked(sized, shares, small).filter(F.col("__pi") > 0).select("doc_id", "source", "size", "need", "__rank", "__place", "__row")
    at, shift = _boundary(drawn, "__place", PLACE, small, few_rows)
    out = _ranked(_base(docs, seed) if payload else sized, shares, small)
    more = F.lit(0)
    if at is not None:
        cell = F.shiftright("__place", shift)
        groups = _with(drawn, at, small).filter(cell == F.col("__at")).groupBy("source", "__rank", "doc_id", "size").agg(F.count(F.lit(1)).alias("__n"), F.max("__need").alias("need"))
        order = Window.partitionBy("source").orderBy("__rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        groups = groups.withColumn("__before", F.coalesce(F.sum(F.col("size") * F.col("__n")).over(order), F.lit(0)))
        # Of n equal rows as many are taken, one by one, as bring the prefix nearer to its end.
        lack = F.col("need") - F.col("__before")
        fit = F.when(F.col("size") == 0, F.when(lack > 0, F.col("__n")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("__n"), F.ceil(lack / F.col("size") - 0.5).cast("long"))))
        stops = groups.withColumn("__fit", fit).filter(F.col("__fit") < F.col("__n"))
        first = F.min(F.struct(_group().alias("group"), F.col("__fit").alias("fit"))).alias("m")
        ends = cut(_with(at, stops.groupBy("source").agg(first).select("source", F.col("m.group").alias("__stop"), F.col("m.fit").alias("__fit")), small))
        if ends.filter("__fit > 0").isEmpty():
            ends = ends.withColumn("__last", F.lit(None).cast("long"))
        else:
            same = _with(drawn.drop("need"), ends, small).filter((F.col("__fit") > 0) & (cell == F.col("__at")) & (_group() == F.col("__stop")))
            same = same.select("source", F.lit(1).alias("size"), F.col("__fit").cast("double").alias("need"), "__row")
            last, _ = _boundary(same, "__row", ROW, small, 0)
            ends = cut(_with(ends, last.select("source", F.col("__at").alias("__last")), small))
        out = _with(out, ends, small)
        in_cell = F.when(F.col("__stop").isNull() | (_group() < F.col("__stop")), 1).when((_group() == F.col("__stop")) & (F.col("__row") <= F.col("__last")), 1)
        more = F.when(cell < F.col("__at"), 1).when(cell == F.col("__at"), in_cell)
    copies = (F.col("__whole") + F.coalesce(more, F.lit(0))).cast("long")
    return out.select(*names, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns of ``docs``, whatever their names."""
    row = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row_of"))
    mixed = mix(row, payload=True, **options).filter(F.col("copies") > 0)
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row_of.*")
