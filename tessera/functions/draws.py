"""Draws from a stream: uniform, weighted, Bernoulli, windows, table interpolation.

A draw is described on the driver by the bounds that it consumes and by a function of the drawn integers. ``Plan`` collects the draws of one
site in order; the same site with the same declarations always consumes the same outputs of its stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most decimal places of a weight or a rate.
MAX_PLACES = 19


class DrawError(ValueError):
    """A declaration that no draw can follow. ``rule`` names the rule it breaks."""

    def __init__(self, rule: str, detail: str):
        super().__init__(f"{rule}: {detail}")
        self.rule = rule


def scaled_decimal(text: str, places: int | None = None) -> tuple[int, int]:
    """(integer, places) of a non-negative decimal string; the places are those written."""
    if not isinstance(text, str) or not text:
        raise DrawError("invalid-decimal", f"{text!r} is not a decimal string")
    try:
        value = Decimal(text)
    except InvalidOperation:
        raise DrawError("invalid-decimal", f"{text!r} is not a decimal string") from None
    if not value.is_finite():
        raise DrawError("invalid-decimal", f"{text!r} is not finite")
    if value < 0:
        raise DrawError("negative-weight", f"{text!r} is below zero")
    own = max(0, -value.as_tuple().exponent)
    if own > MAX_PLACES:
        raise DrawError("decimal-precision-limit", f"{text!r} has more than {MAX_PLACES} places")
    places = own if places is None else places
    return int(value.scaleb(places)), places


def scale_weights(weights: Sequence[str]) -> list[int]:
    """Decimal strings as integers at the most places that any of them has."""
    if not weights:
        raise DrawError("zero-weight-total", "no weights")
    places = max(scaled_decimal(w)[1] for w in weights)
    out = [scaled_decimal(w, places)[0] for w in weights]
    if sum(out) == 0:
        raise DrawError("zero-weight-total", "weights sum to zero")
    if sum(out) > 1 << 64:
        raise DrawError("sampler-domain-limit", "weights sum above 2^64")
    return out


def scaled_rate(rate: str) -> tuple[int, int]:
    """(threshold, bound) of a probability. The places written decide the bound, so 0.30 and 0.3 are different draws."""
    value, places = scaled_decimal(rate)
    bound = 10**places
    if value > bound:
        raise DrawError("probability-out-of-range", f"{rate!r} is above one")
    return value, bound


@dataclass
class Plan:
    """The draws of one site in order: their bounds, and a reader for each named value."""

    bounds: list[int] = field(default_factory=list)

    def take(self, *bounds: int) -> Callable[[Column], list[Column]]:
        at = len(self.bounds)
        self.bounds.extend(bounds)
        return lambda drawn: [drawn[at + i] for i in range(len(bounds))]


def uniform(plan: Plan, low: int, high: int) -> Callable[[Column], Column]:
    """Integer from low to high, both included."""
    read = plan.take(high - low + 1)
    return lambda d: read(d)[0] + F.lit(low)


def pick_weighted(plan: Plan, weights: Sequence[int]) -> Callable[[Column], Column]:
    """Index of the first weight whose running sum exceeds the draw; a zero weight is never chosen."""
    read = plan.take(sum(weights))

    def value(d: Column) -> Column:
        draw, out, total = read(d)[0], None, 0
        for i, w in enumerate(weights):
            total += w
            if w and total < 1 << 63:
                out = (F.when if out is None else out.when)(draw < F.lit(total), F.lit(i))
        last = max(i for i, w in enumerate(weights) if w)
        return (F.lit(last) if out is None else out.otherwise(F.lit(last))).cast("int")

    return value


def bernoulli(plan: Plan, rate: str) -> Callable[[Column], Column]:
    """True with probability ``rate``; zero and one consume nothing."""
    threshold, bound = scaled_rate(rate)
    if threshold == 0:
        return lambda d: F.lit(False)
    if threshold == bound:
        return lambda d: F.lit(True)
    read = plan.take(bound)
    return lambda d: read(d)[0] < F.lit(threshold)


def from_list(plan: Plan, values: Sequence[str]) -> Callable[[Column], Column]:
    """One of the values, uniformly."""
    read = plan.take(len(values))
    held = F.array(*[F.lit(v) for v in values])
    return lambda d: F.get(held, read(d)[0].cast("int"))


#: Subdivisions of a table's interval.
STEPS = 1 << 20


def from_table(plan: Plan, knots: Sequence[int]) -> Callable[[Column], Column]:
    """Interval, then offset within it, interpolated in integers."""
    read = plan.take(len(knots) - 1, STEPS)
    held = F.array(*[F.lit(int(k)).cast("bigint") for k in knots])

    def value(d: Column) -> Column:
        interval, offset = read(d)
        low, high = F.get(held, interval.cast("int")), F.get(held, interval.cast("int") + 1)
        return low + F.shiftright((high - low) * offset, 20)

    return value


def instant_in(plan: Plan, start: int, end: int) -> Callable[[Column], Column]:
    """Epoch second in [start, end)."""
    return uniform(plan, start, end - 1)


DAY = 86_400
OFFSET_SECONDS = 10_800


def local_datetime(epoch: Column, offset: str = "+03:00", seconds: int = OFFSET_SECONDS) -> Column:
    """ISO seconds at a fixed offset, by calendar arithmetic alone: the session's time zone plays no part."""
    local = epoch + F.lit(seconds)
    day = F.floor(local / F.lit(DAY)).cast("int")
    second = (local - day.cast("bigint") * F.lit(DAY)).cast("int")
    hour, minute = F.floor(second / 3600).cast("int"), F.floor(second / 60).cast("int") % 60
    return F.format_string(f"%sT%02d:%02d:%02d{offset}", local_date(epoch, seconds), hour, minute, second % 60)


def local_date(epoch: Column, seconds: int = OFFSET_SECONDS) -> Column:
    day = F.floor((epoch + F.lit(seconds)) / F.lit(DAY)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string")


def age_seconds(years: int) -> int:
    return (years * 365 + years // 4) * DAY


def age_window(start: int, low: int, high: int) -> tuple[int, int]:
    """The window of births of people who are low to high years old at ``start``."""
    return start - age_seconds(high), start - age_seconds(low)
