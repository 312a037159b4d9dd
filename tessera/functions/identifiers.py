"""Six identifier families as columns: generation from draws, shape, and checksum validity.

Under the policy ``safe`` the check of a family that has one is moved by a drawn non-zero offset, so that it can never hold; ``validator`` keeps it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import Plan, uniform
from .text import fold_local, local_part

POLICIES = ("safe", "validator")
CHECKSUMMED = ("TCKN", "VKN", "IBAN", "PAN")
ALL = (*CHECKSUMMED, "PHONE", "EMAIL")
# Names reserved for documentation, and a bank code that no bank holds.
RESERVED_HOSTS = ("example.com", "example.net", "example.org")
RESERVED_SUFFIX = ".example"
BANK = "99999"


def _text(digits: list[Column]) -> Column:
    return F.concat(*[d.cast("string") for d in digits])


def _at(c: Column, i: int) -> Column:
    """The i-th digit of a text, from 1; null if there is none."""
    return F.substring(c, i, 1).try_cast("int")


def _total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def tckn_check(d: list[Column]) -> tuple[Column, Column]:
    tenth = F.pmod(_total(d[0:9:2]) * 7 - _total(d[1:8:2]), F.lit(10))
    return tenth, (_total(d[:9]) + tenth) % 10


def vkn_check(d: list[Column]) -> Column:
    terms = []
    for place, digit in enumerate(reversed(d[:9]), 1):
        t = (digit + place) % 10
        weighted = (t * (2**place)) % 9
        terms.append(F.when(t == 0, 0).when(weighted == 0, 9).otherwise(weighted))
    return F.pmod(10 - _total(terms), F.lit(10))


def luhn_check(d: list[Column]) -> Column:
    terms = []
    for k, digit in enumerate(reversed(d[:15])):
        terms.append(F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2) if k % 2 == 0 else digit)
    return F.pmod(10 - _total(terms) % 10, F.lit(10))


def iban_remainder(body: list[Column], check: list[Column]) -> Column:
    """The rearranged number modulo 97: body, the country's letters as 29 and 27, check digits."""
    rest = F.lit(0)
    for d in [*body, *[F.lit(x) for x in (2, 9, 2, 7)], *check]:
        rest = (rest * 10 + d) % 97
    return rest


def _iban_remainder_of(digits: Column) -> Column:
    """As iban_remainder, of a text of digits, nine at a time; null if it holds anything else."""
    rest = F.lit(0).cast("bigint")
    for at in range(1, 29, 9):
        part = F.substring(digits, at, 9)
        rest = (rest * F.pow(F.lit(10), F.length(part)).cast("bigint") + part.try_cast("bigint")) % 97
    return rest


def make_tckn(plan: Plan, policy: str) -> Callable[[Column], Column]:
    read = plan.take(9, *[10] * 8)
    shift = uniform(plan, 1, 9) if policy == "safe" else None

    def value(x: Column) -> Column:
        d = read(x)
        d[0] = d[0] + 1
        tenth, eleventh = tckn_check(d)
        return _text([*d, tenth, (eleventh + shift(x)) % 10 if shift else eleventh])

    return value


def make_vkn(plan: Plan, policy: str) -> Callable[[Column], Column]:
    read = plan.take(*[10] * 9)
    shift = uniform(plan, 1, 9) if policy == "safe" else None

    def value(x: Column) -> Column:
        d = read(x)
        check = vkn_check(d)
        return _text([*d, (check + shift(x)) % 10 if shift else check])

    return value


def make_iban(plan: Plan, policy: str) -> Callable[[Column], Column]:
    read = plan.take(*[10] * 16)
    shift = uniform(plan, 1, 96) if policy == "safe" else None

    def value(x: Column) -> Column:
        account = _text(read(x))
        body = F.concat(F.lit(f"{BANK}0"), account)
        check = 98 - _iban_remainder_of(F.concat(body, F.lit("292700")))
        if shift:
            check = (check - 2 + shift(x)) % 97 + 2
        return F.concat(F.lit("TR"), F.lpad(check.cast("string"), 2, "0"), body)

    return value


def make_pan(plan: Plan, policy: str) -> Callable[[Column], Column]:
    read = plan.take(*[10] * 14)
    shift = uniform(plan, 1, 9) if policy == "safe" else None

    def value(x: Column) -> Column:
        d = [F.lit(9), *read(x)]
        check = luhn_check(d)
        return _text([*d, (check + shift(x)) % 10 if shift else check])

    return value


def make_phone(plan: Plan, policy: str) -> Callable[[Column], Column]:
    read = plan.take(*[10] * 9)

    def value(x: Column) -> Column:
        d = read(x)
        return F.concat(F.lit("+90 5"), _text(d[:2]), F.lit(" "), _text(d[2:5]), F.lit(" "), _text(d[5:7]), F.lit(" "), _text(d[7:]))

    return value


def make_email(plan: Plan, first: Column, last: Column, nameless: bool, subdomain: str | None = None) -> Callable[[Column], Column]:
    """An address under a reserved name. ``nameless`` plans the draws of rows without both names, which take a serial first."""
    serial = plan.take(10_000) if nameless else None
    host = None if subdomain else plan.take(len(RESERVED_HOSTS))
    suffix = uniform(plan, 1, 9999)

    def value(x: Column) -> Column:
        local = F.concat(F.lit("kullanici"), F.lpad(serial(x)[0].cast("string"), 4, "0")) if serial else local_part(first, last)
        at = F.concat(fold_local(F.lit(subdomain)), F.lit(RESERVED_SUFFIX)) if host is None else F.get(F.array(*[F.lit(h) for h in RESERVED_HOSTS]), host(x)[0].cast("int"))
        return F.concat(local, F.lit("."), suffix(x).cast("string"), F.lit("@"), at)

    return value


def mask_pan(c: Column) -> Column:
    return F.when(F.length(c) == 16, F.concat(F.substring(c, 1, 6), F.lit("******"), F.substring(c, 13, 4))).otherwise(F.raise_error(F.lit("a PAN has 16 digits")).cast("string"))


def group_iban(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), "(.{4})", "$1 "))


def compact_phone(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def valid_tckn(c: Column) -> Column:
    d = [_at(c, i) for i in range(1, 12)]
    tenth, eleventh = tckn_check(d)
    return F.when(c.rlike(r"\A[1-9][0-9]{10}\z"), (d[9] == tenth) & (d[10] == eleventh)).otherwise(F.lit(False))


def valid_vkn(c: Column) -> Column:
    d = [_at(c, i) for i in range(1, 11)]
    return F.when(c.rlike(r"\A[0-9]{10}\z"), d[9] == vkn_check(d)).otherwise(F.lit(False))


def valid_iban(c: Column) -> Column:
    plain = F.replace(c, F.lit(" "), F.lit(""))
    check = F.substring(plain, 3, 2)
    number = F.concat(F.substring(plain, 5, 22), F.lit("2927"), check)
    inside = check.try_cast("int").between(2, 98)
    return F.when(plain.rlike(r"\ATR[0-9]{24}\z") & inside, _iban_remainder_of(number) == 1).otherwise(F.lit(False))


def valid_pan(c: Column) -> Column:
    return F.when(c.rlike(r"\A[0-9]{16}\z"), F.call_function("luhn_check", c)).otherwise(F.lit(False))


def reserved_email(c: Column) -> Column:
    host = F.lower(F.substring_index(c, "@", -1))
    return c.contains("@") & (host.isin(*RESERVED_HOSTS) | host.endswith(RESERVED_SUFFIX))


def shape_iban(c: Column) -> Column:
    return c.rlike(r"\A(TR[0-9]{24}|TR[0-9]{2}( [0-9]{4}){5} [0-9]{2})\z")


@dataclass(frozen=True)
class Family:
    name: str
    make: Callable[[Plan, str], Callable[[Column], Column]] | None
    valid: Callable[[Column], Column]
    shape: Callable[[Column], Column]


_NEVER = lambda c: F.lit(False)

FAMILIES: dict[str, Family] = {
    f.name: f
    for f in (
        Family("TCKN", make_tckn, valid_tckn, lambda c: c.rlike(r"\A[1-9][0-9]{10}\z")),
        Family("VKN", make_vkn, valid_vkn, lambda c: c.rlike(r"\A[0-9]{10}\z")),
        Family("IBAN", make_iban, valid_iban, shape_iban),
        Family("PAN", make_pan, valid_pan, lambda c: c.rlike(r"\A([0-9]{16}|[0-9]{6}\*{6}[0-9]{4})\z")),
        Family("PHONE", make_phone, _NEVER, lambda c: c.rlike(r"\A\+90 5[0-9]{2} [0-9]{3} [0-9]{2} [0-9]{2}\z")),
        Family("EMAIL", None, _NEVER, lambda c: c.rlike(r"\A[^@ ]+@[^ ]*\z") & reserved_email(c)),
    )
}


def valid_under(c: Column) -> Column:
    """Names of the checksums that a candidate satisfies."""
    hits = [F.when(FAMILIES[name].valid(c), F.lit(name)) for name in CHECKSUMMED]
    return F.array_compact(F.array(*hits))


def impostor(c: Column, label: Column) -> Column:
    """The first family whose shape a surface has though its label is another one."""
    out = None
    for name in ALL:
        hit = FAMILIES[name].shape(c) & (label != name)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out
