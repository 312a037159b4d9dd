"""Pieces of SQL for DuckDB that say what the column builders compute, written independently of them."""

from __future__ import annotations

G, A, B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
M = "18446744073709551616::UHUGEINT"
SPACES = r"\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def blob(prefix: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in prefix) + "'::BLOB"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def seeds(source: str, prefix: bytes) -> str:
    """CTE s(id, seed) from a query with columns id and site."""
    return f"s AS (SELECT id, ('0x' || substr(sha256({blob(prefix)} || encode(site)), 1, 16))::UBIGINT::UHUGEINT AS seed FROM ({source}))"


def draws(source: str, prefix: bytes, k: int) -> str:
    """CTEs up to d(id, d): the first k outputs of each row's stream as a list, indexed from 1."""
    return f"""{seeds(source, prefix)},
z0 AS (SELECT id, k, (seed + k * {G}::UHUGEINT) % {M} AS z FROM s, (SELECT unnest(range(1, {k + 1}))::UHUGEINT AS k)),
z1 AS (SELECT id, k, (xor(z, z >> 30) * {A}::UHUGEINT) % {M} AS z FROM z0),
z2 AS (SELECT id, k, (xor(z, z >> 27) * {B}::UHUGEINT) % {M} AS z FROM z1),
d AS (SELECT id, list(xor(z, z >> 31) ORDER BY k) AS d FROM z2 GROUP BY id)"""


def modulo(i: int, n: int) -> str:
    return f"(d[{i}] % {n}::UHUGEINT)::BIGINT"


def digits(start: int, n: int) -> list[str]:
    return [modulo(i, 10) for i in range(start, start + n)]


def joined(parts: list[str]) -> str:
    return "concat(" + ", ".join(parts) + ")"


def fold(c: str) -> str:
    return f"lower(translate({c}, 'ıİIşŞçÇğĞüÜöÖâÂîÎûÛ', 'iiissccgguuooaaiiuu'))"


def tckn_rules(d: list[str]) -> tuple[str, str]:
    """Expressions of the tenth and eleventh digit."""
    odd, even = " + ".join(d[0:9:2]), " + ".join(d[1:8:2])
    tenth = f"((((({odd}) * 7 - ({even})) % 10) + 10) % 10)"
    return tenth, f"((({' + '.join(d[:9])}) + {tenth}) % 10)"


def vkn_rule(d: list[str]) -> str:
    terms = []
    for p, x in enumerate(reversed(d[:9]), 1):
        t = f"((({x}) + {p}) % 10)"
        terms.append(f"(CASE WHEN {t} = 0 THEN 0 WHEN ({t} * {2**p}) % 9 = 0 THEN 9 ELSE ({t} * {2**p}) % 9 END)")
    return f"((10 - ({' + '.join(terms)}) % 10) % 10)"


def luhn_rule(d: list[str]) -> str:
    terms = [f"(CASE WHEN ({x}) > 4 THEN ({x}) * 2 - 9 ELSE ({x}) * 2 END)" if k % 2 == 0 else f"({x})" for k, x in enumerate(reversed(d[:15]))]
    return f"((10 - ({' + '.join(terms)}) % 10) % 10)"


def char_digits(c: str, n: int) -> list[str]:
    return [f"substr({c}, {i}, 1)::INT" for i in range(1, n + 1)]


def valid(kind: str, c: str) -> str:
    if kind == "TCKN":
        d = char_digits(c, 11)
        tenth, eleventh = tckn_rules(d)
        return f"(CASE WHEN regexp_full_match({c}, '[1-9][0-9]{{10}}') THEN {d[9]} = {tenth} AND {d[10]} = {eleventh} ELSE false END)"
    if kind == "VKN":
        d = char_digits(c, 10)
        return f"(CASE WHEN regexp_full_match({c}, '[0-9]{{10}}') THEN {d[9]} = {vkn_rule(d)} ELSE false END)"
    if kind == "PAN":
        d = char_digits(c, 16)
        return f"(CASE WHEN regexp_full_match({c}, '[0-9]{{16}}') THEN {d[15]} = {luhn_rule(d)} ELSE false END)"
    if kind == "IBAN":
        p = f"replace({c}, ' ', '')"
        return f"(CASE WHEN regexp_full_match({p}, 'TR[0-9]{{24}}') THEN substr({p}, 3, 2)::INT BETWEEN 2 AND 98 AND concat(substr({p}, 5), '2927', substr({p}, 3, 2))::HUGEINT % 97 = 1 ELSE false END)"
    raise ValueError(kind)


SHAPES = {
    "TCKN": "[1-9][0-9]{10}",
    "VKN": "[0-9]{10}",
    "IBAN": "TR[0-9]{24}|TR[0-9]{2}( [0-9]{4}){5} [0-9]{2}",
    "PAN": "[0-9]{16}|[0-9]{6}[*]{6}[0-9]{4}",
    "PHONE": "[+]90 5[0-9]{2} [0-9]{3} [0-9]{2} [0-9]{2}",
}


def shape(kind: str, c: str) -> str:
    if kind == "EMAIL":
        return f"(regexp_full_match({c}, '[^@ ]+@[^ ]*') AND {reserved(c)})"
    return f"regexp_full_match({c}, '{SHAPES[kind]}')"


def reserved(c: str) -> str:
    host = f"lower(split_part({c}, '@', -1))"
    return f"(contains({c}, '@') AND ({host} IN ('example.com', 'example.org', 'example.net') OR ends_with({host}, '.example')))"


def candidates(c: str) -> str:
    """Digit-run candidates of a text, distinct and in order (texts without IBANs)."""
    tokens = f"list_filter(regexp_split_to_array({c}, '[^0-9A-Za-z]+'), lambda t: regexp_full_match(t, '[0-9]{{10,19}}'))"
    return f"list_filter({tokens}, lambda t, i: list_position({tokens}, t) = i)"
