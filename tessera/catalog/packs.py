"""Queries on packs: planned tables, rendered documents, and reports on a dataset that is generated for them."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from ..functions.text import text_digest
from ..plans import mint as m
from ..plans import verify as v
from ..plans.spec import load_pack
from ..plans.streams import stream_prefix
from ..sources.library import HERE, Library
from . import generate as g
from . import oracle as o
from .data import GIVEN, SURNAMES
from .generate import START, read

SAMPLE = HERE / "packs" / "sample"


def _plan(spark, members: int, payments: int, policy: str = "safe") -> m.Plan:
    pack = load_pack(SAMPLE)
    return m.Plan(spark, pack, pack.recipe("demo"), 42, policy, {"member": members, "payment": payments})


def _planned(spark, sf_dir, table: str) -> m.Minted:
    """The sample pack's tables in the sizes of customers and suppliers of the fixtures."""
    members = read(spark, sf_dir, "customer").count()
    plan = _plan(spark, members, members * 5 // 4)
    return plan.table(next(t for t in plan.pack.tables if t.name == table))


def plan_members(spark, sf_dir):
    planned = _planned(spark, sf_dir, "member")
    return planned.rows.select(*planned.columns)


def plan_payments(spark, sf_dir):
    planned = _planned(spark, sf_dir, "payment")
    return planned.rows.select(*planned.columns)


def render_docs(spark, sf_dir):
    rows = _planned(spark, sf_dir, "payment").rows
    return rows.select("payment_id", "note", text_digest(F.col("note")).alias("text_sha256"), F.size("__spans").alias("n_spans"))


def render_spans(spark, sf_dir):
    rows = _planned(spark, sf_dir, "payment").rows.select("payment_id", "note", F.explode("__spans").alias("s"))
    return rows.select("payment_id", "s.start", "s.end", "s.label", F.substring("note", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("surface"))


def json_lines(spark, sf_dir):
    return m.lines(_planned(spark, sf_dir, "member"), "jsonl").select("line")


def csv_lines(spark, sf_dir):
    return m.lines(_planned(spark, sf_dir, "member"), "csv").select("line")


def sidecar_lines(spark, sf_dir):
    return m.sidecar_lines(_planned(spark, sf_dir, "payment")).select("line")


def verify_report(spark, sf_dir):
    with tempfile.TemporaryDirectory() as tmp:
        out = Path(tmp) / "sample"
        m.mint(spark, pack=SAMPLE, recipe="demo", seed=42, out=out)
        r = v.verify(spark, out)
        rows = [(r.ok, r.checksums_matched, r.documents_checked, r.spans_checked, r.checksum_valid_identifiers, len(r.problems))]
    return spark.createDataFrame(rows, "ok boolean, checksums_matched int, documents_checked int, spans_checked int, valid_identifiers int, problems int")


def reproduce_report(spark, sf_dir):
    with tempfile.TemporaryDirectory() as tmp:
        out = Path(tmp) / "sample"
        m.mint(spark, pack=SAMPLE, recipe="demo", seed=42, out=out, fmt="csv", identifier_policy="validator", records={"member": 30, "payment": 40})
        r = v.reproduce(spark, out, pack=SAMPLE)
    return spark.createDataFrame([(r.ok, len(r.differing), len(r.drift))], "ok boolean, differing int, drift int")


def packcheck_report(spark, sf_dir):
    problems = v.packcheck(spark, SAMPLE)
    return spark.createDataFrame([(not problems, len(problems))], "ok boolean, problems int")


def _members_sql() -> str:
    """The member table of the sample pack, field by field, each from its own site."""
    prefix = stream_prefix(42, "tessera-sample", "1.0.0", "demo")
    rows = "(SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS i)"
    one = lambda field, k, value: (field, g._sql(rows, "i", field, k, f"{value} AS {field}", kind="member", prefix=prefix))
    low, high = (START - (65 * 365 + 16) * 86400, START - (18 * 365 + 4) * 86400)
    knots = "[" + ", ".join(map(str, Library().table("balances"))) + "]::BIGINT[]"
    at = f"{o.modulo(1, 1023)} + 1"
    made = g.identifier_sql(safe=True)
    plain = lambda c: f"regexp_replace({o.fold(c)}, '[^0-9a-z]', '', 'g')"
    fields = [
        one("first_name", 1, f"{o.texts(GIVEN)}[{o.modulo(1, len(GIVEN))} + 1]"),
        one("last_name", 1, f"{o.texts(SURNAMES)}[{o.modulo(1, len(SURNAMES))} + 1]"),
        one("national_id", 10, made["tckn"][2]),
        one("card", 15, g.masked_sql(made["pan_masked"][2])),
        one("email", 2, f"concat('.', {o.modulo(2, 9999)} + 1, '@', ['example.com', 'example.net', 'example.org'][{o.modulo(1, 3)} + 1])"),
        one("phone", 9, g.phone_sql()),
        one("birth_date", 1, g._local_day(f"({o.modulo(1, high - low)} + {low})")),
        one("tier", 1, g._weighted_sql(o.modulo(1, 10), [7, 2, 1], ["'basic'", "'plus'", "'gold'"])),
        one("balance", 2, f"({knots})[{at}] + ((({knots})[{at} + 1] - ({knots})[{at}]) * {o.modulo(2, 1 << 20)}) // {1 << 20}"),
        one("score", 1, f"{o.modulo(1, 11)} - 5"),
    ]
    joined = " ".join(f"JOIN ({sql}) {name}_t USING (i)" for name, sql in fields)
    columns = "first_name, last_name, national_id, card, concat({}, '.', {}, email) AS email, phone, birth_date, tier, balance, score".format(plain("first_name"), plain("last_name"))
    return f"SELECT concat('MEM-', lpad(i::VARCHAR, 8, '0')) AS member_id, {columns} FROM {rows} {joined}"


def _json_sql() -> str:
    texts = ["member_id", "first_name", "last_name", "national_id", "card", "email", "phone", "birth_date", "tier"]
    parts = ", ".join(f"'{',' if k else '{'}\"{c}\":\"', {c}, '\"'" for k, c in enumerate(texts))
    return f"SELECT concat({parts}, ',\"balance\":', balance, ',\"score\":', score, '}}') AS line FROM ({_members_sql()})"


PREFIX_SQL = stream_prefix(42, "tessera-sample", "1.0.0", "demo")
_PAYMENTS = "(SELECT unnest(range(0, (SELECT count(*) FROM customer) * 5 // 4)) AS i)"


def _iban_sql(start: int) -> str:
    """A safe IBAN from the outputs from ``start`` on."""
    body = o.joined(["'999990'", *o.digits(start, 16)])
    check = f"((98 - concat({body}, '292700')::HUGEINT % 97 - 2 + {o.modulo(start + 16, 96)} + 1) % 97 + 2)"
    return o.joined(["'TR'", f"lpad({check}::VARCHAR, 2, '0')", body])


def _parents_sql() -> str:
    """(i, parent): payments dealt to members; all slots that a member may give up or take are listed in order, and the first ones used."""
    src = "SELECT i AS id, concat('payment/member_id/', i, '/count') AS site FROM (SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS i)"
    case = g._weighted_sql(o.modulo(1, 10), [2, 4, 3, 1], ["0", "1", "2", "3"])
    return f"""(WITH {o.draws(src, PREFIX_SQL, 1)},
drawn AS (SELECT id AS p, ({case})::BIGINT AS c FROM d),
goal AS (SELECT (SELECT count(*) FROM customer) * 5 // 4 AS n, (SELECT sum(c)::BIGINT FROM drawn) AS t),
give AS (SELECT p, row_number() OVER (ORDER BY p DESC, k) AS r FROM (SELECT p, unnest(range(0, c)) AS k FROM drawn)),
gave AS (SELECT p, count(*) AS x FROM give, goal WHERE r <= t - n GROUP BY p),
room AS (SELECT p, row_number() OVER (ORDER BY k, p) AS r FROM (SELECT p, unnest(range(c, 3)) - c AS k FROM drawn)),
took AS (SELECT p, count(*) AS x FROM room, goal WHERE r <= n - t GROUP BY p),
dealt AS (SELECT p, c - coalesce(gave.x, 0) + coalesce(took.x, 0) AS c FROM drawn LEFT JOIN gave USING (p) LEFT JOIN took USING (p))
SELECT (row_number() OVER (ORDER BY p, k) - 1)::BIGINT AS i, p AS parent FROM (SELECT p, unnest(range(c)) AS k FROM dealt))"""


def _payment_fields_sql() -> str:
    """(i, ...): the payment table of the sample pack without its documents."""
    one = lambda field, k, value: f"JOIN ({g._sql(_PAYMENTS, 'i', field, k, f'{value} AS {field}', kind='payment', prefix=PREFIX_SQL)}) {field}_t USING (i)"
    knots = "[" + ", ".join(map(str, Library().table("txn_amounts"))) + "]::BIGINT[]"
    at = f"{o.modulo(1, len(Library().table('txn_amounts')) - 1)} + 1"
    fields = [
        one("ts", 1, g._local_time(f"({o.modulo(1, g.END - START)} + {START})")),
        one("amount", 2, f"({knots})[{at}] + ((({knots})[{at} + 1] - ({knots})[{at}]) * {o.modulo(2, 1 << 20)}) // {1 << 20}"),
        one("anomaly", 1, g._weighted_sql(o.modulo(1, 100), [90, 6, 4], ["'none'", "'late'", "'twice'"])),
        one("iban", 18, f"CASE WHEN {o.modulo(1, 100)} >= 35 THEN {_iban_sql(2)} END"),
    ]
    columns = "concat('PAY-', lpad(i::VARCHAR, 8, '0')) AS payment_id, concat('MEM-', lpad(parent::VARCHAR, 8, '0')) AS member_id, ts, strftime(substr(ts, 1, 10)::DATE + 30, '%Y-%m-%d') AS due, amount, (amount * 82) // 100 AS net, amount AS mirror, anomaly, anomaly <> 'none' AS is_anomaly, iban"
    return f"SELECT i, {columns} FROM {_PAYMENTS} JOIN {_parents_sql()} r USING (i) {' '.join(fields)}"


def _notes_sql() -> str:
    """The payment table with its documents and their spans: each of the three templates written out, with its own count of outputs before each slot."""
    lib = Library()
    pick = lambda values, k: f"({o.texts(values)})[{o.modulo(k, len(values))} + 1]"
    person, firm, health, places = (lib.surfaces("PERSON"), lib.surfaces("ORG"), lib.surfaces("HEALTH"), lib.lexicon("places_tr"))
    vkn = o.digits(2, 9)
    vkn = o.joined([*vkn, f"(({o.vkn_rule(vkn)} + {o.modulo(11, 9)} + 1) % 10)"])
    pan = ["9", *o.digits(13, 14)]
    pan = g.masked_sql(o.joined([*pan, f"(({o.luhn_rule(pan)} + {o.modulo(27, 9)} + 1) % 10)"]))
    d = o.digits(13, 9)
    phone = o.joined(["'+90 5'", *d[:2], "' '", *d[2:5], "' '", *d[5:7], "' '", *d[7:]])
    mail = f"concat('kullanici', lpad({o.modulo(13, 10000)}::VARCHAR, 4, '0'), '.', {o.modulo(15, 9999)} + 1, '@', ['example.com', 'example.net', 'example.org'][{o.modulo(14, 3)} + 1])"
    span = lambda start, surface, label: f"{{'start': ({start})::INT, 'end': ({start} + length({surface}))::INT, 'label': '{label}'}}"
    draws = g._sql(_PAYMENTS, "i", "note/render", 28, "d", kind="payment", prefix=PREFIX_SQL)
    chosen = g._sql(_PAYMENTS, "i", "note/pick", 1, g._weighted_sql(o.modulo(1, 10), [5, 3, 2], ["0", "1", "2"]) + " AS template", kind="payment", prefix=PREFIX_SQL)
    parts = f"""SELECT p.*, template, {o.modulo(2, 2)} AS way, {o.modulo(3, 10)} < 4 AS told, {o.modulo(18, 100)} < 25 AS special, {o.modulo(12, 3)} AS kind,
{pick(person, 1)} AS person, {_iban_sql(1)} AS own, {pick(health, 19)} AS health, {pick(firm, 1)} AS firm, {vkn} AS vkn, {pan} AS pan, {phone} AS phone, {mail} AS mail,
{pick(places, 28)} AS place_pan, {pick(places, 22)} AS place_phone, {pick(places, 16)} AS place_mail, coalesce(concat(iban, ' '), '') AS lead
FROM ({_payment_fields_sql()}) p JOIN ({draws}) USING (i) JOIN ({chosen}) USING (i)"""
    lead = "CASE WHEN iban IS NULL THEN '' ELSE concat(iban, ' ') END"
    by_kind = lambda a, b, c: f"CASE kind WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END"
    note = f"""CASE template WHEN 0 THEN concat(person, ' adina ', ['havale', 'EFT'][way + 1], ' yapildi', CASE WHEN told THEN concat(', tutar ', amount) ELSE '' END, '.')
WHEN 1 THEN concat({lead}, own, ' hesabina aktarildi', CASE WHEN special THEN concat('; ', health, ' nedeniyle') ELSE '' END, '.')
ELSE concat(firm, ' {{', vkn, '}} faturasi, ', {by_kind("concat('kart ', pan)", "concat('tel ', phone)", "concat('posta ', mail)")}, ', ', {by_kind('place_pan', 'place_phone', 'place_mail')}, '.') END"""
    behind = f"(length({lead}) + 26 + length(' hesabina aktarildi; '))"
    contact = "(length(firm) + length(vkn) + length(' {} faturasi, '))"
    found = f"""CASE template WHEN 0 THEN [{span('0', 'person', 'PERSON')}]
WHEN 1 THEN list_concat(CASE WHEN iban IS NULL THEN [] ELSE [{span('0', 'iban', 'IBAN')}] END, [{span(f'length({lead})', 'own', 'IBAN')}], CASE WHEN special THEN [{span(behind, 'health', 'HEALTH')}] ELSE [] END)
ELSE list_concat([{span('0', 'firm', 'ORG')}, {span('length(firm) + 2', 'vkn', 'VKN')}], {by_kind(f"[{span(f'{contact} + 5', 'pan', 'PAN')}]", f"[{span(f'{contact} + 4', 'phone', 'PHONE')}]", f"[{span(f'{contact} + 6', 'mail', 'EMAIL')}]")}) END"""
    return f"SELECT *, {note} AS note, {found} AS spans FROM ({parts})"


def _sidecar_sql() -> str:
    one = """list_transform(spans, lambda s: concat('{"start":', s.start, ',"end":', s."end", ',"label":"', s.label, '"}'))"""
    return f"""SELECT concat('{{"doc_id":"', payment_id, '","text_sha256":"', sha256(note), '","spans":[', array_to_string({one}, ','), ']}}') AS line FROM ({_notes_sql()})"""


QUERIES = {f.__name__: f for f in (plan_members, plan_payments, render_docs, render_spans, json_lines, csv_lines, sidecar_lines, verify_report, reproduce_report, packcheck_report)}
ORACLE: dict[str, str] = {
    "plan_members": _members_sql(),
    "plan_payments": f"SELECT payment_id, member_id, ts, due, amount, net, mirror, anomaly, is_anomaly, iban, note FROM ({_notes_sql()})",
    "render_docs": f"SELECT payment_id, note, sha256(note) AS text_sha256, len(spans)::INT AS n_spans FROM ({_notes_sql()})",
    "render_spans": f'SELECT payment_id, s.start AS start, s."end" AS "end", s.label AS label, substr(note, s.start + 1, s."end" - s.start) AS surface FROM (SELECT payment_id, note, unnest(spans) AS s FROM ({_notes_sql()}))',
    "sidecar_lines": _sidecar_sql(),
    "json_lines": _json_sql(),
    "csv_lines": f"SELECT concat_ws(',', member_id, first_name, last_name, national_id, card, email, phone, birth_date, tier, balance, score) AS line FROM ({_members_sql()})",
    "reproduce_report": "SELECT true AS ok, 0::INT AS differing, 0::INT AS drift",
    "packcheck_report": "SELECT true AS ok, 0::INT AS problems",
}
