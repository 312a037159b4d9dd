"""Queries that generate: streams, draws, fields, identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws as dr
from ..functions import identifiers as ids
from ..functions import u64
from ..plans.mint import derived
from ..plans.streams import stream_prefix
from . import oracle as o
from .data import GIVEN, PLACES, SURNAMES, amounts_table

PREFIX = stream_prefix(42, "fixtures", "1.0.0", "catalog")
Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site(kind: str, key: str, field: str) -> Column:
    """A row's site."""
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"), F.lit(f"/{field}"))


def site_sql(kind: str, key: str, field: str) -> str:
    """The same for the oracle."""
    return f"concat('{kind}/', {key}, '/{field}')"


def drawn(spark: SparkSession, df: DataFrame, keep: list[str], at: Column, plan: dr.Plan, columns: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """keep columns, and columns computed from the site's draws."""
    with u64.wrapping(spark):
        seeded = u64.with_streams(df, {"__seed": (PREFIX, at)})
        ready = u64.with_draws(seeded, {"__d": ("__seed", plan.bounds)})
        return ready.select(*keep, *[c.alias(n) for n, c in columns(F.col("__d")).items()])


def source(table: str, key: str, sql_site: str) -> str:
    return f"SELECT {key} AS id, {sql_site} AS site FROM {table}"


def stream_seed(spark, sf_dir):
    at = site("customer", "c_custkey", "seed")
    with u64.wrapping(spark):
        return read(spark, sf_dir, "customer").select("c_custkey", F.format_string("%016x", u64.stream_seed(PREFIX, at)).alias("seed_hex"))


def prng_u64(spark, sf_dir):
    at = site("customer", "c_custkey", "raw")
    with u64.wrapping(spark):
        seeded = u64.with_streams(read(spark, sf_dir, "customer").select("c_custkey"), {"seed": (PREFIX, at)})
        out = seeded.select("c_custkey", F.posexplode(u64.outputs(F.col("seed"), 4)).alias("k", "z"))
        return out.select("c_custkey", F.col("k").cast("bigint").alias("k"), u64.as_decimal(F.col("z")).cast("string").alias("output"))


def draw_bounded(spark, sf_dir):
    plan = dr.Plan()
    reads = {f"below_{n}": plan.take(n) for n in (7, 1, 1000, 1 << 40, 10**9 + 7)}
    at = site("orders", "o_orderkey", "bounded")
    return drawn(spark, read(spark, sf_dir, "orders"), ["o_orderkey"], at, plan, lambda d: {k: r(d)[0] for k, r in reads.items()})


def draw_wide(spark, sf_dir):
    """Bounds above 2^62, where every other candidate may be rejected."""
    plan = dr.Plan()
    reads = [plan.take((1 << 63) + 1), plan.take((1 << 63) + 1)]
    at = site("customer", "c_custkey", "wide")
    return drawn(spark, read(spark, sf_dir, "customer"), ["c_custkey"], at, plan, lambda d: {f"draw_{i}": u64.as_decimal(r(d)[0]).cast("string") for i, r in enumerate(reads)})


def draw_range(spark, sf_dir):
    plan = dr.Plan()
    a, b = dr.uniform(plan, -50, 50), dr.uniform(plan, 2005, 2026)
    at = site("orders", "o_orderkey", "range")
    return drawn(spark, read(spark, sf_dir, "orders"), ["o_orderkey"], at, plan, lambda d: {"around_zero": a(d), "model_year": b(d)})


def draw_weighted(spark, sf_dir):
    plan = dr.Plan()
    w, one, tenth = dr.pick_weighted(plan, dr.scale_weights(["0.55", "0", "0.30", "0.15"])), dr.pick_weighted(plan, dr.scale_weights(["1"])), dr.pick_weighted(plan, dr.scale_weights(["1.0"]))
    last = plan.take(100)
    at = site("customer", "c_custkey", "weighted")
    return drawn(spark, read(spark, sf_dir, "customer"), ["c_custkey"], at, plan, lambda d: {"chosen": w(d), "only": one(d), "only_drawn": tenth(d), "next_draw": last(d)[0]})


def draw_bernoulli_null(spark, sf_dir):
    plan = dr.Plan()
    null, fine = dr.bernoulli(plan, "0.35"), dr.bernoulli(plan, "0.350")
    never, always = dr.bernoulli(plan, "0"), dr.bernoulli(plan, "1")
    value = plan.take(1000)
    at = site("events", "event_id", "nullable")
    return drawn(spark, read(spark, sf_dir, "events"), ["event_id"], at, plan, lambda d: {"value": F.when(~null(d), value(d)[0]), "fine": fine(d), "never": never(d), "always": always(d)})


START, END = 1_767_225_600, 1_798_761_599  # 2026 in UTC


def draw_instant(spark, sf_dir):
    plan = dr.Plan()
    t = dr.instant_in(plan, START, END)
    at = site("orders", "o_orderkey", "instant")
    return drawn(spark, read(spark, sf_dir, "orders"), ["o_orderkey"], at, plan, lambda d: {"instant": dr.local_datetime(t(d)), "local_day": dr.local_date(t(d))})


def draw_age_window(spark, sf_dir):
    plan = dr.Plan()
    low, high = dr.age_window(START, 18, 65)
    t = dr.instant_in(plan, low, high)
    at = site("customer", "c_custkey", "birth")
    return drawn(spark, read(spark, sf_dir, "customer"), ["c_custkey"], at, plan, lambda d: {"birth_date": dr.local_date(t(d))})


def draw_lognormal(spark, sf_dir):
    plan = dr.Plan()
    v = dr.from_table(plan, amounts_table())
    at = F.concat(F.lit("lineitem/"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit("/amount"))
    return drawn(spark, read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], at, plan, lambda d: {"amount": v(d)})


def gen_seq_id(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.format_string("CUST-%08d", F.col("c_custkey")).alias("entity_id"))


def gen_lexicon(spark, sf_dir):
    plan = dr.Plan()
    first, last, place = dr.from_list(plan, GIVEN), dr.from_list(plan, SURNAMES), dr.from_list(plan, PLACES)
    at = site("supplier", "s_suppkey", "name")
    return drawn(spark, read(spark, sf_dir, "supplier"), ["s_suppkey"], at, plan, lambda d: {"first_name": first(d), "last_name": last(d), "place": place(d)})


CHANNELS, CHANNEL_WEIGHTS = ["mobile", "web", "pos", "atm", "branch"], ["0.52", "0.18", "0.15", "0.10", "0.05"]


def gen_enum(spark, sf_dir):
    plan = dr.Plan()
    k = dr.pick_weighted(plan, dr.scale_weights(CHANNEL_WEIGHTS))
    at = site("orders", "o_orderkey", "channel")
    return drawn(spark, read(spark, sf_dir, "orders"), ["o_orderkey"], at, plan, lambda d: {"channel": F.get(F.array(*map(F.lit, CHANNELS)), k(d))})


def gen_uniform(spark, sf_dir):
    plan = dr.Plan()
    k = dr.uniform(plan, 1, 600)
    at = site("supplier", "s_suppkey", "score")
    return drawn(spark, read(spark, sf_dir, "supplier"), ["s_suppkey"], at, plan, lambda d: {"score": k(d)})


def _family(name: str, policy: str) -> Query:
    def run(spark, sf_dir):
        plan = dr.Plan()
        value = ids.FAMILIES[name].make(plan, policy)
        at = site("customer", "c_custkey", name)
        shown = (lambda c: ids.mask_pan(c)) if name == "PAN" else (lambda c: c)
        df = read(spark, sf_dir, "customer").select("c_custkey")
        if name in ("PHONE",):
            return drawn(spark, df, ["c_custkey"], at, plan, lambda d: {"identifier": value(d)})
        made = drawn(spark, df, ["c_custkey"], at, plan, lambda d: {"identifier": F.explode(F.array(value(d)))})
        return made.select("c_custkey", shown(F.col("identifier")).alias("identifier"), ids.FAMILIES[name].valid(F.col("identifier")).alias("valid"))

    return run


def gen_email(spark, sf_dir):
    """Names from the place lists for most rows, none for every tenth: those draw a serial first."""
    at = site("supplier", "s_suppkey", "email")
    names = gen_lexicon(spark, sf_dir).withColumn("named", F.col("s_suppkey") % 10 != 0)
    with_names, without = dr.Plan(), dr.Plan()
    a = ids.make_email(with_names, F.col("first_name"), F.col("last_name"), nameless=False)
    b = ids.make_email(without, F.lit(""), F.lit(""), nameless=True)
    c_plan = dr.Plan()
    c = ids.make_email(c_plan, F.col("first_name"), F.col("last_name"), nameless=False, subdomain="Gölge İnşaat")
    with u64.wrapping(spark):
        seeded = u64.with_streams(names, {"__seed": (PREFIX, at)})
        ready = u64.with_draws(seeded, {"__a": ("__seed", with_names.bounds), "__b": ("__seed", without.bounds), "__c": ("__seed", c_plan.bounds)})
        return ready.select("s_suppkey", F.when(F.col("named"), a(F.col("__a"))).otherwise(b(F.col("__b"))).alias("email"), c(F.col("__c")).alias("work_email"))


def derive_ratio(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint") - 15_000_000
    df = read(spark, sf_dir, "orders").select("o_orderkey", cents.alias("cents"))
    return df.select("o_orderkey", "cents", derived("ratio_of", {"numerator": 82, "denominator": 100}, F.col("cents"), True).alias("net_cents"))


def derive_copy(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", derived("copy_of", {}, F.col("o_custkey"), True).alias("mirror"))


def derive_flag(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus"))
    return read(spark, sf_dir, "orders").select("o_orderkey", derived("flag_unless", {"value": "F"}, status, False).alias("flag"))


def derive_date_offset(spark, sf_dir):
    shown = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", derived("date_offset", {"days": 365}, shown, False).alias("plus_year"))


def _weighted_sql(draw: str, weights: list[int], values: list[str]) -> str:
    out, total = "CASE", 0
    for w, v in zip(weights, values, strict=True):
        total += w
        if w:
            out += f" WHEN {draw} < {total} THEN {v}"
    return out + " END"


def _local_time(epoch: str) -> str:
    return f"strftime(TIMESTAMP '1970-01-01' + to_seconds({epoch} + 10800), '%Y-%m-%dT%H:%M:%S+03:00')"


def _local_day(epoch: str) -> str:
    return f"strftime(TIMESTAMP '1970-01-01' + to_seconds({epoch} + 10800), '%Y-%m-%d')"


def _sql(table: str, key: str, field: str, k: int, columns: str, kind: str | None = None, prefix: bytes = PREFIX) -> str:
    s = site_sql(kind or table, key, field)
    return f"WITH {o.draws(source(table, key, s), prefix, k)} SELECT id AS {key}, {columns} FROM d"


def identifier_sql(safe: bool) -> dict[str, tuple[str, int, str]]:
    """For each family with a checksum: its name, the outputs it takes, and the identifier from the list d of outputs."""
    d = [f"({o.modulo(1, 9)} + 1)", *o.digits(2, 8)]
    tenth, eleventh = o.tckn_rules(d)
    if safe:
        eleventh = f"(({eleventh} + {o.modulo(10, 9)} + 1) % 10)"
    made = {"tckn": ("TCKN", 10, o.joined([*d, tenth, eleventh]))}
    d = o.digits(1, 9)
    check = o.vkn_rule(d)
    made["vkn"] = ("VKN", 10, o.joined([*d, f"(({check} + {o.modulo(10, 9)} + 1) % 10)" if safe else check]))
    body = o.joined(["'999990'", *o.digits(1, 16)])
    check = f"(98 - concat({body}, '292700')::HUGEINT % 97)"
    if safe:
        check = f"(({check} - 2 + {o.modulo(17, 96)} + 1) % 97 + 2)"
    made["iban"] = ("IBAN", 17, f"concat('TR', lpad({check}::VARCHAR, 2, '0'), {body})")
    d = ["9", *o.digits(1, 14)]
    check = o.luhn_rule(d)
    made["pan_masked"] = ("PAN", 15, o.joined([*d, f"(({check} + {o.modulo(15, 9)} + 1) % 10)" if safe else check]))
    return made


def masked_sql(c: str) -> str:
    return f"concat(substr({c}, 1, 6), '******', substr({c}, 13, 4))"


def phone_sql() -> str:
    d = o.digits(1, 9)
    return o.joined(["'+90 5'", *d[:2], "' '", *d[2:5], "' '", *d[5:7], "' '", *d[7:]])


def _family_sql() -> dict[str, str]:
    out = {}
    for policy, suffix in (("safe", ""), ("validator", "_validator")):
        for name, (kind, k, value) in identifier_sql(policy == "safe").items():
            inner = _sql("customer", "c_custkey", kind, k, f"{value} AS identifier")
            shown = masked_sql("identifier") if kind == "PAN" else "identifier"
            out[f"gen_{name}{suffix}"] = f"SELECT c_custkey, {shown} AS identifier, {o.valid(kind, 'identifier')} AS valid FROM ({inner})"
    out["gen_phone"] = _sql("customer", "c_custkey", "PHONE", 9, f"{phone_sql()} AS identifier")
    return out


def _email_sql() -> str:
    names = _sql("supplier", "s_suppkey", "name", 3, f"{o.texts(GIVEN)}[{o.modulo(1, len(GIVEN))} + 1] AS f, {o.texts(SURNAMES)}[{o.modulo(2, len(SURNAMES))} + 1] AS l")
    plain = lambda c: f"regexp_replace({o.fold(c)}, '[^0-9a-z]', '', 'g')"
    local = f"concat({plain('f')}, '.', {plain('l')})"
    hosts = "['example.com', 'example.net', 'example.org']"
    drawn_ = _sql("supplier", "s_suppkey", "email", 3, "d")
    with_names = f"concat({local}, '.', {o.modulo(2, 9999)} + 1, '@', {hosts}[{o.modulo(1, 3)} + 1])"
    without = f"concat('kullanici', lpad({o.modulo(1, 10000)}::VARCHAR, 4, '0'), '.', {o.modulo(3, 9999)} + 1, '@', {hosts}[{o.modulo(2, 3)} + 1])"
    work = f"concat({local}, '.', {o.modulo(1, 9999)} + 1, '@golgeinsaat.example')"
    return f"SELECT n.s_suppkey, CASE WHEN n.s_suppkey % 10 <> 0 THEN {with_names} ELSE {without} END AS email, {work} AS work_email FROM ({names}) n JOIN ({drawn_}) e USING (s_suppkey)"


def _wide_sql() -> str:
    """Accepted candidates of the bound 2^63 + 1, of which only those below it are."""
    n = (1 << 63) + 1
    s = site_sql("customer", "c_custkey", "wide")
    kept = f"list_filter(d, lambda z: z < {n}::UHUGEINT)"
    return f"WITH {o.draws(source('customer', 'c_custkey', s), PREFIX, 106)} SELECT id AS c_custkey, {kept}[1]::VARCHAR AS draw_0, {kept}[2]::VARCHAR AS draw_1 FROM d"


def _lognormal_sql() -> str:
    knots = "[" + ", ".join(map(str, amounts_table())) + "]::BIGINT[]"
    i, off = f"{o.modulo(1, len(amounts_table()) - 1)} + 1", o.modulo(2, dr.STEPS)
    src = "SELECT DISTINCT l_orderkey * 100 + l_linenumber AS id, concat('lineitem/', l_orderkey, '.', l_linenumber, '/amount') AS site FROM lineitem"
    return f"WITH {o.draws(src, PREFIX, 2)}, t AS (SELECT {knots} AS t) SELECT l_orderkey, l_linenumber, t[{i}] + ((t[{i} + 1] - t[{i}]) * {off}) // {dr.STEPS} AS amount FROM lineitem JOIN d ON id = l_orderkey * 100 + l_linenumber, t"


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (stream_seed, prng_u64, draw_bounded, draw_wide, draw_range, draw_weighted, draw_bernoulli_null, draw_instant, draw_age_window, draw_lognormal)
    + (gen_seq_id, gen_lexicon, gen_enum, gen_uniform, gen_email, derive_ratio, derive_copy, derive_flag, derive_date_offset)
} | {
    f"gen_{name}{suffix}": _family(kind, policy)
    for policy, suffix in (("safe", ""), ("validator", "_validator"))
    for name, kind in (("tckn", "TCKN"), ("vkn", "VKN"), ("iban", "IBAN"), ("pan_masked", "PAN"))
} | {"gen_phone": _family("PHONE", "safe")}

ORACLE: dict[str, str] = {
    "stream_seed": f"WITH {o.seeds(source('customer', 'c_custkey', site_sql('customer', 'c_custkey', 'seed')), PREFIX)} SELECT id AS c_custkey, lower(lpad(to_hex(seed::UBIGINT), 16, '0')) AS seed_hex FROM s",
    "prng_u64": f"WITH {o.draws(source('customer', 'c_custkey', site_sql('customer', 'c_custkey', 'raw')), PREFIX, 4)} SELECT id AS c_custkey, (k - 1)::BIGINT AS k, d[k]::VARCHAR AS output FROM (SELECT id, d, unnest(range(1, 5)) AS k FROM d)",
    "draw_bounded": _sql("orders", "o_orderkey", "bounded", 4, f"{o.modulo(1, 7)} AS below_7, 0::BIGINT AS below_1, {o.modulo(2, 1000)} AS below_1000, {o.modulo(3, 1 << 40)} AS below_{1 << 40}, {o.modulo(4, 10**9 + 7)} AS below_{10**9 + 7}"),
    "draw_wide": _wide_sql(),
    "draw_range": _sql("orders", "o_orderkey", "range", 2, f"{o.modulo(1, 101)} - 50 AS around_zero, {o.modulo(2, 22)} + 2005 AS model_year"),
    "draw_weighted": _sql("customer", "c_custkey", "weighted", 3, f"({_weighted_sql(o.modulo(1, 100), [55, 0, 30, 15], ['0', '1', '2', '3'])})::INT AS chosen, 0::INT AS only, 0::INT AS only_drawn, {o.modulo(3, 100)} AS next_draw"),
    "draw_bernoulli_null": _sql("events", "event_id", "nullable", 3, f"CASE WHEN NOT ({o.modulo(1, 100)} < 35) THEN {o.modulo(3, 1000)} END AS value, {o.modulo(2, 1000)} < 350 AS fine, false AS never, true AS always"),
    "draw_instant": _sql("orders", "o_orderkey", "instant", 1, f"{_local_time(f'({o.modulo(1, END - START)} + {START})')} AS instant, {_local_day(f'({o.modulo(1, END - START)} + {START})')} AS local_day"),
    "draw_age_window": _sql("customer", "c_custkey", "birth", 1, f"{_local_day(f'({o.modulo(1, (65 * 365 + 16 - 18 * 365 - 4) * 86400)} + {START - (65 * 365 + 16) * 86400})')} AS birth_date"),
    "draw_lognormal": _lognormal_sql(),
    "gen_seq_id": "SELECT c_custkey, concat('CUST-', lpad(c_custkey::VARCHAR, 8, '0')) AS entity_id FROM customer",
    "gen_lexicon": _sql("supplier", "s_suppkey", "name", 3, ", ".join(f"{o.texts(v)}[{o.modulo(i, len(v))} + 1] AS {n}" for i, (n, v) in enumerate((("first_name", GIVEN), ("last_name", SURNAMES), ("place", PLACES)), 1))),
    "gen_enum": _sql("orders", "o_orderkey", "channel", 1, f"{_weighted_sql(o.modulo(1, 100), [52, 18, 15, 10, 5], [o.text(c) for c in CHANNELS])} AS channel"),
    "gen_uniform": _sql("supplier", "s_suppkey", "score", 1, f"{o.modulo(1, 600)} + 1 AS score"),
    "gen_email": _email_sql(),
    "derive_ratio": "SELECT o_orderkey, c AS cents, CAST(floor(c * 82 / 100.0::DECIMAL(10, 1)) AS BIGINT) AS net_cents FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) - 15000000 AS c FROM orders)",
    "derive_copy": "SELECT o_orderkey, o_custkey AS mirror FROM orders",
    "derive_flag": "SELECT o_orderkey, (CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END) IS DISTINCT FROM 'F' AS flag FROM orders",
    "derive_date_offset": "SELECT l_orderkey, l_linenumber, strftime(l_shipdate::DATE + 365, '%Y-%m-%d') AS plus_year FROM lineitem",
    **_family_sql(),
}
