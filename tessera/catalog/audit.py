"""Queries that audit: checks, sweeps, text forms, tallies, coverage, reconciliation, spans, allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions import text as tx
from ..operators import alloc, reconcile, spans, sweep, tally
from ..plans import verify
from ..plans.grammar import Parser, Slot, walk
from ..plans.mint import unresolved
from . import generate as g
from . import oracle as o
from .data import GIVEN, PLACES, SURNAMES

read = g.read


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier candidates of the documents, with generated ones of both policies: without these no TCKN, VKN or IBAN would be among them."""
    found = sweep.swept(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).select(F.concat(F.lit("doc "), F.col("doc_id")).alias("origin"), "candidate")
    q = g.QUERIES
    for name in ("tckn", "vkn", "iban"):
        for policy in ("", "_validator"):
            made = q[f"gen_{name}{policy}"](spark, sf_dir)
            found = found.unionByName(made.select(F.concat(F.lit(f"{name}{policy} "), F.col("c_custkey")).alias("origin"), F.col("identifier").alias("candidate")))
    return found


def _candidates_sql() -> str:
    parts = [f"SELECT concat('doc ', doc_id) AS origin, unnest({o.candidates('text')}) AS candidate FROM documents"]
    for name in ("tckn", "vkn", "iban"):
        for policy in ("", "_validator"):
            parts.append(f"SELECT concat('{name}{policy} ', c_custkey) AS origin, identifier AS candidate FROM ({g.ORACLE[f'gen_{name}{policy}']})")
    return " UNION ALL ".join(parts)


def _check(kind: str):
    def run(spark, sf_dir):
        f = ids.FAMILIES[kind]
        return _candidates(spark, sf_dir).select("origin", "candidate", f.shape(F.col("candidate")).alias("well_formed"), f.valid(F.col("candidate")).alias("valid"))

    return run


def _check_sql(kind: str) -> str:
    return f"SELECT origin, candidate, {o.shape(kind, 'candidate')} AS well_formed, {o.valid(kind, 'candidate')} AS valid FROM ({_candidates_sql()})"


def _surfaces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(SURFACES)], "n int, surface string")


#: Surfaces at the edges of the shapes.
SURFACES = [
    "12345678901", "02345678901", "1234567890", "123456789", "TR330006100519786457841326", "TR33 0006 1005 1978 6457 8413 26", "TR33 00061005 1978 6457 8413 26",
    "4111111111111111", "411111******1111", "411111*****11111", "+90 532 123 45 67", "+90 432 123 45 67", "+905321234567", "a@example.com", "a b@example.com", "a@mail.example.com",
    "a@shop.example", "@example.org", "a@EXAMPLE.NET", "a@b@example.org", "", "plain",
]


def shapes(spark, sf_dir):
    return _surfaces(spark).select("n", *[f.shape(F.col("surface")).alias(name.lower()) for name, f in ids.FAMILIES.items()])


def impostor(spark, sf_dir):
    labels = spark.createDataFrame([(x,) for x in ("TCKN", "EMAIL", "PERSON")], "label string")
    pairs = _surfaces(spark).crossJoin(F.broadcast(labels))
    return pairs.select("n", "label", F.coalesce(ids.impostor(F.col("surface"), F.col("label")), F.lit("-")).alias("impostor"))


def _values(columns: str, rows) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(o.text(x) if isinstance(x, str) else str(x) for x in r) + ')' for r in rows)}) t({columns})"


def reserved_email(spark, sf_dir):
    found = F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._-]+@[A-Za-z0-9.-]*[A-Za-z0-9])"), 1))
    mails = read(spark, sf_dir, "documents").select("doc_id", found.alias("address"))
    return mails.select("doc_id", "address", ids.reserved_email(F.col("address")).alias("reserved"))


def identifier_sweep(spark, sf_dir):
    """Documents, conversations and pages: each row's distinct candidates with the checksums that hold."""
    parts = [
        ("documents", F.col("doc_id").cast("string"), [F.col("text")]),
        ("conversations", F.concat_ws("/", "conv_id", "turn"), [F.col("text")]),
        ("pages", F.col("page_id").cast("string"), [F.col("html")]),
    ]
    out = None
    for name, key, texts in parts:
        part = sweep.swept(read(spark, sf_dir, name).withColumn("row_id", key), ["row_id"], texts).select(F.lit(name).alias("origin"), "row_id", "candidate", F.array_join("valid_under", ",").alias("valid_under"))
        out = part if out is None else out.unionByName(part)
    return out


def _valid_list(c: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {o.valid(k, c)} THEN '{k}' END" for k in ids.CHECKSUMMED) + ")"


def _sweep_sql() -> str:
    parts = [
        f"SELECT 'documents' AS origin, doc_id::VARCHAR AS row_id, unnest({o.candidates('text')}) AS candidate FROM documents",
        f"SELECT 'conversations', concat(conv_id, '/', turn), unnest({o.candidates('text')}) FROM conversations",
        f"SELECT 'pages', page_id::VARCHAR, unnest({o.candidates('html')}) FROM pages",
    ]
    return f"SELECT origin, row_id, candidate, {_valid_list('candidate')} AS valid_under FROM ({' UNION ALL '.join(parts)})"


def sweep_counts(spark, sf_dir):
    found = identifier_sweep(spark, sf_dir)
    return found.groupBy("origin").agg(F.count(F.lit(1)).alias("candidates"), F.sum((F.col("valid_under") != "").cast("bigint")).alias("valid"))


def safe_assertion(spark, sf_dir):
    """Generated rows of both policies: how many candidates each policy leaves valid. Safe leaves none."""
    q, out = g.QUERIES, None
    for name in ("tckn", "vkn", "iban"):
        for policy, suffix in (("safe", ""), ("validator", "_validator")):
            df = q[f"gen_{name}{suffix}"](spark, sf_dir).select(F.lit(policy).alias("policy"), F.lit(name).alias("family"), "identifier")
            out = df if out is None else out.unionByName(df)
    hit = F.size(ids.valid_under(F.col("identifier"))) > 0
    return out.groupBy("policy", "family").agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("bigint")).alias("valid"))


def _safe_sql() -> str:
    parts = [f"SELECT '{policy}' AS policy, '{name}' AS family, identifier FROM ({g.ORACLE[f'gen_{name}{suffix}']})" for name in ("tckn", "vkn", "iban") for policy, suffix in (("safe", ""), ("validator", "_validator"))]
    any_of = " OR ".join(o.valid(k, "identifier") for k in ids.CHECKSUMMED)
    return f"SELECT policy, family, count(*) AS n, sum(CASE WHEN {any_of} THEN 1 ELSE 0 END)::BIGINT AS valid FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


PHRASES = {"apache license": "licence lines", "general public license": "licence lines", "the mit": "licence lines", "the and": "common words", "der die": "common words"}


def denylist_scan(spark, sf_dir):
    return sweep.phrase_hits(read(spark, sf_dir, "documents"), ["doc_id"], F.col("text"), PHRASES)


def _denylist_sql() -> str:
    folded = o.fold("text")
    edge = r"(^|[^\pL\pN_])%s([^\pL\pN_]|$)"
    parts = [f"SELECT doc_id, {o.text(p)} AS phrase, {o.text(s)} AS source FROM documents WHERE regexp_matches({folded}, '{edge % p}')" for p, s in PHRASES.items()]
    return " UNION ALL ".join(parts)


def superset(spark, sf_dir):
    """Phrases that an extension of a denylist leaves out: nations as the core, three in four of them as the extension."""
    nations = [(r.n_nationkey, r.n_name) for r in read(spark, sf_dir, "nation").collect()]
    core, extension = (sweep.load_phrases("\n".join(f"{n}  # nation {k}" for k, n in some)) for some in (nations, [x for x in nations if x[0] % 4]))
    return spark.createDataFrame([(p,) for p in sorted(sweep.missing_phrases(extension, core))], "phrase string")


def fold_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.text_digest(tx.fold(F.col("text"))).alias("folded_sha256"), F.length(tx.fold(F.col("text"))).alias("n_chars"))


def names_frame(spark: SparkSession) -> DataFrame:
    names = [*GIVEN, *SURNAMES, *PLACES, "", "--", "IĞDIR İli"]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(names, reversed(names), strict=True))], "n int, first string, last string")


def fold_local_part(spark, sf_dir):
    df = names_frame(spark)
    return df.select("n", tx.fold(F.col("first")).alias("folded"), tx.local_part(F.col("first"), F.col("last")).alias("local"))


def _local_part_sql() -> str:
    names = [*GIVEN, *SURNAMES, *PLACES, "", "--", "IĞDIR İli"]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(names, reversed(names), strict=True))]
    plain = lambda c: f"nullif(regexp_replace({o.fold(c)}, '[^0-9a-z]', '', 'g'), '')"
    return f"SELECT n, {o.fold('first')} AS folded, coalesce(nullif(concat_ws('.', {plain('first')}, {plain('last')}), ''), 'kullanici') AS local FROM {_values('n, first, last', rows)}"


def ws_normalize(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("row_id"), "text")
    c = read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.concat_ws("/", "conv_id", "turn")).alias("row_id"), F.concat(F.lit(" \t"), F.col("text"), F.lit(" , end")).alias("text"))
    both = d.unionByName(c)
    clean = tx.normalize_whitespace(F.col("text"))
    return both.select("row_id", F.length(clean).alias("n_chars"), tx.text_digest(clean).alias("sha256"))


def _ws_sql() -> str:
    one = f"trim(regexp_replace(text, '[{o.SPACES}]+', ' ', 'g'), ' ')"
    clean = f"regexp_replace({one}, ' ([,.;:!?)\\]}}%])', '\\1', 'g')"
    both = "SELECT concat('d', doc_id) AS row_id, text FROM documents UNION ALL SELECT concat('c', conv_id, '/', turn), concat(' ', chr(9), text, ' , end') FROM conversations"
    return f"SELECT row_id, length(c)::INT AS n_chars, sha256(c) AS sha256 FROM (SELECT row_id, {clean} AS c FROM ({both}))"


CELLS = ["=1+1", "+SUM(A1:A2)", "-2+3", "@cmd", "\t=x", "+90 532 123 45 67", "-12.5", "+7", "-", "plain", "", " -1", " - 1", "a=b", 'quote " here', "comma, here", "line\nbreak", "x\ry"]


def formula_guard(spark, sf_dir):
    df = spark.createDataFrame(list(enumerate(CELLS)), "n int, cell string")
    return df.select("n", F.coalesce(tx.formula_trigger(F.col("cell")), F.lit("none")).alias("trigger"))


def _formula_sql() -> str:
    rest = f"regexp_replace(cell, '^[{o.SPACES}\\x{{0001}}-\\x{{001f}}]+', '')"
    harmless = f"(regexp_full_match({rest}, '[+-][0-9]+([.][0-9]+)?') OR regexp_full_match({rest}, '[+]90 5[0-9]{{2}} [0-9]{{3}} [0-9]{{2}} [0-9]{{2}}'))"
    return f"SELECT n, CASE WHEN NOT {harmless} AND substr({rest}, 1, 1) IN ('=', '+', '-', '@') THEN substr({rest}, 1, 1) ELSE 'none' END AS trigger FROM {_cells_sql()}"


def _cells_sql() -> str:
    quoted = [", ".join([str(i), "concat(" + ", ".join(f"chr({ord(ch)})" for ch in c) + ")" if c else "''"]) for i, c in enumerate(CELLS)]
    return f"(VALUES {', '.join(f'({q})' for q in quoted)}) t(n, cell)"


def csv_line(spark, sf_dir):
    cells = spark.createDataFrame(list(enumerate(CELLS)), "n int, cell string")
    small = cells.select(F.concat(F.lit("cell "), F.col("n")).alias("row_id"), tx.csv_line([F.col("n").cast("string"), F.col("cell")]).alias("line"))
    nations = read(spark, sf_dir, "nation").select(F.concat(F.lit("nation "), F.col("n_nationkey")).alias("row_id"), tx.csv_line([F.col("n_nationkey").cast("string"), F.col("n_name"), F.lit(None).cast("string")]).alias("line"))
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), F.col("doc_id")).alias("row_id"), tx.text_digest(tx.csv_line([F.col("doc_id").cast("string"), F.col("text")])).alias("line"))
    return small.unionByName(nations).unionByName(docs)


def _csv_sql() -> str:
    cell = lambda c: f"CASE WHEN regexp_matches({c}, '[,\"\\n\\r]') THEN concat('\"', replace({c}, '\"', '\"\"'), '\"') ELSE {c} END"
    return (
        f"SELECT concat('cell ', n) AS row_id, concat(n, ',', {cell('cell')}) AS line FROM {_cells_sql()} "
        f"UNION ALL SELECT concat('nation ', n_nationkey), concat(n_nationkey, ',', {cell('n_name')}, ',') FROM nation "
        f"UNION ALL SELECT concat('doc ', doc_id), sha256(concat(doc_id, ',', {cell('text')})) FROM documents"
    )


def json_line(spark, sf_dir):
    row = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("note"), (F.col("n_regionkey") > 1).alias("far"))
    return read(spark, sf_dir, "nation").select("n_nationkey", tx.json_line(row).alias("line"))


def text_digest(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.text_digest(F.col("text")).alias("text_sha256"))


FIFTHS = {k: "0.2" for k in ("click", "error", "purchase", "signup", "view")}
SEGMENTS = {"AUTOMOBILE": "0.30", "BUILDING": "0.2", "FURNITURE": "0.2", "HOUSEHOLD": "0.1", "MACHINERY": "0.2"}


def tally_distribution(spark, sf_dir):
    e = tally.tally(read(spark, sf_dir, "events"), F.col("event_type"), FIFTHS).withColumn("site", F.lit("events/event_type"))
    c = tally.tally(read(spark, sf_dir, "customer"), F.col("c_mktsegment"), SEGMENTS).withColumn("site", F.lit("customer/c_mktsegment"))
    return e.unionByName(c).select("site", "value", "target", "n", "total", "achieved", "near")


def tally_tolerance(spark, sf_dir):
    e = tally.within_tolerance(tally.tally(read(spark, sf_dir, "events"), F.col("event_type"), FIFTHS)).withColumn("site", F.lit("events/event_type"))
    c = tally.within_tolerance(tally.tally(read(spark, sf_dir, "customer"), F.col("c_mktsegment"), SEGMENTS)).withColumn("site", F.lit("customer/c_mktsegment"))
    return e.unionByName(c)


def _tally_sql() -> str:
    out = []
    for site, tbl, column, targets in (("events/event_type", "events", "event_type", FIFTHS), ("customer/c_mktsegment", "customer", "c_mktsegment", SEGMENTS)):
        t = _values("value, target", targets.items())
        counted = f"SELECT t.value, t.target, count(x.{column}) AS n FROM {t} LEFT JOIN {tbl} x ON x.{column} = t.value GROUP BY ALL"
        total = "(sum(n) OVER ())::BIGINT"
        s = f"((n * 10000 + {total} // 2) // {total})"
        goal = "(CAST(CAST(target AS DECIMAL(10, 4)) * 10000 AS BIGINT))"
        out.append(f"SELECT '{site}' AS site, value, target, n, {total} AS total, concat({s} // 10000, '.', lpad(({s} % 10000)::VARCHAR, 4, '0')) AS achieved, abs({s} - {goal}) <= 200 AS near FROM ({counted})")
    return " UNION ALL ".join(out)


def unexpected_values(spark, sf_dir):
    few = {k: v for k, v in FIFTHS.items() if k != "view"}
    return tally.unexpected(read(spark, sf_dir, "events"), F.col("event_type"), few)


def label_coverage(spark, sf_dir):
    marks = read(spark, sf_dir, "labels").select(F.explode(F.array(F.concat(F.lit("quality"), F.col("quality")), F.concat(F.lit("toxic"), F.col("toxic")))).alias("label"))
    return marks.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def coverage_targets(spark, sf_dir):
    marks = read(spark, sf_dir, "labels").select(F.explode(F.array(F.concat(F.lit("quality"), F.col("quality")), F.concat(F.lit("toxic"), F.col("toxic")))).alias("label"))
    return tally.coverage(marks, "label", {"quality1": 20, "toxic1": 1_000_000, "absent": 1, "none": 0})


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def record_counts(spark, sf_dir):
    out = None
    for t in TABLES:
        one = read(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def byte_totals(spark, sf_dir):
    d = read(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text") + 1).alias("bytes"), F.max(F.octet_length("text")).cast("bigint").alias("longest"))
    p = read(spark, sf_dir, "pages").agg(F.sum(F.octet_length("html") + 1).alias("bytes"), F.max(F.octet_length("html")).cast("bigint").alias("longest"))
    return d.withColumn("name", F.lit("documents")).unionByName(p.withColumn("name", F.lit("pages")))


def duplicates(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_sha256"))
    return tally.duplicates(d, "text_sha256")


def _parents(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("p"))


COUNTS, WEIGHTS = (1, 2, 3), ("0.55", "0.30", "0.15")


def _assign(children_per_ten: int):
    def run(spark, sf_dir):
        parents = _parents(spark, sf_dir)
        n = parents.count() * children_per_ten // 10
        return alloc.assign_children(parents, "p", g.PREFIX, "orders/o_custkey", n, COUNTS, WEIGHTS)

    return run


def _assign_sql(children_per_ten: int) -> str:
    """By another way than ours: all slots that a parent may take or give up are listed in order, and the first ones used."""
    src = "SELECT c_custkey AS id, concat('orders/o_custkey/', c_custkey, '/count') AS site FROM customer"
    case = g._weighted_sql(o.modulo(1, 100), [55, 30, 15], ["1", "2", "3"])
    return f"""WITH {o.draws(src, g.PREFIX, 1)},
drawn AS (SELECT id AS p, ({case})::BIGINT AS c FROM d),
goal AS (SELECT (SELECT count(*) FROM customer) * {children_per_ten} // 10 AS n, (SELECT sum(c)::BIGINT FROM drawn) AS t),
give AS (SELECT p, row_number() OVER (ORDER BY p DESC, k) AS r FROM (SELECT p, unnest(range(1, c)) AS k FROM drawn)),
gave AS (SELECT p, count(*) AS x FROM give, goal WHERE r <= t - n GROUP BY p),
room AS (SELECT p, row_number() OVER (ORDER BY k, p) AS r FROM (SELECT p, unnest(range(c, 3)) - c AS k FROM drawn)),
took AS (SELECT p, count(*) AS x FROM room, goal WHERE r <= n - t GROUP BY p),
final AS (SELECT p, c - coalesce(gave.x, 0) + coalesce(took.x, 0) AS c FROM drawn LEFT JOIN gave USING (p) LEFT JOIN took USING (p))
SELECT (row_number() OVER (ORDER BY p, k) - 1)::BIGINT AS child, p AS parent FROM (SELECT p, unnest(range(c)) AS k FROM final)"""


def ref_integrity(spark, sf_dir):
    orders, customer, lineitem = (read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    a = reconcile.dangling(orders, "o_custkey", customer, "c_custkey").agg(F.count(F.lit(1)).alias("dangling")).withColumn("ref", F.lit("orders to customer"))
    b = reconcile.dangling(lineitem, "l_orderkey", orders, "o_orderkey").agg(F.count(F.lit(1)).alias("dangling")).withColumn("ref", F.lit("lineitem to orders"))
    shifted = customer.select((F.col("c_custkey") * 2).alias("c_custkey"))
    c = reconcile.dangling(orders, "o_custkey", shifted, "c_custkey").agg(F.count(F.lit(1)).alias("dangling")).withColumn("ref", F.lit("orders to even customers"))
    return a.unionByName(b).unionByName(c)


def sidecar_reconcile(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id")
    repeated = labels.unionByName(labels.filter("doc_id % 50 = 0")).unionByName(labels.select((F.col("doc_id") + 1_000_000_000).alias("doc_id")).filter("doc_id % 97 = 0"))
    return reconcile.sidecar_findings(read(spark, sf_dir, "documents").select("doc_id"), repeated, "doc_id")


def _texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("path"), F.sha2("text", 256).alias("sha"), "doc_id")


def sums_reconcile(spark, sf_dir):
    listed = _texts(spark, sf_dir).filter("doc_id % 11 <> 0").select("path", "sha")
    recorded = _texts(spark, sf_dir).filter("doc_id % 13 <> 0").select("path", F.when(F.col("doc_id") % 17 == 0, F.lit("0" * 64)).otherwise(F.col("sha")).alias("sha"))
    return reconcile.compare(listed, recorded, "path", "sha").select(F.col("key").alias("path"), "finding")


def entry_reconcile(spark, sf_dir):
    listed = _texts(spark, sf_dir).filter("doc_id % 11 <> 0").select("path")
    present = _texts(spark, sf_dir).filter("doc_id % 13 <> 0").select("path")
    return reconcile.one_sided(listed, present, "path").select(F.col("key").alias("path"), "side")


def site_resolve(spark, sf_dir):
    sites = spark.createDataFrame([(s,) for s in ("events/event_type", "nothing/x", "customer/c_mktsegment", "orders")], "site string")
    types = spark.createDataFrame([(t,) for t in TABLES], "type_name string")
    parts = sites.withColumn("type_name", F.when(F.col("site").contains("/"), F.substring_index("site", "/", 1)))
    return parts.join(types, "type_name", "left_anti").select("site")


def replica_diff(spark, sf_dir):
    original = _texts(spark, sf_dir).select("path", "sha")
    replica = _texts(spark, sf_dir).select("path", F.when(F.col("doc_id") % 101 == 0, F.lit("changed")).otherwise(F.col("sha")).alias("sha"))
    return reconcile.compare(original, replica, "path", "sha").select(F.col("key").alias("path"), "finding")


def manifest_drift(spark, sf_dir):
    """Paths at which two nested documents differ: nations by region, some with another key and some left out."""
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).collect()
    a, b = {"provenance": 1}, {"provenance": 2}
    for r in rows:
        a.setdefault(r.r_name, {})[r.n_name] = r.n_nationkey
        if r.n_nationkey % 5:
            b.setdefault(r.r_name, {})[r.n_name] = r.n_nationkey + (r.n_nationkey % 7 == 0)
    return spark.createDataFrame([(p,) for p in verify.drift(a, b)], "path string")


def reachability(spark, sf_dir):
    declared = spark.createDataFrame([("template", "a"), ("template", "b"), ("lexicon", "names"), ("lexicon", "unused")], "kind string, name string")
    used = spark.createDataFrame([("template", "a"), ("lexicon", "names"), ("lexicon", "missing")], "kind string, name string")
    return declared.join(used, ["kind", "name"], "left_anti").withColumn("finding", F.lit("unreachable")).unionByName(used.join(declared, ["kind", "name"], "left_anti").withColumn("finding", F.lit("unknown")))


def slot_resolve(spark, sf_dir):
    """Slots of a template that names every column of two tables as a field of the first: those that it does not have."""
    columns = {t: read(spark, sf_dir, t).columns for t in ("customer", "orders")}
    text = " ".join(f"{{field:customer.{c}}}" for t in columns for c in columns[t])
    nodes = Parser("every", text, frozenset(spans.LABELS), frozenset(ids.ALL), frozenset()).parse()
    missing = unresolved([n for n in walk(nodes) if isinstance(n, Slot)], "customer", columns["customer"])
    return spark.createDataFrame([(x,) for x in missing], "slot string")


def compose_cross(spark, sf_dir):
    """Ordered cross product of two small lexicons, numbered as it is composed."""
    n, r = read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    size = r.count()
    pairs = n.crossJoin(F.broadcast(r))
    return pairs.select((F.col("n_nationkey") * size + F.col("r_regionkey")).cast("bigint").alias("position"), F.concat_ws(" ", "n_name", "r_name").alias("surface"))


def union_surfaces(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    both = n.select(F.col("n_name").alias("surface")).unionByName(r.select(F.col("r_name").alias("surface"))).unionByName(r.select(F.col("r_name").alias("surface")))
    return both.distinct()


def _spans(spark, sf_dir):
    return spans.candidate_spans(read(spark, sf_dir, "documents"), ["doc_id"], "text")


def span_extract(spark, sf_dir):
    found = spans.candidate_spans(read(spark, sf_dir, "documents"), ["doc_id", "text"], "text")
    return found.select("doc_id", "start", "end", "surface", (spans.extract(F.col("text"), F.col("start"), F.col("end")) == F.col("surface")).alias("aligned"))


def _span_sql() -> str:
    pieces = "SELECT doc_id, text, unnest(regexp_extract_all(text, '[0-9A-Za-z]+|[^0-9A-Za-z]+')) AS piece, generate_subscripts(regexp_extract_all(text, '[0-9A-Za-z]+|[^0-9A-Za-z]+'), 1) AS k FROM documents WHERE regexp_matches(text, '[0-9]{10}')"
    at = f"SELECT doc_id, text, piece, (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece))::INT AS start FROM ({pieces})"
    return f"SELECT doc_id, start, (start + length(piece))::INT AS \"end\", piece AS surface, substr(text, start + 1, length(piece)) = piece AS aligned FROM ({at}) WHERE regexp_full_match(piece, '[0-9]{{10,19}}')"


def span_shape(spark, sf_dir):
    """Candidate spans with labels dealt to them, right and wrong ones, and the rule that each breaks."""
    label = F.get(F.array(*[F.lit(x) for x in ("PAN", "TCKN", "PERSON", "NOPE")]), (F.col("doc_id") % 4).cast("int"))
    found = spans.candidate_spans(read(spark, sf_dir, "documents"), ["doc_id", "text"], "text").withColumn("label", label)
    return spans.findings(found, list(spans.LABELS)).select("doc_id", "start", "end", "label", F.coalesce("finding", F.lit("-")).alias("finding"))


def _span_shape_sql() -> str:
    return f"""SELECT doc_id, start, "end", label, CASE WHEN label = 'NOPE' THEN 'unknown label' WHEN label = 'PAN' AND NOT {o.shape('PAN', 'surface')} THEN 'shape' WHEN label = 'TCKN' AND NOT {o.shape('TCKN', 'surface')} THEN 'shape'
WHEN label <> 'TCKN' AND {o.shape('TCKN', 'surface')} THEN 'impostor TCKN' WHEN {o.shape('VKN', 'surface')} THEN 'impostor VKN' WHEN label <> 'PAN' AND {o.shape('PAN', 'surface')} THEN 'impostor PAN' ELSE '-' END AS finding
FROM (SELECT *, ['PAN', 'TCKN', 'PERSON', 'NOPE'][doc_id % 4 + 1] AS label FROM ({_span_sql()}))"""


def span_overlap(spark, sf_dir):
    found = _spans(spark, sf_dir).select("doc_id", "start", "end")
    wider = found.filter("doc_id % 2 = 0").select("doc_id", (F.col("start") + 3).alias("start"), (F.col("end") + 2).alias("end"))
    again = found.filter("doc_id % 3 = 0")
    return spans.overlaps(found.unionByName(wider).unionByName(again), "doc_id")


def _overlap_sql() -> str:
    found = f'SELECT doc_id, start, "end" FROM ({_span_sql()})'
    every = f'WITH f AS ({found}), a AS (SELECT * FROM f UNION ALL SELECT doc_id, start + 3, "end" + 2 FROM f WHERE doc_id % 2 = 0 UNION ALL SELECT * FROM f WHERE doc_id % 3 = 0)'
    w = 'OVER (PARTITION BY doc_id ORDER BY start, "end")'
    return f"""{every} SELECT doc_id, start, "end", finding FROM (SELECT *, CASE WHEN ps = start AND pe = "end" THEN 'duplicate' WHEN start < pe THEN 'overlap' END AS finding FROM (SELECT *, lag(start) {w} AS ps, lag("end") {w} AS pe FROM a)) WHERE finding IS NOT NULL"""


def pin_digest(spark, sf_dir):
    df = spark.createDataFrame(list(enumerate(spans.ENTITY_LABELS)), "k int, label string")
    return reconcile.ordered_digest(df, F.col("k"), F.concat("label", F.lit("\n")))


def pack_digest(spark, sf_dir):
    """As a pack's digest: path, zero byte, digest of the content, newline, in the order of the paths' bytes."""
    n = read(spark, sf_dir, "nation")
    return reconcile.ordered_digest(n, F.col("n_name"), F.concat("n_name", F.lit("\0"), F.sha2("n_name", 256), F.lit("\n")))


def top_problems(spark, sf_dir):
    """Problems in a fixed order, cut at a bound, with a marker behind: how a report stays finite."""
    found = identifier_sweep(spark, sf_dir).filter("valid_under <> ''").select(F.concat_ws(" ", "origin", "row_id", "candidate").alias("problem"))
    first = found.orderBy("problem").limit(11)
    n = F.row_number().over(Window.orderBy("problem"))
    return first.select(n.alias("n"), "problem").select("n", F.when(F.col("n") <= 10, F.col("problem")).otherwise(F.lit("more problems were left out")).alias("problem"))


_LABEL_SQL = "SELECT label, count(*) AS n FROM (SELECT unnest([concat('quality', quality), concat('toxic', toxic)]) AS label FROM labels) GROUP BY 1"
_TEXTS_SQL = "SELECT concat('doc-', doc_id) AS path, sha256(text) AS sha, doc_id FROM documents"

QUERIES = {
    f.__name__: f
    for f in (shapes, impostor, reserved_email, identifier_sweep, sweep_counts, safe_assertion, denylist_scan, superset, fold_text, fold_local_part, ws_normalize)
    + (formula_guard, csv_line, json_line, text_digest, tally_distribution, tally_tolerance, unexpected_values, label_coverage, coverage_targets, record_counts)
    + (byte_totals, duplicates, ref_integrity, sidecar_reconcile, sums_reconcile, entry_reconcile, site_resolve, replica_diff, manifest_drift, reachability)
    + (slot_resolve, compose_cross, union_surfaces, span_extract, span_shape, span_overlap, pin_digest, pack_digest, top_problems)
} | {
    **{f"check_{k.lower()}": _check(k) for k in ids.CHECKSUMMED},
    "assign_children": _assign(16),
    "assign_trim": _assign(12),
    "assign_fill": _assign(25),
}

_SURFACE = "surface"

ORACLE = {
    "shapes": f"SELECT n, {', '.join(f'{o.shape(k, _SURFACE)} AS {k.lower()}' for k in ids.ALL)} FROM {_values('n, surface', enumerate(SURFACES))}",
    "impostor": f"SELECT n, label, CASE {' '.join(f'WHEN {o.shape(k, "s.s")} AND label <> {o.text(k)} THEN {o.text(k)}' for k in ids.ALL)} ELSE '-' END AS impostor FROM {_values('n, s', enumerate(SURFACES)).replace(') t(', ') s(')}, (SELECT unnest(['TCKN', 'EMAIL', 'PERSON']) AS label)",
    "reserved_email": f"SELECT doc_id, address, {o.reserved('address')} AS reserved FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]*[A-Za-z0-9]')) AS address FROM documents)",
    "identifier_sweep": _sweep_sql(),
    "sweep_counts": f"SELECT origin, count(*) AS candidates, sum(CASE WHEN valid_under <> '' THEN 1 ELSE 0 END)::BIGINT AS valid FROM ({_sweep_sql()}) GROUP BY 1",
    "safe_assertion": _safe_sql(),
    "denylist_scan": _denylist_sql(),
    "superset": f"SELECT {o.fold('n_name')} AS phrase FROM nation WHERE n_nationkey % 4 = 0",
    "fold_text": f"SELECT doc_id, sha256({o.fold('text')}) AS folded_sha256, length({o.fold('text')})::INT AS n_chars FROM documents",
    "fold_local_part": _local_part_sql(),
    "ws_normalize": _ws_sql(),
    "formula_guard": _formula_sql(),
    "csv_line": _csv_sql(),
    "json_line": """SELECT n_nationkey, concat('{"id":', n_nationkey, ',"name":"', n_name, '","note":null,"far":', CASE WHEN n_regionkey > 1 THEN 'true' ELSE 'false' END, '}') AS line FROM nation""",
    "text_digest": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
    "tally_distribution": _tally_sql(),
    "tally_tolerance": f"SELECT site, bool_and(near) AS within_tolerance, sum(n)::BIGINT AS total FROM ({_tally_sql()}) GROUP BY site",
    "unexpected_values": "SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'error', 'purchase', 'signup') GROUP BY 1",
    "label_coverage": _LABEL_SQL,
    "coverage_targets": f"SELECT t.label, t.target::BIGINT AS target, coalesce(n, 0) AS achieved, coalesce(n, 0) >= t.target AS met FROM {_values('label, target', [('quality1', 20), ('toxic1', 1000000), ('absent', 1), ('none', 0)])} LEFT JOIN ({_LABEL_SQL}) USING (label)",
    "record_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES),
    "byte_totals": "SELECT 'documents' AS name, sum(strlen(text) + 1)::BIGINT AS bytes, max(strlen(text))::BIGINT AS longest FROM documents UNION ALL SELECT 'pages', sum(strlen(html) + 1)::BIGINT, max(strlen(html))::BIGINT FROM pages",
    "duplicates": "SELECT sha256(text) AS text_sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "ref_integrity": "SELECT 'orders to customer' AS ref, count(*) AS dangling FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem to orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders to even customers', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey * 2 FROM customer)",
    "sidecar_reconcile": """WITH s AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 50 = 0 UNION ALL SELECT doc_id + 1000000000 FROM labels WHERE (doc_id + 1000000000) % 97 = 0),
a AS (SELECT doc_id AS key, count(*) AS nd FROM documents GROUP BY 1), b AS (SELECT doc_id AS key, count(*) AS ns FROM s GROUP BY 1), j AS (SELECT * FROM a FULL JOIN b USING (key))
SELECT key, 'no document' AS finding, ns AS n FROM j WHERE nd IS NULL UNION ALL SELECT key, 'no sidecar', nd FROM j WHERE ns IS NULL UNION ALL SELECT key, 'duplicate document', nd FROM j WHERE nd > 1 UNION ALL SELECT key, 'duplicate sidecar', ns FROM j WHERE ns > 1""",
    "sums_reconcile": f"WITH t AS ({_TEXTS_SQL}), l AS (SELECT * FROM t WHERE doc_id % 11 <> 0), r AS (SELECT path, CASE WHEN doc_id % 17 = 0 THEN repeat('0', 64) ELSE sha END AS sha FROM t WHERE doc_id % 13 <> 0) SELECT path, CASE WHEN r.sha IS NULL THEN 'missing' WHEN l.sha IS NULL THEN 'extra' ELSE 'differs' END AS finding FROM l FULL JOIN r USING (path) WHERE l.sha IS DISTINCT FROM r.sha",
    "entry_reconcile": f"WITH t AS ({_TEXTS_SQL}) SELECT path, 'left' AS side FROM t WHERE doc_id % 11 <> 0 AND doc_id % 13 = 0 UNION ALL SELECT path, 'right' FROM t WHERE doc_id % 11 = 0 AND doc_id % 13 <> 0",
    "site_resolve": "SELECT unnest(['nothing/x', 'orders']) AS site",
    "replica_diff": "SELECT concat('doc-', doc_id) AS path, 'differs' AS finding FROM documents WHERE doc_id % 101 = 0",
    "manifest_drift": "SELECT concat('/', r_name, '/', n_name) AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 = 0",
    "reachability": "SELECT * FROM (VALUES ('template', 'b', 'unreachable'), ('lexicon', 'unused', 'unreachable'), ('lexicon', 'missing', 'unknown')) t(kind, name, finding)",
    "slot_resolve": "SELECT concat('customer.', column_name) AS slot FROM (DESCRIBE orders)",
    "compose_cross": "SELECT (row_number() OVER (ORDER BY n_nationkey, r_regionkey) - 1)::BIGINT AS position, concat(n_name, ' ', r_name) AS surface FROM nation, region",
    "union_surfaces": "SELECT n_name AS surface FROM nation UNION SELECT r_name FROM region",
    "span_extract": _span_sql(),
    "span_shape": _span_shape_sql(),
    "span_overlap": _overlap_sql(),
    "pin_digest": f"SELECT sha256({o.text(chr(10).join(spans.ENTITY_LABELS) + chr(10))}) AS digest",
    "pack_digest": "SELECT sha256(string_agg(concat(n_name, chr(0), sha256(n_name), chr(10)), '' ORDER BY n_name)) AS digest FROM nation",
    "top_problems": f"SELECT n::INT AS n, CASE WHEN n <= 10 THEN problem ELSE 'more problems were left out' END AS problem FROM (SELECT row_number() OVER (ORDER BY problem) AS n, problem FROM (SELECT concat(origin, ' ', row_id, ' ', candidate) AS problem FROM ({_sweep_sql()}) WHERE valid_under <> '')) WHERE n <= 11",
    **{f"check_{k.lower()}": _check_sql(k) for k in ids.CHECKSUMMED},
    "assign_children": _assign_sql(16),
    "assign_trim": _assign_sql(12),
    "assign_fill": _assign_sql(25),
}
