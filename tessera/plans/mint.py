"""From a pack, a recipe and a seed to a dataset directory.

Every table is one DataFrame over ``spark.range``: each field's value is a column expression of its own stream, so any
partitioning gives the same rows. References are dealt by windows (operators.alloc); documents are rendered in Arrow batches. The
text lines are written in ranges of the index and joined in order.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import signal
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime
from decimal import Decimal
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws as dr
from ..functions import identifiers as ids
from ..functions import text as tx
from ..functions import u64
from ..operators import alloc, sweep, tally
from ..operators.spans import ENTITY_LABELS, LABELS
from ..session import reach_workers
from ..sources.library import HERE, Library
from .grammar import Parser, Slot, walk
from .render import Document, renderer
from .spec import CORE_VERSION, Field, Pack, Recipe, Table, count_fault, load_pack
from .streams import stream_prefix

MANIFEST, SUMS = "DATASET.json", "SHA256SUMS"
SCHEMA_VERSION = 2
FILE_BYTES, DATASET_BYTES = 256 << 20, 512 << 20
CLAIM = "The same engine version, pack digest, recipe, seed, identifier policy and format give the same bytes in data files and label sidecars, however the work is partitioned."
PLATFORMS = ("Spark 4 on any JVM that it supports",)
EXCLUDED = ("provenance.created_utc", "provenance.invocation")
WARNING = (
    "This dataset was generated under the identifier policy validator: its identifiers pass their checksums and serve to test validation only. "
    "Bank codes, card ranges and mail hosts in it are reserved ones, but personal and tax numbers have no reserved range and may coincide with real ones. "
    "Do not use it where they could be taken for real, and contact no one by it."
)
#: Lists longer than this are joined rather than inlined.
INLINE_LIST = 2_000


class MintError(RuntimeError):
    """A run cannot go on."""


def resolve_pack(argument: str) -> Path:
    """A path that exists, or else a pack of that name that ships with the engine, or else the path."""
    path, bundled = Path(argument), HERE / "packs" / argument
    return path if path.exists() or not (bundled / "pack.yaml").exists() else bundled


def resolve_policy(requested: str | None, recipe: Recipe, pack: Pack) -> str:
    """Omitted means safe; a recipe's policy binds; the pack must allow it."""
    policy = requested or "safe"
    if policy not in ids.POLICIES:
        raise MintError(f"unknown identifier policy {policy!r}")
    if recipe.policy not in (None, policy):
        raise MintError(f"recipe {recipe.name!r} binds the policy {recipe.policy!r}; {policy!r} was asked for")
    if policy not in pack.policies:
        raise MintError(f"the pack allows {', '.join(pack.policies)}, not {policy!r}")
    return policy


def resolve_counts(recipe: Recipe, overrides: dict[str, int] | None) -> dict[str, int]:
    counts = dict(recipe.records)
    for name, n in (overrides or {}).items():
        if name not in counts:
            raise MintError(f"recipe {recipe.name!r} has no records {name!r}")
        counts[name] = n
    if fault := count_fault(counts):
        raise MintError(": ".join(fault))
    return counts


@dataclass
class Minted:
    """A table as planned: rows (in ``columns``), the index they are ordered by, and the spans of its document."""

    table: Table
    rows: DataFrame
    count: int

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.table.fields]


def derived(kind: str, params: dict, source: Column, whole: bool) -> Column:
    """The value that a derived field takes from its source; ``whole`` if that is an integer."""
    if kind == "copy_of":
        return source
    if kind == "flag_unless":
        return ~source.eqNullSafe(F.lit(params.get("value")))
    if kind == "ratio_of":
        if not whole:
            return F.lit(None).cast("bigint")
        n, m = int(params.get("numerator", 1)), int(params.get("denominator", 1))
        if m < 0:
            n, m = -n, -m
        wide = source.cast("decimal(38,0)") * F.lit(Decimal(n))
        return F.floor((wide - F.pmod(wide, F.lit(Decimal(m)))) / F.lit(Decimal(m))).cast("bigint")
    return F.date_add(F.to_date(F.substring(source.cast("string"), 1, 10)), int(params.get("days", 0))).cast("string")


def unresolved(slots, table: str, fields) -> list[str]:
    """Names of field slots that a table's fields do not have."""
    allowed = {f"{table}.{x}" for x in fields}
    return sorted({s.name for s in slots if s.kind == "field" and s.name not in allowed})


@dataclass
class Plan:
    """One run's DataFrames."""

    spark: SparkSession
    pack: Pack
    recipe: Recipe
    seed: int
    policy: str
    counts: dict[str, int]
    library: Library = field(default_factory=Library)

    def __post_init__(self) -> None:
        reach_workers(self.spark)
        self.prefix = stream_prefix(self.seed, self.pack.name, self.pack.version, self.recipe.name)
        self.documents = {t.name: self._document(t) for t in self.pack.tables if t.document}

    def lexicon(self, name: str) -> tuple[str, ...]:
        values = self.pack.lexicons.get(name) or self.library.lexicon(name)
        if not values:
            raise MintError(f"lexicon {name!r} is empty")
        return values

    def surfaces(self, label: str) -> tuple[str, ...]:
        """The core's surfaces of a label, then the pack's own."""
        return self.library.surfaces(label) + tuple(v for name in self.pack.entity_lexicons.get(label, ()) for v in self.lexicon(name))

    def _document(self, table: Table) -> Document:
        """Every template of the set, parsed and its slots resolved, before the first row is made."""
        f = table.document
        entries = self.pack.templates[f.argument]
        known = frozenset(self.pack.lexicons) | self.library.names
        parsed = tuple(Parser(e.id, e.text, frozenset(LABELS), frozenset(ids.ALL), known).parse() for e in entries)
        slots = {n for nodes in parsed for n in walk(nodes) if isinstance(n, Slot)}
        if wrong := unresolved(slots, table.name, [x.name for x in table.fields]):
            raise MintError(f"templates {f.argument!r} name the unknown field {wrong[0]!r}")
        return Document(
            self.prefix,
            table.name,
            f.name,
            parsed,
            tuple(dr.scale_weights([e.weight for e in entries])),
            {f"{table.name}.{x.name}": x.label for x in table.fields if x.label != "none"},
            {s.name: self.surfaces(s.name) for s in slots if s.kind == "entity"},
            {s.name: self.lexicon(s.name) for s in slots if s.kind == "lex"},
            self.recipe.special_rate,
            self.policy == "safe",
        )

    def table(self, table: Table) -> Minted:
        n = self.counts.get(table.name, 0)
        df = self.spark.range(n).withColumnRenamed("id", "__index")
        for f in table.fields:
            if f.type == "ref":
                df = self._reference(df, table, f, n)
        with u64.wrapping(self.spark):
            df = self._values(df, table)
            if table.document:
                df = self._render(df, table)
            return Minted(table, df, n)

    def _reference(self, df: DataFrame, table: Table, f: Field, n: int) -> DataFrame:
        parent = next(t for t in self.pack.tables if t.name == f.ref.parent)
        parents = self.spark.range(self.counts.get(parent.name, 0)).withColumnRenamed("id", "p")
        if n == 0:
            return df.withColumn(f"__parent_{f.name}", F.lit(None).cast("bigint"))
        dealt = alloc.assign_children(parents, "p", self.prefix, f"{table.name}/{f.name}", n, f.ref.counts, f.ref.weights)
        return df.join(dealt.select(F.col("child").alias("__index"), F.col("parent").alias(f"__parent_{f.name}")), "__index", "left")

    def _values(self, df: DataFrame, table: Table) -> DataFrame:
        """Three projections: seeds of all fields, draws of all fields, values; then what is derived from them, in order."""
        streams, draws, values = {}, {}, {}
        for k, f in enumerate(table.fields):
            streams[f"__seed_{k}"] = (self.prefix, F.concat(F.lit(f"{table.name}/"), F.col("__index").cast("string"), F.lit(f"/{f.name}")))
            earlier = {x.name for x in table.fields[:k]}
            options = self._options(f, earlier)
            for j, (plan, _) in enumerate(options):
                draws[f"__d_{k}_{j}"] = (f"__seed_{k}", plan.bounds)
            values[f.name] = (k, options)
        used = {s for s, b in draws.values() if any(x > 1 for x in b)}
        df = u64.with_streams(df, {k: v for k, v in streams.items() if k in used})
        df = df.select("*", *[F.lit(0).cast("bigint").alias(s) for s in streams if s not in used])
        df = u64.with_draws(df, draws)
        simple = [f for f in table.fields if f.kind not in ("derived", "grammar") and not (f.kind == "identifier" and f.argument == "EMAIL") or f.type == "ref"]
        df = df.select("*", *[self._value(table, f, values[f.name]).alias(f.name) for f in simple])
        for f in table.fields:
            if f not in simple:
                df = df.withColumn(f.name, self._value(table, f, values[f.name]))
        return df.select("__index", *[f.name for f in table.fields])

    def _options(self, f: Field, earlier: set[str]) -> list[tuple[dr.Plan, Any]]:
        """Plans of a field's draws, the null draw first, each with a reader of the value; a mail address has two, with and without names."""
        out = []
        mail = f.type != "ref" and (f.kind == "identifier" and f.argument == "EMAIL" or f.generator == "derived:email_from_name")
        for nameless in (False, True) if mail else (False,):
            plan = dr.Plan()
            null = dr.bernoulli(plan, f.null_rate) if f.nullable and f.null_rate else None
            out.append((plan, (null, self._reader(plan, f, earlier, nameless))))
        return out

    def _name(self, which: str, earlier: set[str]) -> Column:
        return F.coalesce(F.col(which).cast("string"), F.lit("None")) if which in earlier else F.lit("")

    def _reader(self, plan: dr.Plan, f: Field, earlier: set[str], nameless: bool):
        p = f.params
        if f.type == "ref" or f.kind in ("seq_id", "grammar"):
            return None
        if f.generator == "derived:email_from_name" or f.kind == "identifier" and f.argument == "EMAIL":
            subdomain = str(p.get("subdomain") or "") or None if f.kind == "derived" else None
            return ids.make_email(plan, self._name("first_name", earlier), self._name("last_name", earlier), nameless, subdomain)
        if f.kind == "derived":
            return None
        if f.kind == "identifier":
            make = ids.FAMILIES[f.argument].make(plan, self.policy)
            return (lambda d: ids.mask_pan(make(d))) if f.argument == "PAN" else make
        if f.kind == "lexicon":
            return dr.from_list(plan, self.lexicon(f.argument))
        if f.kind == "enum_weighted":
            pick, values = dr.pick_weighted(plan, dr.scale_weights(p.get("weights", []))), [F.lit(str(v)) for v in p.get("values", [])]
            return lambda d: F.get(F.array(*values), pick(d))
        if f.kind == "int_uniform":
            low, high = int(p.get("low", 0)), int(p.get("high", 1))
            if -(1 << 63) <= low and high < 1 << 63 and high - low < 1 << 63:
                return dr.uniform(plan, low, high)
            read = plan.take(high - low + 1)
            return lambda d: (u64.as_decimal(read(d)[0]) + F.lit(Decimal(low))).cast("decimal(38,0)")
        if f.kind == "int_lognormal_table":
            return dr.from_table(plan, self.library.table(f.argument))
        if f.kind == "datetime_window":
            start, end = self.recipe.window
            if "age_years" in p:
                start, end = dr.age_window(start, *map(int, p["age_years"]))
            moment = dr.instant_in(plan, start, end)
            return lambda d: dr.local_date(moment(d)) if f.type == "date" else dr.local_datetime(moment(d))
        raise MintError(f"no generator {f.generator!r}")

    def _value(self, table: Table, f: Field, held: tuple[int, list]) -> Column:
        k, options = held
        drawn = [(F.col(f"__d_{k}_{j}"), null, read) for j, (_, (null, read)) in enumerate(options)]
        d, null, read = drawn[0]
        earlier = {x.name for x in table.fields[:k]}
        source = F.col(f.params["source"]) if f.params.get("source") in earlier else F.lit(None).cast("string")
        if f.type == "ref":
            parent = next(t for t in self.pack.tables if t.name == f.ref.parent)
            value = F.format_string(f"{parent.prefix}-%08d", F.col(f"__parent_{f.name}"))
        elif f.kind == "seq_id":
            value = F.format_string(f"{table.prefix}-%08d", F.col("__index"))
        elif f.kind == "grammar":
            value = F.lit("")
        elif len(drawn) == 2:
            without = (self._name("first_name", earlier) == "") & (self._name("last_name", earlier) == "")
            value = F.when(without, drawn[1][2](drawn[1][0])).otherwise(read(d))
        elif f.kind != "derived":
            value = read(d)
        else:
            kinds = {x.name: x.type for x in table.fields}
            value = derived(f.argument, f.params, source, kinds.get(str(f.params.get("source"))) == "int")
        return F.when(~null(d), value) if null else value

    def _render(self, df: DataFrame, table: Table) -> DataFrame:
        columns = ["__index", *[f.name for f in table.fields]]
        schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
        run = renderer(self.documents[table.name], columns)
        return df.select(*columns).mapInArrow(run, f"{schema}, `__spans` array<struct<start:int,end:int,label:string>>")


def lines(minted: Minted, fmt: str) -> DataFrame:
    """(__index, line): each row as one line of the format, without its newline."""
    for f in minted.rows.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            raise MintError(f"{f.name} holds floating point; amounts are integers, rates are text")
    if fmt == "jsonl":
        row = F.struct(*[F.col(f"`{c}`") for c in minted.columns])
        return minted.rows.select("__index", tx.json_line(row).alias("line"))
    cells = []
    for f in minted.rows.select(*minted.columns).schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("array", "map", "struct"):
            raise MintError(f"{f.name} is nested and has no form in CSV")
        cells.append(F.initcap(c.cast("string")) if kind == "boolean" else c.cast("string"))
    return minted.rows.select("__index", tx.csv_line(cells).alias("line"))


def formula_cells(minted: Minted) -> DataFrame:
    """Cells that a spreadsheet would run: none may be written as CSV."""
    texts = [f.name for f in minted.rows.schema.fields if f.dataType.typeName() == "string" and f.name in minted.columns]
    found = F.array_compact(F.array(*[F.when(tx.formula_trigger(F.col(c)).isNotNull(), F.lit(c)) for c in texts]))
    return minted.rows.select("__index", F.explode(found).alias("field"))


def sidecar_lines(minted: Minted) -> DataFrame:
    """(__index, line): the label sidecar of each document."""
    doc = minted.table.document.name
    key = minted.table.fields[0].name
    row = F.struct(F.col(key).cast("string").alias("doc_id"), tx.text_digest(F.col(doc)).alias("text_sha256"), F.col("__spans").alias("spans"))
    return minted.rows.select("__index", tx.json_line(row).alias("line"))


def _publish(df: DataFrame, header: str, target: Path, stage: Path, room: int) -> tuple[int, str]:
    """Writes the lines in ranges of their index and joins the parts in order: (bytes, sha256)."""
    parts = stage / f".{target.name}.parts"
    size = df.sparkSession.sparkContext.defaultParallelism
    df.repartitionByRange(size, "__index").sortWithinPartitions("__index").select("line").write.option("lineSep", "\n").text(parts.as_uri())
    digest, total = hashlib.sha256(), 0
    with open(target, "xb", opener=lambda p, flags: os.open(p, flags, 0o600)) as out:
        chunks = [header.encode()] if header else []
        for part in [None, *sorted(parts.glob("part-*"))]:
            for chunk in chunks if part is None else iter(lambda f=open(part, "rb"): f.read(1 << 20), b""):  # noqa: SIM115
                total += len(chunk)
                if total > FILE_BYTES or total > room:
                    raise MintError(f"{'output-byte-limit' if total > FILE_BYTES else 'dataset-output-byte-limit'}: {target.name}")
                digest.update(chunk)
                out.write(chunk)
    shutil.rmtree(parts)
    return total, digest.hexdigest()


def attribution(name: str, version: str, recipe: str, seed: object, license_: str) -> str:
    return f"{name} {version} reference dataset (recipe {recipe}, seed {seed}), licensed {license_}"


def taxonomy_pin() -> dict[str, str]:
    text = "".join(f"{x}\n" for x in ENTITY_LABELS)
    return {"name": "labels-tr", "version": "0.1", "pin_digest": hashlib.sha256(text.encode()).hexdigest()}


@contextmanager
def _terminable() -> Iterator[None]:
    """A request to terminate raises, so that what is staged is removed; only the main thread may listen for it."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_) -> None:
        raise SystemExit("terminated")

    before = signal.signal(signal.SIGTERM, stop)
    try:
        yield
    finally:
        signal.signal(signal.SIGTERM, before)


def mint(
    spark: SparkSession,
    *,
    pack: str | Path,
    recipe: str,
    seed: int,
    out: str | Path,
    identifier_policy: str | None = None,
    fmt: str = "jsonl",
    records: dict[str, int] | None = None,
    invocation: str = "mint",
    library: Library | None = None,
) -> dict[str, Any]:
    """Generates one dataset into the new directory ``out``, all or nothing, and returns its manifest."""
    if fmt not in ("jsonl", "csv"):
        raise MintError(f"unknown format {fmt!r}")
    loaded = load_pack(pack)
    declared = loaded.recipe(recipe)
    policy = resolve_policy(identifier_policy, declared, loaded)
    counts = resolve_counts(declared, records)
    plan = Plan(spark, loaded, declared, seed, policy, counts, library or Library())
    target = Path(out).resolve()
    if target.exists():
        raise MintError(f"{target} exists already")
    target.parent.mkdir(parents=True, exist_ok=True)
    stage = Path(tempfile.mkdtemp(prefix=f".{target.name}-", dir=target.parent))
    try:
        with _terminable():
            manifest = _fill(plan, stage, fmt, {"records": dict(sorted(records.items()))} if records else {}, invocation)
            if target.exists():
                raise MintError(f"{target} exists already")
            os.rename(stage, target)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise
    return manifest


def write_tables(spark: SparkSession, *, pack: str | Path, recipe: str, seed: int, folder: str, records: dict[str, int], identifier_policy: str | None = None, fmt: str = "parquet", library: Library | None = None) -> None:
    """Every table as files of ``fmt`` (any that Spark writes) below ``folder``, a path of any file system that Spark reaches, each row in the file of its
    partition and spans beside documents. Nothing is joined or counted at the driver, and the ceilings of a dataset directory do not hold:
    rows are those that ``mint`` makes of the same pack, recipe, seed and numbers of records."""
    loaded = load_pack(pack)
    declared = loaded.recipe(recipe)
    plan = Plan(spark, loaded, declared, seed, resolve_policy(identifier_policy, declared, loaded), dict(records), library or Library())
    for table in loaded.tables:
        minted = plan.table(table)
        rows = minted.rows.select(*minted.columns, F.col("__spans").alias("spans")) if table.document else minted.rows.select(*minted.columns)
        rows.write.format(fmt).save(f"{folder}/{table.name}")


def _fill(plan: Plan, stage: Path, fmt: str, overrides: dict, invocation: str) -> dict[str, Any]:
    outputs, record_counts, distributions, coverage, room = [], {}, [], {}, DATASET_BYTES
    for table in plan.pack.tables:
        minted = plan.table(table)
        if table.document:
            minted.rows = minted.rows.persist()
        if plan.policy == "safe":
            hit = sweep.violations(minted.rows.select("__index", *minted.columns), ["__index"], sweep.scalar_texts(minted.rows.select(*minted.columns).schema)).first()
            if hit:
                raise MintError(f"{table.name} record {hit['__index']} holds a valid {hit.family} under the safe policy")
        if fmt == "csv" and (cell := formula_cells(minted).first()):
            raise MintError(f"{table.name} record {cell['__index']}: {cell.field} is a spreadsheet formula")
        record_counts[table.name] = minted.count
        header = tx_header(minted.columns) if fmt == "csv" else ""
        files = [(f"{table.name}.{fmt}", lines(minted, fmt), header)]
        if table.document and minted.count:
            files.append((f"{table.name}.labels.jsonl", sidecar_lines(minted), ""))
        for name, df, head in files:
            size, digest = _publish(df, head, stage / name, stage, room)
            room -= size
            outputs.append({"path": name, "bytes": size, "sha256": digest, "records": minted.count})
        distributions += _distributions(minted)
        if table.document:
            spans = minted.rows.select(F.explode("__spans.label").alias("label"))
            for r in spans.groupBy("label").count().collect():
                coverage[r.label] = coverage.get(r.label, 0) + r["count"]
            minted.rows.unpersist()
    manifest = manifest_document(plan, sorted(outputs, key=lambda o: o["path"]), record_counts, distributions, coverage, overrides, invocation)
    text = json.dumps(manifest, ensure_ascii=False, indent=2) + "\n"
    (stage / MANIFEST).write_text(text, encoding="utf-8", newline="\n")
    sums = {o["path"]: o["sha256"] for o in outputs} | {MANIFEST: hashlib.sha256(text.encode("utf-8")).hexdigest()}
    (stage / SUMS).write_text("".join(f"{sums[p]}  {p}\n" for p in sorted(sums, key=lambda p: p.encode())), newline="\n")
    return manifest


def tx_header(columns: list[str]) -> str:
    return ",".join(columns) + "\n"


def _distributions(minted: Minted) -> list[dict[str, Any]]:
    """Target and achieved shares of every weighted field, in the order in which they are first seen."""
    out = []
    for position, f in enumerate(minted.table.fields):
        if f.kind != "enum_weighted" or f.type == "ref" or not minted.count:
            continue
        first = minted.rows.filter(F.col(f.name).isNotNull()).agg(F.min("__index")).first()[0]
        if first is None:
            continue
        targets = {str(v): str(w) for v, w in zip(f.params["values"], f.params["weights"], strict=True)}
        rows = {r.value: r for r in tally.tally(minted.rows, F.col(f.name), targets).collect()}
        stat = {"site": f"{minted.table.name}/{f.name}", "target": targets, "achieved": {k: rows[k].achieved for k in sorted(targets)}, "within_tolerance": all(r.near for r in rows.values())}
        out.append((first, position, stat))
    return [stat for _, _, stat in sorted(out, key=lambda x: x[:2])]


def manifest_document(plan: Plan, outputs: list, record_counts: dict, distributions: list, coverage: dict, overrides: dict, invocation: str) -> dict[str, Any]:
    p, r = plan.pack, plan.recipe
    out: dict[str, Any] = {
        "engine": {"version": CORE_VERSION, "manifest_schema_version": SCHEMA_VERSION},
        "pack": {"name": p.name, "version": p.version, "digest": p.digest},
        "recipe": {
            "name": r.name,
            "parameters": {"records": dict(sorted(record_counts.items())), "date_window": {"start": r.start.isoformat(), "end": r.end.isoformat()}, "overrides": overrides},
        },
        "seed": str(plan.seed),
        "identifier_policy": plan.policy,
    }
    if plan.policy == "validator":
        out["validator_warning"] = WARNING
    targets = [{"label": k, "target": n, "achieved": coverage.get(k, 0), "met": coverage.get(k, 0) >= n} for k, n in sorted(r.coverage.items())]
    return out | {
        "license": {"code": "Apache-2.0", "datasets": p.license, "attribution": attribution(p.name, p.version, r.name, plan.seed, p.license)},
        "taxonomy": taxonomy_pin(),
        "outputs": outputs,
        "stats": {"record_counts": dict(sorted(record_counts.items())), "distributions": distributions, "coverage_targets": targets},
        "entity_coverage": dict(sorted(coverage.items())),
        "determinism": {"claim": CLAIM, "platforms": list(PLATFORMS), "excluded": list(EXCLUDED)},
        "provenance": {"created_utc": datetime.now(tz=UTC).isoformat(timespec="seconds"), "invocation": invocation},
    }
