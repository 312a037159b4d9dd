"""Verifying a dataset directory from its files alone, and making it again from its manifest."""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections import Counter
from dataclasses import asdict, dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import POLICIES
from ..operators import reconcile, spans, sweep, tally
from ..functions.text import display_path
from ..session import reach_workers
from ..sources.dataset import DATA_BYTES, DatasetError, Reader, parse_sums
from ..sources.library import Library
from ..sources.records import read_records, read_sidecars
from ..sources.strict import SpecError, loads_json
from . import mint as m
from .grammar import Parser, TemplateError, literals
from .spec import Any_, Closed, Int, Many, MapOf, OneOf, Pack, Shape, Str, load_pack

MAX_PROBLEMS, MAX_SCHEMA_PROBLEMS = 1_000, 100
_SHA, _SHARES = Str("[0-9a-f]{64}"), MapOf(Str(r"[0-9]+(\.[0-9]+)?"))
MANIFEST = Closed(
    {
        "engine": Closed({"version": Str(), "manifest_schema_version": OneOf((m.SCHEMA_VERSION,))}),
        "pack": Closed({"name": Str(), "version": Str(), "digest": _SHA}),
        "recipe": Closed({"name": Str(), "parameters": Closed({"records": MapOf(Int(0)), "date_window": Closed({"start": Str(), "end": Str()}), "overrides": Closed({}, {"records": MapOf(Int(0))})})}),
        "seed": Str("[0-9]{1,20}"),
        "identifier_policy": OneOf(POLICIES),
        "license": Closed({"code": Str(), "datasets": Str(), "attribution": Str()}),
        "taxonomy": Closed({"name": Str(), "version": Str(), "pin_digest": _SHA}),
        "outputs": Many(Closed({"path": Str("[A-Za-z0-9][A-Za-z0-9._-]{0,254}"), "bytes": Int(0), "sha256": _SHA, "records": Int(0)})),
        "stats": Closed(
            {
                "record_counts": MapOf(Int(0)),
                "distributions": Many(Closed({"site": Str(), "target": _SHARES, "achieved": _SHARES, "within_tolerance": Any_(bool)})),
                "coverage_targets": Many(Closed({"label": Str(), "target": Int(0), "achieved": Int(0), "met": Any_(bool)})),
            }
        ),
        "entity_coverage": MapOf(Int(0)),
        "determinism": Closed({"claim": Str(), "platforms": Many(Str()), "excluded": Many(Str())}),
        "provenance": Closed({"created_utc": Str(), "invocation": Str()}),
    },
    {"validator_warning": Str()},
)


@dataclass
class Report:
    """What was checked, and what is wrong; at most MAX_PROBLEMS problems and a marker."""

    directory: str
    identifier_policy: str = ""
    checksums_checked: int = 0
    checksums_matched: int = 0
    documents_checked: int = 0
    spans_checked: int = 0
    checksum_valid_identifiers: int = 0
    coverage_checked: bool = False
    coverage_targets_checked: int = 0
    manifest_sha256: str = ""
    problems: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.problems

    def add(self, *problems: str) -> None:
        for p in problems:
            if len(self.problems) < MAX_PROBLEMS:
                self.problems.append(p)
            elif len(self.problems) == MAX_PROBLEMS:
                self.problems.append("more problems were left out")

    def to_json(self) -> dict[str, Any]:
        return asdict(self) | {"ok": self.ok}

    def render(self) -> str:
        shown = {k: v for k, v in asdict(self).items() if k != "problems"}
        head = [f"{k.replace('_', ' ')}: {v}" for k, v in shown.items()]
        return "\n".join([*head, "ok" if self.ok else f"{len(self.problems)} problem(s)", *[f"- {p}" for p in self.problems]])


def schema_faults(value: Any, shape: Shape = MANIFEST) -> list[str]:
    return [f"{at or '/'}: {why[:240]}" for at, why in sorted(shape.check(value, ""))][:MAX_SCHEMA_PROBLEMS]


def verify(spark: SparkSession, directory: str | Path, *, trusted_manifest_sha256: str | None = None) -> Report:
    """Checks files, claims and spans; problems in the files never raise."""
    reach_workers(spark)
    report = Report(str(directory))
    try:
        with Reader(Path(directory)) as reader:
            _verify(spark, reader, report, trusted_manifest_sha256)
    except (DatasetError, OSError, ValueError) as why:
        report.add(f"verification ended safely: {type(why).__name__}: {why}")
    return report


def _verify(spark: SparkSession, reader: Reader, report: Report, trusted: str | None) -> None:
    text = reader.text(m.MANIFEST)
    report.manifest_sha256 = hashlib.sha256(text.encode("utf-8")).hexdigest()
    if trusted is not None and trusted != report.manifest_sha256:
        report.add(f"{m.MANIFEST}: not the manifest that is trusted")
    doc = loads_json(text, m.MANIFEST)
    if faults := schema_faults(doc):
        report.add(*[f"{m.MANIFEST}{f}" for f in faults])
        return
    report.identifier_policy = doc["identifier_policy"]
    if doc["taxonomy"] != m.taxonomy_pin():
        report.add("taxonomy is not the one pinned")
    if not _semantics(doc, report):
        return
    warning = doc.get("validator_warning")
    if doc["identifier_policy"] == "validator" and warning != m.WARNING:
        report.add("the validator warning is missing" if warning is None else "the validator warning was altered")
    if doc["identifier_policy"] == "safe" and warning is not None:
        report.add("a validator warning under the safe policy")
    _checksums(reader, doc, report)
    _contents(spark, reader, doc, report)
    _coverage(doc, report)


def _semantics(doc: dict, report: Report) -> bool:
    before, paths = len(report.problems), [o["path"] for o in doc["outputs"]]
    report.add(*[f"output {p!r} is listed more than once" for p, n in sorted(Counter(paths).items()) if n > 1])
    report.add(*[f"outputs may not hold {p}" for p in (m.MANIFEST, m.SUMS) if p in paths])
    if sum(o["bytes"] for o in doc["outputs"]) > m.DATASET_BYTES:
        report.add(f"outputs claim more than {m.DATASET_BYTES} bytes")
    if int(doc["seed"]) >= 1 << 64:
        report.add("the seed is outside 0..2^64-1")
    return len(report.problems) == before


def _checksums(reader: Reader, doc: dict, report: Report) -> None:
    for o in doc["outputs"]:
        report.checksums_checked += 1
        try:
            digest, size = reader.digest(o["path"])
        except DatasetError as why:
            report.add(str(why))
            continue
        if digest != o["sha256"]:
            report.add(f"{o['path']}: checksum mismatch")
        elif size != o["bytes"]:
            report.add(f"{o['path']}: {size} bytes, not {o['bytes']}")
        else:
            report.checksums_matched += 1
    listed = {o["path"] for o in doc["outputs"]} | {m.MANIFEST, m.SUMS}
    for name, kind in reader.entries():
        if kind != "file":
            report.add(f"{name}: a {kind}, not a file")
        if name not in listed:
            report.add(f"{name}: not listed in the manifest")
    try:
        sums = parse_sums(reader.text(m.SUMS))
    except DatasetError as why:
        report.add(str(why))
        return
    wanted = {o["path"]: o["sha256"] for o in doc["outputs"]} | {m.MANIFEST: report.manifest_sha256}
    report.add(*[f"{m.SUMS} {'omits' if p not in sums else 'disagrees on'} {p}" for p in sorted(wanted) if sums.get(p) != wanted[p]])
    report.add(*[f"{m.SUMS} lists {p!r} besides" for p in sorted(set(sums) - set(wanted))])


def _capped(report: Report, df: DataFrame, column: str = "problem") -> None:
    """Adds problems in a fixed order; one more than may be shown is fetched."""
    report.add(*[r[0] for r in df.select(column).orderBy(column).limit(MAX_PROBLEMS + 1).collect()])


def _contents(spark: SparkSession, reader: Reader, doc: dict, report: Report) -> None:
    """Counts, shares, the identifier sweep and the spans, from one parse of the data files."""
    names = {o["path"]: o for o in doc["outputs"]}
    primary: dict[str, str] = {}
    for name in names:
        if name.endswith(".labels.jsonl"):
            continue
        stem, dot, kind = name.rpartition(".")
        if kind not in ("jsonl", "csv") or not dot:
            report.add(f"{name}: unsupported format")
        elif stem in primary:
            report.add(f"{name}: a second file of {stem!r}")
        else:
            primary[stem] = name
    present = {n for n, k in reader.entries() if k == "file"}
    sites: dict[str, dict] = {}
    for d in doc["stats"]["distributions"]:
        stem, slash, name = d["site"].partition("/")
        if d["site"] in sites:
            report.add(f"distribution {d['site']!r} repeats")
        elif not slash or "/" in name or stem not in primary:
            report.add(f"distribution {d['site']!r} does not resolve")
        else:
            sites[d["site"]] = d
    path = lambda n: str(reader.root.resolve() / n)
    files = [{"file": n, "path": path(n), "sites": [s.partition("/")[2] for s in sites if s.startswith(f"{stem}/")]} for stem, n in primary.items() if n in present]
    records = read_records(spark, files).repartition(spark.sparkContext.defaultParallelism).persist()
    try:
        _capped(report, records.filter("problem is not null"))
        counts = {r.file: r["count"] for r in records.filter("problem is null").groupBy("file").count().collect()}
        actual = {stem: counts.get(n, 0) for stem, n in primary.items()}
        report.add(*[f"{n}: {names[n]['records']} records claimed, {actual[stem]} found" for stem, n in primary.items() if names[n]["records"] != actual[stem]])
        for where, claimed in (("stats.record_counts", doc["stats"]["record_counts"]), ("recipe.parameters.records", doc["recipe"]["parameters"]["records"])):
            if claimed != actual:
                report.add(f"{where} is not what the files hold")
        for site, d in sites.items():
            _shares(records.filter(F.col("file") == primary[site.partition("/")[0]]), site, d, report)
        hits = sweep.violations(records, ["file", "number"], [F.array_join("texts", "\n")])
        report.checksum_valid_identifiers = hits.count()
        if report.identifier_policy == "safe" and report.checksum_valid_identifiers:
            _capped(report, hits.select(F.format_string("%s line %d: holds a valid %s under the safe policy", "file", "number", "family").alias("problem")))
        labels = _spans(spark, reader, doc, report, records, primary, present)
        _claims(doc, labels, report)
    finally:
        records.unpersist()


def _shares(records: DataFrame, site: str, d: dict, report: Report) -> None:
    value = F.element_at("sites", site.partition("/")[2])
    for r in tally.unexpected(records, value, d["target"]).orderBy("value").limit(MAX_PROBLEMS).collect():
        report.add(f"distribution {site!r} omits the value {r.value!r}")
    rows = {r.value: r for r in tally.tally(records, value, d["target"]).collect()}
    if d["achieved"] != {k: rows[k].achieved for k in sorted(d["target"])}:
        report.add(f"distribution {site!r} claims false shares")
    if d["within_tolerance"] is not all(r.near for r in rows.values()):
        report.add(f"distribution {site!r} has a false tolerance flag")


def _spans(spark: SparkSession, reader: Reader, doc: dict, report: Report, records: DataFrame, primary: dict, present: set) -> dict[str, int]:
    """Every sidecar line against its document, every span against its text; labels of the sound ones."""
    sidecars = [o["path"] for o in doc["outputs"] if o["path"].endswith(".labels.jsonl")]
    report.add(*[f"{n}: no data file beside it" for n in sidecars if n.removesuffix(".labels.jsonl") not in primary])
    known = [n for n in sidecars if n.removesuffix(".labels.jsonl") in primary and n in present]
    if not known:
        return {}
    lines = read_sidecars(spark, [{"file": n, "path": str(reader.root.resolve() / n)} for n in known]).repartition(spark.sparkContext.defaultParallelism).persist()
    _capped(report, lines.filter("problem is not null"))
    data_of = {n: primary[n.removesuffix(".labels.jsonl")] for n in known}
    key = lambda c: F.concat_ws("\0", F.col("file"), c)
    to_sidecar = F.create_map(*[F.lit(x) for n, d in data_of.items() for x in (d, n)])
    docs = records.filter(F.col("file").isin(*data_of.values()) & F.col("doc_id").isNotNull() & F.col("doc_text").isNotNull())
    docs = docs.withColumn("file", F.element_at(to_sidecar, F.col("file"))).select(key(F.col("doc_id")).alias("key"), "doc_text")
    marked = lines.filter("doc_id is not null").withColumn("key", key(F.col("doc_id")))
    found = reconcile.sidecar_findings(docs, marked, "key")
    _capped(report, found.select(F.concat(F.replace("key", F.lit("\0"), F.lit(": ")), F.lit(": "), "finding").alias("problem")))
    first = marked.filter("problem is null").dropDuplicates(["key"]).join(docs.dropDuplicates(["key"]), "key")
    report.documents_checked = lines.count()
    differs = F.sha2("doc_text", 256) != F.col("text_sha256")
    where = F.format_string("%s line %d: ", "file", "number")
    _capped(report, first.filter(differs).select(F.concat(where, F.lit("text_sha256 is not that of the document")).alias("problem")))
    each = first.filter(~differs).select("key", "file", "number", F.col("doc_text").alias("text"), F.explode("spans").alias("s"))
    each = each.select("key", "file", "number", "text", "s.start", "s.end", "s.label", F.col("s.problem").alias("fault"))
    held = spans.findings(each.withColumn("start", F.col("start").cast("int")).withColumn("end", F.col("end").cast("int")), list(spans.LABELS)).withColumn("finding", F.coalesce("fault", "finding")).persist()
    report.spans_checked = held.count()
    _capped(report, held.filter("finding is not null").select(F.concat(where, F.format_string("span [%d, %d) %s: ", "start", "end", "label"), "finding").alias("problem")))
    sound = held.filter("finding is null")
    _capped(report, spans.overlaps(sound, "key").select(F.concat(F.replace("key", F.lit("\0"), F.lit(": ")), F.lit(": "), "finding", F.lit(" spans")).alias("problem")))
    counts = {r.file: r.n for r in marked.groupBy("file").agg(F.countDistinct("key").alias("n")).collect()}
    claimed = {o["path"]: o["records"] for o in doc["outputs"]}
    report.add(*[f"{n}: {claimed[n]} records claimed, {counts.get(n, 0)} found" for n in known if claimed[n] != counts.get(n, 0)])
    labels = {r.label: r["count"] for r in sound.groupBy("label").count().collect()}
    held.unpersist()
    lines.unpersist()
    return labels


def _claims(doc: dict, labels: dict[str, int], report: Report) -> None:
    if doc["entity_coverage"] != labels:
        report.add("entity_coverage is not what the sidecars hold")
    seen: set[str] = set()
    for c in doc["stats"]["coverage_targets"]:
        n = labels.get(c["label"], 0)
        if c["label"] in seen or c["label"] not in spans.LABELS:
            report.add(f"coverage target {c['label']!r} repeats, or is no label")
        seen.add(c["label"])
        if c["achieved"] != n or c["met"] is not (n >= c["target"]):
            report.add(f"coverage target {c['label']!r} makes a false claim")
    p, r = doc["pack"], doc["recipe"]["name"]
    if doc["license"]["attribution"] != m.attribution(p["name"], p["version"], r, doc["seed"], doc["license"]["datasets"]):
        report.add("the attribution is not that of this dataset")
    if doc["determinism"] != {"claim": m.CLAIM, "platforms": list(m.PLATFORMS), "excluded": list(m.EXCLUDED)}:
        report.add("the determinism block is not the engine's")
    try:
        naive = datetime.fromisoformat(doc["provenance"]["created_utc"]).tzinfo is None
    except ValueError:
        naive = True
    if naive:
        report.add("created_utc is no instant with an offset")
    if any(c in doc["provenance"]["invocation"] for c in "\0\r\n"):
        report.add("the invocation holds control characters")


def _coverage(doc: dict, report: Report) -> None:
    """A missed target fails, unless the record counts were overridden."""
    report.coverage_checked = "records" not in doc["recipe"]["parameters"]["overrides"]
    if report.coverage_checked:
        for c in doc["stats"]["coverage_targets"]:
            report.coverage_targets_checked += 1
            if c["achieved"] < c["target"]:
                report.add(f"coverage target {c['label']} = {c['target']} was missed: {c['achieved']}")


def leaves(value: Any, at: tuple = ()) -> dict[tuple, Any]:
    """Leaf values of a nested document by path; a list is one leaf."""
    if isinstance(value, dict) and value:
        return {k: v for name, x in value.items() for k, v in leaves(x, (*at, name)).items()}
    return {at: value}


def drift(a: dict, b: dict) -> list[str]:
    """Paths at which two manifests differ, their provenance left out."""
    x, y = (leaves({k: v for k, v in d.items() if k != "provenance"}) for d in (a, b))
    return [display_path(list(p)) for p in sorted(x.keys() | y.keys(), key=str) if (p in x) != (p in y) or x.get(p) != y.get(p)]


@dataclass
class Reproduction:
    report: Report
    differing: list[str] = field(default_factory=list)
    drift: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return self.report.ok and not self.differing and not self.drift


def locate_pack(name: str, near: Path, given: str | Path | None = None) -> Path:
    """The first of the places where a pack may be that holds one of this name."""
    short = name.split("-", 1)[-1]
    tried = [given] if given else [Path("packs") / short, Path("packs") / name, near.parent / short, near.parent / name, m.HERE / "packs" / short, m.HERE / "packs" / name]
    for p in map(Path, tried):
        try:
            if load_pack(p).name == name:
                return p
        except SpecError:
            continue
    raise m.MintError(f"no pack {name!r} was found")


def reproduce(spark: SparkSession, directory: str | Path, *, pack: str | Path | None = None, library: Library | None = None) -> Reproduction:
    """Verifies, generates again from what the manifest records, and compares bytes and manifests."""
    root = Path(directory)
    report = verify(spark, root)
    if not report.ok:
        return Reproduction(report)
    with Reader(root) as reader:
        text = reader.text(m.MANIFEST)
        doc = loads_json(text, m.MANIFEST)
        if hashlib.sha256(text.encode()).hexdigest() != report.manifest_sha256:
            report.add("the manifest changed since it was verified")
            return Reproduction(report)
        out = Reproduction(report)
        formats = {o["path"].rpartition(".")[2] for o in doc["outputs"] if not o["path"].endswith(".labels.jsonl")}
        with tempfile.TemporaryDirectory() as tmp:
            again = m.mint(
                spark,
                pack=locate_pack(doc["pack"]["name"], root.resolve(), pack),
                recipe=doc["recipe"]["name"],
                seed=int(doc["seed"]),
                out=Path(tmp) / "again",
                identifier_policy=doc["identifier_policy"],
                fmt=formats.pop() if len(formats) == 1 else "jsonl",
                records=doc["recipe"]["parameters"]["overrides"].get("records"),
                library=library,
            )
            sums = {o["path"]: o["sha256"] for o in again["outputs"]}
            out.differing = [o["path"] for o in doc["outputs"] if sums.get(o["path"]) != reader.digest(o["path"], DATA_BYTES)[0]]
    found = drift(doc, again)
    out.notes = [f"{p} differs" for p in found if p == "/engine/version"]
    out.drift = [p for p in found if p != "/engine/version"]
    return out


def small_counts(pack: Pack, recipe, most: int = 25) -> dict[str, int]:
    """Few records of each table, within what references allow."""
    out: dict[str, int] = {}
    for t in pack.tables:
        n = min(recipe.records.get(t.name, 0), most)
        for f in t.fields:
            if f.ref and n:
                parents = out.get(f.ref.parent, 0)
                n = max(parents * min(f.ref.counts), min(n, parents * max(f.ref.counts)))
        if t.name in recipe.records:
            out[t.name] = n
    return out


def packcheck(spark: SparkSession, root: str | Path, library: Library | None = None) -> list[str]:
    """Problems of a pack: phrases and valid identifiers in what it declares, and every recipe generated small, verified and scanned."""
    library = library or Library()
    pack, problems = load_pack(root), []
    declared = [(f"lexicon {k}", v) for k, values in pack.lexicons.items() for v in values]
    declared += [(f"{t.name}/{f.name}", str(v)) for t in pack.tables for f in t.fields for v in f.params.get("values", [])]
    for name, entries in pack.templates.items():
        for e in entries:
            try:
                nodes = Parser(e.id, e.text, frozenset(spans.LABELS), frozenset(("TCKN", "VKN", "IBAN", "PAN", "PHONE", "EMAIL")), frozenset(pack.lexicons) | library.names).parse()
                declared += [(f"templates {name}/{e.id}", x) for x in literals(nodes)]
            except (TemplateError, ValueError) as why:
                problems.append(f"templates {name}/{e.id}: {why}")
    phrases = sweep.read_phrases(library.phrases)
    if declared:
        df = spark.createDataFrame(declared, "origin string, text string")
        problems += [f"{r.origin}: holds {r.phrase!r} ({r.source})" for r in sweep.phrase_hits(df, ["origin"], F.col("text"), phrases).orderBy("origin", "phrase").limit(MAX_PROBLEMS).collect()]
        problems += [f"{r.origin}: holds a valid {r.family}" for r in sweep.violations(df, ["origin"], [F.col("text")]).orderBy("origin").limit(MAX_PROBLEMS).collect()]
    for recipe in pack.recipes.values():
        counts = small_counts(pack, recipe)
        with tempfile.TemporaryDirectory() as tmp:
            out = Path(tmp) / "mini"
            try:
                manifest = m.mint(spark, pack=root, recipe=recipe.name, seed=1, out=out, identifier_policy=recipe.policy, records=counts, library=library)
            except (m.MintError, ValueError, KeyError) as why:
                problems.append(f"recipe {recipe.name}: {why}")
                continue
            problems += [f"recipe {recipe.name}: {p}" for p in verify(spark, out).problems]
            files = [{"file": o["path"], "path": str(out / o["path"]), "sites": []} for o in manifest["outputs"] if not o["path"].endswith(".labels.jsonl")]
            texts = read_records(spark, files).select("file", F.explode("texts").alias("text"))
            problems += [f"recipe {recipe.name}: {r.file} holds {r.phrase!r}" for r in sweep.phrase_hits(texts, ["file"], F.col("text"), phrases).distinct().orderBy("file", "phrase").limit(MAX_PROBLEMS).collect()]
        whole, mini = sum(recipe.records.values()), sum(counts.values())
        for label, target in recipe.coverage.items():
            if manifest["entity_coverage"].get(label, 0) * whole < target * mini:
                problems.append(f"recipe {recipe.name}: {label} will hardly reach {target}")
    return problems


def inspect(directory: str | Path) -> dict[str, Any]:
    """A dataset's manifest, read as strictly as for verification but not verified."""
    with Reader(Path(directory)) as reader:
        doc = loads_json(reader.text(m.MANIFEST), m.MANIFEST)
    if faults := schema_faults(doc):
        raise DatasetError("; ".join(faults[:5]))
    return json.loads(json.dumps(doc))
