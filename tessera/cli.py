"""Command line: mint, verify, reproduce, packcheck, inspect, schema."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import __version__
from .plans.mint import MintError, mint, resolve_pack
from .plans.verify import inspect, packcheck, reproduce, verify
from .sources.dataset import DatasetError
from .sources.strict import SpecError

# Exit codes: done, failed, bad declaration or usage, verification failed, reproduction differs, interrupted.
DONE, FAILED, REFUSED, INVALID, DIFFERS, INTERRUPTED = 0, 1, 2, 3, 4, 130


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    verbs = p.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("mint", help="generate a dataset")
    for name in ("--pack", "--recipe", "--out"):
        v.add_argument(name, required=True)
    v.add_argument("--seed", type=int, required=True)
    v.add_argument("--identifier-policy", choices=("safe", "validator"))
    v.add_argument("--format", choices=("jsonl", "csv"), default="jsonl")
    v.add_argument("--records", action="append", default=[], metavar="TYPE=N")
    v = verbs.add_parser("verify", help="check a dataset")
    v.add_argument("directory")
    v.add_argument("--trusted-manifest-sha256")
    v = verbs.add_parser("reproduce", help="generate a dataset again and compare")
    v.add_argument("directory")
    v.add_argument("--pack")
    verbs.add_parser("packcheck", help="check a pack").add_argument("pack")
    verbs.add_parser("inspect", help="show a manifest").add_argument("directory")
    verbs.add_parser("schema", help="print the JSON Schema of a kind of file").add_argument("kind", nargs="?", choices=("manifest", "pack", "table", "recipe", "templates"), default="manifest")
    for v in verbs.choices.values():
        v.add_argument("--json", action="store_true")
    return p


def _records(pairs: list[str]) -> dict[str, int] | None:
    out = {}
    for pair in pairs:
        name, eq, n = pair.partition("=")
        if not eq or not n.isdigit():
            raise MintError(f"--records takes TYPE=N, not {pair!r}")
        out[name] = int(n)
    return out or None


def run(args: argparse.Namespace, spark: SparkSession) -> tuple[int, dict, str]:
    if args.verb == "mint":
        m = mint(spark, pack=resolve_pack(args.pack), recipe=args.recipe, seed=args.seed, out=args.out, identifier_policy=args.identifier_policy, fmt=args.format, records=_records(args.records), invocation="mint --pack <pack> --out <out>")
        return DONE, m, "\n".join(f"{o['path']}: {o['records']} records" for o in m["outputs"])
    if args.verb == "verify":
        r = verify(spark, args.directory, trusted_manifest_sha256=args.trusted_manifest_sha256)
        return DONE if r.ok else INVALID, r.to_json(), r.render()
    if args.verb == "reproduce":
        r = reproduce(spark, args.directory, pack=args.pack)
        doc = {"ok": r.ok, "problems": r.report.problems, "differing": r.differing, "drift": r.drift, "notes": r.notes}
        return DONE if r.ok else INVALID if r.report.problems else DIFFERS, doc, json.dumps(doc, indent=2)
    if args.verb == "packcheck":
        problems = packcheck(spark, resolve_pack(args.pack))
        return DONE if not problems else INVALID, {"ok": not problems, "problems": problems}, "\n".join(problems) or "ok"
    raise AssertionError(args.verb)


def schema_of(kind: str) -> dict:
    from .plans import spec
    from .plans.verify import MANIFEST

    shape = MANIFEST if kind == "manifest" else getattr(spec, kind.upper())
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": kind} | shape.json_schema()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.verb in ("inspect", "schema"):
            doc = inspect(args.directory) if args.verb == "inspect" else schema_of(args.kind)
            code, text = DONE, json.dumps(doc, ensure_ascii=False, indent=2)
        else:
            code, doc, text = run(args, spark or SparkSession.builder.appName("tessera").getOrCreate())
    except (SpecError, DatasetError) as why:
        code, doc, text = REFUSED, {"ok": False, "error": str(why)}, str(why)
    except (MintError, ValueError, KeyError, OSError) as why:
        code, doc, text = FAILED, {"ok": False, "error": str(why)}, str(why)
    except KeyboardInterrupt:
        return INTERRUPTED
    print(json.dumps(doc, ensure_ascii=False) if args.json else text, file=sys.stdout if code in (DONE, INVALID, DIFFERS) else sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
