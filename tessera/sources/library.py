"""What packs draw from beside their own lists: core lexicons, surfaces of entity labels, inverse-distribution tables, phrases not to emit.

The engine brings a small library of its own; another one is a directory with the same layout.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import yaml

HERE = Path(__file__).resolve().parent.parent / "data"


@dataclass(frozen=True)
class Library:
    lexicons_dir: Path = HERE / "lexicons"
    tables_dir: Path = HERE / "tables"
    phrases: Path = HERE / "phrases.txt"

    @cached_property
    def names(self) -> frozenset[str]:
        return frozenset(p.stem for p in self.lexicons_dir.glob("*.yaml") if p.stem != "special_descriptors")

    def lexicon(self, name: str) -> tuple[str, ...]:
        path = self.lexicons_dir / f"{name}.yaml"
        if name not in self.names:
            raise KeyError(f"no core lexicon {name!r}")
        values = yaml.safe_load(path.read_text(encoding="utf-8")).get("values", [])
        return tuple(str(v.get("name", "") if isinstance(v, dict) else v) for v in values)

    def surfaces(self, label: str) -> tuple[str, ...]:
        """The label's list, or the ordered product of lexicons that it names."""
        path = self.lexicons_dir / "special_descriptors.yaml"
        entry = yaml.safe_load(path.read_text(encoding="utf-8"))["labels"].get(label)
        if not entry:
            raise KeyError(f"no surfaces for {label}")
        if "compose" not in entry:
            return tuple(str(v) for v in entry["values"])
        out = [""]
        for name in entry["compose"]:
            values = self.lexicon(name)
            out = [f"{a} {b}".strip() for a in out for b in values]
        return tuple(out)

    def table(self, name: str) -> tuple[int, ...]:
        """An ascending table of integers whose digest stands in CHECKSUMS."""
        path = self.tables_dir / f"{name}.json"
        if not path.is_file():
            raise KeyError(f"no table {name!r}")
        raw = path.read_bytes()
        sums = dict(re.findall(r"^([0-9a-f]{64})  (\S+)$", (self.tables_dir / "CHECKSUMS").read_text(), re.M))
        if hashlib.sha256(raw).hexdigest() not in [d for d, n in sums.items() if n == path.name]:
            raise ValueError(f"{path.name}: CHECKSUMS lists another digest, or none")
        doc = json.loads(raw)
        values = tuple(doc.get("values") or doc.get("table") or next(v for v in doc.values() if isinstance(v, list)))
        if len(values) < 2 or any(a > b for a, b in zip(values, values[1:], strict=False)):
            raise ValueError(f"{path.name}: at least two values, none below its predecessor")
        return values
