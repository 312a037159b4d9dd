"""Strict YAML and JSON: whatever could be read in two ways is refused, by the name of a rule."""

from __future__ import annotations

import json
from collections.abc import Hashable
from pathlib import Path
from typing import Any

import yaml

# Ceilings.
YAML_BYTES, YAML_DEPTH, YAML_NODES, YAML_SCALAR = 1 << 20, 64, 100_000, 256_000


class SpecError(ValueError):
    """A declaration is refused: where, and by which rule."""

    def __init__(self, path: object, location: str, rule: str, detail: str):
        super().__init__(f"{path}: {location}: {rule}: {detail}")
        self.path, self.location, self.rule, self.detail = str(path), location, rule, detail


class _Loader(yaml.SafeLoader):
    """Parses one event at a time and stops at the first construct that is not plain."""

    def __init__(self, stream: str):
        super().__init__(stream)
        self.depth = self.nodes = 0

    def refuse(self, why: str, mark: object) -> None:
        raise yaml.constructor.ConstructorError(None, None, why, mark)

    def compose_node(self, parent: Any, index: Any) -> Any:
        event = self.peek_event()
        mark = event.start_mark
        if isinstance(event, yaml.AliasEvent):
            self.refuse("aliases are not allowed", mark)
        if getattr(event, "anchor", None):
            self.refuse("anchors are not allowed", mark)
        if getattr(event, "tag", None) == "tag:yaml.org,2002:set":
            self.refuse("sets are not allowed", mark)
        self.nodes += 1
        if self.nodes > YAML_NODES:
            self.refuse(f"more than {YAML_NODES} nodes", mark)
        if len(getattr(event, "value", None) or "") > YAML_SCALAR:
            self.refuse(f"a scalar of more than {YAML_SCALAR} characters", mark)
        self.depth += 1
        if self.depth > YAML_DEPTH:
            self.refuse(f"nesting deeper than {YAML_DEPTH}", mark)
        try:
            return super().compose_node(parent, index)
        finally:
            self.depth -= 1

    def construct_mapping(self, node: Any, deep: bool = False) -> dict:
        out: dict = {}
        for key_node, value_node in node.value:
            if key_node.tag == "tag:yaml.org,2002:merge":
                self.refuse("merge keys are not allowed", key_node.start_mark)
            key = self.construct_object(key_node, deep=True)
            if not isinstance(key, Hashable):
                self.refuse("a key must be a scalar", key_node.start_mark)
            if key in out:
                self.refuse(f"duplicate key {key!r}", key_node.start_mark)
            out[key] = self.construct_object(value_node, deep=deep)
        return out


def _mapping(loader: _Loader, node: Any) -> dict:
    return loader.construct_mapping(node, deep=True)


_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)


def load_yaml(path: Path) -> dict[str, Any]:
    """The mapping that one strict YAML document holds."""
    if path.is_symlink() or not path.is_file():
        raise SpecError(path, "-", "non-regular-file", "not a regular file")
    try:
        raw = path.read_bytes()
    except OSError as why:
        raise SpecError(path, "-", "unreadable", str(why)) from why
    if len(raw) > YAML_BYTES:
        raise SpecError(path, "-", "yaml-byte-limit", f"more than {YAML_BYTES} bytes")
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as why:
        raise SpecError(path, "-", "invalid-utf8", str(why)) from why
    for n, line in enumerate(text.split("\n"), 1):
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise SpecError(path, f"line {n}", "tab-indentation", "indented by a tab")
    loader = _Loader(text)
    try:
        if not loader.check_data():
            raise SpecError(path, "-", "empty-file", "no document")
        value = loader.get_data()
        if loader.check_data():
            raise SpecError(path, "-", "multiple-documents", "more than one document")
    except yaml.constructor.ConstructorError as why:
        raise SpecError(path, str(why.problem_mark or "-"), "strict-yaml", str(why.problem)) from why
    except (yaml.YAMLError, RecursionError, ValueError) as why:
        if isinstance(why, SpecError):
            raise
        raise SpecError(path, "-", "malformed-yaml", str(why)) from why
    finally:
        loader.dispose()
    if value is None:
        raise SpecError(path, "-", "empty-file", "no content")
    if not isinstance(value, dict):
        raise SpecError(path, "-", "non-mapping-root", f"the root is a {type(value).__name__}")
    return value


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) < len(pairs):
        seen: set[str] = set()
        raise ValueError(f"duplicate key {next(k for k, _ in pairs if k in seen or seen.add(k))!r}")
    return out


def loads_json(text: str, where: str) -> Any:
    """JSON without duplicate keys, and not nested beyond what can be read."""
    try:
        return json.loads(text, object_pairs_hook=_unique)
    except RecursionError:
        raise ValueError(f"{where}: nested too deeply") from None
    except ValueError as why:
        raise ValueError(f"{where}: {why}") from None
