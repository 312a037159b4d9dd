"""Document templates: text with slots ``{kind:name}``, choices ``(a|b)`` and optional parts ``[?rate: text]``; ``{{`` and ``}}`` stand for braces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from ..functions.draws import MAX_PLACES

MAX_CHARS, MAX_DEPTH = 65_536, 64
SPECIAL = "special"
SLOTS = ("entity", "field", "id", "lex")


class TemplateError(ValueError):
    """A template is refused: which, at what character, by which rule."""

    def __init__(self, name: str, at: int, rule: str, detail: str):
        super().__init__(f"template {name!r} at {at}: {rule}: {detail}")
        self.name, self.at, self.rule = name, at, rule


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Slot:
    kind: str
    name: str


@dataclass(frozen=True)
class Choice:
    branches: tuple[tuple, ...]


@dataclass(frozen=True)
class Maybe:
    rate: str
    body: tuple


@dataclass
class Parser:
    """One pass over a template; the names that slots may use are given."""

    name: str
    source: str
    labels: frozenset[str]
    identifiers: frozenset[str]
    lexicons: frozenset[str] = frozenset()
    at: int = 0

    def fail(self, at: int, rule: str, detail: str) -> None:
        raise TemplateError(self.name, at, rule, detail)

    def parse(self) -> tuple:
        if len(self.source) > MAX_CHARS:
            self.fail(MAX_CHARS, "template-length-limit", f"longer than {MAX_CHARS} characters")
        nodes = self.run("", 0)
        if self.at < len(self.source):
            self.fail(self.at, "unexpected-close", f"nothing to close with {self.source[self.at]!r}")
        return nodes

    def run(self, stops: str, depth: int) -> tuple:
        if depth > MAX_DEPTH:
            self.fail(self.at, "template-nesting-limit", f"nested deeper than {MAX_DEPTH}")
        nodes: list = []
        for piece in self.pieces(stops, depth):
            if isinstance(piece, str) and nodes and isinstance(nodes[-1], Text):
                nodes[-1] = Text(nodes[-1].text + piece)
            else:
                nodes.append(Text(piece) if isinstance(piece, str) else piece)
        return tuple(nodes)

    def pieces(self, stops: str, depth: int) -> Iterator:
        openers = {"{": self.slot, "(": self.choice, "[": self.maybe}
        while self.at < len(self.source):
            c = self.source[self.at]
            if c in stops:
                return
            if self.source[self.at : self.at + 2] in ("{{", "}}"):
                self.at += 2
                yield c
            elif c in openers:
                yield openers[c](depth)
            elif c == "}":
                self.fail(self.at, "unbalanced-brace", "closes no slot")
            else:
                self.at += 1
                yield c

    def slot(self, depth: int) -> Slot:
        start, end = self.at, self.source.find("}", self.at)
        if end < 0:
            self.fail(start, "unbalanced-brace", "a slot without an end")
        kind, colon, name = (x.strip() for x in self.source[start + 1 : end].partition(":"))
        if not colon:
            self.fail(start, "malformed-slot", f"a slot is one of {', '.join(SLOTS)}, a colon and a name")
        if kind not in SLOTS:
            self.fail(start, "unknown-slot-kind", f"{kind!r} is none of {', '.join(SLOTS)}")
        if not name:
            self.fail(start, "empty-slot-argument", f"{kind} names nothing")
        known = {"entity": (self.labels, "unknown-label"), "id": (self.identifiers, "unknown-identifier"), "lex": (self.lexicons, "unknown-lexicon")}.get(kind)
        if known and name not in known[0] and (known[0] or kind != "lex"):
            self.fail(start, known[1], f"{name!r} is none of {', '.join(sorted(known[0]))}")
        self.at = end + 1
        return Slot(kind, name)

    def choice(self, depth: int) -> Choice:
        start, branches = self.at, []
        while True:
            self.at += 1
            branches.append(self.run("|)", depth + 1))
            if self.at >= len(self.source):
                self.fail(start, "unbalanced-paren", "a choice without an end")
            if self.source[self.at] == ")":
                break
        self.at += 1
        if len(branches) == 1:
            self.fail(start, "single-branch-alternation", "one branch is no choice")
        return Choice(tuple(branches))

    def maybe(self, depth: int) -> Maybe:
        start, colon = self.at, self.source.find(":", self.at)
        if self.source[start : start + 2] != "[?" or colon < 0:
            self.fail(start, "malformed-optional", "an optional part is [?rate: text]")
        rate = self.source[start + 2 : colon].strip()
        self.check_rate(start, rate)
        self.at = colon + 1
        body = self.run("]", depth + 1)
        if self.at >= len(self.source):
            self.fail(start, "unbalanced-bracket", "an optional part without an end")
        self.at += 1
        return Maybe(rate, body)

    def check_rate(self, at: int, rate: str) -> None:
        if rate == SPECIAL:
            return
        try:
            value = Decimal(rate)
        except InvalidOperation:
            value = None
        if value is None:
            self.fail(at, "malformed-probability", f"{rate!r} is no decimal")
        if not value.is_finite() or not 0 <= value <= 1:
            self.fail(at, "probability-out-of-range", f"{rate!r} is not from 0 to 1")
        if -value.as_tuple().exponent > MAX_PLACES:
            self.fail(at, "probability-precision-limit", f"{rate!r} has more than {MAX_PLACES} places")


def walk(nodes: tuple) -> Iterator:
    """Every node, those inside choices and optional parts too."""
    for n in nodes:
        yield n
        for inner in n.branches if isinstance(n, Choice) else (n.body,) if isinstance(n, Maybe) else ():
            yield from walk(inner)


def literals(nodes: tuple, limit: int = 10_000) -> list[str]:
    """All texts that a template can render, slots as a space; more than ``limit`` is an error."""
    out = [""]
    for n in nodes:
        if isinstance(n, Text):
            ends = [n.text]
        elif isinstance(n, Slot):
            ends = [" "]
        elif isinstance(n, Choice):
            ends = [x for b in n.branches for x in literals(b, limit)]
        else:
            ends = ["", *literals(n.body, limit)]
        if len(out) * len(ends) > limit:
            raise ValueError(f"more than {limit} texts")
        out = [a + b for a in out for b in ends]
    return out
