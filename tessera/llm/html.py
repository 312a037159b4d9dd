"""Operator 6: main text of web pages by a maximum-scoring subsequence.

A page is cut into tags and runs of text. Words score by weights learned from labelled pages, tags score below zero. The weight of a word is
2p - 1, where the log-odds of p (that it is content) are the sum of

- its context: the log-odds of the element around it, by its class, id and role tokens as a whole, else by their first and last parts, else by its name.
  What stands in an element below zero stays there, unless only parts of a token speak against it and an inner element is known as content;
- its text: the kind of block, whether it is a link, and how many words its block has.

Inner scans come first: an element in a context below zero that scores below zero as a whole is cut, but for a region in it that scores above.
Then one linear scan over what is left finds the contiguous region with the greatest sum; ties go to the earlier start and the longer region.
Its text is joined block by block; nothing else decides what is content.

Labelled pages are those that mark their content: exactly one ``article``, or else exactly one ``main``. Weights come from a hash sample of about
``sample`` pages, from features seen on ``least_pages`` of them or more, ``most_features`` at most. They add to the counts of SEEDS, which stand for labelled
pages of other sites: so marks that the table's labelled pages do not show have a weight too, and those they do show are learned anew.

Character references are decoded; white space (no-break spaces too) becomes single spaces within a block, where a line break
counts as white space; blocks are trimmed, empty ones dropped, and the rest joined by newlines.

Nulls: a null or empty page gives an empty text. Unclosed tags close with their parent; an unclosed comment, script or style runs to the end. A page
without tags is one block. Very long and deeply nested pages take time in proportion. Empty table: empty result. Repeated rows give repeated
results. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .worker import tidy

#: Elements whose text is never shown as content, with all that they hold.
SILENT = frozenset("head script style noscript template textarea select button iframe object svg canvas audio video map datalist title".split())
#: Elements whose names are features.
NAMED = frozenset("main article header nav footer aside form menu dialog".split())
#: Elements that frame others.
FRAMES = NAMED | frozenset("section div figure details table ul ol dl blockquote fieldset center".split())
#: Elements that begin and end a block of text.
BLOCKS = FRAMES | frozenset("html body p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption figcaption pre hr address summary legend hgroup option".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that close an open one of the same kind beside them.
PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Prior counts (inside content, outside), as of elements on labelled pages of other sites.
SEEDS: dict[str, tuple[int, int]] = {}
for _names, _counts in (
    ("nav footer aside form menu dialog header [hidden]", (0, 60)),
    ("article main header-in-article", (20, 0)),
):
    SEEDS |= {f"<{n}>": _counts for n in _names.split()}
for _tokens, _whole, _part in (
    ("ad ads advert advertisement adverts sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup login nav navbar navigation menu "
     "breadcrumb breadcrumbs sidebar footer comment comments reply replies disqus respond recommended recommendations pagination pager complementary contentinfo", (0, 60), (0, 30)),
    ("banner notice notices alert popup modal overlay aside header masthead discussion share sharing social related widget toolbar skip search", (0, 60), (0, 2)),
    ("content article post entry story main body text", (20, 0), (4, 0)),
):
    for _t in _tokens.split():
        SEEDS[f".{_t}"] = _whole
        SEEDS[f"{_t}-"] = SEEDS[f"-{_t}"] = _part
SEEDS |= {"kind p": (6, 0), "kind h": (2, 0), "link": (0, 6), "size 0": (0, 1), "size 2": (1, 0), "size 3": (3, 0)}

#: Log-odds of words of which nothing is known.
PRIOR = 0.75

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"\S+")


@dataclass
class Weights:
    """Log-odds of features of elements (<name>, .token, first-, -last) and texts (kind, link, size), and the scores of tags."""

    odds: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: dict[str, tuple[int, int]], smooth: float = 1.0) -> Weights:
        """From counts (inside content, outside) of features, added to the seeds."""
        out = cls()
        for f in sorted(SEEDS.keys() | counts.keys()):
            a, b = (x + y for x, y in zip(SEEDS.get(f, (0, 0)), counts.get(f, (0, 0)), strict=True))
            if f.startswith("tag "):
                out.tags[f[4:]] = -0.02 - 0.5 * (b + smooth) / (a + b + 2 * smooth)
            else:
                most = 2.0 if f[0] not in "<.-" and f[-1] != "-" else 5.0
                out.odds[f] = max(-most, min(most, log((a + smooth) / (b + smooth))))
        return out

    def element(self, features: tuple[list[str], list[str], str]) -> tuple[float | None, bool]:
        """(log-odds of an element or None if nothing of it is known, whether more than parts of tokens speak)."""
        whole, parts, name = features
        for some, firm in ((whole, True), (parts, False), ([name], True)):
            known = [x for f in some if f and (x := self.odds.get(f)) is not None and abs(x) > 0.5]
            if known:
                return (min(known) if min(known) < 0 and min(known) + max(known) <= 0 else max(known)), firm
        return None, False

    def text(self, kind: str, link: bool, size: int) -> float:
        odds = PRIOR + self.odds.get(f"kind {kind}", 0.0) + self.odds.get(f"size {size}", 0.0) + (self.odds.get("link", 0.0) if link else 0.0)
        return max(-2.5, min(2.5, odds))


def marks(attributes: str) -> tuple[list[str], list[str]]:
    """Features of an element's class, id and role: whole tokens (digits as #), and first and last parts of those that have several."""
    whole, parts = [], []
    for m in _MARKS.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            pieces = [p.lower() for p in _PARTS.findall(token)]
            whole.append("." + re.sub(r"\d+", "#", token.lower()))
            if len(pieces) > 1:
                parts += [f"{pieces[0]}-", f"-{pieces[-1]}"]
    return whole, parts


def _size(words: int) -> int:
    return 0 if words < 3 else 1 if words < 10 else 2 if words < 25 else 3


class Page:
    """A page's tags and runs of text in order, and the tree of elements that matter: blocks and those that carry marks.

    ``pieces`` has (tag, text, words, node, kind of block, whether in a link) and ``nodes`` has (parent, features, name); node 0 is the page.
    What silent elements hold is passed over.
    """

    def __init__(self, page: str):
        self.pieces: list[tuple[str, str, int, int, str, bool]] = []
        self.nodes: list[tuple[int, tuple[list[str], list[str], str], str]] = [(-1, ([], [], ""), "")]
        stack: list[tuple[str, int]] = [("", 0)]  # open elements: name, node
        open_: Counter = Counter()
        silent = ""

        def close(names: tuple[str, ...], within: frozenset = frozenset()) -> None:
            """Closes the innermost open element of these names with all in it, if no element of ``within`` is inside it."""
            if not any(open_[n] for n in names):
                return
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    for n, _ in stack[k:]:
                        open_[n] -= 1
                    del stack[k:]
                    return
                if stack[k][0] in within:
                    return

        for m in _TOKEN.finditer(page):
            slash, name, attributes = m[2], m[3], m[4]
            if name is None:
                raw = m[0]
                if m[1] or silent and not _NAME.match(raw):
                    continue
                if plain := _NAME.match(raw):  # a tag with an odd quote ends at the first >
                    if raw[-1] != ">":
                        continue  # cut off by the end of the page
                    slash, name, attributes = plain[1], plain[2], raw[plain.end() : -1]
                elif raw[0] == "<" and len(raw) > 1:
                    continue
            if name is None:
                text = entities.unescape(raw) if "&" in raw else raw
                kind = next((n for n, _ in reversed(stack) if n in BLOCKS), "") if len(stack) > 1 else ""
                kind = "h" if kind[:1] == "h" and kind[1:].isdigit() else kind
                self.pieces.append(("", text, len(_WORD.findall(text)), stack[-1][1], kind, open_["a"] > 0))
                continue
            name, closing = name.lower(), bool(slash)
            if silent:
                if closing and name == silent or name == "body":
                    silent = ""
                if silent or name != "body":
                    continue
            if name in SILENT:
                if not closing and not attributes.rstrip().endswith("/"):
                    silent = name
                continue
            if closing:
                self.pieces.append((name, "", 0, stack[-1][1], "", False))
                close((name,), FRAMES if name not in BLOCKS else frozenset())
                continue
            if name in PEERS:
                close(PEERS[name], FRAMES)
            elif name in BLOCKS:
                close(("p",), FRAMES)
            node = stack[-1][1]
            whole, parts = marks(attributes) if attributes and name not in ("html", "body") else ([], [])
            feature = "<[hidden]>" if attributes and _HIDDEN.search(attributes) else f"<{name}>" if name in NAMED else ""
            if name == "header" and (open_["article"] or open_["main"]):
                feature = "<header-in-article>"
            if name in BLOCKS or whole or feature:
                self.nodes.append((node, (whole, parts, feature), name))
                node = len(self.nodes) - 1
            self.pieces.append((name, "", 0, node, "", False))
            if name not in VOID and not attributes.rstrip().endswith("/"):
                stack.append((name, node))
                open_[name] += 1

    def block_words(self) -> list[int]:
        """For each piece the number of words in its block."""
        out, start, words = [0] * len(self.pieces), 0, 0
        for k, p in enumerate(self.pieces):
            if p[0] in BLOCKS:
                out[start:k] = [words] * (k - start)
                start, words = k, 0
            words += p[2]
        out[start:] = [words] * (len(out) - start)
        return out

    def contexts(self, weights: Weights) -> list[tuple[float, bool]]:
        """Log-odds of each node's context, and whether they are firm."""
        out: list[tuple[float, bool]] = [(0.0, False)]
        for parent, features, _ in self.nodes[1:]:
            around, (own, firm) = out[parent], weights.element(features)
            if own is None:
                out.append(around)
            elif around[0] < 0 and (around[1] or own < 0):
                out.append((min(around[0], own), around[1] or firm and own < around[0]))
            else:
                out.append((own, firm))
        return out

    def scores(self, weights: Weights) -> tuple[list[float], list[tuple[float, bool]]]:
        contexts, out = self.contexts(weights), []
        for (tag, _, words, node, kind, link), size in zip(self.pieces, self.block_words(), strict=True):
            if tag:
                out.append(weights.tags.get(tag, -0.1))
            elif words:
                odds = contexts[node][0] + weights.text(kind, link, _size(size))
                out.append(words * (2 / (1 + exp(-odds)) - 1))
            else:
                out.append(0.0)
        return out, contexts


def marked_element(page: str) -> str:
    """The element by which the page marks its content, if just one does."""
    low = page.lower()
    for name in ("article", "main"):
        if len(re.findall(rf"<{name}[\s>]", low)) == 1:
            return name
    return ""


def region(scores: list[float]) -> tuple[int, int]:
    """Half-open bounds of the maximum-scoring contiguous run, found in one pass; (0, 0) if no sum is above zero."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, k
        total += s
        if total > best or total == best and bounds[1] > bounds[0] and start == bounds[0]:
            best, bounds = total, (start, k + 1)
    return bounds


def cut_elements(page: Page, scores: list[float], contexts: list[tuple[float, bool]]) -> list[bool]:
    """For each piece whether an inner scan cuts it."""
    totals = [0.0] * len(page.nodes)
    for s, p in zip(scores, page.pieces, strict=True):
        totals[p[3]] += s
    for k in range(len(totals) - 1, 0, -1):
        totals[page.nodes[k][0]] += totals[k]
    top = [0] * len(totals)  # the outermost cut element around each node, or 0
    for k in range(1, len(totals)):
        parent = page.nodes[k][0]
        top[k] = top[parent] or (k if contexts[k][0] < 0 and totals[k] < 0 else 0)
    of: dict[int, list[int]] = {}
    for i, p in enumerate(page.pieces):
        if top[p[3]]:
            of.setdefault(top[p[3]], []).append(i)
    out = [False] * len(scores)
    for at in of.values():
        a, b = region([scores[i] for i in at])
        for j, i in enumerate(at):
            out[i] = not a <= j < b
    return out


def main_text(text: str | None, weights: Weights) -> str:
    if not text:
        return ""
    page = Page(text)
    scores, contexts = page.scores(weights)
    cut = cut_elements(page, scores, contexts)
    start, end = region([0.0 if c else s for s, c in zip(scores, cut, strict=True)])
    blocks, block = [], []
    for k in range(start, end):
        tag, run = page.pieces[k][:2]
        if tag in BLOCKS:
            blocks.append("".join(block))
            block = []
        elif tag == "br":
            block.append(" ")
        elif not tag and not cut[k]:
            block.append(run)
    blocks.append("".join(block))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def observed(text: str, weights: Weights) -> tuple[Counter, Counter]:
    """Of a labelled page: its features inside and outside what it marks. What stands in a context below zero is explained by that and says nothing."""
    inside, outside = Counter(), Counter()
    marked = marked_element(text) if text else ""
    if not marked:
        return inside, outside
    page = Page(text)
    at = next((k for k, n in enumerate(page.nodes) if n[2] == marked), None)
    if at is None:
        return inside, outside
    content, around = [False] * len(page.nodes), {at}
    for k in range(1, len(page.nodes)):
        content[k] = k == at or content[page.nodes[k][0]]
    while (parent := page.nodes[min(around)][0]) > 0:  # parents come before their children
        around.add(parent)
    contexts, sizes = page.contexts(weights), page.block_words()
    for k, (_, (whole, parts, name), _) in enumerate(page.nodes):
        if k and (k == at or k not in around) and contexts[page.nodes[k][0]][0] >= 0:
            if not content[k] or contexts[k][0] >= 0:  # boilerplate within what is marked is no evidence that it is content
                (inside if content[k] else outside).update({*whole, *parts, name} - {""})
    for (tag, _, words, node, kind, link), size in zip(page.pieces, sizes, strict=True):
        to = inside if content[node] and contexts[node][0] >= 0 else outside
        if tag and (tag in BLOCKS or tag in ("a", "b", "i", "em", "strong", "span", "br", "img")):
            to[f"tag {tag}"] += 1
        elif words and contexts[node][0] >= 0:
            to.update([f"kind {kind}", f"size {_size(size)}", *["link"] * link])
    return inside, outside


def fit(pages: DataFrame, sample: int = 20_000, least_pages: int = 3, most_features: int = 20_000) -> Weights:
    """Weights from about ``sample`` pages. What reaches the driver is one row for each of ``most_features`` features at most."""
    n = max(1, pages.count())
    draw = F.pmod(F.xxhash64("html", F.lit("weights")), F.lit(1 << 20)) / float(1 << 20)

    def count(batches):
        seeded = Weights.of({})
        inside, outside, seen = Counter(), Counter(), Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                a, z = observed(page or "", seeded)
                inside.update(a)
                outside.update(z)
                seen.update(a.keys() | z.keys())
        keys = sorted(seen)
        counts = [pa.array([c[k] for k in keys], pa.int64()) for c in (inside, outside, seen)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *counts], ["feature", "inside", "outside", "pages"])

    rows = pages.filter(draw < min(1.0, sample / n)).select("html").mapInArrow(tidy(count), "feature string, inside bigint, outside bigint, pages bigint")
    rows = rows.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("inside", "outside", "pages")]).filter(F.col("pages") >= least_pages)
    found = rows.orderBy(F.desc("pages"), "feature").limit(most_features).collect()
    return Weights.of({r.feature: (r.inside, r.outside) for r in found})


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py(), sent.value) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(tidy(run), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
