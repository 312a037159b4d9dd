"""Operator 4: token counts by offset-mapped attribution.

A document is encoded once, as a whole; each token then has a half-open span of characters in it. Sections are half-open
spans too, in order and without gaps. Spans are joined by binary search on their ends, and a token whose span
crosses a boundary is allocated by an explicit rule:

- ``first``: to the section that holds its first character;
- ``last``: to the section that holds its last character;
- ``most``: to the section that holds most of its bytes, the earlier one if several do.

So the counts of a document's sections always sum to its tokens. A character whose bytes are shared by several tokens
belongs to the span of each of them.

Nulls: a null text is one empty section without tokens; so is the empty text. A null field is an empty section. Empty table: empty
result. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Codec, codec_of, read_spec
from .worker import tidy

RULES = ("first", "last", "most")


def line_ends(text: str) -> list[int]:
    """Ends, in characters, of the sections of a text that are its lines; a newline belongs to the line that it ends."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


_SENTENCE_END = re.compile(r"[.!?]+[ \t]+|\n")


def sentence_ends(text: str) -> list[int]:
    """Ends, in characters, of the sentences of a text: behind a newline, or behind stops and the blanks that follow them."""
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


def token_ends(codec: Codec, text: str) -> np.ndarray:
    """Ends of the tokens of a text, in bytes of its UTF-8 form."""
    return np.cumsum([len(t) for t in codec.token_bytes(codec.encode(text))], dtype=np.int64)


def char_ends_in_bytes(text: str, ends: list[int]) -> np.ndarray:
    """Character offsets (ascending) as byte offsets."""
    if text.isascii():
        return np.array(ends, np.int64)
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    return starts[np.array(ends, np.int64)]


def char_spans(codec: Codec, text: str) -> list[tuple[int, int]]:
    """The span of each token in characters: from the character of its first byte to behind that of its last."""
    ends = token_ends(codec, text)
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
    starts = np.concatenate([[0], ends]).astype(np.int64)[: len(ends)]
    return list(zip(of_byte[starts].tolist(), (of_byte[ends - 1] + 1).tolist(), strict=True)) if len(ends) else []


def attribute(ends: np.ndarray, sections: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """For each token its section, and whether it crosses a boundary. Both arguments are ascending ends from 0, in bytes."""
    starts = np.concatenate([[0], ends]).astype(np.int64)[: len(ends)]
    first = np.searchsorted(sections, starts, side="right")
    last = np.searchsorted(sections, ends - 1, side="right")
    crosses = first != last
    if rule == "first":
        return first, crosses
    if rule == "last":
        return last, crosses
    if rule != "most":
        raise ValueError(f"unknown rule {rule!r}; one of {', '.join(RULES)}")
    chosen = first.copy()
    for t in np.flatnonzero(crosses).tolist():
        over = range(int(first[t]), int(last[t]) + 1)
        held = [min(int(ends[t]), int(sections[s])) - max(int(starts[t]), int(sections[s - 1]) if s else 0) for s in over]
        chosen[t] = over[held.index(max(held))]
    return chosen, crosses


def count_sections(docs: DataFrame, tokenizer: str, rule: str = "most", sections: Callable[[str], list[int]] = line_ends) -> DataFrame:
    """(doc_id, n_tokens, n_sections, n_crossing, section_tokens array) of every row of docs (doc_id, text)."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; one of {', '.join(RULES)}")
    sent = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec = codec_of(sent, Codec)
        for b in batches:
            rows = []
            for x in b.column(1):
                text = x.as_py() or ""
                bounds = char_ends_in_bytes(text, sections(text))
                chosen, crosses = attribute(token_ends(codec, text), bounds, rule)
                rows.append((len(chosen), len(bounds), int(crosses.sum()), np.bincount(chosen, minlength=len(bounds)).tolist()))
            n, k, c, each = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array(each, pa.list_(pa.int64()))],
                ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens bigint, n_sections bigint, n_crossing bigint, section_tokens array<bigint>")


def count_fields(rows: DataFrame, id_column: str, fields: list[str], tokenizer: str, joint: str = "\n", rule: str = "most") -> DataFrame:
    """Tokens of each field of a row, encoded as one text with ``joint`` after each field: (id, n_tokens, n_crossing, tokens struct of fields)."""
    from pyspark.sql import functions as F

    sent = rows.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches):
        codec = codec_of(sent, Codec)
        for b in batches:
            out = []
            for values in zip(*(b.column(i + 1).to_pylist() for i in range(len(fields))), strict=True):
                parts = [(v or "") + joint for v in values]
                bounds = np.cumsum([len(p.encode("utf-8")) for p in parts])
                chosen, crosses = attribute(token_ends(codec, "".join(parts)), bounds, rule)
                out.append({"n_tokens": len(chosen), "n_crossing": int(crosses.sum()), "each": np.bincount(chosen, minlength=len(fields)).tolist()})
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([o[k] for o in out], t) for k, t in (("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("each", pa.list_(pa.int64()))))],
                ["id", "n_tokens", "n_crossing", "each"],
            )

    found = rows.select(id_column, *[F.col(f).cast("string") for f in fields]).mapInArrow(tidy(run), f"id {kind}, n_tokens bigint, n_crossing bigint, each array<bigint>")
    tokens = F.struct(*[F.element_at("each", i + 1).alias(f) for i, f in enumerate(fields)])
    return found.select(F.col("id").alias(id_column), "n_tokens", "n_crossing", tokens.alias("tokens"))
