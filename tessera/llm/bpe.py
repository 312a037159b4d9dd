"""Operator 9: BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The most frequent words of the corpus (counted over all documents; LEXICON_WORDS of them and LEXICON_BYTES bytes at most) are encoded once by exact
merging and compiled into an acyclic automaton whose equal suffixes are shared. Each transition carries the number of words that sort before those
it leads to, so the sum along a path is a word's number, the transducer's output; a table maps it to the word's ids. The
whole is one file of flat arrays, which each Python worker writes once, without a name, and memory-maps. A word that the
automaton does not accept is merged exactly: lowest rank first, leftmost of equal ranks, on a heap, so that a word of any
length takes n log n steps. The result never depends on what the lexicon holds.

A text is cut at single spaces and newlines whose neighbours are no white space; there the pre-tokenizer always cuts.
Tables are encoded many texts at a time: each different piece between cuts is pre-tokenized once, its words are looked up and merged together in
arrays, and the ids are put together by the pieces' numbers. A text alone, and one in which white space adjoins, is encoded
piece by piece, with a bounded memory of pieces seen by this worker.

Nulls: a null text encodes as the empty one: no ids. A text that spells a special token gets its id, as in the library.
Empty table: empty result. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .worker import held, tidy

#: How byte-level BPE cuts a text before merging: a fixed value of this tokenizer family.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of which all Unicode versions in use agree whether they are letters, numbers or spaces. A text with any
#: other is pre-tokenized by the tokenizers library itself.
_SETTLED = re.compile("[^\x00-\u0557\u2000-\u206f\u20a0-\u20bf\u2190-\u21ff\u3000-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]")
#: White space as \s in PRETOKEN means it.
_ADJACENT = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2}")
#: Pieces that a worker remembers in a generation.
MEMORY = 350_000
#: Words of a lexicon, their bytes, and characters of one at most.
LEXICON_WORDS, LEXICON_BYTES, LONGEST = 1 << 17, 1 << 21, 64
#: Bytes of text that a task counts before it hands its counts on.
HELD_TEXT = 1 << 26
#: Bytes of text that are cut and encoded together (a longer text alone), words that are merged together, and bytes of a word merged so at most.
TOGETHER, MERGED, SHORT = 1 << 23, 1 << 14, 64
#: Bytes that are looked up at once at the beginning of a word.
LEAD = 4
_NO_PAIR = 1 << 62
#: Marks that are pre-tokens of their own behind letters.
_STOPS = frozenset(".,;:!?")
_STOP_BYTES = np.array([ord(c) for c in _STOPS], np.uint8)
#: Letters behind a space or not, and a stop or none: for Arrow.
_SIMPLE = r"\A ?\pL+[.,;:!?]?\z"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 stands for itself, the rest for 256 and on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins in the bytes of all, with the end of the last; and these bytes. Nulls are empty."""
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    _, begins, data = texts.buffers()
    offsets = np.frombuffer(begins, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return offsets - offsets[0], np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]


def groups(texts: pa.Array, room: int = TOGETHER):
    """The texts in runs of ``room`` bytes at most; a longer text alone."""
    offsets, a = flat(texts)[0], 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + room, "right")) - 1)
        yield texts.slice(a, b - a)
        a = b


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts cut before each space, before and behind each newline; and the number of pieces before each text, with that of all."""
    offsets, data = flat(texts)
    begins = np.zeros(len(data) + 1, bool)
    lines = data == 10
    begins[:-1] = lines | (data == 32)
    begins[1:] |= lines
    begins[offsets] = True
    at = np.flatnonzero(begins)
    pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
    return pieces, np.searchsorted(at, offsets)


def lists_of_ids(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An array of lists of ids, as little-endian bytes, so many in each."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets * 4), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def bytes_of(lists: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Where each value of a new large binary array begins in its bytes, with the end of the last; and these bytes."""
    _, begins, data = lists.buffers()
    return np.frombuffer(begins, np.int64)[: len(lists) + 1] if len(lists) else np.zeros(1, np.int64), data or pa.py_buffer(b"")


class Merges:
    """The vocabulary and merge table of a byte-level BPE file (its JSON text)."""

    def __init__(self, spec: bytes):
        data = json.loads(spec)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token_bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in vocab.items():
            self.token_bytes[i] = as_bytes(text)
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        of_byte = {self.token_bytes[i]: i for i in vocab.values() if len(self.token_bytes[i]) == 1}
        self.first = [of_byte.get(bytes([b]), -1) for b in range(256)]
        ids = {as_bytes(t): i for t, i in vocab.items()}
        # A pair as a << 20 | b; its rank and the merged id as rank << 20 | id.
        self.rank: dict[int, int] = {}
        for r, pair in enumerate(data["model"]["merges"]):
            a, b = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank.setdefault(ids[a] << 20 | ids[b], r << 20 | ids[a + b])
        # The same in arrays, for many words at once; and for pairs of bytes in a table.
        order = sorted(self.rank)
        self.pairs = np.array([*order, _NO_PAIR], np.int64)
        self.ranks = np.array([*map(self.rank.get, order), _NO_PAIR], np.int64)
        self.firsts = np.array(self.first, np.int64)
        self.starts = self.ranked(self.firsts[:, None] << 20 | self.firsts)

    def word(self, word: bytes) -> list[int]:
        """Ids of one pre-token, by merging."""
        ids = [self.first[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        rank = self.rank.get
        if n <= 64:  # short words: the least of the neighbours' ranks, again and again
            pairs = [rank(a << 20 | b, _NO_PAIR) for a, b in zip(ids, ids[1:], strict=False)]
            while pairs:
                best = min(pairs)
                if best == _NO_PAIR:
                    break
                i = pairs.index(best)
                ids[i] = new = best & 0xFFFFF
                del pairs[i], ids[i + 1]
                if i:
                    pairs[i - 1] = rank(ids[i - 1] << 20 | new, _NO_PAIR)
                if i < len(pairs):
                    pairs[i] = rank(new << 20 | ids[i + 1], _NO_PAIR)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r >> 20, i, ids[i], ids[i + 1], r & 0xFFFFF) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -2
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(new << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r >> 20, i, new, ids[k], r & 0xFFFFF))
            if (h := before[i]) >= 0 and (r := rank(ids[h] << 20 | new)) is not None:
                heapq.heappush(heap, (r >> 20, h, ids[h], new, r & 0xFFFFF))
        return [x for x in ids if x != -2]

    def ranked(self, pairs: np.ndarray) -> np.ndarray:
        """Rank and merged id of each pair, _NO_PAIR if it is not merged."""
        at = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[at] == pairs, self.ranks[at], _NO_PAIR)

    def words(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """Ids of many pre-tokens, each so many bytes of data from where it begins, by merging: as word() has them."""
        order = np.argsort(lengths, kind="stable")
        short, done, counts = int(np.searchsorted(lengths[order], SHORT, "right")), [], []
        for k in range(0, short, MERGED):
            some = order[k : min(k + MERGED, short)]
            ids, n = self._together(data, begins[some], lengths[some])
            done.append(ids)
            counts.append(n)
        for k in order[short:].tolist():
            ids = self.word(data[begins[k] : begins[k] + lengths[k]].tobytes())
            done.append(np.array(ids, np.int64))
            counts.append(np.array([len(ids)]))
        if not done:
            return lists_of_ids(np.zeros(0), np.zeros(0, np.int64))
        merged = lists_of_ids(np.concatenate(done), np.concatenate(counts))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return merged.take(pa.array(place))

    def _together(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A column for each word, a row for each place in it. In a step each word merges its leftmost pair of the least rank."""
        width, n = int(lengths.max(initial=0)), len(lengths)
        if not width:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        places, every = np.arange(width)[:, None], np.arange(n)
        stands = places < lengths
        letters = data[np.where(stands, begins + places, begins[-1])]
        ids = self.firsts[letters]
        if (ids[stands] < 0).any():
            raise OverflowError("the vocabulary lacks a byte")
        # The rank, merged id and place of the pair that begins at a place; the places behind and before it.
        pairs = np.full((width, n), _NO_PAIR)
        here = self.starts[letters[:-1], letters[1:]]
        pairs[:-1] = np.where(stands[1:] & (here != _NO_PAIR), here << 8 | places[:-1], _NO_PAIR)
        after, before = np.repeat(places + 1, n, 1), np.repeat(places - 1, n, 1)

        def pair(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
            found = self.ranked(left << 20 | right)
            return np.where(found == _NO_PAIR, _NO_PAIR, found << 8 | at)

        while True:
            best = pairs.min(0)
            w = every[best != _NO_PAIR]
            if not len(w):
                break
            best = best[w]
            i, new = best & 0xFF, best >> 8 & 0xFFFFF
            j = after[i, w]
            k = after[j, w]
            ids[i, w], after[i, w] = new, k
            stands[j, w], pairs[j, w], pairs[i, w] = False, _NO_PAIR, _NO_PAIR
            more = k < lengths[w]
            a, b, c = i[more], k[more], w[more]
            before[b, c] = a
            pairs[a, c] = pair(new[more], ids[b, c], a)
            h = before[i, w]
            more = h >= 0
            a, c = h[more], w[more]
            pairs[a, c] = pair(ids[a, c], new[more], a)
        return ids.T[stands.T], stands.sum(0)


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """Words with their ids as a minimal acyclic transducer in flat little-endian arrays.

    The words' prefix tree is laid out in arrays, a level of letters at a time. Nodes that are equally high and have the same ends, letters and
    targets are one state: so from the leaves up, equal suffixes become shared states. Memory is a few dozen bytes for each byte of the words.
    """
    order = sorted(w for w in words if w)
    label, parent, ends, depth_of = bytearray([0]), array("i", [-1]), bytearray([0]), array("H", [0])
    path, last = [0], b""  # nodes along the last word; nodes are numbered so that a parent's children ascend by letter
    for w in order:
        common = len(os.path.commonprefix([w, last]))
        del path[common + 1 :]
        for byte in w[common:]:
            label.append(byte)
            parent.append(path[-1])
            ends.append(0)
            depth_of.append(len(path))
            path.append(len(label) - 1)
        ends[path[-1]] = 1
        last = w
    label, parent, ends, depth_of = (np.frombuffer(x, t) for x, t in ((label, np.uint8), (parent, np.int32), (ends, np.uint8), (depth_of, np.uint16)))
    n = len(label)
    by_depth = np.argsort(depth_of, kind="stable")
    levels = np.split(by_depth, np.cumsum(np.bincount(depth_of))[:-1])
    height, seen = np.zeros(n, np.int32), ends.astype(np.int64)  # the longest way down, and the words accepted from here
    for nodes in reversed(levels[1:]):
        np.maximum.at(height, parent[nodes], height[nodes] + 1)
        np.add.at(seen, parent[nodes], seen[nodes])
    child = np.argsort(parent[1:], kind="stable").astype(np.int32) + 1
    begin = np.searchsorted(parent[child], np.arange(n + 1)).astype(np.int64)

    state, first, targets, skips, labels, accepts = np.zeros(n, np.int32), [0], array("I"), array("I"), bytearray(), bytearray()
    up = np.argsort(height, kind="stable")
    for nodes in np.split(up, np.cumsum(np.bincount(height))[:-1]):
        # Equal states are equally high. Those with one letter are compared in bulk.
        single = nodes[begin[nodes + 1] - begin[nodes] == 1]
        below = child[begin[single]]
        keys, where, number = np.unique(ends[single].astype(np.int64) << 40 | label[below].astype(np.int64) << 32 | state[below], return_index=True, return_inverse=True)
        state[single] = len(accepts) + number
        accepts += ends[single[where]].tobytes()
        labels += label[below[where]].tobytes()
        targets.frombytes(state[below[where]].astype(np.uint32).tobytes())
        skips.extend(ends[single[where]].tolist())
        first.extend(range(first[-1] + 1, first[-1] + 1 + len(keys)))
        register: dict[bytes, int] = {}
        for node in nodes[begin[nodes + 1] - begin[nodes] != 1].tolist():
            below = child[begin[node] : begin[node + 1]]
            key = bytes([ends[node]]) + label[below].tobytes() + state[below].tobytes()
            at = register.get(key)
            if at is None:
                at = register[key] = len(accepts)
                accepts.append(ends[node])
                labels += label[below].tobytes()
                targets.frombytes(state[below].astype(np.uint32).tobytes())
                skips.frombytes((ends[node] + np.cumsum(seen[below]) - seen[below]).astype(np.uint32).tobytes())
                first.append(len(labels))
            state[node] = at
    offsets, ids = array("I", [0]), array("I")
    for w in order:
        ids.extend(words[w])
        offsets.append(len(ids))
    parts = [x.tobytes() for x in (array("I", first), targets, skips, offsets, ids)] + [bytes(accepts), bytes(labels)]
    return struct.pack("<8I", int(state[0]), *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A compiled lexicon in a memory-mapped file."""

    def __init__(self, blob: bytes):
        # The file loses its name at once: the mapping keeps it, and nothing is left behind on the executor.
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        (self.start, *sizes), at, views = struct.unpack_from("<8I", self.map), 32, []
        for n in sizes:
            views.append((at, at + n))
            at += n
        whole = memoryview(self.map)
        self.first, self.targets, self.skips, self.offsets, self.ids = (whole[a:b].cast("I") for a, b in views[:5])
        self.ends, (self.labels_at, _) = whole[slice(*views[5])], views[6]

        self.leads = self._leads(LEAD)
        # A state and a letter as state << 8 | letter: ascending, as states are laid out in order and their letters ascend.
        first = np.asarray(self.first).astype(np.int64)
        self.edges = np.append(np.repeat(np.arange(len(first) - 1) << 8, np.diff(first)) | np.frombuffer(self.map, np.uint8, first[-1], self.labels_at), _NO_PAIR)
        offsets = np.asarray(self.offsets)
        self.lists = lists_of_ids(np.asarray(self.ids), np.diff(offsets))

    def _leads(self, length: int) -> dict[bytes, tuple[int, int]]:
        """State and number behind each beginning of ``length`` bytes: where to start for longer words."""
        reached = {b"": (self.start, 0)}
        for _ in range(length):
            longer = {}
            for prefix, (state, number) in reached.items():
                for e in range(self.first[state], self.first[state + 1]):
                    at = self.labels_at + e
                    longer[prefix + self.map[at : at + 1]] = self.targets[e], number + self.skips[e]
            reached = longer
        return reached

    def find(self, word: bytes) -> bytes | None:
        """The ids of a word of the lexicon as little-endian 32-bit integers."""
        at, find, length = self.labels_at, self.map.find, len(word)
        first, targets, skips = self.first, self.targets, self.skips
        state, number, i = self.start, 0, 0
        if length > LEAD:
            lead = self.leads.get(word[:LEAD])
            if lead is None:
                return None
            state, number = lead
            i = LEAD
        while i < length:
            e = find(word[i : i + 1], at + first[state], at + first[state + 1]) - at
            if e < 0:
                return None
            number += skips[e]
            state = targets[e]
            i += 1
        if not self.ends[state]:
            return None
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tobytes()

    def numbers(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The numbers of many words, each so many bytes of data from where it begins; -1 for those that are not in the lexicon."""
        found, ends = np.full(len(lengths), -1), np.asarray(self.ends)
        targets, skips = np.asarray(self.targets), np.asarray(self.skips)
        w = np.arange(len(lengths))
        state, number, i = np.full(len(w), self.start), np.zeros(len(w), np.int64), 0
        while len(w):
            over = lengths[w] == i
            accepted = over & (ends[state] != 0)
            found[w[accepted]] = number[accepted]
            w, state, number = w[~over], state[~over], number[~over]
            edge = state << 8 | data[begins[w] + i]
            e = np.searchsorted(self.edges, edge)
            goes = self.edges[e] == edge
            w, e = w[goes], e[goes]
            state, number, i = targets[e].astype(np.int64), number[goes] + skips[e], i + 1
        return found


class Codec:
    """Encodes whole texts to ids (as little-endian bytes) and back."""

    def __init__(self, spec: bytes, lexicon: bytes | None = None):
        import regex

        self.merges = Merges(spec)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.pretokens = regex.compile(PRETOKEN).findall
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) + ")") if self.merges.special else None
        # Pieces between white space, as they stand at the start of a line and behind a space; and words of other texts.
        self.plain, self.spaced, self.words = _Memory(self._at_start), _Memory(self._behind_space), _Memory(self._word, MEMORY // 10)
        self.newline = self._piece("\n")
        self._spec, self._library = spec, None
        self.tokens = pa.array(self.merges.token_bytes, pa.large_binary())

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        if self.lexicon and (found := self.lexicon.find(raw)) is not None:
            return found
        return array("I", self.merges.word(raw)).tobytes()

    def _piece(self, piece: str) -> bytes:
        return b"".join([self.words[w] for w in self.pretokens(piece)])

    def _at_start(self, piece: str) -> bytes:
        return self._word(piece) if piece.isalpha() else self._piece(piece)

    def _behind_space(self, piece: str) -> bytes:
        if piece.isalpha():
            return self._word(" " + piece)
        if piece[-1:] in _STOPS and piece[:-1].isalpha():
            return self.spaced[piece[:-1]] + self.plain[piece[-1]]
        return self._piece(" " + piece)

    def _cut_by_library(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._spec.decode()).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _ordinary(self, text: str) -> bytes:
        if _SETTLED.search(text):
            return b"".join([self.words[w] for w in self._cut_by_library(text)])
        if _ADJACENT.search(text):
            return self._piece(text)
        plain, behind, out = self.plain, self.spaced.__getitem__, []
        for line in text.split("\n"):
            pieces = line.split(" ")
            out.append(plain[pieces[0]])
            out.extend(map(behind, pieces[1:]))
            out.append(self.newline)
        return b"".join(out[:-1])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special is None or not self.special.search(text):
            return self._ordinary(text)
        parts = self.special.split(text)
        return b"".join(array("I", [self.merges.special[p]]).tobytes() if k % 2 else self._ordinary(p) for k, p in enumerate(parts))

    def token_bytes(self, ids: bytes) -> list[bytes]:
        known = self.merges.token_bytes
        return [known[i] for i in array("I", ids)]

    def raw(self, ids: bytes | np.ndarray) -> bytes:
        """The bytes of all tokens, gathered at once."""
        i = np.frombuffer(ids, np.uint32)
        if not len(i):
            return b""
        offsets, data = bytes_of(self.tokens.take(pa.array(i)))
        return data.slice(0, int(offsets[-1])).to_pybytes()

    def decode(self, ids: bytes) -> str:
        return self.raw(ids).decode("utf-8", "replace")


    def odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts are not to be cut at spaces and newlines: those with special tokens, characters that are not settled, or white space that adjoins."""
        offsets, data = flat(texts)
        found = np.zeros(len(texts), bool)
        text_of = lambda at: np.searchsorted(offsets, at, "right") - 1
        space = (data == 32) | ((data >= 9) & (data <= 13))
        at = np.flatnonzero(space[:-1] & space[1:])
        a = text_of(at)
        found[a[a == text_of(at + 1)]] = True
        for token in self.merges.special:
            found |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        # Characters from U+0540 on begin with 0xD5 or more; the white space below that is not ASCII, with 0xC2.
        look = data >= 0xD5
        look[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        for k in np.unique(text_of(np.flatnonzero(look))).tolist():
            if not found[k]:
                text = texts[k].as_py()
                found[k] = bool(_SETTLED.search(text) or _ADJACENT.search(text))
        return found

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of many texts: as encode() has them."""
        odd = self.odd(texts)
        pieces, first = pieces_of(texts.filter(pa.array(~odd)))
        coded = pieces.dictionary_encode()
        offsets, data = bytes_of(self._pieces(coded.dictionary).take(coded.indices))
        ids, ends, out, k = np.frombuffer(data, np.uint32, int(offsets[-1]) // 4), (offsets[first] // 4).tolist(), [], 0
        for at, is_odd in enumerate(odd.tolist()):
            if is_odd:
                out.append(np.frombuffer(self.encode(texts[at].as_py()), np.uint32))
            else:
                out.append(ids[ends[k] : ends[k + 1]])
                k += 1
        return out

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        words, counts = cut_pieces(pieces, self.pretokens)
        coded = words.dictionary_encode()
        offsets, data = bytes_of(self._words(coded.dictionary).take(coded.indices))
        ends = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets[ends]), data])

    def _words(self, words: pa.Array) -> pa.Array:
        offsets, data = flat(words)
        begins, lengths = offsets[:-1], np.diff(offsets)
        if not self.lexicon:
            return self.merges.words(data, begins, lengths)
        number = self.lexicon.numbers(data, begins, lengths)
        rest = np.flatnonzero(number < 0)
        number[rest] = len(self.lexicon.lists) + np.arange(len(rest))
        return pa.concat_arrays([self.lexicon.lists, self.merges.words(data, begins[rest], lengths[rest])]).take(pa.array(number))


def cut_pieces(pieces: pa.Array, pretokens) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of all pieces (none empty), and how many each piece has. Letters alone, or letters and a stop, need no pattern."""
    offsets, data = flat(pieces)
    simple = pc.match_substring_regex(pieces, _SIMPLE).to_numpy(zero_copy_only=False)
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    last = offsets[1:] - 1
    begins[last[simple & np.isin(data[last], _STOP_BYTES)]] = True
    rest = np.flatnonzero(~simple)
    for at, piece in zip(offsets[rest].tolist(), pieces.take(pa.array(rest)).to_pylist(), strict=True):
        for word in pretokens(piece):  # together they are the piece
            begins[at] = True
            at += len(word) if word.isascii() else len(word.encode("utf-8"))
    at = np.flatnonzero(begins)
    words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
    return words, np.diff(np.searchsorted(at, offsets))


def codec_of(sent, make) -> Codec:
    """This worker's codec for a broadcast: what it remembers serves all tasks that the worker runs."""
    return held("codec", sent.value, lambda: make(sent.value))


class _Memory(dict):
    """Results by argument, of two generations: when the young one is full it replaces the old one, and what is used again moves over."""

    def __init__(self, make, size: int = MEMORY):
        super().__init__()
        self.make, self.size, self.old, self.chars = make, size, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 200:
            self.chars += len(key)
            if len(self) >= self.size or self.chars > 8_000_000:
                self.old = dict(self)
                self.clear()
                self.chars = 0
            self[key] = value
        return value


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each pre-token of up to LONGEST characters stands in all texts. Counts are exact.

    A task hands its counts on whenever it holds many pieces or has read much text.
    """

    def count(batches):
        import regex

        pretokens, held, rows, read = regex.compile(PRETOKEN).findall, [], 0, 0

        def total(parts):
            return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def words():
            pieces = total(held)
            found, counts = cut_pieces(pieces["word"].combine_chunks(), pretokens)
            each = pa.table({"word": found, "n": np.repeat(pieces["n"].to_numpy(), counts)}).filter(pc.less_equal(pc.utf8_length(found), LONGEST))
            return total([each]).cast(pa.schema({"word": pa.string(), "n": pa.int64()})).combine_chunks().to_batches()

        for b in batches:
            for texts in groups(b.column(0)):
                coded = pieces_of(texts)[0].dictionary_encode()
                part = pa.table({"word": coded.dictionary, "n": np.bincount(coded.indices, minlength=len(coded.dictionary))})
                held.append(part.filter(pc.not_equal(part["word"], "\n")))
                rows, read = rows + len(part), read + flat(texts)[0][-1]
                if rows >= 3 * MEMORY or read >= HELD_TEXT:
                    yield from words()
                    held, rows, read = [], 0, 0
        if held:
            yield from words()

    return docs.select("text").mapInArrow(tidy(count), "word string, n bigint").filter("length(word) > 0").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, size: int, room: int = LEXICON_BYTES) -> DataFrame:
    """(word): the most frequent pre-tokens over all texts, ties by hash: as many as make up ``size`` words and ``room`` bytes at most.

    The cut is found by histograms of 256 bins: of counts first, each narrowing the last bin that does not fit, then of hashes among words of that
    count. So no ranking is ever in one place, and the driver sees 256 rows a time.
    """
    counted = cut(word_counts(docs).select("word", "n", F.shiftrightunsigned(F.xxhash64("word"), 2).alias("h"), F.octet_length("word").cast("long").alias("bytes")))

    def narrow(rows: DataFrame, value: Column, top: int, words: int, left: int) -> tuple[int, int, int]:
        """The least bound so that all rows with a greater value fit; and the words and bytes still free beside them."""
        low, high = 0, top + 1  # what is at or above ``high`` fits; bins are half-open
        while high > low:
            width = max(1, -(-(high - low) // 256))
            bins = rows.filter((value >= low) & (value < high)).groupBy(F.floor((value - low) / width).cast("long").alias("bin"))
            for r in sorted(bins.agg(F.count(F.lit(1)).alias("words"), F.sum("bytes").alias("bytes")).collect(), key=lambda r: -r.bin):
                if r["words"] > words or r["bytes"] > left:
                    low, high = low + r.bin * width, min(high, low + (r.bin + 1) * width)
                    break
                words, left = words - r["words"], left - r["bytes"]
            else:
                return low, words, left
            if width == 1:
                return high, words, left
        return high, words, left

    most = counted.agg(F.max("n")).first()[0]
    if most is None:
        return counted.select("word")
    least, words, left = narrow(counted, F.col("n"), most, size, room)
    tied = counted.filter(F.col("n") == least - 1)
    bound, _, _ = narrow(tied, F.col("h"), (1 << 62) - 1, words, left)
    return counted.filter((F.col("n") >= least) | ((F.col("n") == least - 1) & (F.col("h") >= bound))).select("word")


def build_lexicon(docs: DataFrame, spec: bytes, size: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon, made by one task from ``size`` words and LEXICON_BYTES bytes of them at most; the driver gets the file only."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def make(batches):
        merges, words = Merges(sent.value), {}
        for b in batches:
            offsets, data = flat(b.column(0))
            ids = merges.words(data, offsets[:-1], np.diff(offsets)).to_pylist()
            words.update(zip(map(str.encode, b.column(0).to_pylist()), (np.frombuffer(x, np.uint32).tolist() for x in ids), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([compile_lexicon(words)], pa.binary())], ["lexicon"])

    made = frequent_words(docs, size).coalesce(1).mapInArrow(tidy(make), "lexicon binary").collect()
    sent.unpersist()
    return bytes(made[0].lexicon) if made else compile_lexicon({})


def read_spec(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer: str, lexicon_words: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs (doc_id, text); with_ids adds ids binary and decoded string."""
    spec = read_spec(tokenizer)
    sent = docs.sparkSession.sparkContext.broadcast((spec, build_lexicon(docs, spec, lexicon_words)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec = codec_of(sent, lambda v: Codec(*v))
        for b in batches:
            n, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for ids in (x for texts in groups(b.column(1)) for x in codec.encode_all(texts)):
                raw = codec.raw(ids)
                text = raw.decode("utf-8", "replace")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(text.encode("utf-8") if "\ufffd" in text else raw).hexdigest())
                if with_ids:
                    all_ids.append(ids.tobytes())
                    all_text.append(text)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(all_ids, pa.binary()), pa.array(all_text, pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
