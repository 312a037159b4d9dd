"""Operator 8: SimHash near-duplicates through segment popcounts.

Fingerprint: bit i is set if it is set in over half the hashes (XXH64, seed 42) of a text's 3-word shingles, repeats
included. Two fingerprints link at ``distance`` or fewer differing bits.

A fingerprint is embedded as the vector of its 2-bit segments' popcounts (32 numbers from 0 to 2). A differing bit
changes one popcount by one, so the Manhattan distance of two vectors never exceeds the Hamming distance of their
fingerprints. The segments are cut into ``groups`` axes of the grid; vectors within Manhattan distance d differ in at most
d axes, so they fall into one cell of at least one of the grids that fix ``groups - d`` axes. Each distinct fingerprint goes once
into each of these grids (20 for d = 3 and 6 groups). Within a cell, rows are ordered by total popcount, pairs further
apart than d in it or in Manhattan distance are passed over, and the rest are compared bit by bit.

Equal fingerprints are one class from the start. A cell emits a spanning forest of its links, never all pairs, so a large
group of near copies costs rows in proportion to its size; components come from graph.components. No link is lost.

Nulls: a null text has no words, fingerprint 0, and links like any other. A null doc_id keeps its row; a component holds
the smallest doc_id that is not null. Repeated rows give repeated result rows. Empty table: empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, partitions_of
from .graph import components
from .worker import tidy

SHINGLE = 3
#: Popcount of a byte's four 2-bit segments, two bits each: 0, 1 or 2.
_PAIR_MASK = np.uint64(0x5555555555555555)
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    import xxhash

    words = _words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, stops, strict=True)]
    return _majority(np.array(hashes, dtype=np.uint64))


_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _words(text: str | None) -> list[bytes]:
    # bytes.split() without arguments cuts at exactly the six characters that are no part of words.
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()


def _majority(hashes: np.ndarray) -> int:
    lanes, out = hashes.view(np.uint8).reshape(-1, 8), 0
    for lane in range(8):
        set_bits = np.bincount(lanes[:, lane], minlength=256) @ _BITS_OF_BYTE
        for bit in np.flatnonzero(2 * set_bits > len(hashes)).tolist():
            out |= 1 << (8 * lane + bit)
    return out - (1 << 64) if out >> 63 else out


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row of docs."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(x.as_py(), shingle) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, fp bigint")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Popcounts of the 32 two-bit segments of each fingerprint, two bits apiece in one 64-bit word."""
    return (fps & _PAIR_MASK) + ((fps >> np.uint64(1)) & _PAIR_MASK)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed popcount vectors: 2-bit fields differ by 0, 1 or 2."""
    # per field |a-b|: 1 if the low bits differ, 2 if they are 0 and 2.
    low = (a ^ b) & _PAIR_MASK
    high = ((a ^ b) >> np.uint64(1)) & _PAIR_MASK & ~low
    return np.bitwise_count(low).astype(np.int16) + 2 * np.bitwise_count(high).astype(np.int16)


def grid_masks(groups: int, distance: int) -> list[int]:
    """One mask of packed segments for each choice of ``groups - distance`` axes."""
    axes = [0] * groups
    for seg in range(32):
        axes[seg % groups] |= 3 << (2 * seg)
    return [sum(axes[g] for g in kept) for kept in combinations(range(groups), groups - distance)]


def _pairs_of_runs(fps: np.ndarray, run: np.ndarray, distance: int):
    """Links within short runs: rows of one run at offsets 1, 2, ..."""
    vec, total = segment_counts(fps), np.bitwise_count(fps).astype(np.int16)
    step = 1
    while step < len(fps):
        same = np.flatnonzero(run[:-step] == run[step:])
        if not len(same):
            return
        near = same[np.abs(total[same] - total[same + step]) <= distance]
        near = near[manhattan(vec[near], vec[near + step]) <= distance]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= distance]
        if len(near):
            yield fps[near], fps[near + step]
        step += 1


def _forest(fps: np.ndarray, distance: int):
    """A spanning forest of the links within one long run: each row is reached once, from a row that links to it."""
    rest = fps[np.argsort(np.bitwise_count(fps), kind="stable")]
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            lo, hi = np.searchsorted(np.bitwise_count(rest), [max(0, int(np.bitwise_count(x)) - distance), int(np.bitwise_count(x)) + distance + 1])
            window = rest[lo:hi]
            close = manhattan(segment_counts(window), segment_counts(np.array([x], np.uint64))) <= distance
            close[close] = np.bitwise_count(window[close] ^ x) <= distance
            if close.any():
                found = window[close]
                yield np.full(len(found), x, np.uint64), found
                front.extend(found)
                keep = np.ones(len(rest), bool)
                keep[lo:hi] = ~close
                rest = rest[keep]


#: Runs up to this length are compared at all offsets; longer ones by their spanning forest; those of a crowded cell are cut up first.
SHORT_RUN, CROWDED = 24, 4096


def _cell_links(cells: np.ndarray, fps: np.ndarray, distance: int, bands: int = 0):
    """Links among the rows of each cell (rows of a cell stand together).

    A crowded cell is cut again: of distance + 1 equal bands of bits, two linked fingerprints share at least one, so links are sought among rows that
    agree in a band, band by band.
    """
    if not len(cells):
        return
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(cells)]]))
    run = np.repeat(np.arange(len(starts)), lengths)
    short = np.repeat((lengths > 1) & (lengths <= SHORT_RUN), lengths)
    if short.any():
        yield from _pairs_of_runs(fps[short], run[short], distance)
    for k in np.flatnonzero(lengths > SHORT_RUN).tolist():
        crowd = fps[starts[k] : starts[k] + lengths[k]]
        if len(crowd) <= CROWDED or bands >= 1:
            yield from _forest(crowd, distance)
            continue
        width = -(-64 // (distance + 1))
        for low in range(0, 64, width):
            mask = np.uint64(((1 << min(width, 64 - low)) - 1) << low)
            order = np.argsort(crowd & mask, kind="stable")
            yield from _cell_links((crowd & mask)[order], crowd[order], distance, bands + 1)


def links(classes: DataFrame, distance: int = 3, groups: int = 6) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp of ``classes``, already distinct), spanning every component."""
    masks = np.array(grid_masks(groups, distance), np.uint64)

    def spread(batches):
        import xxhash  # noqa: F401  (workers without it fail here, not in the middle)

        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fps):
                continue
            vec = segment_counts(fps)
            # The cell: the kept popcounts, mixed with the grid's number by an odd multiplier per grid.
            cell = np.concatenate([(vec & m) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(k * 0x1000193B) for k, m in enumerate(masks)])
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(np.tile(fps, len(masks)).view(np.int64))], ["cell", "fp"])

    def meet(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of a cell that may go on in the next batch

        def out(parts):
            cells, fps = (np.concatenate(c) for c in zip(*parts, strict=True))
            for a, b in _cell_links(cells, fps, distance):
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"])

        for b in batches:
            cells, fps = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(cells):
                continue
            end = int(np.searchsorted(cells, cells[-1]))  # rows are sorted by cell
            if end or held and held[0][0][0] != cells[0]:
                yield from out([*held, (cells[:end], fps[:end])])
                held = []
            held.append((cells[end:], fps[end:]))
        if held:
            yield from out(held)

    cells = classes.select("fp").mapInArrow(tidy(spread), "cell bigint, fp bigint")
    dealt = cells.repartition(partitions_of(classes.sparkSession), "cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(tidy(meet), "a bigint, b bigint")


def _rooted(classes: DataFrame, distance: int, groups: int) -> DataFrame:
    """Every class with its root; classes without links are their own."""
    roots = components(links(classes, distance, groups))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, distance: int = 3, groups: int = 6) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text)."""
    fps = cut(with_fingerprints(docs))
    rooted = _rooted(cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"))), distance, groups)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = cut(rooted.join(least, "root").select("fp", "component_id"))
    return fps.join(of_class, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_first(docs: DataFrame, distance: int = 3, groups: int = 6) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id, and of the smallest digest among rows that share it.

    Groups are of texts: rows of one doc_id but unrelated texts are of different groups and stay, and rows without a doc_id, which come last, are grouped
    like others. Of rows equal in doc_id and text one stays.
    """
    # One key for the doc_id and the text: the rows are moved by it once, to be picked and to drop repeats.
    named = F.concat_ws("|", F.col("doc_id").isNull().cast("int"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    key = F.sha2(named.cast("binary"), 256)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = [fingerprint(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

    rows = docs.select("doc_id", "text", key.alias("key")).mapInArrow(tidy(run), f"doc_id {kind}, key string, fp bigint")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    classes = cut(rows.groupBy("fp").agg(F.min(order).alias("first")))
    first = cut(_rooted(classes, distance, groups).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("__key")))
    return docs.withColumn("__key", key).join(first, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
