"""Operator 3: language-model scoring with a log-frequency Bloom filter.

Tokens are lower-cased words and one end per text. Learned are exact counts of single tokens and the counts of all pairs of
neighbours, the latter kept in a Bloom filter: a pair seen c times is entered as (pair, 1) ... (pair, q) with
q = 1 + floor(log2 c), and probes for j = 1, 2, ... until one fails give q back. Scoring discounts what the probes say and backs off:

    P(w | h) = max(0, 2^(q-1) - D) / c(h) + back(h) * (c(w) + alpha) / (N + alpha * (V + 1)),
    back(h)  = 1 - sum over w of (2^(q-1) - D) / c(h).

D is 0.99: a pair seen once says next to nothing of unseen text (held-out texts score as well as by the Good-Turing estimate, 0.76 on the fixtures), and
so a text that the corpus holds twice is told from one that it holds once. P(. | h) sums to one for each history, but for false positives, of which
there is one in ten million; 2^(q-1) is held to c(h) and c(w), so a token that was not learned has none. A history that was not learned
leaves the base probability.

Nothing that grows with the corpus meets in one task or at the driver. Texts are packed into blocks of token numbers as they are read; a block sends its
distinct tokens, cut by ranges of their 64-bit hash, as packed arrays; each range is summed in one place and the sums
go back to the blocks. Pairs go the same way: each range sums its pairs, makes its segment of the filter, asks it for the
pairs of every block and sends their levels back; one block is named for each learned pair, and what the named blocks say of their pairs gives the
sums of every history, by ranges of tokens again. The filter is never whole in one place, so no pair has to be left out, and a range holds as much at any size of the corpus.
What a step has read goes when it ends (its shuffle files, the rows of tokens once they are summed), so that the disk holds a step's data and not all steps'.

Tokens are told apart by 64-bit hashes, pairs by 48 bits of theirs within a filter: among a billion types two meet with probability 0.03.

Nulls: a null text is the empty one: just an end. A null doc_id counts as the empty id in the fold rule. Without training documents
all counts are 0 and every token has the base probability of an unseen one. Empty table: empty result. Repeated rows count and are scored each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, brief_shuffles, id_remainder, remove, work_folder
from .worker import give_back, tidy

#: Text bytes of a block: what a scoring task holds at a time, besides one longer text.
BLOCK_BYTES = 5 << 20
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
END, START = np.uint64(0x5AFE0E4D), np.uint64(0x5AFE57A7)
PAIR_BITS = 48
#: Text bytes for which there is one more range.
RANGE_BYTES, LEAST_RANGES = 16 << 20, 16
#: Marks, beside a pair's level, that the block is to count it for its history.
_NAMED = np.uint64(1 << 7)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_TO_LOWER).split()


def _squeeze(values: np.ndarray, width: int = 8) -> bytes:
    """Values of ``width`` bytes, byte plane by byte plane, compressed."""
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _unsqueeze(blob: bytes, n: int, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n)


def _squeeze_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as compressed differences."""
    return _squeeze(np.diff(values, prepend=np.uint64(0)))


def _unsqueeze_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unsqueeze(blob, n), dtype=np.uint64)


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, ends included, of all texts in order; number of tokens of each text)."""
    import xxhash

    split = [words(t) for t in texts]
    known: dict[bytes, int] = {}
    for ws in split:
        known.update(dict.fromkeys(ws))
    for w in known:
        known[w] = xxhash.xxh64_intdigest(w)
    lengths = np.array([len(ws) + 1 for ws in split], np.int64)
    out = np.full(int(lengths.sum()), END, np.uint64)
    at = np.ones(len(out), bool)
    at[np.cumsum(lengths) - 1] = False
    out[at] = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.uint64, int(at.sum()))
    return out, lengths


def _first_of(lengths: np.ndarray) -> np.ndarray:
    return (np.cumsum(lengths) - lengths).astype(np.int64)


def histories(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each token its predecessor; that of the first of a text is START."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[_first_of(lengths)] = START
    return before


def pair_hashes(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Hashes, of PAIR_BITS bits, of pairs."""
    x = (before * _MIX_A) ^ ((tokens >> np.uint64(29)) | (tokens << np.uint64(35)))
    x = (x ^ (x >> np.uint64(32))) * _MIX_B
    return (x ^ (x >> np.uint64(29))) * _MIX_A >> np.uint64(64 - PAIR_BITS)


def _ranges(values: np.ndarray, bits: int, parts: int) -> list[tuple[int, slice]]:
    """Cuts ascending values of ``bits`` bits into equal ranges of their value; only those that hold any."""
    part = (values >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(values)]
    return [(int(part[a]), slice(a, b)) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def _batches_of(batches, size: int) -> Iterator[pa.Table]:
    """Record batches regrouped by about ``size`` bytes of text (column 1)."""
    held, total = [], 0
    for b in batches:
        lengths = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(1)], np.int64)
        at = 0
        while at < b.num_rows:
            fits = int(np.searchsorted(np.cumsum(lengths[at:]), max(1, size - total))) + 1
            held.append(b.slice(at, fits))
            total += int(lengths[at : at + fits].sum())
            at += fits
            if total >= size:
                yield pa.Table.from_batches(held)
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _texts(table) -> list[str]:
    return [t or "" for t in table.column(1).to_pylist()]


def _write(df: DataFrame, folder: str, partition: str | None = None) -> DataFrame:
    writer = df.write
    with brief_shuffles(df.sparkSession):
        (writer.partitionBy(partition) if partition else writer).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


#: docs: data has ids and folds, more has token numbers, counts the distinct tokens. Others: data has values, counts and more have what is sent with them.
_PACKED = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), ("counts", pa.binary()), ("more", pa.binary())])
_SENT = pa.schema([f for f in _PACKED if f.name != "kind"])
_SENT_SQL = "block bigint, part int, n bigint, data binary, counts binary, more binary"


def _pack(parts: int):
    def run(batches):
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for table in _batches_of(batches, BLOCK_BYTES):
            block, k = (task << 32) | k, k + 1
            tokens, lengths = token_hashes(_texts(table))
            learn = np.repeat(~np.array(table.column(2).to_pylist(), bool), lengths)
            distinct, number = np.unique(tokens, return_inverse=True)
            n = np.bincount(number[learn], minlength=len(distinct))
            kept = table.select([0, 2]).append_column("length", pa.array(lengths))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(kept)
            rows = [("docs", block, -1, len(distinct), sink.getvalue().to_pybytes(), _squeeze_sorted(distinct), _squeeze(number, 4))]
            rows += [("tokens", block, part, s.stop - s.start, _squeeze_sorted(distinct[s]), _squeeze(n[s]), b"") for part, s in _ranges(distinct, 64, parts)]
            yield _batch(rows, _PACKED)

    return run


class Block:
    """What a block of documents holds: ids, folds and lengths (``docs``), its distinct tokens, and the number of each token among them."""

    def __init__(self, row: dict):
        self.docs = pa.ipc.open_stream(row["data"]).read_all()
        self.lengths = self.docs.column("length").to_numpy()
        self.distinct = _unsqueeze_sorted(row["counts"], row["n"])
        self.number = _unsqueeze(row["more"], int(self.lengths.sum()), 4)
        self.learn = np.repeat(~np.array(self.docs.column(1).to_pylist(), bool), self.lengths)
        self.before = histories(self.distinct[self.number], self.lengths)
        self.pairs = pair_hashes(self.before, self.distinct[self.number])


def _summed(table: pa.Table, columns: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of one range: (rows of each block, distinct values, where each first stands, the number of each of all values, sums by value of each column)."""
    sizes = table.column("n").to_pylist()
    values = np.concatenate([_unsqueeze_sorted(d, n) for d, n in zip(table.column("data").to_pylist(), sizes, strict=True)])
    distinct, first, number = np.unique(values, return_index=True, return_inverse=True)
    sums = []
    for c in columns:
        counts = np.concatenate([_unsqueeze(d, n) for d, n in zip(table.column(c).to_pylist(), sizes, strict=True)])
        sums.append(np.bincount(number, weights=counts.astype(np.float64), minlength=len(distinct)).astype(np.uint64))
    return sizes, distinct, first, number, sums


def _back(table: pa.Table, sizes: list[int], columns: dict[str, np.ndarray], totals: dict[str, int]) -> pa.Table:
    """What a range sends back to its blocks: ``columns`` have a value for each of their values; totals stand in the first row."""
    out = {"block": table.column("block"), "part": table.column("part"), "n": table.column("n")}
    for name, values in columns.items():
        out[name] = pa.array([_squeeze(x) for x in np.split(values, np.cumsum(sizes)[:-1])], pa.binary())
    for name, total in totals.items():
        out[name] = pa.array([total] + [0] * (len(sizes) - 1), pa.int64())
    return pa.table(out)


def _sum_tokens(table: pa.Table) -> pa.Table:
    """One hash range: the corpus count of every block's tokens, in the block's order."""
    sizes, _, _, number, (sums,) = _summed(table, ["counts"])
    return _back(table, sizes, {"counts": sums[number]}, {"known": int((sums > 0).sum()), "total": int(sums.sum())})


def _block_pairs(parts: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                distinct, number = np.unique(block.pairs, return_inverse=True)
                n = np.bincount(number[block.learn], minlength=len(distinct))
                del block, number
                rows = [(row["block"], part, s.stop - s.start, _squeeze_sorted(distinct[s]), _squeeze(n[s]), b"") for part, s in _ranges(distinct, PAIR_BITS, parts)]
                yield _batch(rows, _SENT)

    return run


def _pair_levels(table: pa.Table) -> pa.Table:
    """One hash range: its segment of the filter, and what that says of every block's pairs, in the block's order; each learned pair names one block."""
    sizes, distinct, first, number, (sums,) = _summed(table, ["counts"])
    learned = sums > 0
    levels = LogBloom.segment(distinct[learned], sums[learned]).levels(distinct) if learned.any() else np.zeros(len(distinct), np.int64)
    codes = levels.astype(np.uint64)[number]
    codes[first[learned]] |= _NAMED
    made = _back(table, sizes, {"counts": codes}, {})
    del distinct, first, number, sums, learned, levels, codes
    give_back()
    return made


def _block_histories(parts: int):
    """What a block's named pairs add to their histories: the counts that the filter gives them, and their number."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            block, codes = Block(row), _of_kind(right, "pairs")
            _, first = np.unique(block.pairs, return_index=True)
            named = codes & _NAMED != 0
            history, level = block.before[first[named]], (codes[named] & ~_NAMED).astype(np.int64)
            known = np.unique(np.append(block.distinct, START))
            at = np.searchsorted(known, history)
            counts = np.bincount(at, weights=np.exp2(level - 1.0), minlength=len(known))
            times = np.bincount(at, minlength=len(known))
            rows += [(row["block"], part, s.stop - s.start, _squeeze_sorted(known[s]), _squeeze(counts[s]), _squeeze(times[s])) for part, s in _ranges(known, 64, parts)]
            del block, codes, first, named, history, level, known, at, counts, times
        give_back()
        return pa.Table.from_batches([_batch(rows, _SENT)])

    return run


def _sum_histories(table: pa.Table) -> pa.Table:
    """One hash range: the sums of every block's histories, in the block's order."""
    sizes, _, _, number, (counts, times) = _summed(table, ["counts", "more"])
    return _back(table, sizes, {"counts": counts[number], "more": times[number]}, {})


class LogBloom:
    """A segment of a log-frequency Bloom filter: that of one hash range."""

    #: An item that was never entered passes with probability (1 - e^(-12/40))^12 = 1e-7. A segment lives in one task only, so bits are cheap.
    PROBES = 12
    BITS_PER_ITEM = 40
    #: In a segment of few bits the places of different items meet more often than that.
    LEAST_BITS = 1 << 20

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = np.uint64(bits), data

    @staticmethod
    def level(counts: np.ndarray) -> np.ndarray:
        return np.floor(np.log2(np.maximum(counts, 1).astype(np.float64))).astype(np.int64) + 1

    @classmethod
    def places(cls, pairs: np.ndarray, level: int, bits: np.uint64):
        a = (pairs + np.uint64(level)) * _MIX_A
        a ^= a >> np.uint64(31)
        b = (a * _MIX_B) | np.uint64(1)
        b ^= b >> np.uint64(33)
        for i in range(cls.PROBES):
            yield ((a + np.uint64(i) * b) % bits).astype(np.int64)

    @classmethod
    def segment(cls, pairs: np.ndarray, counts: np.ndarray) -> LogBloom:
        levels = cls.level(counts)
        bits = max(cls.LEAST_BITS, int(levels.sum()) * cls.BITS_PER_ITEM)
        bits += -bits % 8
        field = np.zeros(bits, bool)
        for j in range(1, int(levels.max(initial=0)) + 1):
            for place in cls.places(pairs[levels >= j], j, np.uint64(bits)):
                field[place] = True
        return cls(bits, np.packbits(field, bitorder="little"))

    def levels(self, pairs: np.ndarray) -> np.ndarray:
        """For each pair the highest level up to which all probes succeed; 0 if the first fails."""
        out = np.zeros(len(pairs), np.int64)
        alive = np.arange(len(pairs))
        for j in range(1, 64):
            ok = np.arange(len(alive))
            for place in self.places(pairs[alive], j, self.bits):
                spot = place[ok]
                ok = ok[(self.data[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1]
            alive = alive[ok]
            if not len(alive):
                break
            out[alive] = j
        return out


def _of_kind(right: pa.Table, kind: str, column: str = "counts") -> np.ndarray:
    """What the hash ranges sent back for a block's distinct values of a kind, in ascending order of these."""
    back = sorted((r for r in right.select(["kind", "part", "n", column]).to_pylist() if r["kind"] == kind), key=lambda r: r["part"])
    return np.concatenate([_unsqueeze(r[column], r["n"]) for r in back])


def _score(less: float, total: int, known: int, alpha: float, id_type: pa.DataType):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = Block(row)
            lengths, first = block.lengths, _first_of(block.lengths)
            of_token = _of_kind(right, "tokens").astype(np.float64)
            counts = of_token[block.number]
            base = (counts + alpha) / (total + alpha * (known + 1))
            tokens = np.unique(np.append(block.distinct, START))
            times = np.zeros(len(tokens))  # of each history: as often as it was learned, something followed
            times[np.searchsorted(tokens, block.distinct)] = of_token
            times[np.searchsorted(tokens, START)] = of_token[np.searchsorted(block.distinct, END)]
            given = _of_kind(right, "histories").astype(np.float64) - less * _of_kind(right, "histories", "more")
            back = 1 - given / np.maximum(times, 1.0)
            at = np.searchsorted(tokens, block.before)
            history = times[at]
            number = np.unique(block.pairs, return_inverse=True)[1]
            levels = (_of_kind(right, "pairs") & ~_NAMED).astype(np.int64)[number]
            seen = np.where(levels > 0, np.minimum(np.exp2(levels - 1.0), np.minimum(history, counts)), 0.0)
            mixed = np.where(history > 0, np.maximum(seen - less, 0) / np.maximum(history, 1.0) + back[at] * base, base)
            sums = [np.add.reduceat(x, first) for x in (np.log10(base), np.log10(mixed), (counts > 0).astype(np.int64))]
            out.append(
                pa.table(
                    {
                        "doc_id": block.docs.column(0).cast(id_type),
                        "held_out": block.docs.column(1),
                        "n_tokens": pa.array(lengths, pa.int64()),
                        "n_known": pa.array(sums[2], pa.int64()),
                        "train_tokens": pa.array(np.full(len(lengths), total), pa.int64()),
                        "base_score": pa.array(sums[0], pa.float64()),
                        "score": pa.array(sums[1], pa.float64()),
                    }
                )
            )
            del block, of_token, counts, base, tokens, times, given, back, at, history, number, levels, seen, mixed, sums
        give_back()
        return pa.concat_tables(out)

    return run


def score_documents(docs: DataFrame, modulus: int = 10, held_out: int = 0, alpha: float = 0.1, discount: float = 0.99, parts: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text)."""
    folder = work_folder(docs.sparkSession, "lm")
    folded = docs.select("doc_id", "text", (id_remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"))
    size = folded.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts or max(LEAST_RANGES, size // RANGE_BYTES)

    packed = _write(folded.mapInArrow(tidy(_pack(parts)), f"kind string, {_SENT_SQL}"), f"{folder}/blocks", "kind")
    blocks = packed.filter("kind = 'docs'").drop("kind")
    back = "block bigint, part int, n bigint, counts binary"
    summed = _write(packed.filter("kind = 'tokens'").drop("kind").groupBy("part").applyInArrow(_sum_tokens, f"{back}, known bigint, total bigint"), f"{folder}/sums")
    known, total = summed.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    remove(docs.sparkSession, f"{folder}/blocks/kind=tokens")

    levels = blocks.mapInArrow(tidy(_block_pairs(parts)), _SENT_SQL).groupBy("part").applyInArrow(_pair_levels, back)
    levels = _write(levels, f"{folder}/levels")

    named = lambda df, kind: df.select("block", F.lit(kind).alias("kind"), "part", "n", "counts", "more" if "more" in df.columns else F.lit(None).cast("binary").alias("more"))
    told = blocks.groupBy("block").cogroup(named(levels, "pairs").groupBy("block")).applyInArrow(_block_histories(parts), _SENT_SQL)
    of_history = _write(told.groupBy("part").applyInArrow(_sum_histories, f"{back}, more binary"), f"{folder}/histories")

    sent = named(summed, "tokens").unionByName(named(levels, "pairs")).unionByName(named(of_history, "histories")).groupBy("block")
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.groupBy("block").cogroup(sent).applyInArrow(_score(discount, int(total), int(known), alpha, to_arrow_type(kind)), schema)
