"""Operator 2: exact top-k search with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it; sorted by that key, vectors are packed into blocks, so each block is an annulus
(one pivot, a range of distances). By the triangle inequality |q - x| >= |d(q, p) - d(x, p)|, and as q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, no x of an
annulus with distances r in [lo, hi] and |x|^2 <= m scores above (|q|^2 + m - gap^2) / 2, where gap is how far d(q, p) lies outside [lo, hi].

Queries are packed into chunks. Each chunk has its annuli in the order of that bound and expands them in rounds: the first few, then more, then
the rest. Between rounds the k-th best scores that all tasks have found become the chunk's floor, annuli whose bound is below it are no longer
fetched, and within a round a task carries the floor along and stops at the first such annulus. A first floor comes from the sample that the pivots are
chosen from. The plan of rounds holds numbers only; vectors are fetched by the number of their block or chunk, so no pivot is a hot key.

The result is exact: pivots and sample only decide what is skipped. Pivots (as many as the square root of the rows over 8, 32 to 512) come from a hash
sample by farthest-first traversal.

Every row is a query if its id is divisible, and a candidate for every query but itself; so a query row that is repeated has its ranks
repeated, and its copies are its neighbours. Ties go to the smaller id.

Vectors that are null, empty, or hold null components or such as are not finite when scaled, and rows with a null id, take no part. Vectors of another
dimension than the query's are no candidates. Inner products are exact integers of any size; a score is held to the range of 64 bits. Empty
table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions_of

BLOCK_ROWS, CHUNK_ROWS = 2048, 256
#: Annuli that each round may expand; the last takes all that are left. Annuli of a chunk that one task expands at a time.
ROUNDS, PART = (4, 60), 64
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Distances are rounded; bounds give way by this share, so that nothing is skipped wrongly.
SLACK = 1e-9


def usable(embedding: Column, scale: float = 1.0) -> Column:
    """True for vectors with at least one component and only such as are finite when scaled."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & ~bad, F.lit(False))


def matrices(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: (length, places of the lists that have it, these lists as rows of doubles)."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = (np.cumsum(sizes) - sizes).astype(np.int64)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, flat[starts[at][:, None] + np.arange(dim)].astype(np.float64)


def packed(vectors: np.ndarray) -> tuple[str, bytes]:
    """The smallest type that holds the (integer) components, and the rows in it."""
    top = float(np.abs(vectors).max(initial=0))
    kind = next((t for t in ("i1", "i2", "i4") if top < 2 ** (8 * int(t[1]) - 1)), "f8")
    return kind, vectors.astype(kind).tobytes()


def unpacked(kind: str, blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(-1, dim)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held to 64 bits: in floating point where all sums are exact in it, or else in integers of any size."""
    top = lambda a: int(np.abs(a.astype(np.float64)).max(initial=0))
    bound = top(queries) * top(vectors) * queries.shape[1]
    for kind, exact in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if bound < exact:
            return (queries.astype(kind) @ vectors.astype(kind).T).astype(np.int64)
    whole = lambda a: np.array([[int(x) for x in row] for row in a.tolist()], object).reshape(a.shape)
    return np.clip(whole(queries) @ whole(vectors).T, _LEAST + 1, _MOST).astype(np.int64)


def farthest_first(sample: np.ndarray, pivots: int) -> np.ndarray:
    chosen = [0]
    gap = _squares(sample - sample[0])
    while len(chosen) < min(pivots, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _squares(sample - sample[chosen[-1]]))
    return sample[chosen]


def _squares(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x**2).sum(axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows from pivots; 0 where squares are beyond a double, whose bounds are infinite anyway."""
    with np.errstate(over="ignore", invalid="ignore"):
        squares = _squares(x)[:, None] + _squares(pivots)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.where(np.isfinite(squares), np.maximum(squares, 0), 0))


def _open() -> Column:
    """Whether a chunk may find something in an annulus: the least 64-bit number stands for no floor at all."""
    return (F.col("reach") >= F.col("least")) | (F.col("least") == F.lit(_LEAST))


def _record(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)], list(fields))


_BLOCK = {"block": pa.int64(), "dim": pa.int32(), "pivot": pa.int32(), "lo": pa.float64(), "hi": pa.float64(), "top": pa.float64(), "ids": pa.binary(), "kind": pa.string(), "vectors": pa.binary()}
_CHUNK = {"chunk": pa.int64(), "dim": pa.int32(), "near": pa.list_(pa.float64()), "far": pa.list_(pa.float64()), "qtop": pa.float64(), "least": pa.int64(), "ids": pa.binary(), "own": pa.binary(), "floors": pa.binary(), "kind": pa.string(), "vectors": pa.binary()}
_NAMES = {pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.float64()): "array<double>"}
_schema = lambda fields: ", ".join(f"{n} {_NAMES[t]}" for n, t in fields.items())


def top_k(table: DataFrame, k: int = 20, scale: int = 64, every: int = 20, pivots: int | None = None, sample: int = 2048, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the k other rows with the highest inner product."""
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"), scale))
    n = max(1, rows.count())
    pivots = pivots or min(512, max(32, isqrt(n) // 8))
    draw = F.pmod(F.xxhash64("vec_id", F.lit("pivot")), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.filter(draw < min(1.0, sample / n)).limit(4 * sample).collect()
    samples: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r.embedding) for r in drawn}:
        same = sorted((r for r in drawn if len(r.embedding) == dim), key=lambda r: r.vec_id)
        samples[dim] = np.array([r.vec_id for r in same], np.int64), np.floor(np.array([r.embedding for r in same], np.float64) * scale)
    centres = {dim: farthest_first(x, pivots) for dim, (_, x) in samples.items()}
    sent = spark.sparkContext.broadcast((samples, centres))

    def centres_of(dim: int) -> np.ndarray:
        return sent.value[1].get(dim, np.zeros((1, dim)))

    def key(batches):
        for b in batches:
            size, pivot, dist = (np.zeros(b.num_rows, t) for t in (np.int32, np.int32, np.float64))
            for dim, at, x in matrices(b.column(1)):
                d = _distances(np.floor(x * scale), centres_of(dim))
                size[at], pivot[at], dist[at] = dim, d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(pivot), pa.array(dist), *b.columns], ["dim", "pivot", "dist", *b.schema.names])

    element = table.schema["embedding"].dataType.simpleString()
    keyed = rows.mapInArrow(key, f"dim int, pivot int, dist double, vec_id bigint, embedding {element}")
    order = ["dim", "pivot", "dist", "vec_id"]
    dealt = keyed.repartitionByRange(partitions_of(spark), *order).sortWithinPartitions(*order)

    def pack(batches):
        from pyspark import TaskContext

        task, number, held, of = TaskContext.get().partitionId(), 0, [], None

        def blocks(all_of_it: bool):
            nonlocal number, held
            ids, dist, x = (np.concatenate([h[i] for h in held]) for i in range(3))
            made, at = [], 0
            while at < len(ids) and (all_of_it or len(ids) - at >= block_rows):
                part = slice(at, at + block_rows)
                top = float(_squares(x[part]).max())
                lo, hi = (float(dist[part][0]), float(dist[part][-1])) if np.isfinite(top) else (0.0, np.inf)
                made.append(((task << 32) | number, *of, lo, hi, top, ids[part].tobytes(), *packed(x[part])))
                number, at = number + 1, at + block_rows
            held = [] if at >= len(ids) else [(ids[at:], dist[at:], x[at:])]
            return made

        for b in batches:
            keys = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            made = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if held and of != tuple(keys[lo].tolist()):
                    made += blocks(True)
                of = tuple(keys[lo].tolist())
                part = b.slice(lo, hi - lo)
                (_, _, x), *_ = matrices(part.column(4))
                held.append((part.column(3).to_numpy(), part.column(2).to_numpy(), np.floor(x * scale)))
                if sum(len(h[0]) for h in held) >= block_rows:
                    made += blocks(False)
            if made:
                yield _record(made, _BLOCK)
        if held:
            yield _record(blocks(True), _BLOCK)

    blocks = cut(dealt.mapInArrow(pack, _schema(_BLOCK)))

    def query(batches):
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId(), 0, []

        def out():
            nonlocal number, held
            dim = held[0][0]
            ids, own, x = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            x, held = x.astype(np.float64), []
            floors = np.full(len(ids), _LEAST)
            if dim in sent.value[0]:
                known, vectors = sent.value[0][dim]
                s = products(x, vectors)
                s[ids[:, None] == known[None]] = _LEAST  # one of them may be the query itself
                if len(known) > k:
                    floors = np.partition(s, len(known) - k, axis=1)[:, len(known) - k]
            d, top = _distances(x, centres_of(dim)), float(_squares(x).max())
            far = d.max(axis=0) if np.isfinite(top) else np.full(d.shape[1], np.inf)
            row = ((task << 32) | number, dim, d.min(axis=0).tolist(), far.tolist(), top, int(floors.min()), ids.tobytes(), own.tobytes(), floors.tobytes(), *packed(x))
            number += 1
            return _record([row], _CHUNK)

        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                asked = np.flatnonzero(ids % every == 0)
                for start in range(0, len(asked), chunk_rows):
                    at = asked[start : start + chunk_rows]
                    if held and (held[0][0] != r["dim"] or sum(len(h[1]) for h in held) + len(at) > chunk_rows):
                        yield out()
                    own = np.stack([np.full(len(at), r["block"]), at], 1)
                    held.append((r["dim"], ids[at], own, unpacked(r["kind"], r["vectors"], r["dim"])[at]))
        if held:
            yield out()

    chunks = cut(blocks.mapInArrow(query, _schema(_CHUNK)))
    asks = chunks.select("chunk", "dim", "qtop", "least", F.posexplode(F.arrays_zip("near", "far")).alias("pivot", "d"))
    asks = asks.select("chunk", "dim", "pivot", "qtop", "least", "d.near", "d.far")
    gap = F.greatest(F.lit(0.0), F.col("near") - F.col("hi"), F.col("lo") - F.col("far"))
    reach = (F.col("qtop") + F.col("top") - gap * gap) / 2 * (1 + SLACK) + 1
    plan = asks.join(blocks.select("block", "dim", "pivot", "lo", "hi", "top"), ["dim", "pivot"]).withColumn("reach", reach).filter(_open())
    nth = F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("reach"), "block")) - 1
    plan = cut(plan.select("chunk", "block", "reach", nth.alias("nth")))
    most = plan.agg(F.coalesce(F.max("nth"), F.lit(-1))).first()[0]

    def search(batches):
        at, state = None, None

        def out():
            chunk, ids, _, _, _, found_ids, found_scores = state
            some = [(np.full(len(f), chunk), np.full(len(f), i, np.int32), np.full(len(f), q), f, s) for i, (q, f, s) in enumerate(zip(ids.tolist(), found_ids, found_scores, strict=True)) if len(f)]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*some, strict=True)], ["chunk", "i", "query_id", "vec_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                dim = r["dim"]
                if at != (r["chunk"], r["part"]):
                    if state is not None:
                        yield from out()
                    at, ids = (r["chunk"], r["part"]), np.frombuffer(r["ids"], np.int64)
                    floors = np.frombuffer(r["floors"], np.int64).copy()
                    for x in r["raised"] or []:
                        floors[x["i"]] = max(floors[x["i"]], x["floor"])
                    own = np.frombuffer(r["own"], np.int64).reshape(-1, 2)
                    state = (r["chunk"], ids, floors, own, unpacked(r["qkind"], r["queries"], dim), [np.empty(0, np.int64)] * len(ids), [np.empty(0, np.int64)] * len(ids))
                _, ids, floors, own, queries, found_ids, found_scores = state
                if r["reach"] < floors.min() > _LEAST:
                    continue  # and so are all that follow in this part: they come in the order of their bounds
                exact = queries.astype(np.float64)
                d = _distances(exact, centres_of(dim)[r["pivot"]][None])[:, 0]
                apart = np.maximum(0, np.maximum(d - r["hi"], r["lo"] - d))
                live = np.flatnonzero(((_squares(exact) + r["top"] - apart**2) / 2 * (1 + SLACK) + 1 >= floors) | (floors == _LEAST))
                if not len(live):
                    continue
                known = np.frombuffer(r["xids"], np.int64)
                scores = products(queries[live], unpacked(r["xkind"], r["xs"], dim))
                for row, qi in enumerate(live.tolist()):
                    near = np.flatnonzero(scores[row] >= floors[qi])
                    if own[qi, 0] == r["block"]:
                        near = near[near != own[qi, 1]]
                    if not len(near):
                        continue
                    some_ids = np.concatenate([found_ids[qi], known[near]])
                    some_scores = np.concatenate([found_scores[qi], scores[row][near]])
                    keep = np.lexsort((some_ids, -some_scores))[:k]
                    found_ids[qi], found_scores[qi] = some_ids[keep], some_scores[keep]
                    if len(keep) == k:
                        floors[qi] = max(floors[qi], found_scores[qi][-1])
        if state is not None:
            yield from out()

    best = Window.partitionBy("chunk", "i").orderBy(F.desc("score"), "vec_id")
    found, start = None, 0
    for width in (*ROUNDS, most + 1):
        if found is not None and start > most:
            break
        now = plan.filter((F.col("nth") >= start) & (F.col("nth") < start + width)).withColumn("part", F.floor((F.col("nth") - start) / PART))
        asking = chunks.select("chunk", "dim", "ids", "own", "floors", F.col("kind").alias("qkind"), F.col("vectors").alias("queries"), "least")
        if found is None:
            asking = asking.withColumn("raised", F.lit(None).cast("array<struct<i:int,floor:bigint>>"))
        else:
            full = found.groupBy("chunk", "i").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
            full = full.groupBy("chunk").agg(F.collect_list(F.struct("i", "floor")).alias("raised"))  # chunk_rows of them at most
            asking = asking.join(full, "chunk", "left")
            lowest = F.when(F.size("raised") == F.length("ids") / 8, F.array_min(F.transform("raised", lambda x: x["floor"])))
            asking = asking.withColumn("least", F.greatest("least", lowest))
        fetched = now.join(asking, "chunk").filter(_open()).drop("least")
        fetched = fetched.join(blocks.select("block", "pivot", "lo", "hi", "top", F.col("ids").alias("xids"), F.col("kind").alias("xkind"), F.col("vectors").alias("xs")), "block")
        fetched = fetched.repartition(partitions_of(spark), "chunk", "part").sortWithinPartitions("chunk", "part", "nth")
        new = fetched.mapInArrow(search, "chunk bigint, i int, query_id bigint, vec_id bigint, score bigint")
        found = new if found is None else found.unionByName(new)
        found = cut(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank"))
        start += width
    return found.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")
