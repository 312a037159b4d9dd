"""Operator 5: near-duplicate embeddings by collision-counting projections.

Two unit vectors of cosine c differ by sqrt(2 - 2c), and their projections on a unit direction by that times the cosine of an angle: about normal, with
deviation r = sqrt(2 - 2c) / sqrt(dim). Vectors are projected on ``projections`` fixed directions, in each of which the vectors of a cell
are sorted, and every query counts a collision with what lies within ``width`` * r of it. Pairs with at least t collisions are verified by their
cosine in double precision. t is calibrated: the largest count that a pair just at the threshold reaches with probability 1 - ``miss`` or more; closer pairs
reach it more often. Verification lets nothing below the threshold through.

Cells come from further directions, more of them the more vectors the largest label has: a vector is at home in the cell of the direction on which its
projection is greatest, and asks in the cells of all directions on which it is less by ``reach`` * sqrt(2) * r at most (by which a pair at the threshold
is lost with probability 5e-4). So pairs are sought in a share of all that falls with the number of cells. A cell with more rows than a task's fair share, as a
dense cluster makes it, is cut: its homes are sorted by their first projection and cut into tiles of a range of it, and a query goes to the tiles that its
window meets.

Equal vectors are one class with a multiplicity, and tiles report sums and a spanning forest, not pairs; so a large group of copies costs
rows in proportion to its size. Links are exact counts of what is found.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label, link with nothing: they are components of their
own. So are rows without a vec_id, whose component is null. Vectors of different dimensions do not link. Rows that repeat count each other. Empty table: empty result.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions_of
from .graph import components, least_labels
from .topk import matrices, usable

#: Rows of a tile, at least and at most.
SMALLEST_TILE, LARGEST_TILE = 256, 4096
#: Vectors of a label for which there is one more cell, and cells at least and at most.
CELL_ROWS, LEAST_CELLS, MOST_CELLS = 1024, 16, 2048
#: Tiles that are broadcast.
BROADCAST_TILES = 100_000


def directions(dim: int, number: int, seed: int = 11) -> np.ndarray:
    d = np.random.default_rng([seed, dim]).standard_normal((dim, number))
    return d / np.linalg.norm(d, axis=0)


def collisions_needed(projections: int, width: float, miss: float) -> int:
    """The largest t with P(Binomial(projections, p) >= t) >= 1 - miss, p the chance of one collision at the threshold."""
    p, below = erf(width / sqrt(2)), 0.0
    for t in range(projections + 1):
        below += comb(projections, t) * p**t * (1 - p) ** (projections - t)
        if below > miss:
            return t
    return projections


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def window(dim: int, width: float, threshold: float) -> float:
    """By how much projections of a pair at the threshold differ, times ``width``."""
    return min(1.0, width / sqrt(dim)) * sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9


def tile_links(homes: np.ndarray, queries: np.ndarray, threshold: float, projections: int, width: float, miss: float):
    """Pairs (query, home) with cosine >= threshold, by collision counts; rows are unit vectors."""
    dim = homes.shape[1]
    d = directions(dim, projections)
    half = window(dim, width, threshold)
    needed = collisions_needed(projections, width, miss) if dim > 2 else 0
    order, keys = [], []
    for j in range(projections):
        p = homes @ d[:, j]
        o = np.argsort(p, kind="stable")
        order.append(o)
        keys.append(p[o])
    found_q, found_h = [], []
    for start in range(0, len(queries), 512):
        block = queries[start : start + 512]
        counts = np.zeros((len(block), len(homes)), np.uint8)
        for j in range(projections):
            p = block @ d[:, j]
            lo, hi = np.searchsorted(keys[j], p - half), np.searchsorted(keys[j], p + half, side="right")
            o = order[j]
            for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
                counts[i, o[a:b]] += 1
        q, h = np.nonzero(counts >= needed)
        for a in range(0, len(q), 1 << 16):
            qa, ha = q[a : a + (1 << 16)], h[a : a + (1 << 16)]
            near = np.einsum("ij,ij->i", block[qa], homes[ha]) >= threshold
            found_q.append(qa[near] + start)
            found_h.append(ha[near])
    return (np.concatenate(found_q), np.concatenate(found_h)) if found_q else (np.empty(0, np.int64),) * 2


def cells_of(x: np.ndarray, cells: int, reach: float, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: (the cell where each is at home, rows that ask, cells in which they ask)."""
    dim = x.shape[1]
    p = x @ directions(dim, cells, 12)
    # A pair's projections on two directions shift against each other by at most sqrt(2) as much as on one.
    rows, asked = np.nonzero(p >= p.max(axis=1, keepdims=True) - sqrt(2) * window(dim, reach, threshold))
    return p.argmax(axis=1), rows, asked


def near_duplicates(table: DataFrame, threshold: float = 0.98, projections: int = 16, width: float = 1.5, reach: float = 3.5, miss: float = 1e-4, cells: int | None = None, tile: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of table (vec_id, embedding, label)."""
    spark = table.sparkSession
    rows = table.select("vec_id", "label", "embedding", usable(F.col("embedding")).alias("ok"))
    linkable = F.col("ok") & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("key", F.when(linkable, F.xxhash64("label", "embedding")))
    id_type = table.schema["vec_id"].dataType.simpleString()
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = cut(classes.select("key", "least", "times", F.xxhash64("label").alias("label"), "embedding"))
    most = classes.groupBy("label", F.size("embedding")).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    cells = cells or int(min(MOST_CELLS, max(LEAST_CELLS, most // CELL_ROWS)))

    def spread(payload: bool):
        def run(batches):
            for b in batches:
                label = b.column(1).to_numpy(zero_copy_only=False)
                for dim, at, x in matrices(b.column(2)):
                    x = unit(x)
                    own, who, asked = cells_of(x, cells, reach, threshold)
                    w = np.concatenate([np.arange(len(at)), who])
                    first = (x @ directions(dim, 1))[:, 0]
                    asks = np.arange(len(w)) >= len(at)
                    columns = [pa.array(label[at[w]]), pa.array(np.full(len(w), dim, np.int32)), pa.array(np.concatenate([own, asked]).astype(np.int32)), pa.array(asks), pa.array(first[w])]
                    names = ["label", "dim", "cell", "asks", "first"]
                    if payload:
                        columns += [b.column(k).take(pa.array(at[w])) for k in (0, 3, 2)]
                        names += ["key", "times", "embedding"]
                    yield pa.RecordBatch.from_arrays(columns, names)

        return run

    element = table.schema["embedding"].dataType.simpleString()
    source, schema, place = classes.select("key", "label", "embedding", "times"), "label bigint, dim int, cell int, asks boolean, first double", ["label", "dim", "cell"]
    sizes = cut(source.mapInArrow(spread(False), schema).groupBy(*place).agg(F.count(F.when(~F.col("asks"), 1)).alias("homes"), F.count(F.lit(1)).alias("rows"), F.min("first").alias("low"), F.max("first").alias("high")).filter("homes > 0"))
    n_rows, n_homes = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("homes"), F.lit(0))).first()
    tile = tile or int(min(LARGEST_TILE, max(SMALLEST_TILE, n_rows // (2 * partitions_of(spark)))))
    # A cell's range of first projections is cut into as many equal parts as it has tiles of homes.
    sizes = sizes.select(*place, F.ceil(F.col("homes") / tile).cast("int").alias("tiles"), "low", ((F.col("high") - F.col("low")) * (1 + 1e-9) + 1e-12).alias("range"))
    spreading = source.mapInArrow(spread(True), schema + f", key bigint, times bigint, embedding {element}")
    dealt = spreading.join(F.broadcast(sizes) if n_homes // tile + sizes.count() <= BROADCAST_TILES else sizes, place)
    part = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.col("tiles") - 1.0, (c - F.col("low")) / F.col("range") * F.col("tiles")))).cast("int")
    half = F.lit(sqrt(max(0.0, 2 - 2 * threshold))) * F.least(F.lit(1.0), reach / F.sqrt("dim")) + 1e-9
    across = F.when(F.col("asks"), F.sequence(part(F.col("first") - half), part(F.col("first") + half))).otherwise(F.array(part(F.col("first"))))
    dealt = dealt.withColumn("tile", F.explode(across))
    # A tile's queries come in groups of a tile's size, each with all the tile's homes.
    counts = cut(dealt.groupBy(*place, "tile").agg(F.count(F.when(F.col("asks"), 1)).alias("queries"), F.count(F.when(~F.col("asks"), 1)).alias("homes")).filter("homes > 0 and queries > 0"))
    groups = counts.select(*place, "tile", F.ceil(F.col("queries") / tile).cast("int").alias("q"), F.ceil(F.col("homes") / tile).cast("int").alias("h"))
    dealt = dealt.join(F.broadcast(groups) if groups.count() <= BROADCAST_TILES else groups, [*place, "tile"])
    draw = lambda n: F.pmod(F.xxhash64("key", F.lit("tile")), F.col(n)).cast("int")
    other = F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("h") - 1)).otherwise(F.sequence(F.lit(0), F.col("q") - 1)))
    dealt = dealt.withColumn("other", other)
    dealt = dealt.select(*place, "tile", F.when(F.col("asks"), F.col("other")).otherwise(draw("h")).alias("th"), F.when(F.col("asks"), draw("q")).otherwise(F.col("other")).alias("tq"), "asks", "key", "times", "embedding")

    def meet(t: pa.Table) -> pa.Table:
        asks = np.array(t.column("asks").to_pylist(), bool)
        keys, times = t.column("key").to_numpy(), t.column("times").to_numpy()
        empty = pa.table([pa.array([], pa.int64())] * 3, names=["a", "b", "n"])
        if asks.all() or not asks.any():
            return empty
        (_, _, x), *_ = matrices(t.column("embedding").combine_chunks())
        x = unit(x)
        hk, qk, ht = keys[~asks], keys[asks], times[~asks]
        q, h = tile_links(x[~asks], x[asks], threshold, projections, width, miss)
        apart = qk[q] != hk[h]
        q, h = q[apart], h[apart]
        if not len(q):
            return empty
        linked = np.bincount(q, weights=ht[h], minlength=len(qk)).astype(np.int64)
        some = np.flatnonzero(linked)
        b, a = least_labels(qk[q], hk[h])
        a, b = a[a != b], b[a != b]
        return pa.table({"a": np.concatenate([qk[some], a]), "b": np.concatenate([qk[some], b]), "n": np.concatenate([linked[some], np.zeros(len(a), np.int64)])})

    met = cut(dealt.groupBy(*place, "tile", "th", "tq").applyInArrow(meet, "a bigint, b bigint, n bigint"))
    links = met.filter("n > 0").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("links"))
    roots = components(met.filter("n = 0").select("a", "b")).withColumnRenamed("node", "key")
    full = classes.select("key", "least", "times").join(links, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    full = cut(full)
    least = full.groupBy("root").agg(F.min("least").alias("component"))
    full = cut(full.join(least, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), "component"))
    out = rows.select("vec_id", "key").join(full, "key", "left")
    component = F.coalesce("component", "vec_id").cast(id_type)
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
