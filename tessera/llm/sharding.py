"""Operator 1: hierarchical weighted hash tree.

A cluster is a tree: regions hold racks, racks hold shards, and a shard has a weight; the weight of an inner node is the
sum below it. A row starts at the root; at each level every child makes a draw ``-ln(u) / weight`` where ``u`` is a hash
of the row's key and the child's name, and the smallest draw wins. The draw of a child depends on that child's name and
weight alone, so when weights change, rows move only into or out of the children whose weight changed; everything
inside other subtrees stays. A shard that joins as a region of its own changes no other subtree's weight, and so takes
rows only into itself.

Nulls: a null key hashes as itself and all its rows share a shard; a null text has size 1 and the checksum of no bytes.
Empty table: empty result. Repeated rows share a shard and get different slots. Columns of the input that clash with
those of the result are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, digest_bits

#: Lanes of a shard at least, and rows for which there is one more; rows of a lane that one task numbers; lanes that are broadcast.
LEAST_LANES, LANE_ROWS, HEAVY_LANE, BROADCAST_LANES = 256, 50_000, 400_000, 100_000


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, regions: int = 2, racks: int = 2) -> list[Shard]:
    """``shards`` leaves of weight 1, dealt evenly to ``regions`` x ``racks``."""
    return [Shard(f"region{i * regions // shards}", f"rack{i * regions * racks // shards % racks}", i) for i in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region of its own."""
    new = max(s.shard for s in tree) + 1
    return [*tree, Shard(f"region-of-{new}", "rack0", new, weight)]


def levels(tree: list[Shard]) -> list[dict[str, dict[str, float]]]:
    """For each level, the children of every node by path, with their weights."""
    names = [[s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}"] for s in tree]
    out = []
    for depth in range(3):
        level: dict[str, dict[str, float]] = {}
        for path, s in zip(names, tree, strict=True):
            children = level.setdefault(path[depth - 1] if depth else "", {})
            children[path[depth]] = children.get(path[depth], 0.0) + s.weight
        out.append(level)
    return out


def _draw(key: Column, name: str, weight: float) -> Column:
    # 52 bits of a digest, shifted by one half: u lies strictly between 0 and 1.
    return -F.log((digest_bits(key, F.lit(name)) + 0.5) / float(2**52)) / weight


def _pick(key: Column, children: dict[str, float]) -> Column:
    """Name of the child with the smallest draw; equal draws go to the smaller name."""
    draws = [F.struct(_draw(key, name, w).alias("draw"), F.lit(name).alias("name")) for name, w in children.items() if w > 0]
    return draws[0]["name"] if len(draws) == 1 else F.array_min(F.array(*draws))["name"]


def place(df: DataFrame, key: Column, tree: list[Shard], out: str = "shard") -> DataFrame:
    """Adds the int column ``out``: the shard of each row. One narrow projection per level, no shuffle."""
    if not any(s.weight > 0 for s in tree):
        raise ValueError("the tree has no shard with a weight")
    at = f"__node_{out}"
    df = df.withColumn(at, F.lit(""))
    for level in levels(tree):
        step = None
        for parent, children in level.items():
            if sum(children.values()) <= 0:
                continue
            step = (F.when if step is None else step.when)(F.col(at) == parent, _pick(key, children))
        df = df.withColumn(at, step)
    return df.withColumn(out, F.substring_index(F.col(at), "/", -1).cast("int")).drop(at)


def slots(df: DataFrame, shard: str, order: list[str], shards: int, lanes: int | None = None, heavy: int = HEAVY_LANE, out: str = "slot") -> DataFrame:
    """Adds ``out``: a gapless number from 0 within each of ``shards`` shards.

    Rows of a shard are split over lanes by a hash of all of ``order``, more of them the more rows there are; each lane is numbered on its own, from
    the number of rows in the lanes before it. So no task sees a whole shard. A lane of more than ``heavy`` rows, as rows repeated in full make
    it, is split further by the rows' places in the table, which decide the order of its rows first.
    """
    df = cut(df)
    count = df.count()
    lanes = lanes or max(LEAST_LANES, count // LANE_ROWS)
    df = df.withColumn("__lane", digest_bits(*[F.col(c) for c in order]) % lanes)
    sizes = df.groupBy(shard, "__lane").agg(F.count(F.lit(1)).alias("__n"))
    # There are at most count / heavy of these.
    split = sizes.filter(F.col("__n") > heavy).select(shard, "__lane", F.ceil(F.col("__n") / heavy).cast("long").alias("__parts")) if count > heavy else None
    keys = [shard, "__lane"]
    if split is not None and not split.isEmpty():
        df = df.withColumn("__place", F.monotonically_increasing_id()).join(F.broadcast(split) if count // heavy <= BROADCAST_LANES else split, keys, "left")
        df = cut(df.withColumn("__part", F.coalesce(F.pmod(F.xxhash64("__place"), F.col("__parts")), F.lit(0))).drop("__parts", "__place"))
        keys.append("__part")
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    starts = F.broadcast(starts) if shards * lanes + 2 * (count // heavy) <= BROADCAST_LANES else starts
    return numbered.join(starts, keys).withColumn(out, (F.col("__start") + F.col("__rn")).cast("long")).drop(*keys[1:], "__start", "__rn")


def shard_documents(docs: DataFrame, shards: int = 8, lanes: int | None = None, heavy: int = HEAVY_LANE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, by the law ``key``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    tree = even_tree(shards)
    placed = place(place(base, F.col("doc_id"), tree, "shard"), F.col("doc_id"), grown(tree), "grown_shard")
    done = slots(placed, "shard", ["doc_id", "text_crc32", "size"], shards, lanes, heavy)
    return done.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
