"""Sharding by a hierarchical weighted hash tree (operator 2).

A document descends region, rack and shard; at each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the document's key and the child's name, and the
smallest draw wins.  A child's draw depends on the key, its name and its weight alone, so a changed
weight moves documents only into or out of that subtree.  ``grow`` adds a shard
as a region of its own: the draws of all other children stay, and documents move
into the new shard or not at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class Tree:
    """``nodes``: a tuple of (shard, region, rack, weight)."""

    nodes: tuple[tuple[int, int, int, float], ...]

    @classmethod
    def regular(cls, shards: int, racks: int = 2, per_rack: int = 4) -> Tree:
        """Regions of ``racks`` racks of ``per_rack`` shards; shards beyond the last full region are regions of their own."""
        whole = shards - shards % (racks * per_rack)
        return cls(tuple((s, s // (racks * per_rack) if s < whole else s, s // per_rack if s < whole else s, 1.0) for s in range(shards)))

    def grow(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region and a rack of its own."""
        shard, region, rack = (max(n[k] for n in self.nodes) + 1 for k in range(3))
        return Tree((*self.nodes, (shard, region, rack, weight)))

    def children(self) -> dict[int, dict[int, list[tuple[int, float]]]]:
        out: dict[int, dict[int, list[tuple[int, float]]]] = {}
        for shard, region, rack, weight in self.nodes:
            out.setdefault(region, {}).setdefault(rack, []).append((shard, weight))
        return out


def _draw(key: Column, level: str, name: int, weight: float) -> Column:
    """53 bits of a 64-bit hash as a number in (0, 1), as an exponential of rate ``weight``."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def _pick(key: Column, level: str, options: list[tuple[int, float]]) -> Column:
    """The name of the child with the smallest draw."""
    if len(options) == 1:
        return F.lit(options[0][0])
    return F.array_min(F.array(*(F.struct(_draw(key, level, n, w).alias("d"), F.lit(n).alias("n")) for n, w in options)))["n"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of ``key``, as one JVM-side expression: draws at each level, only along the path taken."""
    regions = tree.children()

    def choose(by: Column, cases: dict[int, Column]) -> Column:
        if len(cases) == 1:
            return next(iter(cases.values()))
        out = None
        for name, then in cases.items():
            out = F.when(by == name, then) if out is None else out.when(by == name, then)
        return out

    region = _pick(key, "region", [(g, sum(w for r in racks.values() for _, w in r)) for g, racks in regions.items()])
    rack = choose(F.col("_region"), {g: _pick(key, "rack", [(k, sum(w for _, w in r)) for k, r in racks.items()]) for g, racks in regions.items()})
    shard = choose(F.col("_rack"), {k: _pick(key, "shard", r) for racks in regions.values() for k, r in racks.items()})
    return region, rack, shard


def with_shard(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """``df`` with the int column ``name``."""
    region, rack, shard = shard_of(key, tree)
    return df.withColumn("_region", region).withColumn("_rack", rack).withColumn(name, shard.cast("int")).drop("_region", "_rack")


def assign(spark: SparkSession, docs: DataFrame, tree: Tree, rows_per_bucket: int = 20_000) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot, grown_shard)`` of every document.

    ``size``: UTF-8 bytes of the text (null: none) plus 16; ``slot``: from 0
    without gaps in each shard, by counts of hash buckets and ranks inside
    them, so no shard is sorted in one task.  A null ``doc_id`` is a key like
    any other; rows that repeat a ``doc_id`` share its shard, with a slot each.
    An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = with_shard(with_shard(rows, F.col("doc_id"), tree, "shard"), F.col("doc_id"), tree.grow(), "grown_shard")
    rows = materialize(spark, rows, "sharded")
    n = max(1, rows.count() // (rows_per_bucket * len(tree.nodes)))
    # The crc parts rows that share one doc_id, be they ever so many.
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("slot")), F.lit(n)))
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    slotted = rows.withColumn("k", inside).join(base, ["shard", "bucket"])
    return slotted.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("k") - 1).alias("slot"), "grown_shard")
