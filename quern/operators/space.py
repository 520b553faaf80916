"""Sizes of encodings as column expressions, in whole numbers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floor_log2(x: Column) -> Column:
    """0 for 0 and 1."""
    return (F.length(F.bin(x)) - 1).cast("long")


def ceil_log2(x: Column) -> Column:
    return F.when(x <= 1, F.lit(0)).otherwise(F.length(F.bin(x - 1))).cast("long")


def context(most: Column) -> Column:
    """The selector of a block by its largest value."""
    return F.when(most <= 1, F.lit(0)).otherwise(ceil_log2(ceil_log2(most + 1))).cast("long")


def elias_fano(u: Column, n: Column) -> Column:
    low = F.when(u > n, floor_log2(F.floor(u / n))).otherwise(0)
    high = n + F.floor(u / F.pow(F.lit(2.0), low)) + 2
    return ((F.floor((high - n) / 512) + F.floor(n / 256)) * ceil_log2(high.cast("long")) + high + n * low).cast("long")


def strict_elias_fano(u: Column, n: Column) -> Column:
    return elias_fano(u - n + 1, n)


def bitmap(u: Column, n: Column) -> Column:
    return (F.floor(u / 512) * ceil_log2(n + 1) + F.floor(n / 256) * ceil_log2(u) + u).cast("long")


def indexed(u: Column, n: Column) -> Column:
    return F.when(u == n, F.lit(0)).otherwise(F.least(elias_fano(u, n), bitmap(u, n)) + 1).cast("long")


def gamma(n: Column) -> Column:
    return (2 * floor_log2(n + 1) + 1).cast("long")


def delta(n: Column) -> Column:
    k = floor_log2(n + 1)
    return (gamma(k) + k).cast("long")


def list_header(occurrences: Column) -> Column:
    return (gamma(occurrences - 1) + F.when(occurrences > 1, ceil_log2(occurrences + 1)).otherwise(0)).cast("long")


def vbyte(v: Column) -> Column:
    return F.when(v < 1 << 7, 1).when(v < 1 << 14, 2).when(v < 1 << 21, 3).when(v < 1 << 28, 4).otherwise(5).cast("long")


def group_bytes(v: Column) -> Column:
    return F.when(v < 1 << 8, 1).when(v < 1 << 16, 2).when(v < 1 << 24, 3).otherwise(4).cast("long")


def list_sizes(postings: DataFrame, n_docs: int) -> DataFrame:
    """Bits of every list of documents under each form: ``(term_id, n, ef, strict_ef, bitmap, indexed, header)``."""
    lists = postings.groupBy("term_id").agg(F.count("*").alias("n"), F.sum("freq").alias("cf"))
    u, n = F.lit(n_docs).cast("long"), F.col("n")
    return lists.select("term_id", "n", elias_fano(u, n).alias("ef"), strict_elias_fano(u, n).alias("strict_ef"), bitmap(u, n).alias("bitmap"), indexed(u, n).alias("indexed"), list_header(F.col("cf")).alias("header"))


def block_sizes(gapped: DataFrame, size: int = 256) -> DataFrame:
    """Bytes of the gap blocks under byte codes: ``(term_id, block_no, n, u32, vbyte, group, gamma_bits, delta_bits)``."""
    g, v = gapped.withColumn("block_no", F.expr(f"pos div {size}")), F.col("gap")
    keys = F.ceil(F.count("*") / 4)
    return g.groupBy("term_id", "block_no").agg(
        F.count("*").alias("n"), (F.count("*") * 4).alias("u32"), F.sum(vbyte(v)).alias("vbyte"), (keys + F.sum(group_bytes(v))).cast("long").alias("group_bytes"),
        F.sum(gamma(v)).alias("gamma_bits"), F.sum(delta(v)).alias("delta_bits"),
    )


def block_list_bytes(blocks: DataFrame) -> DataFrame:
    """``(term_id, n, blocks, bytes)`` of vbyte block lists: count, block maxima, endpoints, payload."""
    per_list = blocks.groupBy("term_id").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), F.sum("vbyte").alias("payload"))
    return per_list.select("term_id", "n", "blocks", (vbyte(F.col("n")) + 4 * F.col("blocks") + 4 * (F.col("blocks") - 1) + F.col("payload")).alias("bytes"))
