"""Physical layouts of postings: gaps, fixed blocks, partitions, and encoded index tables.

Lists are cut by document ranges before they are ordered, so a term that fills
the collection is handled by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import partitions
from quern.functions.codecs import CODECS
from quern.functions.dictcodec import Dictionary, MultiDictionary
from quern.functions.ship import ship

BLOCK = 256
RANGE_BITS = 22


def gaps(postings: DataFrame, range_bits: int = RANGE_BITS) -> DataFrame:
    """``(term_id, doc_id, freq, pos, prev, gap, fbias)``: place in the list, document before (-1: none), gap less 1, frequency less 1."""
    ranged = postings.withColumn("range", F.shiftright("doc_id", range_bits))
    ends = ranged.groupBy("term_id", "range").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    earlier = Window.partitionBy("term_id").orderBy("range")
    before = ends.select(
        "term_id", "range", F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.coalesce(F.lag("last").over(earlier), F.lit(-1)).alias("last"),
    )
    inside = Window.partitionBy("term_id", "range").orderBy("doc_id")
    placed = ranged.withColumn("k", F.row_number().over(inside) - 1).withColumn("lag", F.lag("doc_id").over(inside)).join(before, ["term_id", "range"])
    prev = F.coalesce("lag", "last")
    return placed.select("term_id", "doc_id", "freq", (F.col("base") + F.col("k")).alias("pos"), prev.alias("prev"), (F.col("doc_id") - prev - 1).alias("gap"), (F.col("freq") - 1).alias("fbias"))


def from_gaps(gapped: DataFrame, run: int = 1 << 16) -> DataFrame:
    """Postings from ``(term_id, pos, gap, fbias)``; a list is summed up in runs of ``run`` places."""
    placed = gapped.withColumn("run", F.expr(f"pos div {run}"))
    sums = placed.groupBy("term_id", "run").agg(F.sum(F.col("gap") + 1).alias("s"))
    earlier = Window.partitionBy("term_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("term_id", "run", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("term_id", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("s", F.sum(F.col("gap") + 1).over(inside)).join(before, ["term_id", "run"])
    return summed.select("term_id", (F.col("before") + F.col("s") - 1).alias("doc_id"), (F.col("fbias") + 1).alias("freq"))


def blocks(postings: DataFrame, size: int = BLOCK, range_bits: int = RANGE_BITS) -> DataFrame:
    """``(term_id, block_no, n, block_base, block_max, docs_universe, gaps, fbias)``.

    ``block_base`` is the first document a block may hold; ``docs_universe`` is the sum of its gaps.
    """
    g = gaps(postings, range_bits).withColumn("block_no", F.expr(f"pos div {size}"))
    packed = g.groupBy("term_id", "block_no").agg(
        F.count("*").alias("n"), (F.min("prev") + 1).alias("block_base"), F.max("doc_id").alias("block_max"), F.sum("gap").alias("docs_universe"),
        F.array_sort(F.collect_list(F.struct("pos", "gap", "fbias"))).alias("p"),
    )
    return packed.select("term_id", "block_no", "n", "block_base", "block_max", "docs_universe", F.col("p.gap").alias("gaps"), F.col("p.fbias").alias("fbias"))


INDEX = "term_id long, block_no long, n long, block_base long, block_max long, docs_universe long, codec string, docs binary, freqs binary"


def _encode(name: str, known: bool, dictionaries=None):
    if name in CODECS:
        c = CODECS[name]
        return lambda v, total, kind: c.encode(v, total if known else None)
    if name == "single_greedy":
        return lambda v, total, kind: dictionaries.value[kind].encode(v, optimal=False)
    return lambda v, total, kind: dictionaries.value[kind].encode(v)


def encode(laid: DataFrame, codec: str, dictionaries=None) -> DataFrame:
    """The index table of blocks: gap blocks with a known sum, frequency blocks without, under one code.

    ``dictionaries``, for the dictionary codes: a broadcast of {"docs", "freqs"} to a dictionary.
    """
    ship(laid.sparkSession)
    put = _encode(codec, True, dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column(5).to_pylist()
            docs = [put(np.array(v, np.int64), t, "docs") for v, t in zip(b.column(6).to_pylist(), total, strict=True)]
            freqs = [put(np.array(v, np.int64), None, "freqs") for v in b.column(7).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array([codec] * b.num_rows, pa.string()), pa.array(docs, pa.binary()), pa.array(freqs, pa.binary())], names=[x.split()[0] for x in INDEX.split(", ")])

    return laid.select("term_id", "block_no", "n", "block_base", "block_max", "docs_universe", "gaps", "fbias").mapInArrow(run, INDEX)


def decode(index: DataFrame, dictionaries=None) -> DataFrame:
    """Postings from an index table; each block by itself, from its base."""
    ship(index.sparkSession)

    def take(name: str, data: bytes, n: int, total: int | None, kind: str) -> np.ndarray:
        if name in CODECS:
            return CODECS[name].decode(data, n, total)
        return dictionaries.value[kind].decode(data, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            none = [np.zeros(0, np.int64)]
            terms, docs, freqs = none[:], none[:], none[:]
            for term, n, base, total, name, d, f in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 5, 6, 7, 8)), strict=True):
                docs.append(base - 1 + np.cumsum(take(name, d, n, total, "docs") + 1))
                freqs.append(take(name, f, n, None, "freqs") + 1)
                terms.append(np.full(n, term, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (terms, docs, freqs)], names=["term_id", "doc_id", "freq"])

    return index.mapInArrow(run, "term_id long, doc_id long, freq long")


def uniform_parts(postings: DataFrame, log_size: int = 7) -> DataFrame:
    """``(term_id, part_no, n, base, upper)``: slices of 2**log_size documents, rebased on the one before."""
    g = gaps(postings).withColumn("part_no", F.shiftright(F.col("pos").cast("long"), log_size))
    return g.groupBy("term_id", "part_no").agg(F.count("*").alias("n"), (F.min("prev") + 1).alias("base"), F.max("doc_id").alias("upper"))


PARTS = "term_id long, part_no long, n long, base long, upper long, form string, payload binary"


def optimal_parts(postings: DataFrame, fixed: int = 64, run_length: int = 1 << 16) -> DataFrame:
    """Cost-optimal partitions, encoded; a list is handled in runs of ``run_length`` documents at most, so no list is one task's alone."""
    ship(postings.sparkSession)
    runs = gaps(postings).withColumn("run", F.expr(f"pos div {run_length}")).groupBy("term_id", "run").agg(F.min("prev").alias("prev"), F.array_sort(F.collect_list("doc_id")).alias("docs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for term, r, prev, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                v = np.array(docs, np.int64) - prev - 1
                for k, (n, base, upper, form, payload) in enumerate(partitions.encode_parts(v, partitions.partition(v, fixed))):
                    rows.append((term, r * run_length + k, n, base + prev + 1, upper + prev + 1, form, payload))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PARTS.split(", ")])

    return runs.select("term_id", "run", "prev", "docs").mapInArrow(run, PARTS)


def decode_parts(parts: DataFrame) -> DataFrame:
    """``(term_id, doc_id)`` from partitions."""
    ship(parts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [partitions.decode_part(*x) for x in zip(*(b.column(k).to_pylist() for k in range(2, 7)), strict=True)]
            terms = np.repeat(b.column(0).to_numpy(), [len(x) for x in got])
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.concatenate([np.zeros(0, np.int64), *got]))], names=["term_id", "doc_id"])

    return parts.mapInArrow(run, "term_id long, doc_id long")


def verify(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, counted: ``(missing, extra)``, both 0 if the sides are equal as multisets."""
    missing = left.exceptAll(right).agg(F.count("*").alias("missing")).withColumn("one", F.lit(1))
    extra = right.exceptAll(left).agg(F.count("*").alias("extra")).withColumn("one", F.lit(1))
    return missing.join(extra, "one").drop("one")


__all__ = ["Dictionary", "MultiDictionary", "blocks", "decode", "decode_parts", "encode", "from_gaps", "gaps", "optimal_parts", "uniform_parts", "verify"]
