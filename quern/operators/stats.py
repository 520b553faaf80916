"""Statistics of lists, blocks, encoded tables, latencies and query traffic."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.codecs import CODECS, MIXED
from quern.functions.ship import ship


def values_statistics(gapped: DataFrame, size: int = 256) -> DataFrame:
    """Of each gap block: ``(term_id, block_no, n, entropy, sum_of_logs, nonzeros, max_b)``."""
    g = gapped.withColumn("block_no", F.expr(f"pos div {size}"))
    groups = g.groupBy("term_id", "block_no", "gap").agg(F.count("*").alias("g"))
    total = F.sum("g").over(Window.partitionBy("term_id", "block_no"))
    e = groups.withColumn("n", total)
    return e.groupBy("term_id", "block_no").agg(
        F.max("n").alias("n"), F.round(F.sum(F.col("g") * F.log2(F.col("n") / F.col("g"))), 6).alias("entropy"), F.round(F.sum(F.col("g") * F.log2(F.col("gap").cast("double") + 1)), 6).alias("sum_of_logs"),
        F.sum(F.when(F.col("gap") > 0, F.col("g")).otherwise(0)).alias("nonzeros"), F.max(F.when(F.col("gap") > 0, F.length(F.bin("gap"))).otherwise(0)).cast("long").alias("max_b"),
    )


def size_stats(index: DataFrame) -> DataFrame:
    """``(codec, postings, docs_bytes, freqs_bytes, bits_per_doc, bits_per_freq)`` of an index table; document bytes hold the headers too."""
    lists = index.groupBy("codec", "term_id").agg(F.sum("n").alias("n"), F.count("*").alias("b"), F.sum(F.octet_length("docs")).alias("d"), F.sum(F.octet_length("freqs")).alias("f"))
    from .space import vbyte

    head = vbyte(F.col("n")) + 8 * F.col("b") - 4
    return lists.groupBy("codec").agg(F.sum("n").alias("postings"), F.sum(F.col("d") + head).alias("docs_bytes"), F.sum("f").alias("freqs_bytes")).select(
        "codec", "postings", "docs_bytes", "freqs_bytes", (F.col("docs_bytes") * 8 / F.col("postings")).alias("bits_per_doc"), (F.col("freqs_bytes") * 8 / F.col("postings")).alias("bits_per_freq")
    )


def size_stats_of_all(laid: DataFrame, dictionaries: dict | None = None) -> DataFrame:
    """The rows of ``size_stats`` of ``laid`` under every code and the dictionary codes given (name: a broadcast of {"docs", "freqs"}).

    A block's size depends on its values alone, so equal blocks are encoded once; each is
    encoded by all codes in one pass that returns sums.  ``laid`` should be a stored table.
    """
    from .space import vbyte

    ship(laid.sparkSession)
    coded = {} if dictionaries is None else dictionaries
    single = [c for c in CODECS if c != "mixed"]

    def sizes(kind: str, values: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for b in batches:
                for v, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    block = np.array(v, np.int64)
                    known = int(block.sum()) if kind == "docs" else None
                    size = {c: len(CODECS[c].encode(block, known)) for c in single}
                    size["mixed"] = 1 + min(size[c] for c in MIXED)  # a byte that tells the code
                    size |= {c: len(d.value[kind].encode(block)) for c, d in coded.items()}
                    for c, n in size.items():
                        total[c] += n * times
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["codec", "bytes"])

        # Blocks differ in cost, not in number: small parts for all workers.
        distinct = laid.groupBy(values).agg(F.count("*").alias("times")).repartition(8 * laid.sparkSession.sparkContext.defaultParallelism)
        return distinct.mapInArrow(run, "codec string, bytes long").groupBy("codec").agg(F.sum("bytes").alias(f"{kind}_bytes"))

    lists = laid.groupBy("term_id").agg(F.sum("n").alias("n"), F.count("*").alias("b"))
    heads = lists.agg(F.sum("n").alias("postings"), F.sum(vbyte(F.col("n")) + 8 * F.col("b") - 4).alias("head"))
    both = sizes("docs", "gaps").join(sizes("freqs", "fbias"), "codec").crossJoin(heads).withColumn("docs_bytes", F.col("docs_bytes") + F.col("head"))
    return both.select("codec", "postings", "docs_bytes", "freqs_bytes", *((8 * F.col(f"{k}s_bytes") / F.col("postings")).alias(f"bits_per_{k}") for k in ("doc", "freq")))


def throughput(index: DataFrame, decoded: DataFrame) -> DataFrame:
    """``(lists, postings, bytes, bits_per_int, seconds, ns_per_int, ints_per_second)``: one run of ``decoded`` by the clock.

    ``index`` should be a stored table, so that encoding is not timed.  A posting is two integers.
    """
    start = time.perf_counter()
    decoded.write.format("noop").mode("overwrite").save()
    seconds = F.lit(time.perf_counter() - start)
    sizes = index.agg(F.countDistinct("term_id").alias("lists"), F.sum("n").alias("postings"), F.sum(F.octet_length("docs") + F.octet_length("freqs")).cast("long").alias("bytes"))
    ints = 2 * F.col("postings")
    return sizes.select("*", (8 * F.col("bytes") / ints).alias("bits_per_int"), seconds.alias("seconds"), (seconds * 1e9 / ints).alias("ns_per_int"), (ints / seconds).alias("ints_per_second"))


def latency(times: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, runs, mean, q50, q90, q95)``: quantiles are the sorted values at floor(p n / 100), not interpolated."""
    order = Window.partitionBy(key).orderBy(value)
    ranked = times.select(key, value, (F.row_number().over(order) - 1).alias("k"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    at = lambda p: F.max(F.when(F.col("k") == F.expr(f"{p} * n div 100"), F.col(value)))
    return ranked.groupBy(key).agg(F.count("*").alias("runs"), F.round(F.avg(value), 6).alias("mean"), at(50).alias("q50"), at(90).alias("q90"), at(95).alias("q95"))


def block_profile(laid: DataFrame, queries: DataFrame, postings: DataFrame) -> DataFrame:
    """Blocks that a conjunctive query has to open: ``(term_id, block_no, touched)``.

    The shortest list of a query leads; each of its documents opens, in every
    other list, the first block whose maximum is not below it.  Lists and probes are
    merged in document order, not joined by range.
    """
    terms = queries.dropDuplicates(["query_id", "term_id"])
    sizes = laid.join(terms.select("term_id").distinct(), "term_id", "left_semi").groupBy("term_id").agg(F.sum("n").alias("df"))
    ranked = terms.join(sizes, "term_id").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term_id")))
    lead = ranked.where("r = 1").select("query_id", F.col("term_id").alias("lead"))
    probes = ranked.where("r > 1").join(lead, "query_id").join(postings.select(F.col("term_id").alias("lead"), "doc_id"), "lead")
    probes = probes.groupBy("term_id", "doc_id").agg(F.count("*").alias("times"))
    both = probes.select("term_id", F.col("doc_id").alias("at"), F.lit(0).alias("kind"), "times", F.lit(None).cast("long").alias("block_no")).unionByName(
        laid.select("term_id", F.col("block_max").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("times"), "block_no")
    )
    ahead = Window.partitionBy("term_id").orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    hit = both.withColumn("b", F.first("block_no", ignorenulls=True).over(ahead)).where("kind = 0 and b is not null")
    return hit.groupBy("term_id", F.col("b").alias("block_no")).agg(F.sum("times").alias("touched"))
