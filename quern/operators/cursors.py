"""What a cursor over a list does, for batches of lists and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import layout


def in_list_order():
    return Window.partitionBy("term_id").orderBy("doc_id")


def _ranges(postings: DataFrame, range_bits: int) -> DataFrame:
    """``(term_id, range, n, first)`` of the ranges of documents that a list has postings in."""
    return postings.groupBy("term_id", F.shiftright("doc_id", range_bits).alias("range")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def walk(postings: DataFrame, n_docs: int, range_bits: int = layout.RANGE_BITS) -> DataFrame:
    """Every step of a cursor: ``(term_id, pos, doc_id, next_doc, prev_value)``.

    After the last document comes ``n_docs``; before the first, 0.  Lists are walked by ranges of documents, and the
    first document of the next range joins them.
    """
    stepped = layout.gaps(postings, range_bits).withColumn("range", F.shiftright("doc_id", range_bits))
    over = Window.partitionBy("term_id").orderBy("range")
    after = _ranges(postings, range_bits).select("term_id", "range", F.lead("first").over(over).alias("then"))
    inside = F.lead("doc_id").over(Window.partitionBy("term_id", "range").orderBy("doc_id"))
    stepped = stepped.withColumn("next", inside).join(after, ["term_id", "range"])
    return stepped.select(
        "term_id", F.col("pos").cast("long").alias("pos"), "doc_id", F.coalesce("next", "then", F.lit(n_docs).cast("long")).alias("next_doc"),
        F.greatest(F.col("prev"), F.lit(0)).cast("long").alias("prev_value"),
    )


def next_geq(postings: DataFrame, probes: DataFrame, n_docs: int, range_bits: int = layout.RANGE_BITS) -> DataFrame:
    """``(term_id, x, next_geq, rank)`` for probes ``(term_id, x)``: the least document not below x (``n_docs`` if none), and how many are below.

    Probes and postings are merged in the order of documents inside a range; what earlier and later ranges hold comes from their counts.
    """
    both = postings.select("term_id", F.col("doc_id").alias("at"), F.lit(1).alias("kind"), F.col("doc_id").alias("doc")).unionByName(
        probes.distinct().select("term_id", F.col("x").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc"))
    )
    both = both.withColumn("range", F.shiftright("at", range_bits))
    inside = Window.partitionBy("term_id", "range").orderBy("at", "kind")
    later = F.first("doc", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    below = F.count("doc").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("n", later).withColumn("r", below).where("kind = 0").select("term_id", "range", "at", "n", "r")
    held = both.groupBy("term_id", "range").agg(F.count("doc").alias("n"), F.min("doc").alias("first"))
    over = Window.partitionBy("term_id").orderBy("range")
    around = held.select(
        "term_id", "range", F.min("first").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("then"),
        F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    found = found.join(around, ["term_id", "range"])
    return found.select("term_id", F.col("at").alias("x"), F.coalesce("n", "then", F.lit(n_docs).cast("long")).alias("next_geq"), (F.col("before") + F.col("r")).alias("rank"))


def move(postings: DataFrame, positions: DataFrame) -> DataFrame:
    """``(term_id, pos, doc_id, freq)`` at the given positions."""
    ranked = layout.gaps(postings).select("term_id", F.col("pos").cast("long").alias("pos"), "doc_id", "freq")
    return ranked.join(positions, ["term_id", "pos"]).select("term_id", "pos", "doc_id", "freq")


def bitmap(postings: DataFrame) -> DataFrame:
    """``(term_id, word, bits)``: the lists as bits, 64 documents to a word; words without a document are left out."""
    bit = F.expr("shiftleft(1L, cast(doc_id & 63 as int))")
    return postings.groupBy("term_id", F.shiftright("doc_id", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def bitmap_rank(words: DataFrame, probes: DataFrame, range_bits: int = layout.RANGE_BITS) -> DataFrame:
    """``(term_id, x, rank)`` for probes ``(term_id, x)``: how many documents of the list are below x.

    A rank is a count for the ranges before, one for the words before in the range, and the
    bits below x in its own word.  ``range_bits`` is 6 at least.
    """
    probe = probes.distinct().select("term_id", F.shiftright("x", 6).alias("word"), F.lit(None).cast("long").alias("bits"), "x")
    both = words.select("term_id", "word", "bits", F.lit(None).cast("long").alias("x")).unionByName(probe).withColumn("range", F.shiftright("word", range_bits - 6))
    ones = F.coalesce(F.bit_count("bits"), F.lit(0)).cast("long")
    earlier = Window.partitionBy("term_id", "range").orderBy("word").rangeBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("term_id", "range", "word")
    found = both.withColumn("inside", F.coalesce(F.sum(ones).over(earlier), F.lit(0))).withColumn("held", F.max("bits").over(own)).where("x is not null")
    over = Window.partitionBy("term_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    samples = both.groupBy("term_id", "range").agg(F.sum(ones).alias("n")).select("term_id", "range", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    below = F.expr("bit_count(coalesce(held, 0L) & ~shiftleft(-1L, cast(x & 63 as int)))")
    return found.join(samples, ["term_id", "range"]).select("term_id", "x", (F.col("before") + F.col("inside") + below).alias("rank"))
