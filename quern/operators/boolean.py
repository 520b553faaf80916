"""Boolean retrieval over a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _met(postings: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    terms = queries.dropDuplicates(["query_id", "term_id"])
    return terms, terms.join(postings, "term_id")


def and_docs(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, doc_id, freq)`` of documents with all distinct terms; ``freq`` sums the terms'."""
    terms, met = _met(postings, queries)
    asked = terms.groupBy("query_id").agg(F.count("*").alias("asked"))
    return met.groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"), F.sum("freq").alias("freq")).join(asked, "query_id").where("hits = asked").select("query_id", "doc_id", "freq")


def or_docs(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, doc_id, freq)`` of documents with any term."""
    return _met(postings, queries)[1].groupBy("query_id", "doc_id").agg(F.sum("freq").alias("freq"))


def counts(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, results)``, 0 where no document matches."""
    n = docs.groupBy("query_id").agg(F.count("*").alias("results"))
    return queries.select("query_id").distinct().join(n, "query_id", "left").select("query_id", F.coalesce("results", F.lit(0)).alias("results"))


def intersect_pairs(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(query_id, doc_id)`` in both lists of each pair ``(query_id, a, b)``; a list with itself gives itself."""
    left = pairs.join(postings.select(F.col("term_id").alias("a"), "doc_id"), "a").select("query_id", "b", "doc_id")
    return left.join(postings.select(F.col("term_id").alias("b"), "doc_id"), ["b", "doc_id"]).select("query_id", "doc_id")
