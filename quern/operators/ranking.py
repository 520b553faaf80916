"""BM25 top-k over a batch of queries: conjunctive, disjunctive, and pruned forms with the same answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.stored import store

B, K1 = 0.5, 1.2

#: Query terms that may go to all tasks: about 20 MB.
FEW = 200_000


def doc_weight(freq: Column, norm_len: Column) -> Column:
    return freq / (freq + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * norm_len))


def query_weight(qtf: Column, df: Column, n_docs: int) -> Column:
    odds = (F.lit(float(n_docs)) - df + F.lit(0.5)) / (df + F.lit(0.5))
    return qtf * F.greatest(F.lit(1e-6), F.log(odds)) * F.lit(1.0 + K1)


def query_freqs(queries: DataFrame) -> DataFrame:
    """The multiset as ``(query_id, term_id, qtf)``."""
    return queries.groupBy("query_id", "term_id").agg(F.count("*").alias("qtf"))


def weighted(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings with ``weight``, the part of a score that does not depend on the query."""
    return postings.join(docs.select("doc_id", "norm_len"), "doc_id").select("term_id", "doc_id", "freq", doc_weight(F.col("freq"), F.col("norm_len")).alias("weight"))


def term_stats(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """``(term_id, df, cf, max_weight)``"""
    return weighted(postings, docs).groupBy("term_id").agg(F.count("*").alias("df"), F.sum("freq").alias("cf"), F.max("weight").alias("max_weight"))


def _terms_of(queries: DataFrame, postings: DataFrame, n_docs: int) -> DataFrame:
    """``(query_id, term_id, qw)``; unknown terms have no list and go, so only the lists asked for are counted."""
    asked = query_freqs(queries)
    df = postings.join(asked.select("term_id").distinct(), "term_id", "left_semi").groupBy("term_id").agg(F.count("*").alias("df"))
    return asked.join(df, "term_id").select("query_id", "term_id", query_weight(F.col("qtf"), F.col("df"), n_docs).alias("qw"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query: ``(query_id, rank, doc_id, score)``; equal scores go by document."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _parts(terms: DataFrame, postings: DataFrame, docs: DataFrame) -> DataFrame:
    """``terms`` with ``doc_id`` and ``part``, what the term adds to the document's score.

    A word that many queries ask for has a row for each of them and each document of its list.  So
    where the terms are few, the lists go to the documents first, and the terms meet them there:
    what is summed by query and document is not shuffled any more.  ``terms`` should be a stored table.
    """
    part = F.col("qw") * doc_weight(F.col("freq"), F.col("norm_len"))
    lengths = docs.select("doc_id", "norm_len")
    if terms.limit(FEW + 1).count() > FEW:
        met = terms.join(postings, "term_id").join(lengths, "doc_id")
    else:
        lists = postings.join(F.broadcast(terms.select("term_id").distinct()), "term_id", "left_semi")
        met = lists.repartition("doc_id").join(lengths.hint("merge"), "doc_id").join(F.broadcast(terms), "term_id")
    return met.select(*terms.columns, "doc_id", part.alias("part"))


def _stored(postings: DataFrame, terms: DataFrame) -> DataFrame:
    return store(postings.sparkSession, terms, "query_terms", free=True)


def _scores(terms: DataFrame, postings: DataFrame, docs: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score, hits)``"""
    return _parts(terms, postings, docs).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("hits"))


def ranked_or(postings: DataFrame, docs: DataFrame, queries: DataFrame, n_docs: int, k: int = 10) -> DataFrame:
    """Disjunctive top-k: documents with any term."""
    return top(_scores(_stored(postings, _terms_of(queries, postings, n_docs)), postings, docs), k)


def ranked_and(postings: DataFrame, docs: DataFrame, queries: DataFrame, n_docs: int, k: int = 10) -> DataFrame:
    """Conjunctive top-k: documents with all terms; an unknown term leaves none."""
    asked = query_freqs(queries).groupBy("query_id").agg(F.count("*").alias("asked"))
    scored = _scores(_stored(postings, _terms_of(queries, postings, n_docs)), postings, docs).join(asked, "query_id").where("hits = asked")
    return top(scored, k)


def _bounded(postings: DataFrame, docs: DataFrame, queries: DataFrame, n_docs: int) -> DataFrame:
    """Query terms with ``ub``, the most that a term can add to a score; stored, as several parts of a query read them."""
    terms = _terms_of(queries, postings, n_docs)
    most = term_stats(postings.join(terms.select("term_id").distinct(), "term_id", "left_semi"), docs).select("term_id", "max_weight")
    return _stored(postings, terms.join(most, "term_id").withColumn("ub", F.col("qw") * F.col("max_weight")))


def maxscore(postings: DataFrame, docs: DataFrame, queries: DataFrame, n_docs: int, k: int = 10, slack: float = 1e-5) -> DataFrame:
    """Disjunctive top-k by essential lists.

    A query's threshold is the k-th best score from its strongest term alone.
    Terms whose bounds sum to less, weakest first, cannot lift a
    document over it: candidates come from the other lists only.  A candidate is told where
    its parts are summed, so it is not shuffled to meet its terms.
    """
    terms = _bounded(postings, docs, queries, n_docs)
    strongest = terms.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ub"), "term_id"))).where("r = 1")
    alone = top(_scores(strongest, postings, docs).drop("hits"), k).where(F.col("rank") == k)
    threshold = alone.select("query_id", F.col("score").alias("theta"))
    rising = Window.partitionBy("query_id").orderBy("ub", "term_id").rowsBetween(Window.unboundedPreceding, 0)
    essential = terms.withColumn("reach", F.sum("ub").over(rising)).join(threshold, "query_id", "left").where(F.col("theta").isNull() | (F.col("reach") >= F.col("theta") - slack))
    marked = _stored(postings, terms.join(essential.select("query_id", "term_id", F.lit(True).alias("essential")), ["query_id", "term_id"], "left").select("query_id", "term_id", "qw", "essential"))
    scored = _parts(marked, postings, docs).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"), F.max("essential").alias("essential"))
    return top(scored.where("essential").drop("essential"), k)


def wand(postings: DataFrame, docs: DataFrame, queries: DataFrame, n_docs: int, k: int = 10, slack: float = 1e-5) -> DataFrame:
    """Disjunctive top-k by document bounds: a document is scored only if the bounds of its terms reach the threshold."""
    terms = _bounded(postings, docs, queries, n_docs)
    strongest = terms.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ub"), "term_id"))).where("r = 1")
    threshold = top(_scores(strongest, postings, docs).drop("hits"), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("theta"))
    met = terms.join(postings, "term_id")
    bound = met.groupBy("query_id", "doc_id").agg(F.sum("ub").alias("ub"), F.collect_list(F.struct("qw", "freq")).alias("parts"))
    live = bound.join(threshold, "query_id", "left").where(F.col("theta").isNull() | (F.col("ub") >= F.col("theta") - slack))
    scored = live.join(docs.select("doc_id", "norm_len"), "doc_id")
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["qw"] * doc_weight(p["freq"], F.col("norm_len")))
    return top(scored.select("query_id", "doc_id", F.round(total, 6).alias("score")), k)
