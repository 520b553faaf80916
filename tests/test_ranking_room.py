"""What ranked queries shuffle."""

import re

from pyspark.sql import functions as F

from quern.operators import ranking


def batch(spark):
    p = spark.range(4000).select((F.col("id") % 20).alias("term_id"), F.expr("id div 20").alias("doc_id"), (F.col("id") % 3 + 1).alias("freq")).where("(term_id + doc_id) % 3 <> 0")
    docs = spark.range(200).select(F.col("id").alias("doc_id"), (0.5 + F.col("id") % 7 / 4).alias("norm_len"))
    queries = spark.range(120).select((F.col("id") % 12).alias("query_id"), (F.col("id") * 7 % 23).alias("term_id"))
    return p, docs, queries


def test_candidates_meet_their_terms_without_a_shuffle(spark):
    p, docs, queries = batch(spark)
    for op in (ranking.maxscore, ranking.ranked_or):
        plan = op(p, docs, queries, 200)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan)


def test_many_terms_give_the_same(spark, monkeypatch):
    p, docs, queries = batch(spark)
    rows = lambda op: sorted(map(tuple, op(p, docs, queries, 200, 3).collect()))
    few = [rows(op) for op in (ranking.ranked_or, ranking.maxscore, ranking.wand)]
    monkeypatch.setattr(ranking, "FEW", 0)
    assert few == [rows(op) for op in (ranking.ranked_or, ranking.maxscore, ranking.wand)]
    assert few[0] == few[1] == few[2] and few[0]
