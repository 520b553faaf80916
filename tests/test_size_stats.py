"""Sizes under all codes from one pass over the distinct blocks."""

from pyspark.sql import functions as F

from quern.functions.codecs import CODECS
from quern.operators import layout, stats


def test_all_sizes_in_one_pass(spark, monkeypatch):
    p = spark.range(900).select((F.col("id") % 3).alias("term_id"), (F.expr("id div 3") * (1 + F.col("id") % 3)).alias("doc_id"), F.lit(1).cast("long").alias("freq"))
    laid = layout.blocks(p).cache()
    all_codes = stats.size_stats_of_all(laid)
    assert all_codes._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 4  # two, printed once or twice; was one for each code
    got = {r.codec: tuple(r) for r in all_codes.collect()}
    assert set(got) == set(CODECS)
    for codec in ("vbyte", "interpolative", "mixed"):
        assert got[codec] == tuple(stats.size_stats(layout.encode(laid, codec)).first())
