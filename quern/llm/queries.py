"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    packed = packing.pack(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2, 4096)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    rows = sharding.assign(spark, table(spark, sf_dir, "documents"), sharding.Tree.regular(40))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    out = simhash.fingerprint_edits(spark, table(spark, sf_dir, "documents"))
    name = simhash.fingerprint_text
    return out.select("doc_id", "n_chars", "edited_sha256", name(F.col("fp")).alias("fingerprint"), name(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near")


def _removed(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    out = suffix_dedup.dedup(spark, table(spark, sf_dir, "documents"), 400, passage=256)
    # Passages of over 50 words can have fewer than 400 bytes; they are counted beside what goes.
    return out.select(
        "doc_id", "n_bytes", _removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), _removed("passages").alias("n_repeated"),
    )


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.known_table(spark))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    out = substring_dedup.dedup(spark, table(spark, sf_dir, "documents"), 20)
    return out.select("doc_id", "n_words", _removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.score(spark, docs, model).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.link_components(spark, table(spark, sf_dir, "documents"), 5, 80)


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts

    return token_counts.count_tokens(spark, table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), 4096)


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontamination

    found = decontamination.find(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    n_hit = _removed()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest",
    )


def _oracles() -> None:
    from . import license_scan

    ORACLE_SQL["op8_license_scan"] = license_scan.oracle()


_oracles()
