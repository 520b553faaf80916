"""From documents to packed sequences, in five stages of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontamination, ngram_join, packing, suffix_dedup, toxicity
from quern.llm.common import materialize
from quern.llm.queries import table, vocabulary


#: Bytes of a repeated string, about 45 words of prose: passages of over 50 words that documents share are caught.
REPEATED_BYTES = 256


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.keep_clean(spark, docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram links join."""
    return ngram_join.keep_first(spark, docs, 5, 80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``REPEATED_BYTES`` that start elsewhere too."""
    return suffix_dedup.remove(spark, docs, REPEATED_BYTES)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents go that are benchmark for more than half."""
    return decontamination.remove(spark, docs, table(spark, sf_dir, "benchmark"), 10, 0.5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, placed in sequences of 4096 ids."""
    packed = packing.pack(spark, docs, vocabulary("word_bpe_49k.json"), 2, 4096)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: No SQL expresses these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return docs
