"""Stored tables: indexes, dictionaries, statistics, profiles, sequences; and one-line reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.functions.dictcodec import Dictionary, MultiDictionary


def freeze(index: DataFrame, path: str) -> None:
    """Store an index table so that a term's blocks lie together, with its range in the file statistics."""
    index.repartitionByRange("term_id").sortWithinPartitions("term_id", "block_no").write.mode("overwrite").parquet(path)


def open_index(spark: SparkSession, path: str, terms: list[int] | None = None) -> DataFrame:
    """A stored index; with ``terms`` only their row groups are read."""
    df = spark.read.parquet(path)
    return df if terms is None else df.where(F.col("term_id").isin(terms))


def warm_up(index: DataFrame) -> int:
    """Keep the blocks in memory; returns how many."""
    return index.cache().count()


def append(left: DataFrame, right: DataFrame) -> DataFrame:
    """The lists of two collections; those of ``right`` follow."""
    base = (left.agg(F.max("term_id")).first()[0] or 0) + 1 if left.take(1) else 0
    return left.unionByName(right.withColumn("term_id", F.col("term_id") + base))


def store_dictionaries(spark: SparkSession, dictionaries: dict, path: str) -> None:
    rows = []
    for kind, d in dictionaries.items():
        for k, part in enumerate(d.parts if isinstance(d, MultiDictionary) else [d]):
            rows += [(kind, k, i, len(e), list(e)) for i, e in enumerate(part.entries)]
    spark.createDataFrame(rows, "kind string, dict_id int, code int, size int, entry array<long>").write.mode("overwrite").parquet(path)


def load_dictionaries(spark: SparkSession, path: str) -> dict:
    """What ``store_dictionaries`` kept; entries are bounded by what symbols can name."""
    found: dict[str, dict[int, list]] = {}
    for r in spark.read.parquet(path).orderBy("kind", "dict_id", "code").collect():
        found.setdefault(r.kind, {}).setdefault(r.dict_id, []).append(tuple(r.entry))
    multi = any(max(parts) > 0 for parts in found.values())
    return {k: MultiDictionary([parts.get(i, []) for i in range(max(parts) + 1)]) if multi else Dictionary(parts[0]) for k, parts in found.items()}


def store_statistics(patterns: DataFrame, total: int, path: str) -> None:
    """Keep counted patterns ``([context,] entry, freq)`` of ``total`` values, the frequent ones first."""
    order = [F.desc("freq"), F.desc(F.size("entry")), F.col("entry")]
    patterns.withColumn("total", F.lit(total).cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def load_statistics(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """What ``store_statistics`` kept; with ``most`` only the first so many by frequency, size and entry."""
    df = spark.read.parquet(path)
    return df if most is None else df.orderBy(F.desc("freq"), F.desc(F.size("entry")), "entry").limit(most)


def or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``, built by ``build()`` if there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def write_profile(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").csv(path, sep="\t", header=False)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="term_id long, block_no long, touched long")


def pack_sequences(rows: DataFrame) -> DataFrame:
    """``(seq_id, n, universe, values)`` from ``(seq_id, pos, value)``."""
    packed = rows.groupBy("seq_id").agg(F.count("*").alias("n"), (F.max("value") + 1).alias("universe"), F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("p"))
    return packed.select("seq_id", "n", "universe", F.col("p.value").alias("values"))


def get(sequences: DataFrame, seq_id: int) -> DataFrame:
    return sequences.where(F.col("seq_id") == seq_id)


def stats_line(df: DataFrame) -> DataFrame:
    """Each row as one line of JSON."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def counted(df: DataFrame, term: str = "term_id") -> tuple[DataFrame, Observation]:
    """``df``, and what will be known once it has run: postings and distinct lists (approximate)."""
    seen = Observation()
    return df.observe(seen, F.count("*").alias("postings"), F.approx_count_distinct(term).alias("lists")), seen


def report(**values) -> str:
    return json.dumps(values, sort_keys=True)
