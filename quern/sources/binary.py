"""Binary collections of integer sequences, and text query logs.

A file is a run of sequences, each a 32-bit little-endian length and as many
32-bit values.  ``.docs`` starts with the single value N, then has one list of
documents per term; ``.freqs`` has the aligned frequencies; ``.sizes`` has one
sequence, the document lengths.  Empty sequences are skipped, so term ids count
the lists that are not empty; a cut tail is read as far as it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.ship import ship


def parse(raw: bytes) -> Iterator[np.ndarray]:
    words = np.frombuffer(raw[: len(raw) // 4 * 4], "<u4")
    at = 0
    while at < len(words):
        n = int(words[at])
        if n:
            yield words[at + 1 : at + 1 + n]
        at += 1 + n


def parse_blocks(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Records ``(frequency, values)`` after a count word; a record of no values is an error."""
    words = np.frombuffer(raw[: len(raw) // 4 * 4], "<u4")
    at = 1
    while at < len(words):
        n = int(words[at])
        if not n:
            raise ValueError("a block without values")
        yield int(words[at + 1]), words[at + 2 : at + 2 + n]
        at += 2 + n


def dump(sequences: list) -> bytes:
    return b"".join(np.array([len(s), *s], "<u4").tobytes() for s in sequences)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """``(path, seq_id, values)`` of one file or of a folder of files; a file is read by one task."""
    ship(spark)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, rows = [], []
                for i, s in enumerate(parse(raw)):
                    ids.append(i)
                    rows.append(s.astype(np.int64))
                    if len(ids) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["path", "seq_id", "values"])
                        ids, rows = [], []
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["path", "seq_id", "values"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(explode, "path string, seq_id long, values array<long>")


def read_postings(spark: SparkSession, base: str) -> tuple[int, DataFrame]:
    """``(N, postings)`` of ``base.docs`` and ``base.freqs``."""
    docs = read_sequences(spark, f"{base}.docs")
    head = docs.where("seq_id = 0").first()
    if head is None or len(head["values"]) != 1:
        raise ValueError("the first sequence must hold the number of documents alone")
    lists = docs.where("seq_id > 0").select((F.col("seq_id") - 1).alias("term_id"), F.col("values").alias("docs"))
    freqs = read_sequences(spark, f"{base}.freqs").select(F.col("seq_id").alias("term_id"), F.col("values").alias("freqs"))
    zipped = lists.join(freqs, "term_id").select("term_id", F.explode(F.arrays_zip("docs", "freqs")).alias("p"))
    return head["values"][0], zipped.select("term_id", F.col("p.docs").alias("doc_id"), F.col("p.freqs").alias("freq"))


def read_sizes(spark: SparkSession, base: str) -> DataFrame:
    """``(doc_id, len)``"""
    first = read_sequences(spark, f"{base}.sizes").where("seq_id = 0")
    return first.select(F.posexplode("values").alias("doc_id", "len")).select(F.col("doc_id").cast("long"), "len")


def list_images(postings: DataFrame) -> DataFrame:
    """``(term_id, docs, freqs)``: each list as it stands in the two files, as binary; join them in the order of ``term_id``."""
    ship(postings.sparkSession)
    lists = postings.groupBy("term_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "freq"))).alias("p"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, freqs = ([dump([s]) for s in b.column(k).to_pylist()] for k in (1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(docs, pa.binary()), pa.array(freqs, pa.binary())], names=["term_id", "docs", "freqs"])

    return lists.select("term_id", "p.doc_id", "p.freq").mapInArrow(write, "term_id long, docs binary, freqs binary")


def read_images(images: DataFrame) -> DataFrame:
    """Postings from list images."""
    ship(images.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, freqs = ([next(parse(x)).astype(np.int64) for x in b.column(k).to_pylist()] for k in (1, 2))
            term = np.repeat(b.column(0).to_numpy(), [len(x) for x in docs])
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.concatenate([*none, *docs])), pa.array(np.concatenate([*none, *freqs]))], names=["term_id", "doc_id", "freq"])

    return images.mapInArrow(read, "term_id long, doc_id long, freq long")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, term_id)`` of a log with one query per line; ids are those of lines, in each file by offset."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\n")).alias("query_id", "line"))
    terms = lines.select(F.col("query_id").cast("long"), F.explode(F.split(F.trim("line"), "\\s+")).alias("t"))
    return terms.where("t <> ''").select("query_id", F.col("t").cast("long").alias("term_id"))
