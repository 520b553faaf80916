"""Shared parts of the corpus operators: blocks of texts, tables in the shared folder, hashing.

Null handling, everywhere: a null ``text`` is an empty text, a null ``doc_id``
is a value of its own.  Operators read only ``doc_id`` and ``text``; other
columns, whatever their names, pass by.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import inspect
import secrets
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.ship import ship

U64 = np.uint64
#: Odd numbers with well-mixed bits.
GOLD, SILVER = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local runs without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Below the shared folder, where tables are written now.
_FOLDER: ContextVar[str] = ContextVar("folder", default="quern")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end, all but the ``lasting`` ones: what is returned may read only these."""
    was = _FOLDER.set(f"{_FOLDER.get()}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{_FOLDER.get()}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _FOLDER.reset(was)


def materialize(spark: SparkSession, df: DataFrame, tag: str, free: bool = False, lasting: bool = False, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation, and what was
    computed once (block numbers, say) stays as it is.  ``free`` releases the
    finished job's shuffle files at once, worth the pause where they are large.
    ``lasting`` tables outlive the ``scratch`` they are written in.
    """
    folder = _FOLDER.get().rpartition("/scratch-")[0] if lasting and "/" in _FOLDER.get() else _FOLDER.get()
    path = f"{shared_dir(spark)}/{folder}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    schema = df.schema
    del df
    if free:
        release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no live plan refers to; what one collection frees, the next may follow up."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def arrow_batches(spark: SparkSession, mb: int = 2) -> None:
    """Ready the session for Python operators: batches bounded by bytes (rows hold whole texts; a block is a batch), this package on the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


@cache
def _c_library():
    return ctypes.CDLL(None)


def trim() -> None:
    """Give freed memory back to the machine: workers outlive tasks, and idle ones would hold on to it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # not every C library has it
        _c_library().malloc_trim(0)


#: When this worker last trimmed its memory between groups.
_TRIMMED = [0.0]


def lean(f):
    """``f``, a function of a task's batches or of a group's table, that trims the worker's memory when it is done.

    A group does not know whether it is its task's last, so groups trim every two seconds.
    """
    if not inspect.isgeneratorfunction(f):

        def group(table: pa.Table) -> pa.Table:
            out = f(table)
            if time.monotonic() > _TRIMMED[0] + 2:
                trim()
                _TRIMMED[0] = time.monotonic()
            return out

        return group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def doc_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


# ---- blocks -----------------------------------------------------------------


#: Documents of a block at most: block << 16 | place is a document's number.
BLOCK_ROWS = 1 << 16


def write_blocks(spark: SparkSession, docs: DataFrame, block_bytes: int = 2 << 20) -> DataFrame:
    """Documents as rows ``(block, doc_ids, texts)`` of about ``block_bytes`` of text, kept in the shared folder.

    Later passes see the same documents in the same order under the same block
    number, so a pass can send keys by block and get answers back by block.  A
    text longer than ``block_bytes`` is a block of its own.
    """
    arrow_batches(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def out() -> pa.RecordBatch:
            assert part < 1 << 23 and seq < 1 << 24
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) | seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))],
                names=["block", "doc_ids", "texts"],
            )

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (held + len(t) > block_bytes or len(ids) == BLOCK_ROWS):
                    yield out()
                    seq, ids, texts, held = seq + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t) + 1
        if ids:
            yield out()

    rows = doc_rows(docs).mapInArrow(lean(pack), "block long, doc_ids array<long>, texts array<string>")
    return materialize(spark, rows, "blocks", **{"parquet.block.size": str(16 << 20)})


def block_texts(row_batch: pa.RecordBatch, k: int, column: str = "texts") -> list[bytes]:
    """The texts of the k-th block of a batch, as UTF-8."""
    values = row_batch.column(row_batch.schema.get_field_index(column))[k].values
    return [] if values is None else values.cast(pa.binary()).to_pylist()


def slices_for(spark: SparkSession, blocks: DataFrame, bytes_per_slice: int = 8 << 20) -> int:
    """Bits of the slice number: slices of the key space are as many as the corpus needs, 8 at least."""
    total = blocks.select(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t)))).first()[0] or 0
    return min(24, max(3, int(np.ceil(np.log2(max(1, total / bytes_per_slice))))))


# ---- hashing ----------------------------------------------------------------


def fresh_key() -> int:
    """The secret of one run's hashes, drawn by the driver: nobody can write texts that collide under it."""
    return secrets.randbits(63)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _secret(key: int, k: int) -> np.uint64:
    return mix(np.array([(key + k * 0xD1B54A32D192ED03) & ((1 << 64) - 1)], U64))[0]


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` values: a run is told by its two parts, mixed at every step."""
    out, have, step = None, 0, 1
    while True:
        if width & step:
            out = h if out is None else mix(out[: len(h) - have] * GOLD + h[have:])
            have += step
        if 2 * step > width or len(h) <= step:
            break
        h = mix(h[:-step] * SILVER + h[step:])
        step *= 2
    n = max(0, len(h) + step - width) if have == width else 0
    return out[:n] if n else np.zeros(0, U64)


#: Space and the control characters 9 to 13 part words; bytes.split() parts at just these.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """The words of the texts of a block: hashes under a secret key, and the text each stands in."""

    def __init__(self, texts: list[bytes], lower: bool = False, key: int = 0):
        joined = b" ".join(texts) + b" "
        buf = np.frombuffer((joined.lower() if lower else joined) + bytes(8), np.uint8)
        space = SPACES[buf[:-8]]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        self.n_texts, self.key = len(texts), key
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        #: first word of each text, and one past the last word
        self.first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(lengths)]))
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self._buf = buf

    def hashes(self, k: int = 0) -> np.ndarray:
        """The k-th hash of each word: its parts of eight bytes are mixed with their place, summed, and mixed with the length."""
        secret, size = _secret(self.key, k), self.end - self.start
        parts = (size + 7) >> 3
        first = np.cumsum(parts) - parts
        place = np.arange(parts.sum()) - np.repeat(first, parts)
        at = np.repeat(self.start, parts) + 8 * place
        eights = np.lib.stride_tricks.as_strided(self._buf, (len(self._buf) - 7, 8), (1, 1))[at].view("<u8").ravel()
        cut = U64(8) * np.maximum(0, 8 - (np.repeat(size, parts) - 8 * place)).astype(U64)
        part = mix((eights << cut >> cut) ^ mix(place.astype(U64) * GOLD + secret))
        if len(part) > len(size):
            part = np.add.reduceat(part, first)
        return mix(part + size.astype(U64) * SILVER + secret)

    def windows(self, width: int, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words inside one text, and the first word of each."""
        n = len(self.start) - width + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text[:n] == self.text[width - 1 :])
        return rolled(self.hashes(k), width)[at], at


# ---- key counting by slices -------------------------------------------------


def cut(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the 2**bits slices a sorted array of 64-bit keys falls into, and the bounds of its part in each."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    top = keys >> U64(64 - bits)
    first = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    return top[first].astype(np.int64), np.append(first, len(keys))


def sliced(block: int, bits: int, keys: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per slice that has keys: the slice, the block, and the part of each column that falls there as bytes."""
    used, bounds = cut(keys, bits)
    arrays = [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), block, np.int64))]
    for values in columns.values():
        values = np.ascontiguousarray(values)
        offsets = bounds * values.itemsize
        arrays.append(pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)]))
    return pa.RecordBatch.from_arrays(arrays, names=["slice", "block", *columns])


def short_keys(keys: np.ndarray, bits: int) -> np.ndarray:
    """The top bits + 32 bits of 64-bit keys, in place: what a sketch cell is told by."""
    low = U64(32 - bits)
    return (keys >> low) << low


def repeated_keys(blocks: DataFrame, keys_of, bits: int, counts: str = "") -> DataFrame:
    """Count-min over the keys of all blocks: for each block, which keys may occur elsewhere too.

    ``keys_of(batch, k)`` gives the 64-bit keys of a block, repeats included.  Each block
    sketches its keys as the distinct cells (``bits`` + 32 bits of the key) and
    sends them to the owners of the ``2**bits`` slices of the cell space; an owner
    merges the partition sketches of its slice and answers each block with one
    mark per cell.  Cells that two keys share make counts too high, never too
    low.  Returns ``(block, marks)``: for the sorted distinct cells of the block
    the count as ``counts`` ("u1" or "u2", the largest number standing for all
    above), or packed bits of "in two blocks or more".
    A key that fills the corpus costs one entry per block.
    """

    most = np.iinfo(counts).max if counts else 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                cells, n = np.unique(short_keys(keys_of(b, k), bits), return_counts=True)
                cols = {"cells": (cells >> U64(32 - bits)).astype(np.uint32)}
                if counts:
                    cols["own"] = np.minimum(n, most).astype(counts)
                yield sliced(b.column(0)[k].as_py(), bits, cells, cols)

    def merge(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in t.column("cells").to_pylist()]
        cells, inverse, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        if counts:
            own = np.concatenate([np.frombuffer(x, counts) for x in t.column("own").to_pylist()])
            n = np.bincount(inverse, weights=own, minlength=len(cells))
            marks = np.minimum(n, most).astype(counts)[inverse]
        else:
            marks = (n > 1)[inverse]
        ends = np.cumsum([len(p) for p in parts])
        out = [(m if counts else np.packbits(m)).tobytes() for m in np.split(marks, ends[:-1])]
        return pa.table({"slice": t.column("slice"), "block": t.column("block"), "n": pa.array([len(p) for p in parts], pa.int32()), "marks": pa.array(out, pa.binary())})

    sent = blocks.mapInArrow(lean(send), "slice int, block long, cells binary" + ", own binary" * bool(counts))
    return by_block(sent.groupBy("slice").applyInArrow(lean(merge), ANSWER))


#: What the owner of a slice tells a block: marks of its n keys there.
ANSWER = "slice int, block long, n int, marks binary"


def by_block(answers: DataFrame) -> DataFrame:
    """``(block, marks)``: all answers to a block, in the order of the slices; as many as a block has keys at most."""
    return answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("slice", "n", "marks"))).alias("marks"))


def exact_keys(rows: DataFrame, keys_of, bits: int, first: bool) -> DataFrame:
    """Group the 128-bit keys of all blocks exactly; ``(block, marks)`` as from ``repeated_keys``, a bit per key.

    ``keys_of(batch, k)`` gives the distinct keys of a block as sorted arrays
    ``hi, lo``, and with ``first`` also ``doc, pos``, the first place of each.  The bit tells
    that the key is in other blocks too, or with ``first`` that it comes earlier in
    another block.  One entry per key and block is sent, so no key is hot.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                hi, lo, *place = keys_of(b, k)
                if len(hi):
                    yield sliced(b.column(0)[k].as_py(), bits, hi, {"hi": hi, "lo": lo} | dict(zip(("doc", "pos"), place, strict=False)))

    def merge(t: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()])
        hi, lo = read("hi", U64), read("lo", U64)
        sizes = [len(x) // 8 for x in t.column("hi").to_pylist()]
        if first:
            block = np.repeat(t.column("block").to_numpy(), sizes)
            order = np.lexsort((block, read("pos", np.int64), read("doc", np.int64), lo, hi))
        else:
            order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        same = (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])
        marks = np.zeros(len(hi), bool)
        marks[1:] |= same
        if not first:
            marks[:-1] |= same
        back = np.empty(len(hi), bool)
        back[order] = marks
        out = [np.packbits(m).tobytes() for m in np.split(back, np.cumsum(sizes)[:-1])]
        return pa.table({"slice": t.column("slice"), "block": t.column("block"), "n": pa.array(sizes, pa.int32()), "marks": pa.array(out, pa.binary())})

    sent = rows.mapInArrow(lean(send), "slice int, block long, hi binary, lo binary" + ", doc binary, pos binary" * first)
    return by_block(sent.groupBy("slice").applyInArrow(lean(merge), ANSWER))


def with_marks(blocks: DataFrame, **marks: DataFrame) -> DataFrame:
    """``blocks`` with the answers of earlier passes as columns of the given names (null: none)."""
    for name, df in marks.items():
        blocks = blocks.join(df.withColumnRenamed("marks", name), "block", "left")
    return blocks


def read_marks(batch: pa.RecordBatch, k: int, column: str, counts: str = "") -> np.ndarray:
    """The marks of the k-th block of a batch, in the order of its keys."""
    found = batch.column(batch.schema.get_field_index(column))[k].as_py() or []
    if counts:
        return np.concatenate([np.zeros(0, counts), *(np.frombuffer(x["marks"], counts) for x in found)])
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(x["marks"], np.uint8), count=x["n"]).astype(bool) for x in found)])


def key_marks(keys: np.ndarray, bits: int, marks: np.ndarray) -> np.ndarray:
    """For each key of a block its count, or whether it may be repeated (in the block itself or elsewhere)."""
    _, inverse, n = np.unique(short_keys(keys, bits), return_inverse=True, return_counts=True)
    return (marks | (n > 1) if marks.dtype == bool else marks)[inverse]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
    return edges[0::2], edges[1::2]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in a range [start, end)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
