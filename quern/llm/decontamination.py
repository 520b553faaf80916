"""Benchmark decontamination with a generalised suffix automaton (operator 10).

The automaton is built over the words of all normalised items, items apart.
Documents are streamed through it: its state is the longest run of words,
ending here, that some item holds.  Where that run reaches the window width, a window of
an item ends; the states on the suffix path say which items hold it.

The items are a stated set, sent to the executors in automata of at most
``words_per_automaton`` words.  A larger set makes more automata: each is built,
broadcast, streamed over all documents and dropped before the next; what the
passes find is stored and merged by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, doc_rows, lean, materialize

#: Bytes to words: A-Z as a-z, the other ASCII characters but digits and letters as spaces, bytes of other characters as they are.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items each window occurs in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.width = width
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[str]] = [set()]
        shorts: list[tuple[str, list[int]]] = []
        for name, words in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            last = 0
            for c in seq:
                last = self._extend(last, c, own)
                own[last].add(name)
            if 0 < len(seq) < width:
                shorts.append((name, seq))
        #: items that hold the runs of a state: those of the states that end in it too
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                own[self.link[v]] |= own[v]
        #: short items are windows as they are, told by their state and length
        self._short: dict[int, list[tuple[int, str]]] = {}
        for name, seq in shorts:
            v = 0
            for c in seq:
                v = self.next[v][c]
            self._short.setdefault(v, []).append((len(seq), name))
        self._least = min([width, *(len(s) for _, s in shorts)])
        long = {name for name, words in items if len(words) >= width}
        self._windows = [tuple(sorted(x & long)) for x in own]
        self._found: dict[tuple[int, int], tuple[int, frozenset[str]]] = {}

    def _extend(self, last: int, c: int, own: list[set[str]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # the run is known from an earlier item
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q, own)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        own.append(set())
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q, own)
        return cur

    def _clone(self, p: int, c: int, q: int, own: list[set[str]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        own.append(set())
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _ending(self, v: int, n: int) -> tuple[int, frozenset[str]]:
        """Of the windows that end where state ``v`` is met with a run of ``n`` words: the longest one's length, their items."""
        key = (v, min(n, self.width))
        got = self._found.get(key)
        if got is None:
            most, items, u, k = 0, set(), v, n
            while u > 0:
                if k >= self.width > self.length[self.link[u]]:
                    items.update(self._windows[u])
                    most = max(most, self.width if self._windows[u] else 0)
                for m, name in self._short.get(u, ()):
                    if m <= k:
                        items.add(name)
                        most = max(most, m)
                u = self.link[u]
                k = self.length[u]
            got = self._found[key] = (most, frozenset(items))
        return got

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Spans of words inside windows, the items, and the longest run met. Spans are apart and in order."""
        n = len(words)
        ids = np.fromiter(map(self.ids.get, words, (0 for _ in range(n))), np.int32, n) if n else np.zeros(0, np.int32)
        # A window is a run of known words: shorter runs can't hold one, but may hold the longest run met.
        known = np.concatenate([[0], ids > 0, [0]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(known))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        longest = 0
        for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self._least or b - a > longest:
                longest = max(longest, self._run(ids[a:b].tolist(), a, spans, items))
        return spans, items, longest

    def _run(self, seq: list[int], at: int, spans: list[tuple[int, int]], items: set[str]) -> int:
        nxt, link, length, least = self.next, self.link, self.length, self._least
        v = n = longest = 0
        for i, c in enumerate(seq, at + 1):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
                if n > longest:
                    longest = n
                if n >= least:
                    most, names = self._ending(v, n)
                    if most:
                        items |= names
                        if spans and spans[-1][1] >= i - most:
                            while len(spans) > 1 and spans[-2][1] >= i - most:
                                spans.pop()
                            spans[-1] = (min(spans[-1][0], i - most), i)
                        else:
                            spans.append((i - most, i))
        return longest


def automata(items: DataFrame, width: int, words_per_automaton: int) -> Iterator[Automaton]:
    """Automata over all items, one at a time, each of a bounded number of words (a longer item has one of its own)."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for r in items.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        words = words_of(r.t or "")
        if held and size + len(words) > words_per_automaton:
            yield Automaton(held, width)
            held, size = [], 0
        held.append((r.i if r.i is not None else "", words))
        size += len(words)
    if held:
        yield Automaton(held, width)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = {"n_words": pa.int64(), "spans": SPANS, "items": pa.list_(pa.string()), "longest": pa.int64()}
FOUND_SQL = "n_words long, spans array<struct<start: long, end: long>>, items array<string>, longest long"


def _batch(key: pa.Array, name: str, rows: list[tuple]) -> pa.RecordBatch:
    """A batch of ``key`` and the columns of ``FOUND``."""
    made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(FOUND.values())]
    return pa.RecordBatch.from_arrays([key, *made], names=[name, *FOUND])


def _as_spans(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": s, "end": e} for s, e in spans]


def _scan(spark: SparkSession, rows: DataFrame, automaton: Automaton) -> tuple[DataFrame, Callable[[], None]]:
    """What one automaton finds in ``rows(key, text)``, under the first column's name; and how to drop the automaton."""
    sent, name = spark.sparkContext.broadcast(automaton), rows.columns[0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                spans, found, longest = sent.value.scan(words)
                out.append((len(words), _as_spans(spans), sorted(found), longest))
            yield _batch(b.column(0), name, out)

    return rows.mapInArrow(lean(scan), f"`{name}` long, {FOUND_SQL}"), sent.unpersist


def _passes(spark: SparkSession, rows: DataFrame, first: Automaton, others: Iterator[Automaton]) -> DataFrame:
    """What all automata find in ``rows(_row, text)``: a pass for each, stored, then merged by row."""
    stored = None
    while first is not None:
        found, drop = _scan(spark, rows, first)
        del first
        found = materialize(spark, found, "hits")
        drop()
        stored = found if stored is None else stored.unionByName(found)
        first = next(others, None)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column(1).to_pylist():  # one from each automaton
                spans = merge_spans([(s["start"], s["end"]) for p in parts for s in p["spans"]])
                out.append((parts[0]["n_words"], _as_spans(spans), sorted({i for p in parts for i in p["items"]}), max(p["longest"] for p in parts)))
            yield _batch(b.column(0), "_row", out)

    return stored.groupBy("_row").agg(F.collect_list(F.struct(*FOUND)).alias("parts")).mapInArrow(lean(merge), f"_row long, {FOUND_SQL}")


def find(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = 10, words_per_automaton: int = 2_000_000) -> DataFrame:
    """``(doc_id, n_words, spans, items, longest)`` of every document.

    ``spans``: the runs ``[start, end)`` of words inside a window of an item;
    ``items``: the ids, as strings in their order, of items whose windows occur;
    ``longest``: the longest run of words that the document shares with an item.
    Null and empty texts have no words and no spans; items without words have
    no windows; an empty item table finds nothing.  Items with equal texts are
    all reported; items under one id count as one.  Repeated documents are each scanned.
    """
    arrow_batches(spark)
    built, rows = automata(items, width, words_per_automaton), doc_rows(docs)
    first, second = next(built, None) or Automaton([], width), next(built, None)
    if second is None:
        return _scan(spark, rows, first)[0]
    rows = materialize(spark, rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = _passes(spark, rows.select("_row", "text"), first, chain([second], built))
    return rows.select("_row", "doc_id").join(found, "_row").select("doc_id", *FOUND)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = 10, max_share: float = 0.5, words_per_automaton: int = 2_000_000) -> DataFrame:
    """``docs`` without benchmark passages: ``text`` loses the hit spans, documents hit in over ``max_share`` of their words go.

    A document without hits keeps its text to the byte; all its other columns stay as they are.
    """
    arrow_batches(spark)
    built = automata(items, width, words_per_automaton)
    first, second = next(built, None) or Automaton([], width), next(built, None)
    if second is None:
        sent = spark.sparkContext.broadcast(first)

        def spans_of(b: pa.RecordBatch, i: int, words: list[bytes]) -> list[tuple[int, int]]:
            return sent.value.scan(words)[0]

        rows = docs
    else:
        numbered = materialize(spark, docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        found = _passes(spark, numbered.select("_row", F.coalesce("text", F.lit("")).alias("text")), first, chain([second], built))
        rows = numbered.join(found.where("size(spans) > 0").select("_row", F.col("spans").alias("_spans")), "_row", "left").drop("_row")

        def spans_of(b: pa.RecordBatch, i: int, words: list[bytes]) -> list[tuple[int, int]]:
            return [(s["start"], s["end"]) for s in b.column(b.num_columns - 1)[i].as_py() or []]

    names, schema = docs.columns, docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = names.index("text")
            texts, keep = b.column(k).to_pylist(), []
            for i, text in enumerate(texts):
                words = words_of(text or "")
                spans = spans_of(b, i, words) if words else []
                hit = sum(e - s for s, e in spans)
                keep.append(hit <= max_share * len(words))
                if hit and keep[-1]:
                    texts[i] = without(text, spans)
            arrays = [pa.array(texts, b.schema.field(k).type) if j == k else b.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(lean(clean), schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``, from a span's first byte to its last."""
    raw = text.encode()
    word = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], word, [0]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : starts[s]])
        at = int(ends[e - 1])
    return b"".join([*out, raw[at:]]).decode()
