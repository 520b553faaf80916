"""Packing by minimum bin slack (operator 1).

Documents become pieces: full windows of ``capacity`` ids, and what remains.
Remainders have fewer than ``capacity`` distinct lengths however large the
corpus is, so the plan is made on their histogram: minimum bin slack takes the
longest remaining length, a bitset subset-sum finds the multiset of other
lengths that fills the window closest to capacity, backtracking gives its
counts, and the pattern is used as often as the counts allow.  Each pattern
uses up a length, which bounds the plan by ``capacity`` patterns.  A piece finds
its place by its rank among the pieces of its length; ranks come from counts by
(writing task, length), so no length is gathered in one task.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, doc_rows, lean, materialize

#: White space that str.split() and the tokenizer may not see alike: such texts are encoded whole.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Characters beyond those that lower() and the tokenizer surely treat alike, and odd white space.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u0130\u0250-\U0010ffff]")


class WordEncoder:
    """Ids of a word-level BPE tokenizer as little-endian bytes.

    The tokenizer drops white space, ignores case and merges inside words only,
    so a text's ids are those of its words.  Arrow parts and numbers the words of a
    batch and finds those known from before; only new ones are encoded.  New words of
    Latin letters are encoded together, without the steps that leave them as
    they are, and told apart by the ids that end a word.  The tokenizer looks for its added
    tokens in the raw text, case and all; a text with one of them, in any case, is encoded whole.
    """

    def __init__(self, path: str, max_words: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._tok, self._max = Tokenizer.from_str(json.dumps(spec)), max_words
        byte_level = spec["pre_tokenizer"]["pretokenizers"][-1]
        lean = spec | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}}
        self._lean = Tokenizer.from_str(json.dumps(lean))
        self._ends = np.zeros(self._tok.get_vocab_size(), bool)
        for piece, i in self._tok.get_vocab().items():
            self._ends[i] = piece.endswith("</w>")
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self._added = re.compile("|".join(added) if added else "(?!)", re.IGNORECASE)
        self._cores: dict[str, bytes] = {}
        self._keep(pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _keep(self, words: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        """The known words, all their ids, and how many each has."""
        self._words, self._ids, self._size, self._first = words, ids, size, np.cumsum(size) - size

    def _whole(self, text: str) -> bytes:
        return np.array(self._tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, word: str) -> bytes:
        got = self._cores.get(word)
        if got is None:
            got = self._cores[word] = self._whole(word)
        return got

    def _compose(self, word: str) -> bytes:
        core = word.rstrip(string.punctuation)
        if not core or not core.isalpha() or ODD.search(core):
            return self._whole(word) if core else self._core(word)
        # Case is ignored, and letters and marks are parted before merging.
        got = self._core(core.lower())
        return got if len(core) == len(word) else got + self._core(word[len(core) :])

    def _learn(self, words: list[str]) -> list[bytes]:
        cores = self._cores
        if len(cores) > self._max // 4:
            cores.clear()
        plain = [w for w in {w.rstrip(string.punctuation) for w in words} if w.isalpha() and w not in cores]
        parts = [plain[a : a + 1000] for a in range(0, len(plain), 1000)]
        for part, got in zip(parts, self._lean.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            cuts = np.flatnonzero(self._ends[ids]) + 1
            if len(cuts) == len(part):  # else they are encoded one by one when needed
                raw, at = ids.tobytes(), 0
                for w, to in zip(part, (cuts * 4).tolist(), strict=True):
                    cores[w], at = raw[at:to], to
        return [got if (got := cores.get(w)) is not None else self._compose(w) if w else b"" for w in words]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text."""
        plain = texts.to_pylist()
        odd = [i for i, t in enumerate(plain) if ODD.search(t) or self._added.search(t)]
        if odd:
            mask = np.zeros(len(plain), bool)
            mask[odd] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        named = split.flatten().dictionary_encode()
        at = pc.fill_null(pc.index_in(named.dictionary, value_set=self._words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            words = named.dictionary.take(pa.array(fresh))
            ids = self._learn(words.to_pylist())
            at[fresh] = len(self._words) + np.arange(len(fresh))
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            self._keep(pa.concat_arrays([self._words, words]), np.concatenate([self._ids, np.frombuffer(b"".join(ids), "<u4")]), np.concatenate([self._size, size]))
        word = at[named.indices.to_numpy()]
        each = self._size[word]
        ends = np.concatenate([[0], np.cumsum(each)])
        tokens = self._ids[np.arange(ends[-1]) + np.repeat(self._first[word] - ends[:-1], each)]
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        out = [tokens[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        for i in odd:
            whole = ODD_SPACE.search(plain[i]) or self._added.search(plain[i])
            out[i] = self._whole(plain[i]) if whole else b"".join(map(self._compose, plain[i].split()))
        if len(self._words) > self._max:  # those of this batch stay
            size = self._size[at]
            ends = np.cumsum(size)
            self._keep(named.dictionary, self._ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._first[at] - (ends - size), size)], size)
        return out


def tokenize(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int) -> DataFrame:
    """Pieces ``(doc_id, start, length, doc_tokens, ids, part, rank)``: ids as little-endian 32-bit numbers.

    ``rank`` counts the pieces of one length inside ``part``, the task that wrote them.
    Kept in the shared folder: a text is encoded once.
    """
    arrow_batches(spark)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, encoder = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), WordEncoder(tokenizer)
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc, raw in zip(b.column(0).to_pylist(), encoder.encode_all(b.column(1)), strict=True):
                raw += end  # noqa: PLW2901
                n = len(raw) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    for to, x in zip(rows, (doc, start, length, n, raw[4 * start : 4 * (start + length)], int(seen[length])), strict=True):
                        to.append(x)
                    seen[length] += 1
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            arrays = [pa.array(x, t) for x, t in zip(rows, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(rows[0]), part, np.int32))], names=["doc_id", "start", "length", "doc_tokens", "ids", "rank", "part"])

    return materialize(spark, doc_rows(docs).mapInArrow(lean(cut), "doc_id long, start long, length long, doc_tokens long, ids binary, rank long, part int"), "pieces")


def fill(capacity: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The multiset of ``lengths`` (descending, at most ``counts`` of each) whose sum is closest to ``capacity`` from below."""
    reach, steps, mask = 1, [], (1 << (capacity + 1)) - 1
    for n in lengths:
        left = min(counts[n], capacity // n)
        if left <= 0:
            continue
        steps.append((n, reach, left))
        k = 1
        while left > 0:  # 1, 2, 4 ... copies at a time reach every number of copies
            k = min(k, left)
            reach |= (reach << (n * k)) & mask
            left -= k
            k *= 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for n, before, left in reversed(steps):
        k = 0
        while not before >> total & 1:
            total -= n
            k += 1
        assert k <= left
        if k:
            used[n] = k
    return used


def plan_patterns(capacity: int, histogram: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go, by rank: ``(length, first_rank, copies, times, first_sequence, offset)``.

    Ranks ``first_rank`` to ``first_rank + copies * times`` of a length stand
    ``copies`` to a sequence, from ``offset`` on, in ``times`` sequences from
    ``first_sequence`` on.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left, reverse=True)
    taken, sequence, rows = dict.fromkeys(lengths, 0), 0, []
    while lengths:
        seed = lengths[0]
        left[seed] -= 1
        used = fill(capacity - seed, [n for n in lengths if left[n] and n <= capacity - seed], left)
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times, offset = min(left[n] // k for n, k in used.items()), 0
        for n in sorted(used, reverse=True):
            k = used[n]
            rows.append((n, taken[n], k, times, sequence, offset))
            taken[n] += k * times
            left[n] -= k * times
            offset += n * k
        sequence += times
        lengths = [n for n in lengths if left[n]]
    return rows


def place(spark: SparkSession, pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; the columns part and rank go."""
    counts = pieces.groupBy("part", "length").count()
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    plan = spark.createDataFrame(
        plan_patterns(capacity, histogram), "length long, first_rank long, copies long, times long, first_sequence long, at long"
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = pieces.join(base, ["part", "length"]).withColumn("r", F.col("base") + F.col("rank"))
    inside = (F.col("r") >= F.col("first_rank")) & (F.col("r") < F.col("first_rank") + F.col("copies") * F.col("times"))
    # The plan is bounded by the capacity (patterns x lengths in a pattern), whatever the corpus.
    placed = ranked.alias("p").join(F.broadcast(plan.alias("q")), (F.col("p.length") == F.col("q.length")) & inside)
    step = F.col("r") - F.col("first_rank")
    return placed.select(
        *(F.col(f"p.{c}") for c in pieces.columns if c not in ("part", "rank")),
        (F.col("first_sequence") + F.expr("(r - first_rank) div copies")).alias("sequence_id"),
        (F.col("at") + (step % F.col("copies")) * F.col("p.length")).alias("offset"),
    )


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int | None = 2, capacity: int = 4096) -> DataFrame:
    """Every id of every document in exactly one place of one sequence.

    Returns ``(doc_id, start, length, doc_tokens, ids, sequence_id, offset)``.
    A null or empty text is its end id alone (nothing without ``end_id``);
    repeated rows and repeated ids are packed each by itself; an empty table
    gives no rows.
    """
    return place(spark, tokenize(spark, docs, tokenizer, end_id, capacity), capacity)


def sequences(packed: DataFrame, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, ids, n_tokens)``: the packed sequences, padded to ``capacity`` unless their length is a power of two."""

    def join(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("offset").to_numpy())
        ids = np.concatenate([np.frombuffer(t.column("ids")[int(i)].as_py(), "<u4") for i in order])
        n = len(ids)
        pad = 0 if n & (n - 1) == 0 else capacity - n
        ids = np.concatenate([ids, np.full(pad, pad_id, "<u4")]).astype(np.int32)
        return pa.table({"sequence_id": t.column("sequence_id")[:1], "ids": pa.array([ids], pa.list_(pa.int32())), "n_tokens": pa.array([n], pa.int64())})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids array<int>, n_tokens long")
