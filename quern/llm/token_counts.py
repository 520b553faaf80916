"""Token counts by prefix dynamic programming (operator 7).

A piece of the vocabulary never holds a space mark after another character, so
no merge crosses the start of a space-led word: the count of a prefix is a
running sum over words plus the count of a prefix of one word.  Inside a word
``PrefixCounter`` goes forward: a sequence of pieces is the model's encoding if
and only if every two neighbours encode to themselves, so the encoding of a
prefix ends with the one piece that goes with the last piece of the prefix
before it.  ``PrefixTable`` is the table of one text; counts of all prefixes and
the longest prefix within a budget follow without encoding the text again.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, doc_rows, lean

MARK = "▁"
PARTS = re.compile(" +[^ ]*|[^ ]+")


class PrefixCounter:
    """Exact counts of a sentencepiece BPE model, for texts and all their prefixes."""

    def __init__(self, path: str, max_words: int = 400_000):
        import sentencepiece

        self._model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(size)]
        crossing = any(a != MARK and b == MARK for p in pieces for a, b in zip(p, p[1:], strict=False))
        plain = m.encode("a b", out_type=str)[0].startswith(MARK) and len(m.encode(" ")) > 0
        #: without these properties words depend on each other, and whole texts are encoded
        self.splits = not crossing and plain
        self._counts: dict[str, int] = {}
        self._prefixes: dict[str, list[int]] = {}
        self._max_words = max_words
        self._runs: dict[int, int] = {1: 1}
        special = {i for i in range(size) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i)}
        normal = [i for i in range(size) if i not in special]
        runs = [i for i in normal if pieces[i].startswith(MARK * 2)]
        merged = sorted((i for i in normal if len(pieces[i]) > 1 and i not in set(runs)), key=lambda i: -m.get_score(i))
        scores = [m.get_score(i) for i in merged]
        #: the recurrence needs one rank per piece, runs of marks that merge last, and bytes for unknown characters
        self.recurs = (
            self.splits
            and sum(map(m.is_byte, special)) == 256
            and not any(m.is_unused(i) for i in normal)
            and len(set(scores)) == len(scores)
            and all(not pieces[i].strip(MARK) and m.get_score(i) < min(scores) for i in runs)
        )
        if self.recurs:
            self._learn(pieces, [i for i in normal if len(pieces[i]) == 1], merged)

    def _learn(self, pieces: list[str], chars: list[int], merged: list[int]) -> None:
        """Rank of every piece (characters -1), and the two halves that its last merge joins."""
        self._text, self._all = pieces, {pieces[i]: i for i in [*chars, *merged]}
        self._rank = dict.fromkeys(chars, -1) | {i: k for k, i in enumerate(merged)}
        self._halves: dict[int, tuple[int, int]] = {}
        #: pieces that encode to themselves
        self._piece = {pieces[i]: i for i in chars}
        for k, i in enumerate(merged):
            p = pieces[i]
            for at in range(1, len(p)):
                a, b = self._piece.get(p[:at]), self._piece.get(p[at:])
                if a is not None and b is not None and self._stays(a, b, k):
                    self._halves[i] = a, b
                    self._piece[p] = i
                    break
        self._longest = max(map(len, self._piece))
        self._pairs: dict[int, bool] = {}

    def _stays(self, a: int, b: int, limit: int = 1 << 62) -> bool:
        """Whether no merge ranked before ``limit`` crosses the border of two neighbours: their last merges are undone, latest first."""
        text, every, rank = self._text, self._all, self._rank
        while True:
            both = every.get(text[a] + text[b])
            if both is not None and rank[both] < limit:
                return False
            if rank[a] > rank[b]:
                limit = rank[a]
                a = self._halves[a][1]
            elif rank[b] < 0:
                return True
            else:  # of equal ranks the left one merges first
                limit = rank[b] + 1
                b = self._halves[b][0]

    def _forward(self, marked: str) -> tuple[list[int], list[bool]]:
        """Counts of all prefixes of a word led by one mark, and whether their first piece is the bare mark."""
        n, longest, piece, pairs = len(marked), self._longest, self._piece, self._pairs
        count, last, bare = [0] * (n + 1), [-1] * (n + 1), [False] * (n + 1)
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = piece.get(marked[j:i])
                if t is None:
                    continue
                u = last[j]
                if u >= 0:
                    key = u << 20 | t
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) >= 1_000_000:
                            pairs.clear()
                        ok = pairs[key] = self._stays(u, t)
                    if not ok:
                        continue
                count[i], last[i], bare[i] = count[j] + 1, t, bare[j] if j else i == 1
                break
            else:
                if marked[i - 1] in piece:
                    raise AssertionError(f"no piece ends the prefix {marked[:i]!r}")
                count[i], bare[i] = count[i - 1] + len(marked[i - 1].encode()), bare[i - 1]
        return count, bare

    def _encode(self, text: str) -> int:
        return len(self._model.encode(text))

    def _run(self, n: int) -> int:
        """Count of ``n`` space marks that join no word."""
        got = self._runs.get(n)
        if got is None:
            got = self._runs[n] = self._encode(" " * (n - 1))
        return got

    def _count(self, word: str) -> int:
        if not self.recurs:
            return self._encode(word) if word else 1
        if word[:1] == " ":
            return self._led(word)[-1]
        return self._forward(MARK + word)[0][-1]

    def _led(self, word: str) -> list[int]:
        """Counts of all prefixes of a word with spaces before it, besides the one that starts every word."""
        w = word.lstrip(" ")
        lead = len(word) - len(w)
        out = [0, *(self._run(i + 1) for i in range(1, lead + 1))]
        if w:
            count, bare = self._forward(MARK + w)
            out += [c - b + self._run(lead + b) for c, b in zip(count[2:], bare[2:], strict=True)]
        return out

    def words(self, words: list[str]) -> list[int]:
        """Counts of words that each follow a space (the model's own first space included)."""
        known = self._counts
        try:
            return list(map(known.__getitem__, words))
        except KeyError:
            missing = [w for w in set(words) if w not in known]
            if len(known) + len(missing) > self._max_words:
                known.clear()
                missing = list(set(words))
            known.update(zip(missing, map(self._count, missing), strict=True))
            return list(map(known.__getitem__, words))

    def prefix(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)

    def word_prefixes(self, word: str) -> list[int]:
        got = self._prefixes.get(word)
        if got is None:
            if len(self._prefixes) >= self._max_words // 8:
                self._prefixes.clear()
            if not self.recurs:
                got = [0, *(self._encode(word[:i]) for i in range(1, len(word) + 1))]
            elif word[:1] == " ":
                got = self._led(word)
            else:
                got = [0, *self._forward(MARK + word)[0][2:]]
            self._prefixes[word] = got
        return got


class PrefixTable:
    """Counts at every prefix of one text: ``self[i]`` tokens in ``text[:i]``."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.text, self._counter = text, counter
        plain = text.replace(MARK, " ") if MARK in text else text  # the mark itself is a space to the model
        #: words with the spaces before them, less the one space that starts each (the model puts it before the first)
        self.words: list[str]
        if not plain or not counter.splits:
            self.words = [plain] if plain else []
        elif "  " not in plain and plain[0] != " " and plain[-1] != " ":
            self.words = plain.split(" ")
        else:
            parts = PARTS.findall(plain)
            self.words = [parts[0], *(p[1:] for p in parts[1:])]
        #: tokens before each word, and in all
        self.before = [0, *accumulate(counter.words(self.words))]

    @cached_property
    def ends(self) -> list[int]:
        """Where each word ends."""
        return [n + k for k, n in enumerate(accumulate(map(len, self.words)))]

    def __len__(self) -> int:
        return len(self.text) + 1

    def _inner(self, k: int) -> list[int]:
        """Tokens of the k-th word at each of its prefixes, its space included."""
        found = self._counter.word_prefixes(self.words[k])
        return found if k == 0 else [0, 1, *found[1:]]

    def __getitem__(self, i: int) -> int:
        if i <= 0:
            return 0
        k = bisect.bisect_left(self.ends, i)
        if i == self.ends[k]:
            return self.before[k + 1]
        return self.before[k] + self._inner(k)[i - (self.ends[k - 1] if k else 0)]

    def whole_words(self, budget: int) -> int:
        """How many words from the start have at most ``budget`` tokens together."""
        k = bisect.bisect_right(self.before, budget) - 1
        return k - (k > 0 and k == len(self.words) and not self.words[-1].strip(" "))

    def truncate(self, budget: int) -> int:
        """Length of the longest prefix, ending at a word's end, of at most ``budget`` tokens."""
        k = bisect.bisect_right(self.before, budget) - 1
        return self.ends[k - 1] if k else 0

    def longest(self, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens, wherever it ends."""
        k = bisect.bisect_right(self.before, budget) - 1
        if k == len(self.words):
            return len(self.text)
        inner = self._inner(k)
        return (self.ends[k - 1] if k else 0) + max(i for i, n in enumerate(inner) if self.before[k] + n <= budget)


@lru_cache(maxsize=1)
def _counter(path: str) -> PrefixCounter:
    """A worker's counter: tasks that follow each other share its tables and known words, which are bounded."""
    return PrefixCounter(path)


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, words_in_limit, chars_in_limit)`` of every text.

    ``chars_in_limit`` is the length in characters of the longest prefix of at
    most ``limit`` tokens, ``words_in_limit`` the number of words (between
    spaces) that are whole within ``limit`` tokens.  Null and empty texts have
    no tokens.  Repeated rows are counted each by itself; an empty table gives
    no rows.  ``tokenizer`` is the path of a sentencepiece model on every machine.
    """
    arrow_batches(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                table = counter.prefix(t)
                rows.append((table.before[-1], table.whole_words(limit), table.longest(limit)))
            made = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *made], names=["doc_id", "n_bytes", "n_tokens", "words_in_limit", "chars_in_limit"])

    rows = doc_rows(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = rows.mapInArrow(lean(count), "doc_id long, n_bytes long, n_tokens long, words_in_limit long, chars_in_limit long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "words_in_limit", "chars_in_limit")
