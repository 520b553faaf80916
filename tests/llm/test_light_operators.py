"""Packing, sharding, token counts and decontamination against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from quern.llm import decontamination, packing, sharding, token_counts
from quern.llm import queries as q

WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))


def texts_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in texts]
    by_doc, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for (doc, _), own in zip(texts, ids, strict=True):
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(own))
            assert r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
            at += r.length
        assert at == len(own)
    assert sorted(seqs) == list(range(len(seqs)))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sum(map(len, ids)) / (len(seqs) * capacity)


def test_packing_query(spark, sf):
    rows = q.QUERIES["op1_packing"](spark, sf).collect()
    assert check_packing(rows, texts_of(spark, sf), 4096) > 0.9


def test_packing_edges(spark, make, edges):
    from pyspark.sql import functions as F

    packed = packing.pack(spark, make(edges), WORDS, 2, 64)
    check_packing(packed.withColumn("ids_crc32", F.crc32("ids")).collect(), list(enumerate(edges)), 64)
    seqs = packing.sequences(packed, 64).collect()
    assert all(len(s.ids) == 64 or len(s.ids) & (len(s.ids) - 1) == 0 for s in seqs)
    assert packing.pack(spark, make([]), WORDS).count() == 0
    assert packing.pack(spark, make(["a b"] * 5, [None, 1, 1, 1, None]), WORDS).count() == 5


def test_special_strings(spark, make):
    """The tokenizer knows its added tokens in the raw text only, by their case."""
    from pyspark.sql import functions as F

    texts = ["x <|ENDOFTEXT|> y", "x <|endoftext|> y", "a<|EndOfText|>b", "<|startoftext|><|STARTOFTEXT|>", "é <|ENDOFTEXT|>", "<|endo ftext|>", " <|endoftext|> ", "plain"]
    check_packing(packing.pack(spark, make(texts), WORDS).withColumn("ids_crc32", F.crc32("ids")).collect(), list(enumerate(texts)), 4096)


def test_plan_is_minimum_slack():
    r = np.random.default_rng(3)
    for _ in range(20):
        lengths = {int(n): int(c) for n, c in zip(r.integers(1, 60, 12), r.integers(1, 9, 12), strict=True)}
        rows, capacity = packing.plan_patterns(64, lengths), 64
        taken, load = defaultdict(int), defaultdict(int)
        for n, first, copies, times, seq, _ in rows:
            assert first == taken[n]
            taken[n] += copies * times
            for s in range(seq, seq + times):
                load[s] += n * copies
        assert dict(taken) == lengths and max(load.values()) <= capacity
    # the best fill, by trying all
    assert sum(n * k for n, k in packing.fill(50, [31, 20, 17, 9], {31: 1, 20: 2, 17: 3, 9: 1}).items()) == 49


def test_sharding(spark, sf, make, edges):
    rows = q.QUERIES["op2_sharding"](spark, sf).collect()
    slots = defaultdict(list)
    for r, (doc, text) in zip(sorted(rows, key=lambda r: r.doc_id), sorted(texts_of(spark, sf)), strict=True):
        assert (r.doc_id, r.size, r.text_crc32) == (doc, len(text.encode()) + 16, zlib.crc32(text.encode()))
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    tree = sharding.Tree.regular(40)
    rows = sharding.assign(spark, make([*edges, "t", "t"], [*range(len(edges)), None, 3]), tree).collect()
    assert len(rows) == len(edges) + 2 and len({r.shard for r in rows if r.doc_id == 3}) == 1
    assert sharding.assign(spark, make([]), tree).count() == 0


def test_sharding_moves_only_where_weights_change(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    tree = sharding.Tree.regular(40)
    place = lambda t: np.array([r[0] for r in sharding.with_shard(keys, F.col("doc_id"), t, "s").orderBy("doc_id").select("s").collect()])
    a = place(tree)
    share = np.bincount(a, minlength=40) / len(a)
    assert share.max() < 1.3 / 40 and share.min() > 0.7 / 40
    t = tree
    for n in range(40, 44):  # one shard after the other takes rows only into itself
        t = t.grow()
        b = place(t)
        assert set(b[a != b]) == {n}
        a = b
    heavier = sharding.Tree(tuple((s, g, k, 2.0 if s == 5 else w) for s, g, k, w in tree.nodes))
    a, b = place(tree), place(heavier)
    region = lambda x: x // 8
    assert set(region(b[a != b])) == {region(5)}  # all movement ends in the subtree of shard 5


def test_token_counts(spark, sf, make, edges):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r, (_, text) in zip(q.QUERIES["op7_token_counts"](spark, sf).orderBy("doc_id").collect(), texts_of(spark, sf), strict=True):
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(sp.encode(text)), len(sp.encode(text)) > 4096)
    got = token_counts.count_tokens(spark, make(edges), PIECES).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(sp.encode(t or "")) for t in edges]
    assert token_counts.count_tokens(spark, make([]), PIECES).count() == 0


def test_prefix_table(edges):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = token_counts.PrefixCounter(PIECES)
    assert counter.splits
    for t in [t for t in edges if t and len(t) < 1500] + ["  two  spaces ", " a", "a ", "▁a▁▁b"]:
        table = counter.prefix(t)
        for i in range(len(t) + 1):
            assert table[i] == len(sp.encode(t[:i])), (t, i)
        for budget in (0, 1, 7, 10_000):
            n = table.truncate(budget)
            assert table[n] <= budget


def test_truncation_points(spark, make, edges):
    import random

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.PrefixCounter(PIECES).recurs
    r = random.Random(5)
    odd = ["中文字" * 40, "   " + "日本語テキスト" * 9 + "  b ", "a    b" * 30, "\n\n  if x:\n        return 執벨🙂ﬁ", "".join(r.choice("abeinrst ▁ \n.é中🙂") for _ in range(400))]
    texts = [t for t in edges if len(t or "") < 2100] + odd
    limit = 25
    for row, text in zip(token_counts.count_tokens(spark, make(texts), PIECES, limit).orderBy("doc_id").collect(), texts, strict=True):
        text = text or ""
        sizes = [len(sp.encode(text[:i])) for i in range(len(text) + 1)]
        assert (row.n_tokens, row.over_limit) == (sizes[-1], sizes[-1] > limit)
        assert row.chars_in_limit == max(i for i, n in enumerate(sizes) if n <= limit)
        ends = [m.end() for m in re.finditer("[^ ]+", text.replace("▁", " "))]
        assert row.words_in_limit == sum(sizes[e] <= limit for e in ends)


def brute_items(text, items, width=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    words = pattern.findall(lower(text))
    hit, found = set(), set()
    for name, item in items:
        w = pattern.findall(lower(item))
        k = min(width, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1) if k else ():
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(str(name))
    return len(words), hit, sorted(found)


def test_decontamination(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = q.QUERIES["op10_decontamination"](spark, sf).orderBy("doc_id").collect()
    assert any(r.contaminated for r in rows)
    for r, (_, text) in zip(rows, texts_of(spark, sf), strict=True):
        n, hit, found = brute_items(text, items)
        assert (r.n_words, r.n_hit, r.n_items) == (n, len(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == bool(hit)


@pytest.mark.parametrize("per_automaton", [10_000, 8])
def test_decontamination_edges(spark, make, edges, per_automaton):
    items = [(1, "a b c d"), (2, "A, B c."), (3, None), (4, "..."), (5, edges[11][20:160]), (6, "ab " * 12), (7, "a b c d"), (8, "one"), (9, edges[6][:200]), (10, edges[6][100:260]), (11, "b c")]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.find(spark, make(edges), table, 10, per_automaton).orderBy("doc_id").collect()
    for r, text in zip(rows, edges, strict=True):
        n, hit, found = brute_items(text, items)
        assert (r.n_words, r["items"]) == (n, found)
        assert {i for s in r.spans for i in range(s.start, s.end)} == hit
    none = decontamination.find(spark, make(edges), table.limit(0)).collect()
    assert len(none) == len(edges) and not any(r.spans for r in none)
    assert decontamination.find(spark, make([]), table).count() == 0
    out = decontamination.remove(spark, make(edges), table, 10, 0.5, per_automaton)
    assert out.columns == make([]).columns
    kept = {r.doc_id: r.text for r in out.collect()}
    assert set(kept) == {i for i, t in enumerate(edges) if len(brute_items(t, items)[1]) <= 0.5 * brute_items(t, items)[0]}
    for i, t in kept.items():
        n, hit, _ = brute_items(t, items) if t is None else brute_items(edges[i], items)
        assert brute_items(t, [])[0] == n - len(hit) if hit else t == edges[i]


@pytest.mark.parametrize("per_automaton", [10_000, 8])
def test_longest_run_below_a_window(spark, make, per_automaton):
    items = [" ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(12))]
    part = lambda a, b: " ".join(items[0].split()[a:b])
    texts = ["new " + part(3, 12) + " words", part(3, 12) + " v7", part(0, 2) + " x " + part(5, 9) + " x v1 v2 v3", part(2, 14), "v3 w5 v2", "none", None]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontamination.find(spark, make(texts), table, 10, per_automaton).orderBy("doc_id").collect()
    assert [r.longest for r in rows] == [9, 9, 4, 12, 1, 0, 0]
    assert [bool(r.spans) for r in rows] == [False, False, False, True, False, False, False]
