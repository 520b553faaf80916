"""Segments against all segments; held-out accuracy; odd inputs."""

import random
import zlib

import numpy as np

from quern.llm import queries as q
from quern.llm import toxicity


def brute_segments(s):
    """Recursive: the maximum-scoring segment, then those of what is left and right of it."""

    def go(a, b):
        best = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                x = sum(s[i:j])
                if x > 0 and (best is None or x > best[0] + 1e-12 or (abs(x - best[0]) <= 1e-12 and (j - i) < best[2] - best[1])):
                    best = (x, i, j)
        return [] if best is None else [*go(a, best[1]), best, *go(best[2], b)]

    return go(0, len(s))


def test_segments():
    r = random.Random(2)
    for _ in range(200):
        s = [r.choice([-3, -2, -1, 1, 2, 4]) + r.random() / 7 for _ in range(r.randint(0, 14))]
        got = [(round(x, 6), a, b) for x, a, b in toxicity.maximal_segments(np.array(s))]
        assert got == [(round(x, 6), a, b) for x, a, b in brute_segments(s)], s


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = q.QUERIES["op5_toxicity"](spark, sf).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([p == t for p, t in held]) > 0.95


def test_edges(spark, make, edges):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(spark, make(edges), labels)
    rows = toxicity.score(spark, make(edges), model).collect()
    assert len(rows) == len(edges) and all(r.predicted == 0 for r in rows)
    assert toxicity.score(spark, make([]), model).count() == 0
    r = random.Random(4)
    bad = ["awful", "filthy", "swine"]
    texts = [" ".join([r.choice(["good", "day", "the", "sun", "rain", "of"]) for _ in range(60)] + [r.choice(bad) for _ in range(4 * (i % 3 == 0))]) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(250)], "doc_id long, quality int, toxic int")
    texts += [None, "", "x" * 3000]
    model = toxicity.train(spark, make(texts), labels)
    rows = {r.doc_id: r for r in toxicity.score(spark, make(texts), model).collect()}
    assert all(rows[i].predicted == (i % 3 == 0) for i in range(300)) and not any(rows[i].predicted for i in (300, 301, 302))
    assert rows[0].passages[0].start >= 55
    assert {r.doc_id for r in toxicity.keep_clean(spark, make(texts), model).collect()} == {i for i in rows if not rows[i].predicted}


def test_words_and_units():
    assert toxicity.units("ab") == ["ab$"] and toxicity.units("words") == ["wor", "word", "words", "words$"]
    assert toxicity.units("longest") == ["lon", "long", "longe", "longes", "longest$"]
    for w in ("a", "ab", "words", "letter", "longest", "understanding"):
        chain = toxicity.units(w)
        assert all(toxicity.parent(b) == a for a, b in zip(chain, chain[1:]))
    assert toxicity.words("Big x9y D\u00e9j\u00e0") == ["big", "x", "y", "d\u00e9j\u00e0"]
    assert toxicity.words("ab\u65e5\u672c\u8a9ecd \u5b57") == ["ab", "\u65e5\u672c", "\u672c\u8a9e", "cd", "\u5b57"]


def test_ends_of_words_and_scripts_without_spaces(spark, make):
    """Words alike in six letters tell texts apart, and so do two characters inside a run without spaces."""
    r = random.Random(6)
    for good, bad, gap in (("computerize", "computational", " "), ("\u65e5\u672c\u4eba", "\u99ac\u9e7f\u8005", "")):
        common = ["good", "day", "the", "sun"] if gap else list("\u5c71\u5ddd\u7530\u6728\u82b1")
        texts = []
        for i in range(300):
            parts = [r.choice(common) for _ in range(50)]
            for _ in range(4):
                parts.insert(r.randrange(len(parts)), bad if i % 3 == 0 else good)
            texts.append(gap.join(parts))
        labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(250)], "doc_id long, quality int, toxic int")
        rows = toxicity.score(spark, make(texts), toxicity.train(spark, make(texts), labels)).collect()
        assert np.mean([x.predicted == (x.doc_id % 3 == 0) for x in rows]) > 0.98
