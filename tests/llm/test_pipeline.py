"""Every stage of the pipeline against a plain version on what it was given."""

import re
from collections import Counter

import corpus_pipeline as p

from quern.llm import queries as q
from quern.llm import suffix_dedup

from .test_light_operators import brute_items, check_packing
from .test_ngram_join import brute


def repeated_bytes(texts, length):
    raw = [t.encode() for t in texts]
    n = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    return [{j for i in range(len(t) - length + 1) if n[t[i : i + length]] > 1 for j in range(i, i + length)} for t in raw]


def whole_characters(text, gone):
    """The characters none of whose bytes are in ``gone``."""
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        if not gone.intersection(range(at, at + n)):
            out.append(c)
        at += n
    return "".join(out)


def without_words(text, hit):
    """``text`` without the runs of hit words, from the first character of a run to its last."""
    found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))
    out, at = [], 0
    for i, m in enumerate(found):
        if i in hit:
            if i - 1 not in hit:
                out.append(text[at : m.start()])
            at = m.end()
    return "".join([*out, text[at:]])


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = q.table(spark, sf, "documents")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in q.table(spark, sf, "benchmark").collect()]
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        before = {r.doc_id: r for r in docs.collect()}
        after = out.collect()
        assert after
        if name == "packing":
            check_packing(after, [(i, r.text) for i, r in before.items()], 4096)
            break
        assert out.columns == columns
        kept = {r.doc_id: r for r in after}
        assert len(kept) == len(after) and set(kept) <= set(before)
        same = lambda r, s: all(r[c] == s[c] for c in columns if c != "text")
        assert all(same(r, before[i]) for i, r in kept.items())
        ids = sorted(before)
        texts = [before[i].text for i in ids]
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in q.table(spark, sf, "labels").collect()}
            right = [(i in kept) == (labels[i] == 0) for i in ids if i in labels]
            assert sum(right) >= 0.9 * len(right) and all(r.text == before[i].text for i, r in kept.items())
        elif name == "ngram_join":
            assert set(kept) == {c for _, _, c in brute(ids, texts)} and len(kept) < len(before)
        elif name == "suffix_dedup":
            assert set(kept) == set(before)
            for i, t, gone in zip(ids, texts, repeated_bytes(texts, p.REPEATED_BYTES), strict=True):
                assert kept[i].text == whole_characters(t, gone)
            assert any(kept[i].text != t for i, t in zip(ids, texts, strict=True))
        else:
            for i, t in zip(ids, texts, strict=True):
                n, hit, _ = brute_items(t, items)
                assert (i in kept) == (len(hit) <= 0.5 * n)
                if i in kept:
                    assert kept[i].text == without_words(t, hit)
        docs = out


def test_packing_keeps_ids(spark, edges, make):
    import zlib

    from quern.llm import packing

    rows = p.pack(spark, make(edges), "").collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    check_packing(rows, list(enumerate(edges)), 4096)
    joined = packing.sequences(p.pack(spark, make(edges), "")).collect()
    assert sum(s.n_tokens for s in joined) == sum(r.length for r in rows)


def test_whole_characters():
    text = "aéb–c".encode()
    assert suffix_dedup.whole_characters(text, [(2, 3)]) == "ab–c"
    assert suffix_dedup.whole_characters(text, [(0, 2), (5, 6)]) == "bc"
    assert suffix_dedup.whole_characters(text, [(0, len(text))]) == ""


def test_rows_that_share_an_id(spark, make):
    from quern.llm import ngram_join

    texts = ["one two three four five six", "one two three four five six", "other words here at all now", None, None]
    kept = ngram_join.keep_first(spark, make(texts, [1, 1, 1, None, 2])).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(0, ""), (1, texts[0]), (1, texts[2]), (2, "")])
    a, b = "ab cd " * 20, "xyz " * 30
    out = suffix_dedup.remove(spark, make([a + b, b, a, None, b], [1, 1, None, 7, 1]), 20)
    assert out.columns == make([]).columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect() if r.text is not None) == [(0, ""), (1, ""), (1, ""), (1, "")]
    assert out.count() == 5


def test_one_row_of_each_component(spark, make):
    from quern.llm import ngram_join

    words = [f"w{i}" for i in range(100)]
    base, near = " ".join(words), " ".join([*words[:-1], "other"])
    other = "quite another text with words of its own"
    texts = [base, near, base, "", near, other, other + ".", other, "  ", "", None]
    ids = [1, None, None, None, 3, 5, 5, 5, 3, None, None]
    kept = ngram_join.keep_first(spark, make(texts, ids)).collect()
    assert sum(bool((r.text or "").strip()) for r in kept) == 3
    assert [r.doc_id for r in kept if r.text == base] == [1] and not any(r.text == near for r in kept)
    assert sorted(r.doc_id for r in kept if (r.text or "").startswith("quite")) == [5, 5]  # the full stop makes too few n-grams common
    assert sorted((r.doc_id or 0, r.text or "") for r in kept if not (r.text or "").strip()) == [(0, ""), (3, "  ")]
    same = ngram_join.keep_first(spark, make([base, near, base], [7, 7, 7])).collect()
    assert len(same) == 1 and same[0].doc_id == 7
