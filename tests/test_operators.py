"""Boundary rules, round trips and invariants of the index operators."""

import numpy as np
import pytest

from quern.functions import dictcodec, partitions
from quern.operators import boolean, choose, cursors, layout, mining, ranking, stats, tables
from quern.sources import binary, postings as src


@pytest.fixture(scope="module")
def small(spark):
    """Four lists over ten documents."""
    rows = [(1, d, 1 + d % 3) for d in range(10)] + [(2, d, 2) for d in (0, 3, 9)] + [(3, 5, 1)] + [(4, d, 1) for d in (3, 4)]
    return spark.createDataFrame(rows, "term_id long, doc_id long, freq long").cache()


@pytest.fixture(scope="module")
def edge_queries(spark):
    """Two terms; one term; the same twice; an unknown one; terms without a common document; unknown alone."""
    rows = [(0, 1), (0, 2), (1, 3), (2, 2), (2, 2), (3, 2), (3, 99), (4, 3), (4, 4), (5, 98)]
    return spark.createDataFrame(rows, "query_id long, term_id long")


def test_boolean_boundaries(spark, small, edge_queries):
    count = lambda op: {r.query_id: r.results for r in boolean.counts(op(small, edge_queries), edge_queries).collect()}
    assert count(boolean.and_docs) == {0: 3, 1: 1, 2: 3, 3: 0, 4: 0, 5: 0}
    assert count(boolean.or_docs) == {0: 10, 1: 1, 2: 3, 3: 3, 4: 3, 5: 0}
    # |A or B| = |A| + |B| - |A and B|
    pairs = spark.createDataFrame([(0, 1, 2), (1, 2, 2), (2, 3, 4), (3, 1, 77)], "query_id long, a long, b long")
    assert sorted((r.query_id, r.doc_id) for r in boolean.intersect_pairs(small, pairs).collect()) == [(0, 0), (0, 3), (0, 9), (1, 0), (1, 3), (1, 9)]


def test_ranked_boundaries(spark, small, edge_queries):
    docs = src.with_norm(spark.createDataFrame([(d, d) for d in range(10)], "doc_id long, len long"))
    assert abs(docs.agg({"norm_len": "avg"}).first()[0] - 1) < 1e-9
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(ranking.ranked_or(small, docs, edge_queries, 10, 3))
    assert key(ranking.wand(small, docs, edge_queries, 10, 3)) == whole and key(ranking.maxscore(small, docs, edge_queries, 10, 3)) == whole
    assert {r[0] for r in whole} == {0, 1, 2, 3, 4}
    assert {r[0] for r in key(ranking.ranked_and(small, docs, edge_queries, 10, 3))} == {0, 1, 2}
    single = {r[0]: r[3] for r in whole if r[1] == 1}
    assert single[2] > single[3] > 0  # a repeated term weighs more


def test_cursors(spark, small):
    probes = spark.createDataFrame([(2, x) for x in (0, 1, 3, 4, 9, 10)] + [(3, 6)], "term_id long, x long")
    got = {(r.term_id, r.x): (r.next_geq, r.rank) for r in cursors.next_geq(small, probes, 10).collect()}
    assert got == {(2, 0): (0, 0), (2, 1): (3, 1), (2, 3): (3, 1), (2, 4): (9, 2), (2, 9): (9, 2), (2, 10): (10, 3), (3, 6): (10, 1)}
    walk = [(r.pos, r.doc_id, r.next_doc, r.prev_value) for r in cursors.walk(small, 10).where("term_id = 2").orderBy("pos").collect()]
    assert walk == [(0, 0, 3, 0), (1, 3, 9, 0), (2, 9, 10, 3)]


def test_blocks_hold_their_invariants(spark, sf):
    p = src.lineitem_postings(spark, sf, "l_suppkey")
    for bits in (3, 22):
        for r in layout.blocks(p, 64, bits).collect():
            assert sum(r.gaps) == r.docs_universe == r.block_max - r.block_base - (r.n - 1)
            assert len(r.gaps) == len(r.fbias) == r.n <= 64 and min(r.gaps) >= 0 and min(r.fbias) >= 0
    empty = p.limit(0)
    assert layout.blocks(empty).count() == 0 and layout.decode(layout.encode(layout.blocks(empty), "vbyte")).count() == 0
    assert layout.decode_parts(layout.optimal_parts(empty)).count() == 0


def test_partitions_cost_no_more_than_one():
    r = np.random.default_rng(42)
    for gap in (1.02, 1.4, 2, 2.8, 6.5, 15, 80):
        for n in (1, 7, 300, 2100):
            v = np.sort(r.choice(int(n * gap) + 1, n, replace=False))
            ends = partitions.partition(v)
            assert ends[-1] == n and ends == sorted(set(ends))
            assert partitions.total_cost(v, ends) <= partitions.total_cost(v, [n])
            assert np.concatenate([partitions.decode_part(*p) for p in partitions.encode_parts(v, ends)]).tolist() == v.tolist()
    dense = np.concatenate([np.arange(3000), 100_000 + np.arange(0, 300_000, 997)])
    assert partitions.total_cost(dense, partitions.partition(dense)) < partitions.total_cost(dense, [len(dense)])


def test_dictionaries():
    r = np.random.default_rng(1)
    v = np.concatenate([np.zeros(300, int), np.tile([1, 2, 3, 4], 40), r.integers(0, 90_000, 60), np.zeros(20, int), [2**31]])
    entries = [(1, 2, 3, 4) * 4, (1, 2, 3, 4), (1, 2), (0,), (5,), (0, 0), (1, 2, 3, 4)]
    d = dictcodec.Dictionary(entries)
    best, fast = d.encode(v), d.encode(v, optimal=False)
    assert len(best) <= len(fast) < 4 * len(v)
    for data in (best, fast):
        assert d.decode(data, len(v)).tolist() == v.tolist()
    m = dictcodec.MultiDictionary([entries, [(7,)], [], [(1, 2)], [], []])
    for part in (v, v[:1], np.array([7] * 256), np.array([70_000])):
        assert m.decode(m.encode(part), len(part)).tolist() == part.tolist()
    assert [dictcodec.context_of(np.array([x])) for x in (0, 1, 2, 3, 4, 15, 16, 255, 65_535, 65_536)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 5]
    table = dictcodec.merge_overlaps([(1, 2, 3, 4), (3, 4, 5, 6), (2, 3), (9,), (6, 1)])
    for e in [(1, 2, 3, 4), (3, 4, 5, 6), (2, 3), (9,), (6, 1)]:
        assert any(tuple(table[i : i + len(e)]) == e for i in range(len(table)))
    assert len(table) < 4 + 4 + 2 + 1 + 2


def test_dictionary_is_smaller_than_plain_and_stored(spark, sf, tmp_path):
    laid = layout.blocks(src.lineitem_postings(spark, sf, "l_suppkey"))
    built = mining.build_single(spark, laid)
    tables.store_dictionaries(spark, built, f"{tmp_path}/d")
    loaded = tables.load_dictionaries(spark, f"{tmp_path}/d")
    assert all(loaded[k].entries == built[k].entries for k in built)
    sent = spark.sparkContext.broadcast(loaded)
    size = lambda name, d=None: stats.size_stats(layout.encode(laid, name, d)).first().docs_bytes
    assert size("single_optimal", sent) <= size("single_greedy", sent) < size("u32")


def test_binary_files(spark, tmp_path):
    lists = [[0, 3, 9], [5], [1, 2, 3, 4]]
    (tmp_path / "c.docs").write_bytes(binary.dump([[10], *lists, []]) + b"\x05\0\0\0\x07\0\0\0")
    (tmp_path / "c.freqs").write_bytes(binary.dump([[1, 2, 3], [], [9], [1, 1, 1, 1], [4]]))
    (tmp_path / "c.sizes").write_bytes(binary.dump([list(range(10))]))
    n, p = binary.read_postings(spark, f"file://{tmp_path}/c")
    rows = sorted(map(tuple, p.collect()))
    assert n == 10 and rows == [(0, 0, 1), (0, 3, 2), (0, 9, 3), (1, 5, 9), (2, 1, 1), (2, 2, 1), (2, 3, 1), (2, 4, 1), (3, 7, 4)]  # the cut tail as far as it goes
    assert [r.len for r in binary.read_sizes(spark, f"file://{tmp_path}/c").orderBy("doc_id").collect()] == list(range(10))
    with pytest.raises(ValueError):
        (tmp_path / "bad.docs").write_bytes(binary.dump([[1, 2]]))
        binary.read_postings(spark, f"file://{tmp_path}/bad")
    (tmp_path / "log").write_text("1 2\t3\n\n 7 7 \n5")
    assert sorted(map(tuple, binary.read_queries(spark, f"file://{tmp_path}/log").collect())) == [(0, 1), (0, 2), (0, 3), (2, 7), (2, 7), (3, 5)]
    assert list(binary.parse_blocks(np.array([2, 2, 5, 8, 9, 1, 1, 4], "<u4").tobytes()))[0][0] == 5
    with pytest.raises(ValueError):
        list(binary.parse_blocks(np.array([1, 0, 5], "<u4").tobytes()))


def test_tables(spark, sf, small, tmp_path):
    laid = layout.blocks(small, 4)
    index = layout.encode(laid, "interpolative")
    tables.freeze(index, f"{tmp_path}/i")
    back = layout.decode(tables.open_index(spark, f"{tmp_path}/i"))
    assert layout.verify(small, back).first() == (0, 0)
    assert layout.decode(tables.open_index(spark, f"{tmp_path}/i", [2])).count() == 3
    changed = back.where("doc_id <> 3")
    assert layout.verify(small, changed).first() == (3, 0)
    q = spark.createDataFrame([(0, 1), (0, 2)], "query_id long, term_id long")
    profile = stats.block_profile(laid, q, small)
    assert sorted(map(tuple, profile.collect())) == [(1, 0, 2), (1, 2, 1)]
    tables.write_profile(profile, f"{tmp_path}/p")
    assert sorted(map(tuple, tables.read_profile(spark, f"{tmp_path}/p").collect())) == [(1, 0, 2), (1, 2, 1)]
    both = tables.append(small, small)
    assert both.count() == 2 * small.count() and both.agg({"term_id": "max"}).first()[0] == 9
    made = tables.or_build(spark, f"{tmp_path}/t", lambda: small)
    assert made.count() == small.count() and tables.or_build(spark, f"{tmp_path}/t", lambda: 1 / 0).count() == made.count()
    watched, seen = tables.counted(small)
    watched.collect()
    assert seen.get["postings"] == 16
    assert tables.stats_line(spark.createDataFrame([(1, "x")], "a int, b string")).first().line == '{"a":1,"b":"x"}'


def test_choices(spark, sf, tmp_path):
    laid = layout.blocks(src.lineitem_postings(spark, sf, "l_suppkey"), 128)
    points = choose.candidates(laid, ("u32", "vbyte", "interpolative"))
    least = {(r.term_id, r.block_no): r["size"] for r in points.groupBy("term_id", "block_no").agg({"size": "min"}).withColumnRenamed("min(size)", "size").collect()}
    assert {(r.term_id, r.block_no): r["size"] for r in choose.smallest(points).collect()} == least
    timed = points.selectExpr("*", "case codec when 'u32' then 1.0D when 'vbyte' then 2.0D else 5.0D end as time").cache()
    budget = sum(least.values()) + 500
    got = choose.within_budget(timed, budget).collect()
    assert sum(r["size"] for r in got) <= budget and len(got) == len(least)
    (tmp_path / "w").write_text("type vbyte  n 0.5 bias 2\ntype u32  size 1.5\n")
    assert sorted(map(tuple, choose.load_predictors(spark, f"file://{tmp_path}/w").collect())) == [("u32", "size", 1.5), ("vbyte", "bias", 2.0), ("vbyte", "n", 0.5)]
    (tmp_path / "bad").write_text("vbyte n 0.5\n")
    with pytest.raises(ValueError):
        choose.load_predictors(spark, f"file://{tmp_path}/bad")
    df = spark.range(200).selectExpr("cast(id as double) as n", "cast(id * id % 17 as double) as size", "3.0D * id - 2.0D * (id * id % 17) + 5.0D + if(id % 20 = 0, 500.0D, 0.0D) as t")
    w = choose.least_absolute(df, ["n", "size"], "t")
    assert abs(w["n"] - 3) < 0.02 and abs(w["size"] + 2) < 0.05 and abs(w["bias"] - 5) < 0.5
    assert df.limit(1).select(choose.predict({"n": 2.0, "bias": 1.0}).alias("x")).first().x == 1.0


def test_cursors_over_ranges(spark):
    """Steps, probes and sums do not depend on how lists are cut."""
    from quern.operators import cursors

    r = np.random.default_rng(9)
    rows = [(t, int(d), 1 + int(d) % 3) for t in range(4) for d in np.sort(r.choice(400, [1, 5, 90, 300][t], replace=False))]
    p = spark.createDataFrame(rows, "term_id long, doc_id long, freq long")
    probes = spark.createDataFrame([(t, x) for t in range(4) for x in range(0, 410, 3)], "term_id long, x long")
    docs = {t: [d for u, d, _ in rows if u == t] for t in range(4)}
    for bits in (3, 22):
        got = sorted(map(tuple, cursors.walk(p, 400, bits).collect()))
        assert got == [(t, k, d, [*v, 400][k + 1], v[k - 1] if k else 0) for t, v in docs.items() for k, d in enumerate(v)]
        got = sorted(map(tuple, cursors.next_geq(p, probes, 400, bits).collect()))
        assert got == [(t, x, min([d for d in v if d >= x], default=400), sum(d < x for d in v)) for t, v in docs.items() for x in range(0, 410, 3)]
    assert sorted(map(tuple, layout.from_gaps(layout.gaps(p, 4), 7).collect())) == sorted(rows)


def test_bitmap_ranks_over_ranges(spark):
    """Ranks do not depend on how lists are cut; unknown lists, empty ranges and the last bit of a word count as they should."""
    r = np.random.default_rng(4)
    docs = {0: [63], 1: [0, 63, 64, 127, 1_000_000], 2: sorted(r.choice(3000, 900, replace=False).tolist())}
    p = spark.createDataFrame([(t, d, 1) for t, v in docs.items() for d in v], "term_id long, doc_id long, freq long")
    xs = [0, 1, 62, 63, 64, 65, 127, 128, 500, 2999, 3000, 999_999, 1_000_000, 1_000_001, 5_000_000]
    probes = spark.createDataFrame([(t, x) for t in (*docs, 9) for x in xs] + [(1, 64)], "term_id long, x long")
    for bits in (6, 9, 22):
        got = sorted(map(tuple, cursors.bitmap_rank(cursors.bitmap(p), probes, bits).collect()))
        assert got == sorted((t, x, sum(d < x for d in docs.get(t, []))) for t in (*docs, 9) for x in xs)


def test_stored_statistics_and_rows(spark, tmp_path):
    rows = [([1, 2], 5), ([3], 5), ([0] * 16, 2), ([7], 9), ([4, 4, 4, 4], 1)]
    patterns = spark.createDataFrame(rows, "entry array<long>, freq long")
    path = f"file://{tmp_path}/s"
    tables.store_statistics(patterns, 44, path)
    whole = sorted((r.entry, r.freq, r.total) for r in tables.load_statistics(spark, path).collect())
    assert whole == sorted((e, f, 44) for e, f in rows)
    assert sorted(r.entry for r in tables.load_statistics(spark, path, 3).collect()) == [[1, 2], [3], [7]]
    ranked = mining.ranked(patterns)
    fixed = mining.rectangular(ranked).collect()
    assert all(len(r.row) == 17 for r in fixed)
    back = {r.code: r.entry for r in mining.from_rectangular(mining.rectangular(ranked)).collect()}
    assert back == {r.code: r.entry for r in ranked.collect()}


def test_throughput_counts(spark, small):
    index = layout.encode(layout.blocks(small), "vbyte").cache()
    row = stats.throughput(index, layout.decode(index)).first()
    assert (row.lists, row.postings) == (4, 16) and row.bytes > 0 and row.seconds > 0
    assert abs(row.ns_per_int * 32 / 1e9 - row.seconds) < 1e-9 and abs(row.bits_per_int * 32 - 8 * row.bytes) < 1e-6
