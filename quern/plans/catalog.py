"""Queries by name, over whole tables, and the SQL that gives the same rows.

Query sets are stated ones: orders (or customers) whose key is divisible by 50,
and all benchmark items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.codecs import CODECS
from quern.operators import boolean, cursors, layout, mining, ranking, space, stats
from quern.sources import binary, postings as src, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- common parts -----------------------------------------------------------

PART = "p AS (SELECT l_partkey AS term_id, l_orderkey AS doc_id, count(*) AS freq FROM lineitem GROUP BY 1, 2)"
SUPP = PART.replace("l_partkey", "l_suppkey")
DOCS = "dl AS (SELECT o_orderkey AS doc_id, CAST(coalesce(sum(freq), 0) AS BIGINT) AS len FROM orders LEFT JOIN p ON o_orderkey = doc_id GROUP BY 1), docs AS (SELECT doc_id, len, len / (SELECT avg(len) FROM dl) AS norm_len FROM dl)"
Q_ORDER = "q AS (SELECT l_orderkey AS query_id, l_partkey AS term_id FROM lineitem WHERE l_orderkey % 50 = 0)"
Q_CUST = "q AS (SELECT o_custkey AS query_id, l_partkey AS term_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey % 50 = 0)"
TOKENS = "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents), v AS (SELECT token, CAST(row_number() OVER (ORDER BY substr(token, 1, 2), token) AS BIGINT) AS term_id FROM (SELECT DISTINCT token FROM tok))"
TEXT = TOKENS + ", p AS (SELECT term_id, doc_id, count(*) AS freq FROM tok JOIN v USING (token) GROUP BY 1, 2)"
TEXT_DOCS = "dl AS (SELECT d.doc_id, CAST(coalesce(sum(freq), 0) AS BIGINT) AS len FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id GROUP BY 1), docs AS (SELECT doc_id, len, len / (SELECT avg(len) FROM dl) AS norm_len FROM dl)"
Q_TEXT = "q AS (SELECT item_id AS query_id, term_id FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) JOIN v USING (token))"
DW = "(freq / (freq + CAST(1.2 AS DOUBLE) * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * norm_len)))"
W = "WINDOW w AS (PARTITION BY term_id ORDER BY doc_id)"
GAPS = "g AS (SELECT term_id, doc_id, freq, row_number() OVER w - 1 AS pos, coalesce(lag(doc_id) OVER w, -1) AS prev, doc_id - coalesce(lag(doc_id) OVER w, -1) - 1 AS gap, freq - 1 AS fbias FROM p WINDOW w AS (PARTITION BY term_id ORDER BY doc_id))"


def ranked_sql(family: str, docs: str, queries: str, n: str, conjunctive: bool = False) -> str:
    all_terms = "JOIN (SELECT query_id, count(*) AS asked FROM qt GROUP BY 1) a USING (query_id) WHERE hits = asked" if conjunctive else ""
    return f"""
WITH {family}, {docs}, {queries},
qt AS (SELECT query_id, term_id, count(*) AS qtf FROM q GROUP BY 1, 2),
qw AS (SELECT query_id, term_id, qtf * greatest(CAST(1e-6 AS DOUBLE), ln((({n}) - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)))) * CAST(2.2 AS DOUBLE) AS qw
       FROM qt JOIN (SELECT term_id, count(*) AS df FROM p GROUP BY 1) t USING (term_id)),
s AS (SELECT query_id, doc_id, round(sum(qw * {DW}), 6) AS score, count(*) AS hits FROM qw JOIN p USING (term_id) JOIN docs USING (doc_id) GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s {all_terms})
SELECT * FROM r WHERE rank <= 10"""


N_ORDERS, N_TEXTS = "SELECT count(*) FROM orders", "SELECT count(*) FROM documents"


def part_family(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    p = src.lineitem_postings(spark, sf)
    return p, src.order_docs(spark, sf, p), src.table(spark, sf, "orders").count()


# ---- ranked retrieval -------------------------------------------------------

for _name, _op in (("ranked_or_top10", ranking.ranked_or), ("wand_top10", ranking.wand), ("maxscore_top10", ranking.maxscore)):

    @query(_name, ranked_sql(PART, DOCS, Q_ORDER, N_ORDERS))
    def _(spark, sf, op=_op):
        p, docs, n = part_family(spark, sf)
        return op(p, docs, src.order_queries(spark, sf), n)


@query("ranked_and_top10", ranked_sql(PART, DOCS, Q_ORDER, N_ORDERS, True))
def _(spark, sf):
    p, docs, n = part_family(spark, sf)
    return ranking.ranked_and(p, docs, src.order_queries(spark, sf), n)


@query("ranked_or_repeated_terms", ranked_sql(PART, DOCS, Q_CUST, N_ORDERS))
def _(spark, sf):
    p, docs, n = part_family(spark, sf)
    return ranking.ranked_or(p, docs, src.customer_queries(spark, sf), n)


for _name, _op in (("ranked_or_text", ranking.ranked_or), ("wand_text", ranking.wand), ("maxscore_text", ranking.maxscore)):

    @query(_name, ranked_sql(TEXT, TEXT_DOCS, Q_TEXT, N_TEXTS))
    def _(spark, sf, op=_op):
        p, docs = src.text_counts(spark, sf)
        return op(p, docs, src.word_queries(spark, sf), src.table(spark, sf, "documents").count())


@query("query_freqs", f"WITH {Q_CUST} SELECT query_id, term_id, count(*) AS qtf FROM q GROUP BY 1, 2")
def _(spark, sf):
    return ranking.query_freqs(src.customer_queries(spark, sf))


@query("unique_query_terms", f"WITH {Q_CUST} SELECT DISTINCT query_id, term_id FROM q")
def _(spark, sf):
    return src.customer_queries(spark, sf).dropDuplicates(["query_id", "term_id"])


@query("term_stats", f"WITH {PART}, {DOCS} SELECT term_id, count(*) AS df, CAST(sum(freq) AS BIGINT) AS cf, round(max({DW}), 9) AS max_weight FROM p JOIN docs USING (doc_id) GROUP BY 1")
def _(spark, sf):
    p, docs, _ = part_family(spark, sf)
    return ranking.term_stats(p, docs).withColumn("max_weight", F.round("max_weight", 9))


@query("doc_norms", f"WITH {PART}, {DOCS} SELECT doc_id, len, round(norm_len, 9) AS norm_len FROM docs")
def _(spark, sf):
    return part_family(spark, sf)[1].withColumn("norm_len", F.round("norm_len", 9))


# ---- boolean retrieval ------------------------------------------------------

Q_SET = "qs AS (SELECT DISTINCT query_id, term_id FROM q)"
AND = "m AS (SELECT query_id, doc_id, CAST(sum(freq) AS BIGINT) AS freq, count(*) AS hits FROM qs JOIN p USING (term_id) GROUP BY 1, 2), a AS (SELECT query_id, doc_id, freq FROM m JOIN (SELECT query_id, count(*) AS asked FROM qs GROUP BY 1) t USING (query_id) WHERE hits = asked)"
OR = "a AS (SELECT query_id, doc_id, CAST(sum(freq) AS BIGINT) AS freq FROM qs JOIN p USING (term_id) GROUP BY 1, 2)"
COUNT = "SELECT query_id, count(doc_id) AS results FROM (SELECT DISTINCT query_id FROM q) x LEFT JOIN a USING (query_id) GROUP BY 1"

for _name, _op, _sql in (("and_count", boolean.and_docs, AND), ("or_count", boolean.or_docs, OR)):

    @query(_name, f"WITH {PART}, {Q_ORDER}, {Q_SET}, {_sql} {COUNT}")
    def _(spark, sf, op=_op):
        q = src.order_queries(spark, sf)
        return boolean.counts(op(src.lineitem_postings(spark, sf), q), q)

    @query(_name.replace("count", "freq"), f"WITH {PART}, {Q_ORDER}, {Q_SET}, {_sql} SELECT query_id, doc_id, freq FROM a")
    def _(spark, sf, op=_op):
        return op(src.lineitem_postings(spark, sf), src.order_queries(spark, sf))


@query("and_count_long", f"WITH {PART}, {Q_CUST}, {Q_SET}, {AND} {COUNT}")
def _(spark, sf):
    q = src.customer_queries(spark, sf)
    return boolean.counts(boolean.and_docs(src.lineitem_postings(spark, sf), q), q)


PAIRS = "pairs AS (SELECT query_id, list_sort(list(DISTINCT term_id))[1] AS a, list_sort(list(DISTINCT term_id))[2] AS b FROM q GROUP BY 1 HAVING count(DISTINCT term_id) > 1)"


@query("pair_intersect", f"WITH {PART}, {Q_ORDER}, {PAIRS} SELECT query_id, x.doc_id FROM pairs JOIN p x ON x.term_id = a JOIN p y ON y.term_id = b AND y.doc_id = x.doc_id")
def _(spark, sf):
    return boolean.intersect_pairs(src.lineitem_postings(spark, sf), src.pair_queries(spark, sf))


# ---- sequence transforms and cursors ----------------------------------------


@query("gaps", f"WITH {PART}, {GAPS} SELECT term_id, doc_id, pos, gap, fbias FROM g")
def _(spark, sf):
    return layout.gaps(src.lineitem_postings(spark, sf), 10).select("term_id", "doc_id", "pos", "gap", "fbias")


@query("gaps_back", f"WITH {PART} SELECT * FROM p")
def _(spark, sf):
    return layout.from_gaps(layout.gaps(src.lineitem_postings(spark, sf)))


@query("strict_transform", f"WITH {PART} SELECT term_id, doc_id, doc_id - (row_number() OVER w - 1) AS reduced, (SELECT count(*) FROM orders) - count(*) OVER (PARTITION BY term_id) + 1 AS reduced_universe FROM p {W}")
def _(spark, sf):
    n = src.table(spark, sf, "orders").count()
    g = layout.gaps(src.lineitem_postings(spark, sf))
    sizes = g.groupBy("term_id").agg(F.count("*").alias("n"))
    return g.join(sizes, "term_id").select("term_id", "doc_id", (F.col("doc_id") - F.col("pos")).alias("reduced"), (F.lit(n) - F.col("n") + 1).alias("reduced_universe"))


@query("positive_sequence", f"WITH {PART}, s AS (SELECT term_id, doc_id, CAST(sum(freq) OVER w AS BIGINT) AS upto FROM p {W}) SELECT term_id, doc_id, upto, upto - coalesce(lag(upto) OVER w, 0) AS value FROM s {W}")
def _(spark, sf):
    order = cursors.in_list_order()
    sums = src.lineitem_postings(spark, sf).withColumn("upto", F.sum("freq").over(order.rowsBetween(-(1 << 63), 0)))
    return sums.select("term_id", "doc_id", "upto", (F.col("upto") - F.coalesce(F.lag("upto").over(order), F.lit(0))).alias("value"))


@query("list_length_filter", f"WITH {PART} SELECT term_id, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 30")
def _(spark, sf):
    return src.lineitem_postings(spark, sf).groupBy("term_id").agg(F.count("*").alias("n")).where("n > 30")


@query("cursor_walk", f"WITH {PART} SELECT term_id, row_number() OVER w - 1 AS pos, doc_id, coalesce(lead(doc_id) OVER w, (SELECT count(*) FROM orders)) AS next_doc, coalesce(lag(doc_id) OVER w, 0) AS prev_value FROM p {W}")
def _(spark, sf):
    return cursors.walk(src.lineitem_postings(spark, sf), src.table(spark, sf, "orders").count())




@query("next_geq", f"WITH {SUPP}, pr AS (SELECT DISTINCT term_id, l_orderkey + 1 AS x FROM p JOIN lineitem ON doc_id = l_orderkey) SELECT pr.term_id, x, coalesce((SELECT min(doc_id) FROM p WHERE p.term_id = pr.term_id AND doc_id >= x), (SELECT count(*) FROM orders)) AS next_geq, (SELECT count(*) FROM p WHERE p.term_id = pr.term_id AND doc_id < x) AS rank FROM pr")
def _(spark, sf):
    p = src.lineitem_postings(spark, sf, "l_suppkey")
    return cursors.next_geq(p, p.select("term_id", (F.col("doc_id") + 1).alias("x")), src.table(spark, sf, "orders").count())


@query("bitmap_words", f"WITH {SUPP} SELECT term_id, doc_id // 64 AS word, bit_or(CASE WHEN doc_id % 64 = 63 THEN CAST('-9223372036854775808' AS BIGINT) ELSE CAST(1 AS BIGINT) << (doc_id % 64) END) AS bits FROM p GROUP BY 1, 2")
def _(spark, sf):
    return cursors.bitmap(src.lineitem_postings(spark, sf, "l_suppkey"))


@query("bitmap_rank", f"WITH {SUPP}, pr AS (SELECT DISTINCT term_id, l_orderkey + 1 AS x FROM p JOIN lineitem ON doc_id = l_orderkey) SELECT pr.term_id, x, (SELECT count(*) FROM p WHERE p.term_id = pr.term_id AND doc_id < x) AS rank FROM pr")
def _(spark, sf):
    p = src.lineitem_postings(spark, sf, "l_suppkey")
    return cursors.bitmap_rank(cursors.bitmap(p), p.select("term_id", (F.col("doc_id") + 1).alias("x")))


@query("cursor_move", f"WITH {SUPP}, r AS (SELECT term_id, row_number() OVER w - 1 AS pos, doc_id, freq, count(*) OVER (PARTITION BY term_id) AS n FROM p {W}) SELECT term_id, pos, doc_id, freq FROM r WHERE pos = n // 2")
def _(spark, sf):
    p = src.lineitem_postings(spark, sf, "l_suppkey")
    return cursors.move(p, p.groupBy("term_id").agg(F.expr("count(*) div 2").alias("pos")))


@query("integer_logs", "SELECT l_orderkey, l_linenumber, CAST(length(bin(l_orderkey)) - 1 AS BIGINT) AS floor_log2, CAST(CASE WHEN l_orderkey <= 1 THEN 0 ELSE length(bin(l_orderkey - 1)) END AS BIGINT) AS ceil_log2, l_orderkey > 0 AND bit_count(l_orderkey) = 1 AS is_power FROM lineitem")
def _(spark, sf):
    x = F.col("l_orderkey")
    return src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", space.floor_log2(x).alias("floor_log2"), space.ceil_log2(x).alias("ceil_log2"), ((x > 0) & (F.bit_count(x) == 1)).alias("is_power"))


# ---- blocks and partitions --------------------------------------------------

BLOCKS = "b AS (SELECT term_id, pos // 256 AS block_no, count(*) AS n, min(prev) + 1 AS block_base, max(doc_id) AS block_max, CAST(sum(gap) AS BIGINT) AS docs_universe, max(gap) AS most FROM g GROUP BY 1, 2)"


@query("blocks", f"WITH {SUPP}, {GAPS}, {BLOCKS} SELECT term_id, block_no, n, block_base, block_max, docs_universe FROM b")
def _(spark, sf):
    return layout.blocks(src.lineitem_postings(spark, sf, "l_suppkey"), range_bits=12).drop("gaps", "fbias")


@query("blocks_text", f"WITH {TEXT}, {GAPS}, {BLOCKS} SELECT term_id, block_no, n, block_base, block_max, docs_universe FROM b")
def _(spark, sf):
    return layout.blocks(src.text_postings(spark, sf)[0]).drop("gaps", "fbias")


@query("block_contexts", f"WITH {SUPP}, {GAPS}, {BLOCKS}, c AS (SELECT term_id, block_no, most, CASE WHEN most <= 1 THEN 0 ELSE length(bin(most)) END AS bits FROM b) SELECT term_id, block_no, CAST(CASE WHEN most <= 1 THEN 0 WHEN bits <= 1 THEN 0 ELSE length(bin(bits - 1)) END AS BIGINT) AS context FROM c")
def _(spark, sf):
    laid = layout.blocks(src.lineitem_postings(spark, sf, "l_suppkey"))
    return laid.select("term_id", "block_no", space.context(F.array_max("gaps")).alias("context"))


@query("block_counts", f"WITH {SUPP}, {GAPS}, {BLOCKS} SELECT term_id, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1")
def _(spark, sf):
    return layout.blocks(src.lineitem_postings(spark, sf, "l_suppkey")).groupBy("term_id").agg(F.count("*").alias("blocks"), F.sum("n").alias("n"))


@query("uniform_partitions", f"WITH {SUPP}, {GAPS} SELECT term_id, pos // 128 AS part_no, count(*) AS n, min(prev) + 1 AS base, max(doc_id) AS upper FROM g GROUP BY 1, 2")
def _(spark, sf):
    return layout.uniform_parts(src.lineitem_postings(spark, sf, "l_suppkey"))


@query("optimal_partitions", f"WITH {SUPP} SELECT term_id, doc_id FROM p")
def _(spark, sf):
    return layout.decode_parts(layout.optimal_parts(src.lineitem_postings(spark, sf, "l_suppkey")))


@query("optimal_partitions_text", f"WITH {TEXT} SELECT term_id, doc_id FROM p")
def _(spark, sf):
    return layout.decode_parts(layout.optimal_parts(src.text_postings(spark, sf)[0]))


@query("partition_stats")
def _(spark, sf):
    parts = layout.optimal_parts(src.lineitem_postings(spark, sf, "l_suppkey"))
    return parts.groupBy("form").agg(F.count("*").alias("parts"), F.avg("n").alias("postings_per_part"), F.sum(F.octet_length("payload")).alias("bytes"))


# ---- codes: encode, decode, compare -----------------------------------------

#: Documents of a run: whole lists are encoded in such runs, so no list is one row.
LIST = 1 << 13


def _index(spark: SparkSession, sf: str, codec: str, size: int) -> DataFrame:
    return layout.decode(layout.encode(layout.blocks(src.lineitem_postings(spark, sf, "l_suppkey"), size), codec))


for _name in CODECS:

    @query(f"list_{_name}", f"WITH {SUPP} SELECT * FROM p")
    def _(spark, sf, codec=_name):
        return _index(spark, sf, codec, LIST)

    if _name not in ("ef", "single"):

        @query(f"index_{_name}", f"WITH {SUPP} SELECT * FROM p")
        def _(spark, sf, codec=_name):
            return _index(spark, sf, codec, layout.BLOCK)


# Index types without blocks: whole lists by Elias-Fano, or by their cheapest form; partitions of 128 documents by theirs.
for _name, _codec, _size in (("index_ef", "ef", LIST), ("index_single", "single", LIST), ("index_uniform", "single", 128)):

    @query(_name, f"WITH {SUPP} SELECT * FROM p")
    def _(spark, sf, codec=_codec, size=_size):
        return _index(spark, sf, codec, size)


def _dictionary_index(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    laid = layout.blocks(src.lineitem_postings(spark, sf, "l_suppkey"))
    sent = spark.sparkContext.broadcast(build(spark, laid))  # entries are bounded by what symbols can name
    return layout.decode(layout.encode(laid, name, sent), sent)


for _name, _build in (("single_greedy", mining.build_single), ("single_optimal", mining.build_single), ("multi_optimal", mining.build_multi)):

    @query(f"index_{_name}", f"WITH {SUPP} SELECT * FROM p")
    def _(spark, sf, name=_name, build=_build):
        return _dictionary_index(spark, sf, name, build)


@query("index_text_optpfor", f"WITH {TEXT} SELECT * FROM p")
def _(spark, sf):
    return layout.decode(layout.encode(layout.blocks(src.text_postings(spark, sf)[0]), "optpfor"))


@query("verify_index", "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra")
def _(spark, sf):
    p = src.lineitem_postings(spark, sf, "l_suppkey")
    return layout.verify(p, layout.decode(layout.encode(layout.blocks(p), "interpolative")))


@query("reorder_blocks", f"WITH {SUPP} SELECT * FROM p")
def _(spark, sf):
    index = layout.encode(layout.blocks(src.lineitem_postings(spark, sf, "l_suppkey")), "vbyte")
    return layout.decode(index.repartition(F.xxhash64("block_no", "term_id")))


# ---- sizes ------------------------------------------------------------------

FLOOR = "(length(bin({0})) - 1)"
CEIL = "(CASE WHEN {0} <= 1 THEN 0 ELSE length(bin(CAST({0} - 1 AS BIGINT))) END)"


def _fl(x: str) -> str:
    return FLOOR.format(x)


def _ef(u: str, n: str) -> str:
    low = f"(CASE WHEN {u} > {n} THEN {_fl(f'({u} // {n})')} ELSE 0 END)"
    high = f"({n} + ({u} // CAST(pow(2, {low}) AS BIGINT)) + 2)"
    return f"CAST(((({high} - {n}) // 512) + ({n} // 256)) * {CEIL.format(high)} + {high} + {n} * {low} AS BIGINT)"


def _rb(u: str, n: str) -> str:
    return f"CAST(({u} // 512) * {CEIL.format(f'({n} + 1)')} + ({n} // 256) * {CEIL.format(u)} + {u} AS BIGINT)"


def _gamma(x: str) -> str:
    return f"(2 * {_fl(f'({x} + 1)')} + 1)"


def _sizes(family: str, n_docs: str) -> str:
    header = f"CAST({_gamma('(cf - 1)')} + CASE WHEN cf > 1 THEN {CEIL.format('(cf + 1)')} ELSE 0 END AS BIGINT)"
    return f"""WITH {family}, l AS (SELECT term_id, count(*) AS n, CAST(sum(freq) AS BIGINT) AS cf, ({n_docs}) AS u FROM p GROUP BY 1)
SELECT term_id, n, {_ef("u", "n")} AS ef, {_ef("(u - n + 1)", "n")} AS strict_ef, {_rb("u", "n")} AS bitmap,
CAST(CASE WHEN u = n THEN 0 ELSE least({_ef("u", "n")}, {_rb("u", "n")}) + 1 END AS BIGINT) AS indexed, {header} AS header FROM l"""


@query("list_sizes", _sizes(SUPP, N_ORDERS))
def _(spark, sf):
    return space.list_sizes(src.lineitem_postings(spark, sf, "l_suppkey"), src.table(spark, sf, "orders").count())


@query("list_sizes_text", _sizes(TEXT, N_TEXTS))
def _(spark, sf):
    return space.list_sizes(src.text_postings(spark, sf)[0], src.table(spark, sf, "documents").count())


VB = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"
GB = "CASE WHEN gap < 256 THEN 1 WHEN gap < 65536 THEN 2 WHEN gap < 16777216 THEN 3 ELSE 4 END"
_K = _fl("(gap + 1)")
SIZES = f"""s AS (SELECT term_id, pos // 256 AS block_no, count(*) AS n, count(*) * 4 AS u32, CAST(sum({VB.format("gap")}) AS BIGINT) AS vbyte,
CAST((count(*) + 3) // 4 + sum({GB}) AS BIGINT) AS group_bytes, CAST(sum({_gamma("gap")}) AS BIGINT) AS gamma_bits,
CAST(sum({_gamma(_K)} + {_K}) AS BIGINT) AS delta_bits FROM g GROUP BY 1, 2)"""


@query("block_sizes", f"WITH {SUPP}, {GAPS}, {SIZES} SELECT * FROM s")
def _(spark, sf):
    return space.block_sizes(layout.gaps(src.lineitem_postings(spark, sf, "l_suppkey")))


@query("block_list_bytes", f"WITH {SUPP}, {GAPS}, {SIZES}, l AS (SELECT term_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS blocks, CAST(sum(vbyte) AS BIGINT) AS payload FROM s GROUP BY 1) SELECT term_id, n, blocks, CAST(({VB.format('n')}) + 8 * blocks - 4 + payload AS BIGINT) AS bytes FROM l")
def _(spark, sf):
    return space.block_list_bytes(space.block_sizes(layout.gaps(src.lineitem_postings(spark, sf, "l_suppkey"))))


@query("cheapest_code", f"WITH {SUPP}, {GAPS}, {SIZES} SELECT term_id, block_no, least(u32, vbyte, group_bytes, (gamma_bits + 7) // 8, (delta_bits + 7) // 8) AS bytes FROM s")
def _(spark, sf):
    s = space.block_sizes(layout.gaps(src.lineitem_postings(spark, sf, "l_suppkey")))
    return s.select("term_id", "block_no", F.least("u32", "vbyte", "group_bytes", F.expr("(gamma_bits + 7) div 8"), F.expr("(delta_bits + 7) div 8")).alias("bytes"))


@query("size_stats_vbyte", f"""WITH {SUPP}, {GAPS}, s AS (SELECT term_id, pos // 256 AS block_no, count(*) AS n, sum({VB.format("gap")}) AS d, sum({VB.format("fbias")}) AS f FROM g GROUP BY 1, 2),
l AS (SELECT term_id, sum(n) AS n, count(*) AS b, sum(d) AS d, sum(f) AS f FROM s GROUP BY 1), t AS (SELECT sum(n) AS n, sum(d + ({VB.format("n")}) + 8 * b - 4) AS d, sum(f) AS f FROM l)
SELECT 'vbyte' AS codec, CAST(n AS BIGINT) AS postings, CAST(d AS BIGINT) AS docs_bytes, CAST(f AS BIGINT) AS freqs_bytes, CAST(d * 8 AS DOUBLE) / CAST(n AS DOUBLE) AS bits_per_doc, CAST(f * 8 AS DOUBLE) / CAST(n AS DOUBLE) AS bits_per_freq FROM t""")
def _(spark, sf):
    return stats.size_stats(layout.encode(layout.blocks(src.lineitem_postings(spark, sf, "l_suppkey")), "vbyte"))


@query("size_stats_all")
def _(spark, sf):
    laid = stored.store(spark, layout.blocks(src.lineitem_postings(spark, sf, "l_suppkey")), "laid", free=True)
    built = {name: spark.sparkContext.broadcast(build(spark, laid)) for name, build in (("single_optimal", mining.build_single), ("multi_optimal", mining.build_multi))}
    return stats.size_stats_of_all(laid, built)


@query("decode_throughput")
def _(spark, sf):
    out = []
    for codec in ("vbyte", "streamvbyte", "optpfor", "interpolative"):
        index = stored.store(spark, layout.encode(layout.blocks(src.lineitem_postings(spark, sf, "l_suppkey")), codec), codec)
        out.append(stats.throughput(index, layout.decode(index)).select(F.lit(codec).alias("codec"), "*"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("values_statistics", f"""WITH {SUPP}, {GAPS}, e AS (SELECT term_id, pos // 256 AS block_no, gap, count(*) AS c, sum(count(*)) OVER (PARTITION BY term_id, pos // 256) AS n FROM g GROUP BY 1, 2, 3)
SELECT term_id, block_no, CAST(max(n) AS BIGINT) AS n, round(sum(c * log2(CAST(n AS DOUBLE) / c)), 6) AS entropy, round(sum(c * log2(CAST(gap AS DOUBLE) + 1)), 6) AS sum_of_logs,
CAST(sum(CASE WHEN gap > 0 THEN c ELSE 0 END) AS BIGINT) AS nonzeros, CAST(max(CASE WHEN gap > 0 THEN length(bin(gap)) ELSE 0 END) AS BIGINT) AS max_b FROM e GROUP BY 1, 2""")
def _(spark, sf):
    return stats.values_statistics(layout.gaps(src.lineitem_postings(spark, sf, "l_suppkey")))


@query("latency_quantiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean, max(CASE WHEN k = 50 * n // 100 THEN value END) AS q50, max(CASE WHEN k = 90 * n // 100 THEN value END) AS q90, max(CASE WHEN k = 95 * n // 100 THEN value END) AS q95 FROM r GROUP BY 1""")
def _(spark, sf):
    return stats.latency(src.table(spark, sf, "events"), "event_type", "value")


@query("block_profile", f"""WITH {PART}, {GAPS}, b AS (SELECT term_id, pos // 16 AS block_no, min(prev) + 1 AS block_base, max(doc_id) AS block_max FROM g GROUP BY 1, 2), {Q_ORDER}, {Q_SET},
k AS (SELECT query_id, term_id, row_number() OVER (PARTITION BY query_id ORDER BY df, term_id) AS r FROM qs JOIN (SELECT term_id, count(*) AS df FROM p GROUP BY 1) d USING (term_id)),
pr AS (SELECT o.term_id, p.doc_id FROM k l JOIN k o ON o.query_id = l.query_id AND l.r = 1 AND o.r > 1 JOIN p ON p.term_id = l.term_id)
SELECT pr.term_id, block_no, count(*) AS touched FROM pr JOIN b ON b.term_id = pr.term_id AND pr.doc_id >= block_base AND pr.doc_id <= block_max GROUP BY 1, 2""")
def _(spark, sf):
    p = src.lineitem_postings(spark, sf)
    return stats.block_profile(layout.blocks(p, 16), src.order_queries(spark, sf), p)


# ---- pattern mining ---------------------------------------------------------

LISTS = "ls AS (SELECT term_id, list(gap ORDER BY pos) AS v FROM g GROUP BY 1)"
CUT = "unnest([v[i * {0} + 1 : i * {0} + {0}] FOR i IN range(0, len(v) // {0})])"


def _mined(source: str, key: str = "") -> str:
    cuts = " UNION ALL ".join(f"SELECT {key}{CUT.format(s)} AS entry FROM {source}" for s in (16, 8, 4, 2, 1))
    return f"pt AS (SELECT {key}entry, count(*) AS freq FROM ({cuts}) GROUP BY ALL)"


ENTRY = "array_to_string(entry, ',')"


def joined():
    return F.array_join(F.transform("entry", lambda x: x.cast("string")), ",")


def _gap_lists(spark: SparkSession, sf: str) -> DataFrame:
    g = layout.gaps(src.lineitem_postings(spark, sf, "l_suppkey"))
    return g.groupBy("term_id").agg(F.array_sort(F.collect_list(F.struct("pos", "gap"))).alias("p")).select("term_id", F.col("p.gap").alias("values"))


@query("pattern_counts", f"WITH {SUPP}, {GAPS}, {LISTS}, {_mined('ls')} SELECT {ENTRY} AS entry, freq FROM pt")
def _(spark, sf):
    return mining.count_patterns(_gap_lists(spark, sf)).select(joined().alias("entry"), "freq")


SAVED = "sv AS (SELECT entry, freq, freq * (48 * len(entry) - 16) / CAST((SELECT count(*) FROM p) AS DOUBLE) AS saving FROM pt)"
KEPT = "kp AS (SELECT * FROM sv WHERE len(entry) = 1 OR saving > CAST(1e-7 AS DOUBLE))"
CODES = "cd AS (SELECT entry, freq, CAST(row_number() OVER (ORDER BY freq DESC, len(entry) DESC, entry) - 1 AS INTEGER) AS code FROM kp QUALIFY code < 65529)"


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    total = src.lineitem_postings(spark, sf, "l_suppkey").count()
    return mining.ranked(mining.worthwhile(mining.count_patterns(_gap_lists(spark, sf)), total))


@query("dictionary", f"WITH {SUPP}, {GAPS}, {LISTS}, {_mined('ls')}, {SAVED}, {KEPT}, {CODES} SELECT {ENTRY} AS entry, freq, code FROM cd")
def _(spark, sf):
    return _dictionary(spark, sf).select(joined().alias("entry"), "freq", "code")


@query("dictionary_usage", f"WITH {SUPP}, {GAPS}, {LISTS}, {_mined('ls')}, {SAVED}, {KEPT}, {CODES} SELECT CAST(len(entry) AS BIGINT) AS size, count(*) AS entries, round(100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS percent FROM cd GROUP BY 1")
def _(spark, sf):
    return mining.usage(_dictionary(spark, sf))


PREFIXES = " UNION ".join(f"SELECT entry[1:{s}] AS entry FROM cd WHERE len(entry) > {s}" for s in (8, 4, 2, 1))


@query("dictionary_packed", f"WITH {SUPP}, {GAPS}, {LISTS}, {_mined('ls')}, {SAVED}, {KEPT}, {CODES}, pf AS ({PREFIXES}) SELECT {ENTRY} AS entry, code FROM cd WHERE entry NOT IN (SELECT entry FROM pf)")
def _(spark, sf):
    return mining.drop_prefixes(_dictionary(spark, sf)).select(joined().alias("entry"), "code")


@query("dictionary_rows", f"WITH {SUPP}, {GAPS}, {LISTS}, {_mined('ls')}, {SAVED}, {KEPT}, {CODES} SELECT code, array_to_string(entry, ',') || repeat(',0', 16 - len(entry)) || ',' || len(entry) AS row FROM cd")
def _(spark, sf):
    return mining.rectangular(_dictionary(spark, sf)).select("code", F.array_join(F.transform("row", lambda x: x.cast("string")), ",").alias("row"))


@query("dictionary_rows_back", ORACLE_SQL["dictionary"])
def _(spark, sf):
    d = _dictionary(spark, sf)
    back = mining.from_rectangular(mining.rectangular(d))
    return back.join(d.select("entry", "freq"), "entry").select(joined().alias("entry"), "freq", "code")


#: Patterns that the loader of a single dictionary reads.
LOADED = 1 << 16


@query("block_statistics", f"WITH {SUPP}, {GAPS}, {LISTS}, {_mined('ls')}, {SAVED}, {KEPT} SELECT {ENTRY} AS entry, freq, (SELECT count(*) FROM p) AS total FROM kp QUALIFY row_number() OVER (ORDER BY freq DESC, len(entry) DESC, entry) <= {LOADED}")
def _(spark, sf):
    from quern.operators import tables

    total = src.lineitem_postings(spark, sf, "l_suppkey").count()
    path = stored.new_path(spark, "statistics")
    tables.store_statistics(mining.worthwhile(mining.count_patterns(_gap_lists(spark, sf)), total), total, path)
    return tables.load_statistics(spark, path, LOADED).select(joined().alias("entry"), "freq", "total")


@query("pattern_contexts", f"""WITH {SUPP}, {GAPS}, fb AS (SELECT term_id, pos // 256 AS block_no, list(gap ORDER BY pos) AS v, max(gap) AS most FROM g GROUP BY 1, 2 HAVING count(*) = 256),
cx AS (SELECT v, CAST(CASE WHEN most <= 1 THEN 0 WHEN length(bin(most)) <= 1 THEN 0 ELSE length(bin(length(bin(most)) - 1)) END AS BIGINT) AS context FROM fb), {_mined("cx", "context, ")} SELECT context, {ENTRY} AS entry, freq FROM pt""")
def _(spark, sf):
    laid = layout.blocks(src.lineitem_postings(spark, sf, "l_suppkey"))
    return mining.count_in_contexts(laid).select("context", joined().alias("entry"), "freq")


# ---- sources ----------------------------------------------------------------


@query("binary_collection", f"WITH {PART} SELECT * FROM p")
def _(spark, sf):
    return binary.read_images(binary.list_images(src.lineitem_postings(spark, sf)))


@query("text_vocabulary", f"WITH {TOKENS} SELECT token, term_id FROM v")
def _(spark, sf):
    return src.text_postings(spark, sf)[1]


@query("collection_totals", f"WITH {SUPP}, {GAPS} SELECT count(DISTINCT term_id) AS lists, count(*) AS postings, CAST(sum(freq) AS BIGINT) AS occurrences, count(*) + count(DISTINCT term_id) AS words FROM g")
def _(spark, sf):
    lists = src.lineitem_postings(spark, sf, "l_suppkey").groupBy("term_id").agg(F.count("*").alias("n"), F.sum("freq").alias("cf"))
    return lists.agg(F.count("*").alias("lists"), F.sum("n").alias("postings"), F.sum("cf").alias("occurrences"), F.sum(F.col("n") + 1).alias("words"))


@query("list_blocks", f"WITH {SUPP}, {GAPS} SELECT term_id, pos // 256 AS block_no, array_to_string(list(gap ORDER BY pos), ' ') AS gaps FROM g GROUP BY 1, 2")
def _(spark, sf):
    laid = layout.blocks(src.lineitem_postings(spark, sf, "l_suppkey"))
    return laid.select("term_id", "block_no", F.array_join(F.transform("gaps", lambda x: x.cast("string")), " ").alias("gaps"))


# ---- choices and models -----------------------------------------------------


@query("mixed_choice")
def _(spark, sf):
    from quern.operators import choose

    laid = layout.blocks(src.lineitem_postings(spark, sf, "l_suppkey"), 128)
    return choose.smallest(choose.candidates(laid))


@query("code_space_time")
def _(spark, sf):
    from quern.operators import choose

    laid = layout.blocks(src.lineitem_postings(spark, sf, "l_suppkey"))
    points = choose.candidates(laid, ("u32", "vbyte", "optpfor", "interpolative"))
    cost = F.create_map(*(x for k, v in (("u32", 1.0), ("vbyte", 2.0), ("optpfor", 3.0), ("interpolative", 9.0)) for x in (F.lit(k), F.lit(v))))
    points = points.withColumn("time", cost[F.col("codec")]).persist()
    budget = int(points.where("codec = 'vbyte'").agg(F.sum("size")).first()[0] or 0)
    return choose.within_budget(points, budget)


@query("size_model")
def _(spark, sf):
    from quern.operators import choose

    p = layout.gaps(src.lineitem_postings(spark, sf, "l_suppkey"))
    rows = stats.values_statistics(p).join(space.block_sizes(p).select("term_id", "block_no", "gamma_bits"), ["term_id", "block_no"])
    weights = choose.least_absolute(rows, ["n", "sum_of_logs", "entropy"], "gamma_bits")
    return spark.createDataFrame(sorted(weights.items()), "feature string, weight double")


@query("sequence_collection", f"WITH {SUPP}, {GAPS} SELECT term_id AS seq_id, count(*) AS n, max(doc_id) + 1 AS universe, array_to_string(list(doc_id ORDER BY pos), ' ') AS values FROM g GROUP BY 1")
def _(spark, sf):
    from quern.operators import tables

    g = layout.gaps(src.lineitem_postings(spark, sf, "l_suppkey"))
    packed = tables.pack_sequences(g.select(F.col("term_id").alias("seq_id"), "pos", F.col("doc_id").alias("value")))
    return packed.withColumn("values", F.array_join(F.transform("values", lambda x: x.cast("string")), " "))


@query("flagship_explained_terms", f"WITH {PART}, {Q_ORDER} SELECT q.query_id, count(*) AS asked, count(DISTINCT q.term_id) AS terms, CAST(sum(df) AS BIGINT) AS postings FROM q JOIN (SELECT term_id, count(*) AS df FROM p GROUP BY 1) t USING (term_id) GROUP BY 1")
def _(spark, sf):
    df = src.lineitem_postings(spark, sf).groupBy("term_id").agg(F.count("*").alias("df"))
    return src.order_queries(spark, sf).join(df, "term_id").groupBy("query_id").agg(F.count("*").alias("asked"), F.countDistinct("term_id").alias("terms"), F.sum("df").alias("postings"))
