"""SimHash fingerprints and Hamming search by permuted block tables (operator 3).

DataFrame operations only.  Every term of a text (a word with the two that
follow) votes with its hash on 64 signed bits, as often as it occurs, so a term
weighs by its frequency.  Votes are summed four bits' counters to a number, and
partial sums leave a task as one row per text.  ``near_search`` and ``near_pairs`` find all
fingerprints within a Hamming radius: of more blocks than the radius some agree, and
for each choice of blocks a table keyed by them meets such pairs.  A key that many fingerprints
share is split over tasks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Counters of 16 bits: so many terms go into one sum at most.
CHUNK = 60_000
LANES = 0x0001000100010001
#: Tasks that rows of one fingerprint are spread over.
SALTS = 16


def _votes(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``fp``, the 64-bit fingerprint of the column ``t``."""
    words = texts.select(*keys, F.split("t", "[ \\t\\n\\x0b\\f\\r]+").alias("w"))
    words = words.withColumn("w2", F.slice("w", 2, F.size("w"))).withColumn("w3", F.slice("w", 3, F.size("w")))
    terms = words.select(*keys, F.posexplode(F.arrays_zip("w", "w2", "w3")).alias("pos", "x"))
    hashed = terms.select(*keys, F.expr(f"pos div {CHUNK}").alias("chunk"), F.xxhash64("x.w", "x.w2", "x.w3").alias("h"))
    lane = lambda k: F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(LANES)))
    sums = hashed.groupBy(*keys, "chunk").agg(*(lane(k).alias(f"s{k}") for k in range(16)), F.count("*").alias("n"))
    parts = sums.groupBy(*keys).agg(F.collect_list(F.struct(F.array(*(f"s{k}" for k in range(16))).alias("s"), "n")).alias("parts"))
    for_bit = "aggregate(parts, 0L, (a, p) -> a + (shiftrightunsigned(p.s[cast(b % 16 as int)], cast(16 * (b div 16) as int)) & 65535L))"
    total = "aggregate(parts, 0L, (a, p) -> a + p.n)"
    return parts.select(*keys, F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * {for_bit} > {total}, shiftleft(1L, b), 0L))").alias("fp"))


def fingerprint_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fp`` for each row of ``docs``; ``keys`` must tell the rows apart.  A null text counts as empty."""
    return _votes(docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("t")), keys)


def in_order(docs: DataFrame, rows_per_bucket: int = 500) -> DataFrame:
    """``docs`` as ``(doc_id, text, bucket)``: buckets of about that many rows, in the order of ``doc_id``.

    Bucket bounds are 64 approximate quantiles, each range cut evenly; the number of buckets
    stays below about 100,000.  Rows with a null id come first, in buckets by a hash of their texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n, named, lo, hi, cuts = rows.agg(F.count("*"), F.count("doc_id"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / 64 for i in range(1, 64)], 1000)).first()
    bits = min(16, max(0, (n - named) // rows_per_bucket).bit_length())
    unnamed = F.shiftrightunsigned(F.xxhash64("text"), 64 - bits) - F.lit(1 << bits) if bits else F.lit(-1)
    if lo is None:
        return rows.withColumn("bucket", unnamed.cast("long"))
    cuts = sorted({c for c in cuts if c > lo})
    starts, ends = [lo, *cuts], [*cuts, hi + 1]
    parts = max(1, n // (len(starts) * max(rows_per_bucket, n // 100_000)))
    q = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= F.col("doc_id")))
    at = lambda values: F.element_at(F.array(*(F.lit(v).cast("double") for v in values)), F.col("q"))
    place = F.floor((F.col("doc_id") - at(starts)) / (at(ends) - at(starts)) * parts)
    bucket = F.col("q") * parts + F.least(F.lit(parts - 1), F.greatest(F.lit(0), place))
    return rows.withColumn("q", F.when(F.col("doc_id").isNotNull(), q)).select("doc_id", "text", F.coalesce(bucket, unnamed).cast("long").alias("bucket"))


def _next_bucket(firsts: DataFrame) -> DataFrame:
    """``firsts(bucket, ...)`` under the bucket before, the first under the last: one row per bucket, 100,000 about at most."""
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")
    names = firsts.select("bucket")
    before = names.withColumn("before", F.lag("bucket").over(order)).withColumn("before", F.coalesce("before", F.max("bucket").over(Window.partitionBy(F.lit(0)))))
    return firsts.join(before, "bucket").drop("bucket").withColumnRenamed("before", "bucket")


def fingerprint_edits(spark: SparkSession, docs: DataFrame, radius: int = 3, queried: Column | None = None) -> DataFrame:
    """Fingerprints of texts and of their edits, with likenesses.

    Returns ``(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited,
    near_next, n_near)``.  The edit replaces the last quarter of the code points by the
    first as many of the next document's in the order of ``doc_id`` (null first; equal
    ids by text), the first document following the last.  ``n_near``: for the rows of the condition ``queried``
    on ``doc_id`` (by default those divisible by 50) the number of other rows with a fingerprint within ``radius``
    bits; null for the rest.  Null texts are empty; empty texts
    have the fingerprint of the empty term; a single document follows itself; an empty table gives no rows.
    """
    queried = F.col("doc_id") % 50 == 0 if queried is None else queried
    rows = in_order(docs)
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    heads = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "text"))["text"].alias("head"))
    ordered = rows.withColumn("rn", F.row_number().over(order)).withColumn("next", F.lead("text").over(order)).join(_next_bucket(heads), "bucket")
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edit = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.coalesce("next", "head"), F.lit(1), quarter))
    texts = ordered.select("bucket", "rn", "doc_id", n.cast("long").alias("n_chars"), "text", edit.alias("edited"))
    both = texts.select("bucket", "rn", F.inline(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))))
    fps = _votes(both, ["bucket", "rn", "v"])
    fps = fps.groupBy("bucket", "rn").agg(F.max(F.when(F.col("v") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("v") == 1, F.col("fp"))).alias("edited_fp"))
    about = texts.select("bucket", "rn", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    found = materialize(spark, about.join(fps, ["bucket", "rn"]), "fingerprints")
    following = F.lead("fp").over(Window.partitionBy("bucket").orderBy("rn"))
    heads = found.where("rn = 1").select("bucket", F.col("fp").alias("head"))
    near = near_search(found.where(queried).select("fp"), found.groupBy("fp").agg(F.count("*").alias("n")), radius)
    near = materialize(spark, near.groupBy("a").agg((F.sum("n") - 1).alias("n_near")), "near")
    # A fingerprint of many rows is met under several salts.
    near = near.select(F.col("a").alias("fp"), "n_near", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.when(queried, F.pmod(F.xxhash64("bucket", "rn"), F.lit(SALTS)).cast("int"))
    found = found.withColumn("next", following).join(_next_bucket(heads), "bucket").withColumn("salt", salt).join(near, ["fp", "salt"], "left")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.coalesce("next", "head")).alias("near_next"), "n_near",
    )


def _block_masks(radius: int, blocks: int) -> list[int]:
    """A mask of 64 bits for every choice of ``blocks - radius`` of the blocks."""
    if not radius < blocks <= 64:
        raise ValueError("more blocks than the radius, 64 at most")
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(masks[i] for i in c)) for c in combinations(range(blocks), blocks - radius)]


def _met(left: DataFrame, right: DataFrame, masks: list[int], radius: int, most: int, less: bool = False) -> DataFrame:
    """Pairs of ``left(a)`` and ``right(b, ...)`` within ``radius`` bits (with ``less``, ``a < b``), each found once, and their ``distance``.

    Both are keyed by each of the masks, and rows with equal keys are compared; a pair counts in the
    first table where it meets.  Keys with over ``most`` rows on the right are split among tasks, to which the left rows go.
    """
    keyed = lambda df, c: df.select("*", F.posexplode(F.array(*(F.col(c).bitwiseAND(F.lit(m)) for m in masks))).alias("t", "key"))
    left, right, on = keyed(left, "a"), keyed(right, "b"), ["t", "key"]
    counts = right.groupBy(*on).agg(F.count("*").alias("c")).where(F.col("c") > most)
    hot = counts.select(*on, F.ceil(F.col("c") / most).cast("int").alias("parts"))
    cold = left.join(right.join(hot, on, "left_anti"), on)
    split_right = right.join(hot, on).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    split_left = left.join(hot, on).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    split = split_left.repartition(*on, "part").join(split_right.repartition(*on, "part"), [*on, "part"]).drop("part")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    agree = F.array(*(F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)))
    order = F.col("a") < F.col("b") if less else F.lit(True)
    near = cold.unionByName(split).where(order & (F.bit_count(apart) <= radius))
    return near.where(F.col("t") == F.array_min(agree)).drop(*on).withColumn("distance", F.bit_count(apart).cast("int"))


def near_search(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 6, most: int = 1000) -> DataFrame:
    """``(a, b, n, distance)``: for each distinct fingerprint ``fp`` of ``queries`` the rows ``(fp, n)`` of ``fps`` within ``radius`` bits.

    Fingerprints are cut into ``blocks`` blocks; a pair within the radius agrees in
    ``blocks - radius`` of them at least.  For every choice of so many blocks there is a table of the
    fingerprints keyed by these blocks, and pairs that meet in a table are compared in full.  Null finds nothing.
    """
    left = queries.where(F.col("fp").isNotNull()).select(F.col("fp").alias("a")).distinct()
    return _met(left, fps.where(F.col("fp").isNotNull()).withColumnRenamed("fp", "b"), _block_masks(radius, blocks), radius, most)


def near_pairs(fps: DataFrame, radius: int = 3, blocks: int = 6, most: int = 1000) -> DataFrame:
    """All pairs ``(a, b, distance)`` of distinct fingerprints ``fp`` within ``radius`` bits, ``a < b``; found as in ``near_search``.

    Equal fingerprints are one.  Rows with null are left out.
    """
    distinct = fps.select("fp").where(F.col("fp").isNotNull()).distinct()
    return _met(distinct.withColumnRenamed("fp", "a"), distinct.withColumnRenamed("fp", "b"), _block_masks(radius, blocks), radius, most, less=True)
