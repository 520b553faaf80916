"""Mining of integer patterns for dictionaries: counts, filters, ranking, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.dictcodec import CONTEXTS, MOST, Dictionary, MultiDictionary

from .space import context

SIZES = (16, 8, 4, 2, 1)


def _patterns(lists: DataFrame, keys: list[str], values: str) -> DataFrame:
    """``keys, entry, freq``: aligned windows of each size that ``values`` fills; shorter tails are left out."""
    cut = lambda s: F.transform(
        F.when(F.size(values) >= s, F.sequence(F.lit(0), F.floor(F.size(values) / s).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(values, i * s + 1, F.lit(s))
    )
    return lists.select(*keys, F.explode(F.concat(*(cut(s) for s in SIZES))).alias("entry")).groupBy(*keys, "entry").agg(F.count("*").alias("freq"))


def count_patterns(lists: DataFrame, values: str = "values") -> DataFrame:
    """``(entry, freq)`` over whole lists ``values`` (arrays)."""
    return _patterns(lists, [], values)


def count_in_contexts(blocks: DataFrame, values: str = "gaps", size: int = 256) -> DataFrame:
    """``(context, entry, freq)`` over full blocks."""
    full = blocks.where(F.size(values) == size).select(context(F.array_max(values)).alias("context"), F.col(values).alias("v"))
    return _patterns(full, ["context"], "v")


def worthwhile(patterns: DataFrame, total: int, least: float = 1e-7) -> DataFrame:
    """Patterns that save enough, and all of one value: ``saving = freq * (48 size - 16) / total``."""
    saving = F.col("freq") * (48 * F.size("entry") - 16) / F.lit(float(total))
    return patterns.withColumn("saving", saving).where((F.size("entry") == 1) | (F.col("saving") > least))


def ranked(patterns: DataFrame, keys: list[str] = (), most: int = MOST) -> DataFrame:
    """The first ``most`` by frequency, then size, then the entry itself, with ``code`` from 0."""
    if keys:
        order = Window.partitionBy(*keys).orderBy(F.desc("freq"), F.desc(F.size("entry")), "entry")
        return patterns.withColumn("code", F.row_number().over(order) - 1).where(F.col("code") < most)
    best = patterns.orderBy(F.desc("freq"), F.desc(F.size("entry")), "entry").limit(most)  # bounded by what symbols can name
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("freq"), F.desc(F.size("entry")), "entry")
    return best.withColumn("code", F.row_number().over(order) - 1)


def drop_prefixes(dictionary: DataFrame) -> DataFrame:
    """Entries that are not proper prefixes of others: what a packed table has to store."""
    longer = dictionary.select(F.col("entry").alias("long"))
    prefixes = longer.select(F.explode(F.array(*(F.when(F.size("long") > s, F.slice("long", 1, s)) for s in SIZES[1:]))).alias("entry")).where("entry is not null").distinct()
    return dictionary.join(prefixes, "entry", "left_anti")


def rectangular(dictionary: DataFrame) -> DataFrame:
    """``(code, row)``: rows of one length, the entry filled up with zeros to 16 values and its size last."""
    size = F.size("entry")
    return dictionary.select("code", F.concat("entry", F.array_repeat(F.lit(0).cast("long"), SIZES[0] - size), F.array(size.cast("long"))).alias("row"))


def from_rectangular(rows: DataFrame) -> DataFrame:
    """``(entry, code)`` of the rows of ``rectangular``."""
    return rows.select(F.slice("row", F.lit(1), F.element_at("row", -1).cast("int")).alias("entry"), "code")


def usage(dictionary: DataFrame) -> DataFrame:
    """``(size, entries, percent)``"""
    n = dictionary.groupBy(F.size("entry").cast("long").alias("size")).agg(F.count("*").alias("entries"))
    return n.withColumn("percent", F.round(100.0 * F.col("entries") / F.sum("entries").over(Window.partitionBy(F.lit(0))), 4))


def build_single(spark: SparkSession, blocks: DataFrame) -> dict[str, Dictionary]:
    """Dictionaries of gaps and frequencies for the single codes; each has 65,529 entries at most."""
    out = {}
    for kind, column in (("docs", "gaps"), ("freqs", "fbias")):
        total = blocks.agg(F.sum("n")).first()[0] or 1
        rows = ranked(worthwhile(count_patterns(blocks, column), total)).orderBy("code").select("entry").collect()
        out[kind] = Dictionary([tuple(r.entry) for r in rows])
    return out


def build_multi(spark: SparkSession, blocks: DataFrame) -> dict[str, MultiDictionary]:
    """A dictionary per context, from full blocks."""
    out = {}
    for kind, column in (("docs", "gaps"), ("freqs", "fbias")):
        total = blocks.agg(F.sum("n")).first()[0] or 1
        rows = ranked(worthwhile(count_in_contexts(blocks, column), total), ["context"]).orderBy("context", "code").select("context", "entry").collect()
        out[kind] = MultiDictionary([[tuple(r.entry) for r in rows if r.context == c] for c in range(CONTEXTS)])
    return out
