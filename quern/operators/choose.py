"""Choice of codes by space and predicted decode time, and the fit of the predictors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.codecs import CODECS, MIXED
from quern.functions.ship import ship

#: Features of a block that predictors may weigh.
FEATURES = ("n", "size", "sum_of_logs", "entropy", "nonzeros", "max_b", "pfor_b", "pfor_exceptions")


def load_predictors(spark: SparkSession, path: str) -> DataFrame:
    """``(codec, feature, weight)`` from lines ``type codec  feature weight ...``; anything else is an error."""
    rows = []
    for r in spark.read.text(path).toLocalIterator():
        words = r.value.split()
        if not words:
            continue
        if len(words) < 2 or words[0] != "type" or len(words) % 2:
            raise ValueError(f"not a predictor: {r.value!r}")
        for name, weight in zip(words[2::2], words[3::2], strict=True):
            if name not in (*FEATURES, "bias"):
                raise ValueError(f"unknown feature {name!r}")
            rows.append((words[1], name, float(weight)))
    return spark.createDataFrame(rows, "codec string, feature string, weight double")


def predict(weights: dict[str, float]) -> Column:
    """The linear model as a column expression over feature columns."""
    return reduce(lambda a, b: a + b, (F.col(k) * F.lit(w) for k, w in sorted(weights.items()) if k != "bias"), F.lit(float(weights.get("bias", 0.0))))


def candidates(laid: DataFrame, codecs: tuple[str, ...] = MIXED, kind: str = "gaps") -> DataFrame:
    """``(term_id, block_no, codec, size)``: bytes of each block of ``kind`` under each code."""
    ship(laid.sparkSession)
    known = kind == "gaps"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for term, block, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                values = np.array(v, np.int64)
                out += [(term, block, c, len(CODECS[c].encode(values, int(values.sum()) if known else None))) for c in codecs]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["term_id", "block_no", "codec", "size"])

    return laid.select("term_id", "block_no", kind).mapInArrow(run, "term_id long, block_no long, codec string, size long")


def smallest(points: DataFrame) -> DataFrame:
    """The code of least size for each block; equal sizes go by name."""
    order = Window.partitionBy("term_id", "block_no").orderBy("size", "codec")
    return points.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def within_budget(points: DataFrame, budget: int, rounds: int = 40) -> DataFrame:
    """The choice of least total ``time`` whose total ``size`` fits ``budget``, by a price on bytes found by bisection.

    ``points``: ``(term_id, block_no, codec, size, time)``.  At a price each block takes
    its least ``time + price * size``; the total size falls as the price rises.
    """
    def at(price: float) -> DataFrame:
        order = Window.partitionBy("term_id", "block_no").orderBy(F.col("time") + F.lit(price) * F.col("size"), "size", "codec")
        return points.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")

    size = lambda df: df.agg(F.sum("size")).first()[0] or 0
    if size(at(0.0)) <= budget:
        return at(0.0)
    low, high = 0.0, 1.0
    while size(at(high)) > budget:
        low, high = high, high * 4
        if high > 1e12:
            raise ValueError("no choice fits the budget")
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if size(at(mid)) > budget else (low, mid)
        if high - low < 1e-6 * high:
            break
    return at(high)


def least_absolute(df: DataFrame, features: list[str], target: str, rounds: int = 15) -> dict[str, float]:
    """Weights (and ``bias``) of the linear model of least absolute error, by reweighted normal equations summed on the executors."""
    names = [*features, "bias"]
    x = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    w = np.zeros(len(names))
    for turn in range(rounds):
        guess = reduce(lambda a, b: a + b, (c * F.lit(float(k)) for c, k in zip(x, w, strict=True)))
        weight = F.lit(1.0) if turn == 0 else 1.0 / F.greatest(F.abs(F.col(target) - guess), F.lit(1e-6))
        pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
        got = df.agg(*(F.sum(weight * x[i] * x[j]) for i, j in pairs), *(F.sum(weight * c * F.col(target)) for c in x)).first()
        a = np.zeros((len(x), len(x)))
        for (i, j), v in zip(pairs, got, strict=False):
            a[i, j] = a[j, i] = v or 0.0
        new = np.linalg.lstsq(a, np.array([v or 0.0 for v in got[len(pairs) :]]), rcond=None)[0]
        done, w = np.allclose(new, w, rtol=1e-9, atol=1e-12), new
        if done:
            break
    return dict(zip(names, w.tolist(), strict=True))
