"""Toxicity by maximum-scoring segments (operator 5).

A word scores by its log-odds of standing in a toxic rather than a clean
document.  Words are read as prefixes of 3 to 6 letters and as a whole (with an end
mark), each a Dirichlet prior for the next longer one, so rare words lean on their stems.
Runs of letters in scripts without spaces are cut into overlapping pairs.
Scores less a drift are negative on the whole; a linear scan finds all maximal
scoring segments.  In clean text a segment of score x among n words has
the extreme-value rate K n exp(-lambda x) (Karlin and Altschul); the evidence of
a document is the sum of -log of that rate over its significant segments, and
a logistic curve turns it into the chance of label 1.

Weights are learned on labelled rows outside the held-out fold, calibration on one
fold that the weights under test did not see.  ``max_labelled`` bounds both.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, doc_rows, lean, materialize

WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST, END = 3, 6, "$"
#: Thai, Lao, Burmese, Khmer, kana, Chinese characters: no spaces between words.
SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
ANY_SPACELESS, RUN = re.compile(f"[{SPACELESS}]"), re.compile(f"([{SPACELESS}]+)|[^{SPACELESS}]+")


def words(text: str) -> list[str]:
    """Runs of letters in lower case; those of scripts without spaces as overlapping pairs."""
    found = WORD.findall(text.lower())
    if ANY_SPACELESS.search(text) is None:
        return found
    out: list[str] = []
    for m in (m for w in found for m in RUN.finditer(w)):
        run = m[0]
        out += [run[i : i + 2] for i in range(max(1, len(run) - 1))] if m[1] else [run]
    return out


def units(word: str) -> list[str]:
    """What a word is read as, each the prior of the next: prefixes, short to long, and the whole."""
    marked = word + END
    prefixes = [marked[:k] for k in range(min(SHORTEST, len(marked)), min(LONGEST, len(marked)) + 1)]
    return prefixes if len(marked) <= LONGEST else [*prefixes, marked]


def parent(unit: str) -> str:
    """The unit before this one; of the shortest, a string that is no unit."""
    return unit[: min(LONGEST, len(unit) - 1)]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id is in the held-out fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def maximal_segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(score, start, end)``, by one scan (Ruzzo and Tompa)."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    before: list[float] = []
    after: list[float] = []
    places: list[tuple[int, int]] = []
    lower: list[int] = []  # the last earlier segment that starts lower
    for p in np.flatnonzero(scores > 0).tolist():
        low, high, start = float(total[p]), float(total[p + 1]), p
        j = len(before) - 1
        while True:
            while j >= 0 and before[j] >= low:
                j = lower[j]
            if j < 0 or after[j] >= high:
                break
            low, start = before[j], places[j][0]  # the new one reaches higher: it takes all from j on
            nxt = lower[j]
            del before[j:], after[j:], places[j:], lower[j:]
            j = nxt
        before.append(low)
        after.append(high)
        places.append((start, p + 1))
        lower.append(j)
    return [(b - a, s, e) for a, b, (s, e) in zip(before, after, places, strict=True)]


@dataclass
class Model:
    """Log-odds by unit, and the calibration."""

    weights: dict[str, float]
    drift: float = 0.5
    rate: float = 1.0  # lambda
    scale: float = 0.1  # K
    slope: float = 1.0
    shift: float = -1.0
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def _score(self, word: str) -> float:
        got = 0.0
        for u in units(word):
            w = self.weights.get(u)
            if w is not None:
                got = w
        return got - self.drift

    def scores(self, text: str) -> np.ndarray:
        found, known = words(text), self._known
        if len(known) > 100_000:  # workers keep the model, and so these words
            known.clear()
        scores = list(map(known.get, found))
        if None in scores:
            for w in set(found).difference(known):
                known[w] = self._score(w)
            scores = list(map(known.__getitem__, found))
        return np.array(scores, np.float64)

    def passages(self, scores: np.ndarray, below: float = 1.0) -> list[tuple[float, int, int, float]]:
        """Significant segments ``(score, first word, end, rate)``: those expected less than ``below`` times in clean text of this length."""
        if not len(scores) or scores.max() <= 0:
            return []
        log_n = math.log(self.scale * len(scores))
        out = [(x, s, e, math.exp(min(50.0, log_n - self.rate * x))) for x, s, e in maximal_segments(scores)]
        return [p for p in out if p[3] < below]

    def evidence(self, scores: np.ndarray) -> float:
        return sum(-math.log(max(p[3], 1e-300)) for p in self.passages(scores))

    def chance(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.shift + self.slope * math.log1p(evidence)))))


def _weights(counts: dict[str, tuple[int, int]], toxic: int, clean: int, prior: float, least: float = 0.05) -> dict[str, float]:
    """Log-odds of units against the base odds; a unit's prior of weight ``prior`` is its parent's odds."""
    base = toxic / max(1, toxic + clean)
    base = min(max(base, 1e-6), 1 - 1e-6)
    share: dict[str, float] = {}
    out: dict[str, float] = {}
    for u in sorted(counts, key=len):
        q = share.get(parent(u), base)
        t, c = counts[u]
        if len(u) > LONGEST and counts.get(parent(u)) == (t, c):
            continue  # the only word with these letters: its prefix has counted the same documents
        share[u] = q = (t + prior * q) / (t + c + prior)
        value = math.log(q / (1 - q)) - math.log(base / (1 - base))
        if abs(value) >= least or parent(u) in out:
            out[u] = value
    return out


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000, prior: float = 8.0, drift: float = 0.5) -> Model:
    """Fit on labelled rows outside fold 0.

    ``max_labelled`` bounds the labelled documents used, chosen by a hash of
    their ids.  Rows without a label, or whose id is null, are not learned from;
    of labels given twice the higher counts.  Without labels of both kinds every
    document scores the same, below 0.5.
    """
    arrow_batches(spark)
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    given = given.withColumn("fold", fold(F.col("id")).cast("int")).where("fold <> 0")
    n = given.count()
    if n > max_labelled:
        given = given.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    # At most about max_labelled rows of 16 bytes.
    rows = doc_rows(docs)
    rows = rows.join(F.broadcast(given), rows.doc_id == given.id).select("text", "toxic", "fold")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], Counter[str]] = {}
        size: Counter[tuple[int, int]] = Counter()
        known: dict[str, list[str]] = {}
        for b in batches:
            for text, toxic, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own: set[str] = set()
                for w in set(words(text)):
                    got = known.get(w)
                    if got is None:
                        if len(known) > 100_000:
                            known.clear()
                        got = known[w] = units(w)
                    own.update(got)
                key = (toxic > 0, part == 4)
                found.setdefault(key, Counter()).update(own)
                size[key] += 1
        for (toxic, last), c in found.items():
            c[""] = size[toxic, last]  # the number of documents
            yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([toxic] * len(c)), pa.array([last] * len(c)), pa.array(list(c.values()), pa.int64())], names=["unit", "toxic", "last", "n"])

    is_toxic, is_last = F.col("toxic"), F.col("last")
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    sums = rows.mapInArrow(lean(count), "unit string, toxic boolean, last boolean, n long").groupBy("unit").agg(
        total(is_toxic & ~is_last).alias("t"), total(~is_toxic & ~is_last).alias("c"), total(is_toxic & is_last).alias("t4"), total(~is_toxic & is_last).alias("c4")
    )
    # Units met once tell nothing; the rest are bounded by the sample.
    table = sums.where("unit = '' or t + c + t4 + c4 > 1").toArrow().to_pydict()
    early = {u: (t, c) for u, t, c in zip(table["unit"], table["t"], table["c"], strict=True)}
    whole = {u: (t + t4, c + c4) for u, t, c, t4, c4 in zip(*(table[k] for k in ("unit", "t", "c", "t4", "c4")), strict=True)}
    if not all(whole.pop("", (0, 0))):
        return Model({})
    size = early.pop("", (0, 0))
    trial = Model(_weights(early, *size, prior), drift)
    model = Model(_weights(whole, *(sum(x) for x in zip(size, _last(table), strict=True)), prior), drift)
    _calibrate(spark, rows.where("fold = 4"), trial)
    for name in ("rate", "scale", "slope", "shift"):
        setattr(model, name, getattr(trial, name))
    return model


def _last(table: dict) -> tuple[int, int]:
    i = table["unit"].index("")
    return table["t4"][i], table["c4"][i]


def _calibrate(spark: SparkSession, rows: DataFrame, model: Model) -> None:
    """Fit lambda, K and the logistic curve on rows that the weights did not see.

    Segment scores stay in a stored table and are summed up there; the driver gets
    201 counts, and two numbers for each document of the bounded sample.
    """
    sent = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["toxic", "n", "xs", "bin", "times"]
        clean = np.zeros(201, np.int64)
        for b in batches:
            n, found = [], []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = sent.value.scores(text)
                if toxic == 0:
                    clean += np.bincount(np.clip(np.round(s * 10) + 100, 0, 200).astype(int), minlength=201)
                n.append(len(s))
                found.append([x for x, _, _ in maximal_segments(s)])
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.float64())), *none], names=names)
        used = np.flatnonzero(clean)
        none = [pa.nulls(len(used), t) for t in (pa.int32(), pa.int64(), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*none, pa.array(used.astype(np.int32)), pa.array(clean[used])], names=names)

    got = materialize(spark, rows.mapInArrow(lean(measure), "toxic int, n long, xs array<double>, bin int, times long"), "segments")
    sent.unpersist()
    docs = got.where("toxic is not null").withColumn("clean", (F.col("toxic") == 0) & (F.col("n") > 0))
    n_docs, n_clean = docs.agg(F.count("*"), F.count(F.when(F.col("clean"), 1))).first()
    if not n_clean or n_clean == n_docs:
        return
    bins = np.zeros(201)
    for r in got.where("bin is not null").groupBy("bin").agg(F.sum("times").alias("times")).collect():  # 201 rows at most
        bins[r.bin] = r.times
    values, share = (np.arange(201) - 100) / 10, bins / bins.sum()
    if share @ values < 0 and bins[101:].any():
        lo, hi = 1e-6, 20.0
        for _ in range(80):  # the positive root of sum p exp(lambda s) = 1
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if share @ np.exp(mid * values) < 1 else (lo, mid)
        model.rate = lo
    top = F.coalesce(F.array_max("xs"), F.lit(0.0))
    model.scale = float(n_clean / docs.where("clean").agg(F.sum(F.col("n") * F.exp(F.lit(-model.rate) * top))).first()[0])
    log_n = F.log(F.greatest(F.lit(1e-300), F.lit(model.scale) * F.col("n")))
    evidence = F.aggregate("xs", F.lit(0.0), lambda a, x: a + F.greatest(F.lit(0.0), F.lit(model.rate) * x - log_n))
    # max_labelled bounds the rows.
    table = docs.select("toxic", evidence.alias("e")).toArrow()
    e, toxic = table.column("e").to_numpy(), table.column("toxic").to_numpy()
    x, y = np.log1p(e), toxic.astype(float)
    a = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(60):  # Newton steps, with a small ridge for separable data
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - 1e-2 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
    model.shift, model.slope = float(w[0]), float(max(w[1], 1e-6))


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted, passages)`` of every document, from its text alone.

    ``passages``: the significant segments as words [start, end) with their
    scores and the rate at which clean text has such.  Null and empty texts have
    no evidence and score lowest.  Equal texts score equally.
    """
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("rate", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chance, passages = [], []
            for text in b.column(1).to_pylist():
                found = sent.value.passages(sent.value.scores(text))
                passages.append([{"start": s, "end": e, "score": x, "rate": r} for x, s, e, r in found])
                chance.append(sent.value.chance(sum(-math.log(max(p[3], 1e-300)) for p in found)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(chance, pa.float64()), pa.array(passages, kind)], names=["doc_id", "held_out", "score", "passages"])

    rows = doc_rows(docs).withColumn("held_out", fold(F.col("doc_id")) == 0)
    out = rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, passages array<struct<start: long, end: long, score: double, rate: double>>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def keep_clean(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` less the rows predicted toxic, all columns as they are."""
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = sent.value
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([m.chance(m.evidence(m.scores(t or ""))) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
