"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are ordered: P(grade <= g) = sigmoid(cut_g - w . x), with one weight vector shared by all cuts
and rising cuts. x has, for each chosen feature, whether the text has it; features are a
text's lower-case words and their first four and five letters, so that inflected forms of a root count
together, each once, twice and four times (LEVELS).
The expected severity is the sum over g of P(grade > g).

The model is fitted on a bounded sample: the SAMPLE labelled documents with the smallest hashes of
their ids. Features are chosen by a signed chi-square of presence against the grade being above 0; at most
FEATURES are kept, so what reaches the driver is bounded by these two numbers. Scoring
covers every document and its whole text.

Grades come from labels: 0 not toxic, 1 toxic, 2 toxic and of low quality. Null texts score as
empty; a document whose labels repeat counts once, with its highest grade; null labels are left out; without labels of two grades the
expected severity is null. Rows repeat as they come; words of any length count whole; an empty table gives an empty result. Of other columns none is read.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ddl, ship, slices

SAMPLE = 12_000
FEATURES = 2_048
#: A feature must be seen in so many sampled documents, and stand out by so many standard deviations.
SEEN, STANDS_OUT = 5, 4.5
LEVELS = (1, 2, 4)
EDGES = ".,;:!?\"'()[]{}<>*#$%&|_-"
CACHE = 400_000


def features_of(word: str) -> list[str]:
    word = word.lower().strip(EDGES)
    if len(word) < 4:
        return [word] if word else []
    return [word, "4" + word[:4]] + (["5" + word[:5]] if len(word) > 4 else [])


def _levels(counts: Counter):
    for f, n in counts.items():
        for level in LEVELS:
            if n >= level:
                yield f"{level}:{f}"


def _count(batches):
    """How many sampled texts of each grade have a feature, within one task."""
    counts: Counter = Counter()
    for whole in batches:
        for batch in slices(whole):
            for text, grade in zip(batch.column("text").to_pylist(), batch.column("grade").to_pylist()):
                own: Counter = Counter()
                for w, n in Counter((text or "").split()).items():
                    for f in features_of(w):
                        own[f] += n
                counts.update((f, grade > 0) for f in _levels(own))
        if len(counts) > 300_000:
            yield _counted(counts)
            counts = Counter()
    if counts:
        yield _counted(counts)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([f for f, _ in counts]), pa.array([n if t else 0 for (_, t), n in counts.items()], pa.int64()), pa.array([0 if t else n for (_, t), n in counts.items()], pa.int64())],
        names=["feature", "bad", "good"],
    )


class Finder:
    """Chosen features of texts; words without any are passed over by a set operation."""

    def __init__(self, chosen: dict[str, int]):
        self.chosen, self.seen, self.hits = chosen, set(), {}
        self.roots = {f.split(":", 1)[1] for f in chosen}

    def run(self, texts: list[str | None]) -> list[list[int]]:
        words = [(t or "").split() for t in texts]
        for w in set(itertools.chain.from_iterable(words)).difference(self.seen):
            self.seen.add(w)
            own = tuple(f for f in features_of(w) if f in self.roots)
            if own:
                self.hits[w] = own
        out, known = [], self.hits
        for ws in words:
            counts: Counter = Counter()
            for w in filter(known.__contains__, ws):
                counts.update(known[w])
            out.append(sorted(self.chosen[f] for f in _levels(counts) if f in self.chosen))
        if len(self.seen) > CACHE:
            self.hits, self.seen = {}, set()
        return out


def _rows(batches, chosen):
    finder = Finder(chosen.value)
    for whole in batches:
        for batch in slices(whole):
            found = finder.run(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(found, pa.list_(pa.int32()))], names=["grade", "x"])


class Ordinal:
    """Cumulative-link regression with shared weights: cuts[0] < cuts[1] < ..."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    @classmethod
    def fit(cls, rows: list[list[int]], grades: np.ndarray, width: int, *, penalty: float = 2e-5, steps: int = 500) -> Ordinal:
        """Full-batch gradient steps (Adam) on the penalised mean log-likelihood; deterministic."""
        levels = int(grades.max())
        index = np.concatenate([np.asarray(r, np.int64) for r in rows] or [np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        share = np.array([(grades <= g).mean() for g in range(levels)]).clip(1e-4, 1 - 1e-4)
        first = np.log(share / (1 - share))
        # cuts as a first value and the logs of the gaps above it, so they can't cross
        gaps = np.log(np.maximum(np.diff(first), 1e-2))
        p = np.concatenate([np.zeros(width), first[:1], gaps])
        m, v = np.zeros_like(p), np.zeros_like(p)
        n = len(rows)
        for t in range(1, steps + 1):
            w, cuts = p[:width], np.cumsum(np.append(p[width], np.exp(p[width + 1 :])))
            score = np.bincount(owner, w[index], n)
            edges = np.concatenate([[-np.inf], cuts, [np.inf]])
            s = 1 / (1 + np.exp(-np.clip(edges[None, :] - score[:, None], -30, 30)))
            s[:, 0], s[:, -1] = 0, 1
            own = np.arange(n)
            up, down = s[own, grades + 1], s[own, grades]
            mass = np.maximum(up - down, 1e-12)
            d_up, d_down = up * (1 - up) / mass, down * (1 - down) / mass
            g = np.zeros_like(p)
            g[:width] = np.bincount(index, ((d_up - d_down) / n)[owner], width) + 2 * penalty * w
            g_cut = np.array([-(d_up[grades == c].sum() - d_down[grades == c + 1].sum()) / n for c in range(levels)])
            below = np.cumsum(g_cut[::-1])[::-1]
            g[width] = below[0]
            g[width + 1 :] = below[1:] * np.exp(p[width + 1 :])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        return cls(p[:width].copy(), np.cumsum(np.append(p[width], np.exp(p[width + 1 :]))))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > g) for each g (columns)."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -30, 30)))


def _score(batches, chosen, model):
    finder, model = Finder(chosen.value), model.value
    for whole in batches:
        for batch in slices(whole):
            found = finder.run(batch.column("text").to_pylist())
            score = np.array([model.weights[x].sum() for x in found])
            above = model.above(score)
            chances = -np.diff(np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(chances.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= 0.5)],
                names=["doc_id", "expected_severity", "grade", "toxic"],
            )


def grades_of(labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))
    return labels.where(F.col("doc_id").isNotNull() & grade.isNotNull()).groupBy("doc_id").agg(F.max(grade).alias("grade"))


def fit(spark: SparkSession, docs: DataFrame, grades: DataFrame, *, sample: int = SAMPLE, features: int = FEATURES):
    """(chosen features, model) from at most ``sample`` documents of ``grades`` (doc_id, grade); None with one grade only."""
    ship(spark)
    scratch = Scratch(spark, "toxicity", like=docs)
    # at most ``sample`` rows of two numbers, so it may be broadcast
    picked = scratch.keep(grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "picked").select(F.col("doc_id").alias("_picked"), "grade")
    own = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_picked")).select("text", "grade")
    train = scratch.keep(own, "train")
    bad, total = train.agg(F.count_if(F.col("grade") > 0), F.count("*")).first()
    if not bad or bad == total:
        return None
    counts = train.mapInArrow(_count, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n, rate = F.col("bad") + F.col("good"), bad / total
    z = (F.col("bad") - n * rate) / F.sqrt(n * rate * (1 - rate))
    best = counts.where((n >= SEEN) & (F.abs(z) >= STANDS_OUT)).orderBy(F.abs(z).desc(), "feature").limit(features).collect()
    chosen = {r["feature"]: i for i, r in enumerate(best)}
    shared = spark.sparkContext.broadcast(chosen)
    rows = train.mapInArrow(lambda b: _rows(b, shared), "grade int, x array<int>").collect()  # at most ``sample`` short rows
    rows.sort(key=lambda r: (r["grade"], r["x"]))
    got = np.array([r["grade"] for r in rows])
    levels = sorted(set(got.tolist()))  # grades that no one has get no cut
    model = Ordinal.fit([r["x"] for r in rows], np.searchsorted(levels, got), len(chosen))
    return shared, model


def score(spark: SparkSession, docs: DataFrame, fitted) -> DataFrame:
    """Per document: expected_severity, the likeliest grade, and whether a grade above 0 is as likely as not."""
    ship(spark)
    docs = docs.select("doc_id", "text")
    if fitted is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("expected_severity"), F.lit(0).alias("grade"), F.lit(False).alias("toxic"))
    chosen, model = fitted
    model = spark.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda b: _score(b, chosen, model), ddl(docs, "doc_id") + ", expected_severity double, grade int, toxic boolean")


def severity(spark: SparkSession, docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    return score(spark, docs, fit(spark, docs, grades_of(labels), **how))
