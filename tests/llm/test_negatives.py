"""Hard negatives by bit-planes against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from strandflow.llm import negatives

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("shard", T.StringType()), T.StructField("dims", T.StringType())])


def brute(rows):
    sound = []
    for r in rows:
        if r[0] is None or r[2] is None or r[1] is None or any(x is None or not math.isfinite(x) for x in r[1]):
            continue
        sound.append((r[0], [math.floor(256 * x) for x in r[1]], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2]))
    out = []
    for a in sound:
        if a[0] % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[1], c[1])), c[0], c[2]) for c in sound if c[0] != a[0] and len(c[1]) == len(a[1]))
        for ps, pid, _ in [x for x in scored if x[2] == a[2]][:5]:
            hard = [x for x in scored if x[2] != a[2] and 80 * -ps <= 100 * -x[0] <= 100 * -ps][:5]
            out += [(a[0], pid, k + 1, nid, -ps, -ns) for k, (ns, nid, _) in enumerate(hard)]
    return out


def vectors(rng, n, dims, spread=1.0):
    rows = []
    common = [rng.gauss(0, spread) for _ in range(dims)]
    for i in range(n):
        v = [x + rng.gauss(0, spread / 8) for x in common] if rng.random() < 0.3 else [rng.gauss(0, spread) for _ in range(dims)]
        rows.append((rng.randrange(0, 4 * n) * (25 if rng.random() < 0.3 else 1), v, rng.choice([2, 2, 2, *range(10)]), "x", "y"))
    return rows


@pytest.mark.parametrize("spread,shard,block", [(0.2, 97, 3), (40.0, 64, 2), (1e5, 200, 256)])
def test_against_brute_force(spark, monkeypatch, spread, shard, block):
    monkeypatch.setattr(negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    rng = random.Random(shard)
    rows = vectors(rng, 400, 7, spread)
    nan, inf = float("nan"), float("inf")
    rows += [rows[0], rows[1], (None, [1.0] * 7, 1, None, None), (100, None, 2, None, None), (200, [0.1] * 7, None, None, None), (300, [nan] * 7, 2, None, None), (400, [inf] * 7, 2, None, None), (500, [None] + [0.5] * 6, 2, None, None)]
    rows += [(i, [0.25, -0.5], i % 3, None, None) for i in range(0, 700, 20)] + [(i, [0.0] * 7, 2, None, None) for i in (0, 100, 101, 103)] + [(i, [], i % 2, None, None) for i in (0, 100, 5, 8)]
    want = brute(rows)
    got = negatives.hard_negatives(spark, spark.createDataFrame(rows, VECTORS).repartition(3))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert len(want) > 100


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_ROWS", 50)
    rows = [(100, [1.0], 1, None, None)] + [(i, [1.0], 1, None, None) for i in range(901, 910)] + [(i, [1.0 if i % 2 else 0.9], 3, None, None) for i in range(1001, 1300)]
    got = negatives.hard_negatives(spark, spark.createDataFrame(rows, VECTORS).repartition(4))
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_empty_and_beyond_63_bits(spark):
    assert negatives.hard_negatives(spark, spark.createDataFrame([], VECTORS)).collect() == []
    with pytest.raises(ValueError, match="63 bits"):
        negatives.hard_negatives(spark, spark.createDataFrame([(100, [1e12, 1.0], 1, None, None)], VECTORS))


def test_candidates_are_dropped_by_the_first_planes():
    """The low planes are read for few rows only: that is what the intervals are for."""
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.normal(0, 0.3, (4000, 32))).astype(np.int64)
    import pickle

    bits = 11
    shard = negatives.Shard(pickle.dumps((np.arange(4000), np.ones(4000, np.int64), negatives.planes_of(rows, bits))), 32, "f8")
    read = Counter()
    whole = shard.plane
    shard.plane = lambda p, some: read.update({p: len(some)}) or whole(p, some)
    q = rows[:4]
    w, ids, score = negatives.best_in_ranges(shard, np.arange(4), np.ones(4, np.int64), q, np.arange(4), np.full(4, negatives.LEAST), np.full(4, negatives.MOST), True, 5)
    full = q @ rows.T
    full[np.arange(4), np.arange(4)] = -(10**9)
    assert score.reshape(4, 5).tolist() == np.sort(full, axis=1)[:, :-6:-1].tolist()
    assert read[0] > 3 * read[bits - 1] and read[0] >= 4000
