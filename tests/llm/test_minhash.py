"""Fast similarity sketches and the links they lead to, against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward_texts, table

from strandflow.llm import minhash
from strandflow.llm.minhash import near_duplicates


def shingles(text, width=2):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(ids, texts, width=2, percent=80):
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for i in range(len(sets)):
        least.setdefault(find(i), []).append(ids[i])
    out = []
    for i, s in enumerate(sets):
        c = min((x for x in least[find(i)] if x is not None), default=None)
        out.append((ids[i], len(s), c, c == ids[i]))
    return Counter(out)


def edited(rng, text, share, words):
    return " ".join(rng.choice(words) if rng.random() < share else w for w in text.split())


def near_texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(600)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    texts = []
    for _ in range(12):
        base = prose(rng.choice([3, 5, 6, 9, 12, 40, 90, 300]))
        for _ in range(rng.randint(1, 9)):
            texts.append(edited(rng, base, rng.choice([0.0, 0.02, 0.05, 0.1]), words))
    # a chain: each is near the next, the ends are not
    chain = prose(60)
    for _ in range(8):
        texts.append(chain)
        w = chain.split()
        w[rng.randrange(60)] = rng.choice(words)
        chain = " ".join(w)
    return texts + awkward_texts(seed) + ["one", "ONE", "two", "a b", "A\tB", "b a", "a b a b", "é b", "É b"]


@pytest.mark.parametrize("seed,width", [(1, 2), (2, 2), (3, 5)])
def test_against_brute_force(spark, seed, width):
    texts = near_texts(seed)
    docs = table(spark, texts).withColumnRenamed("lang", "n").withColumnRenamed("source", "id").withColumnRenamed("n_chars", "key")
    ids = [r.doc_id for r in docs.collect()]
    got = near_duplicates(spark, docs.repartition(3), width=width)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == brute(ids, texts, width)


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """Many texts of one key, of which one alone is near all others, and pairs that only each other are near."""
    monkeypatch.setattr(minhash, "LEADS", 2)
    monkeypatch.setattr(minhash, "FACTOR", 2)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for i in rng.sample(range(120), rng.choice([5, 9, 12, 14])):
            w[i] = rng.choice(words)
        texts.append(" ".join(w))
        if rng.random() < 0.3:
            w[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    ids = [i * 3 for i in range(len(texts))]
    want = brute(ids, texts)
    assert len({c for _, _, c, _ in want}) > 3
    assert Counter(map(tuple, near_duplicates(spark, table(spark, texts, ids)).collect())) == want


def test_equal_rows_ids_and_nulls(spark):
    texts = ["a b c d e f"] * 5 + [None, "", "  \n", "x", "x", "lone text here"]
    ids = [7, 7, 7, 3, 9, 1, 1, 2, 20, 10, None]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = Counter(map(tuple, near_duplicates(spark, docs).collect()))
    assert got == Counter({(7, 5, 3, False): 3, (3, 5, 3, True): 1, (9, 5, 3, False): 1, (1, 0, 1, True): 2, (2, 0, 2, True): 1, (20, 1, 10, False): 1, (10, 1, 10, True): 1, (None, 2, None, True): 1})


def test_empty_table_and_long_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(spark, docs).collect() == []
    long = " ".join(f"w{i % 70000}x{i % 11}" for i in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short one")], "doc_id long, text string")
    n = len(shingles(long))
    assert sorted(map(tuple, near_duplicates(spark, docs).collect())) == [(1, n, 1, True), (2, n + 1, 1, False), (3, 1, 3, True)]


def test_sketches_fill_and_agree_as_the_index_says():
    rng = random.Random(6)
    for size in (1, 2, 7, 60, 900):
        texts = [" ".join(f"w{rng.random()}" for _ in range(size + 1)) for _ in range(30)]
        hashes, rows = minhash.shingle_sets(pa.array(texts), 2)
        sketch = minhash.sketches(hashes, rows)
        assert np.all(sketch < np.uint64(1 << 63)) and len(np.unique(sketch)) > 1
    agree = []
    for _ in range(60):
        base = [str(rng.random()) for _ in range(90)]
        a, b = base + [str(rng.random()) for _ in range(10)], base + [str(rng.random()) for _ in range(12)]
        h = [np.sort(np.array([hash(x) & ((1 << 63) - 1) for x in y], np.uint64)) for y in (a, b)]
        s = minhash.sketches(np.concatenate(h), np.array([0, 100, 202]))
        agree.append(np.mean(s[0] == s[1]))
    assert abs(np.mean(agree) - 90 / 112) < 0.015 and np.std(agree) < 0.04
    assert minhash.missed(0.8) < 1e-6
    assert minhash.least_agreement(1.0) == minhash.COORDINATES and 180 < minhash.least_agreement(0.8) < 205
