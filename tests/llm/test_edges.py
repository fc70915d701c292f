"""The defined results for awkward tables: repeated rows, nulls, empty tables, clashing names, very long texts."""

import random
import resource
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from helpers import awkward_texts, table

public = pytest.importorskip("public_tokenizers")
WORD, BYTE = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.json")


def test_top_k_with_huge_components_and_clashing_names(spark):
    from strandflow.llm.topk import top_k

    rng = random.Random(2)
    for size, rows in ((1e6, 60), (3e13, 20)):
        vectors = [(i, [rng.uniform(-size, size) if j % 2 or size < 1e9 else 0.0 for j in range(4)]) for i in range(rows)]
        if size > 1e9:  # one query of small numbers, so that scores fit
            vectors[0] = (0, [1.0, -2.0, 0.5, 3.0])
        df = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, shard string, block int, data int")
        whole = {i: [int(np.floor(256.0 * x)) for x in v] for i, v in vectors}
        every = 10 if size < 1e9 else 1000
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(spark, df, every=every, k=3).collect()}
        for q in (i for i in whole if i % every == 0):
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:3]
            assert [got[q, r + 1] for r in range(3)] == [(i, -s) for s, i in best]


def test_a_long_unbroken_piece_takes_linear_memory():
    code = f"""
import resource, random
from strandflow.llm.bytebpe import PieceCodec
rng = random.Random(1)
text = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
codec = PieceCodec(open({BYTE!r}).read())
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids = codec.trie.encode([text.encode()])[text.encode()]
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base < 300_000, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base
from tokenizers import Tokenizer
assert list(ids) == Tokenizer.from_file({BYTE!r}).encode(text, add_special_tokens=False).ids
"""
    assert resource and subprocess.run([sys.executable, "-c", code], timeout=300).returncode == 0


def plain_round_robin(sizes, weights, window):
    """Tokens of each queue in each window: credits and deficits, window by window, while no queue runs dry."""
    total, served, out = sum(weights), [0] * len(sizes), []
    deficit = [0] * len(sizes)  # in parts of 1 / total token
    while all(s + window * w / total + 2 < n or not w for s, n, w in zip(served, sizes, weights)):
        credit = [d + w * window for d, w in zip(deficit, weights)]
        give = [max(0, c // total) for c in credit]
        rest = [c - g * total for c, g in zip(credit, give)]
        for q in sorted(range(len(sizes)), key=lambda q: (-rest[q], q))[: window - sum(give)]:
            give[q] += 1
        deficit = [c - g * total for c, g in zip(credit, give)]
        served = [s + g for s, g in zip(served, give)]
        out.append(give)
    return out


def test_windows_are_those_of_a_sequential_round_robin():
    from strandflow.llm.packing import schedule, served, whole_weights

    rng = random.Random(4)
    for _ in range(20):
        n = rng.randint(2, 9)
        sizes = [rng.randint(2_000, 60_000) for _ in range(n)]
        shares = [rng.choice([0, 1, 2, 5, 20]) for _ in range(n)]
        if not any(shares):
            continue
        want = plain_round_robin(sizes, [int(w) for w in whole_weights(shares, 256)], 256)
        phases = schedule(sizes, shares, 256)
        got = np.diff(served(phases, np.arange(len(want) + 1), 256), axis=0)
        assert np.abs(got - np.array(want).reshape(len(want), n)).max(initial=0) <= 1


def test_rare_sources_get_their_targets(spark):
    """Two rare sources, one aimed at three quarters and one at nothing: the first windows have the target mixture to a token."""
    from helpers import DOCS
    from strandflow.llm.packing import pack

    rng = random.Random(5)
    text = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(k))
    rows = [(i, text(60), "en", "web", 1) for i in range(3000)] + [(10_000 + i, text(60), "en", "rare1", 1) for i in range(15)] + [(20_000 + i, text(60), "en", "rare2", 1) for i in range(15)] + [(30_000, text(60), "en", "other", 1), (30_001, text(60), "en", None, 1)]
    pieces = pack(spark, spark.createDataFrame(rows, DOCS).repartition(5), WORD, window=256, targets={"web": 1, "rare1": 3, "rare2": 0}).collect()
    source = {r[0]: r[3] for r in rows}
    for window in (0, 1, 2):
        given = Counter()
        for p in pieces:
            if p.sequence_id == window:
                given[source[p.doc_id]] += p.length
        assert abs(given["rare1"] - 192) <= 1 and abs(given["web"] - 64) <= 1 and set(given) == {"rare1", "web"}
    last = max(p.sequence_id for p in pieces)
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert min(p.sequence_id for p in pieces if source[p.doc_id] in ("rare2", "other", None)) >= last - 12


def test_equal_ids_over_several_shards(spark, monkeypatch, tmp_path):
    from strandflow.llm import sstable

    monkeypatch.setattr(sstable, "SHARD_BYTES", 600)
    monkeypatch.setattr(sstable, "RUN", 2)
    rows = [(7, f"text {i} " * 5, i) for i in range(40)] + [(i, f"other {i}", 0) for i in (1, 2, 3, 9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    folder = f"file://{tmp_path}/shards"
    manifest = sstable.write_shards(spark, docs, WORD, folder)
    shards = manifest.collect()
    assert sum(r["first"] == 7 or r["last"] == 7 for r in shards) > 1
    assert len(sstable.lookup(folder, shards, 7)) == 40 and len(sstable.lookup(folder, shards, None)) == 2 and len(sstable.lookup(folder, shards, 9)) == 1
    got = sorted(sstable.read_shards(spark, folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert max(r["ord"] for r in shards) >= 2 * sstable.RUN


def test_small_tables_get_a_shard_a_core(spark, monkeypatch, tmp_path):
    from strandflow.llm import sstable

    monkeypatch.setattr(sstable, "LEAST_BYTES", 100)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)] + [(400, "very long " * 200000)], "doc_id long, text string")
    manifest = sstable.write_shards(spark, docs, WORD, f"file://{tmp_path}/shards")
    assert manifest.count() >= min(4, spark.sparkContext.defaultParallelism)
    got = {r.doc_id: r.n_tokens for r in sstable.read_shards(spark, f"file://{tmp_path}/shards", manifest).collect()}
    assert len(got) == 401 and got[400] > 400000


def test_toxicity_of_awkward_tables(spark):
    from strandflow.llm.toxicity import severity

    rng = random.Random(6)
    words = ["".join(rng.choice("etaoin") for _ in range(5)) for _ in range(200)]
    text = lambda bad: " ".join([rng.choice(words) for _ in range(60)] + ["vilething"] * bad)
    rows = [(i, text(i % 3 == 0), "x") for i in range(300)]
    rows += [(0, rows[0][1], "x")] * 2 + [(1000, None, "x"), (1001, "", "x"), (None, text(1), "x"), (1002, "y" * 200_000 + " " + text(1), "x"), (1003, text(0) * 200, "x")]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(0, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade string")
    got = severity(spark, docs, labels).collect()
    assert len(got) == len(rows) and all(r.expected_severity is not None for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].toxic and not by_id[4].toxic and by_id[1002].toxic and by_id[None].toxic and not by_id[1000].toxic and not by_id[1003].toxic
    assert len({(r.expected_severity, r.toxic) for r in got if r.doc_id == 0}) == 1
    assert severity(spark, docs.limit(0), labels).count() == 0
    assert severity(spark, docs, labels.limit(0)).where("expected_severity is not null").count() == 0


def test_quality_of_awkward_tables(spark):
    from strandflow.llm.quality import assess, keep_good

    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good + f" tail{i}", None if i % 2 else "en", "a", 1) for i in range(50)]
    rows += [(3, good, "en", "b", 2), (3, good, "en", "b", 2), (None, good, None, "c", 3), (60, None, "en", "d", 4), (61, "same words here again now " * 30, "en", "e", 5), (62, "z " * 60_000, "en", "f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n_words int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = assess(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    judged = {r.doc_id: r for r in got}
    assert judged[0].kept and judged[None].kept and not judged[60].kept and judged[60].base_failed and judged[61].base_failed and judged[62].base_failed
    assert (judged[62].n_words, judged[62].n_repeat_words) == (60_000, 60_000)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert assess(docs.limit(0), labels).count() == 0 and keep_good(docs.limit(0), labels).count() == 0


def test_byte_encoding_of_repeated_rows(spark):
    from strandflow.llm.bytebpe import encode_decode

    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, None, 2)], "doc_id long, text string, n_tokens int")
    assert Counter((r.doc_id, r.n_tokens) for r in encode_decode(spark, docs, BYTE).collect()) == {(1, 2): 2, (None, 0): 1}


def test_pipeline_of_awkward_tables(spark):
    import corpus_pipeline

    texts = awkward_texts(3)
    docs = table(spark, texts + texts[:6], [None if i % 11 == 3 else i % 40 for i in range(len(texts) + 6)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    path = None
    import tempfile

    with tempfile.TemporaryDirectory() as path:
        labels.write.parquet(f"{path}/labels.parquet")
        for start in (docs, docs.limit(0), docs.withColumn("text", docs.text.substr(0, 0))):
            now = start
            for name, stage in corpus_pipeline.STAGES:
                before = now.count()
                now = stage(spark, now, path)
                if name != "packing":
                    assert now.columns == list(corpus_pipeline.COLUMNS) and now.count() <= before
                    now.write.mode("overwrite").parquet(f"{path}/{name}")
                    now = spark.read.parquet(f"{path}/{name}")
            pieces = now.collect()
            assert sum(p.length for p in pieces) == sum(n for _, n in {(p.doc_id, p.ids_crc32 if p.start == 0 else None, p.doc_tokens): p.doc_tokens for p in pieces if p.start == 0}.items()) or len(pieces) == 0
