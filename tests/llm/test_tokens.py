"""Encoding, packing and shard files against the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward_texts, table
from tokenizers import Tokenizer

public = pytest.importorskip("public_tokenizers")
WORD, BYTE = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def library(path, texts):
    t = Tokenizer.from_file(path)
    return t, [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_word_codec_is_the_library():
    from strandflow.llm.wordbpe import WordCodec

    texts = awkward_texts(2, 60)
    codec = WordCodec(open(WORD).read(), cap=50)
    got = [np.frombuffer(x, codec.dtype).tolist() for x in codec.encode(texts)]
    assert got == library(WORD, texts)[1]


def test_trie_is_the_library_on_random_words():
    from strandflow.llm.trie import load

    rng = random.Random(3)
    trie = load(open(BYTE).read(), lambda i: (i,))
    words = {"".join(rng.choice("etaoinshr éEA19_-€") for _ in range(rng.randint(1, 16))) for _ in range(3000)}
    tokenizer = Tokenizer.from_file(BYTE)
    from strandflow.llm.bytebpe import PIECES
    import regex

    pieces = {p for w in words for p in regex.findall(PIECES, w)} | {"a" * 500}
    got = trie.encode({p.encode() for p in pieces})
    assert all(list(got[p.encode()]) == tokenizer.encode(p, add_special_tokens=False).ids for p in pieces)
    by_rank = trie.by_rank()
    assert all(by_rank(p.encode()) == list(got[p.encode()]) for p in pieces)


def test_encode_decode(spark):
    from strandflow.llm.bytebpe import encode_decode

    texts = awkward_texts()
    tokenizer, ids = library(BYTE, texts)
    got = Counter(map(tuple, encode_decode(spark, table(spark, texts), BYTE).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter((r[0], len(i), sha(",".join(map(str, i))), sha(tokenizer.decode(i, skip_special_tokens=False))) for r, i in zip(table(spark, texts).collect(), ids))
    assert got == want
    assert encode_decode(spark, table(spark, []), BYTE).count() == 0


@pytest.mark.parametrize("targets", [None, {"s0": 3, "s3": 1}, {"s0": 0.0, "nowhere": 1}])
def test_packing_places_every_id_once(spark, targets):
    from strandflow.llm.packing import pack

    texts = awkward_texts() * 3
    docs = table(spark, texts, list(range(len(texts))))
    ids = [i + [1] for i in library(WORD, texts)[1]]
    rows = pack(spark, docs.repartition(3), WORD, window=256, targets=targets, with_ids=True).collect()
    of, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == crc(own[r.start : r.start + r.length])
        assert np.frombuffer(r.ids, "<u4").tolist() == own[r.start : r.start + r.length]
    assert set(of) == set(range(len(texts)))
    for d, pieces in of.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[d])
    assert sorted(seqs) == list(range(len(seqs)))
    for s, pieces in seqs.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 256 or s == len(seqs) - 1 and at < 256
    if targets is None:  # every whole window has the corpus mixture, to within a token of each queue's credit
        source = {r.doc_id: r.source for r in docs.collect()}
        share = Counter()
        for d, i in enumerate(ids):
            share[source[d]] += len(i)
        big = [s for s, n in share.items() if s and n > 0.1 * sum(share.values())]
        given = Counter()
        for s in sorted(seqs)[:-6]:
            for p in seqs[s]:
                given[source[p.doc_id]] += p.length
            for q in big:
                assert abs(given[q] - share[q] / sum(share.values()) * 256 * (s + 1)) < 8 + share[None]  # the smallest queue is served behind the largest


def test_packing_of_nothing(spark):
    from strandflow.llm.packing import pack

    assert pack(spark, table(spark, []), WORD).count() == 0


def test_apportion_never_takes_back():
    from strandflow.llm.packing import apportion, schedule, served, whole_weights

    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.choice([0, 5, 300, 9000, 100000]) for _ in range(rng.randint(1, 9))]
        phases = schedule(sizes, sizes, 256)
        total = sum(sizes)
        q = served(phases, np.arange(0, -(-total // 256) + 1), 256)
        assert (np.diff(q, axis=0) >= 0).all() and q[-1].tolist() == sizes
        assert (q.sum(axis=1) == np.minimum(np.arange(len(q)) * 256, total)).all()
    w = whole_weights([10**13, 10**10], 2048)
    assert apportion(w, np.array([1 << 44])).sum() == 1 << 44


def test_shards_round_trip(spark, tmp_path):
    from strandflow.llm.sstable import lookup, read_shards, roundtrip, write_shards

    texts = awkward_texts()
    docs = table(spark, texts)
    ids = [i + [2] for i in library(WORD, texts)[1]]
    rows = sorted(zip((r.doc_id for r in docs.collect()), ids), key=lambda x: (x[0] is not None, x[0] or 0))
    want, start = [], 0
    for d, i in rows:
        want.append((d, start, len(i), crc(i)))
        start += len(i)
    folder = f"file://{tmp_path}/shards"
    manifest = write_shards(spark, docs, WORD, folder)
    got = read_shards(spark, folder, manifest).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    rows = manifest.collect()
    for d, i in ((0, ids[0]), (90, ids[30]), (None, ids[7])):
        assert [x.tolist() for x in lookup(folder, rows, d)] == [i]
    assert lookup(folder, rows, 1) == [] and lookup(folder, rows, -5) == []
    assert roundtrip(spark, table(spark, []), WORD).count() == 0


def test_shard_blocks_and_repeated_keys(tmp_path):
    from strandflow.llm.sstable import Reader, Writer, key_of

    path = tmp_path / "x.sst"
    keys = sorted([*range(-500, 500), 7, 7, 7])
    with open(path, "wb") as f:
        w = Writer(f)
        for k in keys:
            w.add(key_of(k), np.arange(abs(k) * 3, dtype="<u2").tobytes())
        w.close({"dtype": "<u2"})
    r = Reader(f"file://{path}")
    assert len(r.index) > 3 and [k for k, _ in r] == keys
    assert len(r.get(7)) == 4 and len(r.get(-500)) == 1 and r.get(1000) == []


@pytest.mark.parametrize("up", [None, "s7"])
def test_many_small_sources_are_mixed(spark, up):
    """200 equal sources in files of one source each: every stretch of windows has all of them, a small one with a target its share."""
    from helpers import DOCS
    from strandflow.llm.packing import pack

    rng = random.Random(3)
    rows = [(s * 20 + i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(30, 60))), "en", f"s{s}" if s else None, 1) for s in range(200) for i in range(20)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), DOCS)
    targets = {up: 0.25, "s8": 0.05, "absent": 0.1} if up else None
    pieces = pack(spark, docs, WORD, window=256, targets=targets).orderBy("sequence_id", "offset").collect()
    source, size, most = {r[0]: r[3] for r in rows}, Counter(), max(p.doc_tokens for p in pieces)
    for p in pieces:
        size[source[p.doc_id]] += p.length
    total, given, done = sum(size.values()), Counter(), 0
    for p in pieces:
        given[source[p.doc_id]] += p.length
        done += p.length
        if targets is None:  # each source has had its share, to within a document or so
            assert all(abs(given[s] - done * n / total) <= 2 * most for s, n in size.items())
        elif given[up] < size[up] - most:  # the two with a target take turns at five to one
            assert abs(given[up] - 5 * given["s8"]) <= 6 * most
    assert done == total and len(size) == 200
    if up:
        last = max(p.sequence_id for p in pieces if source[p.doc_id] in (up, "s8"))
        assert last < 0.1 * max(p.sequence_id for p in pieces)
