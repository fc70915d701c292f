"""Near and exact repeats against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from helpers import awkward_texts, table


def repeat_texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [prose(60) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [prose(rng.randint(0, 40)) if rng.random() < 0.6 else rng.choice(shared)[rng.randint(0, 60) : rng.randint(200, 400)] for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    near = texts[0] + prose(150)
    for _ in range(12):
        w = near.split()
        w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    return texts + awkward_texts(seed) + ["z" * 201, "z" * 200, "ab" * 150, texts[3]]


def test_bytes_against_brute_force(spark):
    from strandflow.llm.suffix import remove_repeats

    texts = repeat_texts(1)
    docs = table(spark, texts)
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    want = []
    for row, b in zip(docs.collect(), raw):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((row.doc_id, len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in remove_repeats(spark, docs).collect()]
    assert Counter(got) == Counter(want)
    assert sum(r[2] for r in want) > 10_000


def test_words_against_brute_force(spark):
    from strandflow.llm.lempelziv import remove_repeats

    texts = repeat_texts(2)
    docs = table(spark, texts)
    rows = sorted(zip((r.doc_id for r in docs.collect()), texts), key=lambda x: (x[0] is not None, x[0] or 0))
    first, want = {}, []
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        gone = np.zeros(len(w) + 1, int)
        for i in range(len(w) - 19):
            if first.setdefault(tuple(w[i : i + 20]), (d, i)) != (d, i):
                gone[i : i + 20] = 1
        want.append((d, len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    assert Counter(tuple(r) for r in remove_repeats(spark, docs).collect()) == Counter(want)
    kept = remove_repeats(spark, docs.withColumn("version", docs.doc_id), with_text=True).collect()
    by_id = {r.doc_id: r for r in kept}
    for d, n, removed, digest in want:
        assert hashlib.sha256(" ".join(re.findall("[^\x20\x09-\x0d]+", by_id[d].text or "")).encode()).hexdigest() == digest
        assert (by_id[d].lz_words, by_id[d].lz_removed) == (n, removed)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_differ_in_one_long_word_are_not_repeats(spark):
    from strandflow.llm.lempelziv import remove_repeats

    shared = " ".join(f"w{i}" for i in range(19))
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{shared} {word}"), (2, f"{shared} {other}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(spark, docs).collect()) == [(1, 20, 0), (2, 20, 0)]


def test_factors_are_copies_of_their_references(spark):
    """Every factor's words stand at its reference, earlier; factors cover what the removal takes, in order, without overlap."""
    from strandflow.llm.lempelziv import factors, remove_repeats

    texts = [t for t in repeat_texts(5) if t]
    docs = table(spark, texts, list(range(1, len(texts) + 1)))
    words = {i + 1: re.findall("[^\x20\x09-\x0d]+", t) for i, t in enumerate(texts)}
    found = defaultdict(list)
    for r in factors(spark, docs).collect():
        found[r.doc_id].append((r.start, r.n_words, r.from_doc, r.from_start))
    removed = {r.doc_id: r.n_removed for r in remove_repeats(spark, docs).collect()}
    assert sum(removed.values()) > 2000
    for d, n in removed.items():
        at = 0
        for start, size, source, place in sorted(found[d]):
            assert start >= at and (source, place) < (d, start)
            assert words[d][start : start + size] == words[source][place : place + size]
            at = start + size
        assert sum(x[1] for x in found[d]) == n


def test_many_equal_rows(spark):
    """Hundreds of rows equal in id and text: each is another document to op4, all are one place to op6."""
    from strandflow.llm import lempelziv, suffix

    text = " ".join(f"word{i * i % 991}" for i in range(700))
    docs = spark.createDataFrame([(1, text, 0)] * 600 + [(2, text[:300], 1), (None, text, 2), (None, text, 2)], "doc_id long, text string, spans int").repartition(8)
    cut = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(spark, docs).collect())
    assert cut == {(1, len(text), len(text), 1): 600, (None, len(text), len(text), 1): 2, (2, 300, 300, 1): 1}
    lz = Counter((r.doc_id, r.n_removed) for r in lempelziv.remove_repeats(spark, docs).collect())
    assert lz == {(None, 0): 2, (1, 700): 600, (2, 20 * (len(text[:300].split()) >= 20) and len(text[:300].split()) - (text[299] != " " and text[300] != " ")): 1}


def test_chunk_borders(monkeypatch, spark):
    """Long documents cut into overlapping chunks lose nothing."""
    from strandflow.llm import repeats

    import pyarrow as pa

    rng = random.Random(4)
    text = "".join(rng.choice("abc ") for _ in range(3000))
    for bits in (9, 12):
        monkeypatch.setattr(repeats, "CHUNK_BITS", bits)
        covered = []
        symbols = repeats.Symbols(pa.array(["x" * 10, text, "y" * 300]), "byte")
        for _first, base, s, rows, shift in repeats._chunks(symbols, 200):
            row, lo, hi, _ = repeats.runs(s, rows, 200, 32)
            for r, a, b in zip(row, lo, hi):
                assert symbols.codes[base : base + len(s)].tolist() == s.tolist()
                covered += [(_first + r, shift + p - (0 if shift else rows[r])) for p in range(a, b + 1)]
        assert Counter(covered) == Counter([(1, p) for p in range(2801)] + [(2, p) for p in range(101)])


def test_empty_tables(spark):
    from strandflow.llm import lempelziv, simhash, suffix

    nothing = table(spark, [])
    assert lempelziv.remove_repeats(spark, nothing).count() == 0
    assert suffix.remove_repeats(spark, nothing).count() == 0
    assert simhash.near_duplicates(spark, nothing).count() == 0
    assert suffix.remove_repeats(spark, table(spark, [None, ""])).count() == 2


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(marks):
    """Component ids of (doc_id, mark) rows by brute force over distinct marks."""
    distinct = sorted(set(m for _, m in marks))
    root = {m: m for m in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for d, m in marks:
        ids[find(m)].append(d)
    low = {r: min((d for d in x if d is not None), default=None) for r, x in ids.items()}
    return Counter((d, f"{m:016x}", low[find(m)]) for d, m in marks)


def test_simhash_against_brute_force(spark):
    from strandflow.llm.simhash import near_duplicates

    texts = repeat_texts(3)
    docs = table(spark, texts)
    marks = [(r.doc_id, brute_fingerprint(t)) for r, t in zip(docs.collect(), texts)]
    assert Counter(map(tuple, near_duplicates(spark, docs).collect())) == smallest(marks)


@pytest.mark.parametrize("crowded", [2, 24])
def test_links_are_complete(spark, monkeypatch, tmp_path, crowded):
    """Random fingerprints in clusters: pairs and meeting points connect what all pairs connect."""
    from strandflow.llm import simhash
    from strandflow.llm.common import Scratch
    from strandflow.llm.components import components

    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(crowded)
    marks = {0}
    for _ in range(12):
        m = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            marks.add(m)
            for _ in range(rng.randint(1, 3)):
                m ^= 1 << rng.randrange(64)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    scratch = Scratch(spark, "test")
    found = components(simhash.links(spark.createDataFrame([(m,) for m in signed], "mark long"), scratch), scratch).collect()
    root = {r.node: r.root for r in found}
    got = Counter((m, root.get(s, s)) for m, s in zip(marks, signed))
    groups, want = defaultdict(set), defaultdict(set)
    for m, r in got:
        groups[r].add(m)
    for (m, _, low), _n in smallest([(m, m) for m in marks]).items():
        want[low].add(m)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_golay_neighbours_share_an_index():
    from strandflow.llm.simhash import golay_indices

    rng = random.Random(6)
    words = np.array([rng.getrandbits(23) for _ in range(3000)])
    other = words ^ (1 << np.array([rng.randrange(23) for _ in words]))
    for a, b in zip(golay_indices(words), golay_indices(other)):
        assert set(a[a >= 0]) & set(b[b >= 0])
        assert len(a[a >= 0]) in (1, 6)


def test_similar_texts_are_linked(spark):
    """Texts with Jaccard index 0.85 or more share a component; unrelated ones don't, and a large group is no trouble."""
    from strandflow.llm.simhash import near_duplicates

    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(150, 400))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(len(w) // 120):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    base = [rng.choice(words) for _ in range(300)]
    for _ in range(60):
        w = list(base)
        w[rng.randrange(300)] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [None, "", "a b"]
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)})
    docs = table(spark, texts, list(range(len(texts))))
    group = {r.doc_id: r.component_id for r in near_duplicates(spark, docs, width=5, similar=0.8).collect()}
    near = lost = 0
    for i in range(len(texts)):
        for j in range(i):
            if not sets[i] or not sets[j]:
                continue
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            near += alike >= 0.85
            lost += alike >= 0.85 and group[i] != group[j]
            assert alike > 0.3 or group[i] != group[j]
    assert near > 100 and lost <= 0.01 * near
    assert near_duplicates(spark, table(spark, []), width=5, similar=0.8).count() == 0


def test_crowded_bands_are_compared_in_full(spark):
    """Stars of copies that are similar to their base only: links are those of all pairs that meet in a band."""
    import pyarrow as pa
    from strandflow.llm import simhash
    from strandflow.llm.common import Scratch
    from strandflow.llm.components import components

    rng = np.random.default_rng(7)
    long = []
    for _ in range(3):
        base = rng.integers(0, 2, 1280)
        long += [base] + [base ^ (rng.random(1280) < 0.145) for _ in range(200)]
    raw = [np.packbits(x.astype(np.uint8), bitorder="little").tobytes() for x in long]
    signed = [int.from_bytes(x[:8], "little", signed=True) for x in raw]
    assert len(set(signed)) == len(raw)
    width = (len(raw) - 1).bit_length() + simhash.SPARE
    batch = next(iter(simhash._bands([pa.record_batch({"mark": pa.array(signed), "long": pa.array(raw)})], width, simhash.band_count(width, 0.8))))
    buckets = defaultdict(list)
    place = {m: i for i, m in enumerate(signed)}
    for key, m in zip(batch.column("key").to_pylist(), batch.column("mark").to_pylist()):
        buckets[key].append(place[m])
    root = list(range(len(raw)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    p = np.arccos(2 * 0.8 / 1.8) / np.pi
    bits, limit = np.array(long), round(1280 * p + simhash.MARGIN * np.sqrt(1280 * p * (1 - p)))
    for own in buckets.values():
        for n, i in enumerate(own):
            for j in own[:n]:
                d = bits[i] != bits[j]
                if d.sum() <= limit and d[:64].sum() <= simhash.NEAR:
                    root[find(i)] = find(j)
    want = defaultdict(set)
    for i, m in enumerate(signed):
        want[find(i)].add(m)
    scratch = Scratch(spark, "test")
    marks = spark.createDataFrame([(m, bytearray(x)) for m, x in zip(signed, raw)], "mark long, long binary")
    got = defaultdict(set)
    roots = {r.node: r.root for r in components(simhash.similar_links(marks, scratch, 0.8), scratch.inner("all")).collect()}
    for m in signed:
        got[roots.get(m, m)].add(m)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert sum(len(x) > 1 for x in want.values()) == 3


@pytest.mark.parametrize("width", [18, 20, 23, 26])
def test_pairs_meet_at_every_corpus_size(width):
    """Pairs at similarity 0.8 share a band as often at the band widths of large corpora."""
    import pyarrow as pa
    from strandflow.llm import simhash

    rng = np.random.default_rng(width)
    n, p = 3000, np.arccos(2 * 0.8 / 1.8) / np.pi
    a = rng.integers(0, 2, (n, 64 * simhash.PARTS))
    b = a ^ (rng.random(a.shape) < p)
    count = simhash.band_count(width, 0.8)

    def keys(bits):
        raw = [np.packbits(x.astype(np.uint8), bitorder="little").tobytes() for x in bits]
        parts = simhash._bands([pa.record_batch({"mark": pa.array(range(n)), "long": pa.array(raw)})], width, count)
        return np.concatenate([x.column("key").to_numpy() for x in parts]).reshape(n, count)

    met = (keys(a) == keys(b)).any(axis=1).mean()
    assert met > simhash.MEET - 0.01


@pytest.mark.parametrize("alike", [0.8, 0.85])
def test_recall_at_the_similarity_asked_for(spark, alike):
    """Independent pairs at a Jaccard index of ``alike``: nine in ten at least share a component."""
    from strandflow.llm.simhash import near_duplicates

    rng = random.Random(int(alike * 100))
    texts = []
    for _ in range(150):
        words = ["".join(rng.choice("etaoinshr") for _ in range(9)) for _ in range(400)]
        shingles, edits = len(words) - 4, 0
        other = list(words)
        for at in range(2, 400, 6):  # an edit that is alone changes five shingles on both sides
            if (shingles - 5 * (edits + 1)) / (shingles + 5 * (edits + 1)) < alike:
                break
            other[at], edits = "edit" + str(at), edits + 1
        texts += [" ".join(words), " ".join(other)]
    group = {r.doc_id: r.component_id for r in near_duplicates(spark, table(spark, texts, list(range(300))), width=5, similar=0.8).collect()}
    assert sum(group[i] == group[i + 1] for i in range(0, 300, 2)) >= 0.9 * 150
    assert len(set(group.values())) >= 150


def test_contraction_keeps_what_is_connected(spark):
    from strandflow.llm.common import Scratch
    from strandflow.llm.components import components

    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(300)] + [(2000 + rng.randrange(80), 2100 + rng.randrange(80)) for _ in range(60)] + [(5, 5)]
    rows = spark.createDataFrame(edges, "u long, v long").repartition(16)
    found = {r.node: r.root for r in components(rows, Scratch(spark, "test")).collect()}
    assert len({found[i] for i in range(401)}) == 1 and len({found[i] for i in range(1000, 1300)}) == 1
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    want = defaultdict(set)
    for x in root:
        want[find(x)].add(x)
    got = defaultdict(set)
    for x in root:
        got[found.get(x, x)].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_one_row_of_each_component_stays(spark):
    """Null and repeated ids with different texts lose nothing; of rows equal in id and text one stays."""
    import corpus_pipeline

    rng = random.Random(21)
    text = lambda: " ".join("".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(60))
    texts = [text() for _ in range(9)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (4, texts[3]), (4, texts[4]), (4, texts[4]), (6, texts[5]), (6, texts[5]), (7, texts[5]), (None, texts[6]), (8, texts[6]), (None, texts[7]), (None, texts[7]), (9, texts[8]), (3, texts[8])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = [(None, 0), (None, 1), (None, 2), (4, 3), (4, 4), (6, 5), (8, 6), (None, 7), (3, 8)]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == Counter((d, texts[i]) for d, i in want)


def test_a_header_of_different_texts_with_one_id_stays_once(spark):
    """Null or repeated ids: a passage at the same place of different texts has one first occurrence; rows equal in id and text are one place."""
    from strandflow.llm import lempelziv, linededup

    rng = random.Random(31)
    words = lambda k: ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(k)]
    head = words(30)
    lines = "\n".join(" ".join(head[i : i + 10]) for i in (0, 10, 20))
    bodies = [" ".join(words(40)) for _ in range(8)]
    ids = [None, None, None, 5, 5, 5, 6, 6]
    texts = [f"{lines}\n{b}" for b in bodies]
    for same in ([0, 1, 2], [3, 4, 5, 3], [3, 6, 7], [6, 6]):
        docs = spark.createDataFrame([(ids[i], texts[i]) for i in same], "doc_id long, text string")
        distinct = len(set(same))
        cut = Counter((r.doc_id, r.kept_sha256, r.n_removed) for r in lempelziv.remove_repeats(spark, docs).collect())
        lined = Counter((r.doc_id, r.kept_sha256, r.n_removed) for r in linededup.digest(docs).collect())
        for found, n in ((cut, 30), (lined, 3)):
            assert sum(k[2] == 0 for k in found) == 1 and sum(k[2] == n for k in found) == distinct - 1
