"""SimHash near-duplicates found through a Golay code.

A fingerprint has 64 bits. Two that differ in at most two bits are brought together as follows.
The bits are cut into three segments A, B, C (22, 21, 21 bits, each filled up to 23). Of at most two
errors, one of three ordered pairs (X, Y) out of (A, B), (B, C), (C, A) has none in X and at most
one in Y (pigeonhole). The 23-bit words of Y are decoded with the perfect Golay code, in which every
word lies within three bits of exactly one of 4,096 codewords: a word's indices are that codeword
and, for a word at distance three, also the five codewords at distance four. Two words that differ in
one bit share an index. So the keys (pair, X, index of Y), three to eighteen for a
fingerprint and of some 33 bits, bring every linked pair together, and each candidate pair is verified
by its true distance.

Where a key holds many different fingerprints, not all pairs are formed: every fingerprint of the
bucket names itself and its 64 one-bit neighbours as meeting points, and two fingerprints differ in
at most two bits exactly if they have a meeting point in common; each then links to the smallest of
its meeting point. This is exact and grows with the bucket's size, not its square.

Two bits of 64 stand for texts that are all but equal. For a similarity (Jaccard index of the shingle sets) as low as
0.8, ``similar`` adds links of a second kind: PARTS fingerprints of 64 bits from differently mixed hashes make a long one,
whose share of differing bits is the angle of the shingle counts over pi, to within about 0.01. Texts meet in
bands of equal bits, and a link is kept if the long fingerprints agree with the similarity asked for; none is made on a band alone.
Small buckets are compared by pairs. In crowded ones one member leads and meets all others of the bucket; then all pairs that the links so far
don't connect are compared, once there are few of them (PAIRS for each member of a bucket, over all buckets); until then more members lead, in rounds. So a group of close
copies takes one round and no pair of a bucket that could connect more is left out. The long fingerprints may differ by MARGIN standard deviations
more than the similarity's angle, so that a pair just at it is kept with a chance of 0.95. A band has
SPARE bits more than the logarithm of the number of fingerprints, so that what meets by chance grows with the corpus and not
with its square; the number of bands follows the width, so that the chance to meet stays above MEET at every size.

Only distinct fingerprints take part; documents join them at the end. Documents without words have
fingerprint zero. A null text has no words; a null doc_id gets its component like any other but is
never a component's id unless alone; repeated rows each give a row.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ddl, ship, slices, text_buffer
from .components import components
from .repeats import STEP, _mix

#: Above so many different fingerprints in a bucket, meeting points take the place of pairs.
CROWDED = 24
#: Generator polynomial of the binary Golay code of length 23. Fixed value.
GOLAY = 0b101011100011
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: 64-bit parts of the long fingerprint, and bits of a band beyond the logarithm of the number of fingerprints.
PARTS, SPARE = 20, 3
#: Least chance that two texts just at the similarity asked for meet in a band, at every corpus size.
MEET = 0.98
#: Above so many members, a band's bucket is compared by leads, in each round so many times those of the one before.
BUCKET, FACTOR = 8, 8
#: Open pairs for each member of a crowded bucket, up to which all are compared.
PAIRS = 32
#: Deviations by which the long fingerprints may differ more than the similarity has it.
MARGIN = 1.65
#: Bits of the first 64 in which members of a bucket may differ to be compared in full (0.8 has some 9.7, deviation 2.9).
NEAR = 24
POINTS = np.array([0, *(1 << i for i in range(64))], np.uint64)


def shingle_hashes(raw: bytes, width: int = 3) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; raw: UTF-8."""
    words = raw.lower().split()  # bytes: only A-Z are lowered and only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(text, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    ends = (starts + sizes - 1)[width - 1 :]
    return np.array([digest(text[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)


def majority(hashes: np.ndarray, parts: int = 1) -> bytes:
    """The bits set in over half the hashes, little-endian; with more ``parts``, also of the hashes mixed anew for each."""
    count = np.zeros(64 * parts, np.int64)
    salt = (np.arange(parts, dtype=np.uint64) * STEP)[None, :]
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 255):  # so many that a byte holds a bit's count
            some = hashes[at : at + 255, None]
            mixed = np.concatenate([some, _mix(some + salt[:, 1:])], axis=1).astype("<u8")
            bits = np.unpackbits(mixed.view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
            count += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(count * 2 > len(hashes), bitorder="little").tobytes()


def _fingerprints(batches, width, others, long):
    for whole in batches:
        for batch in slices(whole):
            raw, rows = text_buffer(batch.column("text"))
            data = raw.tobytes()
            marks, wide = [], []
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
                hashes = shingle_hashes(data[a:b], width)
                mark = majority(hashes, PARTS if long else 1)
                wide.append(mark)
                marks.append(int.from_bytes(mark[:8], "little"))
            arrays, names = [*(batch.column(c) for c in others), pa.array(np.array(marks, np.uint64).view(np.int64))], [*others, "mark"]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(wide, pa.binary())] if long else []), names=names + ["long"] * long)


def band_count(width: int, similarity: float) -> int:
    """Bands of this width in which two texts at the similarity meet with a chance of MEET at least."""
    size, p = 64 * PARTS, math.acos(2 * similarity / (1 + similarity)) / math.pi
    # bands share bits, so the chance is taken for each number of differing bits
    chance = [math.exp(math.lgamma(size + 1) - math.lgamma(d + 1) - math.lgamma(size - d + 1) + d * math.log(p) + (size - d) * math.log1p(-p)) for d in range(size + 1)]
    same = size - np.arange(size + 1)
    apart = 1 - np.prod([np.maximum(same - i, 0) / (size - i) for i in range(width)], axis=0)
    count = size // width
    while float(chance @ apart**count) > 1 - MEET:
        count += max(1, count // 50)
    return count


def _bands(batches, width, count):
    size = 64 * PARTS
    each = size // width
    # when the bits are used up, they are dealt anew in another order
    orders = [np.arange(size) if k == 0 else np.argsort(_mix(np.arange(size, dtype=np.uint64) + np.uint64(k * size)), kind="stable") for k in range(-(-count // each))]
    powers = 1 << np.arange(width, dtype=np.int64)
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            marks = batch.column("mark").to_numpy()
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column("long").to_pylist()), np.uint8).reshape(len(marks), -1), axis=1, bitorder="little")
            value = [bits[:, o[: each * width]].reshape(len(marks), each, width).astype(np.int64) @ powers for o in orders]
            keys = np.concatenate(value, axis=1)[:, :count] | np.arange(count, dtype=np.int64)[None, :] << width
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(marks, count))], names=["key", "mark"])


def _word(column: str, i: int):
    """Eight bytes of a long fingerprint as a number."""
    return F.conv(F.hex(F.substring(column, 8 * i + 1, 8)), 16, -10).cast("long")


def most_different(similarity: float) -> int:
    """Bits in which the long fingerprints of texts of that similarity may differ."""
    size, p = 64 * PARTS, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(size * p + MARGIN * math.sqrt(size * p * (1 - p)))


def _alike(found: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Of candidates (u, v), those whose long fingerprints agree with the similarity."""
    one, two = marks.select(F.col("mark").alias("u"), F.col("long").alias("a")), marks.select(F.col("mark").alias("v"), F.col("long").alias("b"))
    both = found.join(one, "u").join(two, "v")
    differ = sum((F.bit_count(_word("a", i).bitwiseXOR(_word("b", i))) for i in range(PARTS)), F.lit(0))
    return both.where(differ <= most_different(similarity)).select("u", "v")


def similar_links(marks: DataFrame, scratch: Scratch, similarity: float, known: DataFrame | None = None) -> DataFrame:
    """Edges (u, v) that, with those of ``known``, connect what all similar pairs that meet in a band do; marks: distinct mark, long."""
    width = max(1, marks.count() - 1).bit_length() + SPARE
    count = band_count(width, similarity)
    keys = scratch.keep(marks.select("mark", "long").mapInArrow(lambda b: _bands(b, width, count), "key long, mark long"), "bands")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.keep(keys.join(sizes, "key"), "met")
    scratch.drop("bands")
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= NEAR
    few = met.where(F.col("n") <= BUCKET)
    pairs = few.select("key", F.col("mark").alias("u")).join(few.select("key", F.col("mark").alias("v")), "key").where("u < v").where(close).select("u", "v")
    crowd, k = met.where(F.col("n") > BUCKET), 0
    # of a crowded bucket one member leads first and meets all others
    chance = lambda: F.shiftrightunsigned(F.xxhash64("key", "mark"), 11)
    lead = crowd.groupBy("key").agg(F.min_by("mark", chance()).alias("v"))
    met_now = crowd.select("key", F.col("mark").alias("u")).join(lead, "key").where("u <> v").where(close)
    found = scratch.keep(pairs.unionByName(met_now.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct(), "candidates")
    edges = scratch.keep(_alike(found, marks, similarity), "alike")
    scratch.drop("candidates")
    edges = edges.unionByName(known) if known is not None else edges
    # from here on the long fingerprint goes along, as numbers, and the join itself compares it
    words = [f"w{i}" for i in range(1, PARTS)]
    wide = marks.select("mark", *[_word("long", i).alias(f"w{i}") for i in range(1, PARTS)])
    left = crowd.select("key", "mark", (chance() / F.lit(float(1 << 53)) * F.col("n")).alias("draw")).join(wide, "mark")
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"x{w[1:]}"))) for w in words), F.bit_count(F.col("u").bitwiseXOR(F.col("v"))))
    alike = close & (differ <= most_different(similarity))
    while not left.isEmpty():
        roots = components(edges, scratch.inner(f"round-{k}"))
        now = left.join(roots, left.mark == roots.node, "left").select("key", "mark", "draw", *words, F.coalesce("root", "mark").alias("root"))
        now = scratch.keep(now, f"now-{k}")
        # pairs of a bucket in different components are all that can connect more; its largest component is its main one
        classes = now.groupBy("key", "root").agg(F.count("*").alias("c"))
        mixed = classes.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * F.col("c")).alias("s"), F.max(F.struct("c", "root")).alias("m"))
        mixed = scratch.keep(mixed.where(F.col("n") > F.col("m.c")).select("key", F.col("m.root").alias("main"), ((F.col("n").cast("double") * F.col("n") - F.col("s")) / 2).alias("open")), f"mixed-{k}")
        open_, = mixed.agg(F.sum("open")).first()
        if not open_:
            break
        now = scratch.keep(now.join(mixed.select("key", "main"), "key"), f"left-{k}")
        if open_ > PAIRS * now.count() and now.agg(F.max("draw")).first()[0] >= FACTOR ** (k + 1):
            lead, last = now.where(F.col("draw") < FACTOR ** (k + 1)), False
        else:
            lead, last = now.where(F.col("root") != F.col("main")), True
        lead = lead.select("key", F.col("mark").alias("v"), F.col("root").alias("to"), *[F.col(c).alias(f"x{c[1:]}") for c in words])
        pairs = now.select("key", F.col("mark").alias("u"), "root", "main", *words).join(lead, "key").where(F.col("root") != F.col("to"))
        # in the last round both of a pair lead unless one is of the main component
        pairs = pairs.where((F.col("root") == F.col("main")) | (F.col("u") < F.col("v"))) if last else pairs
        more = scratch.keep(pairs.where(alike).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"alike-{k}")
        scratch.drop(f"now-{k}")
        # the stars of the components stand for the edges so far
        edges = roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)
        if last:
            break
        left, k = now.select("key", "mark", "draw", *words), k + 1
    return edges


@functools.cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns (up to six, -1: none) that lead to the codewords that index a word."""
    table = np.full((2048, 6), -1, np.int64)

    def syndrome(word: int) -> int:
        for shift in range(11, -1, -1):
            if word >> (shift + 11) & 1:
                word ^= GOLAY << shift
        return word

    unit = [syndrome(1 << i) for i in range(23)]
    used = np.zeros(2048, int)
    from itertools import combinations

    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = e = 0
            for b in bits:
                s ^= unit[b]
                e |= 1 << b
            if weight < 4 or bin(int(table[s, 0])).count("1") == 3:
                table[s, used[s]] = e
                used[s] += 1
    reduce = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and byte * 8 + i < 23:
                    reduce[byte, v] ^= unit[byte * 8 + i]
    return table, reduce


def golay_indices(words: np.ndarray) -> np.ndarray:
    """Rows of up to six codeword indices for 23-bit words; -1 where there are fewer."""
    table, reduce = golay_tables()
    s = reduce[0, words & 255] ^ reduce[1, words >> 8 & 255] ^ reduce[2, words >> 16]
    errors = table[s]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def fuzzy_keys(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (int64): row numbers and keys."""
    bits = marks.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for pair, (x, y) in enumerate(((0, 1), (1, 2), (2, 0))):
        index = golay_indices(parts[y])
        row, column = np.nonzero(index >= 0)
        rows.append(row)
        keys.append(pair << 40 | parts[x][row] << 12 | index[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches):
    for batch in batches:
        marks = batch.column("mark").to_numpy()
        rows, keys = fuzzy_keys(marks)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(marks[rows])], names=["key", "mark"])


def _points(batches):
    for batch in batches:
        marks = batch.column("mark").to_numpy()
        points = (marks.view(np.uint64)[:, None] ^ POINTS[None, :]).view(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(np.repeat(marks, len(POINTS)))], names=["point", "mark"])


def links(marks: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that connect the same fingerprints as all pairs within two bits do; marks: distinct, one column."""
    keys = scratch.keep(marks.mapInArrow(_keys, "key long, mark long"), "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.keep(keys.join(sizes, "key").select("key", "mark", "n"), "shared")
    few = shared.where(F.col("n") <= CROWDED)
    a, b = few.select("key", F.col("mark").alias("u")), few.select("key", F.col("mark").alias("v"))
    pairs = a.join(b, "key").where("u < v and bit_count(u ^ v) <= 2").select("u", "v").distinct()
    many = shared.where(F.col("n") > CROWDED).select("mark").distinct()
    points = many.mapInArrow(_points, "point long, mark long")
    meet = points.groupBy("point").agg(F.min("mark").alias("v"), F.count("*").alias("n")).where("n > 1").select("point", "v")
    met = points.join(meet, "point").where("mark <> v").select(F.col("mark").alias("u"), "v").distinct()
    return pairs.unionByName(met)


def _placed(docs: DataFrame, others: list[str], width: int, similar: float | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows (others, mark) of docs (others, text), and of each mark its first doc_id and its component's root."""
    rows = scratch.keep(docs.mapInArrow(lambda b: _fingerprints(b, width, others, similar is not None), ddl(docs, *others) + ", mark long" + ", long binary" * (similar is not None)), "rows")
    wide = [F.min("long").alias("long")] if similar is not None else []
    marks = scratch.keep(rows.groupBy("mark").agg(F.min("doc_id").alias("first"), *wide), "marks")
    edges = links(marks.select("mark"), scratch)
    if similar is not None:
        edges = similar_links(marks, scratch, similar, edges)
    roots = components(edges, scratch)
    return rows, marks.join(roots, marks.mark == roots.node, "left").select("mark", "first", F.coalesce("root", "mark").alias("root"))


def near_duplicates(spark: SparkSession, docs: DataFrame, *, width: int = 3, similar: float | None = None) -> DataFrame:
    """Per row: doc_id, fingerprint (hex), component_id (smallest doc_id reachable over links).

    ``similar`` also links texts whose shingle sets have at least that Jaccard index.
    """
    ship(spark)
    scratch = Scratch(spark, "simhash", like=docs)
    rows, placed = _placed(docs.select("doc_id", "text"), ["doc_id"], width, similar, scratch)
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_mark = placed.select("mark", "root").join(names, "root").select(F.col("mark").alias("own"), "component_id")
    by_mark = scratch.keep(by_mark, "by-mark")
    return rows.join(by_mark, rows.mark == by_mark.own).select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, *, width: int = 3, similar: float | None = None) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), then hash of the text, then row."""
    ship(spark)
    scratch = Scratch(spark, "simhash", like=docs)
    # row numbers hold once they are written
    docs = scratch.keep(docs.withColumn("_row", F.monotonically_increasing_id()), "docs")
    keyed = docs.select("doc_id", "_row", F.xxhash64("text").alias("version"), "text")
    rows, placed = _placed(keyed, ["doc_id", "_row", "version"], width, similar, scratch)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version", "_row")
    # first of each mark, then of each root, so that a large component's rows are only minimised
    firsts = rows.groupBy("mark").agg(F.min(order).alias("stays")).join(placed.select("mark", "root"), "mark")
    stay = scratch.keep(firsts.groupBy("root").agg(F.min("stays").alias("stays")).select(F.col("stays._row").alias("_row")), "stay")
    return docs.join(stay, "_row", "left_semi").drop("_row")
