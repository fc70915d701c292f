"""Near-duplicates by fast similarity sketches, banding and exact verification.

A set's sketch has COORDINATES coordinates, filled in rounds. In round i every element falls, by a hash of its own to that
round, into one coordinate with the value (i, hash); a coordinate keeps its least value, so later rounds only fill what is
empty. After as many rounds as there are coordinates, round i puts all elements into coordinate i, so every one is filled whatever the set's size. A
set is done once its coordinates are full: large sets after one or two rounds. Two sets agree in a
coordinate with a chance of their Jaccard index, and the number of agreements is concentrated as if coordinates were independent.

BANDS bands of WIDTH coordinates are keys. Two sets at 0.8 share no key with a chance of 5e-7 (``missed``), whatever
the corpus. Sets that share one are candidates. A candidate pair is dropped by its sketches (four bits of each coordinate)
if they agree less than sets of that similarity do but once in 1e9, and by bitmaps of the shingles if these alone show that too few can be shared, which
is never wrong. All others are compared in full: by the shingles of both.

Equal sets count once. A band's key may be shared by very many different sets. First all of them are compared with one: that which shares most
keys with others, the centre of a group of near copies. Then components are contracted, and in keys with several components the members
outside the largest one are compared with all others: LEADS of them in the first round, FACTOR times as many in each further one. That is done in
blocks of the members, each in a task, which give out near pairs only, and each pair where it first shares a key. So a group costs about its size, but for members that
look near and are not, and no link is left out.

Shingles are told by 64-bit hashes of their words' 64-bit hashes. Texts of one word have that word as their shingle; texts without words, and null
texts, have none and link with nothing. Rows are documents each: equal doc_ids don't link. component_id leaves out null doc_ids, unless
all reachable ones are null; ``kept`` then holds. Columns of other names are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ddl, ship, slices, text_buffer
from .components import components
from .repeats import STEP, _mix

BANDS, WIDTH = 48, 6
COORDINATES = BANDS * WIDTH
#: Longs that hold four bits of each coordinate.
LONGS = COORDINATES // 16
#: A candidate pair at the similarity asked for is dropped by its sketches with this chance at most.
DROPPED = 1e-9
#: Bytes of a text that are split into words together.
CHUNK = 1 << 20
#: Longs of a set's bitmap of shingles.
BITMAP = 16
#: Members outside a key's largest component that are compared with all others in the first round, and how many times as many in each further one.
LEADS, FACTOR = 1024, 8
#: Members of a key that a task compares with others at a time.
BLOCK = 512
NIBBLES = np.uint64(0x1111111111111111)


def missed(similarity: float) -> float:
    """The chance that two sets of this similarity share no key."""
    return (1 - similarity**WIDTH) ** BANDS


def least_agreement(similarity: float) -> int:
    """Coordinates, of four bits each, in which two sets of this similarity agree but for a chance of DROPPED."""
    p, total = similarity + (1 - similarity) / 16, 0.0
    for k in range(COORDINATES + 1):
        total += math.exp(math.lgamma(COORDINATES + 1) - math.lgamma(k + 1) - math.lgamma(COORDINATES - k + 1) + k * math.log(p) + (COORDINATES - k) * math.log1p(-p)) if p < 1 else 0
        if total > DROPPED:
            return k
    return COORDINATES


def _words(data: bytes) -> np.ndarray:
    """Hashes of a text's words: only A-Z are lowered and only ASCII white space splits."""
    parts, at = [], 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, data[at:end].lower().split()), np.uint64))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted: their hashes and row offsets."""
    raw, rows = text_buffer(column)
    data = raw.tobytes()
    of = [_words(data[a:b]) for a, b in itertools.pairwise(rows.tolist())]
    count = np.fromiter(map(len, of), np.int64, len(of))
    words = np.concatenate([*of, np.zeros(width, np.uint64)])
    begin = np.cumsum(count) - count
    short = count < width
    # a short text's shingle takes in all its words; a place beyond them adds nothing
    many = np.where(short, np.minimum(count, 1), count - width + 1)
    row = np.repeat(np.arange(len(of)), many)
    first = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    size = np.where(short, count, width)[row]
    with np.errstate(over="ignore"):
        hashes = np.zeros(len(row), np.uint64)
        for k in range(width):
            hashes = np.where(k < size, _mix(hashes * STEP + words[first + k] + np.uint64(k + 1)), hashes)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.append(0, np.cumsum(np.bincount(row[new], minlength=len(of))))


def sketches(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A row of COORDINATES values for each set; empty sets have none of meaning."""
    t = COORDINATES
    sizes = np.diff(rows)
    empty = np.uint64((1 << 64) - 1)
    out = np.full(len(sizes) * t, empty)
    open_ = np.flatnonzero(sizes)
    row, x = np.repeat(np.arange(len(sizes)), sizes), hashes
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            mixed = _mix(x + np.uint64(i + 1) * STEP)
            value = (mixed & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32)
            at = ((mixed >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
            np.minimum.at(out, row * t + at, value)
            left = (out.reshape(-1, t)[open_] == empty).any(axis=1)
            if not left.all():
                open_ = open_[left]
                if not len(open_):
                    break
                stay = np.zeros(len(sizes), bool)
                stay[open_] = True
                stay = stay[row]
                row, x = row[stay], x[stay]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """BANDS keys of each sketch."""
    parts = sketch.reshape(-1, BANDS, WIDTH)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    with np.errstate(over="ignore"):
        for j in range(WIDTH):
            key = _mix(key * STEP + parts[:, :, j])
    return key.view(np.int64)


def nibbles(sketch: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen to a word."""
    four = (_mix(sketch) & np.uint64(15)).reshape(-1, LONGS, 16)
    return (four << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def bitmaps(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A bit for each shingle of a set; several may share one."""
    bits = np.zeros((len(rows) - 1, 64 * BITMAP), bool)
    bits[np.repeat(np.arange(len(rows) - 1), np.diff(rows)), (hashes >> np.uint64(20)).astype(np.int64) % (64 * BITMAP)] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class Light:
    """What is known of sets without their shingles: sizes, and for each a blob of key marks, nibbles and bitmap."""

    TYPE = np.dtype([("marks", np.uint32, BANDS), ("nibbles", np.uint64, LONGS), ("bitmap", np.uint64, BITMAP)])

    def __init__(self, sizes: np.ndarray, blobs: list[bytes]):
        self.sizes, self.blobs = sizes, np.frombuffer(b"".join(blobs), self.TYPE)

    def near(self, i: np.ndarray, other: Light, j: np.ndarray, percent: int) -> np.ndarray:
        """Of pairs (i of this, j of other), whether sizes, sketches and bitmaps allow the similarity."""
        n, m = self.sizes[i], other.sizes[j]
        x = self.blobs["nibbles"][i] ^ other.blobs["nibbles"][j]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        agree = COORDINATES - np.bitwise_count(x & NIBBLES).sum(axis=1, dtype=np.int64)
        # a bit that only one set has stands for a shingle that only it has
        a, b = self.blobs["bitmap"][i], other.blobs["bitmap"][j]
        shared = np.minimum(n - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), m - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
        return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (agree >= least_agreement(percent / 100)) & (100 * shared >= percent * (n + m - shared))


def _pieces(batches):
    for whole in batches:
        yield from slices(whole)


def _sketched(batches, width, others):
    for batch in _pieces(batches):
        hashes, rows = shingle_sets(batch.column("text"), width)
        sketch = sketches(hashes, rows)
        data = memoryview(hashes.astype("<u8").tobytes())
        digest = [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in itertools.pairwise(rows.tolist())]
        both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        keys = band_keys(sketch)
        light = np.zeros(len(sketch), Light.TYPE)
        light["marks"], light["nibbles"], light["bitmap"] = keys.astype(np.uint32), nibbles(sketch), bitmaps(hashes, rows)
        arrays = [*(batch.column(c) for c in others), pa.array(np.diff(rows)), pa.array(both[:, 0]), pa.array(both[:, 1])]
        arrays += [pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())), pa.array([x.tobytes() for x in light], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*others, "n", "a", "b", "keys", "light"])


def _sets(batches, width):
    for batch in _pieces(batches):
        hashes, rows = shingle_sets(batch.column("text"), width)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(hashes.view(np.int64)))], names=["id", "set"])


def _near(batches, percent):
    """Of pairs with both sides' sizes and blobs, those that are near."""
    for batch in batches:
        one, two = (Light(batch.column(f"{x}n").to_numpy(), batch.column(f"{x}light").to_pylist()) for x in "ab")
        every = np.arange(batch.num_rows)
        good = np.flatnonzero(one.near(every, two, every, percent))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good)) for c in ("u", "v")], names=["u", "v"])


def _compared(batches, percent):
    """Near pairs of each (key, block): its members come first, then the leads that are to be compared with them."""
    of, held, ready = None, [], None
    for batch in batches:
        keys, blocks, leads = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "lead"))
        edge = np.flatnonzero((np.diff(keys) != 0) | (np.diff(blocks) != 0) | (np.diff(leads.astype(np.int8)) != 0)) + 1
        for a, b in zip(np.append(0, edge).tolist(), np.append(edge, len(keys)).tolist()):
            if a == b:
                continue
            piece = batch.slice(a, b - a)
            if of != (keys[a], blocks[a]):
                of, held, ready = (keys[a], blocks[a]), [], None
            if not leads[a]:
                held.append(piece)
                continue
            if ready is None and held:
                ready = _Members(held)
                held = []
            if ready is not None:
                for at in range(0, piece.num_rows, 256):
                    yield ready.pairs(_Members([piece.slice(at, 256)]), percent)


class _Members:
    def __init__(self, pieces: list):
        whole = pa.Table.from_batches(pieces)
        self.id, self.root, self.main, self.band = (whole[c].to_numpy() for c in ("id", "root", "main", "band"))
        self.leads = whole["leads"].to_numpy()
        self.light = Light(whole["n"].to_numpy(), whole["light"].to_pylist())

    def pairs(self, leads: _Members, percent: int) -> pa.RecordBatch:
        n, m = self.light.sizes[:, None], leads.light.sizes[None, :]
        alive = (self.root[:, None] != leads.root[None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        # two leads meet once
        alive &= ~self.leads[:, None] | (self.id[:, None] < leads.id[None, :])
        # a pair belongs to the first band that it shares a key of
        for k in range(int(self.band[0])):
            alive &= self.light.blobs["marks"][:, k][:, None] != leads.light.blobs["marks"][:, k][None, :]
        i, j = np.nonzero(alive)
        good = self.light.near(i, leads.light, j, percent)
        u, v = self.id[i[good]], leads.id[j[good]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


class Linker:
    """Candidates and links among sets; marks: id, n, light; sets: id, set."""

    def __init__(self, marks: DataFrame, sets: DataFrame, percent: int, scratch: Scratch):
        self.marks, self.sets, self.percent, self.scratch = marks.select("id", "n", "light"), sets, percent, scratch

    def near(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent
        both = pairs
        for end, side in (("u", "a"), ("v", "b")):
            both = both.join(self.marks.select(F.col("id").alias(end), F.col("n").alias(f"{side}n"), F.col("light").alias(f"{side}light")), end)
        return both.mapInArrow(lambda b: _near(b, percent), "u long, v long")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of distinct pairs (u, v), those whose sets are as similar as asked for."""
        pairs = self.scratch.keep(pairs, f"near-{name}")
        one, two = self.sets.select(F.col("id").alias("u"), F.col("set").alias("x")), self.sets.select(F.col("id").alias("v"), F.col("set").alias("y"))
        shared = F.size(F.array_intersect("x", "y"))
        total = F.size("x") + F.size("y") - F.col("both")
        found = pairs.join(one, "u").join(two, "v").withColumn("both", shared).where(100 * F.col("both") >= self.percent * total)
        links = self.scratch.keep(found.select("u", "v"), f"links-{name}")
        self.scratch.drop(f"near-{name}")
        return links

    def links(self, met: DataFrame) -> DataFrame:
        """Edges (u, v) that connect the same sets as all similar pairs that share a key; met: key, band, id, size (members of the key)."""
        degree = met.groupBy(F.col("id").alias("own")).agg(F.sum("size").alias("degree"))
        centre = met.join(degree, met.id == degree.own).groupBy("key").agg(F.max(F.struct("degree", "id")).alias("m")).select("key", F.col("m.id").alias("centre"))
        pairs = met.join(centre, "key").where("id <> centre").select(F.least("id", "centre").alias("u"), F.greatest("id", "centre").alias("v")).distinct()
        edges = self.verified(self.near(pairs), "centre")
        left, k, percent = met.select("key", "band", "id"), 0, self.percent
        while True:
            roots = components(edges, self.scratch.inner(f"round-{k}"))
            now = left.join(roots, left.id == roots.node, "left").select("key", "band", "id", F.coalesce("root", "id").alias("root"))
            # members of a key that are in different components are all that can connect more
            classes = now.groupBy("key", "root").agg(F.count("*").alias("c"))
            of = classes.groupBy(F.col("key").alias("own")).agg(F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("m"))
            of = of.where(F.col("size") > F.col("m.c")).select("own", "size", F.col("m.root").alias("main"), (F.col("size") - F.col("m.c")).alias("others"))
            now = self.scratch.keep(now.join(of, now.key == of.own).drop("own"), f"open-{k}")
            if now.isEmpty():
                return edges
            most = LEADS * FACTOR**k
            draw = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53)) * F.col("others")
            now = now.withColumn("leads", (F.col("root") != F.col("main")) & ((F.col("others") <= most) | (draw < most)))
            whole = now.join(self.marks, "id").withColumn("blocks", F.ceil(F.col("size") / BLOCK))
            columns = ["key", "band", "id", "root", "main", "leads", "n", "light"]
            members = whole.select(*columns, F.lit(False).alias("lead"), F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
            leads = whole.where("leads").select(*columns, F.lit(True).alias("lead"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
            dealt = members.unionByName(leads).repartition(F.col("key"), F.col("block")).sortWithinPartitions("key", "block", "lead")
            more = self.verified(dealt.mapInArrow(lambda b: _compared(b, percent), "u long, v long").distinct(), f"round-{k}")
            # the stars of the components stand for the links so far
            edges = roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)
            left = self.scratch.keep(now.where(F.col("others") > most).select("key", "band", "id"), f"left-{k}")
            self.scratch.drop(f"open-{k}")
            k += 1
            if left.isEmpty():
                return edges


def near_duplicates(spark: SparkSession, docs: DataFrame, *, width: int = 2, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id is component_id).

    Documents link whose sets of ``width``-word shingles have ``percent`` of their union in common.
    """
    ship(spark)
    scratch = Scratch(spark, "minhash", like=docs)
    texts = docs.select("doc_id", "text").withColumn("version", F.xxhash64("text"))
    kind = ddl(texts, "doc_id", "version") + ", n long, a long, b long, keys array<long>, light binary"
    rows = scratch.keep(texts.mapInArrow(lambda b: _sketched(b, width, ["doc_id", "version"]), kind), "rows")
    # equal sets are one; the numbers hold once they are written
    one = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version")
    classes = rows.where("n > 0").groupBy("a", "b").agg(F.min("n").alias("n"), F.min(one).alias("one"), F.min("keys").alias("keys"), F.min("light").alias("light"))
    marks = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), "marks")
    keys = marks.select(F.posexplode("keys").alias("band", "key"), "id")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = scratch.keep(keys.join(shared, "key"), "met")
    # the shingles of sets that share a key, from one text of each; a null doc_id and 0 may stand for each other, as the text is the same
    wanted = marks.join(met.select("id").distinct(), "id").select("id", F.coalesce("one.doc_id", F.lit(0)).alias("own"), F.col("one.version").alias("version"))
    once = texts.groupBy(F.coalesce("doc_id", F.lit(0)).alias("own"), "version").agg(F.min("text").alias("text"))
    sets = scratch.keep(once.join(wanted, ["own", "version"]).select("id", "text").mapInArrow(lambda b: _sets(b, width), "id long, set array<long>"), "sets")
    edges = Linker(marks, sets, percent, scratch).links(met)
    roots = components(edges, scratch)
    placed = marks.join(roots, marks.id == roots.node, "left").select("a", "b", F.col("one.doc_id").alias("first"), F.coalesce("root", "id").alias("root"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = scratch.keep(placed.join(names, "root").select(F.col("a").alias("own"), F.col("b").alias("which"), "component_id"), "placed")
    out = rows.join(placed, (rows.a == placed.own) & (rows.b == placed.which) & (rows.n > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


#: Joins the shingles with themselves; at 0.001 to 0.01 this takes DuckDB seconds.
SQL = """
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select r, unnest(case when len(w) < 2 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end) as s from d),
n as (select r, count(*) as n from s group by r),
p as (select a.r as u, b.r as v, count(*) as c from s a join s b on a.s = b.s and a.r < b.r group by a.r, b.r),
e as (select u, v from p join n a on a.r = u join n b on b.r = v where 100 * c >= 80 * (a.n + b.n - c)),
ways as (select u, v from e union all select v, u from e),
reach as (select r, r as t from d union select reach.r, ways.v from reach join ways on reach.t = ways.u),
c as (select reach.r, min(d.doc_id) as component_id from reach join d on d.r = reach.t group by reach.r)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id is not distinct from c.component_id as kept
from d join c using (r) left join n using (r)
"""
