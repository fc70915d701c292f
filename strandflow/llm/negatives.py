"""Hard negatives by bit-sliced integer products.

Components are whole numbers in two's complement, kept as bit-planes: a plane has one bit of every component, so a shard
is BITS planes of 0/1 rows. A score is the weighted sum of the planes' products with the query, and planes are taken from
the most significant on. With ``b`` planes to go, a score lies between what it is so far minus (2^b - 1) times the
query's negative mass and that plus (2^b - 1) times its positive mass. A candidate is dropped for a query once that interval
has nothing in common with what still counts: from the kth score known by then (of this shard's rows so far, or of a pilot shard) up
to the query's highest score allowed. Rows that no query of the block wants go first; when few pairs
are left, they are followed one by one through the remaining planes.

Two scans of this kind answer the question. The first finds each anchor's positives (its best rows of the same label); the second
has a range of scores for each positive, from ``share`` percent of its score up to the score itself, and finds the best rows of another label
in it. Shards are dealt by a hash of the row, not by label, so neither a hot label nor a common vector fills one task; anchors
come to a shard in blocks, after every block searched a pilot shard. What travels are a shard, once for every copy
of it, and an anchor block for each shard; results are k rows for each range of scores and shard.

Rows with a null vec_id, label or vector, or with null, NaN or infinite components, take no part. Only vectors of equal length are
compared; empty ones have score 0. A row is its own: repeated rows are anchors, positives and negatives each, but rows with the anchor's vec_id
are neither its positives nor its negatives. Ties go to the smaller vec_id. A positive of negative score has no range and so no negatives; one of
score 0 those of score 0. Columns of other names are not read. Scores beyond 63 bits are an error. Empty tables give empty results.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ship
from .topk import _by_key

SHARD_ROWS = 16_384
BLOCK_ROWS = 256
#: Rows of a shard that are scanned first; each further piece is twice as long, up to PIECE.
FIRST, PIECE = 256, 8_192
#: Share of pairs left from which they are followed one by one.
SPARSE = 0.04
SHARDS = "shard long, dims int, data binary"
BLOCKS = "block long, data binary"
FOUND = "block long, at int, no int, vec_id long, score long"
#: Lowest and highest score of a range without an end. Fixed values.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def planes_of(rows: np.ndarray, bits: int) -> np.ndarray:
    """Bit-planes of whole numbers in two's complement, most significant first, eight components to a byte."""
    planes = [((rows >> b) & 1).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.stack(planes), axis=-1)


def _whole(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(256.0 * values).astype(np.int64).reshape(len(column), -1)


def _shards(batches, bits):
    for key, rows in _by_key(batches, ["shard"]):
        whole = _whole(rows.column("v"))
        data = (rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), planes_of(whole, bits))
        yield pa.RecordBatch.from_pydict({"shard": [int(key)], "dims": pa.array([whole.shape[1]], pa.int32()), "data": [pickle.dumps(data)]})


def _blocks(batches):
    for key, rows in _by_key(batches, ["block"]):
        data = (rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _whole(rows.column("v")))
        yield pa.RecordBatch.from_pydict({"block": [int(key)], "data": [pickle.dumps(data)]})


class Shard:
    """A shard's planes as 0/1 numbers of the kind that holds all scores exactly."""

    def __init__(self, data: bytes, dims: int, kind: str):
        self.ids, self.labels, packed = pickle.loads(data)
        self.planes = np.unpackbits(packed, axis=-1, count=dims)
        self.kind = kind
        bits = len(self.planes)
        self.weights = [-(1 << bits - 1), *(1 << b for b in range(bits - 2, -1, -1))]

    def plane(self, p: int, rows: np.ndarray) -> np.ndarray:
        return self.planes[p][rows].astype(self.kind)


def best_in_ranges(shard: Shard, own: np.ndarray, labels: np.ndarray, queries: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
    """Range number, vec_id and score of each range's k best rows.

    ``of``: the query of each range; low, high: its scores allowed, both included; same: whether rows have the query's label or another one.
    """
    count, kind = len(queries), shard.kind
    q = queries.astype(kind)
    plus, minus = np.maximum(q, 0).sum(axis=1), -np.minimum(q, 0).sum(axis=1)
    floor = low.copy()
    top = np.full(count, LEAST)
    np.maximum.at(top, of, high)
    order = np.argsort(of, kind="stable")
    begins = np.searchsorted(of[order], np.arange(count + 1))
    got = (np.zeros(0, np.int64),) * 3
    start, size = 0, FIRST
    while start < len(shard.ids):
        rows = np.arange(start, min(start + size, len(shard.ids)))
        start, size = start + size, min(2 * size, PIECE)
        least = np.full(count, MOST)
        np.minimum.at(least, of, floor)
        alive = (shard.labels[rows][:, None] == labels[None, :]) == same
        alive &= shard.ids[rows][:, None] != own[None, :]
        score = np.zeros((len(rows), count), kind)
        p, left = 0, len(shard.weights)
        while left and alive.any():
            rows_left = alive.any(axis=1)
            if rows_left.mean() < 0.9:
                rows, alive, score = rows[rows_left], alive[rows_left], score[rows_left]
            if alive.mean() < SPARSE:
                break
            score += shard.plane(p, rows) @ q.T * kind_of(shard.weights[p], kind)
            p, left = p + 1, left - 1
            open_ = kind_of((1 << left) - 1, kind)
            alive &= (score + open_ * plus >= least) & (score - open_ * minus <= top)
        i, j = np.nonzero(alive)
        i, s = rows[i], score[alive]
        while left and len(i):
            s = s + np.einsum("ij,ij->i", shard.plane(p, i), q[j]) * kind_of(shard.weights[p], kind)
            p, left = p + 1, left - 1
            open_ = kind_of((1 << left) - 1, kind)
            stay = (s + open_ * plus[j] >= least[j]) & (s - open_ * minus[j] <= top[j])
            i, j, s = i[stay], j[stay], s[stay]
        # every pair, once for each range of its query
        many = begins[j + 1] - begins[j]
        pair = np.repeat(np.arange(len(j)), many)
        w = order[np.repeat(begins[j], many) + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)]
        score_ = s[pair].astype(np.int64)
        fits = (score_ >= floor[w]) & (score_ <= high[w])
        w, score_, ids = w[fits], score_[fits], shard.ids[i[pair[fits]]]
        w, ids, score_ = (np.concatenate(x) for x in zip(got, (w, ids, score_)))
        place = np.lexsort((ids, -score_, w))
        w, ids, score_ = w[place], ids[place], score_[place]
        edge = np.flatnonzero(np.diff(w, prepend=-1))
        rank = np.arange(len(w)) - np.repeat(edge, np.diff(np.append(edge, len(w))))
        kth = rank == k - 1
        floor[w[kth]] = np.maximum(floor[w[kth]], score_[kth])
        got = tuple(x[rank < k] for x in (w, ids, score_))
    return got


def kind_of(value: int, kind: str):
    return np.dtype(kind).type(value)


def _search(batches, kind, same, k):
    """Rows come with each shard's data (no block) before the blocks that are to search it."""
    shard, of = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] is None:
                shard, of = Shard(row["data"], row["dims"], kind), (row["shard"], row["copy"])
                continue
            if of != (row["shard"], row["copy"]):
                raise ValueError("a block came without its shard")
            own, labels, queries = pickle.loads(row["data"])
            at, no, low, high = (np.array(row[c], np.int64) for c in ("at", "no", "low", "high"))
            w, ids, score = best_in_ranges(shard, own, labels, queries, at, low, high, same, k)
            arrays = [pa.array(np.full(len(w), row["block"])), pa.array(at[w].astype(np.int32)), pa.array(no[w].astype(np.int32)), pa.array(ids), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "at", "no", "vec_id", "score"])


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each range; of one shard's results k at most are left before the exchange."""
    of = Window.partitionBy("block", "at", "no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= k)


def hard_negatives(spark: SparkSession, vectors: DataFrame, *, every: int = 100, moved: int = 7, classes: int = 10, positives: int = 5, k: int = 5, share: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``; where it is divisible by ``moved``, label first becomes
    (label + 1) % ``classes``. ``share``: lowest negative score in percent of the positive's.
    """
    ship(spark)
    scratch = Scratch(spark, "negatives", like=vectors)
    v = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % moved == 0, (label + 1) % classes).otherwise(label)
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.size(v).alias("dims"), v.alias("v"))
    asked = F.col("vec_id") % every == 0
    n, q, top, dims = rows.agg(F.count("*"), F.count_if(asked), F.max(F.array_max(F.transform("v", lambda x: F.abs(F.floor(256 * x))))), F.max("dims")).first()
    bits = int(top or 0).bit_length() + 1
    reach = (1 << bits) * int(top or 0) * max(1, dims or 1)
    if reach >= 1 << 63:
        raise ValueError("scores of these vectors may pass 63 bits")
    kind = "f4" if reach < 1 << 24 else "f8" if reach < 1 << 53 else "i8"
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-q // BLOCK_ROWS))
    copies = min(blocks, max(1, 2 * spark.sparkContext.defaultParallelism // shards))

    def dealt(n: int, salt: int) -> Column:
        """Numbers of their own for each length of vectors."""
        return F.col("dims").cast("long") * (1 << 32) + F.pmod(F.xxhash64("vec_id", "label", "v", F.lit(salt)), F.lit(n))

    cut = rows.withColumn("shard", dealt(shards, 1)).repartition(F.col("shard")).sortWithinPartitions("shard", "vec_id")
    data = scratch.keep(cut.select("shard", "vec_id", "label", "v").mapInArrow(lambda b: _shards(b, bits), SHARDS), "shards")
    anchors = scratch.keep(rows.where(asked).withColumn("block", dealt(blocks, 2)).select("block", "vec_id", "label", "v"), "anchors")
    cut = anchors.repartition(F.col("block")).sortWithinPartitions("block", "vec_id")
    queries = scratch.keep(cut.mapInArrow(_blocks, BLOCKS), "blocks")
    # each row of shards names the blocks of its length of vectors; those without anchors drop out below
    pairs = data.select("shard", F.explode(F.sequence(F.col("dims").cast("long") * (1 << 32), F.col("dims").cast("long") * (1 << 32) + (blocks - 1))).alias("block"))

    def look(pairs: DataFrame, ranges: DataFrame, same: bool) -> DataFrame:
        """Search the shards of pairs (shard, block) for ranges (block, at, no, low, high)."""
        lists = ranges.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "no", "low", "high"))).alias("r"))
        copy = F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int").alias("copy")
        sent = pairs.join(queries, "block").join(lists, "block").select("shard", copy, "block", F.lit(None).cast("int").alias("dims"), "data", *[F.col(f"r.{c}").alias(c) for c in ("at", "no", "low", "high")])
        held = sent.select("shard", "copy").distinct().join(data, "shard").select("shard", "copy", F.lit(None).cast("long").alias("block"), "dims", "data", *[F.lit(None).cast(sent.schema[c].dataType).alias(c) for c in ("at", "no", "low", "high")])
        together = held.unionByName(sent).repartition(F.col("shard"), F.col("copy")).sortWithinPartitions("shard", "copy", F.col("block").asc_nulls_first())
        return together.mapInArrow(lambda b: _search(b, kind, same, k if not same else positives), FOUND)

    def best(ranges: DataFrame, same: bool, name: str) -> DataFrame:
        """block, at, no, rank, vec_id, score: first from a pilot shard of each block, whose kth scores go along to all others."""
        most = positives if same else k
        pilot = pairs.groupBy("block").agg(F.min(F.struct(F.xxhash64("block", "shard"), "shard")).alias("m")).select("block", F.col("m.shard").alias("shard"))
        one = scratch.keep(look(pilot, ranges, same), f"{name}-pilot")
        kth = one.groupBy("block", "at", "no").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= most).drop("n")
        higher = ranges.join(kth, ["block", "at", "no"], "left").withColumn("low", F.greatest("low", F.coalesce("kth", "low"))).drop("kth")
        rest = look(pairs.join(pilot, ["block", "shard"], "left_anti"), higher, same)
        return scratch.keep(_first(one.unionByName(rest), most).select("block", "at", "no", "rank", "vec_id", "score"), name)

    # anchors are told apart by their place in the block, which is the order of its rows
    numbered = queries.mapInArrow(_places, "block long, at int, vec_id long")
    places = scratch.keep(numbered, "places")
    whole = places.select("block", "at", F.lit(0).alias("no"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    near = best(whole, True, "positives").select("block", "at", F.col("rank").alias("no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # whole scores from share percent on: the ceiling of share * score / 100
    ps = F.col("positive_score").cast("decimal(38,0)")
    ranges = near.where(F.col("positive_score") >= 0).select("block", "at", "no", F.ceil(ps * share / 100).cast("long").alias("low"), F.col("positive_score").alias("high"))
    hard = best(ranges, False, "negatives").select("block", "at", "no", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = hard.join(near, ["block", "at", "no"]).join(places.withColumnRenamed("vec_id", "anchor_id"), ["block", "at"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _places(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = pickle.loads(row["data"])[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["block", "at", "vec_id"])


SQL = """
with e as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r as a, a.vec_id as anchor_id, c.r as c, c.vec_id, a.label = c.label as same,
    coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0)::bigint as score
  from e a join e c on a.vec_id <> c.vec_id and len(a.v) = len(c.v) where a.vec_id % 100 = 0),
p as (select *, row_number() over (partition by a order by score desc, vec_id, c) as no from s where same),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.a, p.no order by s.score desc, s.vec_id, s.c) as rank
  from p join s on p.a = s.a and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score where p.no <= 5)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
