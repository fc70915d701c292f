"""Exact top-k by inner product over KD-trees, one per shard.

Shards are dealt by a hash of the row, so a common vector spreads over all of them. A shard's tree
splits the dimension of widest spread at the median, down to LEAF rows, and every node keeps the
tight box of its rows and its smallest vec_id. A query visits nodes best first by the box bound
(sum over dimensions of the larger of q * low and q * high); a node is left out when its bound is below the
query's kth score, or equal to it with no smaller vec_id. A shard's tree goes to the task that holds its shard, once, and queries
come to it in blocks. Each block first searches one shard; its kth scores go along to all other shards whose root box,
against the block's own box, can reach the least of them,
so most of their nodes are never opened. All arithmetic is on whole numbers, exact in
doubles, otherwise in 64-bit integers, otherwise in Python's; which, is decided once for all rows, and a score beyond 63 bits is an error.

Rows with a null vec_id or vector, or null, NaN or infinite components, take no part. Only vectors of equal length are
compared, however long. Other columns are not read. Repeated rows are candidates each; a row with the query's own vec_id isn't one. A query
that occurs twice has its rows twice. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship

SHARD_ROWS = 16_384
BLOCK_QUERIES = 1_024
LEAF = 256


class Tree:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high, self.least, self.left, self.span = [], [], [], [], []
        place = np.arange(len(ids))
        self._build(place)
        self.order = place
        self.ids, self.rows = self.ids[place], self.rows[place]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, place: np.ndarray) -> None:
        """Nodes in depth-first order; ``place`` (a view) is put in the order of the leaves."""
        stack = [(0, len(place), -1)]
        while stack:
            a, b, parent = stack.pop()
            node = len(self.low)
            own = self.rows[place[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.least.append(int(self.ids[place[a:b]].min()))
            self.span.append((a, b))
            self.left.append(None)
            if parent >= 0:
                self.left[parent] = (self.left[parent] or ()) + (node,)
            spread = high - low
            axis = int(np.argmax(spread)) if len(spread) else 0
            if b - a > LEAF and len(spread) and spread[axis] > 0:
                half = (b - a) // 2
                place[a:b] = place[a:b][np.argpartition(own[:, axis], half)]
                stack += [(a, a + half, node), (a + half, b, node)]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of each query (rows) for each node (columns)."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query its best (score, vec_id), best first; ``floor``: scores known to be reached k times elsewhere."""
    out = []
    for at in range(0, len(ids), 256):
        bounds = tree.bounds(queries[at : at + 256])
        for own, q, bound, least in zip(ids[at : at + 256].tolist(), queries[at : at + 256], bounds, floor[at : at + 256].tolist()):
            best: list[tuple[int, int]] = []  # heap of (score, -vec_id): its top is the worst kept
            heap = [(-bound[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                if -top < least or len(best) == k and (-top < best[0][0] or -top == best[0][0] and tree.least[node] > -best[0][1]):
                    if -top < least or -top < best[0][0]:
                        break
                    continue
                if tree.left[node]:
                    for child in tree.left[node]:
                        heapq.heappush(heap, (-bound[child], child))
                    continue
                a, b = tree.span[node]
                scores = tree.rows[a:b] @ q
                want = best[0][0] if len(best) == k else least
                hit = np.flatnonzero((scores >= want) & (tree.ids[a:b] != own)) if want > -np.inf else np.flatnonzero(tree.ids[a:b] != own)
                if len(hit) > 8 * k:  # only the best and, of equals, the smallest ids can count
                    cut = np.partition(scores[hit], len(hit) - k)[len(hit) - k]
                    above = hit[scores[hit] > cut]
                    equal = hit[scores[hit] == cut]
                    equal = equal[np.argsort(tree.ids[a:b][equal], kind="stable")[:k]]
                    hit = np.concatenate([above, equal])
                for s, i in zip(scores[hit].tolist(), tree.ids[a:b][hit].tolist()):
                    item = (s, -i)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            out.append([(s, -i) for s, i in sorted(best, reverse=True)])
    return out


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Lists of doubles of one length as whole numbers; kind: what holds them exactly."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.floor(256.0 * values).reshape(len(column), -1)
    if kind == "O":
        return np.array([[int(x) for x in r] for r in rows], dtype=object).reshape(rows.shape)
    return rows.astype(kind)


def _by_key(batches, names):
    """Whole groups of rows that come sorted by the first of ``names``."""
    held, now = [], None
    for batch in batches:
        keys = batch.column(names[0]).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(keys)).tolist()):
            if a == b:
                continue
            if now is not None and keys[a] != now:
                yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _trees(batches, kind):
    for key, rows in _by_key(batches, ["shard"]):
        tree = Tree(rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), kind))
        dims = len(rows.column("v")[0])
        yield pa.RecordBatch.from_pydict({"shard": [int(key)], "dims": [dims], "data": [pickle.dumps(tree)], "low": [tree.low[0].astype(float)], "high": [tree.high[0].astype(float)]}, BOXES("shard"))


def _blocks(batches, kind):
    for key, rows in _by_key(batches, ["block"]):
        ids, v = rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), kind)
        yield pa.RecordBatch.from_pydict({"block": [int(key)], "dims": [v.shape[1]], "data": [pickle.dumps((ids, v))], "low": [v.min(axis=0).astype(float)], "high": [v.max(axis=0).astype(float)]}, BOXES("block"))


def BOXES(name: str) -> pa.Schema:
    return pa.schema([(name, pa.int64()), ("dims", pa.int32()), ("data", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])


def _search(batches, k):
    """Rows come with each shard's tree (no block) before the blocks that are to search it."""
    tree, of = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] is None:
                tree, of = pickle.loads(row["data"]), (row["shard"], row["copy"])
                continue
            if of != (row["shard"], row["copy"]):
                raise ValueError("a block came without its shard's tree")
            ids, queries = pickle.loads(row["data"])
            floor = np.full(len(ids), -np.inf)
            for at, low in zip(row["places"] or [], row["floors"] or []):
                floor[at] = low
            found = search(tree, ids, queries, floor, k)
            flat = [(row["block"], at, int(q), v, int(s)) for at, (q, best) in enumerate(zip(ids.tolist(), found)) for s, v in best]
            names = ("block", "at", "query_id", "vec_id", "score")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat) if flat else [[]] * 5, kinds)], names=names)


def top_k(spark: SparkSession, vectors: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose vec_id is divisible by ``every``.

    Work is queries times shards, which the question asks for; what travels are the trees, each once for every
    copy of its shard (copies only where shards are fewer than tasks), and a block of BLOCK_QUERIES queries for each shard
    that its boxes don't rule out, with k results for each query and shard opened.
    """
    ship(spark)
    scratch = Scratch(spark, "topk", like=vectors)
    v = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(v).alias("dims"), v.alias("v"))
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top"))
    n, q, top, dims = sizes.agg(F.sum("n"), F.sum("q"), F.max("top"), F.max("dims")).first()
    reach = (256 * float(top or 0) + 1) ** 2 * max(1, dims or 1)
    kind = "f8" if reach < 2**53 else "i8" if reach < 2**63 else "O"
    shards = max(1, -(-(n or 0) // SHARD_ROWS))
    blocks = max(1, -(-(q or 0) // BLOCK_QUERIES))
    copies = min(blocks, max(1, 2 * spark.sparkContext.defaultParallelism // shards))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(n))
    # one shard, and one block, for each length of vectors
    shard = rows.withColumn("shard", F.col("dims").cast("long") * (1 << 32) + deal(shards, 1))
    block = rows.where(F.col("vec_id") % every == 0).withColumn("block", F.col("dims").cast("long") * (1 << 32) + deal(blocks, 2))
    boxed = ", dims int, data binary, low array<double>, high array<double>"
    trees = scratch.keep(shard.repartition(F.col("shard")).sortWithinPartitions("shard").select("shard", "vec_id", "v").mapInArrow(lambda b: _trees(b, kind), "shard long" + boxed), "trees")
    queries = scratch.keep(block.repartition(F.col("block")).sortWithinPartitions("block", "vec_id").select("block", "vec_id", "v").mapInArrow(lambda b: _blocks(b, kind), "block long" + boxed), "blocks")
    own = queries.select("block", F.col("dims").alias("_dims"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    best = F.zip_with(F.zip_with("_low", "low", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.zip_with("_high", "high", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x, y: F.greatest(x["a"] * x["b"], x["a"] * y["b"], y["a"] * x["b"], y["a"] * y["b"]))
    bound = F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x)
    pairs = scratch.keep(own.join(trees, F.col("_dims") == F.col("dims")).select("block", "shard", bound.alias("bound")), "pairs")
    found = "block long, at int, query_id long, vec_id long, score long"

    def look(pairs: DataFrame) -> DataFrame:
        """Search the pairs (block, shard, places, floors)."""
        copy = F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int").alias("copy")
        asked = pairs.join(queries.select("block", "data"), "block").select("shard", copy, "block", "data", "places", "floors")
        wanted = asked.select("shard", "copy").distinct().join(trees.select("shard", "data"), "shard")
        held = wanted.select("shard", "copy", F.lit(None).cast("long").alias("block"), "data", F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<double>").alias("floors"))
        together = held.unionByName(asked).repartition(F.col("shard"), F.col("copy")).sortWithinPartitions("shard", "copy", F.col("block").asc_nulls_first())
        return together.mapInArrow(lambda b: _search(b, k), found)

    none = [F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<double>").alias("floors")]
    pilot = pairs.groupBy("block").agg(F.min(F.struct(F.pmod(F.xxhash64("block", "shard"), F.lit(1 << 30)), "shard")).alias("m")).select("block", F.col("m.shard").alias("shard"))
    first = scratch.keep(look(pilot.select("block", "shard", *none)), "first")
    kth = first.groupBy("block", "at").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low")).where(F.col("n") >= k)
    floors = kth.groupBy("block").agg(F.collect_list("at").alias("places"), F.collect_list("low").alias("floors"), F.min("low").alias("least"), F.count("*").alias("known"))
    sizes_ = block.groupBy("block").agg(F.count("*").alias("size"))
    rest = pairs.join(pilot, ["block", "shard"], "left_anti").join(floors.join(sizes_, "block"), "block", "left")
    # a block whose queries all know a kth score leaves out the shards whose box is below the least of them
    rest = rest.where(F.col("known").isNull() | (F.col("known") < F.col("size")) | (F.col("bound") * (1 + 1e-9) + 1 >= F.col("least")))
    second = look(rest.select("block", "shard", "places", "floors"))
    every_hit = first.unionByName(second)
    best = every_hit.groupBy("block", "at", "query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


SQL = """
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from e q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
