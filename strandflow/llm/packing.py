"""Mixture-controlled packing of whole documents into fixed token windows.

Deficit round-robin: in each window every source queue gains credit of its share of the window;
it is served the whole tokens of its credit, the spare places go to the largest remaining credits,
and what is left of each credit (its deficit, under one token) is carried to the next window.
Because credit and service are exact integers, the state before any window has a closed form:
queue v has been served ``floor(weight_v * tokens / WEIGHTS)`` tokens, plus one for the largest
remainders. So the carried deficits are known at every window without running those before it, and
each task packs its own documents: a document's place follows from its queue position alone and
texts are not shuffled. A few phases with fewer queues follow where a queue runs dry.

Every source named in ``targets`` has its own queue (of more than NAMED, those with the largest targets). Without targets, sources with a
small share of the text are too many for a queue each. They share a queue, as do the named ones beyond NAMED; a shared queue serves its sources in turn by whole documents: next is the document whose source
would be least ahead of its share after it (its end within its source over the source's weight). So at every point
a source has had its share of its queue's tokens to within a document, however many sources there are. Only
these sources' ids are shuffled, once, to take their place in the order.

Null or repeated rows: a null text is an empty document (its end id only); a null source is a
source of its own; repeated rows are packed each. A very long text is one document of many windows. Columns of other names are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, ddl, read_tokenizer, ship, slices
from .wordbpe import codec

WINDOW = 2048
#: Queue weights are whole parts of this; with at most 2^44 tokens all products fit 63 bits.
WEIGHTS = 1 << 16
#: Sources with a smaller share of the text share two queues, so there are at most 66 queues without targets.
MIN_SHARE = 1 / 64
#: At most so many sources with a target have a queue each.
NAMED = 256
#: At most so many scan tasks, so that the table of queue starts has a fixed bound (258 queues x 8 bytes each).
MAX_PARTS = 16_384


def apportion(weights: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Tokens served to each queue (columns) after so many tokens in all (rows)."""
    total = int(weights.sum())
    product = tokens[:, None].astype(np.int64) * weights[None, :]
    base, rest = product // total, product % total
    spare = tokens - base.sum(axis=1)
    order = np.argsort(-rest, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(weights))[None, :], axis=1)
    return base + (place < spare[:, None])


def whole_weights(shares: list[int], window: int) -> np.ndarray:
    """Shares as whole parts of WEIGHTS; none so small that rounding could take a token back."""
    least, total = WEIGHTS // window, max(1, sum(shares))
    return np.array([max(least, s * WEIGHTS // total) if s > 0 else 0 for s in shares], np.int64)


def schedule(sizes: list[int], shares: list[int], window: int) -> list[dict]:
    """Phases: from which window on, where each queue stands then, and by which weights it is served."""
    at, left, first, phases = [0] * len(sizes), list(sizes), 0, []
    weights = whole_weights(shares, window)
    while any(left):
        # queues without a share wait until the others are dry, then all go by what is left
        w = np.where(np.array(left) > 0, weights, 0)
        if not w.any():
            w = whole_weights(left, window)
        total = int(w.sum())
        count = min(r * total // (int(x) * window) for r, x in zip(left, w) if r and x)
        if count:
            given = apportion(w, np.array([count * window]))[0].tolist()
            phases.append({"first": first, "at": list(at), "weights": w})
        else:  # some queue ends within this window: the others fill its place
            count, room = 1, window
            given = [0] * len(left)
            while room and any(r > g for r, g in zip(left, given)):
                open_ = np.array([x if r > g else 0 for x, r, g in zip(w, left, given)])
                if not open_.any():
                    open_ = whole_weights([r - g for r, g in zip(left, given)], window)
                more = apportion(open_, np.array([room]))[0]
                for v, m in enumerate(more.tolist()):
                    m = min(m, left[v] - given[v])
                    given[v] += m
                    room -= m
            phases.append({"first": first, "at": list(at), "weights": None})
        first += count
        at = [a + g for a, g in zip(at, given)]
        left = [r - g for r, g in zip(left, given)]
    phases.append({"first": first, "at": list(at), "weights": None})
    return phases


def served(phases: list[dict], windows: np.ndarray, window: int) -> np.ndarray:
    """Tokens of each queue in all windows before each of ``windows`` (sorted)."""
    firsts = np.array([p["first"] for p in phases])
    which = np.searchsorted(firsts, windows, "right") - 1
    out = np.empty((len(windows), len(phases[0]["at"])), np.int64)
    for k in np.unique(which):
        rows, p = which == k, phases[k]
        out[rows] = p["at"]
        if p["weights"] is not None:
            out[rows] += apportion(p["weights"], (windows[rows] - p["first"]) * window)
    return out


def find_windows(phases: list[dict], queue: int, positions: np.ndarray, window: int) -> np.ndarray:
    """The window of each position of a queue, to within one."""
    at = np.array([p["at"][queue] for p in phases])
    k = np.clip(np.searchsorted(at, positions, "right") - 1, 0, len(phases) - 1)
    first = np.array([p["first"] for p in phases])
    rate = np.array([p["weights"][queue] / p["weights"].sum() * window if p["weights"] is not None and p["weights"][queue] else np.inf for p in phases])
    last = np.append(first[1:], first[-1]) - 1
    return np.minimum(first[k] + ((positions - at[k]) / rate[k]).astype(np.int64), np.maximum(last[k], first[k]))


def _tokens(batches, source, names, aimed, end_id):
    """Per document: the task, its row there, its queue, its position within the task and queue (shared queues: and source), and its ids."""
    words = codec(source.value)
    kind = words.dtype
    end = np.array([end_id], kind).tobytes()
    part = TaskContext.get().partitionId()
    before: dict = {}
    row = 0
    for whole in batches:
        for batch in slices(whole):
            sources = batch.column("source").to_pylist()
            queues = [names[s] if s in names else len(names) + (s not in aimed) for s in sources]
            ids = [x + end for x in words.encode(batch.column("text").to_pylist())]
            counts = [len(x) // kind.itemsize for x in ids]
            starts = []
            for q, s, n in zip(queues, sources, counts):
                starts.append(before.get((q, s), 0))
                before[q, s] = starts[-1] + n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array([part] * len(ids), pa.int32()), pa.array(range(row, row + len(ids)), pa.int64()), pa.array(queues, pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "source", "part", "row", "queue", "at", "doc_tokens", "ids"],
            )
            row += len(ids)


def _running(batches):
    """Rows in order, each with the tokens before it in its queue and partition."""
    before = np.zeros(2, np.int64)
    for batch in batches:
        queue, counts = batch.column("queue").to_numpy(), batch.column("doc_tokens").to_numpy()
        at = np.empty(len(counts), np.int64)
        for k, q in enumerate(np.unique(queue).tolist()):
            own = np.flatnonzero(queue == q)
            ends = np.cumsum(counts[own])
            at[own] = before[q % 2] + ends - counts[own]
            before[q % 2] += ends[-1]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "row", "queue", "pid", "doc_tokens")), pa.array(at)], names=["part", "row", "queue", "pid", "doc_tokens", "at"])


def in_turn(tokens: DataFrame, scratch: Scratch, spark: SparkSession, targets: dict | None) -> DataFrame:
    """Rows of the shared queues with their position in the queue, sources served in turn by their weights."""
    counts = scratch.keep(tokens.groupBy("queue", "source", "part").agg(F.sum("doc_tokens").alias("n")), "counts")
    # a source has at most a row for each task here
    own = W.partitionBy("queue", "source")
    ahead = counts.select("queue", F.col("source").alias("_s"), F.col("part").alias("_p"), F.sum("n").over(own).alias("size"), (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("ahead"))
    small = tokens.select("source", "part", "row", "queue", "at", "doc_tokens").join(ahead.withColumnRenamed("queue", "_q"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")) & (F.col("queue") == F.col("_q")))
    weight = F.col("size").cast("double")
    if targets is not None:
        goal = spark.createDataFrame([(s, float(v)) for s, v in targets.items() if v > 0] or [(None, 1.0)], "_g string, goal double")
        small = small.join(goal, small.source == goal._g, "left")
        weight = F.coalesce("goal", weight)
    small = small.select("part", "row", "queue", "doc_tokens", ((F.col("ahead") + F.col("at") + F.col("doc_tokens")) / weight).alias("turn"))
    order = ["queue", "turn", "part", "row"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = small.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    dealt = scratch.keep(dealt.select("part", "row", "queue", "pid", "doc_tokens").mapInArrow(_running, "part int, row long, queue int, pid int, doc_tokens long, at long"), "turns")
    # two rows for each partition at most
    sums = dealt.groupBy("queue", "pid").agg(F.sum("doc_tokens").alias("n"))
    starts = sums.select(F.col("queue").alias("_q"), F.col("pid").alias("_i"), (F.sum("n").over(W.partitionBy("queue").orderBy("pid")) - F.col("n")).alias("start"))
    placed = dealt.join(F.broadcast(starts), (F.col("queue") == F.col("_q")) & (F.col("pid") == F.col("_i"))).select(F.col("part").alias("_p"), F.col("row").alias("_r"), (F.col("start") + F.col("at")).alias("_at"))
    joined = tokens.join(placed, (tokens.part == placed._p) & (tokens.row == placed._r))
    return scratch.keep(joined.select("doc_id", "source", "part", "row", "queue", F.col("_at").alias("at"), "doc_tokens", "ids"), "in-turn")


def _pieces(batches, plan, kind, window, with_ids):
    phases, base, virtual = plan.value["phases"], plan.value["base"], plan.value["virtual"]
    for whole in batches:
        for batch in slices(whole, name="ids"):
            column = {n: batch.column(n) for n in ("doc_id", "part", "queue", "at", "doc_tokens", "ids")}
            queue = column["queue"].to_numpy(zero_copy_only=False)
            starts = column["at"].to_numpy() + base[column["part"].to_numpy(), queue]
            counts = column["doc_tokens"].to_numpy()
            out = {k: [] for k in ("row", "start", "length", "sequence_id", "offset")}
            lanes = np.array([virtual[q][0] for q in range(len(virtual))])[queue]
            starts = starts + np.array([virtual[q][1] for q in range(len(virtual))])[queue]
            for lane in np.unique(lanes):
                rows = np.flatnonzero(lanes == lane)
                a, b = starts[rows], starts[rows] + counts[rows]
                lo = np.maximum(find_windows(phases, lane, a, window) - 2, 0)
                hi = find_windows(phases, lane, b - 1, window) + 3
                # windows of these documents, as runs of numbers
                order = np.argsort(lo, kind="stable")
                spans, reach = [], None
                for x, y in zip(lo[order].tolist(), hi[order].tolist()):
                    if reach is None or x > reach[1]:
                        reach = [x, y]
                        spans.append(reach)
                    elif y > reach[1]:
                        reach[1] = y
                for x, y in spans:
                    inside = (lo >= x) & (hi <= y)
                    table = served(phases, np.arange(x, y + 1), window)
                    cuts = table[:, lane]
                    widths = np.diff(table, axis=0)
                    ahead = (np.cumsum(widths, axis=1) - widths)[:, lane]
                    i = np.searchsorted(cuts, a[inside], "right") - 1
                    j = np.searchsorted(cuts, b[inside] - 1, "right") - 1
                    n = j - i + 1
                    own = np.repeat(np.flatnonzero(inside), n)
                    w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(i, n)
                    left, right = np.maximum(cuts[w], a[own]), np.minimum(cuts[w + 1], b[own])
                    full = right > left
                    own, w, left, right = own[full], w[full], left[full], right[full]
                    out["row"].append(rows[own])
                    out["start"].append(left - a[own])
                    out["length"].append(right - left)
                    out["sequence_id"].append(w + x)
                    out["offset"].append(ahead[w] + left - cuts[w])
            got = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
            ids = [np.frombuffer(x, kind).astype("<u4") for x in column["ids"].to_pylist()]
            cut = [ids[r][s : s + n] for r, s, n in zip(got["row"].tolist(), got["start"].tolist(), got["length"].tolist())]
            rows = pa.array(got["row"], pa.int64())
            arrays = [column["doc_id"].take(rows)] + [pa.array(got[k], pa.int64()) for k in ("start", "length")]
            arrays += [pa.array([zlib.crc32(x) for x in cut], pa.int64()), column["doc_tokens"].take(rows)]
            arrays += [pa.array(got[k], pa.int64()) for k in ("sequence_id", "offset")]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([x.tobytes() for x in cut], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end_id: int = 1, targets: dict[str, float] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in which sequence.

    ``targets`` gives the token share of sources (any unit); without it, each source's own share of
    the corpus, so that every window has the corpus mixture to the end. Only the last sequence can
    be short. ``with_ids`` adds each piece's ids as little-endian 32-bit numbers.
    """
    ship(spark)
    from .wordbpe import WordCodec

    source = read_tokenizer(tokenizer)
    shared = spark.sparkContext.broadcast(source)
    scratch = Scratch(spark, "pack", like=docs)
    docs = docs.select("doc_id", "text", "source")
    if docs.rdd.getNumPartitions() > MAX_PARTS:
        docs = docs.coalesce(MAX_PARTS)
    # at most 1 / MIN_SHARE sources can have that share, and NAMED are named, so the collected table is bounded
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    least = max(1.0, total * MIN_SHARE)
    main = sizes.where(F.col("n") >= least)
    if targets is not None:
        named = sorted(targets, key=lambda s: (-targets[s], s))[:NAMED]
        main = sizes.where(F.col("source").isin(named))
    aimed = {s for s, v in (targets or {}).items() if v > 0}
    names = {r["source"]: i for i, r in enumerate(main.orderBy("source").select("source").collect())}
    schema = ddl(docs, "doc_id", "source") + ", part int, row long, queue int, at long, doc_tokens long, ids binary"
    tokens = scratch.keep(docs.mapInArrow(lambda b: _tokens(b, shared, names, aimed, end_id), schema), "tokens")
    # one row for each task and queue: at most MAX_PARTS x 66
    sums = {(r["part"], r["queue"]): r["n"] for r in tokens.groupBy("part", "queue").agg(F.sum("doc_tokens").alias("n")).collect()}
    parts, queues = 1 + max((p for p, _ in sums), default=0), len(names) + 2
    table = np.zeros((parts, queues), np.int64)
    for (p, q), n in sums.items():
        table[p, q] = n
    base, size = np.cumsum(table, axis=0) - table, table.sum(axis=0).tolist()
    few = F.col("queue") < len(names)
    if any(size[len(names) :]):
        base[:, len(names) :] = 0
        turned = in_turn(tokens.where(~few), scratch, spark, targets)
        tokens = tokens.where(few).unionByName(turned) if names else turned
    wanted = size
    if targets is not None:
        wanted = [round(targets.get(s, 0) * (1 << 40)) for s in names] + [round(sum(targets[s] for s in aimed if s not in names) * (1 << 40)), 0]
    # without targets, a queue of under a token a window is served behind the largest one, in one lane
    largest = int(np.argmax(size)) if size else 0
    tiny = [q for q in range(queues) if targets is None and q != largest and size[q] * window < sum(size)]
    lanes = [q for q in range(queues) if q not in tiny]
    virtual, lane_size = {}, [size[q] for q in lanes]
    for i, q in enumerate(lanes):
        virtual[q] = (i, 0)
    for q in tiny:
        lane = lanes.index(largest)
        virtual[q] = (lane, lane_size[lane])
        lane_size[lane] += size[q]
    phases = schedule(lane_size, [wanted[q] for q in lanes] if targets is not None else lane_size, window)
    plan = spark.sparkContext.broadcast({"phases": phases, "base": base, "virtual": virtual})
    kind = WordCodec(source).dtype.str
    schema = ddl(docs, "doc_id") + ", start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return tokens.mapInArrow(lambda b: _pieces(b, plan, kind, window, with_ids), schema)
