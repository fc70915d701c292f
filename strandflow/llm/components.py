"""Connected components by contraction, all in DataFrame joins and aggregates.

In a round every node moves to the smallest among itself and its neighbours, and the edges between the nodes so chosen are the next
round's graph. Each round is smaller than the one before, so all rounds together cost about as much as the first few;
at last the rounds' moves are followed back. Before that, each task contracts the edges it holds, CHUNK
at a time, which shortens paths for no shuffle (and ids in order don't make long chains). Every round is written to the scratch folder, so a lost executor
costs a task and not the rounds before. A hub's edges are only ever minimised (partial aggregates) or
joined from a plain exchange, which adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges that a task contracts together.
CHUNK = 500_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes: from each node to one node of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        hung = root.copy()
        np.minimum.at(hung, root[a], low)
        np.minimum.at(hung, root[b], low)
        while True:
            jumped = hung[hung]
            if np.array_equal(jumped, hung):
                break
            hung = jumped
        hung = hung[root]
        if np.array_equal(hung, root):
            break
        root = hung
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _contract(batches):
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield _stars(held)
            held, n = [], 0
    if n:
        yield _stars(held)


def _stars(held):
    whole = pa.Table.from_batches(held)
    u, v = contract(whole["u"].to_numpy(), whole["v"].to_numpy())
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of an edge; edges: two long columns u, v; root: one node of the component."""
    edges = edges.where("u <> v").select("u", "v").mapInArrow(_contract, "u long, v long")
    now = scratch.keep(edges, "edges-0")
    moves: list[DataFrame] = []
    while not now.isEmpty():
        k = len(moves)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("to"))
        moves.append(scratch.keep(low, f"moves-{k}"))
        a, b = moves[k].select(F.col("node").alias("u"), F.col("to").alias("a")), moves[k].select(F.col("node").alias("v"), F.col("to").alias("b"))
        between = now.join(a, "u").join(b, "v").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        now = scratch.keep(between.mapInArrow(_contract, "u long, v long"), f"edges-{k + 1}")
        scratch.drop(f"edges-{k}")
    if not moves:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = moves[-1].select("node", F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = move.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    out = scratch.keep(roots, "roots")
    scratch.drop(*(f"moves-{k}" for k in range(len(moves))))
    return out
