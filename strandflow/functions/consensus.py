"""Draft consensus of a few reads, by named backends.

``partial_order``: reads are added to a graph one by one. A node is a letter, and nodes that reads align to each other share a column; an edge counts the reads
that go along it. A read is aligned to the graph with the least edits within a band around where reads pass each node, which is doubled while the alignment doesn't fit in it.
The consensus is the path of the heaviest edges from the start to the end (Lee et al., 2002; Lee, 2003). ``medoid``: the read with the least total distance to the others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .align import edit_distance

FAR = np.int32(1 << 28)
#: Half the band: letters, and share of the read's length. A fit of more edits than this share of the read asks for a wider band.
BAND, BAND_SHARE, POOR = 48, 0.02, 0.3


class Graph:
    """Letters and counted edges; node 0 is the start, node 1 the end."""

    def __init__(self):
        self.letter, self.column = [0, 0], [0, 1]
        self.before: list[dict[int, int]] = [{}, {}]
        #: Sum of the relative places at which reads passed a node, and how many did.
        self.place, self.reads = [0.0, 1.0], [1, 1]
        self.of_column: dict[int, dict[int, int]] = {}
        #: The columns in order, while every read has a letter in each of them.
        self.straight: list[int] | None = None

    def add(self, letter: int, column: int | None) -> int:
        node = len(self.letter)
        column = node if column is None else column
        self.letter.append(letter)
        self.column.append(column)
        self.before.append({})
        self.place.append(0.0)
        self.reads.append(0)
        self.of_column.setdefault(column, {})[letter] = node
        return node

    def order(self) -> list[int]:
        """Nodes after all nodes before them; the start and the end are left out."""
        after: list[list[int]] = [[] for _ in self.letter]
        need = [len(b) for b in self.before]
        for v, b in enumerate(self.before):
            for u in b:
                after[u].append(v)
        ready, out = [0], []
        while ready:
            u = ready.pop()
            if u > 1:
                out.append(u)
            for v in after[u]:
                need[v] -= 1
                if not need[v]:
                    ready.append(v)
        return out

    def align_straight(self, read: np.ndarray) -> list[tuple[int, int]] | None:
        """The alignment that ``align`` finds, where it surely has no gaps; else null.

        Two gaps, one on either side, cost two edits, so none of the best alignments has them if one edit is enough. In a graph of one path the
        best alignment that goes straight is the one taken, as straight steps come first.
        """
        if self.straight is None or len(self.straight) != len(read):
            return None
        cost, letters = {0: 0}, read.tolist()
        for i, c in enumerate(self.straight):
            for letter, v in self.of_column[c].items():
                cost[v] = min(cost[u] for u in self.before[v]) + (letters[i] != letter)
        v = min(self.before[1], key=cost.__getitem__)
        edits = cost[v]
        if edits > 1 and (len(self.letter) > len(read) + 2 or edit_distance(bytes(self.letter[2:]).decode("latin-1"), read.tobytes().decode("latin-1")) < edits):
            return None
        path = []
        for i in range(len(letters) - 1, -1, -1):
            path.append((v, i))
            before = cost[v] - (letters[i] != self.letter[v])
            v = next(u for u in self.before[v] if cost[u] == before)
        return path[::-1]

    def align(self, read: np.ndarray, half: int) -> tuple[list[tuple[int, int]], int]:
        """Pairs (node or -1, read place or -1) of the best alignment within the band, and its edits."""
        n, width = len(read), 2 * half + 1
        along = np.arange(width, dtype=np.int32)
        letters = np.concatenate([np.zeros(1, np.uint8), read, np.zeros(width, np.uint8)])
        rows: dict[int, np.ndarray] = {0: np.where(along <= n, along, FAR)}
        low = {0: 0}
        order = self.order()
        for v in order:
            at = min(max(0, round(self.place[v] / self.reads[v] * n) - half), max(0, n - half))
            # what the nodes before cost at the places at - 1 .. at + width - 1
            best = np.full(width + 1, FAR, np.int32)
            for u in self.before[v]:
                shift = at - 1 - low[u]
                a, b = max(0, -shift), min(width + 1, width - shift)
                if a < b:
                    np.minimum(best[a:b], rows[u][a + shift : b + shift], out=best[a:b])
            cost = np.minimum(best[:-1] + (letters[at : at + width] != self.letter[v]), best[1:] + 1)
            row = np.minimum.accumulate(cost - along) + along
            row[along + at > n] = FAR
            rows[v], low[v] = row, at
        value = lambda u, i: int(rows[u][i - low[u]]) if 0 <= i - low[u] < width else int(FAR)
        v = min(self.before[1], key=lambda u: value(u, n))
        i, edits, path = n, value(v, n), []
        if edits >= FAR:
            return [], edits
        while v or i:
            here = value(v, i)
            if not v:
                i -= 1
                path.append((-1, i))
                continue
            both = next((u for u in self.before[v] if i and value(u, i - 1) + (read[i - 1] != self.letter[v]) == here), None)
            if both is not None:
                i -= 1
                path.append((v, i))
                v = both
                continue
            skip = next((u for u in self.before[v] if value(u, i) + 1 == here), None)
            if skip is not None:
                path.append((v, -1))
                v = skip
            else:
                i -= 1
                path.append((-1, i))
        return path[::-1], edits

    def thread(self, read: np.ndarray, path: list[tuple[int, int]]) -> None:
        """Take the read into the graph along its alignment."""
        last = 0
        if len(self.letter) == 2:
            self.straight = list(range(2, len(read) + 2))
        elif self.straight is not None and (len(path) != len(self.straight) or any(v < 0 or i < 0 for v, i in path)):
            self.straight = None
        for v, i in path:
            if i < 0:
                continue
            letter = int(read[i])
            if v < 0:
                node = self.add(letter, None)
            else:
                same = self.of_column[self.column[v]]
                node = same[letter] if letter in same else self.add(letter, self.column[v])
            self.before[node][last] = self.before[node].get(last, 0) + 1
            self.place[node] += (i + 0.5) / len(read)
            self.reads[node] += 1
            last = node
        self.before[1][last] = self.before[1].get(last, 0) + 1

    def heaviest(self) -> str:
        score, best = {0: 0}, {}
        for v in [*self.order(), 1]:
            best[v] = max(self.before[v], key=lambda u: (self.before[v][u], score[u], -u))
            score[v] = score[best[v]] + self.before[v][best[v]]
        out, v = [], best[1]
        while v:
            out.append(chr(self.letter[v]))
            v = best[v]
        return "".join(reversed(out))


def partial_order(seqs: list[str]) -> str:
    """Reads nearest the median length come first: the graph's shape is theirs."""
    reads = [np.frombuffer(q.encode("latin-1", "replace"), np.uint8) for q in seqs if q]
    if not reads:
        return ""
    middle = float(np.median([len(r) for r in reads]))
    graph = Graph()
    for k, read in enumerate(sorted(reads, key=lambda r: abs(len(r) - middle))):
        if not k:
            graph.thread(read, [(-1, i) for i in range(len(read))])
            continue
        straight = graph.align_straight(read)
        if straight:
            graph.thread(read, straight)
            continue
        half = BAND + round(BAND_SHARE * len(read))
        while True:
            path, edits = graph.align(read, half)
            if edits <= POOR * len(read) + 8 or half >= len(read):
                break
            half *= 2
        if path:
            graph.thread(read, path)
    return graph.heaviest()


def medoid(seqs: list[str]) -> str:
    """The read with the least total distance to the others; of equals the first."""
    return seqs[min(range(len(seqs)), key=lambda i: (sum(edit_distance(seqs[i], x) for x in seqs), i))] if seqs else ""


BACKENDS: dict[str, Callable[[list[str]], str]] = {"partial_order": partial_order, "medoid": medoid}


def backend(name: str) -> Callable[[list[str]], str]:
    """The named backend; there is no other in its place."""
    if name not in BACKENDS:
        raise ValueError(f"unknown consensus backend: {name!r}, known: {sorted(BACKENDS)}")
    return BACKENDS[name]


def consensus(name: str = "partial_order"):
    """A grouped aggregate function of a column of reads. A group has to be a bounded number of reads, since it comes together in one task."""
    make = backend(name)

    @F.pandas_udf("string")
    def aggregate(seqs: pd.Series) -> str:
        return make(seqs.dropna().tolist())

    return aggregate
