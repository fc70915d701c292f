"""Windows of a corpus filed under anchors: what byte and word repeats are searched by.

The corpus is a sequence of symbols (bytes, or words) for each document. A window of W symbols is filed
under its anchor, the position in it of the smallest hash of ``gram`` symbols (the first of equals). Equal
windows have equal anchors at the same place in the window, and consecutive windows mostly share theirs,
so a document has one entry, a range of windows, for about every W / 2 positions. An entry has the key of its
anchor's gram and the hash of its whole span (all symbols of its windows).

``narrow`` cuts entries into ranges of fewer windows, counted from the anchor, so that equal windows
of different entries fall into ranges of one number; a range is keyed by what the first ``depth`` symbols of all
its windows have in common.

Keys are hashes of the symbols' bytes (words joined by one space), seeded by the key before: in all 128 bits stand for
a window. Documents are cut into chunks that overlap by W - 1 symbols, so memory doesn't grow with a
document. A document is known by doc_id and a 64-bit hash of its text: rows that repeat both count
as one place (see the callers).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, slices, text_buffer

#: Positions are told apart within a chunk by the low bits of the anchors' order key.
CHUNK_BITS = 20
#: Odd multipliers. Fixed values.
STEP, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: [\x20\x09-\x0D]
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: Columns of a range of windows: how far its first window starts before the anchor, and how many windows, in one number.
SHAPE = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: A random number for each byte value, made by rule.
BYTE_CODE = _mix(np.arange(1, 257, dtype=np.uint64) * STEP)


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a text's bytes."""
    blank = BLANK[raw]
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    return edge[0::2], edge[1::2]


class Symbols:
    """The symbols of a text column: a code of each, row offsets, and the bytes of any run of them."""

    def __init__(self, column: pa.Array, unit: str):
        raw, rows = text_buffer(column)
        if unit == "byte":
            self.codes, self.rows, self.data = raw, rows, memoryview(np.ascontiguousarray(raw))
            self.begin = self.finish = None
            return
        data = raw.tobytes()
        # bytes split at ASCII white space only
        words = [data[a:b].split() for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]
        self.rows = np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))
        flat = list(itertools.chain.from_iterable(words))
        n = len(flat)
        # the codes only place the anchors; keys are made from the words' bytes
        self.codes = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, n)
        self.finish = np.cumsum(np.fromiter(map(len, flat), np.int64, n) + 1) - 1
        self.begin = np.append(0, self.finish[:-1] + 1)
        self.data = memoryview(b" ".join(flat))

    def bounds(self, first: np.ndarray, last: np.ndarray) -> tuple[list, list]:
        """Byte ranges of the symbols first .. last (included)."""
        if self.begin is None:
            return first.tolist(), (last + 1).tolist()
        return self.begin[first].tolist(), self.finish[last].tolist()


def _grams(s: np.ndarray, gram: int) -> np.ndarray:
    h = BYTE_CODE[s] if s.dtype == np.uint8 else s
    power, size = STEP, 1
    while size < gram:
        h = h[:-size] + h[size:] * power
        power, size = power * power, size * 2
    return _mix(h)


def runs(s: np.ndarray, rows: np.ndarray, window: int, gram: int):
    """Entries of a chunk (under 2^CHUNK_BITS symbols): row, first window, last window, anchor."""
    n = len(s) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    with np.errstate(over="ignore"):
        grams = _grams(s, gram)
    low = np.uint64(CHUNK_BITS)
    least = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
    width, size = window - gram + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    anchor = (least[:n] & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.int64)
    # windows that lie within one row
    mark = np.zeros(n + 1, np.int32)
    a = np.minimum(rows[:-1], n)
    b = np.minimum(np.maximum(rows[1:] - window + 1, a), n)
    np.add.at(mark, a[b > a], 1)
    np.add.at(mark, b[b > a], -1)
    inside = np.flatnonzero(np.cumsum(mark[:-1]))
    if not len(inside):
        return none, none, none, none
    own = anchor[inside]
    first = np.flatnonzero(np.diff(own, prepend=own[0] - 1) | (np.diff(inside, prepend=inside[0] - 2) > 1))
    last = np.append(first[1:], len(own)) - 1
    lo, hi = inside[first], inside[last]
    return np.searchsorted(rows, lo, "right") - 1, lo, hi, own[first]


def _chunks(symbols: Symbols, window: int):
    """(first row, first symbol, codes, row offsets, offset of the first symbol in its row), whole rows together where they fit."""
    s, rows = symbols.codes, symbols.rows
    limit = (1 << CHUNK_BITS) - 1
    i = 0
    while i < len(rows) - 1:
        j = max(i + 1, int(np.searchsorted(rows, rows[i] + limit, "right")) - 1)
        if rows[j] - rows[i] <= limit:
            yield i, int(rows[i]), s[rows[i] : rows[j]], rows[i : j + 1] - rows[i], 0
        else:
            for at in range(int(rows[i]), int(rows[i + 1]) - window + 1, limit - window + 1):
                to = min(at + limit, int(rows[i + 1]))
                yield i, at, s[at:to], np.array([0, to - at]), at - int(rows[i])
        i = j


def _signed(x) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def place_columns(docs: DataFrame) -> str:
    return f"key long, span long, {ddl(docs, 'doc_id')}, version long, at int, shape int"


def entries(batches, unit: str, window: int, gram: int):
    """Entries (key, span, doc_id, version, at, shape) of documents."""
    digest = xxhash.xxh3_64_intdigest
    for whole in batches:
        for batch in slices(whole, 2 << 20):
            symbols = Symbols(batch.column("text"), unit)
            for first, base, s, rows, shift in _chunks(symbols, window):
                row, lo, hi, anchor = runs(s, rows, window, gram)
                data = symbols.data
                keys = [digest(data[a:b]) for a, b in zip(*symbols.bounds(base + anchor, base + anchor + gram - 1))]
                shape = (anchor - lo) << SHAPE | hi - lo + 1
                spans = [digest(data[a:b], n) for a, b, n in zip(*symbols.bounds(base + lo, base + hi + window - 1), shape.tolist())]
                take = pa.array(row + first)
                at = lo + shift - np.where(shift, 0, rows[row])
                yield pa.RecordBatch.from_arrays(
                    [_signed(keys), _signed(spans), batch.column("doc_id").take(take), batch.column("version").take(take), pa.array(at.astype(np.int32)), pa.array(shape.astype(np.int32))],
                    names=["key", "span", "doc_id", "version", "at", "shape"],
                )


def narrow(batches, unit: str, window: int, width: int, depth: int):
    """The chosen entries (``spans`` of each row) cut into ranges of ``width`` windows, keyed by their common first ``depth`` symbols.

    Range j has the windows that start ``j * width`` to ``j * width + width - 1`` symbols before the anchor.
    """
    digest = xxhash.xxh3_64_intdigest
    for whole in batches:
        for batch in slices(whole, 2 << 20):
            symbols = Symbols(batch.column("text"), unit)
            row, x = flat(batch.column("spans"))
            base = symbols.rows[row]
            n, off = x["shape"] & (1 << SHAPE) - 1, x["shape"] >> SHAPE
            anchor = base + x["at"] + off
            low, high = (off - n + 1) // width, off // width
            for part in np.array_split(np.arange(len(row)), max(1, int((high - low + 1).sum()) // 200_000)):
                count = (high - low + 1)[part]
                own = np.repeat(part, count)
                j = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + low[own]
                start = anchor[own] - j * width  # the range's last window
                first = np.maximum((base + x["at"])[own], start - width + 1)
                last = np.minimum((base + x["at"] + n - 1)[own], start)
                shape = (anchor[own] - first) << SHAPE | last - first + 1
                seeds = x["key"].view(np.uint64)[own] ^ j.astype(np.uint64)
                data = symbols.data
                # windows start - width + 1 .. start share their symbols from start to the depth of the first
                keys = [digest(data[a:b], s) for a, b, s in zip(*symbols.bounds(start, start - width + depth), seeds.tolist())]
                spans = [digest(data[a:b], s) for a, b, s in zip(*symbols.bounds(first, last + window - 1), shape.tolist())]
                take = pa.array(row[own])
                yield pa.RecordBatch.from_arrays(
                    [_signed(keys), _signed(spans), batch.column("doc_id").take(take), batch.column("version").take(take), pa.array((first - base[own]).astype(np.int32)), pa.array(shape.astype(np.int32))],
                    names=["key", "span", "doc_id", "version", "at", "shape"],
                )


def flat(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row numbers and fields of a column of lists of structs of numbers; null: none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    inner = column.flatten()
    names = [f.name for f in column.type.value_type]
    return np.repeat(np.arange(len(column)), sizes), {n: inner.field(n).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for n in names}


def with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """``docs`` with each row's distinct spans; repeated rows share one list."""
    grouped = spans.groupBy("doc_id", "version").agg(F.collect_set(F.struct(*[c for c in spans.columns if c not in ("doc_id", "version")])).alias("spans"))
    grouped = grouped.select(F.col("doc_id").alias("_d"), F.col("version").alias("_w"), "spans")
    return docs.join(grouped, docs.doc_id.eqNullSafe(grouped._d) & (docs.version == grouped._w), how).drop("_d", "_w")


def with_version(docs: DataFrame) -> DataFrame:
    return docs.withColumn("version", F.xxhash64("text"))


def merged(row: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching [at, end) of each row: row, start, end."""
    order = np.lexsort((at, row))
    row, at, end = row[order], at[order], end[order]
    # ends made to rise over all rows
    far = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(end + row * far)
    new = np.append(True, (at + row * far)[1:] > reach[:-1])[: len(row)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], at[first], (reach[last] - row[first] * far) if len(first) else first


def covered(column: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: the merged runs [start, end) of the symbols that the windows of its (at, n) spans cover; offsets of rows in them."""
    row, x = flat(column)
    row, start, end = merged(row, x["at"], x["at"] + x["n"] + window - 1)
    return np.searchsorted(row, np.arange(len(column) + 1)), start, end


def edit(docs: DataFrame, spans: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``docs`` with each row's spans (null: none), through an Arrow function."""
    return with_spans(docs, spans, "left").mapInArrow(work, schema)
