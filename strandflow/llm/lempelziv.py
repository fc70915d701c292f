"""Substring dedup of words by a relative Lempel-Ziv parse against the whole corpus.

Reference blocks are ranges of windows of ``window`` words (repeats.py), of every document. They are indexed by exact keys: a block's
anchor files it, the hash of all its words names it, and the index holds for each name the first place it occurs
(smallest doc_id, of texts with one id the smallest version, then start). A document's blocks are looked up in the index of
the whole corpus:

1. A block whose name has an earlier place is copied from there.
2. Of blocks that share their anchor with a different one, a representative is cut into the narrower blocks of WIDTHS
   windows, down to one, and looked up again; so a match is found at every length from the window on.

``parse`` then reads each document from left to right: hits that go on in the same place of the same reference document are
one match, and the longest match at hand becomes the next factor, a piece copied from (reference document, start). Where
a factor ends and another one goes on, the windows across the border are hits of their own, so a border neither loses
a window nor adds one: a word is covered by a factor exactly if a window around it occurs earlier.
Matches shorter than the window are left as literals.

A word covered by a window that starts earlier too goes; the first occurrence stays. Null doc_ids come first; different texts with
one doc_id are in the order of a hash of the text. A null text has no words. Rows equal in
doc_id and text are one place: neither is earlier than the other. Very long texts are worked through in chunks. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ddl, ship, slices, text_buffer
from .repeats import SHAPE, edit, entries, flat, merged, narrow, place_columns, with_spans, with_version, words_of

WINDOW = 20
GRAM = 4
#: Windows to a reference block, after the blocks that the anchors make.
WIDTHS = (4, 1)


def look_up(blocks: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Hits of blocks with an earlier equal (place, windows, and the first place), and a representative of each name where an anchor has several."""
    place = F.struct("doc_id", "version", "at")
    index = blocks.groupBy("key").agg(F.count("*").alias("c"), F.min("span").alias("a"), F.max("span").alias("b")).where("c > 1")
    index = scratch.keep(index.select(F.col("key").alias("k"), (F.col("a") != F.col("b")).alias("mixed")), f"anchors-{name}")
    shared = scratch.keep(blocks.join(index, blocks.key == index.k).drop("k"), f"shared-{name}")
    names = shared.groupBy("key", "span").agg(F.count("*").alias("c"), F.min(place).alias("first"), F.any_value("shape").alias("shape"), F.max("mixed").alias("mixed"))
    names = scratch.keep(names, f"names-{name}")
    known = names.where("c > 1").select(F.col("key").alias("k"), F.col("span").alias("s"), "first")
    hits = shared.join(known, (shared.key == known.k) & (shared.span == known.s))
    # the same place in a repeated row is not earlier
    hits = hits.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version")) & (F.col("at") == F.col("first.at"))))
    hits = hits.select("doc_id", "version", "at", F.col("shape").bitwiseAND((1 << SHAPE) - 1).alias("n"), F.col("first.doc_id").alias("from"), F.col("first.at").alias("place"))
    hits = scratch.keep(hits.distinct(), f"hits-{name}")
    left = scratch.keep(names.where("mixed").select("key", "first.doc_id", "first.version", "first.at", "shape"), f"left-{name}")
    scratch.drop(f"anchors-{name}", f"shared-{name}", f"names-{name}")
    return hits, left


def matches(docs: DataFrame, scratch: Scratch, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Hits (doc_id, version, at, n, from, place): the windows at ``at`` .. ``at + n - 1`` occur earlier, from ``place`` on in document ``from``."""
    docs = docs.select("doc_id", "version", "text")
    hits, left = look_up(docs.mapInArrow(lambda b: entries(b, "word", window, gram), place_columns(docs)), scratch, "blocks")
    # from here on only the texts of these blocks are read
    texts = scratch.keep(with_spans(docs, left, "inner"), "texts")
    for k, width in enumerate(w for w in WIDTHS if w == 1 or 4 * w <= window):
        chosen = with_spans(texts.drop("spans"), left, "inner") if k else texts
        blocks = scratch.keep(chosen.mapInArrow(lambda b, w=width: narrow(b, "word", window, w, window), place_columns(docs)), f"narrow-{width}")
        more, left = look_up(blocks, scratch, str(width))
        scratch.drop(f"narrow-{width}")
        hits = hits.unionByName(more)
    scratch.drop("texts")
    return hits


def parse(column: pa.Array, window: int) -> tuple[np.ndarray, ...]:
    """The factors of each row's document: row, start, words, reference document, start there; null references are 0."""
    row, x = flat(column)
    at, shift = x["at"], x["place"] - x["at"]
    # hits that go on in one reference are one match
    keys = np.stack([row, x["from"], shift], axis=1)
    _, group = np.unique(keys, axis=0, return_inverse=True) if len(row) else (None, row)
    group, start, end = merged(group.ravel(), at, at + x["n"])
    first = np.unique(keys, axis=0) if len(row) else keys
    own, source, move = (first[group, i] for i in range(3))
    end = end + window - 1
    order = np.lexsort((-end, start, own))
    out, now, done = [], -1, 0
    i, n = 0, len(order)
    own_, start_, end_ = own[order].tolist(), start[order].tolist(), end[order].tolist()
    while i < n:
        if own_[i] != now:
            now, done = own_[i], 0
        # of the matches that begin by ``done`` (or next), the one that reaches farthest
        begin, best = max(done, start_[i]), i
        j = i
        while j < n and own_[j] == now and start_[j] <= begin:
            if end_[j] > end_[best]:
                best = j
            j += 1
        if end_[best] > begin:
            k = int(order[best])
            out.append((now, begin, end_[best] - begin, int(source[k]), begin + int(move[k])))
            done = end_[best]
        i = j
    return tuple(np.array(c, np.int64) for c in (zip(*out) if out else [[]] * 5))


def _cut(batches, window, with_text):
    for whole in batches:
        for batch in slices(whole):
            raw, rows = text_buffer(batch.column("text"))
            data = raw.tobytes()
            row, start, size, _, _ = parse(batch.column("spans"), window)
            own, first, last = merged(row, start, start + size)
            cut = np.searchsorted(own, np.arange(batch.num_rows + 1))
            out = []
            for i in range(batch.num_rows):
                text = data[rows[i] : rows[i + 1]]
                starts, ends = first[cut[i] : cut[i + 1]], last[cut[i] : cut[i + 1]]
                if not len(starts):
                    words = text.split()
                    out.append((len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), text if with_text else b""))
                    continue
                left, right = words_of(raw[rows[i] : rows[i + 1]])
                # kept runs of words, [a, b)
                a, b = np.append(0, ends), np.append(starts, len(left))
                a, b = a[b > a].tolist(), b[b > a].tolist()
                parts = [text[left[x] : right[y - 1]] for x, y in zip(a, b)]
                kept = b" ".join(parts)
                out.append((len(left), int((ends - starts).sum()), hashlib.sha256(b" ".join(kept.split())).hexdigest(), b"\n".join(parts) if with_text else b""))
            n, removed, digest, texts = zip(*out)
            if not with_text:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
                continue
            source = batch.column("text").is_null()
            text = pa.array([None if gone else t.decode("utf-8", "replace") for t, gone in zip(texts, source.to_pylist())], pa.string())
            names = [c for c in batch.schema.names if c not in ("version", "spans")]
            arrays = [text if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "lz_words", "lz_removed"])


def _factors(batches, window):
    for whole in batches:
        for batch in slices(whole):
            row, start, size, source, place = parse(batch.column("spans"), window)
            arrays = [batch.column("doc_id").take(pa.array(row))] + [pa.array(x) for x in (start, size, source, place)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_words", "from_doc", "from_start"])


def factors(spark: SparkSession, docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The parse itself: doc_id, start, n_words, and the document and word that the factor is copied from (null doc_ids there: 0)."""
    ship(spark)
    docs = with_version(docs.select("doc_id", "text"))
    hits = matches(docs, Scratch(spark, "lempelziv", like=docs), window=window, gram=gram)
    return edit(docs, hits, lambda b: _factors(b, window), ddl(docs, "doc_id") + ", start long, n_words long, from_doc long, from_start long")


def remove_repeats(spark: SparkSession, docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256; with ``with_text``, the documents with their kept text instead.

    The kept text joins the kept runs of words, with their own white space, by line breaks;
    ``lz_words`` and ``lz_removed`` are added. Columns called version, spans, _d or _w are not passed on.
    """
    ship(spark)
    docs = with_version(docs.drop("version", "spans", "_d", "_w", "lz_words", "lz_removed") if with_text else docs.select("doc_id", "text"))
    hits = matches(docs, Scratch(spark, "lempelziv", like=docs), window=window, gram=gram)
    if not with_text:
        return edit(docs, hits, lambda b: _cut(b, window, False), ddl(docs, "doc_id") + ", n_words long, n_removed long, kept_sha256 string")
    schema = ddl(docs, *[c for c in docs.columns if c != "version"]) + ", lz_words long, lz_removed long"
    return edit(docs, hits, lambda b: _cut(b, window, True), schema)
