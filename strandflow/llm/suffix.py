"""Suffix-array dedup of bytes: depth-limited radix passes instead of a sorted suffix array.

Suffixes are ordered only through the threshold (200 bytes), most significant digit first, and a pass keeps
only groups of several: after the last, the groups are exactly the repeated windows. A row for each suffix
would make some 30 times the input, so a row stands for a range of consecutive suffixes of a document (repeats.py):

1. Ranges are dealt into buckets by the 32 bytes at their anchor, which equal suffixes share; a range alone in its
   bucket holds no repeat.
2. Ranges equal through the threshold of their last suffix are equal in all their suffixes: they are done, and
   one of them stays for comparison with the rest of the bucket.
3. Where a bucket has several different ranges, these go through the PASSES. In each the ranges are cut into narrower
   ones and sorted by a further digit, the first so many bytes that all suffixes of the range have in common; the group of
   the pass before is the more significant part of the key. Groups of one drop, equal ranges are done as above.
4. In the last pass a range is one suffix and its digits reach the threshold: what is equal there is a repeated window.

Every byte covered by a window that also starts elsewhere goes, in all its places. A null text is
empty; texts shorter than the window stay; a repeated row (equal doc_id and text) is another
document, so both go. Null doc_ids are ordinary. Very long texts are worked through in chunks. An empty table gives an
empty result. Of other columns none is read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ddl, ship, slices, text_buffer
from .repeats import SHAPE, covered, edit, entries, narrow, place_columns, with_spans, with_version

WINDOW = 200
GRAM = 32
#: Suffixes to a range and share of the threshold to which its digits reach, pass by pass.
PASSES = ((32, 0.6), (4, 0.8), (1, 1.0))


def _sorted_pass(rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Of ranges by their group: those equal through the threshold (to go), and one of each where a group has several."""
    groups = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("span").alias("a"), F.max("span").alias("b")).where("c > 1")
    groups = scratch.keep(groups.select(F.col("key").alias("k"), (F.col("a") != F.col("b")).alias("mixed")), f"groups-{name}")
    hits = scratch.keep(rows.join(groups, rows.key == groups.k).drop("k"), f"hits-{name}")
    place = F.struct("doc_id", "version", "at", "shape")
    kinds = scratch.keep(hits.groupBy("key", "span").agg(F.count("*").alias("c"), F.min(place).alias("one"), F.max("mixed").alias("mixed")), f"kinds-{name}")
    twice = kinds.where("c > 1").select(F.col("key").alias("k"), F.col("span").alias("s"))
    gone = hits.join(twice, (hits.key == twice.k) & (hits.span == twice.s), "left_semi")
    gone = scratch.keep(gone.select("doc_id", "version", "at", F.col("shape").bitwiseAND((1 << SHAPE) - 1).alias("n")).distinct(), f"gone-{name}")
    left = scratch.keep(kinds.where("mixed").select("key", "one.doc_id", "one.version", "one.at", "one.shape"), f"left-{name}")
    scratch.drop(f"groups-{name}", f"hits-{name}", f"kinds-{name}")
    return gone, left


def repeated(docs: DataFrame, scratch: Scratch, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Spans (doc_id, version, at, n): the windows starting at ``at`` .. ``at + n - 1`` occur more than once; docs: doc_id, version, text."""
    docs = docs.select("doc_id", "version", "text")
    gone, left = _sorted_pass(docs.mapInArrow(lambda b: entries(b, "byte", window, gram), place_columns(docs)), scratch, "buckets")
    # from here on only the texts of these ranges are read
    texts = scratch.keep(with_spans(docs, left, "inner"), "texts")
    for k, (width, share) in enumerate(PASSES):
        if width > 1 and 4 * width > window:
            continue
        depth = max(round(share * window), min(width, window))
        chosen = with_spans(texts.drop("spans"), left, "inner") if left is not None and k else texts
        ranges = scratch.keep(chosen.mapInArrow(lambda b, w=width, d=depth: narrow(b, "byte", window, w, d), place_columns(docs)), f"ranges-{k}")
        more, left = _sorted_pass(ranges, scratch, str(k))
        scratch.drop(f"ranges-{k}")
        gone = gone.unionByName(more)
    scratch.drop("texts")
    return gone


def _cut(batches, window, with_kept):
    for whole in batches:
        for batch in slices(whole):
            raw, rows = text_buffer(batch.column("text"))
            data = raw.tobytes()
            runs, starts, ends = covered(batch.column("spans"), window)
            out = []
            for i in range(batch.num_rows):
                text = data[rows[i] : rows[i + 1]]
                kept, at = [], 0
                for a, b in zip(starts[runs[i] : runs[i + 1]].tolist(), ends[runs[i] : runs[i + 1]].tolist()):
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((len(text), len(text) - len(rest), len(kept) - 1, hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            arrays = [batch.column("doc_id")] + [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays[: None if with_kept else -1], names=names[: None if with_kept else -1])


def remove_repeats(spark: SparkSession, docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, with_kept: bool = False) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 and, on demand, the kept bytes."""
    ship(spark)
    docs = with_version(docs.select("doc_id", "text"))
    spans = repeated(docs, Scratch(spark, "suffix", like=docs), window=window, gram=gram)
    schema = ddl(docs, "doc_id") + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return edit(docs, spans, lambda b: _cut(b, window, with_kept), schema)
