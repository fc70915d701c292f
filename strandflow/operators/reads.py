"""Reads: orientation, span between anchors, category; assignment to alleles. reads(sample, ord, name, seq, qual)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ReadSettings
from ..dictionary import Dictionary, default
from ..functions.align import infix_distance, infix_hits, once, revcomp

CATEGORIES = "sample string, ord long, name string, category string, seq string, mean_q double, strand string, edits int, basis string, length int"


def _spans(texts: list[str], words: Dictionary, s: ReadSettings) -> list[tuple[int, int, int, str] | None]:
    """Of each text the span (start, end, edits, basis) between the layout's end units, else between the flanks."""
    first, last = (words.units[u] for u in words.ends)
    out: list = [None] * len(texts)

    def between(rows: list[int], one: str, two: str, k: int, basis: str) -> None:
        lefts = infix_hits(one, [texts[i] for i in rows], k)
        found = [(i, x) for i, x in zip(rows, lefts) if x]
        rights = infix_hits(two, [texts[i][x[1] :] for i, x in found], k)
        for (i, x), y in zip(found, rights):
            if y and basis == "motif":
                out[i] = (x[0], x[1] + y[1], x[2] + y[2], basis)
            elif y:
                out[i] = (x[1], x[1] + y[0], x[2] + y[2], basis)

    between(list(range(len(texts))), first, last, s.anchor_edits, "motif")
    if words.left and words.right:
        between([i for i, x in enumerate(out) if x is None], words.left[-s.flank_bp :], words.right[: s.flank_bp], max(2, s.anchor_edits // 4), "flank")
    return out


def _categorize(seqs: list[str], quals: list[str], words: Dictionary, s: ReadSettings) -> list[tuple]:
    forward = _spans(seqs, words, s)
    # the forward strand wins ties, so where it fits without an edit the other needn't be searched
    again = [i for i, x in enumerate(forward) if x is None or x[2]]
    turned = {i: revcomp(seqs[i]) for i in again}
    back = dict(zip(again, _spans([turned[i] for i in again], words, s)))
    out: list = []
    partial = []
    for i, (seq, qual) in enumerate(zip(seqs, quals)):
        hit, strand, text = forward[i], "+", seq
        other = back.get(i)
        if other and (hit is None or other[2] < hit[2]):
            hit, strand, text, qual = other, "-", turned[i], qual[::-1]
        if hit and s.least_units * words.unit_bp <= hit[1] - hit[0] <= s.most_units * words.unit_bp:
            a, b, edits, basis = hit
            q = np.frombuffer(qual[a:b].encode("latin-1"), np.uint8)
            out.append(("spanning", text[a:b], float(q.mean()) - 33 if len(q) else 0.0, strand, edits, basis, b - a))
        else:
            partial.append(i)
            out.append(None)
    texts = [t for i in partial for t in (seqs[i], turned.get(i) or revcomp(seqs[i]))]
    ends = [[x is not None for x in infix_hits(words.units[u], texts, s.anchor_edits)] for u in words.ends]
    for n, i in enumerate(partial):
        kind = tuple(any(e[2 * n : 2 * n + 2]) for e in ends)
        out[i] = ({(True, False): "left", (False, True): "right"}.get(kind, "internal_or_offtarget"), seqs[i], None, None, None, None, len(seqs[i]))
    return out


def categorize(reads: DataFrame, words: Dictionary | None = None, s: ReadSettings = ReadSettings()) -> DataFrame:
    """Each read's category, and for spanning reads the oriented span. Reads are independent: no shuffle."""
    words = words or default()

    def work(batches):
        for pdf in batches:
            # equal reads of a batch are searched once
            given, which = once(zip(pdf["seq"], pdf["qual"]))
            found = _categorize([q for q, _ in given], [q for _, q in given], words, s)
            rows = [found[i] for i in which]
            out = pd.DataFrame(rows, columns=["category", "seq", "mean_q", "strand", "edits", "basis", "length"])
            out.insert(0, "name", pdf["name"].to_numpy())
            out.insert(0, "ord", pdf["ord"].to_numpy())
            out.insert(0, "sample", pdf["sample"].to_numpy())
            for c in ("edits", "length"):
                out[c] = out[c].astype("Int32")
            yield out[["sample", "ord", "name", "category", "seq", "mean_q", "strand", "edits", "basis", "length"]]

    return reads.select("sample", "ord", "name", "seq", "qual").mapInPandas(work, CATEGORIES)


def category_counts(categorized: DataFrame) -> DataFrame:
    return categorized.groupBy("sample", "category").agg(F.count("*").alias("n"))


def assign(reads: DataFrame, refs: DataFrame, s: ReadSettings = ReadSettings(), forward_only: bool = False) -> DataFrame:
    """Each long read's allele: nearest in either orientation, leading by the margin, within the error rate.

    refs(sample, allele, seq): one or two rows for each sample, so they travel with the reads as an array.
    """
    listed = refs.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("allele", "seq"))).alias("refs"))
    work = reads.where(F.length("seq") >= s.fragment_bp).join(listed, "sample").select("sample", "ord", "seq", "refs")

    def nearest(seq, refs):
        found = []
        for ref in refs:
            for strand in "+" if forward_only else "+-":
                text = seq if strand == "+" else revcomp(seq)
                found.append((infix_distance(text, ref["seq"]), len(found), ref["allele"], strand))
        best = min(found)
        rest = [x[0] for x in found if x[2] != best[2]]
        if best[0] > s.error_rate * len(seq):
            name = "off_target"
        elif rest and min(rest) - best[0] < s.margin:
            name = "undecided"
        else:
            name = best[2]
        return name, best[3], best[0]

    def run(batches):
        for pdf in batches:
            # equal reads of a sample in a batch are searched once
            refs = dict(zip(pdf["sample"], pdf["refs"]))
            given, which = once(zip(pdf["sample"], pdf["seq"]))
            found = [nearest(seq, refs[sample]) for sample, seq in given]
            yield pd.DataFrame([(r.sample, r.ord, *found[i]) for r, i in zip(pdf.itertuples(), which)], columns=["sample", "ord", "assigned", "strand", "distance"])

    return work.mapInPandas(run, "sample string, ord long, assigned string, strand string, distance int")


def inside(assigned: DataFrame, categories: DataFrame, words: Dictionary | None = None, s: ReadSettings = ReadSettings()) -> DataFrame:
    """(sample, allele, ord, seq): partial reads that were assigned to an allele, turned its way and cut to what lies between the layout's end units.

    assigned(sample, ord, assigned, strand); a read that has neither end unit lies inside as it is.
    """
    words = words or default()
    first, last = (words.units[u] for u in words.ends)
    known = assigned.where("assigned not in ('off_target', 'undecided')").select("sample", "ord", F.col("assigned").alias("allele"), F.col("strand").alias("_turn"))
    both = categories.where("category <> 'spanning'").select("sample", "ord", "seq").join(known, ["sample", "ord"])

    def cut(batches):
        for pdf in batches:
            given, which = once(zip(pdf["seq"], pdf["_turn"]))
            seqs = [revcomp(q) if t == "-" else q for q, t in given]
            starts, ends = infix_hits(first, seqs, s.anchor_edits), infix_hits(last, seqs, s.anchor_edits)
            own = [q[a[0] if a else 0 : b[1] if b and (not a or b[1] > a[0]) else len(q)] for q, a, b in zip(seqs, starts, ends)]
            yield pdf[["sample", "allele", "ord"]].assign(seq=[own[i] for i in which])

    return both.mapInPandas(cut, "sample string, allele string, ord long, seq string").where(F.length("seq") >= words.unit_bp)
