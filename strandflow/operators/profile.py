"""How reads differ from what they were drawn from: errors by strand on an interval, lengths of a known run, spans and balance of alleles.

A read is aligned in an Arrow stage that groups nothing, with its source beside it; everything after that is counting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.align import infix_hits, lay, revcomp, runs
from .aggregates import offset_histogram
from .joins import small, spread

READ = "ref_bases long, mismatch long, ins long, del long, run_right long, run_seen long, span long, several_anchors boolean"


@dataclass(frozen=True)
class ProfileSettings:
    """``whole``: kinds of reads that come from one place of their source; ``products``: kinds whose span is measured."""

    unit_bp: int = 60
    run_letter: str = "C"
    run_length: int = 7
    run_reach: int = 7
    anchor_edits: int = 12
    anchor_hits: int = 6
    whole: tuple[str, ...] = ("full", "fragment")
    products: tuple[str, ...] = ("full", "smear", "chimera", "concatemer")
    off_units: float = 1.5
    bin_bp: int = 15
    lowest_bin: int = -12
    highest_bin: int = 4
    size_units: int = 55
    peak_bp: int = 30
    peak_share: float = 0.012


def run_calls(read: str, begin: np.ndarray, ref: str, s: ProfileSettings) -> tuple[int, int]:
    """(right, seen): of the reference's runs of just the length, those that the read shows so long. Letters that the alignment
    left beside a run count, as far as ``run_reach``; a run that is gone isn't looked for beside its place."""
    right = seen = 0
    for start, end, letter in runs(ref, s.run_length):
        if letter != s.run_letter or end - start != s.run_length or start == 0 or end == len(ref):
            continue
        a, b = int(begin[start]), int(begin[end])
        found = read.count(letter, a, b)
        if found:
            before, behind = read[max(0, a - s.run_reach) : a], read[b : b + s.run_reach]
            found += len(before) - len(before.rstrip(letter)) + len(behind) - len(behind.lstrip(letter))
        right, seen = right + (found == s.run_length), seen + 1
    return right, seen


def _hits(anchor: str, reads: list[str], s: ProfileSettings) -> list[list[tuple[int, int]]]:
    """Places of an anchor in each read, best first found and then masked, in order of place."""
    found, open_ = [[] for _ in reads], list(range(len(reads)))
    texts = list(reads)
    for _ in range(s.anchor_hits):
        hits = infix_hits(anchor, [texts[i] for i in open_], s.anchor_edits)
        again = []
        for i, hit in zip(open_, hits):
            if hit:
                found[i].append(hit[:2])
                texts[i] = texts[i][: hit[0]] + "N" * (hit[1] - hit[0]) + texts[i][hit[1] :]
                again.append(i)
        open_ = again
    return [sorted(f) for f in found]


def first_copy(left: list[tuple[int, int]], right: list[tuple[int, int]]) -> int | None:
    """Length from the first left anchor to the first right one behind it, for reads that have either more than once."""
    if max(len(left), len(right)) < 2 or not left:
        return None
    return next((end - left[0][0] for start, end in right if start >= left[0][1]), None)


#: What a read's measures are made from.
GIVEN = ["kind", "strand", "src_start", "src_end", "seq", "source", "lo", "hi", "spanning"]


def _measure(pdf: pd.DataFrame, s: ProfileSettings) -> pd.DataFrame:
    """One batch: equal reads of one place are measured once."""
    group = pdf.groupby(GIVEN, sort=False, dropna=False).ngroup().to_numpy()
    _, first = np.unique(group, return_index=True)
    found = _measured(pdf.iloc[first], s).iloc[group].reset_index(drop=True)
    keys = pdf[["case", "read_id", "kind", "hap", "strand", "overlapping", "spanning"]].reset_index(drop=True)
    return pd.concat([keys, found], axis=1)


def _measured(pdf: pd.DataFrame, s: ProfileSettings) -> pd.DataFrame:
    """The measures (READ) of each row: reads of one stretch of one source are laid together."""
    pdf = pdf.reset_index(drop=True)
    out = {c.split()[0]: [None] * len(pdf) for c in READ.split(", ")}
    turned = [q if strand == "+" else revcomp(q) for q, strand in zip(pdf["seq"], pdf["strand"])]
    stretch: dict[tuple, list[int]] = {}
    anchored: dict[tuple, list[int]] = {}
    for i, row in enumerate(pdf.itertuples(index=False)):
        if row.spanning:
            stretch.setdefault((row.source, row.lo, row.hi, row.src_start, row.src_end), []).append(i)
        if row.kind in s.products:
            out["span"][i] = len(row.seq) - (len(row.source) - (row.hi - row.lo))
            anchored.setdefault((row.source[row.lo : row.lo + s.unit_bp], row.source[row.hi - s.unit_bp : row.hi]), []).append(i)
    for (source, lo, hi, start, end), rows in stretch.items():
        laid = lay([turned[i] for i in rows], source[start:end])
        pieces = [turned[i][int(b[lo - start]) : int(b[hi - start])] for i, b in zip(rows, laid.begin)]
        ref = source[lo:hi]
        laid = lay(pieces, ref)
        other = laid.has & (laid.codes != np.frombuffer(ref.encode("latin-1", "replace"), np.uint8))
        counts = zip(other.sum(axis=1).tolist(), laid.ahead.sum(axis=1).tolist(), (~laid.has).sum(axis=1).tolist())
        for i, piece, begin, (mismatch, ins, gone) in zip(rows, pieces, laid.begin, counts):
            out["ref_bases"][i], out["mismatch"][i], out["ins"][i], out["del"][i] = len(ref), mismatch, ins, gone
            out["run_right"][i], out["run_seen"][i] = run_calls(piece, begin, ref, s)
            if out["span"][i] is not None:
                out["span"][i] = len(piece)
    for (left, right), rows in anchored.items():
        reads = [turned[i] for i in rows]
        for i, a, b in zip(rows, _hits(left, reads, s), _hits(right, reads, s)):
            first = first_copy(a, b)
            out["several_anchors"][i] = first is not None
            out["span"][i] = out["span"][i] if first is None else first
    kinds = {n: "boolean" if n == "several_anchors" else "Int64" for n in out}
    return pd.DataFrame({n: pd.array(v, kinds[n]) for n, v in out.items()})


def read_profile(truth: DataFrame, reads: DataFrame, sources: DataFrame, s: ProfileSettings = ProfileSettings()) -> DataFrame:
    """One row for each truth(case, read_id, kind, hap, strand, src_start, src_end): its errors on the source's interval, runs and span.

    reads(case, name, seq), sources(case, hap, seq, lo, hi). Errors are counted for reads of one place that span the interval, null for
    others; a span is null for kinds that are no product. A read that isn't there, or a source of a read of one place, is an error.
    """
    known = small(sources.select("case", "hap", F.upper("seq").alias("source"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")))
    seqs = reads.select("case", F.col("name").alias("read_id"), F.upper("seq").alias("seq"))
    both = truth.join(seqs, ["case", "read_id"], "left").join(known, ["case", "hap"], "left")
    whole = F.col("kind").isin(*s.whole)
    missing = F.when(F.col("seq").isNull(), F.raise_error(F.concat(F.lit("no read "), "read_id"))).when(whole & F.col("source").isNull(), F.raise_error(F.concat(F.lit("no source of read "), "read_id")))
    overlapping = whole & (F.col("src_start") < F.col("hi")) & (F.col("src_end") > F.col("lo"))
    spanning = whole & (F.col("src_start") <= F.col("lo")) & (F.col("src_end") >= F.col("hi"))
    both = both.where(missing.cast("string").isNull()).select("case", "read_id", "kind", "hap", "strand", F.coalesce(F.col("src_start").cast("long"), F.lit(0)).alias("src_start"), F.coalesce(F.col("src_end").cast("long"), F.lit(0)).alias("src_end"), "seq", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("hi", F.lit(0)).alias("hi"), F.coalesce(overlapping, F.lit(False)).alias("overlapping"), F.coalesce(spanning, F.lit(False)).alias("spanning"))
    keys = ", ".join(f"`{n}` {both.schema[n].dataType.simpleString()}" for n in ("case", "read_id", "kind", "hap", "strand", "overlapping", "spanning"))
    # equal reads come one after the other, so that a batch has most of theirs
    near = spread(both).sortWithinPartitions("case", "hap", "src_start", "src_end", "strand", "seq")
    return near.mapInPandas(lambda batches: (_measure(pdf, s) for pdf in batches if len(pdf)), f"{keys}, {READ}")


def error_table(profile: DataFrame, *keys: str) -> DataFrame:
    """(keys, strand, kind, errors, bases, rate) of every kind of error and all together, by strand and over both ("all")."""
    sums = [F.sum(c).alias(c) for c in ("ref_bases", "mismatch", "ins", "del")]
    strands = profile.where("spanning").groupingSets([[*map(F.col, keys), F.col("strand")], [*map(F.col, keys)]], *map(F.col, keys), F.col("strand")).agg(F.grouping("strand").alias("_all"), *sums)
    kinds = F.expr("stack(4, 'mismatch', mismatch, 'insertion', ins, 'deletion', del, 'error', mismatch + ins + del) as (kind, errors)")
    return strands.select(*keys, F.when(F.col("_all") == 1, "all").otherwise(F.col("strand")).alias("strand"), kinds, F.col("ref_bases").alias("bases")).withColumn("rate", F.try_divide("errors", "bases"))


def run_table(profile: DataFrame, *keys: str) -> DataFrame:
    """(keys, strand, right, seen, share): runs of the known length that reads show right, by strand and over both."""
    sets = [[*map(F.col, keys), F.col("strand")], [*map(F.col, keys)]]
    sums = profile.where("spanning").groupingSets(sets, *map(F.col, keys), F.col("strand")).agg(F.grouping("strand").alias("_all"), F.sum("run_right").alias("right"), F.sum("run_seen").alias("seen"))
    return sums.select(*keys, F.when(F.col("_all") == 1, "both").otherwise(F.col("strand")).alias("strand"), "right", "seen", F.try_divide("right", "seen").alias("share"))


def placed(profile: DataFrame, sources: DataFrame) -> DataFrame:
    """Products with their case's allele lengths (in order), the nearest of these (ties: the shorter) and the offset from it."""
    alleles = small(sources.groupBy("case").agg(F.array_sort(F.collect_set((F.col("hi") - F.col("lo")).cast("long"))).alias("alleles")))
    near = F.array_min(F.transform("alleles", lambda a: F.struct(F.abs(F.col("span") - a).alias("far"), a.alias("near"))))["near"]
    return profile.where("span is not null").join(alleles, "case").withColumn("near", near).withColumn("offset", F.col("span") - F.col("near"))


def on_peak(s: ProfileSettings) -> Column:
    return F.abs("offset") <= F.greatest(F.lit(float(s.peak_bp)), s.peak_share * F.col("near"))


def span_fractions(products: DataFrame, s: ProfileSettings = ProfileSettings()) -> DataFrame:
    """Per case of ``placed``: products, those of each impure kind, off any allele, between the alleles, below the short one, with repeated anchors."""
    off = s.off_units * s.unit_bp
    low, high = F.element_at("alleles", 1), F.element_at("alleles", -1)
    share = lambda c: F.try_divide(F.count_if(c), F.count("*"))
    return products.groupBy("case").agg(
        F.count("*").alias("products"),
        share(F.col("kind") == "smear").alias("smear_frac"),
        share(F.col("kind") == "chimera").alias("chimera_frac"),
        share(F.abs("offset") > off).alias("off_frac"),
        share((F.col("span") > low + off) & (F.col("span") < high - off)).alias("between_frac"),
        share(F.col("span") < low - off).alias("below_frac"),
        share(F.coalesce("several_anchors", F.lit(False))).alias("several_anchors_frac"),
    )


def read_fractions(profile: DataFrame) -> DataFrame:
    """Per case: reads, those off target, and of fragments that overlap the interval those that span it (null without fragments)."""
    fragments = F.count_if(F.col("kind") == "fragment") > 0
    spans = F.try_divide(F.count_if("spanning"), F.count_if("overlapping"))
    return profile.groupBy("case").agg(F.count("*").alias("reads"), F.try_divide(F.count_if(F.col("kind") == "offtarget"), F.count("*")).alias("offtarget_frac"), F.when(fragments, spans).alias("spanning_frac"))


def span_offsets(products: DataFrame, s: ProfileSettings = ProfileSettings(), *keys: str) -> DataFrame:
    """Histogram of ``placed`` offsets by keys and the size of the nearest allele (small, large)."""
    size = F.when(F.col("near") / s.unit_bp < s.size_units, "small").otherwise("large")
    return offset_histogram(products.withColumn("size", size), [*keys, "size"], "offset", s.bin_bp, s.lowest_bin, s.highest_bin)


def allele_balance(products: DataFrame, s: ProfileSettings = ProfileSettings()) -> DataFrame:
    """Per case with two alleles a unit or more apart, both with products on their peak: units apart, log of long over short, and per unit."""
    low, high = F.element_at("alleles", 1), F.element_at("alleles", -1)
    n = products.where(on_peak(s)).groupBy("case").agg(F.first((high - low) / s.unit_bp).alias("delta_units"), F.count_if(F.col("near") == low).alias("n_short"), F.count_if(F.col("near") == high).alias("n_long"))
    kept = n.where("delta_units >= 1 and n_short > 0 and n_long > 0").withColumn("log_ratio", F.ln(F.col("n_long") / F.col("n_short")))
    return kept.withColumn("slope", F.col("log_ratio") / F.col("delta_units"))
