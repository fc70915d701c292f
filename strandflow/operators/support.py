"""Read support of each event of each allele, from the reads assigned to the allele.

Reads are laid on their allele's consensus in an Arrow stage in piles of at most about TOGETHER reads; a pile goes with its allele and the allele's events. What its
reads say about runs are counts, so that the fits below cost the number of (run, strand, length) classes of an allele, however many
reads it has. Alleles of one pile are fitted where it is; of others the counts leave the stage and are added up. What reads say about other events leaves as the piece of each around the event, with its vote. Only two steps look at an event's or an allele's rows together,
and both are bounded: the fit of an allele's classes, and the consensus of at most ``polish_reads`` pieces.

An event is a unit with a template or of another length than its parent. One whose template adds or takes one base of a run of ``event_run`` bases or more is a
*run* event: lengths of the run, read between its bounds, are compared under profiles of what reads show of runs of the event's length and of the length without it
(see ``profiles``). All others are *contests*: does a read's piece, the event's unit with ``context_units`` units on either side, fit the event better
than the best alternative: the parent's unit in its place, or what the reads that don't favour the event show there.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import ReadSettings
from ..dictionary import Dictionary, default
from ..functions.align import edit_distance, lay, once, runs
from .evidence import Mixture, competition_status, hp_status, profiles
from .joins import small, spread
from .phase import polish

#: About how many reads of one allele are laid together.
TOGETHER = 512
#: Letters of the alleles and reads that a task remembers.
HELD = 16 << 20
EVENTS = "sample string, allele string, index int, start int, end int, unit string, template string, kind string, run_start int, run_end int, base string, change int, low int, high int, with_event string, without string"
SAID = "sample string, allele string, kind string, index int, at int, strand string, length int, n long, ord long, piece string, vote int"
FITS = "sample string, allele string, index int, n long, alt long, ref long, llr double, share double, strand_low boolean, strands string"
FIT = tuple(c.split()[0] for c in FITS.split(", ")[3:])
SUPPORT = ["sample", "allele", "index", "start", "end", "unit", "template", "kind", "n", "alt", "ref", "other", "alt_share", "alternative_share", "llr", "strands", "status"]


def changed_run(template, parent: str, cons: str, start: int, end: int, s: ReadSettings) -> tuple[int, int, str, int] | None:
    """(start, end, base, change) of the consensus run that a template lengthens or shortens by one base; null if it does something else.

    Runs of ``longest_run`` bases, with or without the event, aren't modelled.
    """
    at = template.start - 1
    if template.kind == "insert" and len(template.bases) == 1:
        base, change = template.bases, 1
    elif template.kind == "delete" and template.start == template.end and at < len(parent):
        base, change = parent[at], -1
    else:
        return None
    for a, b, letter in runs(cons, s.event_run):
        if letter == base and a <= start + at <= b and a < end and b > start:
            return (a, b, base, change) if max(b - a, b - a - change) < s.longest_run else None
    return None


def located(alleles: DataFrame, units: DataFrame, words: Dictionary | None = None, s: ReadSettings = ReadSettings()) -> DataFrame:
    """EVENTS of alleles(sample, allele, seq), whose units(id "sample/allele", index, start, end, unit, template, net_bp) are segmented."""
    words = words or default()
    templates = {t.name: t for t in words.templates}
    context = round(s.context_units * words.unit_bp)
    found = units.where(F.col("template").isNotNull() | (F.col("net_bp") != 0)).select("id", "index", "start", "end", "unit", "template")
    named = alleles.select("sample", "allele", "seq", F.concat_ws("/", "sample", "allele").alias("id")).join(found, "id")

    def work(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                parent, run = words.units.get(r.unit), None
                low, high = max(0, r.start - context), min(len(r.seq), r.end + context)
                if parent and r.template in templates:
                    run = changed_run(templates[r.template], parent, r.seq, r.start, r.end, s)
                kind = "none" if not parent else "run" if run else "contest"
                without = r.seq[low : r.start] + parent + r.seq[r.end : high] if parent else None
                rows.append((r.sample, r.allele, r.index, r.start, r.end, r.unit, r.template, kind, *(run or (None,) * 4), low, high, r.seq[low:high], without))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])
            for c in ("run_start", "run_end", "change"):
                out[c] = out[c].astype("Int32")
            yield out

    return named.mapInPandas(work, EVENTS)


def said(members: DataFrame, alleles: DataFrame, events: DataFrame, s: ReadSettings = ReadSettings()) -> DataFrame:
    """What reads say (SAID): fits of run events, or counts of clean lengths of every run of the events' bases for alleles of several piles, and a piece with its vote for each contest.

    members(sample, allele, ord, seq, strand): spanning reads, oriented to the consensus. Letters other than the consensus' outside its runs are
    counted too, so that what is left of a second allele shows (``residual``).
    """
    keys = ["sample", "allele"]
    # an allele's events are a handful, so they travel with its piles
    listed = events.where("kind <> 'none'").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("index", "kind", "low", "high", "with_event", "without", "run_start", "run_end", "base", "change"))).alias("events"))
    told = alleles.select(*keys, F.col("seq").alias("cons")).join(listed, keys, "left")
    # deep alleles are few as a rule, and then the reads needn't be sorted to meet them
    deep = small(members.groupBy(*keys).agg(F.ceil(F.count("*") / TOGETHER).alias("parts")).where("parts > 1"))
    number = members.select(*keys, "ord", "seq", "strand").join(deep, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = number.groupBy(*keys, "parts", F.pmod(F.xxhash64("ord"), F.col("parts")).alias("part"))
    both = dealt.agg(F.sort_array(F.collect_list(F.struct("ord", "seq", "strand"))).alias("reads")).join(told, keys)

    def work(batches):
        # alleles that are alike in their events and in what was read of them are worked out once, as long as they are held
        made: dict[tuple, list[tuple]] = {}
        held = 0
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf.itertuples():
                events = [] if r.events is None else [tuple(e[c] for c in EVENT) for e in r.events]
                read = [(x["seq"], x["strand"]) for x in r.reads]
                like = r.cons, r.parts == 1, tuple(events), tuple(read)
                if like not in made:
                    held += len(r.cons) + sum(len(q) for q, _ in read)
                    if held > HELD:
                        made, held = {}, 0
                    made[like] = _of_reads(r.cons, [dict(zip(EVENT, e)) for e in events], read, r.parts == 1, s)
                # what a single read says goes with its place
                out += [(r.sample, r.allele, *x[:-3], None if x[-3] is None else r.reads[x[-3]]["ord"], *x[-2:]) for x in made[like]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SAID.split(", ")]).astype({c: "Int64" for c in ("index", "at", "length", "n", "ord", "vote")})

    # piles of a deep allele go to several tasks
    return spread(both, *keys, "part").mapInPandas(work, SAID)


EVENT = ("index", "kind", "low", "high", "with_event", "without", "run_start", "run_end", "base", "change")


def _of_reads(cons: str, events: list[dict], read: list[tuple[str, str]], alone: bool, s: ReadSettings) -> list[tuple]:
    """SAID of a pile, without its allele, and with places in the pile for ``ord``; read: (sequence, strand) of each. ``alone``: these are all reads of the allele."""
    given, which = once(read)
    number = np.bincount(which, minlength=len(given))
    seqs, strands = [q for q, _ in given], [t for _, t in given]
    laid, rows = lay(seqs, cons), []
    within = np.zeros(len(cons), bool)
    for a, b, _ in runs(cons, s.site_run):
        within[a:b] = True
    codes = laid.codes
    other = np.argwhere((codes != np.frombuffer(cons.encode("latin-1", "replace"), np.uint8)) & ~within)
    seen: Counter = Counter()
    for r, j in other.tolist():
        seen[j, int(codes[r, j])] += int(number[r])
    rows += [("letter", None, j, None, None, n, None, chr(c), None) for (j, c), n in seen.items()]
    by_strand = Counter(t for _, t in read)
    rows += [("reads", None, None, t, None, c, None, None, None) for t, c in by_strand.items()]
    ours = [e for e in events if e["kind"] == "run"]
    bases = {e["base"] for e in ours}
    counts: dict[tuple[int, str], Counter] = {}
    for a, b, base in runs(cons, 2) if ours else []:
        if base not in bases:
            continue
        for t, n, c in zip(strands, np.minimum(laid.clean(a, b), s.longest_run).tolist(), number.tolist()):
            if n >= 0:
                counts.setdefault((a, t), Counter())[n] += c
    if alone:
        rows += [("fit", x[0], None, None, None, None, None, json.dumps(dict(zip(FIT, x[1:]))), None) for x in _fitted(cons, counts, sum(by_strand.values()), ours, s)]
    else:
        rows += [("run", None, a, t, n, c, None, None, None) for (a, t), lengths in counts.items() for n, c in lengths.items()]
    for e in events:
        if e["kind"] != "contest":
            continue
        pieces = [q[laid.begin[r, e["low"]] : laid.begin[r, e["high"]]] for r, q in enumerate(seqs)]
        votes = [_vote(p, e["with_event"], [e["without"]]) for p in pieces]
        rows += [("piece", e["index"], None, t, None, None, place, pieces[i], votes[i]) for place, (i, (_, t)) in enumerate(zip(which, read))]
    return rows


def _vote(piece: str, event: str, others: list[str]) -> int:
    """1: the event is nearer than every alternative, -1: one is nearer, 0: as near."""
    return int(np.sign(min(edit_distance(piece, x) for x in others) - edit_distance(piece, event)))


def _fit(pdf: pd.DataFrame, events: pd.DataFrame, s: ReadSettings) -> pd.DataFrame:
    """FITS of an allele's run events; pdf: its counts, one row for each class; events: with the allele's consensus."""
    counts: dict[tuple[int, str], Counter] = {}
    for a, t, n, c in zip(pdf["at"], pdf["strand"], pdf["length"], pdf["n"]):
        if not pd.isna(a):
            counts.setdefault((int(a), t), Counter())[int(n)] += int(c)
    reads = int(pdf.loc[pdf["at"].isna(), "n"].sum())
    first = events.iloc[0]
    rows = [(first["sample"], first["allele"], *x) for x in _fitted(first["cons"], counts, reads, events.to_dict("records"), s)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FITS.split(", ")])


def _fitted(cons: str, counts: dict[tuple[int, str], Counter], reads: int, events: list[dict], s: ReadSettings) -> list[tuple]:
    """FITS of an allele's run events, without the allele; counts: lengths read by (run, strand)."""
    rows, sizes = [], {a: (base, b - a) for a, b, base in runs(cons, 2)}
    for e in events:
        a, length, change = int(e["run_start"]), int(e["run_end"] - e["run_start"]), int(e["change"])
        classes, by_strand = [], {}
        for t in sorted({t for k, t in counts if k == a}):
            event, absent = profiles(counts, sizes, (a, e["base"], length, change), t, s)
            # in the order of lengths, so that sums don't hang on that of the reads
            seen = sorted(counts[a, t].items())
            classes += [(event[n], absent[n], c) for n, c in seen]
            far = sum(c for n, c in seen if (n >= length if change > 0 else n <= length))
            by_strand[t] = (sum(c for _, c in seen), far, float(sum(c * np.log(event[n] / absent[n]) for n, c in seen)))
        alt, total = sum(x[1] for x in by_strand.values()), sum(x[0] for x in by_strand.values())
        share = Mixture(*map(list, zip(*classes))).share() if classes else 0.0
        low = any(n >= s.strand_reads and llr < 0 for n, _, llr in by_strand.values())
        told = json.dumps({t: round(far / n, 3) for t, (n, far, _) in by_strand.items()})
        rows.append((int(e["index"]), reads, alt, total - alt, float(sum(x[2] for x in by_strand.values())), share, low, told))
    return rows


def run_events(heard: DataFrame, alleles: DataFrame, events: DataFrame, s: ReadSettings = ReadSettings()) -> DataFrame:
    """Support of run events: fits as the stage made them, or from counted lengths."""
    keys = ["sample", "allele"]
    done = heard.where("kind = 'fit'").select(*keys, "index", F.from_json("piece", ", ".join(FITS.split(", ")[3:])).alias("x")).select(*keys, F.col("index").cast("int").alias("index"), "x.*")
    own = events.where("kind = 'run'").join(done.select(*keys).distinct(), keys, "left_anti").join(alleles.select(*keys, F.col("seq").alias("cons")), keys)
    told = heard.where("kind in ('run', 'reads')").join(own.select(*keys).distinct(), keys, "left_semi")
    counts = told.groupBy(*keys, "at", "strand", "length").agg(F.sum("n").alias("n"))
    fits = done.unionByName(spread(counts, *keys).groupBy(*keys).cogroup(spread(own, *keys).groupBy(*keys)).applyInPandas(lambda a, b: _fit(a, b, s), FITS))
    alternative = 1 - F.col("share")
    status = hp_status("n", "llr", F.try_divide("alt", "n"), alternative, "strand_low", s)
    out = fits.withColumns({"other": F.col("n") - F.col("alt") - F.col("ref"), "alt_share": F.try_divide("alt", "n"), "alternative_share": alternative, "status": status})
    return out.select(*keys, "index", "n", "alt", "ref", "other", "alt_share", "alternative_share", "llr", "strands", "status")


def contest_events(heard: DataFrame, events: DataFrame, s: ReadSettings = ReadSettings(), *, keep=lambda df, name: df) -> DataFrame:
    """Support of other events: votes against the parent's unit and against what the reads that don't favour the event show."""
    keys = ["sample", "allele", "index"]
    pieces = keep(heard.where("kind = 'piece'").select(*keys, "ord", "strand", "piece", "vote"), "pieces")
    told = events.where("kind = 'contest'").select(*keys, "with_event", "without")
    draw = F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64("piece", "ord"), "ord"))
    rest = pieces.where("vote <= 0 and piece <> ''").withColumn("_r", draw).where(F.col("_r") <= s.polish_reads)

    def derive(pdf: pd.DataFrame) -> pd.DataFrame:
        event = pdf["with_event"].iloc[0]
        shown = polish(event, pdf.sort_values("_r")["piece"].tolist(), s)
        return pdf[keys].iloc[:1].assign(derived=shown if shown not in (event, pdf["without"].iloc[0]) else None)

    derived = rest.join(told, keys).select(*keys, "_r", "piece", "with_event", "without")
    derived = spread(derived, *keys).groupBy(*keys).applyInPandas(derive, "sample string, allele string, index int, derived string")
    derived = keep(derived.where("derived is not null"), "derived")

    def again(batches):
        for pdf in batches:
            vote = [_vote(p, e, [w, d]) for p, e, w, d in zip(pdf["piece"], pdf["with_event"], pdf["without"], pdf["derived"])]
            yield pdf[[*keys, "strand"]].assign(vote=vote)

    met = pieces.join(derived, keys, "left")
    settled = met.where("derived is null").select(*keys, "strand", "vote")
    votes = settled.unionByName(met.where("derived is not null").join(told, keys).select(*keys, "strand", "piece", "with_event", "without", "derived").mapInPandas(again, "sample string, allele string, index int, strand string, vote int"))
    by_strand = votes.groupBy(*keys, "strand").agg(F.count("*").alias("n"), F.count_if(F.col("vote") > 0).alias("alt"), F.count_if(F.col("vote") < 0).alias("ref"))
    strands = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("strand", F.round(F.col("alt") / F.col("n"), 3))))))
    n = by_strand.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "alt", "ref")], strands.alias("strands"))
    status = competition_status("n", "alt", "ref", s)
    out = n.withColumns({"other": F.col("n") - F.col("alt") - F.col("ref"), "alt_share": F.col("alt") / F.col("n"), "alternative_share": F.col("ref") / F.col("n"), "llr": F.lit(None).cast("double"), "status": status})
    return out.select(*keys, "n", "alt", "ref", "other", "alt_share", "alternative_share", "llr", "strands", "status")


def residual(heard: DataFrame, s: ReadSettings = ReadSettings()) -> DataFrame:
    """(sample, allele, sites): columns in which one letter, or a gap, other than the consensus' still has ``residual_af`` of the reads."""
    keys = ["sample", "allele"]
    reads = heard.where("kind = 'reads'").groupBy(*keys).agg(F.sum("n").alias("reads"))
    most = heard.where("kind = 'letter'").groupBy(*keys, "at", "piece").agg(F.sum("n").alias("n")).groupBy(*keys, "at").agg(F.max("n").alias("n"))
    over = reads.join(most, keys, "left").groupBy(*keys).agg(F.count_if(F.col("n") >= s.residual_af * F.col("reads")).alias("sites"))
    return over


def event_support(alleles: DataFrame, units: DataFrame, members: DataFrame, words: Dictionary | None = None, s: ReadSettings = ReadSettings(), *, keep=lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """Every event of every allele with its reads' counts, likelihood ratio, shares and status (SUPPORT), and the alleles' residual sites.

    Events without a read are insufficient_depth, those of a unit that the dictionary doesn't have not_localized; neither speaks against an event.
    """
    keys = ["sample", "allele", "index"]
    events = keep(located(alleles, units, words, s), "events")
    heard = keep(said(members, alleles, events, s), "said")
    found = run_events(heard, alleles, events, s).unionByName(contest_events(heard, events, s, keep=keep))
    both = events.select("sample", "allele", "index", "start", "end", "unit", "template", "kind").join(found, keys, "left")
    none = F.when(F.col("kind") == "none", "not_localized").otherwise("insufficient_depth")
    return both.withColumn("status", F.coalesce("status", none)).fillna(0, ["n", "alt", "ref", "other"]).select(*SUPPORT), residual(heard, s)


def mutations(support: DataFrame, units: DataFrame) -> DataFrame:
    """Events as the decision takes them: name, frameshift, template_match, ambiguous_place and their read support."""
    place = units.select("id", F.col("index").alias("_i"), "frameshift", "ambiguous_place", "label", "net_bp")
    name: Column = F.concat_ws(" ", "allele", F.concat(F.lit("unit "), F.col("index")), "label")
    both = support.join(place, (F.concat_ws("/", support["sample"], support["allele"]) == place["id"]) & (support["index"] == F.col("_i")))
    return both.select(*SUPPORT, name.alias("name"), "net_bp", "frameshift", "ambiguous_place", F.col("template").isNotNull().alias("template_match"), F.col("status").alias("read_support_status"), F.lit(None).cast("string").alias("support_status"))
