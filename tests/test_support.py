"""Read support of events, and whole runs from reads to decisions, on simulated reads."""

import random

import pytest

from strandflow import dictionary
from strandflow.config import ReadSettings
from strandflow.functions import align
from strandflow.operators import segment, support

WORDS = dictionary.default()
HEAD, TAIL = ("1", "2", "3", "4", "5"), ("6", "7", "8", "9")


def chain(*names):
    return "".join(WORDS.units[n] for n in names)


def mutated(unit, template):
    return next(s for s, (u, t) in WORDS.mutated.items() if (u, t) == (unit, template))


def allele(*middle):
    """A whole allele; names of more than one letter that aren't units are sequences."""
    return chain(*HEAD) + "".join(WORDS.units.get(x, x) for x in middle) + chain(*TAIL)


def stutter(seq, rng, loses, gains):
    out = []
    for a, b, base in align.runs(seq, 1):
        x = rng.random() if b - a >= 4 else 1.0
        out.append(base * (b - a - (x < loses) + (loses <= x < loses + gains)))
    return "".join(out)


def reads(parts, seed, err=0.01, loses=0.0, gains=0.0):
    """(allele's reads, oriented, strand) from (sequence, number) parts."""
    rng = random.Random(seed)
    out = []
    for seq, n in parts:
        for i in range(n):
            q = stutter(seq, rng, loses, gains)
            q = "".join(c if rng.random() > err else rng.choice(["", c + rng.choice("ACGT"), rng.choice("ACGT")]) for c in q)
            out.append((q, "+-"[i % 2]))
    return out


def supported(spark, cases, s=ReadSettings(), tmp=None):
    """Support of each case (consensus, reads), as one table of samples."""
    alleles = spark.createDataFrame([(k, "allele_1", cons) for k, (cons, _) in cases.items()], "sample string, allele string, seq string")
    rows = [(k, "allele_1", i, q, t) for k, (_, own) in cases.items() for i, (q, t) in enumerate(own)]
    members = spark.createDataFrame(rows, "sample string, allele string, ord long, seq string, strand string").repartition(4)
    units = segment.segments(alleles.selectExpr("concat_ws('/', sample, allele) as id", "seq"), WORDS)
    # the same table must come out whichever way it is written in between
    return [r.asDict() for r in support.event_support(alleles, units, members, WORDS, s)[0].collect()]


def test_events_that_reads_carry_are_supported_and_others_are_not(spark):
    x = [*"XX"] * 5
    dup = allele(*x, mutated("X", "dupC"), *x)
    wild = allele(*x, "X", *x)
    long_ = allele(*x, mutated("C", "ins16bp"), *x)
    plain = allele(*x, "C", *x)
    mid = WORDS.units["X"][:30] + "T" + WORDS.units["X"][30:]
    wrong = allele(*x, mid, *x)
    cases = {
        "true_run": (dup, reads([(dup, 60)], 1)),
        "true_run_stutter": (dup, reads([(dup, 60)], 2, loses=0.1, gains=0.05)),
        "wild_reads": (dup, reads([(wild, 60)], 3, loses=0.1, gains=0.05)),
        "mixture": (dup, reads([(dup, 30), (wild, 30)], 4)),
        "few": (dup, reads([(dup, 12)], 5)),
        "true_long": (long_, reads([(long_, 60)], 6)),
        "no_long": (long_, reads([(plain, 60)], 7)),
        "half_long": (long_, reads([(long_, 30), (plain, 30)], 8)),
        "consensus_error": (wrong, reads([(wrong, 30), (wild, 30)], 9)),
    }
    got = {}
    for r in supported(spark, cases):
        assert r["sample"] not in got, r
        got[r["sample"]] = r
    assert set(got) == set(cases)
    kinds = {k: r["kind"] for k, r in got.items()}
    assert {k for k, v in kinds.items() if v == "run"} == {"true_run", "true_run_stutter", "wild_reads", "mixture", "few"}
    status = {k: r["status"] for k, r in got.items()}
    assert status["true_run"] == status["true_run_stutter"] == status["true_long"] == "supported"
    assert status["wild_reads"] == status["no_long"] == "not_supported"
    assert status["few"] == "insufficient_depth"
    assert all(status[k] != "supported" for k in ("mixture", "half_long", "consensus_error"))
    assert all(r["n"] == len(cases[k][1]) and r["alt"] + r["ref"] + r["other"] == r["n"] for k, r in got.items())
    assert got["true_run"]["llr"] > 10 > got["wild_reads"]["llr"] and got["true_long"]["llr"] is None


def test_what_the_reads_show_beats_the_parent_unit(spark):
    """The consensus has an error beside the unit: reads fit it better than the parent's unit, but what they show themselves fits best."""
    x = [*"XX"] * 4
    other = WORDS.units["A"]
    error = other[:20] + "G" + other[20:]
    truth = allele(*x, "A", "X", *x)
    cons = allele(*x, error, "X", *x)
    moved = allele(*x, other[:40] + "G" + other[40:], "X", *x)
    rows = supported(spark, {"s": (cons, reads([(cons, 24), (moved, 36)], 11)), "t": (truth, reads([(truth, 40)], 12))})
    assert [r["sample"] for r in rows] == ["s"] and rows[0]["kind"] == "contest" and rows[0]["status"] != "supported"
    assert rows[0]["ref"] >= 30


def test_residual_sites(spark):
    from strandflow.operators.support import residual, said

    cons = allele(*"XXAXX")
    at = next(j for j in range(400, 440) if cons[j - 1 : j + 2].count(cons[j]) == 1)
    other = cons[:at] + ("A" if cons[at] != "A" else "T") + cons[at + 1 :]
    alleles = spark.createDataFrame([("s", "allele_1", cons), ("t", "allele_1", cons)], "sample string, allele string, seq string")
    rows = [(k, "allele_1", i, q, t) for k, parts in (("s", [(cons, 20), (other, 12)]), ("t", [(cons, 30)])) for i, (q, t) in enumerate(reads(parts, 5, err=0.005))]
    members = spark.createDataFrame(rows, "sample string, allele string, ord long, seq string, strand string")
    events = support.located(alleles, segment.segments(alleles.selectExpr("concat_ws('/', sample, allele) as id", "seq"), WORDS), WORDS)
    assert {r["sample"]: r.sites for r in residual(said(members, alleles, events)).collect()} == {"s": 1, "t": 0}


def raw_reads(parts, seed, err=0.004):
    rng = random.Random(seed)
    out = []
    for seq, n in parts:
        for i in range(n):
            q = WORDS.left[-40:] + seq + WORDS.right[:40]
            q = "".join(c if rng.random() > err else rng.choice(["", c + c, rng.choice("ACGT")]) for c in q)
            out.append(align.revcomp(q) if i % 2 else q)
    return out


def test_reads_to_decisions(spark, tmp_path):
    from strandflow.plans.decision import call

    def keep(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    short, long_ = allele(*"XXABXXCXXX"), allele(*"XXABXXCXXXXAXX")
    carrier = allele(*"XXABXXCX", mutated("X", "dupC"), *"XXXAXX")
    samples = {"wild": raw_reads([(short, 40), (long_, 40)], 1), "carrier": raw_reads([(short, 40), (carrier, 40)], 2), "thin": raw_reads([(short, 12), (carrier, 12)], 3), "none": ["ACGT" * 300] * 3}
    raw = spark.createDataFrame([(k, i, f"r{i}", q, "5" * len(q)) for k, own in samples.items() for i, q in enumerate(own)], "sample string, ord long, name string, seq string, qual string")
    run = call(raw, keep=keep)
    got = {r["sample"]: r for r in run["decisions"].collect()}
    assert {k: r.decision for k, r in got.items()} == {"wild": "NO_PATHOGENIC_VARIANT_DETECTED", "carrier": "PATHOGENIC", "thin": "INCONCLUSIVE", "none": "NO_CALL"}, {k: (r.decision, r.reasons, r.caveats) for k, r in got.items()}
    found = {r["sample"]: r for r in run["mutations"].collect()}
    assert found["carrier"].read_support_status == "supported" and found["carrier"].blockers == [] and found["carrier"].template == "dupC"
    assert found["thin"].read_support_status == "insufficient_depth" and any("depth" in x for x in got["thin"].reasons)


def test_an_insertion_beside_a_run_is_a_site():
    """Half of the reads have a G behind a run of seven: two alleles, which the letters of the run alone don't show."""
    from strandflow.operators.phase import Features, candidates, split

    cons = allele(*"XXAXXXX")
    run = next((a, b) for a, b, base in align.runs(cons, 7) if base == "C" and a > 400)
    with_g = cons[: run[1]] + "G" + cons[run[1] :]
    seqs, strands = [cons] * 10 + [with_g] * 10, list("+-" * 10)
    f = Features(cons, seqs, strands, ReadSettings())
    sites, _ = candidates(f, ReadSettings())
    assert [(x["site"], x["major"], x["minor"]) for x in sites] == [(("ins", run[1]), "", "G")]
    assert split(cons, seqs, strands, ReadSettings())[0] == "unconfirmed_single_site"
    # more of the run's own letter is the run's length, not an insertion
    f = Features(cons, [cons] * 10 + [cons[: run[1]] + "C" + cons[run[1] :]] * 10, strands, ReadSettings())
    assert [x["site"] for x in candidates(f, ReadSettings())[0]] == [("run", run[0])]


def test_few_reads_are_no_run_site():
    from strandflow.operators.phase import Features, candidates

    cons = allele(*"XXAXXXX")
    a, b, base = next(x for x in align.runs(cons, 7) if x[2] == "C" and x[0] > 400)
    longer = cons[:b] + base + cons[b:]
    sites, tiers = candidates(Features(cons, [cons] * 4 + [longer], list("+-+-+"), ReadSettings()), ReadSettings())
    assert sites == [] and tiers == []


def test_profiles_repeat_their_ends(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from strandflow.functions.stats import shifted
    from strandflow.operators.evidence import moved

    p = np.array([0.5, 0.3, 0.2])
    for d, want in ((1, [0.5, 0.5, 0.3]), (-1, [0.3, 0.2, 0.2]), (5, [1, 1, 1])):
        want = np.array(want) / sum(want)
        assert np.allclose(moved(p, d), want)
        assert np.allclose(spark.range(1).select(shifted(F.array(*map(F.lit, p.tolist())), d).alias("p")).first().p, want)


def test_profile_of_a_length_that_cannot_be_told_apart():
    """An unmeasured event length whose carried profile says the length without the event gives way to the moved profile."""
    from collections import Counter

    s = ReadSettings(class_reads=10)
    sizes = {0: ("C", 8), 100: ("C", 7), 200: ("C", 7), 300: ("C", 6), 400: ("C", 6)}
    good = {(k, "+"): Counter({n: 95, n - 1: 5}) for k, (_, n) in sizes.items()}
    event, absent = support.profiles(good, sizes, (0, "C", 8, 1), "+", s)
    assert event.argmax() == 8 and absent.argmax() == 7 and event[7] < 0.3
    poor = good | {(k, "+"): Counter({7: 55, 6: 45}) for k in (100, 200)} | {(k, "+"): Counter({6: 80, 5: 20}) for k in (300, 400)}
    event, absent = support.profiles(poor, sizes, (0, "C", 8, 1), "+", s)
    assert abs(event[8] - absent[7]) < 0.02 and event.argmax() == 8


@pytest.mark.parametrize("template,unit,change", [("dupC", "X", 1), ("dupA", "X", None), ("insG", "X", None), ("del18_31", "X", None)])
def test_which_templates_change_a_run(template, unit, change):
    t = next(t for t in WORDS.templates if t.name == template)
    seq = allele("X", mutated(unit, template), "X")
    start = len(chain(*HEAD)) + 60
    run = support.changed_run(t, WORDS.units[unit], seq, start, start + len(mutated(unit, template)), ReadSettings())
    assert (run and run[3]) == change


def test_reads_of_an_allele_are_laid_together(spark):
    alleles = spark.createDataFrame([("s", str(k), "ACGTTGCA") for k in range(8)], "sample string, allele string, seq string")
    members = spark.createDataFrame([("s", str(k), n, "ACGTTGCA", "+") for n in range(12) for k in range(8)], "sample string, allele string, ord long, seq string, strand string")
    events = spark.createDataFrame([], support.EVENTS)
    heard = support.said(members.repartition(6), alleles, events).where("kind = 'reads'").collect()
    assert sorted((r.allele, r.n) for r in heard) == [(str(k), 12) for k in range(8)]
