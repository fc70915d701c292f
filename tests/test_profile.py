import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.functions.align import lay, revcomp
from strandflow.operators import profile as P

S = P.ProfileSettings()


def made(seed=0):
    """Two sources of one case, with flanks of 100 and one run of seven C within."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("AGT") for _ in range(n))
    out = {}
    for hap, n in ((1, 600), (2, 1200)):
        core = word(n // 2) + "C" * 7 + word(n - n // 2 - 7)
        out[hap] = (word(100) + core + word(100), 100, 100 + n)
    return out


def changed(seq, edits):
    """``edits``: (place, letter) for another letter, (place, "") for a deletion, (place, two letters) for an insertion."""
    for at, text in sorted(edits, reverse=True):
        seq = seq[:at] + text + seq[at + 1 :]
    return seq


def tables(spark, truth, seqs, sources):
    return (
        spark.createDataFrame(truth, "case string, read_id string, kind string, hap int, strand string, src_start int, src_end int"),
        spark.createDataFrame(seqs, "case string, name string, seq string"),
        spark.createDataFrame([("c", h, q, lo, hi) for h, (q, lo, hi) in sources.items()], "case string, hap int, seq string, lo int, hi int"),
    )


def test_errors_runs_and_spans(spark):
    sources = made()
    q1, q2 = sources[1][0], sources[2][0]
    other = lambda c: "A" if c != "A" else "G"
    flank = changed(q1, [(10, other(q1[10])), (50, "")])  # outside: no errors
    sub = changed(q1, [(150, other(q1[150])), (220, other(q1[220]))])
    gone = q2[:800] + "".join(q2[810:])
    run8 = q2.replace("C" * 7, "C" * 8)
    run6 = q1.replace("C" * 7, "C" * 6)
    truth, seqs = [], []

    def add(name, kind, hap, strand, seq, start=0, end=None):
        truth.append(("c", name, kind, hap, strand, start, len(sources[hap][0]) if end is None else end))
        seqs.append(("c", name, seq if strand == "+" else revcomp(seq)))

    add("flank", "full", 1, "+", flank)
    add("sub", "full", 1, "-", sub)
    add("gone", "full", 2, "+", gone)
    add("run8", "full", 2, "-", run8.lower())
    add("run6", "full", 1, "+", run6)
    add("smear", "smear", 2, "+", q2[:700])
    add("twice", "concatemer", 1, "+", q1 + q1)
    add("inside", "fragment", 1, "+", q1[200:500], 200, 500)
    add("beside", "fragment", 1, "+", q1[:90], 0, 90)
    truth.append(("c", "off", "offtarget", None, "+", None, None))
    seqs.append(("c", "off", "ACGT" * 20))
    t, r, s = tables(spark, truth, seqs, sources)
    rows = {x.read_id: x for x in P.read_profile(t, r, s).collect()}
    errors = {n: (x.mismatch, x["ins"], x["del"]) for n, x in rows.items() if x.spanning}
    assert errors == {"flank": (0, 0, 0), "sub": (2, 0, 0), "gone": (0, 0, 10), "run8": (0, 1, 0), "run6": (0, 0, 1)}
    assert {n: (x.run_right, x.run_seen) for n, x in rows.items() if x.spanning} == {"flank": (1, 1), "sub": (1, 1), "gone": (1, 1), "run8": (0, 1), "run6": (0, 1)}
    assert {n: x.span for n, x in rows.items()} == {"flank": 600, "sub": 600, "gone": 1190, "run8": 1201, "run6": 599, "smear": 500, "twice": 600, "inside": None, "beside": None, "off": None}
    assert rows["twice"].several_anchors and not rows["sub"].several_anchors and rows["inside"].overlapping and not rows["beside"].overlapping

    profile = P.read_profile(t, r, s)
    table = {(x.strand, x.kind): (x.errors, x.bases) for x in P.error_table(profile, "case").collect()}
    assert table["+", "deletion"] == (11, 2400) and table["-", "mismatch"] == (2, 1800) and table["all", "error"] == (14, 4200)
    assert {x.strand: (x.right, x.seen) for x in P.run_table(profile, "case").collect()} == {"+": (2, 3), "-": (1, 2), "both": (3, 5)}
    products = P.placed(profile, s)
    f = P.span_fractions(products).first()
    assert (f.products, f.smear_frac, f.below_frac, f.between_frac, f.several_anchors_frac) == (7, 1 / 7, 1 / 7, 0, 1 / 7)
    f = P.read_fractions(profile).first()
    assert (f.reads, f.offtarget_frac, f.spanning_frac) == (10, 0.1, 5 / 6)
    assert {(x["size"], x["bin"]): x.n for x in P.span_offsets(products).collect()} == {("small", 0): 5, ("small", -7): 1, ("small", -1): 1}
    b = P.allele_balance(products).first()
    assert (b.delta_units, b.n_short, b.n_long) == (10, 4, 2) and b.log_ratio == pytest.approx(np.log(0.5))


def test_missing_reads_and_sources_are_errors(spark):
    sources = made()
    truth = [("c", "a", "full", 1, "+", 0, 800)]
    t, r, s = tables(spark, truth, [("c", "b", "ACGT")], sources)
    with pytest.raises(Exception, match="no read a"):
        P.read_profile(t, r, s).collect()
    t, r, s = tables(spark, truth, [("c", "a", "ACGT")], {2: sources[2]})
    with pytest.raises(Exception, match="no source of read a"):
        P.read_profile(t, r, s).collect()
    t, r, s = tables(spark, truth, [("c", "a", "ACGT")], sources)
    assert P.read_profile(t.limit(0), r, s).count() == 0


def test_run_calls_reach_beside_the_run_but_not_for_one_that_is_gone():
    ref = "AGT" + "C" * 7 + "GATGA" + "C" * 6 + "AT" + "C" * 7
    for read, want in ((ref, (1, 1)), (ref.replace("C" * 7 + "G", "C" * 9 + "G"), (0, 1)), ("AGTGATGA" + "C" * 6 + "AT" + "C" * 7, (0, 1))):
        laid = lay([read], ref)
        assert P.run_calls(read, laid.begin[0], ref, S) == want


def test_first_copy():
    assert P.first_copy([(0, 60)], [(500, 560)]) is None
    assert P.first_copy([(10, 70), (700, 760)], [(500, 560), (1200, 1260)]) == 550
    assert P.first_copy([], [(5, 9), (20, 24)]) is None
    assert P.first_copy([(300, 360), (700, 760)], [(100, 160), (320, 350)]) is None


def test_error_totals_on_random_reads(spark):
    """Counted kinds add up to the edit distance of the piece, whatever the errors are."""
    from strandflow.functions.align import edit_distance

    rng, sources = random.Random(7), made(5)
    truth, seqs = [], []
    for i in range(60):
        hap, strand = rng.choice([1, 2]), rng.choice("+-")
        q = "".join(rng.choice(["", c + rng.choice("ACGT"), rng.choice("ACGT")]) if rng.random() < 0.06 else c for c in sources[hap][0])
        truth.append(("c", f"r{i}", "full", hap, strand, 0, len(sources[hap][0])))
        seqs.append(("c", f"r{i}", q if strand == "+" else revcomp(q)))
    t, r, s = tables(spark, truth, seqs, sources)
    texts = {n: q for _, n, q in seqs}
    for x in P.read_profile(t, r, s).collect():
        q, lo, hi = sources[x.hap]
        read = texts[x.read_id] if x.strand == "+" else revcomp(texts[x.read_id])
        laid = lay([read], q)
        piece = read[int(laid.begin[0, lo]) : int(laid.begin[0, hi])]
        assert x.mismatch + x["ins"] + x["del"] == edit_distance(piece, q[lo:hi]) and x.ref_bases == hi - lo
