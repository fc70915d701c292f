"""Consensus backends, partial reads in the consensus, and drafts of poor reads."""

import random

import pytest

from strandflow import dictionary
from strandflow.config import ReadSettings
from strandflow.functions import align
from strandflow.functions.consensus import Graph, backend, consensus, medoid, partial_order
from strandflow.operators import phase, segment

WORDS = dictionary.default()
TRUTH = "".join(WORDS.units[u] for u in ["1", "2", "3", "4", "5", *"XXABXXCX", "6", "7", "8", "9"])


def noisy(text, err, rng):
    return "".join(c if rng.random() > err else rng.choice(["", c + rng.choice("ACGT"), rng.choice("ACGT")]) for c in text)


def test_poor_reads_give_the_units_where_the_medoid_does_not():
    rng = random.Random(1)
    reads = [noisy(TRUTH, 0.08, rng) for _ in range(24)]
    labels = lambda seq: [u["label"] for u in segment.segment(seq, WORDS)]
    whole = labels(TRUTH)
    graph, single = partial_order(reads), medoid(reads)
    assert align.edit_distance(graph, TRUTH) <= 3 and align.edit_distance(single, TRUTH) > 30
    assert sum(a == b for a, b in zip(labels(graph), whole)) >= len(whole) - 2 and labels(single) != whole


def test_graph_is_exact_where_reads_agree():
    rng = random.Random(2)
    for _ in range(20):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 200)))
        assert partial_order([seq] * 3) == seq
        edited = [seq] * 5
        for k in range(2):
            i = rng.randrange(len(seq))
            edited[k] = seq[:i] + rng.choice(["", "A", "CG"]) + seq[i + 1 :]
        assert partial_order(edited) == seq
    assert partial_order([]) == "" and partial_order(["", "A"]) == "A" and medoid([]) == ""
    assert partial_order(["AAAATTTTGGGGCCCC" * 4] * 4 + ["C" * 20]) == "AAAATTTTGGGGCCCC" * 4


def test_alignment_to_a_chain_has_the_least_edits():
    import numpy as np

    rng = random.Random(3)
    for _ in range(40):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 60)))
        b = noisy(a, 0.2, rng) or "A"
        graph, read = Graph(), np.frombuffer(a.encode(), np.uint8)
        graph.thread(read, [(-1, i) for i in range(len(a))])
        path, edits = graph.align(np.frombuffer(b.encode(), np.uint8), 64)
        assert edits == align.edit_distance(a, b)
        assert [i for _, i in path if i >= 0] == list(range(len(b)))


def test_backends_are_named(spark):
    assert backend("medoid") is medoid
    with pytest.raises(ValueError, match="unknown consensus backend"):
        ReadSettings(consensus="other")
    with pytest.raises(ValueError):
        consensus("other")
    rows = [(k, s) for k, own in (("a", ["ACGTACGT", "ACGTACG", "ACGTACGT", None]), ("b", ["TTTT"])) for s in own]
    df = spark.createDataFrame(rows, "k string, s string")
    got = {r.k: r.c for r in df.groupBy("k").agg(consensus()("s").alias("c")).collect()}
    assert got == {"a": "ACGTACGT", "b": "TTTT"}


def test_partial_reads_vote_where_they_cover(spark):
    """Three spanning reads share an error that many partial reads don't have."""
    rng = random.Random(5)
    at = 500
    wrong = TRUTH[:at] + TRUTH[at + 1 :]
    cons = phase.polish(wrong, [wrong] * 3, ReadSettings())
    assert cons == wrong
    partial = [noisy(TRUTH[a : a + 600], 0.01, rng) for a in [0, 100, 200, 300, 350, 400] * 5]
    assert phase.polish(wrong, [wrong] * 3, ReadSettings(), partial) == TRUTH
    # a read that ends, or begins, at a place says nothing about what is inserted there
    ends = [TRUTH[:at] + "ACG"] * 9
    laid = align.lay(ends, TRUTH, True)
    assert phase.pileup(TRUTH, [align.lay([TRUTH] * 3, TRUTH), laid], ReadSettings())[:at] == TRUTH[:at]
    alleles = spark.createDataFrame([("s", "allele_1", wrong), ("s", "allele_2", TRUTH)], "sample string, allele string, seq string")
    members = spark.createDataFrame([("s", "allele_1", i, wrong) for i in range(3)], "sample string, allele string, ord long, seq string")
    some = spark.createDataFrame([("s", "allele_1", 10 + i, q) for i, q in enumerate(partial)], "sample string, allele string, ord long, seq string")
    got = {r.allele: r.seq for r in phase.refine(alleles, members, some).collect()}
    assert got == {"allele_1": TRUTH, "allele_2": TRUTH}


def test_partial_reads_are_turned_and_cut(spark):
    from strandflow.operators.reads import inside

    left, right = WORDS.left[-50:], WORDS.right[:50]
    seqs = [left + TRUTH[:700], align.revcomp(left + TRUTH[:700]), TRUTH[300:] + right, TRUTH[200:900], "ACGT" * 100]
    categories = spark.createDataFrame([("s", i, "left", q) for i, q in enumerate(seqs)], "sample string, ord long, category string, seq string")
    assigned = spark.createDataFrame([("s", i, "off_target" if i == 4 else "allele_1", "-" if i == 1 else "+") for i in range(5)], "sample string, ord long, assigned string, strand string")
    got = {r.ord: r.seq for r in inside(assigned, categories).collect()}
    assert got == {0: TRUTH[:700], 1: TRUTH[:700], 2: TRUTH[300:], 3: TRUTH[200:900]}


def test_reads_of_few_errors_go_straight_and_alike(monkeypatch):
    rng, plain = random.Random(5), Graph.align
    groups = [[noisy(text, err, rng) for _ in range(5)] for text in ("ACGT" * 9, TRUTH[:90], "AAAACCCCAAAA") for err in (0.0, 0.02, 0.1) for _ in range(4)]
    found = [partial_order(g) for g in groups]
    wrong = [TRUTH[:k] + ("A" if TRUTH[k] != "A" else "C") + TRUTH[k + 1 :] for k in (7, 300, 44)]
    monkeypatch.setattr(Graph, "align", lambda self, read, half: pytest.fail("aligned in full"))
    assert partial_order(wrong) == TRUTH
    monkeypatch.setattr(Graph, "align", plain)
    monkeypatch.setattr(Graph, "align_straight", lambda self, read: None)
    assert found == [partial_order(g) for g in groups]


def test_groups_of_a_grouping_stay_spread(spark):
    from pyspark.sql import functions as F
    from strandflow.operators.joins import spread

    made = spark.range(400).groupBy("id").agg(F.lit("x").alias("x"))
    assert spread(made, "id").select(F.spark_partition_id()).distinct().count() > 1


def test_an_empty_read_is_all_gaps():
    laid = align.lay(["", "ACG", ""], "ACG")
    assert laid.has.tolist() == [[False] * 3, [True] * 3, [False] * 3] and laid.begin.tolist() == [[0] * 4, [0, 1, 2, 3], [0] * 4]
