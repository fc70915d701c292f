import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandflow.functions.align import edit_distance
from strandflow.operators import cohort as C

A, B, D = "ACGTACGTAA", "ACGTTCGTAA", "GGGGCCCCTTTTAAAA"


def tables(spark, runs, truths, anchors, calls):
    return (
        spark.createDataFrame(runs, "run string, sample string, validated boolean, callable boolean"),
        spark.createDataFrame(truths, "sample string, t int, seq string"),
        spark.createDataFrame(anchors, "sample string, left string, right string"),
        spark.createDataFrame(calls, "run string, p int, seq string, independent boolean, origin string"),
    )


def test_every_run_has_a_row(spark):
    runs = [("ok", "s", True, True), ("swap", "s", True, True), ("one", "s", True, True), ("off", "s", True, False), ("failed", "s", False, False), ("none", "s", True, True), ("odd", "s", True, True), ("bare", "x", True, True), ("null", None, None, None)]
    calls = [("ok", 0, A, True, "h1"), ("ok", 1, D, True, "h2"), ("swap", 0, D.lower(), True, "h1"), ("swap", 1, A, True, "h2"), ("one", 0, B, True, "h1"), ("off", 0, A, True, "h1"), ("off", 1, D, True, "h2"), ("failed", 0, A, True, "h1"), ("odd", 0, "AC-T", True, "h1"), ("bare", 0, A, True, "h1")]
    rows = {r.run: r for r in C.compared(*tables(spark, runs, [("s", 0, A), ("s", 1, D)], [], calls)).collect()}
    assert set(rows) == {r[0] for r in runs}
    assert {n: r.reason for n, r in rows.items()} == {"ok": None, "swap": None, "one": None, "off": None, "failed": C.NO_RUN, "none": C.NO_SEQUENCES, "odd": C.NO_SEQUENCES, "bare": C.NO_TRUTH, "null": C.NO_TRUTH}
    for n in ("ok", "swap"):
        r = rows[n]
        assert (r.sequence_equal, r.literal_sequence_equal, r.distance, r.ways, r.literal_exact, r.independent_exact, r.length_errors) == (True, True, 0, 1, 2, 2, [0, 0])
    assert (rows["one"].distance, rows["one"].literal_exact, rows["one"].length_errors, rows["one"].sequence_length_equal) == (1, 0, None, False)
    assert (rows["off"].sequence_equal, rows["off"].literal_sequence_equal, rows["off"].literal_exact, rows["off"].independent_exact) == (False, True, 2, 0)
    assert rows["failed"].sequence_equal is None and rows["failed"].independent_exact is None


def test_copies_count_once_unless_proven(spark):
    truths = [("s", 0, A), ("s", 1, A)]
    runs = [(n, "s", True, True) for n in ("proven", "unproven", "one_origin", "no_origin")]
    calls = [("proven", 0, A, True, "h1"), ("proven", 1, A, True, "h2"), ("unproven", 0, A, True, "h1"), ("unproven", 1, A, False, "h2"), ("one_origin", 0, A, True, "h"), ("one_origin", 1, A, True, "h"), ("no_origin", 0, A, True, None), ("no_origin", 1, A, True, None)]
    rows = {r.run: (r.sequence_equal, r.literal_sequence_equal, r.literal_exact, r.independent_exact, r.ways) for r in C.compared(*tables(spark, runs, truths, [], calls)).collect()}
    assert rows == {"proven": (True, True, 2, 2, 2), "unproven": (False, True, 2, 1, 2), "one_origin": (False, True, 2, 1, 2), "no_origin": (False, True, 2, 1, 2)}


def test_anchors_cut_both_sides_or_say_why_not(spark):
    truth = "TT" + "GATTACA" + "CCC" + "CATCAT" + "G"
    runs = [(n, "s", True, True) for n in ("cut", "twice", "turned", "absent")]
    calls = [("cut", 0, "AAAAGATTACACCCCATCATTTTT", True, "h"), ("twice", 0, "GATTACAGATTACACCATCAT", True, "h"), ("turned", 0, "CATCATCCGATTACA", True, "h"), ("absent", 0, "CCCCATCAT", True, "h")]
    rows = {r.run: r for r in C.compared(*tables(spark, runs, [("s", 0, truth)], [("s", "gattaca", "CATCAT")], calls)).collect()}
    assert rows["cut"].sequence_equal and [tuple(i) for i in rows["cut"].intervals] == [(0, 4, 20)]
    assert {n: rows[n].reason for n in ("twice", "turned", "absent")} == {"twice": C.NOT_ONCE, "turned": C.NOT_ORDERED, "absent": C.NOT_ONCE}


def test_truths_that_cannot_serve_are_errors(spark):
    runs, calls = [("r", "s", True, True)], [("r", 0, A, True, "h")]
    with pytest.raises(Exception, match="truth without plain DNA: s"):
        C.compared(*tables(spark, runs, [("s", 0, "ACGN")], [], calls)).collect()
    with pytest.raises(Exception, match="truth can't be cut: s"):
        C.compared(*tables(spark, runs, [("s", 0, A)], [("s", "GGG", "TTT")], calls)).collect()


def test_assignments_against_all_permutations(spark):
    rng = random.Random(3)
    truths, calls, want = [], [], {}
    for k in range(40):
        word = lambda: "".join(rng.choice("AC") for _ in range(rng.randrange(1, 4)))
        t, p = [word() for _ in range(rng.randrange(1, 4))], [word() for _ in range(rng.randrange(0, 5))]
        own = [rng.random() < 0.5 for _ in p]
        truths += [(k, i, v) for i, v in enumerate(t)]
        calls += [(k, i, v, o) for i, (v, o) in enumerate(zip(p, own))]
        n, ways = min(len(t), len(p)), []
        for ts in itertools.combinations(range(len(t)), n):
            for ps in itertools.permutations(range(len(p)), n):
                pairs = list(zip(ts, ps))
                ways.append((sum(edit_distance(t[i], p[j]) for i, j in pairs), sum(t[i] == p[j] for i, j in pairs), sum(t[i] == p[j] and own[j] for i, j in pairs)))
        best = [w for w in ways if w[0] == min(w[0] for w in ways)]
        want[k] = (best[0][0], len(best), min(w[1] for w in best), min(w[2] for w in best))
    got = C.best_assignments(spark.createDataFrame(truths, "k int, t int, value string"), spark.createDataFrame(calls, "k int, p int, value string, recoverable boolean"), "k").collect()
    assert {r.k: (r.distance, r.ways, r.literal_exact, r.independent_exact) for r in got} == want


def test_anchors_stay_unique_for_every_key(spark, tmp_path):
    """The sequence of customer 31132 begins or ends so that short anchors occur in it once more."""
    import duckdb
    from strandflow.queries import profile

    folder, duck = str(tmp_path), duckdb.connect()
    spark.createDataFrame([(31132,), (31133,)], "c_custkey long").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(n, 31132, "F") for n in range(1, 12)], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{folder}/orders.parquet")
    for t in ("customer", "orders"):
        duck.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df, found = profile.cohort_compared(spark, folder), duck.execute(profile.R.oracles["cohort_compared"])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())
