"""What a task holds, and what is worked out once, in queries over large tables."""

import math
import re
from collections import Counter

from strandflow.operators import lengths as L


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _grid(spans, s=L.LengthSettings()):
    """All grid points of one sample by the definition: place to density."""
    n = Counter(spans)
    lo, hi = min(n) - s.margin_bp, max(n) + s.margin_bp
    found = {}
    for i in range((hi - lo) // s.grid_bp + 1):
        x = lo + i * s.grid_bp
        near = [(c, (x - length) / (s.bandwidth_bp + s.bandwidth_share * length)) for length, c in sorted(n.items())]
        terms = [c * math.exp(-0.5 * z * z) for c, z in near if abs(z) <= s.kernel_reach]
        if terms:
            found[x] = sum(terms)
    return found


# lengths that crowd, lie alone, and whose peaks fall on either side of a block's end
SPANS = {"a": [900] * 5 + [903, 960, 1500], "b": list(range(700, 1100, 7)), "c": [63, 64, 5000, 5001, 5064], "d": [1200]} | {f"e{k}": [800, 800 + k, 1400] for k in range(60, 130)}


def _spans(spark):
    return spark.createDataFrame([(k, x) for k, v in SPANS.items() for x in v], "sample string, length long")


def test_density_gathers_no_grid_points(spark):
    df = L.density(_spans(spark))
    got = {}
    for r in df.collect():
        got.setdefault(r["sample"], {})[r["x"]] = r["d"]
    for k, spans in SPANS.items():
        want = _grid(spans)
        assert got[k].keys() == want.keys()
        assert all(math.isclose(got[k][x], want[x], rel_tol=1e-9) for x in want)
    # grid points are opened last, and nothing is grouped after that
    assert "Aggregate" not in plan(df).split("Generate")[0]


def test_maxima_sort_no_grid_points(spark):
    df = L.maxima(_spans(spark))
    got = {r["sample"]: r["centers"] for r in df.collect()}
    for k, spans in SPANS.items():
        d = _grid(spans)
        peaks = sorted((-round(v, 9), x) for x, v in d.items() if v >= d.get(x - 2, 0) and v > d.get(x + 2, 0))
        kept = []
        for _, x in peaks:
            if all(abs(x - q) >= 42 for q in kept):
                kept.append(x)
        assert got[k] == kept
    assert "Window" not in plan(df).split("Generate")[0]


def _grid_steps(df):
    """Steps of a plan that group or order rows by grid point."""
    return [x for x in plan(df).split("\n") if re.search(r"\b(Aggregate|Window|Sort) ", x) and re.search(r"\bi#\d+", x)]


def test_kde_peaks_orders_no_grid_points(spark, sf):
    from strandflow.queries import catalog

    assert _grid_steps(catalog.queries()["kde_peaks"](spark, sf)) == []


def test_length_candidates_order_no_grid_points(spark, sf):
    from strandflow.queries import catalog

    assert _grid_steps(catalog.queries()["length_candidates"](spark, sf)) == []


def test_smear_sorts_no_pairs_of_candidates_and_lengths(spark):
    assert "RangeFrame" not in plan(L.length_model(_spans(spark)))


def test_equal_reads_are_measured_once(monkeypatch):
    import pandas as pd
    from strandflow.operators import profile as P

    source = "ACGTTGCAAC" * 12
    reads = [source[:120], source[:50] + source[51:120], source[:120], source[:50] + source[51:120], source[:60] + "T" + source[60:120]]
    rows = pd.DataFrame({"case": "c", "read_id": [f"r{i}" for i in range(5)], "kind": "full", "hap": 0, "strand": "+", "src_start": 0, "src_end": 120, "seq": reads, "source": source, "lo": 20, "hi": 100, "overlapping": True, "spanning": True})
    alone = [P._measure(rows.iloc[[i]], P.ProfileSettings()).iloc[0].to_dict() for i in range(5)]
    looked, hits = [], P.infix_hits
    monkeypatch.setattr(P, "infix_hits", lambda anchor, texts, k: looked.append(len(texts)) or hits(anchor, texts, k))
    got = P._measure(rows, P.ProfileSettings())
    assert [r.to_dict() for _, r in got.astype(object).iterrows()] == [pd.Series(x).astype(object).to_dict() for x in alone]
    assert max(looked) == 3


def _islands(sites):
    out = []
    for key, start, end in sorted(sites):
        if out and out[-1][0] == key and start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([key, start, end])
    return sorted(map(tuple, out))


def test_tasks_of_islands_follow_the_rows(spark, monkeypatch):
    from pyspark.sql import functions as F
    from strandflow.operators import aggregates, joins

    sites = [(i % 37, i * 7919 % 5003, i * 7919 % 5003 + i % 11) for i in range(2000)]
    df = spark.createDataFrame(sites, "gene long, start long, end long")
    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    numbered = aggregates.touching(df, ["gene"])
    assert numbered.rdd.getNumPartitions() == 20
    got = numbered.groupBy("gene", "event").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("event")
    assert sorted(map(tuple, got.collect())) == _islands(sites)


def test_tasks_of_exons_follow_the_rows(spark, monkeypatch):
    from strandflow.operators import joins, quality

    sites = [(i % 37, i * 7919 % 5003, i * 7919 % 5003 + i % 11) for i in range(2000)]
    df = spark.createDataFrame(sites, "gene long, start long, end long")
    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    merged = quality.merged_exons(df.where("start > 50"), df.where("start <= 50"))
    assert merged.rdd.getNumPartitions() == 20
    assert sorted(map(tuple, merged.select("gene", "start", "end").collect())) == _islands(sites)


def _split(text):
    """Letter by letter, by the definition."""
    depth, out = 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        out += "\x01" if c == ";" and depth == 0 else c
    return [x.replace("\x01", ";") for x in out.split("\x01 ")]


def test_reasons_are_read_once_and_split_without_folding(spark):
    import random

    from pyspark.sql import functions as F
    from strandflow.functions import sequence as S

    draw = random.Random(3)
    texts = ["", "a", "a; b", "a (b; c); d", "a;; b;", "; ", "(a; b", "a); b", "((a; b); c); d", "a;b; (c;d)\n; e", "x\x01 y; z"] + ["".join(draw.choice("a;; ()(") for _ in range(draw.randint(1, 14))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts + [None]], "t string").select("t", S.split_top("t").alias("s")).collect()
    for r in rows:
        assert r["s"] == (None if r["t"] is None else _split(r["t"]))
    reasons = ["Allele_1: Dup at 5.5 is inconclusive (few reads (3 seen); None given; (x (y; z)); low)", "plain; reason 7.", None, "A is inconclusive ()"]
    df = spark.createDataFrame([(x,) for x in reasons], "r string").select(S.reason_keys("r").alias("k"))
    head = "dup at # is inconclusive: "
    assert [r["k"] for r in df.collect()] == [[head + x for x in ("few reads (# seen)", "# given", "(x (y; z))", "low")], ["plain; reason #"], [None], ["a is inconclusive: "]]
    # the patterns of a key are looked for once
    assert df._jdf.queryExecution().optimizedPlan().toString().count("is inconclusive") <= 3
    assert df._jdf.queryExecution().optimizedPlan().toString().count("allele[ _]") == 1


def test_equal_reads_are_searched_once(spark, monkeypatch):
    import pandas as pd
    from strandflow.config import ReadSettings
    from strandflow.dictionary import default
    from strandflow.operators import reads as R

    words = default()
    seq = words.left[-40:] + "".join(words.units[u] for u in "12345X6789") + words.right[:40]
    other = R.revcomp(seq)
    given = [(seq, "5" * len(seq)), (other, "5" * len(seq)), (seq, "5" * len(seq)), (seq, "9" * len(seq)), (seq[:300], "5" * 300), (other, "5" * len(seq))]
    pdf = pd.DataFrame([("s", i, f"r{i}", q, p) for i, (q, p) in enumerate(given)], columns=["sample", "ord", "name", "seq", "qual"])
    want = [x for q, p in given for x in R._categorize([q], [p], words, ReadSettings())]
    asked, real = [], R._categorize
    monkeypatch.setattr(R, "_categorize", lambda seqs, quals, *rest: asked.append(len(seqs)) or real(seqs, quals, *rest))

    class Rows:
        def select(self, *names):
            return self

        def mapInPandas(self, work, schema):
            return pd.concat(work([pdf]))

    got = R.categorize(Rows())
    columns = ["category", "seq", "mean_q", "strand", "edits", "basis", "length"]
    assert got["ord"].tolist() == list(range(6))
    assert [tuple(None if pd.isna(x) else x for x in r) for r in got[columns].itertuples(index=False)] == want
    assert asked == [4]


class _Rows:
    """Stands for a frame, whose one batch goes through a Python stage."""

    columns = ["sample"]

    def __init__(self, pdf):
        self.pdf = pdf

    def __getattr__(self, name):
        return lambda *args, **more: self

    def mapInPandas(self, work, schema):
        import pandas as pd

        return _Rows(pd.concat(work([self.pdf])))


def test_equal_reads_are_compared_once_after_the_scan(spark, monkeypatch):
    import pandas as pd
    from strandflow.dictionary import default
    from strandflow.functions import align
    from strandflow.operators import phase as P
    from strandflow.operators import reads as R

    words = default()
    one, two = ("".join(words.units[u] for u in order) for order in ("12345XX6789", "12345XXXX6789"))
    joined = one + two
    searched, hits = [], align.infix_hits
    monkeypatch.setattr(align, "infix_hits", lambda query, texts, k: searched.append(len(texts)) or hits(query, texts, k))
    monkeypatch.setattr(R, "infix_hits", align.infix_hits)

    def rows(found, columns):
        return [tuple(None if pd.isna(x) else x for x in r) for r in found.pdf[columns].itertuples(index=False)]

    # joined spans
    seqs = [joined, one, joined, two, one, joined]
    pdf = pd.DataFrame({"sample": "s", "ord": range(6), "seq": seqs})
    got = rows(L.junctions(_Rows(pdf.copy()), words), ["ord", "first_bp", "second_bp"])
    alone = [rows(L.junctions(_Rows(pdf.iloc[[i]].copy()), words), ["ord", "first_bp", "second_bp"])[0] for i in range(6)]
    assert got == alone and got[0][1:] == (len(one), len(two)) and got[1][1:] == (None, None)
    assert searched[:2] == [3, 3]

    # partial reads against alleles, with two samples whose alleles differ
    asked, distance = [], R.infix_distance
    monkeypatch.setattr(R, "infix_distance", lambda a, b: asked.append(1) or distance(a, b))
    refs = {"s": [{"allele": "a", "seq": one}, {"allele": "b", "seq": two}], "t": [{"allele": "c", "seq": two}]}
    given = [("s", two[200:500]), ("t", two[200:500]), ("s", R.revcomp(one[:400])), ("s", two[200:500]), ("s", "ACGT" * 50), ("t", two[200:500])]
    pdf = pd.DataFrame({"sample": [x for x, _ in given], "ord": range(6), "seq": [q for _, q in given], "refs": [refs[x] for x, _ in given]})
    names = ["sample", "ord", "assigned", "strand", "distance"]
    alone = [rows(_assigned(R, pdf.iloc[[i]]), names)[0] for i in range(6)]
    asked.clear()
    assert rows(_assigned(R, pdf), names) == alone
    assert len(asked) == 3 * 4 + 2

    # partial reads inside an allele
    pdf = pd.DataFrame({"sample": "s", "allele": "a", "ord": range(5), "seq": [one[:300], R.revcomp(one[:300]), one[:300], one[70:200], one[:300]], "_turn": ["+", "-", "+", "+", "-"]})
    work = _work(R.inside, _Rows(pdf), _Rows(pdf), words)
    alone = [work([pdf.iloc[[i]]])[0]["seq"].iloc[0] for i in range(5)]
    searched.clear()
    assert work([pdf])[0]["seq"].tolist() == alone
    assert searched == [4, 4]

    # reads against the groups of their peak
    asked, edits = [], P.edit_distance
    monkeypatch.setattr(P, "edit_distance", lambda a, b: asked.append(1) or edits(a, b))
    groups = [{"group": 0, "cons": one}, {"group": 1, "cons": one[:100] + "T" + one[101:]}]
    seqs = [one, groups[1]["cons"], one, one[:100] + one[101:], one]
    pdf = pd.DataFrame({"sample": "s", "peak": 660, "ord": range(5), "seq": seqs, "groups": [groups] * 5})
    work = _work(P.members, _Rows(pdf), _Rows(pdf))
    found = work([pdf])[0]["group"]
    assert [None if pd.isna(x) else x for x in found] == [0, 1, 0, None, 0]
    assert len(asked) == 3 * 2


def _assigned(R, pdf):
    return _Rows(_work(R.assign, _Rows(pdf), _Rows(pdf))([pdf])[0])


def _work(operator, *frames):
    """An operator's Python stage as a function of batches."""
    stages = []
    real = _Rows.mapInPandas
    _Rows.mapInPandas = lambda self, work, schema: stages.append(work) or self
    try:
        operator(*frames)
    finally:
        _Rows.mapInPandas = real
    return lambda batches: list(stages[0](batches))


def test_percentiles_sort_only_what_is_near(spark, monkeypatch):
    import numpy as np
    from strandflow.operators import aggregates as A

    draw = np.random.default_rng(5)
    groups = {"a": draw.normal(size=5001).round(2).tolist(), "b": [7.0] * 40, "c": [3.5], "d": draw.lognormal(3, 4, 3000).tolist() + [None] * 5, "e": [None], None: [1.0, 2.0, 4.0]}
    df = spark.createDataFrame([(k, v) for k, x in groups.items() for v in x], "g string, v double").repartition(3)
    shares = {"least": 0.0, "low": 0.025, "mid": 0.5, "high": 0.975, "most": 1.0}

    def check():
        got = {r["g"]: r for r in A.percentiles(df, ["g"], "v", shares).collect()}
        assert got.keys() == groups.keys()
        for k, x in groups.items():
            x = [v for v in x if v is not None]
            for name, share in shares.items():
                assert (got[k][name] is None) if not x else abs(got[k][name] - np.percentile(x, 100 * share)) <= 1e-9 * max(1, abs(got[k][name]))

    check()
    plan_of = A.percentiles(df, ["g"], "v", shares)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan_of
    # bounds that are off in either direction only make it sort more
    real = A.F.percentile_approx
    for off in (-2.0, 2.0):
        monkeypatch.setattr(A.F, "percentile_approx", lambda c, p, n, off=off: A.F.transform(real(c, p, n), lambda x: x + off))
        check()
