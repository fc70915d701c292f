"""Whole-table queries at sizes where counts are large and sites dense."""

import inspect
from fractions import Fraction

import duckdb
import pytest
from strandflow.queries import catalog, decision
from test_queries import rows_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["adoption_rule", "mcnemar", "phase_evidence"])
def test_whole_table(spark, name):
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    df = catalog.queries()[name](spark, SF)
    found = c.execute(catalog.oracle_sql()[name])
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of([d[0] for d in found.description], found.fetchall())


def test_exact_p_of_large_counts(spark):
    from strandflow.functions.stats import mcnemar_exact

    counts = [(10_050, 9_950), (20_300, 19_900), (12_000, 12_000), (0, 30_000), (3, 1)]
    got = spark.createDataFrame(counts, "b long, c long").withColumn("p", mcnemar_exact("b", "c")).collect()
    for r in got:
        n, term, tail = r.b + r.c, 1, 0
        for j in range(min(r.b, r.c) + 1):
            tail += term
            term = term * (n - j) // (j + 1)
        assert r.p == pytest.approx(float(min(Fraction(1), Fraction(2 * tail, 1 << n))), rel=1e-6, abs=1e-12)


def test_phase_split_has_the_operators_limits():
    assert "ReadSettings(" not in inspect.getsource(decision.phase_split)
