"""Alleles of a reference ladder where one cluster of contigs hides two."""

import random

from strandflow.operators.ladder import alleles_of_ladder

SCHEMA = "sample string, read string, units int, score int, indel int, length int, flag int"


def records(sample, alleles, reach=1, lengths=True, seed=1):
    """Each read has a primary record on its own contig and others on the contigs around it, which fit worse."""
    rng = random.Random(seed)
    out = []
    for units, n in alleles:
        for i in range(n):
            for off in range(-reach, reach + 1):
                length = 30 + 60 * ((units if lengths else alleles[0][0]) + 9) + rng.choice([0, 1, 2])
                out.append((sample, f"{units}-{i}", units + off, 3000 - 60 * abs(off) + rng.choice([0, 1]), 60 * abs(off), length, 0 if off == 0 else 256))
    return out


def test_two_alleles_within_one_cluster(spark):
    rows = records("far", [(40, 30), (60, 20)])
    rows += records("next", [(40, 40), (41, 25)])
    rows += records("valley", [(40, 40), (46, 25)], lengths=False)
    rows += records("single", [(50, 50)])
    rows += records("minority", [(40, 60), (70, 5)])
    rows += records("weak", [(40, 60), (70, 2)])
    # a second mode of read lengths without reads that fit its contig better
    rows += [(s, r, u, 3000 - 60 * abs(u - 40), i, n + (60 if int(r.split("-")[1]) % 2 else 0), f) for s, r, u, _, i, n, f in records("bent", [(40, 40)])]
    got = {r["sample"]: (r.basis, r["first"], r.second) for r in alleles_of_ladder(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        "far": ("clusters", 40, 60), "next": ("read_length", 40, 41), "valley": ("indel_valley", 40, 46), "single": ("single", 50, None),
        "minority": ("minority", 40, 70), "weak": ("single", 40, None), "bent": ("single", 40, None),
    }


def test_no_records(spark):
    assert alleles_of_ladder(spark.createDataFrame([], SCHEMA)).collect() == []
    few = records("s", [(40, 3)])
    assert alleles_of_ladder(spark.createDataFrame(few, SCHEMA)).collect() == []
