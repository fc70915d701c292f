"""Names of edits on a unit, in closed forms.

An insertion or deletion can slide along its unit as far as the unit repeats the edit's own bases; the
distance is the longest common prefix of the edit's bases, repeated, with what follows (and, for the other
direction, of both reversed). So no step by step walk is needed.
Positions are 1-based and inclusive; an insertion has end = start - 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import col, common_prefix

# Names of variants known from the literature.
KNOWN = (
    "59dupC",
    "56_59dupCCCC",
    "58_59insG",
    "60dupA",
    "55delinsAT",
    "54_56delinsAT",
    "1_5delGCCCA",
    "30_31insCAGGCCGGCCCCGGGCTCCGGACAC",
    "23dupC",
    "57_58insG",
    "53_54insG",
    "54dupG",
    "53_54insA",
)


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _edit(start, end, inserted) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), inserted.alias("inserted"))


def trim_edit(unit, start, end, inserted) -> Column:
    """The edit without the bases that deletion and insertion share at the front, then at the back."""
    unit, start, end, inserted = map(col, (unit, start, end, inserted))

    def front(x: Column) -> Column:
        k = common_prefix(x["d"], x["i"])
        n = F.length(x["d"]) + F.length(x["i"])
        return F.struct(F.substring(x["d"], k + 1, n).alias("d"), F.substring(x["i"], k + 1, n).alias("i"), k.alias("k"))

    def back(x: Column) -> Column:
        k = common_prefix(F.reverse(x["d"]), F.reverse(x["i"]))
        return F.struct((F.length(x["d"]) - k).alias("d"), F.substring(x["i"], F.lit(1), F.length(x["i"]) - k).alias("i"), x["k"].alias("k"))

    deleted = F.substring(unit, start, F.greatest(end - start + 1, F.lit(0)))
    return _bind(_bind(_bind(F.struct(deleted.alias("d"), inserted.alias("i")), front), back), lambda x: _edit(start + x["k"], start + x["k"] + x["d"] - 1, x["i"]))


def _slide(unit: Column, e: Column, forward: bool) -> Column:
    """How far a pure insertion or deletion can move."""
    own = F.when(e["inserted"] != "", e["inserted"]).otherwise(F.substring(unit, e["start"], e["end"] - e["start"] + 1))
    if forward:
        rest = F.substring(unit, e["end"] + 1, F.length(unit))
    else:
        own, rest = F.reverse(own), F.reverse(F.substring(unit, F.lit(1), e["start"] - 1))
    return F.when((own == "") | (e["inserted"] != "") & (e["end"] >= e["start"]), 0).otherwise(common_prefix(F.repeat(own, F.length(rest)), rest))


def _moved(e: Column, k: Column) -> Column:
    """The edit ``k`` bases on; what is inserted turns with it."""
    n = F.length(e["inserted"])
    turn = F.when(n > 0, F.pmod(k, n)).otherwise(0)
    return _edit(e["start"] + k, e["end"] + k, F.concat(F.substring(e["inserted"], turn + 1, n), F.substring(e["inserted"], F.lit(1), turn)))


def normalise(unit, start, end, inserted) -> Column:
    """The edit at its 3'-most place; a delins stays. Outside the unit it is left as it is."""
    unit, start, end, inserted = map(col, (unit, start, end, inserted))
    inside = (end <= F.length(unit)) & (start >= 1)
    shifted = _bind(trim_edit(unit, start, end, inserted), lambda e: _bind(F.struct(e.alias("e"), _slide(unit, e, True).alias("k")), lambda x: _moved(x["e"], x["k"])))
    return F.when(inside, shifted).otherwise(_edit(start, end, inserted))


def ambiguity(unit, start, end, inserted) -> Column:
    """(low, high) over which the edit can be placed; null for a delins or a single place."""
    unit, start, end, inserted = map(col, (unit, start, end, inserted))

    def span(e: Column) -> Column:
        low = e["start"] - _slide(unit, e, False)
        high = F.when(e["inserted"] != "", e["start"] - 1).otherwise(e["end"]) + _slide(unit, e, True)
        return F.when(((e["inserted"] == "") | (e["end"] < e["start"])) & (high > low), F.struct(low.cast("int").alias("low"), high.cast("int").alias("high")))

    return F.when((end <= F.length(unit)) & (start >= 1), _bind(trim_edit(unit, start, end, inserted), span))


def name_edit(unit, start, end, inserted) -> Column:
    """(name, kind) of the edit: dup, ins, del, substitution or delins."""
    unit, start, end, inserted = map(col, (unit, start, end, inserted))

    def name(e: Column) -> Column:
        left, n = e["start"] - 1, F.length(e["inserted"])
        text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
        twin = (left >= n) & (F.substring(unit, left - n + 1, n) == e["inserted"])
        gone = F.substring(unit, e["start"], e["end"] - e["start"] + 1)
        span = F.when(e["start"] == e["end"], text(e["start"])).otherwise(text(e["start"], "_", e["end"]))
        insertion = (end == start - 1) | (e["end"] < e["start"])
        pair = lambda a, b: F.struct(a.alias("name"), F.lit(b).alias("kind"))
        return (
            F.when(insertion & twin & (n == 1), pair(text(left, "dup", e["inserted"]), "duplication"))
            .when(insertion & twin, pair(text(left - n + 1, "_", left, "dup", e["inserted"]), "duplication"))
            .when(insertion, pair(text(left, "_", left + 1, "ins", e["inserted"]), "insertion"))
            .when(n == 0, pair(text(span, "del", gone), "deletion"))
            .when((e["start"] == e["end"]) & (n == 1), pair(text(e["start"], gone, ">", e["inserted"]), "substitution"))
            .otherwise(pair(text(span, "delins", e["inserted"]), "delins"))
        )

    return _bind(normalise(unit, start, end, inserted), name)


def repeat_form(unit, start, end, inserted) -> Column:
    """Change of a run's copy number, as 53C[7]>53C[8]; null if the edit isn't one of a run of its base."""
    unit, start, end, inserted = map(col, (unit, start, end, inserted))

    def form(e: Column) -> Column:
        plus = e["inserted"] != ""
        own = F.when(plus, e["inserted"]).otherwise(F.substring(unit, e["start"], e["end"] - e["start"] + 1))
        base = F.substring(own, 1, 1)
        at = F.when(plus, e["start"] - 1).otherwise(e["start"])
        line = F.repeat(base, F.length(unit))
        before = common_prefix(F.reverse(F.substring(unit, F.lit(1), at)), line)
        after = common_prefix(F.substring(unit, at + 1, F.length(unit)), line)
        size, first = before + after, at - before + 1
        fits = (own != "") & (own == F.repeat(base, F.length(own))) & ~(plus & (e["end"] >= e["start"])) & (at >= 1) & (before >= 1) & (size >= 2)
        more = F.when(plus, F.length(own)).otherwise(-F.length(own))
        head = F.concat(first.cast("string"), base, F.lit("["))
        return F.when(fits, F.concat(head, size.cast("string"), F.lit("]>"), head, (size + more).cast("string"), F.lit("]")))

    return F.when((end <= F.length(unit)) & (start >= 1), _bind(trim_edit(unit, start, end, inserted), form))


def tier(name, support, sources) -> Column:
    """A: known and seen in five reads; B: seen in three; else C."""
    return F.when(col(name).isin(*KNOWN) & (col(support) >= 5) & (col(sources) >= 1), "A").when(col(support) >= 3, "B").otherwise("C")


def transcript_name(name, transcript: str = "NM_001204286.1", offset: int | None = None, unmapped: bool = False) -> Column:
    if offset is None and not unmapped:
        return F.lit("transcript_coordinate_unresolved")
    return F.concat(F.lit(f"{transcript}:c.{'' if offset is None else f'{offset}_'}"), col(name))


def repeat_relative(index, name) -> Column:
    return F.concat(F.lit("repeat_"), F.coalesce(col(index).cast("string"), F.lit("?")), F.lit(":c."), col(name))
