"""The repeat dictionary: units, event templates and flanks, as literals and as small tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Unit identifiers and sequences, in dictionary order.
UNITS = """
1 AAGGAGACTTCGGCTACCCAGAGAAGTTCAGTGCCCAGCTCTACTGAGAAGAATGCTGTG
2 AGTATGACCAGCAGCGTACTCTCCAGCCACAGCCCCGGTTCAGGCTCCTCCACCACTCAG
3 GGACAGGATGTCACTCTGGCCCCGGCCACGGAACCAGCTTCAGGTTCAGCTGCCACCTGG
4 GGACAGGATGTCACCTCGGTCCCAGTCACCAGGCCAGCCCTGGGCTCCACCACCCCGCCA
4p GGACAGGATGTCACCTCGGTCCCAGTCACCAGGCCAGCCCTGGGCTCCACCACCCCACCA
5 GCCCACGATGTCACCTCAGCCCCGGACAACAAGCCAGCCCCGGGCTCCACCGCCCCCCCA
5C GCCCACGATGTCACCTCAGCCCCGGACACCAGGCCGGCCCCGGGCTCCACCGCCCCCCAA
X GCCCACGGTGTCACCTCGGCCCCGGACACCAGGCCGGCCCCGGGCTCCACCGCCCCCCCA
A GCCCACGGTGTCACCTCGGCCCCGGAGAGCAGGCCGGCCCCGGGCTCCACCGCGCCCGCA
B GCCCACGGTGTCACCTCGGCCCCGGAGAGCAGGCCGGCCCCGGGCTCCACCGCCCCCCCA
C GCCCACGGTGTCACCTCGGCCCCGGACACCAGGCCGGCCCCGGGCTCCACCGCCCCCCAA
D GCCCACGGTGTCACCTCGGCCCCGGACACCAGGCCCGCCCCGGGCTCCACCGCCCCCCCA
E GCCCACGGTGTCACCTCGGCCCCGGACACCAGGCCCGCCCCGGGCTCCACCGCGCCCGCA
F GCCCACGGTGTCACCTCGGCCCCGGACACCAGGCCGGCCCCGGGCTCCACCGCCCCCACA
G GCCCACGGTGTCACCTCGGCCCCGGACACCAGGCCGGCCCCGGGCTCCACCGCGCCCGCA
H GCCCACGGTGTCACCTCGGCCCCGGACACCAGGCCGGCCCCGGGCTCCACCGCCGCCCCA
I GCCCACGGTGTCACCTCGGCCCCGGACACCAGGCCGGCCCCGGGCTCCACCGCGCCCCCA
J GCCCACGGTGTCACCTCGGCACCGGAGAGCAGGCCGGCCCCGGGCTCCACCGCGCCCGCA
K GCCCACGGTGTCACCTCGGCCCCGGAGAGCAGGCCGGCCCTGGGCTCCACCGCCCCCCCA
V GCCCACGGTGTCACCTCGGCCCCGGACACCAGGCCGGCCCCGGGCTCCACCGCACCCCCA
W GCCCACGGTGTCACCTCGGCCCCGGACACCAGGCCGGCCCCGGGCTCCACCGCCCCCCCG
6 GCCCACGGTGTCACCTCGGCCCCGGACACCAGGCGGGCCCCGGGCTCCACCCCGGCCCCG
6p GCCCACGGTGTCACCTCGGCCCCGGACACCAGGCCGGCCCCGGGCTCCACCCCGGCCCCG
7 GGCTCCACCGCCCCCCCAGCCCACGGTGTCACCTCGGCCCCGGACACCAGGCCGGCCCCG
8 GGCTCCACCGCCCCCCCAGCCCATGGTGTCACCTCGGCCCCGGACAACAGGCCCGCCTTG
9 GGCTCCACCGCCCCTCCAGTCCACAATGTCACCTCGGCCTCAGGCTCTGCATCAGGCTCA
L GCCCACGGTGTCACCTCAGCCCCGGACACCAGGCCGGCCCCGGGCTCCACCGCCGCCCCA
M GCCCACGGTGTCACCTCGGCACCGGACACCAGGCCGGCCCCGGGCTCCACCGCCCCCCCA
N GCCCACGGTGTCACCTCGGCCCCGGAGAGCAGGCCGGCCACGGGCTCCACCGCCCCCCCA
O GCCCACGGTGTCACCTCGGCCCCGGACACCAGGCCGGCCCCAGGCTCCACCGCCCCCCCA
P GCCCACGGTGTCACCTCGGCCCCGGACACCAGGCCAGCCCCGGGCTCCACCGCCCCCCCA
Q GCCCACAGTGTCACCTCGGCCCCGGACACCAGGCCGGCCCCGGGCTCCACCGCCCCCCCA
R GCCCACGGTGTCACCTCGGGCACGGACACCAGGCCGGCCCCGGGCTCCACCGCCCCCCCA
S GCCCACGGTGTCACCTCAGCCCCGGAGAGCAGGCCGGCCCCGGGCTCCACCGCCCCCGCA
"""

# Event templates as name | allowed units | change type | start | end | sequence.
TEMPLATES = """
dupC | 5 X B D K W M N O P Q R | insert | 60 |  | C
dupA | X | insert | 60 |  | A
insG | X | insert | 59 |  | G
insCCCC | X | insert | 60 |  | CCCC
insC_pos23 | A E | insert | 23 |  | C
insG_pos58 | B X | insert | 58 |  | G
insG_pos54 | B J | insert | 54 |  | G
insA_pos54 | A H | insert | 54 |  | A
del18_31 | X | delete | 18 | 31 | 
ins16bp | C | insert | 57 |  | GGGCTCCACCGCCCCC
ins25bp | A B J K N S X | insert | 31 |  | CAGGCCGGCCCCGGGCTCCGGACAC
delinsAT | X | delete_insert | 54 | 56 | AT
delGCCCA | 5 5C 6 6p A B C D E F G H I J K L M N O V W X | delete | 1 | 5 | 
"""

# The bases next to the first and the last unit.
LEFT_FLANK = "TTATTTTTCCTTCATAAAGACCCAACCCTATGACTTTAACTTCTTACAGCTACCACAGCCCCTAAACCCGCAACAGTTGTTACGGGTTCTGGTCATGCAAGCTCTACCCCAGGTGGAGAA"
RIGHT_FLANK = "GCTTCTACTCTGGTGCACAACGGCACCTCTGCCAGGGCTACCACAACCCCAGCCAGCAAGAGCACTCCATTCTCAATTCCCAGCCACCACTCTGATACTCCTACCACCCTTGCCAGCCAT"

# Roles of units.
PRE_UNITS = ('1', '2', '3', '4', '4p', '5', '5C')
AFTER_UNITS = ('6', '6p', '7', '8', '9')
CANONICAL = "X"
UNIT_BP = 60


@dataclass(frozen=True)
class Template:
    name: str
    allowed: tuple[str, ...]
    kind: str
    start: int
    end: int | None
    bases: str

    @property
    def net(self) -> int:
        """Signed change of length."""
        if self.kind == "insert":
            return len(self.bases)
        if self.kind == "delete":
            return self.start - self.end - 1
        return len(self.bases) - (self.end - self.start - 1)  # both bounds are kept

    def apply(self, unit: str) -> str:
        if self.kind == "insert":  # before the 1-based position
            return unit[: self.start - 1] + self.bases + unit[self.start - 1 :]
        if self.kind == "delete":
            return unit[: self.start - 1] + unit[self.end :]
        return unit[: self.start] + self.bases + unit[self.end - 1 :]


@dataclass(frozen=True)
class Dictionary:
    units: dict[str, str]
    templates: tuple[Template, ...]
    pre: tuple[str, ...] = PRE_UNITS
    after: tuple[str, ...] = AFTER_UNITS
    canonical: str = CANONICAL
    left: str = LEFT_FLANK
    right: str = RIGHT_FLANK
    unit_bp: int = UNIT_BP
    mutated: dict[str, tuple[str, str]] = field(init=False, compare=False)

    def __post_init__(self):
        # of templates that give the same sequence the last one names it
        made = {t.apply(self.units[u]): (u, t.name) for t in self.templates for u in t.allowed if u in self.units}
        object.__setattr__(self, "mutated", made)

    @property
    def ends(self) -> tuple[str, str]:
        """The layout's first and last unit, between which an allele lies."""
        return self.pre[0], self.after[-1]

    def role(self, unit: str) -> str:
        if unit in self.pre:
            return "pre"
        if unit in self.after:
            return "after"
        return "canonical" if unit == self.canonical else "variable"

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """units(id, ord, seq, class) and templates(name, ord, parent, seq, net_bp): a few hundred rows at most."""
        units = [(u, i, s, self.role(u)) for i, (u, s) in enumerate(self.units.items())]
        net = {t.name: t.net for t in self.templates}
        made = [(n, i, u, s, net[n]) for i, (s, (u, n)) in enumerate(self.mutated.items())]
        return {
            "units": spark.createDataFrame(units, "id string, ord int, seq string, class string"),
            "templates": spark.createDataFrame(made, "name string, ord int, parent string, seq string, net_bp int"),
        }


def default() -> Dictionary:
    units = dict(line.split() for line in UNITS.strip().splitlines())
    rows = [[x.strip() for x in line.split("|")] for line in TEMPLATES.strip().splitlines()]
    return Dictionary(units, tuple(Template(n, tuple(a.split()), k, int(s), int(e) if e else None, b) for n, a, k, s, e, b in rows))


def load(path: str) -> Dictionary:
    """A dictionary file: {"repeats", "mutations", "pre_repeat_ids", "after_repeat_ids", "canonical_repeat", "flanking_*"}."""
    data = json.loads(open(path, encoding="utf-8").read())
    flanks = next((v for k, v in data.items() if k.startswith("flanking")), {})
    templates = []
    for name, value in data.get("mutations", {}).items():
        if name.startswith("synthetic"):
            continue
        for change in value["changes"]:
            templates.append(Template(name, tuple(value["allowed_repeats"]), change["type"], change["start"], change.get("end"), change.get("sequence", "")))
    return Dictionary(dict(data["repeats"]), tuple(templates), tuple(data["pre_repeat_ids"]), tuple(data["after_repeat_ids"]), data["canonical_repeat"], flanks.get("left", ""), flanks.get("right", ""), data.get("repeat_length_bp", UNIT_BP))
