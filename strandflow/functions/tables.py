"""What SQL users call: a table function for segmentation and functions of sequences, registered in a session.

    register(spark)
    SELECT t.id, s.* FROM t, LATERAL segment(t.seq) AS s
    SELECT revcomp(seq), is_frameshift(net_bp), substitutions_only(a, b) FROM t
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..dictionary import Dictionary, default

SEGMENT = "index int, start int, end int, label string, unit string, template string, distance int, net_bp int, frameshift boolean, status string, ambiguous_place boolean"
#: SQL functions in SQL itself, so that they stay in the engine: name, arguments, type, body.
FUNCTIONS = (
    ("revcomp", "seq string", "string", "reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan'))"),
    ("is_frameshift", "net_bp bigint", "boolean", "net_bp % 3 <> 0"),
    ("substitutions_only", "a string, b string", "boolean", "length(a) = length(b) and levenshtein(a, b) = aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> if(x <> y, 1, 0)), 0, (n, x) -> n + x)"),
)


def segment_function(words: Dictionary | None = None):
    """The table function of segmentation: a row for each unit of a sequence, none for a null one."""
    words = words or default()
    names = [c.split()[0] for c in SEGMENT.split(", ")]

    class Segment:
        def eval(self, seq: str):
            from strandflow.operators.segment import segment

            for unit in segment(seq, words) if seq is not None else ():
                yield tuple(unit[n] for n in names)

    return udtf(Segment, returnType=SEGMENT)


def register(spark: SparkSession, words: Dictionary | None = None, prefix: str = "") -> None:
    """Make ``segment`` and the functions known to the session, with ``prefix`` before their names."""
    spark.udtf.register(f"{prefix}segment", segment_function(words))
    for name, arguments, kind, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {prefix}{name}({arguments}) returns {kind} return {body}")
