"""Line dedup by overlapping windows of consecutive lines, in DataFrame operations only.

Every window of three lines that also occurs earlier (smaller doc_id, then earlier in the document)
is a repeat; the lines that repeats cover go and the rest stays in order. Windows travel as 96 bits
of hash with their place, so lines themselves are never shuffled; a hot window meets partial aggregates and a
join that adaptive execution splits. Texts of fewer lines than a window stay whole.
Null doc_ids come first; different texts with one doc_id are in the order of a hash of the text; a null text stays null; rows equal in doc_id and text are one place, so neither is a
repeat of the other. An empty table gives an empty result. Columns of other names pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
OWN = ("_version", "_lines", "_gone", "_doc", "_which")


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, even where a lambda inside body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(lines: Column, width: int) -> Column:
    def body(pair: Column) -> Column:
        def one(i: Column) -> Column:
            # ``high`` and ``low`` hash the same lines by different functions
            return F.struct(
                i.alias("at"),
                F.xxhash64(*[F.get(pair["a"], i + k) for k in range(width)]).alias("high"),
                F.hash(*[F.get(pair["b"], i + k) for k in range(width)]).alias("low"),
            )

        n = F.size(pair["a"])
        return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), one))

    hashes = F.struct(F.transform(lines, lambda x: F.xxhash64(x)).alias("a"), F.transform(lines, lambda x: F.hash(x)).alias("b"))
    return _bind(hashes, body)


def repeated_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(_doc, _which, at) of every window that also occurs earlier; ``docs``: doc_id, _version, text."""
    found = docs.select(F.col("doc_id").alias("_doc"), F.col("_version").alias("_which"), F.explode(_windows(F.split("text", "\n", -1), width)).alias("w"))
    found = found.select("_doc", "_which", "w.at", "w.high", "w.low")
    first = found.groupBy("high", "low").agg(F.count("*").alias("c"), F.min(F.struct("_doc", "_which", "at")).alias("first")).where("c > 1")
    first = first.select(F.col("high").alias("h"), F.col("low").alias("l"), "first")
    met = found.join(first, (found.high == first.h) & (found.low == first.l))
    return met.where(~(F.col("_doc").eqNullSafe(F.col("first._doc")) & (F.col("_which") == F.col("first._which")) & (F.col("at") == F.col("first.at")))).select("_doc", "_which", "at")


def dedup_lines(docs: DataFrame, *, width: int = WINDOW) -> DataFrame:
    """``docs`` with repeated lines gone from text; adds line_count and lines_removed (long)."""
    docs = docs.drop(*OWN, "line_count", "lines_removed").withColumn("_version", F.xxhash64("text"))
    gone = repeated_windows(docs.select("doc_id", "_version", "text"), width).groupBy("_doc", "_which").agg(F.collect_set("at").alias("_gone"))
    joined = docs.join(gone, docs.doc_id.eqNullSafe(gone._doc) & (docs._version == gone._which), "left")

    def keep(row: Column) -> Column:
        covered = F.array_distinct(F.flatten(F.transform(row["gone"], lambda p: F.sequence(p, p + (width - 1)))))
        left = F.array_except(F.sequence(F.lit(0), F.size(row["lines"]) - 1), covered)
        return F.transform(left, lambda i: F.get(row["lines"], i))

    kept = _bind(F.struct(F.split("text", "\n", -1).alias("lines"), F.col("_gone").alias("gone")), keep)
    marked = joined.withColumn("_lines", F.when(F.col("_gone").isNotNull(), kept))
    total = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    out = marked.select(
        *[(F.when(F.col("_lines").isNotNull(), F.array_join("_lines", "\n")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns if c != "_version"],
        total.cast("long").alias("line_count"),
        F.when(F.col("_lines").isNotNull(), total - F.size("_lines")).otherwise(F.lit(0)).cast("long").alias("lines_removed"),
    )
    return out


def digest(docs: DataFrame) -> DataFrame:
    """Per document: lines, lines removed, and the digest of what is kept (null text: of nothing)."""
    kept = dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", F.col("line_count").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = """
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i
  from documents where text is not null
), w as (
  select doc_id, i, line as a, lead(line) over d as b, lead(line, 2) over d as c, count(*) over (partition by doc_id) as n
  from lines window d as (partition by doc_id order by i)
), later as (
  select doc_id, i from (
    select doc_id, i, row_number() over (partition by a, b, c order by doc_id, i) as r from w where i + 2 <= n) where r > 1
), gone as (
  select distinct doc_id, i + k as i from later, (values (0), (1), (2)) v(k)
), kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.i) as kept, count(*) as n_kept
  from lines l anti join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id
)
select d.doc_id, case when d.text is null then 0 else len(string_split(d.text, chr(10))) end::bigint as n_lines,
  (case when d.text is null then 0 else len(string_split(d.text, chr(10))) end - coalesce(k.n_kept, 0))::bigint as n_removed,
  sha256(coalesce(k.kept, '')) as kept_sha256
from documents d left join kept k using (doc_id)
"""
