"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule compares a ratio of a text's counts with a cutoff. For every stratum (language), rule and
cutoff of the grid, the labelled good documents are a holdout: k of n would be rejected. By the exact
binomial bound, the false rejection rate is under ``risk / rules`` with the confidence asked for if
``P(Binomial(n, risk / rules) <= k) <= delta / tests``, where ``tests`` counts all strata, rules and
cutoffs (Bonferroni). Of the cutoffs that pass, a rule takes the one that rejects most; a rule
with none isn't applied. So with probability 1 - delta, in every stratum at most ``risk`` of the good documents
that pass the base rules are rejected. A stratum without enough good documents has no rules.

Null text: no words, so base_failed. Null or repeated doc_ids pass through as rows; labels that
repeat a doc_id count once; a null language is a stratum of its own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .linededup import _bind

RISK, DELTA = 0.02, 0.05
#: Rule: ratio of counts and the cutoffs tried; a document is rejected at ratio >= cutoff.
GRID = {
    "symbols": ("n_symbols", "word_chars", (0.04, 0.08, 0.12, 0.2, 0.3)),
    "lines": ("n_dup_lines", "n_lines", (0.2, 0.3, 0.4, 0.5, 0.6)),
    "repeats": ("n_repeat_words", "n_words", (0.04, 0.08, 0.12, 0.16)),
    "long": ("word_chars", "n_words", (9.0, 11.0, 13.0, 16.0, 20.0)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BLANKS = "\t\n\x0b\x0c\r"
SPAN = 5


def _repeat_words(hashes: Column, n: Column) -> Column:
    """Words covered by windows of five words that occur twice or more, from the words' hashes."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - SPAN), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SPAN)]))

    def covered(pairs: Column) -> Column:
        # sorted by hash: a window is repeated if a neighbour has its hash
        own = lambda k: F.get(pairs, k)["h"]
        places = F.filter(
            F.transform(pairs, lambda x, k: F.when((x["h"] == F.when(k > 0, own(k - 1))) | (x["h"] == own(k + 1)), x["i"])),
            lambda i: i.isNotNull(),
        )
        step = lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(SPAN), p - acc["last"])).alias("sum"), p.alias("last"))
        return F.aggregate(F.sort_array(places), F.struct(F.lit(0).alias("sum"), F.lit(-SPAN).alias("last")), step)["sum"]

    def count(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), _bind(pairs, covered)).otherwise(F.lit(0))

    return F.when(n >= SPAN, _bind(_bind(hashes, windows), count)).otherwise(F.lit(0))


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with _n_lines, _base_failed and the counts, each under its name with an underscore before it."""
    text = F.coalesce("text", F.lit(""))
    squeezed = F.translate(text, " " + BLANKS, "")
    docs = docs.withColumn("_hashes", F.transform(F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), ""), lambda w: F.xxhash64(w)))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " " + BLANKS, "")) > 0)
    docs = docs.withColumns(
        {
            "_n_words": F.size("_hashes"),
            "_word_chars": F.length(squeezed).cast("long"),
            "_n_symbols": (F.length(squeezed) - F.length(F.translate(squeezed, "#*$%&|<>", ""))).cast("long"),
            "_line_counts": _bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))),
        }
    )
    docs = docs.withColumns(
        {
            "_n_repeat_words": _repeat_words(F.col("_hashes"), F.col("_n_words")).cast("long"),
            "_n_lines": F.col("_line_counts.n").cast("long"),
            "_n_dup_lines": (F.col("_line_counts.n") - F.col("_line_counts.d")).cast("long"),
        }
    ).withColumn("_n_words", F.col("_n_words").cast("long"))
    failed = (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words"))
    return docs.drop("_hashes", "_line_counts").withColumn("_base_failed", failed)


def _rejects(rule: str, cutoff) -> Column:
    top, bottom, _ = GRID[rule]
    return F.col(f"_{top}") >= cutoff * F.col(f"_{bottom}")


def thresholds(counted: DataFrame, labels: DataFrame, *, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, and for each rule its cutoff or null); one row per stratum with good documents."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_good")).distinct()
    holdout = counted.where(~F.col("_base_failed")).join(good, F.col("doc_id") == F.col("_good"), "left_semi")
    names = [(rule, i) for rule in GRID for i in range(len(GRID[rule][2]))]
    sums = holdout.groupBy(F.col(stratum).alias("stratum")).agg(
        F.count("*").alias("n"), *[F.count_if(_rejects(r, F.lit(GRID[r][2][i]))).alias(f"{r}_{i}") for r, i in names]
    )
    strata = sums.agg(F.count("*").alias("strata"))
    tests = sums.crossJoin(F.broadcast(strata))  # one row
    rate = risk / len(GRID)

    def passes(k: Column) -> Column:
        n = F.col("n")
        # P(Binomial(n, rate) <= k), term by term; where k is above the mean the bound can't hold
        step = lambda acc, j: F.struct(
            (acc["t"] + F.log((n - j + 1) / j) + F.log(F.lit(rate / (1 - rate)))).alias("t"),
            (acc["s"] + F.exp(acc["t"] + F.log((n - j + 1) / j) + F.log(F.lit(rate / (1 - rate))))).alias("s"),
        )
        start = n * F.log(F.lit(1 - rate))
        tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(start.alias("t"), F.exp(start).alias("s")), step)["s"]
        return F.when(k <= n * rate, tail <= F.lit(delta) / (F.col("strata") * len(names))).otherwise(F.lit(False))

    picks = []
    for rule in GRID:  # cutoffs rise, so the first that passes rejects most
        picks.append(F.coalesce(*[F.when(passes(F.col(f"{rule}_{i}")), F.lit(c)) for i, c in enumerate(GRID[rule][2])]).alias(rule))
    return tests.select("stratum", *picks)


def _judge(counted: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Adds _kept. Strata are compared null-safe; one row a stratum, so the join adds no rows."""
    named = cutoffs.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_cut_{r}") for r in GRID])
    joined = counted.join(named, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    rejected = F.lit(False)
    for rule in GRID:
        rejected = rejected | F.coalesce(_rejects(rule, F.col(f"_cut_{rule}")), F.lit(False))
    return joined.withColumn("_kept", ~F.col("_base_failed") & ~rejected)


def _few(scratch: Scratch, cutoffs: DataFrame, most: int = 4096) -> DataFrame:
    """The cutoffs as a written table, broadcast only if there are few strata."""
    table = scratch.keep(cutoffs, "cutoffs")
    return F.broadcast(table) if table.count() <= most else table


def assess(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang") -> DataFrame:
    """Per document: the counts, base_failed and kept."""
    scratch = Scratch(docs.sparkSession, "quality", like=docs)
    counted = scratch.keep(with_counts(docs.select("doc_id", "text", stratum)).drop("text"), "counts")
    judged = _judge(counted, _few(scratch, thresholds(counted, labels, stratum=stratum)), stratum)
    return judged.select("doc_id", *[F.col(f"_{c}").alias(c) for c in COUNTS], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang") -> DataFrame:
    """The documents that the rules keep, with their columns; texts are written once with their counts and never shuffled."""
    own = {f"_{c}" for c in (*COUNTS, "n_lines", "base_failed", "kept", "stratum", "good", "hashes", "line_counts", *(f"cut_{r}" for r in GRID))}
    docs = docs.drop(*own)
    scratch = Scratch(docs.sparkSession, "quality", like=docs)
    counted = scratch.keep(with_counts(docs), "counts")
    judged = _judge(counted, _few(scratch, thresholds(counted.drop("text"), labels, stratum=stratum)), stratum)
    return judged.where("_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def _sql() -> str:
    rate = RISK / len(GRID)
    names = [(r, i, c) for r in GRID for i, c in enumerate(GRID[r][2])]
    rejects = lambda r, c: f"({GRID[r][0]} >= {c} * {GRID[r][1]})"
    tail = (
        "case when k <= n * {rate} then (select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate}) + (n - j) * ln(1 - {rate}))) "
        "from (select unnest(range(0, k + 1)) as j)) <= {delta} / ((select count(*) from sums) * {tests}) else false end"
    ).format(rate=rate, delta=DELTA, tests=len(names))
    counts = ", ".join(f"count_if({rejects(r, c)})::bigint as {r}_{i}" for r, i, c in names)
    long = " union all ".join(f"select lang, n, '{r}' as rule, {c} as cutoff, {r}_{i} as k from sums" for r, i, c in names)
    keep = " and ".join(f"not coalesce({GRID[r][0]} >= (select min(cutoff) from valid v where v.rule = '{r}' and v.lang is not distinct from b.lang) * {GRID[r][1]}, false)" for r in GRID)
    return f"""
with words as (
  select doc_id, lang, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from documents
), grams as (
  select doc_id, i, list_slice(w, i, i + 4) as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from words)
), twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from grams) where c > 1
), covered as (
  select doc_id, count(distinct i + k) as n from twice, (values (0), (1), (2), (3), (4)) v(k) group by doc_id
), base as (
  select doc_id, lang, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(l)::bigint as n_lines,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from words left join covered using (doc_id)
), b as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base
), sums as (
  select lang, count(*) as n, {counts} from b where not base_failed and doc_id in (select doc_id from labels where quality = 1) group by lang
), long as ({long}), valid as (select lang, rule, cutoff from long where {tail})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {keep} as kept from b
"""


SQL = _sql()
