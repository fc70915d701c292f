"""Queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(spark, _docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(spark, _docs(spark, sf_dir))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    return remove_repeats(spark, _docs(spark, sf_dir))


def op5_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bytebpe import encode_decode

    return encode_decode(spark, _docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op6_lempelziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lempelziv import remove_repeats

    return remove_repeats(spark, _docs(spark, sf_dir))


def op7_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import severity

    return severity(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import digest

    return digest(_docs(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess

    return assess(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sstable import roundtrip

    return roundtrip(spark, _docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    return hard_negatives(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(spark, _docs(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: Joins windows with themselves over whole texts: at 0.001 to 0.01 this takes DuckDB seconds.
SIMPLE = "[^\\x20\\x09-\\x0D]+"
LEMPELZIV_SQL = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{SIMPLE}') as w from documents),
g as (select doc_id, i, list_slice(w, i, i + 19) as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as r from g) where r > 1),
gone as (select distinct doc_id, i + k as i from later, range(0, 20) r(k)),
kept as (select w.doc_id, string_agg(w.x, ' ' order by w.i) as t, count(*) as n
  from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d) w anti join gone g on w.doc_id = g.doc_id and w.i = g.i group by w.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""

ALL = (op1_kdtree, op2_packing, op3_simhash, op4_suffix, op5_bpe_trie, op6_lempelziv, op7_ordinal, op8_line_windows, op9_quality, op10_sstable, op11_negatives, op12_minhash, pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    from . import linededup, minhash, negatives, quality, topk

    return {"op1_kdtree": topk.SQL, "op6_lempelziv": LEMPELZIV_SQL, "op8_line_windows": linededup.SQL, "op9_quality": quality.SQL, "op11_negatives": negatives.SQL, "op12_minhash": minhash.SQL}
