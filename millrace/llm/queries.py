"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import cotraining, exact_dedup, html_text, jaccard_join, mixing, packing, quality_rules, sharding, suffix_dedup, url_filter

SHARDS = [f"shard-{i:02d}" for i in range(32)]
#: ``host, path, verdict``.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: The large source is held to a fifth of the mix, as long as the others last.
WEIGHTS = {"src0": 5, mixing.OTHERS: 1}


def tokenizer_file() -> str:
    """``MILLRACE_TOKENIZER``, or the public file that is installed."""
    if path := os.environ.get("MILLRACE_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rules = quality_rules.fit_rules(docs, _read(spark, sf_dir, "labels"))
    return quality_rules.judge(docs.select("doc_id", "text"), rules).select("doc_id", *quality_rules.BASE, "base_failed", "kept", "rule")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.fit(docs, _read(spark, sf_dir, "labels"))).select("doc_id", "score", "kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_read(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_file())


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))
    return d.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix_dedup.repeated_spans(_read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix_sources(_read(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS)
    return d.select("doc_id", "source", *[c for c in d.columns if c.startswith("mix_")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_url_filters, op3_ngram_jaccard_join, op4_quality_rules, op5_quality_classifier, op6_sharding,
        op7_best_fit_packing, op8_exact_dedup, op9_suffix_array_dedup, op10_mixing,
    )
}

_HOST = r"regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 1)"
_PATH = r"regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 2)"
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

ORACLE_SQL = {
    "op2_url_filters": f"""
        with p as (select row_number() over () as k, page_id, translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, {_PATH} as path from pages),
        r(rh, rp, rv) as (values {_RULE_ROWS}),
        hit as (select k, rh || rp as rule, rv, row_number() over (partition by k order by length(rh || rp) desc, rv desc, rh || rp desc) as n
                from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
        select page_id, host, path, rule, coalesce(rv, 'allow') as verdict from p left join hit on p.k = hit.k and n = 1""",
    "op6_sharding": f"""
        with t(slot, shard) as (values {", ".join(f"({i}, '{s}')" for i, s in enumerate(sharding.lookup_table(SHARDS)))}),
        d as (select doc_id, cast(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) % {sharding.TABLE_SIZE} as integer) as slot from documents)
        select doc_id, slot, shard from d join t using (slot)""",
    "op8_exact_dedup": """
        with d as (select doc_id, sha256(coalesce(text, '')) as h, row_number() over () as k from documents),
        w as (select *, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
                     row_number() over (partition by h order by doc_id desc nulls last, k desc) as n from d)
        select doc_id, keep_id, group_size, n = 1 as kept, h as text_sha256 from w""",
}
