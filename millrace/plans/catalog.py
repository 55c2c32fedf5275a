"""All queries of the analytics engine by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import aggregates, nested, relations, sequences
from millrace.plans import bound
from millrace.plans.engine import run_sql, view, view_text

DECLARED: dict[str, str] = {**aggregates.SQL, **relations.SQL, **text.SQL}


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, sql)


def st_fixed_window_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.fixed_window_limit(view(spark, sf_dir, "request_metric"), limit=3, window=86400).select("request_id", "n", "allowed")


def st_leaky_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.leaky_bucket(view(spark, sf_dir, "request_metric")).select("request_id", "accepted")


def st_ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = view(spark, sf_dir, "request_metric").withColumn("key", F.concat_ws("|", "model_name", F.col("tokens_generated").cast("string")))
    return sequences.ttl_cache(keyed, ttl=43200).select("request_id", "hit")


def st_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.token_cache(view(spark, sf_dir, "request_metric").withColumn("valid", F.col("status") == 200), ttl=43200).select("request_id", "hit")


def st_micro_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.micro_batch(view(spark, sf_dir, "request_metric").withColumn("service", F.col("model_name")), wait=1200).select("request_id", "batch", "place")


def arr_pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.pad_truncate(view(spark, sf_dir, "chat"), ["conv_id", "turn"])


def topk_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    query = vectors.orderBy("vec_id").select("embedding").first()[0]
    return nested.top_k_cosine(vectors, query).select("vec_id", F.round("score", 5).alias("score"))


FUNCTIONS = (st_fixed_window_limit, st_leaky_bucket, st_ttl_cache, st_token_cache, st_micro_batch, arr_pad_truncate, topk_embedding)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _query(v) for k, v in DECLARED.items()} | {f.__name__: f for f in FUNCTIONS} | bound.QUERIES


def _recursive(key: str, extra: str, start: str, step: str, states: str, out: str) -> str:
    """A fold for the checking engine: rows by key and number, one recursive step a row."""
    return f"""with recursive r as (select *, row_number() over (partition by {key} order by t, request_id) as i from (select *, {extra} from request_metric) z),
        f as (select {key} as key, i, request_id, t, {start} from r where i = 1 union all
        select r.{key}, r.i, r.request_id, r.t, {step} from f join r on r.{key} = f.key and r.i = f.i + 1)
        select request_id, {out} from f"""


_NEW = "(r.t >= f.anchor + {w})"
_FOLDS = {
    "st_fixed_window_limit": _recursive("user_id", "0 as x", "t as anchor, cast(1 as bigint) as n", f"case when {_NEW.format(w=86400)} then r.t else f.anchor end, case when {_NEW.format(w=86400)} then 1 else f.n + 1 end", "", "n, n <= 3 as allowed"),
    "st_leaky_bucket": _recursive(
        "user_id", "0 as x", "cast(0 as double) as excess, t as last, true as accepted",
        "case when greatest(0, f.excess - (1.0 / 7200) * (r.t - f.last) + 1) > 2 then f.excess else greatest(0, f.excess - (1.0 / 7200) * (r.t - f.last) + 1) end, case when greatest(0, f.excess - (1.0 / 7200) * (r.t - f.last) + 1) > 2 then f.last else r.t end, greatest(0, f.excess - (1.0 / 7200) * (r.t - f.last) + 1) <= 2", "", "accepted",
    ),
    "st_ttl_cache": _recursive("key_", "model_name || '|' || cast(tokens_generated as string) as key_", "t as anchor, false as hit", f"case when {_NEW.format(w=43200)} then r.t else f.anchor end, not {_NEW.format(w=43200)}", "", "hit"),
    "st_token_cache": _recursive(
        "user_id", "status = 200 as valid", "case when valid then t end as anchor, false as hit",
        "case when f.anchor is not null and r.t < f.anchor + 43200 then f.anchor when r.valid then r.t end, f.anchor is not null and r.t < f.anchor + 43200", "", "hit",
    ),
    "st_micro_batch": _recursive(
        "model_name", "0 as x", "cast(1 as bigint) as batch, t as first, cast(1 as bigint) as place",
        "case when f.place >= 8 or r.t > f.first + 1200 then f.batch + 1 else f.batch end, case when f.place >= 8 or r.t > f.first + 1200 then r.t else f.first end, case when f.place >= 8 or r.t > f.first + 1200 then 1 else f.place + 1 end", "", "batch, place",
    ),
}
_TOKENS = "(select conv_id, turn, role, $TOKENS(text) as w from chat) x"
_CHECKS = {
    **_FOLDS,
    "arr_pad_truncate": f"select conv_id, turn, array_to_string(list_concat(list_transform(range(0, greatest(16 - len(w[1:512]), 0)), lambda i: '<pad>'), w[1:512]), ' ') as padded from {_TOKENS}",
    "topk_embedding": "select vec_id, round(list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings order by vec_id limit 1)), 5) as score from embeddings order by list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings order by vec_id limit 1)) desc, vec_id limit 5",
}
ORACLE_SQL: dict[str, str] = {k: view_text(v, "duck") for k, v in (DECLARED | _CHECKS).items()} | bound.ORACLE_SQL
