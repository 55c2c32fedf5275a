"""Exact dedup: frequent digests are found by Misra-Gries and settled map-side, the rest are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import keep_rows, misra_gries, row_key, staged

RID = "__rid"


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def exact_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = 1024, min_heavy: int = 8) -> DataFrame:
    """One row for each row of ``df``: ``k1, k2, doc_id, keep_id, group_size, kept, digest`` (32 bytes).

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id stays; null ids
    rank below all others, and of rows that repeat an id exactly one stays. Very long texts are hashed whole; other
    columns are not read; no rows give none. ``k1, k2`` is the row's ``row_key``.

    A digest that more than 1/(counters+1) of the rows have is always found by the summary. The summary's digests are
    counted exactly and their winners (``counters`` rows at most) are broadcast, so those rows never meet in one task;
    any other digest has at most 1/(counters+1) of the rows, which are counted by partial aggregates and joined as they
    stream by.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # the row key is made here, once: what follows reads this table
    d = staged(rows.select(F.monotonically_increasing_id().alias(RID), *row_key("doc_id", "text"), "doc_id", _digest("text").alias("digest")), "digests")
    d = d.withColumn("head", F.xxhash64("digest"))
    heads = df.sparkSession.createDataFrame([(x,) for x in misra_gries(d, "head", counters)], "head long")
    sizes = (F.count("*").alias("group_size"), F.max(F.struct("doc_id", RID)).alias("w"))
    winners = staged(d.join(F.broadcast(heads), "head").groupBy("head", "digest").agg(*sizes).where(F.col("group_size") >= min_heavy), "winners")
    heavy = d.join(F.broadcast(winners), ["head", "digest"])
    light = d.join(F.broadcast(winners), ["head", "digest"], "left_anti")
    light = light.join(light.groupBy("head", "digest").agg(*sizes), ["head", "digest"])
    columns = ("k1", "k2", "doc_id", F.col("w.doc_id").alias("keep_id"), "group_size", (F.col("w." + RID) == F.col(RID)).alias("kept"), "digest")
    return heavy.select(*columns).unionByName(light.select(*columns))


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, with their columns; of rows that repeat the winner's id and text, one.

    They are found again by ``row_key``: the scan of ``df`` here may be split otherwise than the first.
    """
    return keep_rows(df, staged(exact_dedup(df, text, doc_id).select("k1", "k2", "kept", F.lit(True).alias("once")), "decided"), text, doc_id)
