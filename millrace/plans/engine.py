"""Runs a declared query on Spark, and writes the same query for the checking engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.views import VIEWS, render, used

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view_text(sql: str, dialect: str) -> str:
    """``sql`` with the adapter views that it uses as common table expressions."""
    ctes = [f"{n} as ({render(VIEWS[n], dialect)})" for n in used(sql, VIEWS)]
    body = render(sql, dialect).strip()
    if not ctes:
        return body
    if body[:15].lower() == "with recursive ":
        return f"with recursive {', '.join(ctes)}, {body[15:]}"
    return f"with {', '.join(ctes)}, {body[5:]}" if body[:5].lower() == "with " else f"with {', '.join(ctes)} {body}"


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The query over the tables of ``sf_dir``, each named by its file, so nothing is registered in the session."""
    text = view_text(sql, "spark")
    for t in used(text, TABLES):
        text = re.sub(rf"\b((?:from|join)\s+){t}\b", rf"\1parquet.`{sf_dir}/{t}.parquet`", text, flags=re.I)
    return spark.sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter view as a DataFrame."""
    return run_sql(spark, sf_dir, f"select * from {name}")
