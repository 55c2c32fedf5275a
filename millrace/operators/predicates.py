"""Filters, permission rules and probes over any table: columns, lists and thresholds are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAFE_METHODS = ("GET", "HEAD", "OPTIONS")


def indexable_columns(columns: DataFrame, types: list[str], per_table: int = 5) -> DataFrame:
    """``table_name, column_name`` of the first columns of each table whose ``data_type`` is one of ``types``."""
    first = Window.partitionBy("table_name").orderBy("ordinal_position")
    return columns.where(F.col("data_type").isin(types)).withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_table).select("table_name", "column_name")


def has_permission(permissions: Column, required: str, admin: str = "admin") -> Column:
    """The set holds what is required, or the administrator's permission; a null set holds nothing."""
    return F.coalesce(F.array_contains(permissions, required) | F.array_contains(permissions, admin), F.lit(False))


def object_permission(method: Column, owner: Column, user: Column, staff: Column, verified: Column, rule: str) -> Column:
    """``owner_or_read``: reading, or the owner; ``self``; ``staff``; ``verified``: a user that is known to be one."""
    rules = {"owner_or_read": method.isin(*SAFE_METHODS) | (owner == user), "self": owner == user, "staff": staff, "verified": user.isNotNull() & verified}
    return F.coalesce(rules[rule], F.lit(False))


def allowed_in(df: DataFrame, environment: str, endpoint: str = "endpoint", only: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``allowed``: endpoints that belong to one environment are open in that one only."""
    only = only or {}
    own = F.coalesce(*[F.when(F.col(endpoint) == e, F.lit(env)) for e, env in only.items()], F.lit(environment))
    return df.withColumn("allowed", own == environment)


def exposed_paths(responses: DataFrame, paths: list[str], path: str = "path", status: str = "status", size: str = "size") -> DataFrame:
    """Responses to a sensitive path that are 200 and not empty."""
    known = responses.sparkSession.createDataFrame([(p,) for p in paths], f"{path} string")
    return responses.join(F.broadcast(known), path).where((F.col(status) == 200) & (F.col(size) > 0))


def unauthenticated_access(responses: DataFrame, endpoints: list[str], weak: list[str]) -> DataFrame:
    """``endpoint, kind, hits``: for each endpoint and kind of token that must not do (none, or a weak one), the requests that got in."""
    spark = responses.sparkSession
    cases = spark.createDataFrame([(e, k) for e in endpoints for k in ("none", "weak")], "endpoint string, kind string")
    kind = F.when(F.coalesce("token", F.lit("")) == "", "none").when(F.col("token").isin(weak), "weak")
    hits = responses.where("status = 200").withColumn("kind", kind).where("kind is not null").groupBy("endpoint", "kind").agg(F.count("*").alias("hits"))
    return F.broadcast(cases).join(hits, ["endpoint", "kind"])


def config_issues(logins: DataFrame, bodies: DataFrame, defaults: list[tuple[str, str]], listing: list[str]) -> DataFrame:
    """``kind, subject``: default credentials that were accepted, and pages that list a folder."""
    known = logins.sparkSession.createDataFrame(defaults, "name string, password string")
    creds = logins.join(F.broadcast(known), ["name", "password"]).where("status = 200").select(F.lit("default credentials").alias("kind"), F.col("name").alias("subject")).distinct()
    shown = F.lit(False)
    for t in listing:
        shown = shown | F.contains("body", F.lit(t))
    return creds.unionByName(bodies.where(shown).select(F.lit("directory listing").alias("kind"), F.col("url").alias("subject")))


def tls_issues(hosts: DataFrame, as_of: float, days: int = 30, weak: str = "RC4|DES|MD5") -> DataFrame:
    """``url, kind`` of ``url, expires`` (epoch) and ``cipher``: no TLS, a certificate that ends within ``days``, a weak cipher."""
    left = F.floor((F.col("expires") - as_of) / 86400)
    secure = F.startswith(F.lower("url"), F.lit("https://"))
    kinds = F.array_compact(F.array(F.when(~secure, "no TLS"), F.when(secure & (left < days), "certificate expires"), F.when(secure & F.upper("cipher").rlike(weak), "weak cipher")))
    return hosts.where("url is not null").select("url", F.explode(kinds).alias("kind"))
