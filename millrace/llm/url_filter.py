"""URL filters: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, full digests, precedence."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, join_counted, staged

#: Rule lists of up to this many rows are broadcast (about 150 bytes each); longer ones are shuffled.
BROADCAST_RULES = 200_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rules_table(rules: DataFrame) -> DataFrame:
    """``rules``: ``host, path, verdict``. Null or empty hosts are left out, of equal rules a block wins."""
    r = rules.where("host <> ''").select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' sorts after 'allow'
    r = r.select(F.concat("host", "path").alias("rule"), "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_len"))
    digest = F.unhex(F.sha2("rule", 256))
    return r.withColumns({"digest": digest, "prefix": F.conv(F.substring(F.sha2("rule", 256), 1, 8), 16, 10).cast("long")})


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of ``df``: its columns but clashing ones, ``host, path, rule, verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest fitting rule (host and
    path together) wins; of equally long ones a block, then the last by name. A null url, or one with no ``://``, has an
    empty host and path, fits no rule and gets ``default``. Urls of any length are judged whole, repeated rows alike. Empty
    tables give empty results.

    Each host with as much of its path as the longest rule has is judged once, and expanded only into the shapes (labels in
    the host, characters in the path) that some rule has. Frequent hosts and frequent expressions are broadcast with what
    they meet (``join_counted``).
    """
    table = staged(rules_table(rules), "rules")
    shapes = sorted(tuple(x) for x in table.select("labels", "path_len").distinct().collect())
    longest = max((k for _, k in shapes), default=0)
    small = table.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    table = table.select("prefix", F.col("digest").alias("rule_digest"), "rule", F.col("verdict").alias("rule_verdict"))
    own = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    u = df.select(*own).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn("__start", F.substring("path", 1, longest))
    keys = staged(u.where("host <> ''").groupBy("host", "__start").agg(F.count("*").alias("__n")), "hosts")
    shape = F.from_json(F.lit(json.dumps([{"n": n, "k": k} for n, k in shapes])), "array<struct<n: int, k: int>>")
    e = keys.select("host", "__start", shape.alias("__shapes"), F.size(F.split("host", r"\.")).alias("__labels"))
    fits = "filter(__shapes, s -> s.n <= __labels and s.k <= length(__start))"
    e = e.select("host", "__start", F.explode(F.expr(f"array_distinct(transform({fits}, s -> concat(substring_index(host, '.', -s.n), substring(__start, 1, s.k))))")).alias("expression"))
    e = e.withColumn("digest", F.sha2("expression", 256)).withColumns({"prefix": F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), "digest": F.unhex("digest")})
    if small:
        hits = e.join(F.broadcast(table), "prefix")
    else:
        e = staged(e, "expressions")
        hits = join_counted(e, staged(table.join(e.groupBy("prefix").agg(F.count("*").alias("__n")), "prefix"), "counted"), ["prefix"], "__n").drop("__n")
    hits = hits.where("digest = rule_digest")
    order = F.struct(F.length("rule"), F.col("rule_verdict"), F.col("rule"))
    best = hits.groupBy("host", "__start").agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("best"))
    best = staged(keys.join(best, ["host", "__start"]), "judged")
    judged = join_counted(u, best, ["host", "__start"], "__n", "left")
    return judged.select(*own, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
