"""File sources and sinks: CSV, JSON lines, nested JSON, text logs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: client - user [time] "method path protocol" status bytes request_time upstream_time
ACCESS_LOG = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d+) (\d+) ([\d.]+) ([\d.-]+)'


def fetch(spark: SparkSession, sql: str, args: dict, **tables: DataFrame) -> DataFrame:
    """A parameterised query over the tables that it names in braces; lost tasks are tried again by the scheduler."""
    return spark.sql(sql, args=args, **tables)


def captured(requests: DataFrame, method: str, url: str, status: str, seconds: str) -> DataFrame:
    """Requests with ``method, url, status, latency_ms, success``, as a client notes them."""
    return requests.withColumns({"method": F.col(method), "url": F.col(url), "latency_ms": F.col(seconds) * 1000, "success": F.col(status).between(200, 299)})


def endpoint_constants(spark: SparkSession, answers: dict[str, dict[str, str]]) -> DataFrame:
    """``endpoint, name, value`` of endpoints that always answer the same."""
    return spark.createDataFrame([(e, k, v) for e, a in answers.items() for k, v in a.items()], "endpoint string, name string, value string")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; lines that don't parse are kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_benchmark_json(spark: SparkSession, path: str) -> DataFrame:
    """``{endpoint: {mean, p95, success_rate}}`` as one row an endpoint."""
    kind = "map<string, struct<mean: double, p95: double, success_rate: double>>"
    return spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", kind)).alias("endpoint", "m")).select("endpoint", "m.*")


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    names = ("client", "user", "time", "method", "path", "status", "bytes", "request_time", "upstream_time")
    parts = [F.regexp_extract("value", ACCESS_LOG, i + 1).alias(n) for i, n in enumerate(names)]
    d = spark.read.text(path).where(F.col("value").rlike(ACCESS_LOG)).select(*parts)
    return d.withColumns({"status": F.col("status").cast("int"), "bytes": F.col("bytes").cast("long"), "request_time": F.col("request_time").cast("double")})


def read_app_log(spark: SparkSession, path: str) -> DataFrame:
    """``LEVEL time module message`` lines."""
    pattern = r"^(\w+) (\S+ \S+) (\S+) (.*)$"
    return spark.read.text(path).select(*[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(("level", "time", "module", "message"))])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """``n, line`` as numbered lines, in order."""
    df.orderBy("n").select(F.concat_ws("\t", F.col("n").cast("string"), "line").alias("value")).write.mode("overwrite").text(path)


def report_lines(df: DataFrame, title: str, totals: dict[str, Column], by: str) -> DataFrame:
    """``n, line`` of a report: a heading, a line for each total, and one for each group with its rows."""
    head = df.agg(*[c.alias(k) for k, c in totals.items()])
    lines = F.array(F.lit(f"# {title}"), *[F.concat(F.lit(f"{k}: "), F.col(k).cast("string")) for k in totals])
    top = head.select(F.posexplode(lines).alias("n", "line")).select(F.col("n").cast("long").alias("n"), "line")
    groups = df.groupBy(by).agg(F.count("*").alias("c")).withColumn("n", F.row_number().over(Window.orderBy(by)) + len(totals))
    return top.unionByName(groups.select(F.col("n").cast("long").alias("n"), F.concat(F.lit("- "), by, F.lit(": "), F.col("c").cast("string")).alias("line")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``n, line`` of a report's lines."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].cast("long").alias("n"), parts[1].alias("line"))


def exposition(df: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """``line`` of a counter by labels in the text format that scrapers read."""
    escaped = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.coalesce(escaped(c), F.lit("")), F.lit('"')) for c in labels])
    return df.groupBy(*labels).agg(F.count("*").alias("n")).select(F.concat(F.lit(f"{name}{{"), pairs, F.lit("} "), F.col("n").cast("string")).alias("line"))
