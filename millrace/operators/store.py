"""What writes: keys with a time to live, tables that are changed, views that are kept, statistics, backups."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.columns import valid_json

# ---- keys and values ----------------------------------------------------------------------------------------------------


def put(puts: DataFrame, key: str, value: Column, at: str, ttl: float) -> DataFrame:
    """``key, value`` (JSON), ``stored_at, expires_at``: one row for each key, the last that was put."""
    made = puts.select(F.col(key).alias("key"), F.to_json(value).alias("value"), F.col(at).alias("stored_at"))
    last = made.groupBy("key").agg(F.max_by(F.struct("value", "stored_at"), F.struct("stored_at", "value")).alias("x"))
    return last.select("key", "x.value", "x.stored_at", (F.col("x.stored_at") + ttl).alias("expires_at"))


def get(gets: DataFrame, store: DataFrame, key: str, at: str, schema: str) -> DataFrame:
    """``gets`` with ``hit`` and ``found``, the decoded value: keys that are missing, expired or don't decode are misses."""
    s = store.select(F.col("key").alias(key), "value", "expires_at")
    live = gets.join(s, key, "left").withColumn("found", F.when(F.col(at) < F.col("expires_at"), F.from_json("value", schema, {"mode": "PERMISSIVE"})))
    return live.withColumn("hit", F.col("found").isNotNull() & valid_json(F.col("value"))).drop("value", "expires_at")


def run_commands(commands: DataFrame, store: DataFrame) -> DataFrame:
    """``seq, command, key`` with ``result``, as a batch of them would return: the value of ``get``, 1 or 0 for ``exists``, the seconds
    left for ``ttl`` (-2 if missing)."""
    joined = commands.join(store, "key", "left")
    there = F.col("expires_at") > F.col("at")
    by = F.when(F.col("command") == "get", F.when(there, F.col("value"))).when(F.col("command") == "exists", F.coalesce(there, F.lit(False)).cast("int").cast("string"))
    left = F.when(there, F.floor(F.col("expires_at") - F.col("at"))).otherwise(-2)
    return joined.select("seq", "command", "key", by.when(F.col("command") == "ttl", left.cast("string")).alias("result"))


# ---- tables that are changed -----------------------------------------------------------------------------------------------


def insert_missing(table: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The table with those rows whose key it lacks, and these; of rows that repeat a key the first by all columns."""
    first = Window.partitionBy(key).orderBy(*rows.columns)
    new = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").join(table, key, "left_anti").select(*table.columns)
    return table.unionByName(new), new


def delete_rows(table: DataFrame, which: DataFrame, on: list[str]) -> DataFrame:
    return table.join(which.select(*on).distinct(), on, "left_anti").select(*table.columns)


def update_rows(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of ``changes`` (one row for each key) replace those of the table where they are not null."""
    new = [c for c in changes.columns if c != key]
    named = changes.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in new])
    return table.join(named, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in new else F.col(c) for c in table.columns])


# ---- layout, kept views, statistics ----------------------------------------------------------------------------------------


def lay_out(df: DataFrame, path: str, partition: list[str], sort: list[str], where: str | None = None) -> None:
    """What an index gives elsewhere: folders by ``partition``, files sorted by ``sort``, so that readers skip; ``where`` keeps a part."""
    d = df.where(where) if where else df
    d.repartition(*[F.col(c) for c in partition]).sortWithinPartitions(*partition, *sort).write.mode("overwrite").partitionBy(*partition).parquet(path)


def index_ddl(suggestions: DataFrame, columns: DataFrame, dry_run: bool = True) -> DataFrame:
    """``table, statement, status``: an index over the columns that are worth one, for each table that is scanned too much."""
    listed = columns.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("ordinal", "column"))).alias("c")).select("table", F.transform("c", lambda x: x["column"]).alias("c"))
    table = F.replace("table", F.lit("."), F.lit("_"))
    sql = F.concat(F.lit("CREATE INDEX CONCURRENTLY idx_"), table, F.lit("_"), F.array_join("c", "_"), F.lit(" ON "), F.col("table"), F.lit(" ("), F.array_join("c", ", "), F.lit(")"))
    return suggestions.join(listed, "table").select("table", sql.alias("statement"), F.lit("dry run" if dry_run else "planned").alias("status"))


def keep_view(spark: SparkSession, path: str, build: Callable[[], DataFrame], key: str | None = None) -> DataFrame:
    """Writes what ``build`` gives in full beside the old files and then takes their place, as a concurrent refresh; ``key`` must be unique."""
    new = build()
    if key and not new.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    version = f"{path}/v{time.time_ns()}"
    new.write.parquet(version)
    return spark.read.schema(new.schema).parquet(version)


def analyze(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> DataFrame:
    """``table, status, rows, seconds``: each table compacted under ``path`` and the planner's statistics computed for it."""
    out = []
    for name, df in tables.items():
        began, full = time.time(), f"analyzed_{name}_{time.time_ns()}"
        try:
            df.write.option("path", f"{path}/{full}").saveAsTable(full)
            spark.sql(f"ANALYZE TABLE {full} COMPUTE STATISTICS FOR ALL COLUMNS")
            told = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {full}").collect()}["Statistics"]
            rows, status = int(told.split(",")[1].split()[0]), "success"
        except Exception as e:  # the status is the result
            rows, status = None, f"error: {type(e).__name__}"
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {full}")
        out.append((name, status, rows, time.time() - began))
    return spark.createDataFrame(out, "table string, status string, rows long, seconds double")


# ---- backups ---------------------------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Files and folders in ``path``, of any store that Spark reads; none if it isn't there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def count_tables(spark: SparkSession, path: str) -> int:
    """Tables (``name.parquet``) in a folder."""
    return sum(n.endswith(".parquet") for n in names_in(spark, path))


def back_up(frames: dict[str, DataFrame], path: str, exclude: tuple[str, ...] = ()) -> list[str]:
    """Writes each table as JSON lines, but the excluded ones; names of those written."""
    done = [n for n in frames if n not in exclude]
    for n in done:
        frames[n].write.mode("overwrite").json(f"{path}/{n}")
    return done


def find_backup(spark: SparkSession, path: str, date: str | None = None, prefix: str = "backup-") -> str | None:
    """The latest ``prefix``date folder, or that of ``date``; None if there is none."""
    names = [n for n in names_in(spark, path) if n.startswith(prefix) and (date is None or n == prefix + date)]
    return max(names, default=None)


def restore(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a backup; it is an error if a file is missing."""
    there = names_in(spark, path)
    if missing := [n for n in schemas if n not in there]:
        raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")
    return {n: spark.read.schema(s).json(f"{path}/{n}") for n, s in schemas.items()}


def verify_backups(files: DataFrame) -> DataFrame:
    """``name, status`` of ``name, kind, content``: missing, empty, invalid JSON, invalid archive (no gzip mark) or ok."""
    gzip = F.startswith(F.hex("content"), F.lit("1F8B"))
    bad = F.when(F.col("content").isNull(), "missing").when(F.octet_length("content") == 0, "empty")
    bad = bad.when((F.col("kind") == "json") & ~valid_json(F.col("content").cast("string")), "invalid json").when((F.col("kind") == "archive") & ~gzip, "invalid archive")
    return files.select("name", bad.otherwise("ok").alias("status"))


def expired(files: DataFrame, as_of: float, horizons: dict[str, int], at: str = "t", kind: str = "kind") -> DataFrame:
    """Files older than their kind's number of full days; kinds without one are kept."""
    age = F.floor((as_of - F.col(at)) / 86400)
    old = F.lit(False)
    for k, days in horizons.items():
        old = old | ((F.col(kind) == k) & (age > days))
    return files.where(old)
