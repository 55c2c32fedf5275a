"""Structured Streaming forms: tumbling statistics with alarms, and the anchored limiter as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of event files as a stream; ``ts`` becomes an instant, so watermarks work."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_stats(events: DataFrame, period: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", period)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("average")).select(F.col("window.start").alias("start"), "event_type", "n", "average")


def alarms(stats: DataFrame, limit: float, seconds: float, key: str = "event_type", value: str = "average", start: str = "start") -> DataFrame:
    """``key, start, alarm`` of periods that have one before them: this one and the one right before are over ``limit``."""
    w = Window.partitionBy(key).orderBy(start)
    d = stats.select(key, F.col(start).cast("double").alias("start"), (F.col(value) > limit).alias("breach"))
    d = d.withColumns({"before": F.lag("breach").over(w), "prior": F.lag("start").over(w)}).where("prior is not null")
    return d.select(key, F.col("start").cast("long").alias("start"), (F.col("breach") & F.col("before") & (F.col("start") - F.col("prior") == seconds)).alias("alarm"))


def alarm_stream(events: DataFrame, path: str, checkpoint: str, limit: float, seconds: int = 3600) -> StreamingQuery:
    """Alarms over a stream of events: statistics by periods are the stream's state; each trigger tells the alarms as they stand, in
    a folder of its own, so a trigger that is run again replaces its own files."""
    w = F.window("ts", f"{seconds} seconds")
    stats = events.groupBy(w, "event_type").agg(F.avg("value").alias("average")).select(F.col("window.start").alias("start"), "event_type", "average")

    def each(batch: DataFrame, i: int) -> None:
        alarms(batch, limit, seconds).write.mode("overwrite").parquet(f"{path}/trigger={i}")

    q = stats.writeStream.foreachBatch(each).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def limiter(events: DataFrame, limit: int = 100, window_s: float = 3600.0) -> DataFrame:
    """``user_id, n, allowed`` of each request; the anchor and count of a user are state, events of a trigger go in time order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        out = []
        for t in rows["t"]:
            anchor, n = (t, 1) if anchor is None or t >= anchor + window_s else (anchor, n + 1)
            out.append((key[0], n, n <= limit))
        state.update((anchor, n))
        yield pd.DataFrame(out, columns=["user_id", "n", "allowed"])

    d = events.select("user_id", "event_id", F.col("ts").cast("double").alias("t"))
    return d.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, allowed boolean", "anchor double, n long", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything there is now, as Parquet; the checkpoint lets a restarted query go on where it was."""
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q


def refresh_view(df: DataFrame, path: str, build, checkpoint: str) -> StreamingQuery:
    """Rebuilds a summary table from each micro-batch's arrival on (a full refresh, as the cron job does)."""

    def each(batch: DataFrame, _: int) -> None:
        build(batch).write.mode("append").parquet(path)

    q = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def on_arrival(spark: SparkSession, path: str, refresh: Callable[[], object], checkpoint: str) -> StreamingQuery:
    """Runs ``refresh`` once for whatever has arrived in a folder since the last time."""
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    q = source.writeStream.foreachBatch(lambda batch, i: None if batch.isEmpty() else refresh() and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
