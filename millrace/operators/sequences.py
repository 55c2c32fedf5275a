"""State machines over ordered events. Each key's rows are sorted in one partition and folded as they stream by, so a key of
any length needs the memory of its state and nothing more."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(df: DataFrame, key: str, order: list[str], step: Callable[[object, tuple], tuple[object, tuple]], start: object, inputs: list[str], schema: str) -> DataFrame:
    """``key, *inputs`` and what ``step(state, values)`` returns for each row, in order; ``start`` is a new key's state."""
    new = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, began = None, start, False
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                if not began or row[0] != last:
                    last, state, began = row[0], start, True
                state, values = step(state, row[1:])
                out.append(values)
            yield pd.concat([b, pd.DataFrame(out, columns=new, index=b.index)], axis=1)

    d = df.select(key, *inputs)
    types = ", ".join(f"{c} {t}" for c, t in d.dtypes)
    return d.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, f"{types}, {schema}")


def fixed_window_limit(df: DataFrame, key: str = "user_id", ts: str = "t", event: str = "request_id", limit: int = 100, window: float = 3600) -> DataFrame:
    """A window opens at the first request after the last one ended; requests beyond ``limit`` are denied and still counted."""

    def step(state, row):
        anchor, n = state
        t = row[0]
        anchor, n = (t, 1) if anchor is None or t >= anchor + window else (anchor, n + 1)
        return (anchor, n), (n, n <= limit)

    return fold(df, key, [ts, event], step, (None, 0), [ts, event], "n long, allowed boolean")


def leaky_bucket(df: DataFrame, key: str = "user_id", ts: str = "t", event: str = "request_id", rate: float = 1 / 7200, burst: float = 2) -> DataFrame:
    """Excess drains at ``rate``; a request that would lift it over ``burst`` is rejected and changes nothing."""

    def step(state, row):
        excess, last = state
        new = 0.0 if last is None else max(0.0, excess - rate * (row[0] - last) + 1)
        if new > burst:
            return state, (False,)
        return (new, row[0]), (True,)

    return fold(df, key, [ts, event], step, (0.0, None), [ts, event], "accepted boolean")


def ttl_cache(df: DataFrame, key: str = "key", ts: str = "t", event: str = "request_id", ttl: float = 300) -> DataFrame:
    """A miss stores the key for ``ttl``; hits don't refresh it."""

    def step(stored, row):
        if stored is not None and row[0] < stored + ttl:
            return stored, (True,)
        return row[0], (False,)

    return fold(df, key, [ts, event], step, None, [ts, event], "hit boolean")


def token_cache(df: DataFrame, key: str = "user_id", ts: str = "t", event: str = "request_id", valid: str = "valid", ttl: float = 30) -> DataFrame:
    """As ``ttl_cache``, but only valid results are stored."""

    def step(stored, row):
        if stored is not None and row[0] < stored + ttl:
            return stored, (True,)
        return (row[0] if row[2] else None), (False,)

    return fold(df, key, [ts, event], step, None, [ts, event, valid], "hit boolean")


def micro_batch(df: DataFrame, key: str = "service", ts: str = "t", event: str = "request_id", size: int = 8, wait: float = 0.05) -> DataFrame:
    """A batch closes at ``size`` items or ``wait`` seconds after its first; service itself takes no time in this replay."""

    def step(state, row):
        batch, first, n = state
        batch, first, n = (batch + 1, row[0], 1) if first is None or n >= size or row[0] > first + wait else (batch, first, n + 1)
        return (batch, first, n), (batch, n)

    return fold(df, key, [ts, event], step, (0, None, 0), [ts, event], "batch long, place long")


def lru_cache(df: DataFrame, capacity: int, shard: str = "shard", key: str = "key", ts: str = "t", event: str = "request_id") -> DataFrame:
    """``hit`` and ``evicted`` (a key or null) for each access of a shard's cache, exact: a hit is the newest again, and beyond
    ``capacity`` keys the oldest goes. A task holds that many keys."""

    def step(state, row):
        state = state.copy() if not state else state  # the start value is shared
        hit, out = row[2] in state, None
        state.pop(row[2], None)
        state[row[2]] = True
        if len(state) > capacity:
            out = next(iter(state))
            del state[out]
        return state, (hit, out)

    return fold(df, shard, [ts, event], step, {}, [ts, event, key], "hit boolean, evicted string")


def least_connections(df: DataFrame, backends: int = 3, fails: int = 3, out_s: float = 30, pool: str = "pool", ts: str = "t", event: str = "request_id", duration: str = "duration", ok: str = "ok") -> DataFrame:
    """``backend`` for each request: the one with the fewest open connections, the first of equal ones; ``fails`` failures in a row take a
    backend out for ``out_s`` seconds, unless all are out. A task holds the open connections."""

    def step(state, row):
        ends, failed, until = state or ([[] for _ in range(backends)], [0] * backends, [float("-inf")] * backends)
        t, length, good = row[0], row[2], row[3]
        ends = [[e for e in some if e > t] for some in ends]
        live = [i for i in range(backends) if until[i] <= t] or list(range(backends))
        i = min(live, key=lambda k: (len(ends[k]), k))
        ends[i].append(t + length)
        failed = [0 if k == i and good else failed[k] + (k == i and not good) for k in range(backends)]
        if failed[i] >= fails:
            until, failed = [t + out_s if k == i else until[k] for k in range(backends)], [0 if k == i else failed[k] for k in range(backends)]
        return (ends, failed, until), (i,)

    return fold(df, pool, [ts, event], step, None, [ts, event, duration, ok], "backend int")


def concurrent(df: DataFrame, limit: int, key: str = "user_id", ts: str = "t", duration: str = "duration") -> DataFrame:
    """``key, peak, over``: the most requests of a key that run at once (ends come before starts), and whether that is over ``limit``."""
    edge = F.explode(F.array(F.struct(F.col(ts).alias("t"), F.lit(1).alias("d")), F.struct((F.col(ts) + F.col(duration)).alias("t"), F.lit(-1).alias("d")))).alias("e")
    running = F.sum("e.d").over(Window.partitionBy(key).orderBy("e.t", "e.d").rowsBetween(Window.unboundedPreceding, 0))
    return df.select(key, edge).select(key, running.alias("c")).groupBy(key).agg(F.max("c").alias("peak")).withColumn("over", F.col("peak") > limit)


def rate_rule(df: DataFrame, limit: int, seconds: float, key: str = "user_id", ts: str = "t", event: str = "request_id") -> DataFrame:
    """``event, n, blocked``: a key's requests in the ``seconds`` up to each, and whether that is over ``limit``."""
    recent = Window.partitionBy(key).orderBy(ts).rangeBetween(-seconds, 0)
    return df.select(event, F.count("*").over(recent).alias("n")).withColumn("blocked", F.col("n") > limit)


def sampled(df: DataFrame, every: float, key: str, ts: str = "t", event: str = "id") -> DataFrame:
    """The first row of a key in each period, as a sampler that wakes that often would take it."""
    first = Window.partitionBy(key, F.floor(F.col(ts) / every)).orderBy(ts, event)
    return df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def polled(df: DataFrame, every: float, key: str, status: str, ts: str = "t", event: str = "id") -> DataFrame:
    """``key, tick, status``: what a poll every so many seconds sees of a key, from its first event to its last: the latest status."""
    tick = (F.floor(F.col(ts) / every) + 1).cast("long")
    last = df.groupBy(key, tick.alias("tick")).agg(F.max_by(status, F.struct(ts, event)).alias("s"))
    span = last.groupBy(key).agg(F.min("tick").alias("a"), F.max("tick").alias("b"))
    ticks = span.select(key, F.explode(F.sequence("a", "b")).alias("tick"))
    seen = F.last("s", ignorenulls=True).over(Window.partitionBy(key).orderBy("tick"))
    return ticks.join(last, [key, "tick"], "left").select(key, (F.col("tick") * every).alias("tick"), seen.alias("status"))


def retry_wait(attempts: Column, delay: float, most: int = 3) -> Column:
    """Seconds that a call has waited after so many failed attempts: ``delay * k`` after the k-th, and none after the last."""
    k = F.least(attempts, F.lit(most - 1))
    return F.lit(delay) * k * (k + 1) / 2


def interval_peak(runs: DataFrame, samples: DataFrame, run: str, key: str, start: str, end: str, at: str, value: str, step: float) -> DataFrame:
    """``run, peak``: the largest sample of the run's key taken from ``start`` up to ``end``; runs without one have no row.

    Runs and samples meet by key and stretch of ``step`` seconds, so a hot key's rows are dealt over its time.
    """
    part = lambda t: F.floor(t / step).cast("long")
    r = runs.select(run, key, start, end, F.explode(F.sequence(part(F.col(start)), part(F.col(end)))).alias("__part"))
    s = samples.select(key, at, value, part(F.col(at)).alias("__part"))
    return r.join(s, [key, "__part"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).groupBy(run).agg(F.max(value).alias("peak"))
