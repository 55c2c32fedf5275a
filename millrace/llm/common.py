"""Shared plumbing of the training-data operators: staged tables, row keys, mergeable summaries."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First-level Misra-Gries summaries are merged in this many tasks before the driver merges those.
MERGE_TASKS = 16
#: Keys that are broadcast by a join for their many rows, and keys (of 16 bytes) by which a table is narrowed, at most.
HEAVY, FEW_KEYS = 4096, 2_000_000
#: Rows of two longs that are broadcast, at most (about 50 MB).
FEW_ROWS = 500_000
_FOLDERS: set[str] = set()
#: Caches that a Python worker keeps between the tasks of one operator.
KEPT: list[dict] = []


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, ``spark.checkpoint.dir``; it goes when the driver ends.

    Where that is unset, a local master (as in tests) gets a private folder; on a cluster it is an error, as executors
    would each write to a disk of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    path = f"{path.rstrip('/')}/millrace-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        _FOLDERS.add(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: later reads survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lets this session send rows to Python in small batches, so long texts and what is made of them don't add up in a worker."""
    for name, most, most_text in (("maxRecordsPerBatch", 1000, "1000"), ("maxBytesPerBatch", 4 << 20, "4194304b")):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most_text)


def forget() -> None:
    """Frees what this worker keeps of an earlier operator's tasks."""
    for cache in KEPT:
        cache.clear()


def give_back() -> None:
    """Returns freed memory to the system: workers live on, and an executor's limit counts them all."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator], keep: bool = False) -> Callable[[Iterator], Iterator]:
    """``run``, a task's function of batches, in a worker that holds no more than it needs: caches of other operators go first
    (``keep``: it uses them itself), and what the task has freed is returned at its end."""

    def task(batches: Iterator) -> Iterator:
        if not keep:
            forget()
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def unstage(df: DataFrame) -> None:
    """Deletes the files of a staged table that no later job reads."""
    for name in df.inputFiles()[:1]:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def row_key(doc_id: str, text: str) -> list[Column]:
    """``k1, k2``: 128 bits that follow from a row's id and text alone, so every scan gives a row the same key, however it is
    split. Rows that repeat both share a key."""
    return [F.xxhash64(F.col(doc_id), F.col(text)).alias("k1"), F.xxhash64(F.lit(1), F.col(text), F.col(doc_id)).alias("k2")]


def join_counted(left: DataFrame, right: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (``how``: inner or left), a staged table that tells in ``n`` how many rows of ``left`` have its key.

    Keys with over 1 in ``HEAVY`` of those rows (so ``HEAVY`` at most) are broadcast, and only the others are shuffled: no key's
    rows meet in one task.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    heavy = F.col(n) * HEAVY > total
    many = F.broadcast(right.where(heavy))
    rest = left.join(many.select(*on), on, "left_anti").join(right.where(~heavy), on, how)
    return left.join(many, on).unionByName(rest)


def narrowed(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows whose ``key`` (a long) is not in ``keys``, where those are few enough to be told to every task.

    A join follows in any case: beyond ``FEW_KEYS`` it gets all rows.
    """
    keys = keys.select(key).distinct()
    return df.join(F.broadcast(keys), key, "left_semi") if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS else df


def keep_rows(df: DataFrame, decided: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows of ``df`` whose ``k1, k2`` are kept in ``decided`` (staged: ``k1, k2, kept, once``); of rows that repeat one of those
    and have ``once``, one.

    Where the dropped keys are few enough to be told to every task, no text is shuffled.
    """
    key = ["__k1", "__k2"]
    by_key = decided.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.max("kept").alias("kept"), F.max("once").alias("once"), F.count("*").alias("n"))
    odd = staged(by_key.where("not kept or once and n > 1"), "odd")
    drop, again = odd.where("not kept").select(*key), odd.where("kept").select(*key)
    few = lambda d: F.broadcast(d) if d.limit(FEW_ROWS + 1).count() <= FEW_ROWS else d
    k1, k2 = row_key(doc_id, text)
    rows = df.withColumns({"__k1": k1, "__k2": k2}).join(few(drop), key, "left_anti")
    if not again.isEmpty():
        again = few(again)
        rows = rows.join(again, key, "left_anti").unionByName(rows.join(again, key, "left_semi").dropDuplicates(key))
    return rows.drop(*key)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row (a projection would be inlined into every use)."""
    return F.get(F.transform(F.array(value), body), 0)


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _trim(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) > k:
        counts = counts - np.partition(counts, len(counts) - k - 1)[len(counts) - k - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights=counts, minlength=len(u)).astype(np.int64)


def misra_gries(df: DataFrame, key: str, k: int) -> list[int]:
    """Every 64-bit value of ``key`` that more than 1/(k+1) of the rows have, and perhaps others: ``k`` values at most.

    One summary of ``k`` counters for each task, merged in ``MERGE_TASKS`` tasks and then on the driver, so neither
    memory nor what the driver gets depends on the number of rows. Nulls are left out.
    """

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            more = b["n"].to_numpy() if "n" in b else np.ones(len(b), np.int64)
            keys, counts = _trim(*_summed(np.concatenate([keys, b["key"].to_numpy()]), np.concatenate([counts, more])), k)
        yield pd.DataFrame({"key": keys, "n": counts})

    small_batches(df.sparkSession)
    first = df.select(F.col(key).cast("long").alias("key")).where("key is not null").mapInPandas(lean(summary), "key long, n long")
    merged = first.repartition(MERGE_TASKS).mapInPandas(lean(summary), "key long, n long").collect()
    keys, _ = _trim(*_summed(np.array([r["key"] for r in merged], np.int64), np.array([r["n"] for r in merged], np.int64)), k)
    return [int(x) for x in keys]


# ---- hashing of bytes and words --------------------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mul)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


class Rolling:
    """Hashes of any slice of a byte string: prefix sums of random byte values times powers of an odd base, modulo 2**64."""

    def __init__(self, seed: int):
        self.table = mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed << 20))
        self.base = int(mix64(np.array([seed], np.uint64))[0] | np.uint64(1))
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, 2 * n), _powers(self.inverse, 2 * n)
        out = np.zeros(n, np.uint64)
        np.cumsum(self.table[data] * self.up[: n - 1], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


WORDS = Rolling(11)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(text: str | bytes | None, lower: bool) -> np.ndarray:
    """One 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+`` of the whole text; ``lower`` folds A-Z first."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw.lower() if lower else raw, np.uint8)  # bytes.lower() changes A-Z only
    if not len(data):
        return np.empty(0, np.uint64)
    word = np.concatenate([[False], ~_SPACE[data], [False]]).view(np.int8)
    edge = np.diff(word)
    return WORDS.of(WORDS.prefix(data), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the n-word shingles; fewer words are one shingle, none are none."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    if n < 5:
        out = mix64(out + np.uint64(n))
    return np.unique(out)
