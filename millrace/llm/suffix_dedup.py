"""Suffix-array dedup: removes every byte covered by a string of ``length`` bytes that starts in two places or more.

Anchors are places that the bytes around them choose, so two copies of a string choose the same ones, and every string has
one. Only anchors whose next bytes occur twice are looked at; contexts of such an anchor that occur twice as a whole settle
each other. The others are the edges of copies: groups of them that agree on all but a few bytes are taken together, the
bytes around what they share are suffix sorted by linear grouping, and common prefixes in that order tell which strings occur
twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Rolling, join_counted, mix64, narrowed, row_key, small_batches, staged, unstage
from millrace.llm.suffix_array import suffix_array

KEY = ["k1", "k2"]
#: Bytes of the hashed string that ranks a place, and the places of which the least is an anchor.
GRAM, SPREAD = 16, 256
#: Places in a row at which the strings of one suffix sort may start, and strings of one sort.
WIDTH, CHUNK = 16, 4_000
#: Contexts that a task holds at once, about; a group of more is cut by the bytes that its strings share.
BATCH, MOST = 4_000, 3_000
_RANK, _HEAD, _CONTEXT = Rolling(21), Rolling(22), Rolling(23)


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` neighbours, by prefixes and suffixes of blocks."""
    f, fill = (np.minimum, np.iinfo(x.dtype).max) if least else (np.maximum, 0)
    n = len(x)
    pad = np.full(-(-n // width) * width, fill, x.dtype)
    pad[:n] = x
    rows = pad.reshape(-1, width)
    ahead = f.accumulate(rows, axis=1).ravel()
    behind = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``place, head, context, left, right`` of a document's anchors: one at least in the first ``SPREAD`` bytes of each window.

    ``head`` hashes the ``length - SPREAD`` bytes from the place on; ``context`` hashes up to ``SPREAD - 1`` bytes before
    it (``left``) and up to ``length`` from it on (``right``).
    """
    n = len(data)
    if n < length:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    head = length - SPREAD
    p = np.arange(n - head)
    ranks = _RANK.of(_RANK.prefix(data), p, p + GRAM)
    least = _sliding(ranks, SPREAD, True)
    edge = np.zeros(SPREAD - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), SPREAD, False) == ranks)
    heads = _HEAD.of(_HEAD.prefix(data), at, at + head)
    left, right = np.minimum(at, SPREAD - 1), np.minimum(n - at, length)
    contexts = mix64(_CONTEXT.of(_CONTEXT.prefix(data), at - left, at + right) + left.astype(np.uint64))  # the anchor's place counts
    return at, heads.view(np.int64), contexts.view(np.int64), left, right


def _bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary())


def _emit_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for k1, k2, t in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), _bytes(b.column(2)), strict=True):
                raw = t.as_py() or b""
                if len(raw) >= length:
                    a = anchors(np.frombuffer(raw, np.uint8), length)
                    found.append((np.full(len(a[0]), k1), np.full(len(a[0]), k2), *a))
            if found:
                c = [np.concatenate(x) for x in zip(*found, strict=True)]
                kinds = (np.int64, np.int64, np.int32, np.int64, np.int64, np.int32, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip(c, kinds, strict=True)], [*KEY, "place", "head", "context", "left", "right"])

    return run


# ---- edges of copies ----------------------------------------------------------------------------------------------------
#
# A context of an anchor is the bytes before it (``l``, reversed, up to SPREAD - 1) and those after its head (``r``, up to
# SPREAD). String x of a context takes x bytes of ``l``, the head and SPREAD - x bytes of ``r``. Strings lo to hi share what all
# of them hold, their core: ``lo`` bytes of ``l``, the head and SPREAD - hi bytes of ``r``.


def _prefix_hashes(rows: np.ndarray) -> np.ndarray:
    up = np.cumprod(np.full(rows.shape[1], _CONTEXT.base, np.uint64))
    out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    np.cumsum(_CONTEXT.table[rows] * up, axis=1, out=out[:, 1:])
    return out


def _matrix(parts: list[bytes], width: int, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros((len(parts), width), np.uint8)
    flat = np.frombuffer(b"".join(x[:n] for x, n in zip(parts, lengths, strict=True)), np.uint8)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _twice(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each key, and whether it has another member."""
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    return at, n[at] > 1


def repeated_strings(cls: np.ndarray, left: np.ndarray, right: np.ndarray, has_left: np.ndarray, has_right: np.ndarray) -> np.ndarray:
    """For each row, which of its ``width`` strings another row of its class has too.

    A row is ``width - 1`` bytes, its class as one symbol, and ``width - 1`` bytes; string x starts x bytes before the class
    and is ``width`` symbols long. ``has_left`` and ``has_right`` tell how many bytes there are on either side. All suffixes
    of all rows are sorted by linear grouping; two strings are equal if ``width`` symbols are common to suffixes that
    are neighbours in that order.
    """
    n, width = len(cls), left.shape[1] + 1
    away = np.arange(width - 1)
    # symbols: 0 ends all, 1 ends a row, 2 is a byte that there isn't
    l = np.where(away < has_left[:, None], left.astype(np.int64) + 3, 2)[:, ::-1]
    r = np.where(away < has_right[:, None], right.astype(np.int64) + 3, 2)
    rows = np.concatenate([l, cls[:, None] + 259, r, np.ones((n, 1), np.int64)], axis=1)
    text = np.append(rows.ravel(), 0)
    order = np.array(suffix_array(text.tolist()))[1:]
    row, at = np.divmod(order, 2 * width)
    some = at < width  # the strings that hold the class; they start x = width - 1 - at bytes before it
    row, at = row[some], at[some]
    window = np.lib.stride_tricks.sliding_window_view(text, width)[row * 2 * width + at]
    common = np.cumprod(window[1:] == window[:-1], axis=1).sum(axis=1)
    equal = common >= width
    twice = np.zeros(len(row), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    out = np.zeros((n, width), bool)
    out[row, width - 1 - at] = twice
    x = np.arange(width)
    return out & (x <= has_left[:, None]) & (width - 1 - x <= has_right[:, None])


def settle(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each context of a group (``key``): the least and the most x of ``lo`` to ``hi`` whose string another context of the
    group has too; SPREAD and -1 if there is none."""
    n = len(key)
    group = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    l_len, r_len = np.minimum([len(x) for x in left], hi), np.minimum([len(x) for x in right], SPREAD - lo)
    l, r = _matrix(left, SPREAD - 1, l_len), _matrix(right, SPREAD, r_len)
    hl, hr = _prefix_hashes(l), _prefix_hashes(r)

    def shared(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of a group, ``a`` bytes of ``l`` and SPREAD - b of ``r``."""
        return mix64(mix64(mix64(hl[rows, a] + a.astype(np.uint64)) ^ hr[rows, SPREAD - b]) + group[rows])

    least, most = np.full(n, SPREAD), np.full(n, -1)
    rows, a, width = np.arange(n), np.zeros(n, np.int64), SPREAD
    while width > WIDTH:
        # halves whose core another context of the group has too
        width //= 2
        rows, a = np.concatenate([rows, rows]), np.concatenate([a, a + width])
        fits = (l_len[rows] >= a) & (r_len[rows] >= SPREAD - (a + width - 1))
        rows, a = rows[fits], a[fits]
        _, some = _twice(shared(rows, a, a + width - 1))
        rows, a = rows[some], a[some]
    if not len(rows):
        return least, most
    b = a + width - 1
    cls, _ = _twice(shared(rows, a, b))
    # what the strings of a part hold together occurs twice: all of them do
    full = np.flatnonzero((l_len[rows] >= b) & (r_len[rows] >= SPREAD - a))
    _, first, at, times = np.unique(shared(rows[full], b[full], a[full]), return_index=True, return_inverse=True, return_counts=True)
    whole = full[times[at] > 1]
    np.minimum.at(least, rows[whole], a[whole])
    np.maximum.at(most, rows[whole], b[whole])
    # parts further out than any such part of their context, and all that share their core, but one of equal ones
    open_ = (a < least[rows]) | (b > most[rows])
    again = np.zeros(len(rows), bool)
    again[full[first[at] != np.arange(len(full))]] = True
    wanted = np.flatnonzero(np.isin(cls, cls[open_]) & ~again)
    wanted = wanted[np.argsort(cls[wanted], kind="stable")]
    ends = np.flatnonzero(np.diff(cls[wanted])) + 1
    begin = 0
    for end in [*ends, len(wanted)]:
        if end == begin or end - begin < CHUNK and end < len(wanted):
            continue
        w = wanted[begin:end]
        begin = end
        i, at, to = rows[w], a[w], b[w]
        before = np.pad(l, ((0, 0), (0, 1)))[i[:, None], at[:, None] + np.arange(width - 1)]
        after = r[i[:, None], (SPREAD - to)[:, None] + np.arange(width - 1)]
        found = repeated_strings(np.unique(cls[w], return_inverse=True)[1], before, after, l_len[i] - at, r_len[i] - (SPREAD - to))
        any_ = found.any(axis=1)
        np.minimum.at(least, i[any_], (at + found.argmax(axis=1))[any_])
        np.maximum.at(most, i[any_], (to - found[:, ::-1].argmax(axis=1))[any_])
    return least, most


def _settle_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def flush(b: pd.DataFrame) -> pd.DataFrame:
        least, most = settle(b["key"].to_numpy(), b["lo"].to_numpy(), b["hi"].to_numpy(), list(b["l"]), list(b["r"]))
        ok = most >= 0
        return pd.DataFrame({"head": b["head"][ok], "context": b["context"][ok], "least": least[ok], "most": most[ok]})

    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) < BATCH:
            continue
        whole = pd.concat(held, ignore_index=True)
        last = whole["key"] == whole["key"].iloc[-1]  # its group may go on
        if not last.all():
            yield flush(whole[~last].reset_index(drop=True))
        held = [whole[last]]
    if held and sum(map(len, held)):
        yield flush(pd.concat(held, ignore_index=True))


def _emit_contexts(length: int, hot: bool):
    """The bytes around the wanted anchors, of groups with over ``MOST`` contexts or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            rows: list[tuple] = []
            for k1, k2, raw, wanted in zip(b.column("k1"), b.column("k2"), _bytes(b.column("text")), b.column("wanted"), strict=True):
                if (key := (k1.as_py(), k2.as_py())) == last:
                    continue  # a repeated row
                last, raw = key, raw.as_py()
                for w in wanted.as_py():
                    if w["hot"] == hot:
                        at = w["place"]
                        rows.append((w["head"], w["context"], raw[max(0, at - SPREAD + 1) : at][::-1], raw[at + length - SPREAD : at + length]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["head", "context", "l", "r"])

    return run


def _keyed(items: DataFrame) -> DataFrame:
    """``key``: of the core of an item's strings; ``hull``: of all the bytes that they take, null if some are lacking."""
    key = f"xxhash64(head, lo, hi, substring(l, 1, lo), substring(r, 1, {SPREAD} - hi))"
    hull = f"xxhash64(head, lo, hi, substring(l, 1, hi), substring(r, 1, {SPREAD} - lo), 1)"
    return items.withColumns({"key": F.expr(key), "hull": F.expr(f"case when octet_length(l) >= hi and octet_length(r) >= {SPREAD} - lo then {hull} end")})


def _halves(items: DataFrame) -> DataFrame:
    """Each item as two, for the lower and the upper half of its strings; those that lack bytes of the core have none there."""
    mid = "cast((lo + hi + 1) div 2 as int)"
    both = f"array(named_struct('lo', lo, 'hi', {mid} - 1), named_struct('lo', {mid}, 'hi', hi))"
    fits = F.expr(f"explode(filter({both}, p -> octet_length(l) >= p.lo and octet_length(r) >= {SPREAD} - p.hi)) as p")
    return _keyed(items.select("head", "context", "l", "r", fits).select("head", "context", "l", "r", "p.lo", "p.hi"))


def _cut_down(items: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Items of groups of over ``most``: as items of smaller groups, and as ``head, context, least, most`` of those that are settled.

    In such a group, items that agree on all the bytes of their strings settle each other, and one of them stays; what is left
    is cut in halves by the strings it is about, and each half by the core of its strings. Groups are counted by partial
    aggregates, and those with many items are broadcast: none of them meets in a task.
    """
    small, settled, level = [], [], staged(_keyed(items), "items")
    while True:
        hot = staged(level.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"), "hot")
        small.append(level.join(F.broadcast(hot), "key", "left_anti").drop("hull"))
        if hot.isEmpty():
            break
        level = staged(level.join(F.broadcast(hot), "key"), "items")
        whole = staged(level.where("hull is not null").groupBy("hull").agg(F.count("*").alias("n"), F.min("context").alias("first")).where("n > 1"), "whole")
        level = staged(join_counted(level, whole, ["hull"], "n", "left"), "items")
        settled.append(level.where("n is not null").select("head", "context", F.col("lo").alias("least"), F.col("hi").alias("most")))
        level = staged(_halves(level.where("(n is null or context = first) and lo < hi")), "items")
    return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, settled, level.limit(0).select("head", "context", F.col("lo").alias("least"), F.col("hi").alias("most")))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a document that touch become one."""
    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    for b in batches:
        out = []
        for spans in b.column("spans"):
            merged: list[dict] = []
            for x in sorted(spans.as_py(), key=lambda x: x["s"]):
                if merged and x["s"] <= merged[-1]["e"]:
                    merged[-1]["e"] = max(merged[-1]["e"], x["e"])
                else:
                    merged.append(x)
            out.append(merged)
        removed = pa.array([sum(x["e"] - x["s"] for x in m) for m in out], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, span), removed], [*KEY, "spans", "n_removed"])


def _without(raw: bytes, spans: list[dict]) -> Iterator[bytes]:
    at = 0
    for x in spans:
        yield raw[at : x["s"]]
        at = x["e"]
    yield raw[at:]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for b in batches:
        out = []
        for k1, k2, raw, spans in zip(b.column("k1"), b.column("k2"), _bytes(b.column("text")), b.column("spans"), strict=True):
            if (key := (k1.as_py(), k2.as_py())) != last:  # else a repeated row
                out.append((*key, hashlib.sha256(b"".join(_without(raw.as_py(), spans.as_py()))).hexdigest()))
            last = key
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], [*KEY, "kept"])


_SPANS = "array<struct<s: int, e: int>>"


def _cuts(df: DataFrame, length: int) -> DataFrame:
    """``k1, k2, spans, n_removed`` of ``k1, k2, text`` rows that lose bytes, staged; one row for each key."""
    if length <= SPREAD + GRAM:
        raise ValueError(f"length must be over {SPREAD + GRAM}")
    small_batches(df.sparkSession)
    all_ = staged(df.mapInArrow(_emit_anchors(length), "k1 long, k2 long, place int, head long, context long, left int, right int"), "anchors")
    twice = staged(all_.groupBy("head").agg(F.count("*").alias("n")).where("n > 1"), "heads")
    found = staged(join_counted(all_, twice, ["head"], "n").drop("n"), "found")
    unstage(all_)
    contexts = staged(found.groupBy("head", "context").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "place", "left", "right")).alias("x")), "contexts")
    per_head = staged(contexts.groupBy("head").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").drop("least"), "kinds")
    open_ = join_counted(contexts, per_head, ["head"], "kinds").select("x.k1", "x.k2", F.struct("head", "context", "x.place", (F.col("kinds") > MOST).alias("hot")).alias("w"))
    wanted = staged(open_.groupBy(*KEY).agg(F.collect_list("w").alias("wanted")), "wanted")
    texts = staged(narrowed(df, wanted, "k1").join(wanted, KEY), "texts")

    def items(hot: bool) -> DataFrame:
        d = texts.mapInArrow(_emit_contexts(length, hot), "head long, context long, l binary, r binary")
        return d.withColumns({"key": F.col("head"), "lo": F.lit(0), "hi": F.lit(SPREAD - 1)})

    few, edges = items(False), None
    if not per_head.where(F.col("kinds") > MOST).isEmpty():
        small, edges = _cut_down(items(True).drop("key"), MOST)
        few = few.unionByName(small)
    sorted_ = few.repartition("key").sortWithinPartitions("key").mapInPandas(_settle_batches, "head long, context long, least int, most int")
    edges = sorted_ if edges is None else sorted_.unionByName(edges)
    edges = edges.groupBy("head", "context").agg(F.max("most").alias("before"), (length - F.min("least")).cast("int").alias("after"))
    single = contexts.where("n = 1").select("head", "context", "n")
    whole = contexts.where(f"n > 1 and x.left + x.right >= {length}").select("head", "context", "n", F.col("x.left").alias("before"), F.col("x.right").alias("after"))
    reach = staged(whole.unionByName(single.join(edges, ["head", "context"]).select(whole.columns)), "reach")
    spans = join_counted(found, reach, ["head", "context"], "n").select(*KEY, F.struct((F.col("place") - F.col("before")).alias("s"), (F.col("place") + F.col("after")).alias("e")).alias("span"))
    out = staged(spans.groupBy(*KEY).agg(F.collect_set("span").alias("spans")).mapInArrow(_merge, f"k1 long, k2 long, spans {_SPANS}, n_removed long"), "cuts")
    for x in (texts, found, contexts, reach):
        unstage(x)
    return out


def repeated_spans(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 400) -> DataFrame:
    """One row for each row of ``df``: ``doc_id, n_bytes, n_removed, spans`` (byte ranges), ``kept_sha256``.

    Texts are UTF-8 bytes, null is empty; matches stay within a document. Strings are judged on the input. Texts under
    ``length`` bytes lose nothing; very long ones are used whole; rows that repeat a text lose all of it if it is
    that long. Other columns are not read; null ids are kept; no rows give no rows. ``df`` is scanned several times, in
    any splits: rows are known by ``row_key``.

    What is shuffled: 44 bytes for each anchor (one in about 128 bytes), the texts that have edges of copies, and the
    bytes around those edges. Copies are counted by partial aggregates, and what many rows share is broadcast
    (``join_counted``) or cut down (``_cut_down``), so no passage's rows meet in one task.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.select(*row_key(doc_id, text), t.alias("text"))
    cuts = _cuts(base, length)
    plain = df.select(*row_key(doc_id, text), F.col(doc_id).alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("__sha"))
    d = plain.join(cuts, KEY, "left")
    part = staged(d.where("n_removed < n_bytes").select(*KEY, "spans").dropDuplicates(KEY), "parts")
    kept = narrowed(base, part, "k1").join(part, KEY).mapInArrow(_kept, "k1 long, k2 long, kept string").dropDuplicates(KEY)
    sha = F.when(F.col("n_removed") == F.col("n_bytes"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "__sha"))
    none = F.array().cast(_SPANS)
    return d.join(staged(kept, "kept"), KEY, "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("spans", none).alias("spans"), sha.alias("kept_sha256"))


def without_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 400) -> DataFrame:
    """``df`` with the spans cut out of its texts; bytes that no longer make a character are dropped."""
    cuts, names = _cuts(df.select(*row_key(doc_id, text), F.coalesce(F.col(text), F.lit("")).alias("text")), length), df.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text)
            pairs = zip(b.column(i), b.column("__spans"), strict=True)
            new = [t.as_py() if s.as_py() is None else b"".join(_without(t.as_py().encode(), s.as_py())).decode("utf-8", "ignore") for t, s in pairs]
            yield b.set_column(i, text, pa.array(new, pa.string())).select(names)

    d = df.withColumns({"__k1": row_key(doc_id, text)[0], "__k2": row_key(doc_id, text)[1]})
    d = d.join(cuts.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("spans").alias("__spans")), ["__k1", "__k2"], "left").drop("__k1", "__k2")
    return d.mapInArrow(cut, df.schema)
