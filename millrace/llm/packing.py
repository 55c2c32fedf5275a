"""Best-fit packing of token sequences by minimum bin slack over a histogram of lengths."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import KEPT, lean, small_batches, staged

END_ID = 1
#: Positions of the order that are packed together by ``pack_in_order``: ten periods of a mix of 25 blocks of 16 documents.
WINDOW = 4096
#: White-space words that a generation of a worker's cache holds, and their bytes at most.
CACHE_WORDS, CACHE_LENGTH = 200_000, 64
#: How the tokenizers that are taken apart here normalize and split. Any other kind encodes whole texts.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters alone (but the one whose lower case is two) are split by the same rule in the terms of ``re``.
_LATIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[\d\u00b2\u00b3\u00b9\u00bc-\u00be]|(?:[^\w\s]|_)+")
#: The character for each byte in a byte-level vocabulary: printable Latin ones are themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}
_CACHE: dict[str, WordTokens] = {}
KEPT.append(_CACHE)


class Recent(dict):
    """``make(key)`` of what was asked for lately: ``most`` keys become the old generation, and those used again move on."""

    def __init__(self, most: int, make: Callable):
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_LENGTH:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordTokens:
    """Ids of whole texts; a word is taken apart and merged once, as long as a worker remembers it, where the tokenizer splits as ``_SPLIT`` does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.specials = tuple(t.content.lower().encode() for t in self.whole.get_added_tokens_decoder().values())
        self.words, self.merge = Recent(CACHE_WORDS, self.word), self.model.tokenize
        own = json.loads(self.whole.to_str())
        kinds = [x["type"] for x in (own["normalizer"] or {}).get("normalizers", ())]
        split, *rest = (own["pre_tokenizer"] or {}).get("pretokenizers", [None])
        self.by_words = kinds == _NORMALIZERS and bool(rest) and split.get("pattern", {}).get("Regex") == _SPLIT and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]

    @staticmethod
    def at(path: str) -> WordTokens:
        """One for each worker and file."""
        if path not in _CACHE:
            _CACHE[path] = WordTokens(path)
        return _CACHE[path]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        raw = text.encode("utf-8", "replace")
        low = raw.lower()  # A-Z only
        if not self.by_words or any(s in low for s in self.specials):
            return _packed(self.whole.encode(raw.decode(), add_special_tokens=False).ids)
        # a letter and a combining accent (bytes CC and CD) are joined before the case is folded
        words = (raw if b"\xcc" in raw or b"\xcd" in raw else low).split()  # at ASCII white space only
        known = self.words
        return b"".join([known[w] for w in words])

    def word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if not _LATIN.fullmatch(word):
            return _packed(self.whole.encode(word, add_special_tokens=False).ids)
        merge, pieces = self.merge, _PIECE.findall(word.lower())
        return _packed([t.id for p in pieces for t in merge(p if p.isascii() else p.encode().decode("latin-1").translate(_CHARS))])


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def minimum_bin_slack(counts: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as ``([(length, copies), ...], times)``: the same filling is used ``times`` times.

    Each filling starts from the longest length left; a bitset holds which sums of the lengths left reach which total,
    and the largest total that fits is taken apart again, longer lengths first. The filling is repeated while its
    lengths last, so the work depends on the number of distinct lengths and not on the number of pieces.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    full = (1 << (size + 1)) - 1
    while left:
        first = max(left)
        room = size - first
        lengths = sorted((k for k in left if k <= room), reverse=True)
        sums, layers = 1, []
        for k in lengths:
            n, step = min(left[k] - (k == first), room // k), 1
            while n > 0:
                take = min(step, n)
                layers.append((k, take, sums))
                sums |= (sums << (k * take)) & full
                n, step = n - take, step * 2
            if sums >> room & 1:
                break
        total = (sums & ((1 << (room + 1)) - 1)).bit_length() - 1
        use = {first: 1}
        for k, take, before in reversed(layers):
            if not before >> total & 1:
                total -= k * take
                use[k] = use.get(k, 0) + take
        times = min(left[k] // n for k, n in use.items())
        out.append((sorted(use.items(), reverse=True), times))
        for k, n in use.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def token_pieces(df: DataFrame, tokenizer: str, text: str, doc_id: str, size: int, order: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, nth``: ``nth`` counts the pieces of a length in a task's output.

    With ``order``, a column of that kind of position, ``nth`` is its value instead.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = WordTokens.at(tokenizer), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        end = END_ID.to_bytes(4, "little")
        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1)
            at_order = b.column(2).to_pylist() if order else None
            out: list[tuple] = []
            for i, doc in enumerate(docs):
                ids = words.ids(texts[i].as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    n = len(own) // 4
                    out.append((doc, piece, at // 4, n, zlib.crc32(own), part, at_order[i] if order else int(seen[n])))
                    seen[n] += 1
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    small_batches(df.sparkSession)
    d = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).cast("long").alias("order") for c in [order] if c])
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(lean(cut, keep=True), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", size: int = 4096) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece of each row of ``df``.

    A document is its ids and then id 1 (null text: only that). Longer ones than ``size`` are cut; nothing else is. Rows
    that repeat a document are packed each for itself; null ids stay null. No rows give no pieces; other columns are
    not read.

    Only the histogram of lengths (``size`` numbers) reaches the driver. A piece's rank among those of its length is its
    place in its task's output plus the count of earlier tasks, so no length gathers in one task; the plan maps ranks to
    sequences in runs and its size depends on ``size`` alone.
    """
    spark = df.sparkSession
    pieces = staged(token_pieces(df, tokenizer, text, doc_id, size), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}

    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used = dict.fromkeys(counts, 0)
    sequence = 0
    for filling, times in minimum_bin_slack(counts, size):
        offset = 0
        for length, copies in filling:
            runs.setdefault(length, []).append((used[length], sequence, copies, offset))
            used[length] += copies * times
            offset += length * copies
        sequence += times
    held = spark.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in runs.items()})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank, length = (b["nth"] + b["base"]).to_numpy(), b["length"].to_numpy()
            seq, off = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                start, first, copies, at = held.value[int(k)]
                i = np.searchsorted(start, rank[own], side="right") - 1
                turn, nth = np.divmod(rank[own] - start[i], copies[i])
                seq[own], off[own] = first[i] + turn, at[i] + nth * k
            yield b.drop(columns=["part", "nth", "base"]).assign(sequence_id=seq, offset=off)

    kind = pieces.schema["doc_id"].dataType.simpleString()
    ready = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "base")
    return ready.mapInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _packed_window(b: pd.DataFrame, size: int) -> pd.DataFrame:
    """``b``'s pieces with ``own``, the sequence's number in this window, and ``offset``.

    Pieces of a length are dealt by position, and sequences are numbered by the position of their longest piece.
    """
    b = b.sort_values(["nth", "piece", "doc_id", "ids_crc32"], ignore_index=True)
    length, place = b["length"].to_numpy(), b["nth"].to_numpy()
    left = {int(k): iter(np.flatnonzero(length == k)) for k in np.unique(length)}
    seq, off, leader, n = np.empty(len(b), np.int64), np.empty(len(b), np.int64), [], 0
    for filling, times in minimum_bin_slack({int(k): int(c) for k, c in zip(*np.unique(length, return_counts=True), strict=True)}, size):
        for _ in range(times):
            at = 0
            for k, copies in filling:
                for _ in range(copies):
                    i = next(left[k])
                    if at == 0:
                        leader.append(place[i])
                    seq[i], off[i] = n, at
                    at += k
            n += 1
    number = np.empty(n, np.int64)
    number[np.argsort(np.array(leader), kind="stable")] = np.arange(n)
    return b.assign(own=number[seq], offset=off)


def pack_in_order(df: DataFrame, tokenizer: str, order: str, text: str = "text", doc_id: str = "doc_id", size: int = 4096) -> DataFrame:
    """``pack`` with sequences that follow ``order``, a column of distinct non-negative positions (as ``mix_position``).

    Each ``WINDOW`` positions are packed by themselves, and the sequences of a window come before those of the next: any
    run of windows' sequences holds the documents, and so the sources, of that run of positions. A window costs at
    most one sequence that is not full for want of pieces.

    A task holds the lengths of one window; its size doesn't depend on the number of rows. The number of sequences of each window
    is summed up in one task: one row for ``WINDOW`` documents.
    """
    pieces = token_pieces(df, tokenizer, text, doc_id, size, order).withColumn("window", F.expr(f"nth div {WINDOW}")).drop("part")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    packed = pieces.groupBy("window").applyInPandas(lambda b: _packed_window(b, size), f"{kinds}, own long, offset long")
    packed = staged(packed, "packed")
    counts = packed.groupBy("window").agg((F.max("own") + 1).alias("n"))
    before = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("window", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ready = packed.join(F.broadcast(base), "window").withColumn("sequence_id", F.col("own") + F.col("base"))
    return ready.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
