"""N-gram Jaccard join: exact links at a similarity of 0.75 between sets of 5-word shingles, by set-relation skipping.

1. Every text becomes a sorted set of 64-bit shingle hashes; equal sets form one class with one representative.
2. A representative's signature is its first shingles in an order that puts common ones last. Signatures that share
   enough shingles make candidate links; their components bound which sets can be linked at all. ``exact`` takes
   signatures of the full length that linked sets need; else they stop where a miss is less likely than two equal hashes.
3. The sets of a candidate component meet once. There an index keeps, for each shingle, blocks of (size, position); blocks
   whose position leaves too little overlap are skipped, and a set that is highly similar to an earlier one takes its
   overlaps from that one's, corrected by the few shingles in which the two differ.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import join_counted, keep_rows, lean, mix64, row_key, shingle_hashes, small_batches, staged, unstage, word_hashes
from millrace.llm.components import components

#: A link needs NUM / DEN of the union.
NUM, DEN = 3, 4
KEY = ["k1", "k2"]
#: Shingles in so many signatures come last in the order; lists of up to this length give all pairs.
COMMON = 32
#: Times that signatures are made anew, at most, to be rid of common shingles; any that stay only cost time.
ROUNDS = 1
#: Shared shingles of two signatures that make a candidate.
SHARED = 3
#: Odds of a missed candidate, far below those of two equal 64-bit hashes.
MISS = 1e-20
#: Bits of the filters by which tasks know wanted rows and common shingles; full ones only cost time.
FILTER_BITS = 1 << 26
#: Hashes and sets that one verification task holds, about; larger components are verified in pairs of blocks.
BLOCK, BLOCK_SETS = 1_500_000, 20_000


def linked(overlap: int, a: int, b: int) -> bool:
    return DEN * overlap >= NUM * (a + b - overlap)


def least_overlap(a, b):
    """The smallest overlap of linked sets of sizes ``a`` and ``b``."""
    return -(-NUM * (a + b) // (NUM + DEN))


def _log_tail(n: int, miss: float) -> float:
    """Log of the odds that under ``SHARED`` of ``n`` draws are shared, when one is missed with odds ``miss``."""
    from math import comb, log

    return log(sum(comb(n, i) * (1 - miss) ** i * miss ** (n - i) for i in range(SHARED)))


def _limits() -> list[int]:
    """By the share of common shingles in steps of 5 %: so many first shingles bring the odds of a miss under ``MISS``."""
    out = []
    for i in range(21):
        miss = 0.25 / (1 - i / 20) if i < 15 else 1
        out.append(next((n for n in range(4, 400) if _log_tail(n, miss) < np.log(MISS)), 1 << 40) if miss < 0.7 else 1 << 40)
    return out


LIMITS = _limits()


def signature(tokens: np.ndarray, is_common: np.ndarray, exact: bool) -> np.ndarray:
    """The shingles, of a sorted set, by which it is found: in order of hash, common ones last.

    Two linked sets share ``SHARED`` of the first ``size - least overlap + SHARED`` shingles of each; ``exact`` takes all
    those. In an order that is random to the sets, far fewer do: of the union's first ``n`` each is shared with odds of 3/4
    (less what the common ones may take, and one step of the table for those not yet known), so ``LIMITS`` cuts where a
    miss is less likely than two equal hashes.
    """
    n = len(tokens)
    need = -(-NUM * n // DEN)
    take = n - need + min(SHARED, need)
    if not exact:
        take = min(take, LIMITS[min(20, int(np.ceil(20 * is_common.sum() / n)) + 1)])
    rare = tokens[~is_common]
    return rare[:take] if len(rare) >= take else np.concatenate([rare, tokens[is_common][: take - len(rare)]])


def _filter(keys: DataFrame, key: str) -> np.ndarray:
    """``FILTER_BITS`` bits as bytes, whatever the number of keys: made by partial aggregates of 4 KB each."""
    place = F.col(key).bitwiseXOR(F.shiftright(F.col(key), 33)).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    parts = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _may_have(bits: np.ndarray | None, key: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.zeros(len(key), bool)
    p = (key ^ (key >> 33)) & (FILTER_BITS - 1)
    return (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def _sets(df: DataFrame, keep: list[str], lower: bool, exact: bool = False, common: np.ndarray | None = None, only: np.ndarray | None = None, whole: bool = False) -> DataFrame:
    """Of ``k1, k2, text`` rows: ``keep`` columns, ``n, hi, lo, tokens``: two hashes of the whole set, and the signature or, if ``whole``,
    the set itself.

    ``only``: a filter; rows whose ``k1`` it can't have are left out before their text is read, and a task gives a row that
    is repeated there once.
    """
    held = df.sparkSession.sparkContext.broadcast((common, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, only = held.value
        seen: set[int] = set()
        for b in batches:
            if only is not None:
                k1 = b.column("k1").to_numpy()
                first = np.zeros(len(k1), bool)
                first[np.unique(k1, return_index=True)[1]] = True
                first &= _may_have(only, k1)
                for i in np.flatnonzero(first):
                    first[i] = (k := int(k1[i])) not in seen
                    seen.add(k)
                b = b.filter(pa.array(first))
            n, hi, lo, out = [], [], [], []
            for t in b.column("text"):
                s = shingle_hashes(word_hashes(t.as_py(), lower))
                n.append(len(s))
                hi.append(int(np.bitwise_xor.reduce(mix64(s + np.uint64(1)))) - (1 << 63) if len(s) else 0)
                lo.append(int(mix64(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)) - (1 << 63) if len(s) else 0)
                if len(s) and not whole:
                    s = signature(s, _may_have(common, s.view(np.int64)), exact)
                out.append(s.view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            flat = pa.array(np.concatenate(out) if out else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], [*keep, "n", "hi", "lo", "tokens"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.select(*dict.fromkeys([*keep, "k1", "text"])).mapInArrow(lean(run), f"{kinds}, n long, hi long, lo long, tokens array<long>")


def link_sets(keys: list[int], sets: list[np.ndarray], side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join up, as far as they go, all linked sets of the input: at most one for each set and component.

    ``side``: only links between side 0 and side 1 are asked for.

    Skipping in the index: each shingle's list is cut into blocks of one size class, position class and component. A
    block is passed over unread if its sizes or places leave too little overlap, or if its component is joined already.
    Skipping by answers: a set that links to a component is kept as its difference from the component's leader. The
    overlap of a later set with the leader is computed once; that with each follower is bounded by it, and derived from
    it by the shingles in the difference.
    """
    if not sets:
        return []
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), keys[i]))
    tokens, count = np.unique(np.concatenate(sets), return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, count))] = np.arange(len(tokens))
    ordered = [np.sort(rank[np.searchsorted(tokens, s)]) for s in sets]
    lone = int((count == 1).sum())  # shingles of one set come first; they hold places but need no lists
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    lists: dict[int, dict[tuple[int, int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
    relation: dict[int, tuple[int, int, np.ndarray, np.ndarray]] = {}  # leader, overlap with it, leader without set, set without leader
    out = []
    for x in order:
        r, n = ordered[x], len(sets[x])
        prefix = [(pos, int(t)) for pos, t in enumerate(r[: n - (-(-NUM * n // DEN)) + 1]) if t >= lone]
        with_leader: dict[int, int] = {}
        seen: set[int] = set()
        followed = None
        for pos, t in prefix:
            for (size_class, pos_class, part), members in lists.get(t, {}).items():
                big, small = (1 << size_class) - 1, 1 << (size_class - 1)
                most = 1 + min(n - pos - 1, big - ((1 << pos_class) >> 1) - 1)
                if find(part) == find(x) or DEN * big < NUM * n or most < least_overlap(n, max(small, -(-NUM * n // DEN))):
                    continue
                for y in members:
                    if y in seen or side and side[x] == side[y] or find(x) == find(y):
                        continue
                    seen.add(y)
                    m, (leader, own, less, more) = len(sets[y]), relation[y]
                    need = least_overlap(n, m)
                    if DEN * m < NUM * n:
                        continue
                    if leader not in with_leader:
                        with_leader[leader] = _hits(r, ordered[leader])
                    o = with_leader[leader]
                    if min(o, own) + min(n - o, m - own) < need:
                        continue
                    o += _hits(more, r) - _hits(less, r)
                    if linked(o, n, m):
                        out.append((keys[x], keys[y]))
                        root[find(x)] = find(y)
                        if followed is None:
                            followed = leader
        if followed is None:
            relation[x] = (x, n, r[:0], r[:0])
        else:
            a = ordered[followed]
            relation[x] = (followed, with_leader[followed], np.setdiff1d(a, r, True), np.setdiff1d(r, a, True))
        for pos, t in prefix:
            lists[t][n.bit_length(), pos.bit_length(), find(x)].append(x)
    return out


def _hits(a: np.ndarray, b: np.ndarray) -> int:
    """Shared members of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _candidates(signatures: DataFrame) -> DataFrame:
    """``a, b`` of representatives whose signatures share enough; long lists give a star instead of pairs."""
    e = signatures.select("rep", "n", F.explode("tokens").alias("t"))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows_a, rows_b, w = [], [], []
            for reps, sizes in zip(b["reps"], b["sizes"], strict=True):
                o = np.lexsort((reps, sizes))
                reps, sizes = np.asarray(reps)[o], np.asarray(sizes)[o]
                i, j = np.triu_indices(len(reps), 1)
                ok = DEN * sizes[i] >= NUM * sizes[j]
                need = np.minimum(SHARED, -(-NUM * sizes[i][ok] // DEN))
                rows_a.append(np.minimum(reps[i][ok], reps[j][ok]))
                rows_b.append(np.maximum(reps[i][ok], reps[j][ok]))
                w.append(need)
            cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
            yield pd.DataFrame({"a": cat(rows_a), "b": cat(rows_b), "need": cat(w).astype(np.int32)})

    lists = staged(e.groupBy("t").agg(F.count("*").alias("c"), F.min("rep").alias("m")).where("c > 1"), "lists")
    e = staged(join_counted(e, lists, ["t"], "c"), "entries")
    star = e.where(F.col("c") > COMMON).where("rep <> m").select(F.col("rep").alias("a"), F.col("m").alias("b")).distinct()
    short = e.where(F.col("c") <= COMMON).groupBy("t").agg(F.collect_list("rep").alias("reps"), F.collect_list("n").alias("sizes"))
    near = short.select("reps", "sizes").mapInPandas(lean(pairs), "a long, b long, need int").groupBy("a", "b").agg(F.count("*").alias("c"), F.min("need").alias("need")).where("c >= need")
    return star.unionByName(near.select("a", "b"))


def _verify(sets: DataFrame) -> DataFrame:
    """``rep, group, parts, part, tokens`` to links ``a, b``: one task a group, or one for each pair of its parts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        side = None if i == j else (pdf["part"].to_numpy() == j).astype(int).tolist()
        found = link_sets([int(x) for x in pdf["rep"]], [np.asarray(x, np.int64).view(np.uint64) for x in pdf["tokens"]], side)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(F.col("part"), k).alias("i"), F.greatest(F.col("part"), k).alias("j")))
    return sets.withColumn("cell", F.explode(other)).select("rep", "tokens", "part", "group", "cell.*").groupBy("group", "i", "j").applyInPandas(run, "a long, b long")


def _signatures(base: DataFrame, reps: DataFrame, lower: bool, exact: bool) -> DataFrame:
    """``rep, n, tokens``: signatures with common shingles last, as far as ``ROUNDS`` bring it.

    A shingle is common if over ``COMMON`` signatures have it. A round makes the signatures anew of which one has such a
    shingle (the first round: all); the others stay as they are, as theirs come first in the new order too.
    """
    now, common = reps.select("rep", "n", "tokens"), None
    for turn in range(ROUNDS):
        long = now.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") > COMMON)
        more = _filter(long, "t")
        fresh = more if common is None else more & ~common
        if not fresh.any():
            break
        common = more if common is None else common | more
        keys = reps.select("rep", *KEY)
        if turn:
            held = base.sparkSession.sparkContext.broadcast(fresh)

            def has_fresh(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    lists = b.column("tokens")
                    hit = np.concatenate([[0], np.cumsum(_may_have(held.value, lists.flatten().to_numpy()))])
                    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                    yield b.filter(pa.array(hit[ends[1:]] > hit[ends[:-1]])).select(["rep"])

            keys = keys.join(staged(now.mapInArrow(lean(has_fresh), "rep long"), "again"), "rep")
        keys = staged(keys, "wanted")
        made = _sets(base, KEY, lower, exact, common, _filter(keys, "k1")).join(keys, KEY).select("rep", "n", "tokens")
        now = staged(made if not turn else now.join(keys, "rep", "left_anti").unionByName(made), "signatures")
    return now


def _components(df: DataFrame, text: str, doc_id: str, lower: bool, exact: bool) -> DataFrame:
    """``k1, k2, doc_id, n, component_id, root, least`` for each row: ``least`` has the key of the component's first row."""
    small_batches(df.sparkSession)
    base = df.select(*row_key(doc_id, text), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = staged(_sets(base, [*KEY, "doc_id"], lower, exact), "signed")
    classes = signed.where("n > 0").groupBy("hi", "lo", "n").agg(F.min(F.struct(*KEY, "tokens")).alias("x"), F.count("*").alias("rows"))
    reps = staged(classes.select("hi", "lo", "n", "rows", "x.*").withColumn("rep", F.monotonically_increasing_id()), "classes")  # made once, then read
    signatures = _signatures(base, reps, lower, exact)
    groups = staged(components(_candidates(signatures)).select(F.col("node").alias("rep"), F.col("component").alias("group")), "groups")
    sized = groups.join(reps.select("rep", "n", *KEY), "rep")
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / BLOCK_SETS)).cast("int")
    parts = staged(sized.groupBy("group").agg(blocks.alias("parts"), F.count("*").alias("sets")), "parts")
    placed = staged(join_counted(sized.drop("n"), parts, ["group"], "sets").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")), "placed")
    full = _sets(base, KEY, lower, only=_filter(placed, "k1"), whole=True).select(*KEY, "tokens")
    links = staged(_verify(full.join(placed, KEY)), "found")
    joined = components(links).select(F.col("node").alias("rep"), F.col("component").alias("root"))
    classes = staged(reps.join(joined, "rep", "left").select("hi", "lo", "n", "rows", F.coalesce("root", "rep").alias("root")), "roots")
    none = signed.where("n = 0").select(*KEY, "doc_id", "n", F.col("doc_id").alias("component_id"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY).alias("least"))
    members = staged(join_counted(signed.where("n > 0").drop("tokens"), classes, ["hi", "lo", "n"], "rows").select(*KEY, "doc_id", "n", "root"), "members")
    # a root's rows may be many: the smallest is an aggregate (partial before its shuffle), and is joined back
    least = staged(members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("least"), F.count("*").alias("rows")), "least")
    out = join_counted(members, least, ["root"], "rows").select(*KEY, "doc_id", "n", F.col("least.doc_id").alias("component_id"), "least")
    for x in (signatures, groups, placed, links):
        unstage(x)
    return out.unionByName(none)


def jaccard_components(df: DataFrame, text: str = "text", doc_id: str = "doc_id", lower: bool = True, exact: bool = False) -> DataFrame:
    """One row for each row of ``df``: ``doc_id, n_shingles, component_id``.

    ``component_id``: the smallest id that can be reached over links, the row's own included. A text without words (or
    null) has an empty set and links to nothing. Null ids rank above all others: a component of nothing else has a null id.
    Rows that repeat a text are in one component. Very long texts are used whole; other columns are not read; no rows give
    none. ``df`` is scanned several times, in any splits: rows are known by ``row_key``.
    """
    return _components(df, text, doc_id, lower, exact).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that are first in their component, with their columns: of each component the one with the smallest id,
    and of rows that repeat that id and text one. Rows without words are components of their own."""
    d = _components(df, text, doc_id, True, False)
    first = (F.col("least.k1") == F.col("k1")) & (F.col("least.k2") == F.col("k2"))
    return keep_rows(df, staged(d.select(*KEY, first.alias("kept"), (F.col("n") > 0).alias("once")), "decided"), text, doc_id)
