"""Quality classifier by co-training: a view of the text and a view of the metadata teach each other, then score together."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lean, mix64, small_batches, word_hashes

#: Bounds of what is fitted on: labelled rows, and rows that may get a pseudo-label.
LABELLED, POOL = 3000, 2000
ROUNDS, PER_ROUND, CONFIDENT, LEAST_HELD = 4, 60, 0.8, 8
#: Documents whose chance of good quality is under this are rejected: clean documents weigh more than a few bad ones.
LEAST = 0.2
CLASSES, META = 64, 256
#: Bytes that short texts are filled up by, and bounds of the repetition marks (the last pair classes are no byte's).
SMOOTH, RATES = 300, np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])


def _byte_classes() -> np.ndarray:
    out = np.full(256, 62)
    out[ord("a") : ord("z") + 1] = np.arange(26)
    out[ord("A") : ord("Z") + 1] = 26
    out[ord("0") : ord("9") + 1] = 27
    out[[32, *range(9, 14)]] = 28
    out[128:] = 29
    for i, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        out[ord(c)] = 30 + i
    return out


BYTE_CLASS = _byte_classes()


def text_view(raw: bytes) -> np.ndarray:
    """Square roots of pair counts of byte classes over the whole text, small for short texts, and the text's own repetition:
    one of eight marks for the share of words that equal the one before, and one for that of words seen before."""
    c = BYTE_CLASS[np.frombuffer(raw, np.uint8)]
    v = np.zeros(CLASSES * CLASSES, np.float32)
    if len(c) > 1:
        v = (np.sqrt(np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)) / np.sqrt(len(c) + SMOOTH)).astype(np.float32)
    w = word_hashes(raw, False)
    if len(w) > 1:
        v[-1 - int(np.searchsorted(RATES, (w[1:] == w[:-1]).mean()))] = 0.5
        v[-10 - int(np.searchsorted(RATES, 1 - len(np.unique(w)) / len(w)))] = 0.25
    return v


def layout(raw: bytes) -> tuple[int, ...]:
    """What is known of a page without its words: its size, lines, mean and longest line, in octaves or halves of them."""
    lines = [len(x) for x in raw.split(b"\n")]
    half = lambda x: int(2 * np.log2(x + 1))
    return half(len(raw)), len(lines).bit_length(), half(len(raw) / len(lines)), half(max(lines))


def meta_view(values: tuple[str | None, ...], sizes: tuple[int, ...]) -> np.ndarray:
    """Hashed one-hot metadata and layout, and the size with each line length; nulls are a value of their own."""
    v = np.zeros(META, np.float32)
    size, lines, mean, longest = sizes
    for i, x in enumerate([*values, size, lines, mean, longest, (size, mean), (lines, longest)]):
        h = np.frombuffer(f"{i}={x}".encode().ljust(8, b"\0")[:64].ljust(64, b"\0"), np.uint64)
        v[int(mix64(np.array([np.bitwise_xor.reduce(mix64(h + np.arange(8, dtype=np.uint64)))]))[0] % META)] = 1
    return v / max(np.linalg.norm(v), 1e-9)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, sure: np.ndarray, l2: float = 1e-3, steps: int = 120) -> tuple[np.ndarray, float]:
    """Class-balanced logistic regression by accelerated gradient steps; a row weighs what is ``sure`` of its label."""
    d = x.shape[1]
    x, y = x.astype(np.float32, copy=False), y.astype(np.float32)
    weight = (np.where(y > 0, 0.5 / max(sure[y > 0].sum(), 1e-3), 0.5 / max(sure[y == 0].sum(), 1e-3)) * sure).astype(np.float32)
    w, b, mw, mb = np.zeros(d, np.float32), 0.0, np.zeros(d, np.float32), 0.0
    rate = 8.0
    for _ in range(steps):
        e = (_sigmoid(x @ (w + 0.9 * mw) + np.float32(b + 0.9 * mb)) - y) * weight  # all float32: no copies of x
        mw = 0.9 * mw - rate * 0.5 * (x.T @ e + l2 * (w + 0.9 * mw)).astype(np.float32)
        mb = 0.9 * mb - rate * 0.5 * float(e.sum())
        w, b = w + mw, b + mb
    return w, b


def platt(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Calibration: a logistic fit of held-out labels on one or more scores, with the true class rates."""
    z = z.reshape(len(z), -1)
    mean, scale = z.mean(axis=0), z.std(axis=0) + 1e-6
    x = np.c_[(z - mean) / scale, np.ones(len(z))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def combine(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """``platt`` of both views' scores; a view that would count against itself counts nothing."""
    w, b = platt(z, y)
    if (w < 0).any():
        k = int(w.argmax())
        one, b = platt(z[:, k], y)
        w = np.zeros(z.shape[1])
        w[k] = max(float(one[0]), 0.0)
    return w, b


@dataclass(frozen=True)
class Model:
    """Scores of both views, each calibrated, and the weights (none negative) by which their log odds are added; ``pseudo``: how
    many good and bad pseudo-labels the text and the metadata view got from the other."""

    text: tuple[np.ndarray, float]
    meta: tuple[np.ndarray, float]
    text_cal: tuple[np.ndarray, float]
    meta_cal: tuple[np.ndarray, float]
    both: tuple[np.ndarray, float]
    pseudo: dict[str, tuple[int, int]]

    def log_odds(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        a = (t @ self.text[0] + self.text[1]) * self.text_cal[0][0] + self.text_cal[1]
        b = (m @ self.meta[0] + self.meta[1]) * self.meta_cal[0][0] + self.meta_cal[1]
        return np.stack([a, b], axis=-1) @ self.both[0] + self.both[1]

    def score(self, raw: bytes, m: np.ndarray) -> float:
        return float(_sigmoid(self.log_odds(text_view(raw), m)))


def co_train(t: np.ndarray, m: np.ndarray, y: np.ndarray, held: np.ndarray, pool_t: np.ndarray, pool_m: np.ndarray) -> Model:
    """``held`` rows calibrate; the others train.

    In each round each view labels the pool rows at both ends of its ranking for the other view: ``PER_ROUND``, shared
    out as the classes are. How sure such a label is follows from the held rows that score at least as far out, or the
    ``LEAST_HELD`` that are furthest out: the share of them that has it. Labels less sure than ``CONFIDENT`` aren't given, the others weigh as much in training.
    """
    train = ~held
    bad = int(np.clip(round(PER_ROUND * (y[train] == 0).mean()), 5, PER_ROUND - 5))
    extra: dict[str, list[tuple[int, int, float]]] = {"t": [], "m": []}
    taken: dict[str, set[int]] = {"t": set(), "m": set()}
    pools, own = {"t": pool_t, "m": pool_m}, {"t": t, "m": m}
    clf = cal = {}
    for r in range(ROUNDS + 1):
        clf, cal = {}, {}
        for v in "tm":
            rows, labels, sure = (np.array([e[i] for e in extra[v]]) for i in range(3))
            x = np.concatenate([own[v][train], pools[v][rows.astype(int)]])
            clf[v] = logistic(x, np.concatenate([y[train], labels]), np.concatenate([np.ones(train.sum()), sure]))
            cal[v] = platt(own[v][held] @ clf[v][0] + clf[v][1], y[held])
        if r == ROUNDS or not len(pool_t):
            break
        for v, other in (("t", "m"), ("m", "t")):
            z, known = pools[v] @ clf[v][0] + clf[v][1], own[v][held] @ clf[v][0] + clf[v][1]
            order = [int(i) for i in np.argsort(z, kind="stable") if int(i) not in taken[v]]
            for label, some in ((0, order[:bad]), (1, order[::-1][: PER_ROUND - bad])):
                ends = y[held][np.argsort(-known if label else known, kind="stable")] == label  # from the far end on
                for i in some:
                    n = max(LEAST_HELD, int(((known >= z[i]) if label else (known <= z[i])).sum()))
                    sure = ends[:n].mean()
                    if sure >= CONFIDENT and i not in taken[v]:
                        taken[v].add(i)
                        extra[other].append((i, label, sure))
    z = np.stack([(own[v][held] @ clf[v][0] + clf[v][1]) * cal[v][0][0] + cal[v][1] for v in "tm"], axis=1)
    count = lambda v: (sum(e[1] for e in extra[v]), sum(1 - e[1] for e in extra[v]))
    return Model(clf["t"], clf["m"], cal["t"], cal["m"], combine(z, y[held]), {"text": count("t"), "meta": count("m")})


def _strings(meta: tuple[str, ...]) -> list[Column]:
    """The metadata as text, as every use of it sees them."""
    return [F.col(c).cast("string").alias(f"__m{i}") for i, c in enumerate(meta)]


def _metas(b: pa.RecordBatch, meta: tuple[str, ...]) -> list[tuple]:
    return list(zip(*[b.column(f"__m{i}").to_pylist() for i in range(len(meta))], strict=True)) if meta else [()] * len(b)


def _views(df: DataFrame, meta: tuple[str, ...], text: str, keep: list[str]) -> DataFrame:
    """Float16 bytes of both views, for a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [x.as_py() or b"" for x in b.column("__text").cast(pa.binary())]
            t = [text_view(r).astype(np.float16).tobytes() for r in raws]
            m = [meta_view(v, layout(r)).astype(np.float16).tobytes() for r, v in zip(raws, _metas(b, meta), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(t, pa.binary()), pa.array(m, pa.binary())], [*keep, "t", "m"])

    d = df.select(*keep, F.col(text).alias("__text"), *_strings(meta))
    types = dict(d.dtypes)
    return d.mapInArrow(lean(run), ", ".join([*[f"{k} {types[k]}" for k in keep], "t binary, m binary"]))


def fit(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", meta: tuple[str, ...] = ("lang", "source"), labelled: int = LABELLED, pool: int = POOL) -> Model | None:
    """Fits on at most ``labelled`` labelled rows and ``pool`` others: those whose ids hash lowest. None if a class is missing.

    Labels: ``quality`` over 0 is good; null ids and labels are left out, and of labels that repeat an id the lowest counts.
    """
    small_batches(df.sparkSession)
    by_hash = lambda d: d.orderBy(F.xxhash64(doc_id), doc_id)
    marked = labels.where(f"{doc_id} is not null and quality is not null").groupBy(doc_id).agg(F.min("quality").alias("__y"))
    known = by_hash(marked).limit(labelled)
    others = by_hash(df.select(doc_id).where(f"{doc_id} is not null").join(marked, doc_id, "left_anti").distinct()).limit(pool).withColumn("__y", F.lit(None).cast("int"))
    some = df.join(F.broadcast(known.unionByName(others.select(*known.columns))), doc_id)
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), [float(y or 0) for y in b.column(1).to_pylist()], b.column(1).is_valid().to_pylist(), strict=True))
        mine, rest = [r for r in rows if r[4]], [r for r in rows if not r[4]]
        y = np.array([float(r[3] > 0) for r in mine])
        held = np.array([zlib.crc32(f"held {r[0]}".encode()) % 4 == 0 for r in mine], bool)  # by id, so no order of the table shows in it
        if len({*y[held]}) < 2 or len({*y[~held]}) < 2:
            return
        as_matrix = lambda some, k, d: np.frombuffer(b"".join(r[k] for r in some), np.float16).reshape(len(some), d).astype(np.float32)
        t, m, pool_t, pool_m = (as_matrix(some, k, d) for some in (mine, rest) for k, d in ((1, CLASSES**2), (2, META)))
        del rows, mine, rest
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(co_train(t, m, y, held, pool_t, pool_m))], pa.binary())], ["model"])

    # the sample is bounded, so one task trains on it; the driver gets the model only
    got = _views(some, meta, text, [doc_id, "__y"]).repartition(1).mapInArrow(lean(train), "model binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else None


def _scorer(model: Model, meta: tuple[str, ...]):
    """Scores of a batch with ``__text`` and the metadata as text; views of metadata that recur are kept."""
    seen: dict[tuple, np.ndarray] = {}

    def scores(b: pa.RecordBatch) -> list[float]:
        out = []
        for raw, values in zip(b.column("__text").cast(pa.binary()), _metas(b, meta), strict=True):
            raw = raw.as_py() or b""
            key = (values, layout(raw))
            if key not in seen:
                if len(seen) > 20_000:
                    seen.clear()
                seen[key] = meta_view(*key)
            out.append(model.score(raw, seen[key]))
        return out

    return scores


def score(df: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id", meta: tuple[str, ...] = ("lang", "source"), least: float = LEAST) -> DataFrame:
    """One row for each row of ``df``: ``doc_id, score, kept``; ``score`` is the calibrated chance of good quality.

    Whole texts are read; a null or empty text has an empty text view. Null metadata is a value of its own. Rows that
    repeat get equal scores. With no model (no labels, or labels of one class) every score is null and every row is kept.
    """
    d = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), *_strings(meta))
    if model is None:
        return d.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("kept"))
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(held.value, meta)
        for b in batches:
            out = scores(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64()), pa.array([x >= least for x in out], pa.bool_())], ["doc_id", "score", "kept"])

    return d.mapInArrow(lean(run), f"doc_id {dict(d.dtypes)['doc_id']}, score double, kept boolean")


def keep_good(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", meta: tuple[str, ...] = ("lang", "source"), least: float = LEAST) -> DataFrame:
    """The rows of ``df`` that ``score`` keeps, with their columns, scored where they are: nothing is shuffled. Column names
    must differ; those of the form ``__m0`` and ``__text`` are taken."""
    if len(set(df.columns)) < len(df.columns):
        raise ValueError("column names must differ")
    model = fit(df, labels, text, doc_id, meta)
    if model is None:
        return df
    held, names = df.sparkSession.sparkContext.broadcast(model), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(held.value, meta)
        for b in batches:
            yield b.filter(pa.array([x >= least for x in scores(b)], pa.bool_())).select(names)

    return df.select(*names, F.col(text).alias("__text"), *_strings(meta)).mapInArrow(lean(run), df.schema)
