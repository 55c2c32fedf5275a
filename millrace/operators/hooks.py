"""What wraps or follows other work: measured calls, contexts, callbacks, batch hooks and the choice of a model."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Profiler:
    """Calls of functions that give DataFrames: seconds to plan, and rows once they have run, by ``observe`` and without another pass."""

    def __init__(self) -> None:
        self.calls: list[dict] = []

    def profiled(self, name: str, slow: float = 0.1) -> Callable:
        def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            @functools.wraps(f)
            def run(*args, **kwargs) -> DataFrame:
                seen, began = Observation(), time.time()
                try:
                    df = f(*args, **kwargs).observe(seen, F.count(F.lit(1)).alias("rows"))
                except Exception as e:
                    self.calls.append({"name": name, "seconds": time.time() - began, "error": type(e).__name__, "seen": None})
                    raise
                seconds = time.time() - began
                self.calls.append({"name": name, "seconds": seconds, "error": None, "slow": seconds > slow, "seen": seen})
                return df

            return run

        return wrap

    @contextmanager
    def context(self, name: str) -> Iterator[dict]:
        """A block of work; errors are noted and go on."""
        call, began = {"name": name, "error": None, "seen": None}, time.time()
        try:
            yield call
        except Exception as e:
            call["error"] = type(e).__name__
            raise
        finally:
            self.calls.append(call | {"seconds": time.time() - began})

    def table(self, spark: SparkSession) -> DataFrame:
        """``seq, name, rows, error`` and ``seconds`` of each call; rows of those that have run."""
        rows = [(i, c["name"], c["seen"].get["rows"] if c["seen"] else c.get("rows"), c["error"], c["seconds"]) for i, c in enumerate(self.calls)]
        return spark.createDataFrame(rows, "seq long, name string, rows long, error string, seconds double")


class Cleanup:
    """Callbacks that a cleanup runs in their order; one that fails doesn't keep the others from running."""

    def __init__(self) -> None:
        self.callbacks: list[tuple[str, Callable[[], int]]] = []

    def register(self, name: str, callback: Callable[[], int]) -> None:
        self.callbacks.append((name, callback))

    def run(self, spark: SparkSession) -> DataFrame:
        out = []
        for i, (name, callback) in enumerate(self.callbacks):
            try:
                out.append((i, name, int(callback()), None))
            except Exception as e:  # the result tells
                out.append((i, name, None, type(e).__name__))
        return spark.createDataFrame(out, "seq long, name string, freed long, error string")


def on_batches(df: DataFrame, hooks: list[Callable[[DataFrame, int], None]], checkpoint: str) -> None:
    """Gives every micro-batch of a stream to each hook, until nothing is left."""

    def each(batch: DataFrame, i: int) -> None:
        for hook in hooks:
            hook(batch, i)

    df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Deterministic stand-ins for models, by name.
MODELS: dict[str, Callable[[str], str]] = {"echo": lambda p: f"echo {len(p.split())}", "snake": lambda p: p[:20].replace(" ", "_")}


def generate(df: DataFrame, model: str, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, model, reply``: batch inference with the model of that name, which each task gets with the job."""
    if model not in MODELS:
        raise ValueError(f"no model {model}")
    run_model = MODELS[model]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies = [run_model(x.as_py() or "") for x in b.column(text)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array([model] * len(b), pa.string()), pa.array(replies, pa.string())], [*keys, "model", "reply"])

    d = df.select(*keys, text)
    types = dict(d.dtypes)
    return d.mapInArrow(run, ", ".join([*[f"{k} {types[k]}" for k in keys], "model string, reply string"]))
