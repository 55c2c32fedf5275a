"""Array, vector and model-stub operators in DataFrame functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row; a projection would be inlined into every use."""
    return F.get(F.transform(F.array(value), body), 0)


def chunk_explode(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row for each token of a reply: its index, and the token with a space after all but the last."""
    spaced = lambda t: F.concat(F.transform(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), lambda x: F.concat(x, F.lit(" "))), F.slice(t, F.greatest(F.size(t), F.lit(1)), 1))
    return df.select(*keys, F.posexplode(let(tokens(F.col(text)), spaced)).alias("pos", "chunk")).withColumn("pos", F.col("pos").cast("long"))


def pad_truncate(df: DataFrame, keys: list[str], text: str = "text", most: int = 512, pad: str = "<pad>", width: int = 16) -> DataFrame:
    """The first ``most`` tokens, padded on the left to ``width``."""
    t = F.slice(tokens(F.col(text)), 1, most)
    return df.select(*keys, F.array_join(F.concat(F.array_repeat(F.lit(pad), F.greatest(width - F.size(t), F.lit(0))), t), " ").alias("padded"))


def sse_stream(df: DataFrame, keys: list[str], text: str = "text", allowed: Column | None = None, read: Column | None = None, retry: int = 1000) -> DataFrame:
    """``keys, pos, frame, billed``: a retry line, a frame for each token, and the end mark.

    ``allowed``: tokens after which the limit answers with an error frame that ends the stream; ``read``: tokens after which the
    client has gone, so nothing more is sent. Each token that is sent is billed as one.
    """
    none = F.lit(None).cast("int")
    limit, gone = none if allowed is None else allowed, none if read is None else read
    d = df.select(*keys, tokens(F.col(text)).alias("__t"), limit.alias("__limit"), gone.alias("__gone"))
    d = d.withColumn("__sent", F.least(F.size("__t"), F.coalesce("__limit", F.size("__t")), F.coalesce("__gone", F.size("__t"))))
    end = F.when(F.coalesce(F.col("__gone") < F.size("__t"), F.lit(False)) & (F.col("__sent") == F.col("__gone")), F.array().cast("array<string>"))
    end = end.when(F.col("__sent") < F.size("__t"), F.array(F.lit('data: {"error": "Rate limit exceeded"}'))).otherwise(F.array(F.lit("data: [DONE]")))
    frames = F.concat(F.array(F.lit(f"retry: {retry}")), F.transform(F.slice("__t", 1, F.col("__sent")), lambda x: F.concat(F.lit("data: "), x)), end)
    out = d.select(*keys, "__sent", F.posexplode(frames).alias("pos", "frame"))
    return out.select(*keys, F.col("pos").cast("long").alias("pos"), "frame", ((F.col("pos") > 0) & (F.col("pos") <= F.col("__sent"))).cast("int").alias("billed"))


def batch_build(requests: DataFrame, batch: Column, seq: str, prompt: str, max_tokens: str, temperature: str) -> DataFrame:
    """``batch, prompts, max_tokens, temperature``: prompts in their order, the largest number of tokens, the first one's temperature."""
    g = requests.groupBy(batch.alias("batch")).agg(F.array_sort(F.collect_list(F.struct(seq, prompt))).alias("p"), F.max(max_tokens).alias("max_tokens"), F.min_by(temperature, seq).alias("temperature"))
    return g.select("batch", F.transform("p", lambda x: x[prompt]).alias("prompts"), "max_tokens", "temperature")


def conversations(events: DataFrame, conv: str, turn: str, role: str, text: str, kind: str) -> DataFrame:
    """``conv, messages``: what a chat shows: role, content and whether it is an error, in order, since the last ``clear``."""
    message = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"), (F.col(kind) == "error").alias("error"))
    g = events.groupBy(conv).agg(F.array_sort(F.collect_list(F.when(F.col(kind) != "clear", message))).alias("m"), F.coalesce(F.max(F.when(F.col(kind) == "clear", F.col(turn))), F.lit(-1)).alias("cleared"))
    kept = F.filter("m", lambda x: x["turn"] > F.col("cleared"))
    return g.select(conv, F.transform(kept, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["error"].alias("error"))).alias("messages"))


def role_content(messages: Column) -> Column:
    """Messages with role and content only."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


TOOL = "struct<name: string, parameters: struct<type: string, properties: map<string, struct<type: string, description: string>>, required: array<string>>>"


def tool_properties(df: DataFrame, schema: str, keys: list[str]) -> DataFrame:
    """``keys, name, property, type, required`` of function schemas in JSON; ones that don't parse have no rows."""
    t = df.select(*keys, F.from_json(schema, TOOL).alias("t")).where("t.name is not null")
    p = t.select(*keys, "t.name", F.col("t.parameters.required").alias("r"), F.explode("t.parameters.properties").alias("property", "p"))
    return p.select(*keys, "name", "property", "p.type", F.coalesce(F.array_contains("r", F.col("property")), F.lit(False)).alias("required"))


def to_map(key: Column, value: Column) -> Column:
    """An aggregate: rows as one map, in the order of the keys; keys must differ."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("key"), value.alias("value")))))


def merged_map(old: Column, new: Column) -> Column:
    """A map updated by another, whose values win."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def records(df: DataFrame) -> Column:
    """Each row as a JSON object, nulls included."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def top_k_cosine(df: DataFrame, query: list[float], k: int = 5, threshold: float = 0.0, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The ``k`` vectors most similar to a query vector: map-side scores, then a partial top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(F.col(vector), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = sum(float(x) ** 2 for x in query) ** 0.5
    scored = df.select(key, F.try_divide(dot, norm * F.lit(size)).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), key).limit(k)


def generate_batch(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Batch inference with a deterministic stand-in for the model: Arrow batches in, one reply for each prompt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies = [f"echo {len((x.as_py() or '').split())}" for x in b.column(text)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(replies, pa.string())], [*keys, "reply"])

    d = df.select(*keys, text)
    types = dict(d.dtypes)
    return d.mapInArrow(run, ", ".join([*[f"{k} {types[k]}" for k in keys], "reply string"]))
