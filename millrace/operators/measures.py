"""Exact ranks and percentiles that no single task has to sort: values are cut into ranges, counted, and looked up in theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def _ranges(df: DataFrame, value: Column) -> Column:
    """The number of the value's range, between about equal shares of the rows; nulls come first."""
    cuts = df.select(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 1000)).first()[0] or []
    held = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    return F.when(value.isNull(), -1).otherwise(F.size(F.filter(held, lambda c: c <= value))) if cuts else F.lit(0)


def global_rank(df: DataFrame, by: str, ties: list[str], name: str, descending: bool = False) -> DataFrame:
    """``df`` with ``name``: each row's place (from 1) by ``by`` and then ``ties``; ranges of ``by`` are sorted side by side."""
    d = df.withColumn("__range", _ranges(df, F.col(by)))
    order = F.desc if descending else F.asc
    sizes = d.groupBy("__range").agg(F.count("*").alias("n"))  # a row for each range
    before = Window.orderBy(order("__range")).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("__range").orderBy(order(by), *ties)
    return d.withColumn("__own", F.row_number().over(own)).join(F.broadcast(base), "__range").withColumn(name, F.col("__own") + F.col("__base")).drop("__range", "__own", "__base")


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by equal names in which null meets null."""
    other = right.withColumnsRenamed({k: f"__on_{k}" for k in on})
    return left.join(other, [left[k].eqNullSafe(other[f"__on_{k}"]) for k in on], how).drop(*(f"__on_{k}" for k in on))


def _product(a: Column, b: Column) -> tuple[Column, Column]:
    """A product of doubles, and what its rounding lost."""
    split = lambda x: (x * 134217729.0) - (x * 134217729.0 - x)
    p, ah, bh = a * b, split(a), split(b)
    return p, ((ah * bh - p) + ah * (b - bh) + (a - ah) * bh) + (a - ah) * (b - bh)


def _between(low: Column, high: Column, f: Column) -> Column:
    """``low * (1 - f) + high * f``, the first product unrounded, as a fused multiply-add and so SQL's ``quantile_cont`` has it: its
    last bit decides how a value that ends in a half is written."""
    (p, lost), q = _product(low, 1 - f), high * f
    s = p + q
    rest = (p - (s - (s - p))) + (q - (s - p)) + lost
    return F.when(f == 0, low).when((F.abs(low) < 1e290) & (F.abs(s) < 1e290), s + rest).otherwise(s)


def percentiles(df: DataFrame, group: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``group`` and one column for each of ``wanted``: ``name: (kind, p)``, exact.

    ``linear`` interpolates at rank p(n-1); ``exclusive`` at p(n+1), held to the first and last pair, so it extrapolates
    there, and a single value is its own; ``floor`` takes the value at place floor(pn), from 0. Nulls are left out; a group
    without values has no row.

    Equal values are counted by partial aggregates first; a group's ranges of values are summed up side by side.
    """
    keys = group or ["__all"]
    d = df.where(F.col(value).isNotNull()).select(*([F.col(g) for g in group] or [F.lit(1).alias("__all")]), F.col(value).cast("double").alias("__v"))
    counted = d.groupBy(*keys, "__v").agg(F.count("*").alias("__n")).withColumn("__range", _ranges(d, F.col("__v")))
    sizes = counted.groupBy(*keys, "__range").agg(F.sum("__n").alias("__size"))
    upto = Window.partitionBy(*keys).orderBy("__range")
    sizes = sizes.select(*keys, "__range", (F.sum("__size").over(upto) - F.col("__size")).alias("__base"), F.sum("__size").over(Window.partitionBy(*keys)).alias("__all_n"))
    within = Window.partitionBy(*keys, "__range").orderBy("__v")
    c = null_safe(counted.withColumn("__to", F.sum("__n").over(within)), F.broadcast(sizes), [*keys, "__range"])
    c = c.withColumn("__to", F.col("__to") + F.col("__base")).withColumn("__from", F.col("__to") - F.col("__n"))  # its places: from <= place < to
    n = F.col("__all_n")
    at = lambda place: F.max(F.when((F.col("__from") <= place) & (place < F.col("__to")), F.col("__v")))
    out, cols = [], []
    for name, (kind, p) in wanted.items():
        if kind == "floor":
            out.append(at(F.floor(n * p).cast("long")).alias(name))
            cols.append(F.col(name))
            continue
        exact = (n - 1) * p if kind == "linear" else n * p + p
        j = F.floor(exact).cast("long") if kind == "linear" else F.greatest(F.least(F.floor(exact).cast("long"), n - 1), F.lit(1))
        low = j if kind == "linear" else j - 1
        out += [at(low).alias(f"__{name}l"), at(F.least(low + 1, n - 1)).alias(f"__{name}h"), F.max(exact - j).alias(f"__{name}f")]
        low, high, f = (F.col(f"__{name}{x}") for x in "lhf")
        cols.append((_between(low, high, f) if kind == "linear" else low + (high - low) * f).alias(name))
    return c.groupBy(*keys).agg(*out).select(*group, *cols)
