"""Mixing sources to target weights: Pfair windows, earliest deadline first. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Any source without a weight of its own has this entry's weight.
OTHERS = "*"
BUCKETS = 1024
#: None: each source has a lane of its own, whatever their number. Who sets a number lets sources without a weight share one beyond it.
MOST_SOURCES: int | None = None
#: The sum of the given weights, at most.
MOST_SLOTS = 100_000


def phases(blocks: dict[str, int], weights: dict[str, int]) -> tuple[list[tuple], list[tuple]]:
    """Lanes ``(source, phase, first, last, w, period, start)`` and slots ``(source, phase, j, slot, release, deadline)``.

    Earliest deadline first: block ``j`` of a source with ``w`` of ``D`` slots may run from slot ``floor(j*D/w)`` and must have run by
    ``ceil((j+1)*D/w)``; each slot goes to the released block with the earliest deadline. At every slot a source is then less
    than one block away from its share. When a source has no blocks left, the others go on with their own weights in a new phase. Sources of one weight take turns
    by name, so a slot compares one source of each weight; a phase that ends in its first period lists only what it placed.
    """
    lanes, slots, used, start, phase = [], [], dict.fromkeys(blocks, 0), 0, 0
    groups: dict[int, list[str]] = {}
    for s in sorted(blocks, reverse=True):
        groups.setdefault(weights[s], []).append(s)  # the first name is last, where it is cheap to take out
    while groups:
        period = sum(w * len(names) for w, names in groups.items())
        done, table, dry = dict.fromkeys(groups, 0), [], None
        for slot in range(period):
            ready = []
            for w, names in groups.items():
                j, i = divmod(done[w], len(names))
                if j < w and j * period // w <= slot:
                    ready.append((-(-(j + 1) * period // w), names[-1 - i], j, j * period // w, w))
            deadline, s, j, release, w = min(ready)
            done[w] += 1
            table.append((s, j, slot, release, deadline))
            if used[s] + j + 1 == blocks[s]:
                dry, i = s, (done[w] - 1) % len(groups[w])
                break
        if dry is None:
            at = {(s, j): slot for s, j, slot, _, _ in table}
            place = lambda s, j: j // weights[s] * period + at[s, j % weights[s]]  # noqa: E731, B023
            end, dry = min((place(s, blocks[s] - used[s] - 1) + 1, s) for names in groups.values() for s in names)
            i = len(groups[weights[dry]]) - 1 - groups[weights[dry]].index(dry)
        else:
            end = len(table)
        whole, rest = divmod(end, period)
        count = {}
        for s, _, slot, _, _ in table:
            count[s] = count.get(s, 0) + (slot < rest)
        for s, n in count.items():
            n += whole * weights[s]
            lanes.append((s, phase, used[s], used[s] + n, weights[s], period, start))
            used[s] += n
        slots += [(s, phase, j, slot, r, d) for s, j, slot, r, d in table]
        names = groups[weights[dry]]
        del names[-1 - i]
        if not names:
            del groups[weights[dry]]
        start, phase = start + end, phase + 1
    return lanes, slots


def mix_sources(df: DataFrame, weights: dict[str, int], source: str = "source", doc_id: str = "doc_id", block_docs: int = 16, stop_when_dry: bool = False) -> DataFrame:
    """``df``'s rows, all of them, with ``mix_phase, mix_block, mix_release, mix_deadline, mix_position`` (long).

    Read by ``mix_position``, blocks of ``block_docs`` documents of each source come in proportion to the weights, each
    source less than one block off at any point; when one runs dry, the rest keep their relative weights (a new phase).
    So the target weights hold in phase 0; ``stop_when_dry`` gives that phase only, which is a mix of exactly those weights.
    Within a source the order is that of a hash of the id, so it doesn't depend on the input's. A source's last block may
    be short; positions then have a gap. A null source counts as the empty string and, as any source without a
    weight of its own, has that of ``*`` (1 if there is none). Null ids rank by the hash of null; repeated rows
    each get a place. Columns named as the new ones are replaced.

    Ranks within a source are counted by ``BUCKETS`` hash buckets, so a hot source is dealt over as many tasks. The plan
    that is broadcast depends on the number of sources and the weights, with few sources not on the rows. There are as
    many phases as sources, and any number of sources is mixed by the same rule.
    """
    new = ("mix_phase", "mix_block", "mix_release", "mix_deadline", "mix_position")
    h = F.xxhash64(F.col(doc_id))
    d = df.drop(*new).withColumns({"__source": F.coalesce(F.col(source).cast("string"), F.lit("")), "__hash": h, "__bucket": F.shiftrightunsigned(h, 54).cast("int")})
    spark = df.sparkSession
    sizes = d.groupBy("__source", "__bucket").agg(F.count("*").alias("n"))
    if sum(weights.values()) > MOST_SLOTS:
        raise ValueError(f"weights must add up to {MOST_SLOTS} at most")
    if MOST_SOURCES is not None and sizes.select("__source").distinct().limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        named = F.col("__source").isin(*(s for s in weights if s != OTHERS))
        d = d.withColumn("__source", F.when(named, F.col("__source")).otherwise(OTHERS))
        sizes = d.groupBy("__source", "__bucket").agg(F.count("*").alias("n"))
    totals = {r[0]: -(-r[1] // block_docs) for r in sizes.groupBy("__source").agg(F.sum("n")).collect()}
    lanes, slots = phases(totals, {s: weights.get(s, weights.get(OTHERS, 1)) for s in totals})
    lane = spark.createDataFrame(lanes, "__source string, mix_phase int, __first long, __last long, __w long, __period long, __start long")
    slot = spark.createDataFrame(slots, "__source string, mix_phase int, __j long, __slot long, __release long, __deadline long")
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("__source", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__source", "__bucket").orderBy("__hash", doc_id)
    ranked = d.withColumn("__rank", F.row_number().over(within)).join(base, ["__source", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__base") - 1).withColumn("mix_block", F.floor(F.col("__rank") / block_docs).cast("long"))
    ranked = ranked.alias("d").join(F.broadcast(lane).alias("l"), F.expr("d.__source = l.__source and mix_block >= __first and mix_block < __last"))
    ranked = ranked.select("d.*", "mix_phase", "__first", "__w", "__period", "__start")
    ranked = ranked.withColumns({"__turn": F.expr("(mix_block - __first) div __w"), "__j": F.expr("(mix_block - __first) % __w")})
    ranked = ranked.join(F.broadcast(slot), ["__source", "mix_phase", "__j"])
    at = F.col("__start") + F.col("__turn") * F.col("__period")
    ranked = ranked.withColumns({
        "mix_release": at + F.col("__release"),
        "mix_deadline": at + F.col("__deadline"),
        "mix_position": (at + F.col("__slot")) * block_docs + F.col("__rank") % block_docs,
    })
    if stop_when_dry:
        ranked = ranked.where("mix_phase = 0")
    return ranked.withColumn("mix_phase", F.col("mix_phase").cast("long")).select(*[c for c in df.columns if c not in new], *new)


def in_mixed_order(df: DataFrame, weights: dict[str, int], source: str = "source", doc_id: str = "doc_id", position: bool = False) -> DataFrame:
    """``df``'s rows and columns in mixed order: range-partitioned and sorted, so files in name order hold the mix.

    ``position`` keeps ``mix_position`` too: a reader of the files gets rows in the order of its splits, not in this one.
    """
    mixed = mix_sources(df, weights, source, doc_id)
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*[c for c in df.columns if not position or c != "mix_position"], *["mix_position"] * position)
