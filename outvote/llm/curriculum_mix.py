"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a target of words. Its documents, in an order fixed by a hash of their id,
make a stream that repeats until the target is met; a document's copies are the passes in
which its place lies below the target. The source's rate of use over training time t in
[0, 1] follows a schedule; the integral of the schedule is the cumulative demand, and the
inverse of that integral gives each copy the time at which demand reaches its place. Sorting
by time (range partitions) interleaves the sources.

Running totals are sums over (source, bucket) first and within a bucket after, so a source
of any size is spread over many tasks.

Nulls and ties: a null text has no words; the null source comes last; equal hashes go by
id, size and hash of the text; repeated rows are mixed as rows of their own. A document
without words takes nothing. An empty table gives an empty result. Input columns named like
the result's give way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from outvote.llm.columns import WORD, Beside, named
from outvote.staging import stage

WEIGHTS = (5, 2, 1)
#: Words the mix takes in all, as percent of the words there are.
SHARE_PERCENT = 150
#: How often a source may be used.
PASSES = 2
#: (time, rate) knots per weight, linear between: heavy sources come early, light ones late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))
#: Documents whose running totals are taken in one task.
BUCKET_ROWS = 5_000

MADE = ["size", "source_size", "target", "taken", "copies", "first_position", "positions"]


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(named(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """Per source: its number from 1 by code point (null last), size, weight and target. The
    target is weight x level, at most PASSES x size, with the level at which all targets
    add up to the share: the end of resharing what is above until none is."""
    sums = sizes.groupBy(F.col(source).alias("__source")).agg(F.sum(size).alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last()))
    weighted = sums.withColumn("__number", number).withColumn(
        "__weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("__number") - 1) % len(WEIGHTS) + 1)
    )
    # sources by the level at which they are full; those before the last level stay full
    by_level = Window.orderBy(F.col("source_size") / F.col("__weight"), "__number")
    everything = Window.partitionBy(F.lit(0))
    level = weighted.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(SHARE_PERCENT) / F.lit(100.0)).alias("__share"),
        (PASSES * F.sum("source_size").over(by_level) - PASSES * F.col("source_size")).alias("__full_before"),
        (F.sum("__weight").over(everything) - F.sum("__weight").over(by_level) + F.col("__weight")).alias("__weight_left"),
    ).withColumn("__level", (F.col("__share") - F.col("__full_before")) / F.col("__weight_left"))
    # a source is full if, with all before it full, its part would pass its limit
    full = F.col("__weight") * F.col("__level") >= PASSES * F.col("source_size")
    first_open = F.min(F.when(~full, F.struct((F.col("source_size") / F.col("__weight")).alias("r"), "__number", "__level"))).over(everything)
    target = F.when(full, F.lit(float(PASSES)) * F.col("source_size")).otherwise(F.col("__weight") * F.col("__first.__level"))
    return level.withColumn("__first", first_open).select(
        "__source", "__number", "source_size", "__weight", target.cast("double").alias("target")
    )


def _time_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the schedule's integral, scaled to 1, reaches `share`."""
    areas = [(t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:])]
    total, done = sum(areas), 0.0
    time: Column | None = None
    for (t0, r0), (t1, r1), area in zip(knots, knots[1:], areas):
        rest = share * F.lit(total) - F.lit(done)
        slope = (r1 - r0) / (t1 - t0)
        if slope == 0:
            here = F.lit(t0) + rest / F.lit(r0)
        else:
            here = F.lit(t0) + (F.sqrt(F.greatest(F.lit(r0 * r0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(r0)) / F.lit(slope)
        done += area
        piece = F.when(share * F.lit(total) <= F.lit(done), here)
        time = piece if time is None else F.coalesce(time, piece)
    return F.least(F.coalesce(time, F.lit(knots[-1][0])), F.lit(knots[-1][0]))


def _timer(knots: Sequence[tuple[float, float]]):
    return lambda share: _time_of(share, knots)


def mix(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size: Column | None = None,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
) -> DataFrame:
    """documents with size, source_size, target, taken, copies, first_position and
    positions (the time of each copy). Every document stays, also those not taken."""
    size = word_count(text_col) if size is None else size
    tie = F.xxhash64(named(text_col)) if text_col in documents.columns else F.lit(0)
    key = F.md5(F.coalesce(named(id_col).cast("string"), F.lit("")))
    rows = Beside(documents, __size=size, __key=key, __tie=tie)
    keyed, id_col, source_col = rows.df, rows.number(id_col), rows.number(source_col)
    # a small row per document: texts are counted once for the targets and the totals
    small = stage(keyed.select(F.col(source_col).alias("source"), F.col("__size").alias("size"), "__key"), "mix-sizes")
    targets = source_targets(small)
    buckets = max(1, min(1 << 24, -(-small.count() // BUCKET_ROWS)))
    bucket = F.shiftright(F.conv(F.substring("__key", 1, 6), 16, 10).cast("long") * buckets, 24).cast("int").alias("__bucket")
    keyed = keyed.select("*", bucket)
    sums = small.groupBy(F.col("source").alias("__source"), bucket).agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__source", "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    table = offsets.join(targets, offsets["__source"].eqNullSafe(targets["__source"])).drop(targets["__source"])
    table = table.withColumnRenamed("__bucket", "__b")
    joined = keyed.join(table, keyed[source_col].eqNullSafe(table["__source"]) & (keyed["__bucket"] == table["__b"]))
    order = Window.partitionBy("__number", "__bucket").orderBy("__key", id_col, "__size", "__tie")
    running = F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    begin = F.col("__before") + running - F.col("__size")
    place = F.col("__begin").cast("double") + F.col("__size") / 2
    # the passes in which the document's middle lies below the target
    passes = F.array(*(place + F.lit(float(p)) * F.col("source_size") for p in range(PASSES)))
    places = F.filter(passes, lambda x: x <= F.col("target"))
    shares = F.transform("__places", lambda x: x / F.greatest(F.col("target"), F.lit(1e-9)))
    weight_class = (F.col("__number") - 1) % len(schedules)
    times = F.coalesce(
        *(F.when(weight_class == k, F.transform(shares, _timer(s))) for k, s in enumerate(schedules))
    )
    return (
        joined.withColumn("__begin", begin)
        .withColumn("__places", places)
        .withColumn("__times", times)
        .select(
            *rows.others(MADE),
            F.col("__size").alias("size"),
            "source_size",
            "target",
            (F.col("__size") * F.size("__places")).cast("long").alias("taken"),
            F.size("__places").alias("copies"),
            F.get("__times", F.lit(0)).alias("first_position"),
            F.col("__times").alias("positions"),
        )
    )


def in_training_order(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each copy, range-partitioned and sorted by its time."""
    rows = Beside(mixed.select(*map(named, columns), "positions"))
    # written once before it is sorted: sorting by ranges reads its input twice, and the files of
    # the shuffles so far can go
    mixed = stage(rows.df, "mixed")
    timed = mixed.select(*rows.numbers[:-1], F.explode(rows.numbers[-1]).alias("__time"))
    ordered = timed.repartitionByRange("__time").sortWithinPartitions("__time")
    return ordered.select(*rows.others()[:-1])
