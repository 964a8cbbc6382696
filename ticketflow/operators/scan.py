"""Ordered scans over keys of any size.

A window over a key reads all its rows in one task. Here a key with more than SEGMENT rows is dealt by ranges of its order over
as many parts as it needs; windows run inside a part, each part is summed up in one row, and what a part takes over from
those before it is worked out on these rows alone and joined back. Other keys stay as they are, so a table without a hot key costs one count more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ticketflow.operators.lineage import cut

#: Rows of a key that one task reads at most (about).
SEGMENT = 1_000_000
#: Column with a row's part: -1 where the key is whole.
PART = "_part"


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys, nulls included; b has them as _k0, _k1 and so on."""
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & a[k].eqNullSafe(b[f"_k{i}"])
    return on


def _named(df: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *more)


def deal(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, bool]:
    """The rows with their part, and whether any key has several. Parts of a key follow each other in the order; equal rows are in one part."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SEGMENT)
    hot = cut(_named(counts, keys, "_n"))
    total = hot.agg(F.sum("_n")).first()[0]  # each hot key has SEGMENT rows at least, so there are few
    if total is None:
        return df.withColumn(PART, F.lit(-1)), False
    parts = -(-2 * total // SEGMENT)
    keys_of = hot.drop("_n").hint("broadcast")
    large = df.join(keys_of, _same(df, keys_of, keys), "left_semi")
    ranged = cut(large.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id()))
    return df.join(keys_of, _same(df, keys_of, keys), "left_anti").withColumn(PART, F.lit(-1)).unionByName(ranged), True


def inside(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The window over a key's part."""
    return Window.partitionBy(*keys, PART).orderBy(*order)


def carry(rows: DataFrame, keys: Sequence[str], sums: Sequence[Column], fold: Callable[[DataFrame, WindowSpec], DataFrame], names: Sequence[str]) -> DataFrame:
    """Join to each row of a dealt key what its part takes over: `fold` adds the columns `names` to the parts' sums, given the window over a key's parts in order."""
    parts = rows.filter(F.col(PART) >= 0).groupBy(*keys, PART).agg(*sums)
    taken = cut(_named(fold(parts, Window.partitionBy(*keys).orderBy(PART)), keys, F.col(PART).alias("_of"), *names)).hint("broadcast")  # a row for each part
    return rows.join(taken, _same(rows, taken, keys) & (rows[PART] == taken["_of"]), "left").drop("_of", *[f"_k{i}" for i in range(len(keys))])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Each row's place in its key, from 1."""
    rows, several = deal(df, keys, order)
    rows = rows.withColumn(name, F.row_number().over(inside(keys, order)))
    if several:
        before = lambda parts, w: parts.withColumn("_before", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        rows = carry(rows, keys, [F.count(F.lit(1)).alias("_n")], before, ["_before"])
        rows = rows.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")
    return rows.drop(PART)


def preceding(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """The value of the row before, null for a key's first."""
    rows, several = deal(df, keys, order)
    rows = rows.withColumn(name, F.lag(value).over(inside(keys, order)))
    if several:
        rows = rows.withColumn("_first", F.row_number().over(inside(keys, order)) == 1)
        last = [F.max_by(value, F.struct(*order)).alias("_last")]
        rows = carry(rows, keys, last, lambda parts, w: parts.withColumn("_taken", F.lag("_last").over(w)), ["_taken"])
        rows = rows.withColumn(name, F.when(F.col("_first"), F.col("_taken")).otherwise(F.col(name))).drop("_first", "_taken")
    return rows.drop(PART)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], micros: str, gap: int, name: str) -> DataFrame:
    """Number of each row's island, from 1: a new one begins where the time is `gap` or more after the row before."""
    rows, several = deal(df, keys, order)
    w = inside(keys, order)
    rows = rows.withColumn("_before", F.lag(micros).over(w))
    fresh = (F.col("_before").isNull() | (F.col(micros) - F.col("_before") >= gap)).cast("int")
    rows = rows.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(w))
    if several:
        sums = [F.max(name).alias("_islands"), F.min(micros).alias("_low"), F.max(micros).alias("_high")]

        def fold(parts: DataFrame, over: WindowSpec) -> DataFrame:
            joined = F.coalesce((F.col("_low") - F.lag("_high").over(over) < gap).cast("int"), F.lit(0))
            parts = parts.withColumn("_joined", joined)
            earlier = F.coalesce(F.sum("_islands").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            return parts.withColumn("_shift", earlier - F.sum("_joined").over(over))

        rows = carry(rows, keys, sums, fold, ["_shift"])
        rows = rows.withColumn(name, F.col(name) + F.coalesce("_shift", F.lit(0))).drop("_shift")
    return rows.drop("_before", "_fresh", PART)


def tripped_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], bad: Column, k: int, name: str) -> DataFrame:
    """Whether a run of `k` bad rows ended before the row."""
    rows, several = deal(df.withColumn("_bad", bad.cast("int")), keys, order)
    w = inside(keys, order)
    rows = rows.withColumn("_island", F.sum(1 - F.col("_bad")).over(w))
    streak = Window.partitionBy(*keys, PART, "_island").orderBy(*order)
    rows = rows.withColumn("_streak", F.sum("_bad").over(streak))
    if several:
        leading, size = F.col("_island") == 0, F.count(F.lit(1))
        tail = F.max_by("_streak", F.struct(*order))
        sums = [F.max("_island").alias("_goods"), tail.alias("_tail"), F.max(F.when(leading, F.col("_streak"))).alias("_lead"), F.max(F.when(~leading, F.col("_streak"))).alias("_inner"), size.alias("_n")]

        def fold(parts: DataFrame, over: WindowSpec) -> DataFrame:
            parts = parts.withColumn("_run", F.sum((F.col("_goods") > 0).cast("int")).over(over))
            through = F.sum("_tail").over(Window.partitionBy(*keys, "_run").orderBy(PART))  # the run that is open at the end of a part
            parts = parts.withColumn("_open", through).withColumn("_in", F.coalesce(F.lag("_open").over(over), F.lit(0)))
            trip = (F.coalesce(F.col("_lead") + F.col("_in"), F.lit(0)) >= k) | (F.coalesce("_inner", F.lit(0)) >= k)
            return parts.withColumn("_trips", trip.cast("int")).withColumn("_out", F.coalesce(F.max("_trips").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

        rows = carry(rows, keys, sums, fold, ["_in", "_out"])
        rows = rows.withColumn("_streak", F.col("_streak") + F.when(F.col("_island") == 0, F.coalesce("_in", F.lit(0))).otherwise(F.lit(0)))
    else:
        rows = rows.withColumn("_in", F.lit(0)).withColumn("_out", F.lit(0))
    here = F.max((F.col("_streak") >= k).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn(name, F.greatest(F.coalesce(here, F.lit(0)), F.coalesce("_out", F.lit(0))) == 1)
    return rows.drop("_bad", "_island", "_streak", "_in", "_out", PART)
