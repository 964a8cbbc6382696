"""Mixing sources to target weights by balanced (cube-method) sampling."""

from __future__ import annotations

import zlib
from itertools import product
from random import Random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.llm.text import cut

#: Fixed value: what separates words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one flight; a source with more is dealt over several.
BLOCK_ROWS = 4096
#: Rows of a source, about, that stay out of the first flight and enter the second, to make up for the last rounding.
RESERVE_ROWS = 64
#: Sources up to this many are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000

_ROW = "doc_id long, k long, source string, size long, whole long, p double, block long"


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """(source, source_size, n) -> + target: the whole size, shared by weight, at most `limit` times a source's size.

    Sources come by code point, null last, and take the weights in turn. What a stopped source
    leaves is shared among the others by weight, until none is above its limit: sources stop
    in the order of limit / weight, so the first position in that order where the next source
    stays under its limit fixes the level for all.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    rows = totals.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(limit)))
    stops = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("left") / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    rows = rows.withColumn("under", F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level")))
    rows = rows.withColumn("fixed", F.first("under", ignorenulls=True).over(stops.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("most") / F.col("w") >= F.col("fixed"), F.col("fixed") * F.col("w")).otherwise(F.col("most"))
    return rows.select("source", "source_size", "n", target.alias("target"))


def fly(sizes: list[int], p: list[float], rng: Random) -> None:
    """Cube flight phase on (count, size): changes p in place until at most two entries lie strictly between 0 and 1.

    Three open entries always have a direction that changes neither their count nor their
    summed size; the walk goes along it, forth or back, until one of them is 0 or 1.
    """
    held: list[int] = []
    i, n = 0, len(p)
    while True:
        while len(held) < 3 and i < n:
            if 0.0 < p[i] < 1.0:
                held.append(i)
            i += 1
        if len(held) == 3:
            a, b, c = held
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if u == (0, 0, 0):
                u = (1, -1, 0)
        elif len(held) == 2 and sizes[held[0]] == sizes[held[1]]:
            u = (1, -1)
        else:
            return
        forth = min((1.0 - p[k]) / d if d > 0 else p[k] / -d for k, d in zip(held, u) if d)
        back = min(p[k] / d if d > 0 else (1.0 - p[k]) / -d for k, d in zip(held, u) if d)
        step = forth if rng.random() * (forth + back) < back else -back
        for k, d in zip(held, u):
            x = p[k] + step * d
            p[k] = 0.0 if x < 1e-9 else 1.0 if x > 1.0 - 1e-9 else x
        held = [k for k in held if 0.0 < p[k] < 1.0]


def land(sizes: list[int], p: list[float]) -> None:
    """Landing phase: the open entries (two at most) become 0 or 1, as near as can be to their size, then to their count.

    What this is off in size is made up, as far as that goes, by turning settled entries of the
    group, largest first.
    """
    open_ = [k for k, x in enumerate(p) if 0.0 < x < 1.0]
    size, count = sum(sizes[k] * p[k] for k in open_), sum(p[k] for k in open_)
    best = min(product((0.0, 1.0), repeat=len(open_)), key=lambda pick: (abs(sum(sizes[k] * x for k, x in zip(open_, pick)) - size), abs(sum(pick) - count), pick))
    for k, x in zip(open_, best):
        p[k] = x
    off = sum(sizes[k] * p[k] for k in open_) - size
    for k in sorted(range(len(p)), key=lambda k: (-sizes[k], k)):
        change = sizes[k] if p[k] == 0.0 else -sizes[k]
        if k not in open_ and abs(off + change) < abs(off):
            p[k], off = 1.0 - p[k], off + change


def _sample(level: int, last: bool, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(order=[zlib.crc32(f"{seed} {level} {d} {k}".encode()) for d, k in zip(rows["doc_id"], rows["k"])]).sort_values(["order", "doc_id", "k", "size"], kind="stable")
        sizes, p = [int(x) for x in rows["size"]], [float(x) for x in rows["p"]]
        head = rows.iloc[0]
        fly(sizes, p, Random(zlib.crc32(f"{seed} {level} {head['source']} {head['block']}".encode())))
        if last:
            land(sizes, p)
        return rows.assign(p=p).drop(columns="order")

    return run


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0, block_rows: int = BLOCK_ROWS, seed: int = 17) -> DataFrame:
    """documents -> doc_id, source, size, source_size, target, copies, taken; one row per row of documents.

    A source that has to give `r` times its size takes each document floor(r) times, and once
    more with probability r - floor(r). Which ones is decided by the cube method, that keeps
    both the words and the number of documents of the source in balance. A source of any
    size is dealt over blocks of about `block_rows` rows; each block leaves at most two open
    probabilities, and these go through the same step again, until one block a source is left,
    where the landing phase rounds the last two. So a source misses its target by less than
    one document, whatever its size; about RESERVE_ROWS of its documents skip the first step, so that
    the last one has some to turn where that brings the words nearer.

    Null text or no words: size 0, taken 0. Null source: a source of its own. Repeated rows, and rows that share
    a doc_id or have none: each is a document; those with the same id, source and size are numbered, so that they are dealt over
    blocks like others. Empty table: empty result. Columns other than doc_id, text and source
    are not read. The choice depends on seed, ids, sources and sizes alone, so reruns agree.
    """
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    if sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or doc_id is null").isEmpty():
        sized = sized.withColumn("k", F.lit(0).cast("long"))
    else:
        alike = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("c"))
        sized = cut(alike.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))).drop("c"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = cut(source_targets(totals, weights, limit))
    small = targets.count() <= BROADCAST_SOURCES
    hint = "broadcast" if small else "merge"
    t = targets.withColumnRenamed("source", "t_source").hint(hint)
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    block = lambda n: F.pmod(F.xxhash64(F.col("doc_id"), F.col("k"), F.lit(seed)), F.greatest(F.ceil(n / F.lit(block_rows)), F.lit(1)))

    reserve = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("k")), F.greatest(F.col("n"), F.lit(1))) < RESERVE_ROWS
    first = rows.withColumn("block", F.when(reserve, F.lit(-1)).otherwise(block(F.col("n")))).select("doc_id", "k", "source", "size", "whole", "p", "block")
    flown = first.filter("block >= 0").groupBy("source", "block").applyInPandas(_sample(0, False, seed), _ROW)
    state = cut(flown.unionByName(first.filter("block < 0")))
    done, level = [], 0
    while True:
        level += 1
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(state.filter(~is_open))
        rest = state.filter(is_open)
        count = rest.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        most = count.agg(F.max("n")).first()[0] or 0
        last = most <= block_rows
        if not last:
            c = count.withColumnRenamed("source", "c_source").hint(hint)
            rest = rest.drop("block").join(c, F.col("source").eqNullSafe(F.col("c_source"))).withColumn("block", block(F.col("n"))).select("doc_id", "k", "source", "size", "whole", "p", "block")
        else:
            rest = rest.withColumn("block", F.lit(0).cast("long"))
        state = rest.groupBy("source", "block").applyInPandas(_sample(level, last, seed), _ROW)
        if last:
            done.append(state)
            break
        state = cut(state)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("p").cast("long")).alias("copies")
    out = out.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", copies, (F.col("size") * copies).alias("taken"))
