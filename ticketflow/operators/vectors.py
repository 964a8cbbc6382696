"""Vector search: cells with exact bounds, and blocks multiplied as matrices.

Points are dealt to cells round centres that are fitted on a bounded sample. A cell's radius bounds the cosine
that any of its points can have with a query, so cells are left out without a loss. Where no floor is given, the nearest cells are
searched first and the k-th best score found there is the floor for all others. A vector is sent to tiles, of which there are a few, and not to
cells, as in many dimensions most cells can be in reach: neighbouring cells form a tile. Points and queries of a tile meet as two large blocks, where cells out of reach
are left out; a task multiplies some rows at a time and returns the best of its block, not a row for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketflow.functions import scalars as S
from ticketflow.operators.lineage import cut

#: Points of a cell (about), cells at most, points that centres are fitted on at most, rounds of fitting; fewer points than DIRECT are one cell.
CELL, CELLS, SAMPLE, ROUNDS, DIRECT = 64, 4096, 16_384, 2, 16_384
#: Tiles that cells are grouped into at most, rows of a block of a search, and at least of a block whose pairs are returned; cells that are searched before there is a floor.
TILES, BLOCK, PAIRS, FIRST = 12, 65_536, 2048, 2
#: Numbers of one matrix that a task holds at a time.
HELD = 4_000_000
#: Slack for rounding, so that no score at a floor is left out.
SLACK = 1e-6


class Cells(NamedTuple):
    """Centres, and the largest distance of a point to each; no centres: one cell holds all."""

    centers: np.ndarray
    radius: np.ndarray


class Index(NamedTuple):
    """Points (block, grp, v, cell), and their cells."""

    points: DataFrame
    cells: Cells


def unit(name: str) -> Column:
    """A vector column as unit vectors of doubles."""
    return S.l2_normalize(F.col(name).cast("array<double>"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _mapped(df: DataFrame, each: Callable[[pa.RecordBatch], dict[str, object]], more: str) -> DataFrame:
    """The table with the columns that `each` makes from a batch."""
    names = [x.split(":")[0] for x in more.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = each(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[made[n] for n in names]], [*batch.schema.names, *names])

    kept = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in df.schema)
    return df.mapInArrow(run, f"{kept}, {more.replace(':', ' ')}")


def _parts(rows: int, columns: int) -> list[slice]:
    """Rows in parts, so that a part's matrix of `columns` is small."""
    step = max(1, HELD // max(1, columns))
    return [slice(k, k + step) for k in range(0, rows, step)]


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distance of each row to each centre."""
    square = (x**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1) - 2 * x @ centers.T
    return np.sqrt(np.maximum(square, 0))


def fit_centers(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres that leave no row far from all: each starts at the row that is farthest from those before it, then moves to the mean of its rows."""
    square, picked = (x**2).sum(axis=1), [0]
    away = square + square[0] - 2 * x @ x[0]
    while len(picked) < min(n, len(x)):
        k = int(away.argmax())
        picked.append(k)
        np.minimum(away, square + square[k] - 2 * x @ x[k], out=away)
    centers = x[picked].copy()
    for _ in range(rounds):
        own = np.concatenate([distances(x[k : k + 2048], centers).argmin(axis=1) for k in range(0, len(x), 2048)])
        count = np.bincount(own, minlength=len(centers))
        full = np.flatnonzero(count)
        centers[full] = np.add.reduceat(x[np.argsort(own, kind="stable")], (np.cumsum(count) - count)[full], axis=0) / count[full, None]
    return centers


def build_index(points: DataFrame) -> Index:
    """(block, grp, v) with unit vectors -> an index; rows without a vector are left out. Scores are the best point's of each grp inside a block."""
    points = cut(points.select("block", "grp", "v").filter("v is not null and size(v) > 0"))
    count = points.count()
    n = min(CELLS, count // CELL)
    if count < DIRECT or n < 2:
        return Index(points.withColumn("cell", F.lit(0)), Cells(np.zeros((0, 0)), np.zeros(0)))
    drawn = points.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()
    centers = fit_centers(matrix(drawn.column("v")), n)
    n = len(centers)

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        x = matrix(batch.column("v"))
        own, away = np.empty(len(x), np.int32), np.empty(len(x))
        for part in _parts(len(x), n):
            d = distances(x[part], centers)
            own[part], away[part] = d.argmin(axis=1), d.min(axis=1)
        return {"cell": pa.array(own), "away": pa.array(away)}

    held = cut(_mapped(points, each, "cell:int, away:double"))
    radius = np.full(n, -1.0)
    for cell, away in held.groupBy("cell").agg(F.max("away")).collect():  # a row for each cell
        radius[cell] = away
    return Index(held.drop("away"), Cells(centers, radius))


def save_index(index: Index, path: str) -> None:
    """Write an index as two tables."""
    index.points.write.parquet(f"{path}/points")
    rows = [(k, [float(x) for x in c], float(r)) for k, (c, r) in enumerate(zip(index.cells.centers, index.cells.radius))]
    index.points.sparkSession.createDataFrame(rows, "cell int, center array<double>, radius double").write.parquet(f"{path}/cells")


def load_index(spark: SparkSession, path: str) -> Index:
    """Read what save_index wrote."""
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return Index(spark.read.parquet(f"{path}/points"), Cells(np.array([r.center for r in rows]).reshape(len(rows), -1), np.array([r.radius for r in rows])))


def reachable(d: np.ndarray, radius: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Which cells can hold a point whose cosine is at least `floor`, from the distances to the centres."""
    nearest = np.maximum(d - radius, 0)
    return (1 - nearest**2 / 2 >= floor - SLACK) & (radius >= 0)


def tiles_of(cells: Cells) -> np.ndarray:
    """The tile of each cell: cells whose centres are close share one. Without centres, one tile."""
    if not len(cells.radius):
        return np.zeros(1, np.int64)
    return distances(cells.centers, fit_centers(cells.centers, TILES)).argmin(axis=1)


def _asked(queries: DataFrame, cells: Cells, floor: float | None, done: bool, groups: np.ndarray) -> DataFrame:
    """The table with the groups (cells x groups) of the cells to search."""
    rows_floor = "least" in queries.columns
    held = groups.astype(np.float32)

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        x, asked = matrix(batch.column("v")), []
        least = batch.column("least").to_numpy(zero_copy_only=False) if rows_floor else None if floor is None else np.full(len(x), floor)
        for part in _parts(len(x), len(cells.radius)):
            d = distances(x[part], cells.centers)
            near = np.zeros(d.shape, dtype=bool)
            np.put_along_axis(near, np.argsort(np.where(cells.radius >= 0, d, np.inf), axis=1, kind="stable")[:, :FIRST], True, axis=1)
            if least is not None:
                want = reachable(d, cells.radius, least[part, None])
                near = want & ~near if done else want
            asked.append(near.astype(np.float32) @ held > 0)
        near = np.concatenate(asked)
        cut_at = np.cumsum(near.sum(axis=1))[:-1]
        return {"asked": pa.array(np.split(np.nonzero(near)[1].astype(np.int32), cut_at), pa.list_(pa.int32()))}

    return _mapped(queries, each, "asked:array<int>")


def asked_cells(queries: DataFrame, cells: Cells, floor: float | None, done: bool = False) -> DataFrame:
    """(query, block, v) -> with the cells to search: those in reach of `floor` or of the row's own `least`; without either the FIRST nearest; `done`: not these."""
    if not len(cells.radius):
        return queries.withColumn("asked", F.array(F.lit(0)))
    return _asked(queries, cells, floor, done, np.eye(len(cells.radius)))


def asked_tiles(queries: DataFrame, cells: Cells, floor: float | None) -> DataFrame:
    """(query, block, v) -> with the tiles that hold a cell of asked_cells."""
    if not len(cells.radius):
        return queries.withColumn("asked", F.array(F.lit(0)))
    return _asked(queries, cells, floor, False, tiles_of(cells)[:, None] == np.arange(TILES))


def _tiled(points: DataFrame, cells: Cells, **more: list) -> DataFrame:
    """Points with their tile, and with `more`, which has an array of tiles for each tile."""
    tiles = tiles_of(cells)
    rows = [(k, int(t), *[m[t] for m in more.values()]) for k, t in enumerate(tiles)]
    schema = ", ".join(["cell int, tile int", *[f"{name} array<int>" for name in more]])
    return points.join(points.sparkSession.createDataFrame(rows, schema).hint("broadcast"), "cell")


def blocks(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, left_rows: int, right_rows: int) -> tuple[DataFrame, DataFrame]:
    """Deal both sides of each key over blocks of about so many rows; each pair of blocks is one key (`on`, _i, _j)."""
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides may come from one table
    n = lambda df, name, rows: df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / rows).alias(name))
    sizes = cut(n(left.select(*on), "_rows", left_rows).join(n(right.select(*on), "_columns", right_rows).hint("merge"), on))
    sizes = sizes.hint("broadcast" if sizes.count() <= 200_000 else "merge")
    deal = lambda key, c: F.pmod(F.xxhash64(key), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    a = left.join(sizes, on).withColumn("_i", deal(left_id, "_rows")).withColumn("_j", every("_columns")).drop("_rows", "_columns")
    b = right.join(sizes, on).withColumn("_j", deal(right_id, "_columns")).withColumn("_i", every("_rows")).drop("_rows", "_columns")
    return a, b


def best_of_block(left: pa.Table, right: pa.Table, k: int, apart: bool, cells: Cells) -> pa.Table:
    """Of each query the k best groups of a block: score (six digits) descending, then group; `apart`: not the query's own."""
    query, group = (np.asarray(t.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for t, c in ((left, "query"), (right, "grp")))
    names, of = np.unique(group, return_inverse=True)
    order = np.argsort(of, kind="stable")
    x, y, of = matrix(left.column("v")), matrix(right.column("v"))[order], of[order]
    least = left.column("least").combine_chunks().to_numpy(zero_copy_only=False) if "least" in left.column_names else np.full(len(x), -np.inf)
    turn, cell = np.arange(len(x)), None
    if len(cells.radius) and "least" in left.column_names:  # queries of one cell in a row share the cells in reach
        held, cell = np.unique(right.column("cell").combine_chunks().to_numpy(zero_copy_only=False)[order], return_inverse=True)
        centers, radius = cells.centers[held], cells.radius[held]
        turn = np.argsort(np.concatenate([distances(x[p], centers).argmin(axis=1) for p in _parts(len(x), len(held))]), kind="stable")
    own = np.minimum(np.searchsorted(names, query), len(names) - 1)
    own = np.where(apart & (names[own] == query), own, -1)
    found = []
    for part in _parts(len(x), len(y)):
        rows, some, groups = turn[part], y, of
        if cell is not None:
            reach = reachable(distances(x[rows], centers), radius, least[rows, None]).any(axis=0)[cell]
            some, groups = (y, of) if reach.all() else (y[reach], of[reach])
        if not len(some):
            continue
        starts = np.flatnonzero(np.diff(groups, prepend=-1))
        score, groups = x[rows] @ some.T, groups[starts]
        if len(starts) < score.shape[1]:
            score = np.maximum.reduceat(score, starts, axis=1)
        at = np.minimum(np.searchsorted(groups, own[rows]), len(groups) - 1)
        same = np.flatnonzero(groups[at] == own[rows])
        score[same, at[same]] = -np.inf
        near = score >= least[rows, None] - SLACK
        if score.shape[1] > k and np.count_nonzero(near) > 4 * k * len(rows):
            near &= score >= np.partition(score, -k, axis=1)[:, [-k]] - SLACK
        q, g = np.nonzero(near & (score > -np.inf))
        s = np.round(score[q, g], 6)
        ok = s >= least[rows][q]
        q, g, s = q[ok], g[ok], s[ok]
        order = np.lexsort((g, -s, q))
        q, g, s = q[order], g[order], s[order]
        best = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
        found.append((rows[q[best]], groups[g[best]], s[best]))
    q, g, s = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return pa.table({"query": left.column("query").combine_chunks().take(pa.array(q)), "grp": pa.array(names[g], right.schema.field("grp").type), "score": pa.array(s, pa.float64())})


def _search(asked: DataFrame, index: Index, k: int, apart: bool) -> DataFrame:
    more = [c for c in ("least",) if c in asked.columns]
    cells = index.cells
    rows = asked.select("query", "block", "v", *more, F.explode("asked").alias("tile"))
    few = BLOCK if len(cells.radius) else max(1, BLOCK // 8)  # few points are cheap to repeat, which lets more tasks share the queries
    left, right = blocks(rows, _tiled(index.points, cells), ["block", "tile"], "query", "v", few, BLOCK)
    keys = ["block", "tile", "_i", "_j"]
    schema = f"query {_kind(asked, 'query')}, grp {_kind(index.points, 'grp')}, score double"

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query": a.column("query").slice(0, 0), "grp": b.column("grp").slice(0, 0), "score": pa.array([], pa.float64())})
        return best_of_block(a, b, k, apart, cells)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def best_groups(queries: DataFrame, index: Index, k: int, floor: float | None = None, apart: bool = False) -> DataFrame:
    """(query, block, v) -> query, grp, score, rank: the k best groups of the query's block, exact; with a floor only those that reach it.

    Ties go to the smaller group. A zero vector scores 0 with all. `apart`: a query is not its own answer.
    """
    queries = queries.filter("v is not null and size(v) > 0")
    if floor is not None:
        queries = queries.withColumn("least", F.lit(floor))
    asked = cut(asked_tiles(queries, index.cells, floor))
    found = _search(asked, index, k, apart)
    if floor is None and len(index.cells.radius):
        found = cut(found.groupBy("query", "grp").agg(F.max("score").alias("score")))
        by = Window.partitionBy("query").orderBy(F.desc("score"), "grp")
        kth = found.withColumn("r", F.row_number().over(by)).filter(F.col("r") == k).select("query", F.col("score").alias("least"))
        open_ = asked.withColumnRenamed("asked", "before").join(kth.hint("merge"), "query", "left").na.fill(-2.0, ["least"])
        rest = asked_tiles(open_, index.cells, None).withColumn("asked", F.array_except("asked", "before"))
        more = cut(rest.drop("before").filter("size(asked) > 0"))
        found = found.unionByName(_search(more, index, k, apart))
    best = found.groupBy("query", "grp").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "grp")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _close_pairs(p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray, once: bool, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a, b, sim) of two blocks whose cosine reaches the floor, some rows at a time; `once`: of both orders of a pair only one."""
    for part in _parts(len(x), 4 * len(y)):
        score = x[part] @ y.T
        near = score >= floor - SLACK
        if once:
            near &= p[part, None] < q
        at = np.flatnonzero(near)
        sim = np.round(score.ravel()[at], 6)
        at, sim = at[sim >= floor], sim[sim >= floor]
        i, j = np.divmod(at, len(y))
        first, second = p[part][i], q[j]
        yield np.minimum(first, second), np.maximum(first, second), sim


def close_tiles(cells: Cells, floor: float) -> np.ndarray:
    """Which tiles (tiles x tiles) hold two cells in reach of each other."""
    tiles = tiles_of(cells)
    if not len(cells.radius):
        return np.ones((1, 1), dtype=bool)
    held = (tiles[:, None] == np.arange(TILES)).astype(np.float32)
    near = np.zeros((TILES, TILES), dtype=bool)
    for part in _parts(len(tiles), len(tiles)):
        reach = reachable(distances(cells.centers[part], cells.centers), cells.radius[part, None] + cells.radius, np.float64(floor)) & (cells.radius[part, None] >= 0)
        near |= held[part].T @ (reach.astype(np.float32) @ held) > 0
    return near | near.T


def close_pairs(rows: DataFrame, floor: float) -> DataFrame:
    """(id, block, v) with unit vectors -> block, a, b, sim: unordered pairs of a block with a cosine of `floor` or more.

    Pairs of tiles that are too far apart for the floor are left out before anything is multiplied.
    """
    index = build_index(rows.select("block", F.col("id").alias("grp"), "v"))
    near = close_tiles(index.cells, floor)
    ahead = [[int(x) for x in np.flatnonzero(near[k]) if x >= k] for k in range(len(near))]
    behind = [[int(x) for x in np.flatnonzero(near[k]) if x <= k] for k in range(len(near))]
    points = _tiled(index.points, index.cells, his=ahead, los=behind).withColumnRenamed("grp", "id")
    left = points.select("block", F.col("id").alias("p"), F.col("v").alias("x"), F.col("tile").alias("lo"), F.explode("his").alias("hi"))
    right = points.select("block", F.col("id").alias("q"), F.col("v").alias("y"), F.explode("los").alias("lo"), F.col("tile").alias("hi"))
    size = min(BLOCK, max(PAIRS, points.count() // 64))  # blocks that grow with the table, so that a vector is sent to a fixed number of them
    a, b = blocks(left, right, ["block", "lo", "hi"], "p", "q", size, size)
    keys = ["block", "lo", "hi", "_i", "_j"]
    both = a.select(*keys, F.lit(True).alias("left"), F.col("p").alias("id"), F.col("x").alias("v")).unionByName(b.select(*keys, F.lit(False).alias("left"), F.col("q").alias("id"), F.col("y").alias("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by("id")  # one order, so that a pair's score is the same each time it is computed
        key, side = rows.slice(0, 1), rows.column("left")
        sides = [rows.filter(side), rows.filter(pc.invert(side))]
        if not all(t.num_rows for t in sides):
            return
        (p, x), (q, y) = ((t.column("id").combine_chunks().to_numpy(zero_copy_only=False), matrix(t.column("v"))) for t in sides)
        ids, once = rows.schema.field("id").type, key.column("lo")[0] == key.column("hi")[0]
        for first, second, sim in _close_pairs(p, x, q, y, once, floor):
            block = pa.repeat(key.column("block")[0], len(sim))
            yield pa.RecordBatch.from_arrays([block, pa.array(first, ids), pa.array(second, ids), pa.array(sim, pa.float64())], ["block", "a", "b", "sim"])

    kind = _kind(points, "id")
    return both.groupBy(*keys).applyInArrow(run, f"block {_kind(points, 'block')}, a {kind}, b {kind}, sim double")
