"""Near duplicates among vectors by product quantisation.

Unit vectors are dealt to coarse inverted lists; what is left after the list's centre is quantised in subspaces, a code each. A vector asks
the nearest lists, as many as hold nearly all vectors that lie just at the threshold, and there compares its own residual, through tables of
squared distances to the codewords, with the codes of the members. The quantisation error of each member is kept, so that the
table distance bounds the true one from both sides, and no pair that meets is skipped. What passes is decided by the exact cosine.
Lists and questions are dealt in blocks; a task compares two blocks and returns a row for each vector, not for each pair.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm.graph import components
from ticketflow.llm.text import _give_back, cut, join_hint, map_batches

#: Vectors of a list (about), lists at most, and vectors that lists and codes are fitted on at most.
PER_LIST, LISTS, SAMPLE = 256, 4096, 40_000
#: Subspaces, codewords of each, rounds of fitting.
SUBSPACES, CODES, ROUNDS = 16, 256, 8
#: Share of vectors at the threshold whose list must be among those asked.
SURE = 0.995
#: Vectors of a block, and pairs that are held at once.
BLOCK, CHUNK = 1024, 1 << 17


class Quantiser(NamedTuple):
    """Centres of the lists, how many lists are asked and how far their border may be, and codewords of each subspace (bounds cut the dimensions)."""

    centers: np.ndarray
    asked: int
    border: float
    bounds: list[int]
    words: list[np.ndarray]


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[k : k + 4096] @ centers.T, axis=1) for k in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of `n` groups; they start at evenly spaced rows, and a centre without rows stays where it is."""
    centers = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(np.int64)].copy()
    for _ in range(rounds):
        own = _nearest(x, centers)
        count = np.bincount(own, minlength=len(centers))
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(count)
        centers[full] = np.add.reduceat(x[order], (np.cumsum(count) - count)[full], axis=0) / count[full, None]
    return centers


def borders(x: np.ndarray, own: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to the centres (less a constant of the row), and distances to the borders between the own list and each other."""
    square = (centers**2).sum(axis=1)
    d = square - 2 * x @ centers.T
    apart = np.sqrt(np.maximum(square[own][:, None] + square - 2 * centers[own] @ centers.T, 1e-18))
    return d, (d - d[np.arange(len(x)), own][:, None]) / (2 * apart)


def fit(x: np.ndarray, lists: int, least: float) -> Quantiser:
    """Fit lists and codes on a sample of unit vectors. Asked are as many lists as hold SURE of vectors whose cosine to one of the sample is just `least`, in random directions."""
    centers = kmeans(x, lists)
    own = _nearest(x, centers)
    rest = x - centers[own]
    bounds = [int(b) for b in np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1)]
    some = x[np.linspace(0, len(x) - 1, min(len(x), 8192)).astype(np.int64)]
    aside = np.random.Generator(np.random.PCG64(11)).normal(size=some.shape)
    aside -= (aside * some).sum(axis=1, keepdims=True) * some
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    other = _nearest(least * some + np.sqrt(1 - least**2) * aside, centers)
    d, border = borders(some, _nearest(some, centers), centers)
    at = np.arange(len(some))
    asked = int(np.ceil(np.quantile((d < d[at, other][:, None]).sum(axis=1) + 1, SURE)))
    return Quantiser(centers, asked, float(np.quantile(border[at, other], SURE)), bounds, [kmeans(np.ascontiguousarray(rest[:, a:b]), CODES) for a, b in zip(bounds, bounds[1:])])


def units(raw: list[bytes]) -> np.ndarray:
    """Packed doubles as unit vectors."""
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, q: Quantiser) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, codes and quantisation error of unit vectors."""
    own = _nearest(x, q.centers)
    rest = x - q.centers[own]
    codes, error = np.zeros((len(x), len(q.words)), dtype=np.uint8), np.zeros(len(x))
    for m, (a, b) in enumerate(zip(q.bounds, q.bounds[1:])):
        part = np.ascontiguousarray(rest[:, a:b])
        codes[:, m] = _nearest(part, q.words[m])
        error += ((part - q.words[m][codes[:, m]]) ** 2).sum(axis=1)
    return own, codes, np.sqrt(error)


def probes(x: np.ndarray, own: np.ndarray, q: Quantiser) -> np.ndarray:
    """The lists that a vector asks: true where it does, its own always."""
    d, border = borders(x, own, q.centers)
    near = border <= q.border
    if q.asked < len(q.centers):
        near &= d <= np.partition(d, q.asked - 1, axis=1)[:, q.asked - 1 : q.asked]
    near[np.arange(len(x)), own] = True
    return near


def table_distances(x: np.ndarray, center: np.ndarray, codes: np.ndarray, q: Quantiser) -> np.ndarray:
    """Distances of vectors to the decoded members of one list, by a table of each vector and subspace."""
    rest, out = x - center, np.zeros((len(x), len(codes)))
    for m, (a, b) in enumerate(zip(q.bounds, q.bounds[1:])):
        part, words = rest[:, a:b], q.words[m]
        table = (part**2).sum(axis=1)[:, None] + (words**2).sum(axis=1) - 2 * part @ words.T
        out += table[:, codes[:, m]]
    return np.sqrt(np.maximum(out, 0))


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each node of a task reaches through pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(q: Quantiser, least: float):
    """A task: questions and members of one list -> node, links (others linked here), root (a node that it is linked with)."""
    reach = float(np.sqrt(2 - 2 * least))

    def run(key: tuple, ask: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"node": pd.Series(dtype=str), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype=str)})
        if not len(ask) or not len(held):
            return none
        x, y = units(ask["asker_v"].tolist()), units(held["v"].tolist())
        codes = np.frombuffer(b"".join(held["codes"]), dtype=np.uint8).reshape(len(held), -1)
        bound = reach + held["error"].to_numpy() + 1e-6
        names, place = np.unique(np.concatenate([ask["asker"].to_numpy(str), held["node"].to_numpy(str)]), return_inverse=True)
        p, r, own = place[: len(ask)], place[len(ask) :], ask["own"].to_numpy(bool)
        left, right = [], []
        step = max(1, CHUNK // len(held))
        for k in range(0, len(ask), step):
            close = table_distances(x[k : k + step], q.centers[key[0]], codes, q) <= bound
            close &= ~own[k : k + step, None] | (p[k : k + step, None] < r)
            i, j = np.nonzero(close)
            good = np.einsum("ij,ij->i", x[i + k], y[j]) >= least
            left.append(i[good] + k)
            right.append(j[good])
        i, j = np.concatenate(left), np.concatenate(right)
        a, b = p[i], r[j]
        n = np.zeros(len(names), dtype=np.int64)
        n += np.bincount(a, weights=held["times"].to_numpy()[j], minlength=len(names)).astype(np.int64)
        n += np.bincount(b, weights=ask["asker_times"].to_numpy()[i], minlength=len(names)).astype(np.int64)
        met = np.flatnonzero(n)
        label = _labels(len(names), a, b)
        _give_back()
        return pd.DataFrame({"node": names[met], "links": n[met], "root": names[label[met]]}) if len(met) else none

    return run


def _linked(classes: DataFrame, least: float) -> DataFrame:
    """(node, times, embedding) of one dimension, each vector once -> node, links, root: partial counts of links and edges to what links lead to."""
    count = classes.count()
    lists = int(min(LISTS, max(1, count // PER_LIST)))
    drawn = classes.select("embedding").orderBy(F.xxhash64("node", F.lit("sample"))).limit(min(SAMPLE, max(lists * 16, 4096))).toArrow().column("embedding")
    width = len(drawn[0])
    q = fit(units([drawn.combine_chunks().flatten().to_numpy().astype(np.float64).tobytes()[k * width * 8 : (k + 1) * width * 8] for k in range(len(drawn))]), lists, least)

    def index(batch: pa.RecordBatch):
        for k in range(0, batch.num_rows, 2048):
            part = batch.slice(k, 2048)
            flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
            raw = [flat[at : at + width].tobytes() for at in range(0, len(flat), width)]
            x = units(raw)
            own, codes, error = encode(x, q)
            ask = probes(x, own, q)
            ask &= np.arange(ask.shape[1]) >= own[:, None]  # two lists meet once, from the smaller one's side
            to = np.split(np.nonzero(ask)[1], np.cumsum(ask.sum(axis=1))[:-1])
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("times"), pa.array(raw, pa.binary()), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(to, pa.list_(pa.int32()))], ["node", "times", "v", "list", "codes", "error", "probes"])

    held = cut(map_batches(classes, index, "node string, times long, v binary, list int, codes binary, error double, probes array<int>"))
    asked = held.select("node", "times", "v", F.col("list").alias("own"), F.explode("probes").alias("list")).withColumn("own", F.col("own") == F.col("list"))
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name))
    sizes = cut(blocks(held, "columns").join(blocks(asked.select("list"), "rows").hint("merge"), "list")).hint("broadcast")  # a row for each list, LISTS at most
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(sizes, "list").withColumn("i", deal("rows")).withColumn("j", every("columns")).select("list", "i", "j", F.col("node").alias("asker"), F.col("times").alias("asker_times"), F.col("v").alias("asker_v"), "own")
    right = held.join(sizes, "list").withColumn("j", deal("columns")).withColumn("i", every("rows")).select("list", "i", "j", "node", "times", "v", "codes", "error")
    return left.groupBy("list", "i", "j").cogroup(right.groupBy("list", "i", "j")).applyInPandas(_compare(q, least), "node string, links long, root string")


def embedding_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, embedding) -> vec_id, n_links, component_id, kept: one row per row, linked where the cosine is `least` or more.

    Lists and codes are fitted on at most SAMPLE vectors, chosen by hash; every vector is indexed. A pair is found if the one in the lower list asks
    the other's, which SURE of pairs just at `least` do, and nearly all closer ones; no link is false. Table distances use bounds that hold for every pair.

    Equal vectors are one node, told apart by two 64-bit hashes. Null vectors, zero ones and those with null or non-finite parts are linked with
    nothing, and vectors of different length are not linked. Repeated rows are vectors of their own and link with each other. A row without an
    id counts as another vector, but names no component: that is the smallest id known, null if none is. An empty table gives no rows;
    other columns are not read.
    """
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit_for_use = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    node = F.concat_ws("-", F.hex(F.xxhash64(v)), F.hex(F.xxhash64(F.lit("second"), v)))
    rows = rows.withColumn("node", F.when(fit_for_use, node))
    classes = cut(rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("times"), F.first("embedding").alias("embedding")).withColumn("size", F.size("embedding")))
    found = None
    for size in [r[0] for r in classes.groupBy("size").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("size").collect()]:
        part = _linked(classes.filter(F.col("size") == size).select("node", "times", "embedding"), least)
        found = part if found is None else found.unionByName(part)
    found = cut(found if found is not None else classes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("root")).limit(0))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("l_node"), "component")
    placed = cut(classes.select("node", "first_id", "times").join(label.hint("merge"), F.col("node") == F.col("l_node"), "left").select("node", "first_id", "times", F.coalesce("component", "node").alias("component")))
    names = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    answer = placed.join(names.hint("merge"), "component").join(counts.hint("merge"), "node", "left").select(F.col("node").alias("a_node"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    answer = cut(answer)
    out = rows.select("vec_id", "node").join(answer.hint(join_hint(answer, 128)), F.col("node") == F.col("a_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
