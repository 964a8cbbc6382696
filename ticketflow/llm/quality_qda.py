"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.llm.quality_rules import _CLASSES, measure
from ticketflow.llm.text import cut, map_batches, pieces

FEATURES = ("log_words", "word_length", "symbols", "pipes", "bangs", "upper", "digits", "letters", "dup_lines", "repeats", "content")
SHRINK, FLOOR, THRESHOLD = 0.1, 1e-3, 0.3


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def statistics(piece) -> np.ndarray:
    """Transformed statistics of each text of a piece, one row a text; a text without words has zeros."""
    m, n = measure(piece), len(piece)
    words, chars = np.maximum(m["n_words"], 1), np.maximum(piece.end - piece.start, 1)
    c = np.zeros((n, _CLASSES.shape[1]))
    for k in range(_CLASSES.shape[1]):
        run = np.concatenate([[0], np.cumsum(_CLASSES[piece.data, k], dtype=np.int64)])
        c[:, k] = run[piece.end] - run[piece.start]
    lines = np.searchsorted(np.flatnonzero(piece.data == 0x0A), piece.end) - np.searchsorted(np.flatnonzero(piece.data == 0x0A), piece.start) + 1
    root = lambda x: np.sqrt(np.minimum(x, 4))
    x = np.stack([np.log1p(m["n_words"]), np.log1p(m["word_chars"] / words), root(c[:, 0] / words), root(c[:, 1] / words), root(c[:, 2] / words), root(c[:, 3] / np.maximum(c[:, 5], 1)), root(c[:, 4] / chars), c[:, 5] / chars, root(m["n_dup_lines"] / lines), root(m["n_repeat_words"] / words), m["content_share"]], axis=1)
    return np.where((m["n_words"] > 0)[:, None], x, 0.0)


@dataclass
class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances, and log priors; the factors are made once, from class sums."""

    mean: np.ndarray
    factor: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, n: np.ndarray, total: np.ndarray, square: np.ndarray, shrink: float = SHRINK) -> Discriminant:
        """From each class's rows, sums and sums of products. A class without rows has the pooled moments and a prior of one row."""
        d = total.shape[1]
        pooled_n = max(n.sum(), 1.0)
        pooled_mean = total.sum(0) / pooled_n
        within = sum(square[k] - np.outer(total[k], total[k]) / max(n[k], 1.0) for k in range(2)) / pooled_n
        scale = np.diag(np.maximum(np.diag(within), FLOOR))
        mean, factor, offset = [], [], []
        for k in range(2):
            mu = total[k] / n[k] if n[k] else pooled_mean
            own = (square[k] - n[k] * np.outer(mu, mu)) / n[k] if n[k] > 1 else within
            weight = max(shrink, d / (d + n[k]))
            low = np.linalg.cholesky((1 - weight) * own + weight * (0.5 * within + 0.5 * scale) + FLOOR * np.eye(d))
            mean.append(mu)
            factor.append(np.linalg.inv(low))
            offset.append(np.log(max(n[k], 1.0) / pooled_n) - np.log(np.diag(low)).sum())
        return cls(np.array(mean), np.array(factor), np.array(offset))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, from the difference of the log densities."""
        log = [self.offset[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) for k in range(2)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def document_features(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, x array<double>, over whole texts."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0)
        for piece in pieces(batch.column(1)):
            x = statistics(piece)
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([ids.slice(piece.first, len(piece)), column], ["doc_id", "x"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), each, "doc_id long, x array<double>")


def class_sums(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x) rows -> rows, sums and sums of products of both classes: one small row a task and class, added up by Spark."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = np.asarray(batch.column(0))
            x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
            for k in range(2):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["y", "sums"])

    parts = labelled.select("y", "x").mapInArrow(run, "y int, sums array<double>")
    added = parts.select("y", F.posexplode("sums").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((2, 1 + d + d * d))
    for r in added:
        out[r["y"], r["i"]] = r["v"]
    return out[:, 0], out[:, 1 : 1 + d], out[:, 1 + d :].reshape(2, d, d)


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, shrink: float = SHRINK) -> DataFrame:
    """documents, labels -> doc_id, held_out, score, predicted; one row per row of documents, over its whole text.

    The statistics are computed once and kept in the checkpoint folder. The classes' moments
    come from all labelled rows outside the held-out fifth, added up in the tasks, so that the
    driver gets a few hundred numbers whatever the input. Scores are the posterior of label 1.
    Null and empty texts have zero statistics and a score like any other. A null label is not learnt; a document
    labelled twice counts twice; without labels every score is 0.5. Extra columns are not read.
    """
    rows = cut(document_features(docs))
    y = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col("l_id")))
    model = Discriminant.of(*class_sums(rows.join(y.hint("merge"), F.col("doc_id") == F.col("l_id"))), shrink=shrink)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    out = map_batches(rows, each, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
