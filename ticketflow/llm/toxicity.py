"""Toxicity by compression distance between two zstandard dictionaries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm.quality_qda import held_out
from ticketflow.llm.text import cut, map_batches, map_iter

#: Bound of the training sample: labelled documents of each class, chosen by a hash of the id.
TRAIN_TOXIC, TRAIN_ORDINARY = 3000, 9000
#: Words in a dictionary at most, and how much more frequent a toxic word has to be.
DICTIONARY_WORDS, MIN_RATIO, MIN_Z, MIN_COUNT = 1000, 5.0, 6.0, 5
THRESHOLD = 0.5
FEATURES = 6
#: Bytes of a longer word are cut into windows of this size.
WINDOW = 64
#: Text that both dictionaries know stands around each window, so that zstandard, which does
#: not look for matches at the very end of a block, can match all of a short word.
_LEFT, _RIGHT = bytes(range(0x80, 0x90)), bytes(range(0xA0, 0xB8))
_CACHE_WORDS, _COUNTS = 120_000, 40_000
#: Beginnings of words count as candidates too, so that a stem is learnt from few of its forms.
STEM = range(4, 8)


def windows(text: bytes) -> list[bytes]:
    """The lower-cased windows of a whole text: its words, long ones in pieces."""
    out = []
    for w in set(text.lower().split()):
        out += [w] if len(w) <= WINDOW else [w[i : i + WINDOW] for i in range(0, len(w), WINDOW)]
    return out


def segments(word: bytes) -> list[bytes]:
    """The word, without what exceeds a window, and its beginnings."""
    return [word[:WINDOW], *(word[:k] for k in STEM if k < len(word))]


class Distance:
    """Compressed length of a window with the ordinary dictionary, less that with the toxic one."""

    def __init__(self, ordinary: list[bytes], toxic: list[bytes]):
        end = b" " + _LEFT + b"  " + _RIGHT
        self.coders = [self.coder(b" ".join([*ordinary, b""]) + end), self.coder(b" ".join([*ordinary, *toxic, b""]) + end)]
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    @staticmethod
    def coder(content: bytes) -> zstandard.ZstdCompressor:
        p = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=15, hash_log=15, chain_log=15, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2)
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)

    def __call__(self, window: bytes) -> int:
        d = self.known.get(window)
        if d is None:
            d = self.older.get(window)
            if d is None:
                b = b"".join([_LEFT, b" ", window, b" ", _RIGHT])
                d = len(self.coders[0].compress(b)) - len(self.coders[1].compress(b))
            if len(self.known) >= _CACHE_WORDS:  # frequent windows come back from the older half
                self.older, self.known = self.known, {}
            self.known[window] = d
        return d

    def features(self, text: bytes | None) -> tuple[float, ...]:
        """The three largest distances, how many windows pass 4 and 6, and the number of windows (logarithms); a text without windows has zeros."""
        d = sorted(map(self, windows(text or b"")), reverse=True)
        top = [*d[:3], 0, 0, 0]
        over = [sum(1 for _ in _over(d, t)) for t in (4, 6)]
        return (float(top[0]), float(top[1]), float(top[2]), math.log1p(over[0]), math.log1p(over[1]), math.log1p(len(d)))


def _over(ordered: list[int], least: int) -> Iterator[int]:
    for x in ordered:
        if x < least:
            return
        yield x


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression on standardised columns, in the columns' own units."""
    mean, dev = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / dev, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1])
        step = np.linalg.solve(hess, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    own = w[:-1] / dev
    return np.append(own, w[-1] - own @ mean)


def _contrast(count: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """(word, toxic, ordinary) counts -> those significantly more frequent in toxic text, with z and ratio."""
    n1, n0 = (float(max(t, 1)) for t in totals)
    rate = (F.col("toxic") + F.col("ordinary")) / (n1 + n0)
    z = (F.col("toxic") / n1 - F.col("ordinary") / n0) / F.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0))
    ratio = (F.col("toxic") / n1) / ((F.col("ordinary") + 0.5) / n0)
    return count.withColumn("z", z).filter((F.col("toxic") >= MIN_COUNT) & (F.col("z") >= MIN_Z) & (ratio >= MIN_RATIO) & (F.length("word") >= 3))


def _class_counts(sample: DataFrame, keep: list[bytes] | None) -> DataFrame:
    """Segments of the words of the sample's whole texts -> word, toxic, ordinary. With `keep`, each (word before, segment) pair of a class counts once, and only for those segments."""
    wanted = None if keep is None else set(keep)

    def counted(counts: Counter) -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.binary()), pa.array([k[2] for k in keys], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["y", "word", "before", "n"])

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = (text.as_py() or b"").lower().split()
            if wanted is None:
                counts.update((y, x, b"") for w in words for x in segments(w))
            else:
                counts.update({(y, x, before) for before, w in zip([b"", *words], words) for x in segments(w) if x in wanted})
            if len(counts) > _COUNTS:  # sums of parts are as good
                yield counted(counts)
                counts.clear()
        yield counted(counts)

    rows = map_batches(sample.select("y", F.encode("text", "UTF-8").alias("text")), each, "y int, word binary, before binary, n long")
    if wanted is not None:
        rows = rows.select("y", "word", "before").distinct().withColumn("n", F.lit(1))
    return rows.groupBy("word").agg(F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("n"))), F.lit(0)).alias("toxic"), F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("n"))), F.lit(0)).alias("ordinary"))


def train_distance(sample: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """The words of the ordinary and of the toxic dictionary, from (y, text) rows of a bounded sample.

    zstandard's own trainer takes what is frequent, which in both classes is the common
    language; so each dictionary gets what is frequent in its class, and the toxic one only
    what is significantly more frequent there. Words of copied texts would pass as significant;
    therefore the words that do are counted again by the number of different words before them.
    """
    count = cut(_class_counts(sample, None))
    totals = count.agg(F.sum("toxic"), F.sum("ordinary")).first()
    totals = (totals[0] or 0, totals[1] or 0)
    ordinary = [bytes(r[0]) for r in count.orderBy(F.desc("ordinary"), "word").filter(F.length("word") >= 2).limit(DICTIONARY_WORDS).select("word").collect()]
    first = [bytes(r[0]) for r in _contrast(count, totals).orderBy(F.desc("z"), "word").limit(20 * DICTIONARY_WORDS).select("word").collect()]
    again = _class_counts(sample, first)
    toxic = [bytes(r[0]) for r in _contrast(again, totals).orderBy(F.desc("z"), "word").limit(DICTIONARY_WORDS).select("word").collect()]
    return ordinary[::-1], toxic[::-1]


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_toxic: int = TRAIN_TOXIC, train_ordinary: int = TRAIN_ORDINARY, carry: str | None = None) -> DataFrame:
    """documents, labels -> doc_id, held_out, score, predicted; one row per row of documents, over its whole text.

    The dictionaries and the calibration are learnt from a bounded sample: at most `train_toxic` and
    `train_ordinary` labelled documents outside the held-out fifth. Every text is then cut
    into windows (its distinct words); the difference of a window's two compressed lengths is its
    distance, and a logistic calibration of the largest distances and of the windows past the thresholds is the score.
    The pass over all documents is one map without a shuffle.

    Null and empty texts have no windows, hence the score of the shortest texts of the sample without any distance. Null labels are
    not learnt; without labels of both classes every score is 0. A document that is labelled twice counts twice. Repeated rows are
    scored alike. Rows without a doc_id are scored and never learnt; held_out is null for them. Extra columns are not read, but for
    `carry`, the name of a number column that the result has too.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("l_id").isNotNull() & ~held_out(F.col("l_id")))
    chosen = None
    for label, most in ((1, train_toxic), (0, train_ordinary)):
        own = y.filter(F.col("y") == label).orderBy(F.xxhash64("l_id"), "l_id").limit(most)
        chosen = own if chosen is None else chosen.unionByName(own)
    extra = [F.col(carry).cast("long").alias(carry)] if carry else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    sample = cut(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("doc_id", "y", "text"))
    ordinary, toxic = train_distance(sample)

    def measured(rows: DataFrame, keys: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            distance = Distance(ordinary, toxic)
            for batch in batches:
                x = [distance.features(t.as_py()) for t in batch.column(0)]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(x, pa.list_(pa.float64()))], [*batch.schema.names[1:], "x"])

        names = [k.split()[0] for k in keys.split(", ")]
        return map_iter(rows.select(F.encode("text", "UTF-8").alias("text"), *names), run, f"{keys}, x array<double>")

    known = measured(sample, "y int").collect()
    ys, xs = np.array([r[0] for r in known], dtype=float), np.array([r[1] for r in known], dtype=float).reshape(-1, FEATURES)
    weights = fit_logistic(xs, ys) if 0 < ys.sum() < len(ys) else np.append(np.zeros(FEATURES), -1e9)
    at = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):  # inside the range of the sample, so that an empty or huge text is no extrapolation
        low, high = (float(xs[:, i].min()), float(xs[:, i].max())) if len(xs) else (0.0, 0.0)
        at = at + F.lit(float(w)) * F.least(F.greatest(F.col("x")[i], F.lit(low)), F.lit(high))
    out = measured(texts, f"doc_id long, {carry} long" if carry else "doc_id long").withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(at, F.lit(30.0)), F.lit(-700.0)))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *([carry] if carry else []))
