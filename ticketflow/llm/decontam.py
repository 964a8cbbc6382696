"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm.text import Piece, map_batches, ngrams, pieces, prefix_hash, span_hash

#: Words of a seed.
SEED_WORDS = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least alignment score, as a share of the item's score against itself.
MIN_SCORE = 0.5
#: Bytes of test items that go to the tasks at once; more items take more passes.
BLOCK_BYTES = 16 << 20


class Items:
    """A block of test items: word hashes of each, and all seeds in order of their hash."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids = [r[0] for r in rows]
        piece = Piece([(r[1] or "").encode() for r in rows], 0, lower=True)
        words, doc = piece.word_hashes()
        cuts = np.searchsorted(doc, np.arange(len(rows) + 1))
        self.words = [words[cuts[i] : cuts[i + 1]] for i in range(len(rows))]
        seeds, items, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        length = np.diff(cuts)
        for n in sorted({min(SEED_WORDS, int(x)) for x in length if x}):
            h, at = ngrams(words, doc, n)
            own = (length[doc[at]] == n) if n < SEED_WORDS else np.ones(len(at), bool)
            seeds.append(h[own])
            items.append(doc[at][own])
            size.append(np.full(own.sum(), n))
        h, item, n = np.concatenate(seeds), np.concatenate(items), np.concatenate(size)
        order = np.lexsort((item, h))
        self.seed, self.item, self.size = h[order], item[order], n[order]
        self.lengths = sorted({int(x) for x in n})

    def hits(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and seed numbers at which a text has a seed."""
        at_all, seed_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in self.lengths:
            h, at = ngrams(words, doc, n)
            low = np.searchsorted(self.seed, h, side="left")
            some = np.flatnonzero(self.seed[np.minimum(low, len(self.seed) - 1)] == h)
            low, at = low[some], at[some]
            times = np.searchsorted(self.seed, h[some], side="right") - low
            seed_all.append(np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
            at_all.append(np.repeat(at, times))
        return np.concatenate(at_all), np.concatenate(seed_all)


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman over words with linear gaps: best score and where it ends in the text."""
    idx = np.arange(len(text) + 1, dtype=np.int64)
    row, best, end = np.zeros(len(text) + 1, dtype=np.int64), 0, 0
    for w in item:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(text == w, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new - GAP * idx) + GAP * idx  # gaps along the text
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def _reaches(text: np.ndarray, query: np.ndarray, min_score: float) -> bool:
    """Whether the text has enough of the item's words for the score: an alignment has MATCH at most for each."""
    return bool(np.isin(query, text).sum() >= min_score * len(query))


def _passages(docs: DataFrame, items: Items, min_score: float) -> DataFrame:
    """Whole texts -> doc_id, item, first, words: each run of hits of one item, with an item's length of words around it, that could reach the score."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_pylist()
        out: dict[str, list] = {k: [] for k in ("doc_id", "item", "first", "words")}
        for piece in pieces(batch.column(1), lower=True):
            start, end, doc = piece.words()
            words = span_hash(prefix_hash(piece.data), start, end)
            at, seed = items.hits(words, doc)
            if not len(at):
                continue
            of, item = doc[at], items.item[seed]
            order = np.lexsort((at, item, of))
            at, of, item = at[order], of[order], item[order]
            reach = np.array([len(w) for w in items.words])[item]
            new = np.ones(len(at), bool)
            new[1:] = (of[1:] != of[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > reach[1:])
            begins = np.flatnonzero(new)
            for a, b in zip(begins, np.append(begins[1:], len(at))):
                lo, hi = np.searchsorted(doc, of[a], side="left"), np.searchsorted(doc, of[a], side="right")
                p, q = max(lo, at[a] - reach[a]), min(hi, at[b - 1] + 2 * reach[a])
                if not _reaches(words[p:q], items.words[item[a]], min_score):
                    continue
                out["doc_id"].append(ids[piece.first + of[a]])
                out["item"].append(int(item[a]))
                out["first"].append(int(p - lo))
                out["words"].append(words[p:q].view(np.int64))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    return map_batches(docs, each, "doc_id long, item int, first long, words array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents, benchmark (item_id, text) -> doc_id, item_id, score, first_word, last_word; a row for each pair that aligns.

    Every text is read once and whole. Where it has a four-word seed of an item, the words around are a passage, which
    is aligned with the item unless it holds too few of the item's words for the score, however frequent its seeds are.
    The score is a share of the item's own, so 1 is a verbatim copy, and edits or lost words lower it. A pair
    has its best alignment; word numbers are those of the text, from 0, the last included.

    The test items go to the tasks in blocks of at most `block_bytes`, one pass for each block, so a larger benchmark
    needs more passes and not more memory. Items of fewer words than a seed match as a whole. Null or
    empty texts and items match nothing. Repeated documents, those that share a doc_id and those without one are one document of
    that id, or of none, with one row an item: the best of all. Of equal alignments the first counts. Empty tables: empty result.
    Extra columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for k in range(blocks):
        own = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        found = _block(texts, Items([(r[0], r[1]) for r in own.orderBy("item_id", "text").collect()]), min_score)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("a"), "last_word")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", (-F.col("best.a")).alias("first_word"), "best.last_word")


def _block(texts: DataFrame, items: Items, min_score: float) -> DataFrame:
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    if not len(items.seed):
        return texts.sparkSession.createDataFrame([], schema)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "score", "first_word", "last_word")}
        for doc_id, item, first, words in zip(*(c.to_pylist() for c in batch.columns)):
            text, query = np.array(words, dtype=np.int64).view(np.uint64), items.words[item]
            best, end = align(text, query)
            score = best / (MATCH * len(query))
            if score >= min_score:
                _, back = align(text[:end][::-1], query[::-1])
                for k, v in zip(out, (doc_id, items.ids[item], score, first + end - back, first + end - 1)):
                    out[k].append(v)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    return map_batches(_passages(texts, items, min_score), each, schema)
