"""Quality rules: word and line counts, then a linear-chain CRF over the lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm.text import Piece, map_batches, ngrams, pieces, prefix_hash, span_hash

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_SHARE, MIN_CONTENT_SHARE = 50, 0.5, 0.5
SYMBOLS = b"#*$%&|<>"

#: The CRF's parameters: weights of a line's features for `content` against `boilerplate`,
#: and the score of staying in a label or changing it from one line to the next.
EMISSION = {"bias": 1.6, "symbols_per_word": -4.0, "pipes_per_word": -4.0, "bangs_per_word": -2.5, "upper_share": -3.0, "digit_share": -4.0, "seen_before": -2.5, "ends_sentence": 0.7, "few_words": -0.6, "long_words": -1.5}
STAY, CHANGE = 0.5, -0.5

_CLASSES = np.zeros((256, 6), dtype=np.int32)
_CLASSES[list(SYMBOLS), 0] = 1
_CLASSES[ord("|"), 1] = 1
_CLASSES[ord("!"), 2] = 1
_CLASSES[0x41:0x5B, 3] = 1
_CLASSES[0x30:0x3A, 4] = 1
_CLASSES[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)], 5] = 1


def viterbi(content: np.ndarray, stay: float = STAY, change: float = CHANGE) -> np.ndarray:
    """Best labelling of one text's lines: True is content. `content` is each line's emission score for content, against 0."""
    n = len(content)
    back = np.zeros((n, 2), dtype=np.int8)
    bad, good = 0.0, float(content[0])
    for i, x in enumerate(content.tolist()[1:], 1):
        from_bad, from_good = bad + change, good + stay
        back[i, 1] = from_good >= from_bad
        best_good = max(from_good, from_bad) + x
        from_bad, from_good = bad + stay, good + change
        back[i, 0] = from_good > from_bad
        bad, good = max(from_bad, from_good), best_good
    labels = np.zeros(n, dtype=bool)
    at = int(good >= bad)
    for i in range(n - 1, -1, -1):
        labels[i] = at
        at = int(back[i, at])
    return labels


def _lines(piece: Piece, word_start: np.ndarray) -> dict[str, np.ndarray]:
    """Lines with at least one word: text number, words, counts of each byte class, hash, whether an equal line came before in the text."""
    end = np.flatnonzero(piece.data == 0x0A)
    start = np.concatenate([[0], end[:-1] + 1])
    words = np.searchsorted(word_start, end) - np.searchsorted(word_start, start)
    has = words > 0
    start, end, words = start[has], end[has], words[has]
    doc = np.searchsorted(piece.end, start, side="left")
    counts = np.zeros((len(start), _CLASSES.shape[1]), dtype=np.int64)
    for k in range(_CLASSES.shape[1]):
        run = np.concatenate([[0], np.cumsum(_CLASSES[piece.data, k], dtype=np.int64)])
        counts[:, k] = run[end] - run[start]
    h = span_hash(prefix_hash(piece.data), start, end)
    order = np.lexsort((np.arange(len(h)), h, doc))
    seen = np.zeros(len(h), dtype=bool)
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    seen[order[1:][same]] = True
    last = piece.data[np.maximum(end - 1, 0)]
    return {"doc": doc, "words": words, "chars": end - start, "counts": counts, "seen": seen, "stop": np.isin(last, list(b".?:;\"')"))}


def emissions(lines: dict[str, np.ndarray]) -> np.ndarray:
    """Each line's score for content."""
    words, letters = lines["words"].astype(float), np.maximum(lines["counts"][:, 5], 1)
    c = lines["counts"]
    features = {
        "bias": np.ones(len(words)), "symbols_per_word": np.minimum(c[:, 0] / words, 3), "pipes_per_word": np.minimum(c[:, 1] / words, 1), "bangs_per_word": np.minimum(c[:, 2] / words, 2), "upper_share": c[:, 3] / letters,
        "digit_share": c[:, 4] / np.maximum(lines["chars"], 1), "seen_before": lines["seen"], "ends_sentence": lines["stop"], "few_words": words < 4, "long_words": lines["chars"] / words > 30,
    }
    return sum(EMISSION[k] * v for k, v in features.items())


def measure(piece: Piece) -> dict[str, np.ndarray]:
    """The base counts, and the share of words in content lines, of each text of a piece."""
    n = len(piece)
    start, end, doc = piece.words()
    lead = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80, dtype=np.int64)])
    symbol = np.concatenate([[0], np.cumsum(_CLASSES[piece.data, 0], dtype=np.int64)])
    h, at = ngrams(span_hash(prefix_hash(piece.data), start, end), doc, 3)
    owner = doc[at]
    order = np.lexsort((h, owner))
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(start), dtype=bool)
    for k in range(3):
        covered[at[twice] + k] = True
    lines = _lines(piece, start)
    out = {
        "n_words": np.bincount(doc, minlength=n), "word_chars": np.bincount(doc, weights=lead[end] - lead[start], minlength=n).astype(np.int64), "n_symbols": symbol[piece.end] - symbol[piece.start],
        "n_dup_lines": np.bincount(lines["doc"], weights=lines["seen"], minlength=n).astype(np.int64), "n_repeat_words": np.bincount(doc, weights=covered, minlength=n).astype(np.int64),
    }
    scores, share = emissions(lines), np.zeros(n)
    bounds = np.searchsorted(lines["doc"], np.arange(n + 1))
    for i in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[i], bounds[i + 1]
        words = lines["words"][a:b]
        share[i] = words[viterbi(scores[a:b])].sum() / words.sum()
    return out | {"content_share": share}


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS, min_content: float = MIN_CONTENT_SHARE) -> DataFrame:
    """documents -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept.

    A text fails the base rules if it has few words or if most of its words lie in repeated
    three-word windows. Otherwise the CRF labels its lines (those with a word), and it is kept
    if content lines hold at least `min_content` of its words. Null or empty texts have zero counts and fail.
    One row per row of documents, over its whole text, in one pass without a shuffle. Extra columns are not read.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0)
        for piece in pieces(batch.column(1)):
            m = measure(piece)
            failed = (m["n_words"] < min_words) | (m["n_repeat_words"] > MAX_REPEAT_SHARE * m["n_words"])
            kept = ~failed & (m["content_share"] >= min_content)
            yield pa.RecordBatch.from_arrays([ids.slice(piece.first, len(piece)), *[pa.array(m[k], pa.int64()) for k in names], pa.array(failed), pa.array(m["content_share"]), pa.array(kept)], ["doc_id", *names, "base_failed", "content_share", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, content_share double, kept boolean"
    return map_batches(rows, each, schema)
