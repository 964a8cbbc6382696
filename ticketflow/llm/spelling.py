"""Spelling variants: words one edit apart, through a variable-length gram index.

Grams of 2 to 5 characters are counted over all words, and only frequent ones enter the dictionary. A word is decomposed from
its start, and again from its end, into the shortest grams that are not frequent, so common grams are always extended. As a gram
depends on its own characters alone, an edit affects no gram before it in the one decomposition and none after it in the other. For each place
that an edit can have, the word is in the list of all that its unaffected grams cover, on the side where that is more; two words one
edit apart meet in the list of that place. Words that meet are verified; a long list is cut by what is left of its
words when a character at one of its places is taken out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm.terms import held, latin_letters, runs, term_array
from ticketflow.llm.text import cut, join_hint, map_batches, map_iter, mix, pieces, powers, span_hash

#: Shortest and longest gram.
SHORT, LONG = 2, 5
#: A gram is frequent in more words than this, or more where the dictionary of frequent grams would pass its bound.
FREQUENT, DICTIONARY = 32, 500_000
#: A list with more words is cut.
LIST = 64
#: Runs of more bytes are hashed one by one.
SLOT = 64

def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


_CRC = _crc_table()


def crc_after(before: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of what `before` is the crc32 of, followed by a slice, for many slices."""
    order = np.argsort(start - end, kind="stable")
    size, at = (end - start)[order], start[order]
    state = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-size, -SLOT, side="left"))
    done = state.copy()
    for k in range(long):
        done[k] = zlib.crc32(data[at[k] : at[k] + size[k]].tobytes(), int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for j in range(int(size[long]) if long < len(size) else 0):
        n = int(np.searchsorted(-size, -j, side="left"))
        part = done[long:n]
        done[long:n] = _CRC[(part ^ data[at[long:n] + j]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    out = np.empty_like(done)
    out[order] = done ^ np.uint32(0xFFFFFFFF)
    return out


def word_counts(docs: DataFrame, every: int = 31, shortest: int = 7) -> DataFrame:
    """(doc_id, text) -> word, n: runs of letters, A-Z lower-cased, of `shortest` characters or more. Where the crc32 of `<doc_id>:<run>` is divisible by `every`, the run loses one character."""

    def counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        before = np.fromiter((zlib.crc32(f"{x or ''}:".encode()) for x in batch.column("doc_id").to_pylist()), dtype=np.uint32, count=batch.num_rows)
        for piece in pieces(batch.column("text"), lower=True, most=batch.column("text").nbytes + 1):
            start, end = runs(latin_letters(piece.data))
            if not len(start):
                continue
            inner = np.zeros(len(piece.data) + 1, dtype=np.int32)
            np.cumsum((piece.data & 0xC0) == 0x80, out=inner[1:], dtype=np.int32)
            size = end - start - (inner[end] - inner[start])
            far = size >= shortest
            start, end, size = start[far], end[far], size[far]
            if not len(start):
                continue
            crc = crc_after(before[piece.first + np.searchsorted(piece.end, start, side="left")], piece.data, start, end)
            hit = crc % np.uint32(every) == 0
            words = [term_array(piece.data, start[~hit], end[~hit])]
            short = []
            for a, b, n, h in zip(*(x[hit & (size > shortest)].tolist() for x in (start, end, size, crc))):
                run = piece.data[a:b].tobytes().decode()
                short.append((run[: h % n] + run[h % n + 1 :]).encode())
            words.append(pa.array(short, pa.large_binary()))
            n = pc.value_counts(pa.chunked_array(words))
            yield pa.RecordBatch.from_arrays([n.field("values").cast(pa.large_string()).cast(pa.string()), n.field("counts")], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(batches):
            for out in counted(batch):
                for at in range(0, out.num_rows, 50_000):
                    yield out.slice(at, 50_000)

    return map_iter(docs, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Grams:
    """The padded words of a batch side by side: which start in which, and hashes of their slices."""

    def __init__(self, words: list[str]):
        flat = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        size = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
        self.stop = np.cumsum(size)
        self.begin = self.stop - size
        self.word = np.repeat(np.arange(len(words)), size)
        self.room = np.repeat(self.stop, size) - np.arange(len(flat))
        up, _ = powers(len(flat))
        self.run = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum(mix(flat + np.uint64(1)) * up[: len(flat)], out=self.run[1:])

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each gram of n characters."""
        at = np.flatnonzero(self.room >= n)
        return at, span_hash(self.run, at, at + n)

    def marks(self, frequent: np.ndarray, back: bool) -> np.ndarray:
        """Where grams meet when each word is decomposed from its start, or `back` from its end."""
        at = np.arange(len(self.word) + 1)
        size = np.zeros(len(at), dtype=np.int64)
        room = np.append(0, at[:-1] - self.begin[self.word] + 1) if back else np.append(self.room, 0)
        common = np.ones(len(at), dtype=bool)
        for n in range(SHORT, LONG + 1):
            open_ = np.flatnonzero(common & (room >= n))
            h = span_hash(self.run, open_ - n, open_) if back else span_hash(self.run, open_, open_ + n)
            size[open_] = n
            common[open_] = np.isin(h, frequent)
        size[common & (size < LONG)] = 0  # the rest of a word is no gram
        mark = np.zeros(len(at), dtype=bool)
        now = self.stop if back else self.begin
        while len(now := now[size[now] > 0]):
            now = now - size[now] if back else now + size[now]
            mark[now] = True
        return mark

    def lists(self, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
        """Key, word, first and last place of an edit (in the padded word) of each list that a word is in."""
        size = self.stop - self.begin
        half = (size - 1) // 2
        out = []
        for back in (False, True):
            mark, index = self.marks(frequent, back), np.arange(len(self.word) + 1)
            # where what is kept ends (or, back, begins): the last mark before a place, the place itself where there is none
            low, high = (self.begin + 1, self.stop - half) if back else (self.begin + half, self.stop - 1)
            place = np.repeat(low - np.cumsum(high - low + 1) + (high - low + 1), high - low + 1) + np.arange((high - low + 1).sum())
            word = np.repeat(np.arange(len(size)), high - low + 1)
            if back:
                edge = np.minimum.accumulate(np.where(mark, index, len(index))[::-1])[::-1][place]
                edge = np.where(edge < self.stop[word], edge, place)
            else:
                edge = np.maximum.accumulate(np.where(mark, index, -1))[place]
                edge = np.where(edge > self.begin[word], edge, place)
            new = np.ones(len(edge), dtype=bool)
            new[1:] = (edge[1:] != edge[:-1]) | (word[1:] != word[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(edge)) - 1
            of, edge = word[first], edge[first]
            key = span_hash(self.run, edge, self.stop[of]) ^ np.uint64(2) if back else span_hash(self.run, self.begin[of], edge) ^ np.uint64(1)
            out.append((mix(key), of, place[first] - self.begin[of] - back, place[last] - self.begin[of] - back))
        return tuple(np.concatenate(x) for x in zip(*out))


def _frequent(words: DataFrame) -> np.ndarray:
    """Hashes of frequent grams, sorted; at most DICTIONARY, as each is in more than a DICTIONARY-th of all (word, gram) pairs."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        grams = Grams(batch.column("word").to_pylist())
        for n in range(SHORT, LONG + 1):
            at, h = grams.of(n)
            order = np.lexsort((h, grams.word[at]))
            h, of = h[order], grams.word[at][order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            gram, count = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(count, pa.int64())], ["gram", "n"])

    counts = cut(map_batches(words.select("word"), each, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > FREQUENT))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = counts.filter(F.col("n") > max(FREQUENT, total // DICTIONARY)).select("gram").toArrow().column("gram")
    return np.sort(held.to_numpy().view(np.uint64))


def _indexed(words: DataFrame, frequent: np.ndarray) -> DataFrame:
    """word, n -> key, low, high, word, n: a row for each list that a word is in, with the places of an edit that it is for."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, of, low, high = Grams(batch.column("word").to_pylist()).lists(frequent)
        for k in range(0, len(key), 50_000):
            some = pa.array(of[k : k + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 50_000].view(np.int64)), pa.array(low[k : k + 50_000], pa.int32()), pa.array(high[k : k + 50_000], pa.int32()), batch.column("word").take(some), batch.column("n").take(some)], ["key", "low", "high", "word", "n"])

    return map_batches(words.select("word", "n"), each, "key long, low int, high int, word string, n long")


def _cut_lists(rows: DataFrame) -> DataFrame:
    """Rows of long lists -> key, word, n: words one edit apart share what is left, whole or without the character at the edit's place."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, owner = [], []
        for k, (key, low, high, word) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high", "word")))):
            padded = f"^{word}$"
            for form in {padded} | {padded[:j] + padded[j + 1 :] for j in range(low, high + 1)}:
                keys.append(f"{key}:{form}")
                owner.append(k)
        for k in range(0, len(keys), 50_000):
            some = pa.array(owner[k : k + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 50_000], pa.string()), batch.column("word").take(some), batch.column("n").take(some)], ["key", "word", "n"])

    return map_batches(rows.select("key", "low", "high", "word", "n"), each, "key string, word string, n long").withColumn("key", F.xxhash64("key"))


def _met(rows: DataFrame) -> DataFrame:
    """Pairs of words of one list that are one edit apart -> a, n_a, b, n_b with a before b."""
    left, right = rows.select("key", F.col("word").alias("a"), F.col("n").alias("n_a")), rows.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    near = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return left.hint("merge").join(right, "key").filter("a < b").filter(near).select("a", "n_a", "b", "n_b")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n), distinct words -> a, n_a, b, n_b: each pair that is one inserted, deleted or replaced character apart, once.

    Lists longer than LIST are cut, so that no list is paired beyond its near words; an empty table gives no pairs.
    """
    index = cut(_indexed(words, _frequent(words)))
    lists = cut(index.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    met = cut(index.join(lists.hint("merge"), "key"))
    return cut(_met(met.filter(F.col("c") <= LIST)).unionByName(_met(_cut_lists(met.filter(F.col("c") > LIST)))).distinct())


def roots(forms: DataFrame, rounds: int = 60) -> DataFrame:
    """(word, form) -> word, root: forms followed to the last. Each round doubles the way; counts grow tenfold a step, so a few rounds do."""
    held = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        ahead = held.select(F.col("word").alias("via"), F.col("root").alias("next"))
        new = cut(held.join(ahead.hint(join_hint(held)), F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        held = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return held
    raise RuntimeError(f"forms did not settle in {rounds} rounds")


def spelling_variants(docs: DataFrame, times: int = 10) -> DataFrame:
    """documents -> word, form, root, n, n_near, form_n, over the runs of A-Z, a-z and U+00C0 to U+00FF of whole texts.

    Words have at least 7 characters and 2 occurrences. A word's form is its most frequent near word (ties: the first in code-point order) if
    that occurs at least `times` as often, its root where forms lead.

    Null and empty texts have no words; a null doc_id is written as nothing in `<doc_id>:<run>`. Very long texts and runs are taken whole; repeated rows
    count as often as they occur. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = cut(word_counts(texts).filter("n >= 2"))
    near = near_words(words)
    both = near.select(F.col("a").alias("near"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(near.select(F.col("b").alias("near"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = cut(both.groupBy("near").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best")))
    rows = words.join(best.hint(join_hint(best, 128)), F.col("word") == F.col("near"), "left")
    has = -F.col("best.m") >= times * F.col("n")
    rows = cut(rows.select("word", F.when(has, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, -F.col("best.m")).alias("form_n")))
    last = roots(rows.filter("form is not null")).select(F.col("word").alias("last_word"), "root")
    return rows.join(last.hint(join_hint(last, 128)), F.col("word") == F.col("last_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
