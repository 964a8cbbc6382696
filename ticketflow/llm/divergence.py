"""Source divergence audit: how far the sources of a language differ in their use of terms.

Counts are gathered by map-side sums and one shuffle. The terms of a language are dealt into buckets, and in
each bucket every source's counts are a segment tree over the terms' places. Equal subtrees are one node,
whatever source they come from, and two trees are compared by going down both at once; a pair of nodes that comes
up again, in the same or in another pair of sources of the same sizes, is priced once. A task holds two blocks of
sources in one bucket, so that its size depends neither on the number of sources nor on that of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.llm.terms import any_letters, held, runs, term_array
from ticketflow.llm.text import cut, join_hint, map_iter, pieces

SCALE, PRIOR = 1_000_000_000, 5
#: Terms of a bucket (about), and sources of a block.
BUCKET, BLOCK = 1024, 64
#: A count and a place in one number: more places than a bucket can have.
PLACES = 1 << 16


def term_counts(docs: DataFrame) -> DataFrame:
    """(text, lang, source) -> lang, source, term, n (occurrences), docs (texts); each group also has a row of the empty term."""

    def counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
        names = dict.fromkeys(zip(langs, sources))
        of = {g: k for k, g in enumerate(names)}
        group = np.fromiter((of[g] for g in zip(langs, sources)), dtype=np.int64, count=batch.num_rows)
        terms, doc = [], []
        for piece in pieces(batch.column("text"), lower=True, most=batch.column("text").nbytes + 1):
            start, end = runs(any_letters(piece.data))
            terms.append(term_array(piece.data, start, end).dictionary_encode())
            doc.append(piece.first + np.searchsorted(piece.end, start, side="left"))
        for part, owner in zip(terms, doc):
            code, width = part.indices.to_numpy().astype(np.int64), max(1, len(part.dictionary))
            once, times = np.unique(owner * width + code, return_counts=True)
            owner, code = once // width, once % width
            key, at = np.unique(group[owner] * width + code, return_inverse=True)
            n, texts = np.bincount(at, weights=times, minlength=len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
            yield rows(list(names), key // width, part.dictionary.take(pa.array(key % width)).cast(pa.large_string()), n, texts)
        none = np.zeros(len(names), dtype=np.int64)
        yield rows(list(names), np.arange(len(names)), pa.array([""] * len(names), pa.large_string()), none, none)

    def rows(names: list, group: np.ndarray, term: pa.Array, n: np.ndarray, texts: np.ndarray) -> pa.RecordBatch:
        lang, source = (pa.array([x[k] for x in names], pa.string()).take(pa.array(group)) for k in (0, 1))
        return pa.RecordBatch.from_arrays([lang, source, term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(texts, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(batches):
            for out in counted(batch):
                for at in range(0, out.num_rows, 50_000):
                    yield out.slice(at, 50_000)

    found = map_iter(docs, run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + PRIOR) / d), exact for d below 9e15: the quotient is built three digits at a time."""
    whole, rest = np.divmod(n + PRIOR, d)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, d)
        whole = whole * 1000 + digit
    return whole + 1


def share_column(n: Column, d: Column) -> Column:
    """`share` of two columns."""
    return F.call_function("div", (n.cast("decimal(28,0)") + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), d.cast("decimal(28,0)")) + 1


class Forest:
    """Segment trees over rows of counts, equal subtrees stored once; -1 marks places without a term."""

    def __init__(self, counts: np.ndarray):
        width = 1 << max(0, counts.shape[1] - 1).bit_length()
        padded = np.full((len(counts), width), -1, dtype=np.int64)
        padded[:, : counts.shape[1]] = counts
        self.leaf, ids = np.unique(padded, return_inverse=True)
        ids = ids.reshape(padded.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while ids.shape[1] > 1:
            base = int(ids.max()) + 1
            node, at = np.unique(ids[:, 0::2] * base + ids[:, 1::2], return_inverse=True)
            self.levels.append((node // base, node % base))
            ids = at.reshape(len(ids), -1)
        self.root = ids[:, 0]

    def distances(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Sum over places of the difference of shares, for pairs (a, b) of rows whose shares have denominators d."""
        kinds, kind = np.unique(np.stack([d[a], d[b]], axis=1), axis=0, return_inverse=True)
        kind, left, right = kind.ravel(), self.root[a], self.root[b]
        met = []
        for lo, hi in [*reversed(self.levels), (None, None)]:
            base = int(max(left.max(initial=0), right.max(initial=0))) + 1
            pair, at = np.unique((kind * base + left) * base + right, return_inverse=True)
            met.append(at.ravel())
            kind, left, right = pair // (base * base), pair // base % base, pair % base
            if lo is not None:
                kind, left, right = np.concatenate([kind, kind]), np.concatenate([lo[left], hi[left]]), np.concatenate([lo[right], hi[right]])
        x, y = self.leaf[left], self.leaf[right]
        price = np.where(x < 0, 0, np.abs(share(np.maximum(x, 0), kinds[kind, 0]) - share(np.maximum(y, 0), kinds[kind, 1])))
        for at in reversed(met):
            price = price[at]
            if at is not met[0]:
                price = price[: len(price) // 2] + price[len(price) // 2 :]
        return price


def _bucket_distances(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Distances of two blocks of sources in one bucket."""
    lang, _, i, j = key
    rows = rows.sort_values("gid").reset_index(drop=True)
    counts = np.zeros((len(rows), int(rows["width"].iloc[0])), dtype=np.int64)
    for k, packed in enumerate(rows["packed"]):
        if packed is not None and len(packed):
            packed = np.asarray(packed, dtype=np.int64)
            counts[k, packed % PLACES] = packed // PLACES
    one, two = np.flatnonzero(rows["block"] == i), np.flatnonzero(rows["block"] == j)
    a, b = np.repeat(one, len(two)), np.tile(two, len(one))
    a, b = a[a < b], b[a < b]
    value = Forest(counts).distances(a, b, rows["d"].to_numpy()) if len(a) else np.zeros(0, np.int64)
    gid = rows["gid"].to_numpy()
    return pd.DataFrame({"lang": lang, "a": gid[a], "b": gid[b], "value": value})


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """documents (text, lang, source) -> lang, source, part, item, value, rank.

    Kept are each language's terms (runs of letters and of all characters above ASCII, A-Z lower-cased) in at least
    `min_docs` of its documents. Part `pair`: the summed difference of shares of kept terms to each other source of the
    language. Part `term`: the `top` terms that the source uses most above its language, by the difference of shares.

    Null text, lang or source count as ''; empty and blank texts give their group without terms, whose shares are all the
    same; languages without kept terms have pairs of value 0. Very long texts are counted whole. Repeated rows count as
    often as they occur, ties go by item. An empty table gives no rows. Other columns are not read.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = cut(term_counts(texts))
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = cut(kept.drop("docs"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    langs = cut(counts.filter("term = ''").select("lang").distinct().join(sizes.hint("merge"), "lang", "left").na.fill(0).withColumn("buckets", F.ceil(F.col("v") / BUCKET)))
    hint = join_hint(langs)
    dealt = kept.join(langs.select("lang", "buckets").hint(hint), "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")))
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("term")) - 1).select("lang", "term", "total", "bucket", "place")
    rows = cut(counts.filter("n > 0").select("lang", "source", "term", "n").join(placed.hint("merge"), ["lang", "term"]))
    group_n = rows.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.filter("term = ''").select("lang", "source").join(group_n.hint("merge"), ["lang", "source"], "left").na.fill(0, ["group_n"]).join(langs.hint(hint), "lang")
    gid = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = cut(groups.select("lang", "source", (F.col("group_n") + PRIOR * F.col("v")).alias("d"), (F.col("lang_n") + PRIOR * F.col("v")).alias("lang_d"), gid.cast("long").alias("gid")).withColumn("block", F.floor(F.col("gid") / BLOCK)))
    few = groups.hint(join_hint(groups))

    over = rows.join(few, ["lang", "source"]).withColumn("value", share_column(F.col("n"), F.col("d")) - share_column(F.col("total"), F.col("lang_d"))).filter("value > 0")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    packed = rows.groupBy("lang", "bucket", "source").agg(F.collect_list(F.col("n") * PLACES + F.col("place")).alias("packed"))
    widths = rows.groupBy("lang", "bucket").agg((F.max("place") + 1).alias("width"))
    every = cut(widths).hint("merge").join(few, "lang").join(packed.hint("merge"), ["lang", "bucket", "source"], "left")
    blocks = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    paired = every.join(blocks.hint(hint), "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = paired.select("lang", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "gid", "block", "d", "width", "packed")
    parts = paired.groupBy("lang", "bucket", "i", "j").applyInPandas(_bucket_distances, "lang string, a long, b long, value long")
    half = cut(parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    others = groups.select("lang", F.col("gid").alias("b"), F.col("source").alias("item"))
    pairs = groups.select("lang", "source", F.col("gid").alias("a")).hint("merge").join(others, "lang").filter("a <> b").join(both.hint("merge"), ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")).withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(terms)


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS row_no, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
 words AS (SELECT row_no, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM docs),
 kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT row_no) >= 30),
 langs AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(k.total), 0) AS n FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang),
 found AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
 groups AS (SELECT g.lang, g.source, coalesce(sum(f.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source GROUP BY ALL),
 shares AS (SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(f.n, 0) + 5)) // (g.n + 5 * l.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n + 5 * l.v)::HUGEINT AS q
   FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
 far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
 terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 50
"""
