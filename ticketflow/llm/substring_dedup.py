"""Fuzzy repeated passages: k-mer seeds, collinear chaining through a Fenwick tree, alignment of the chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.llm.text import U64, bitmap_of, cut, join_hint, let_go, map_batches, map_iter, maybe_in, mix, ngrams, pieces, powers

#: Words of a seed, seeds of which the one with the smallest hash counts, cost of a skipped word.
SEED_WORDS, SEED_WINDOW, GAP_COST = 5, 16, 0.05
#: What a passage needs: words and share of equal words.
MIN_WORDS, MIN_IDENTITY = 40, 0.8
#: Of so many neighbouring windows of MIN_WORDS words the one with the smallest hash counts: passages of MIN_WORDS + WINDOW_STEP - 1 words have one.
WINDOW_STEP = 11
#: Words on either side of a seed that are compared before two of its holders are aligned; keys with more holders than FEW find them through shared grams of GRAM words.
REACH, GRAM, FEW = 40, 3, 64
#: Slices of texts for the alignment begin and end at multiples of this many words.
SLICE = 64


def minimizers(h: np.ndarray, doc: np.ndarray, w: int = SEED_WINDOW) -> np.ndarray:
    """Which windows have the smallest hash among some w neighbours of their text (all of a shorter text's)."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    chosen = np.zeros(n, bool)
    cuts = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), n)
    short = np.diff(cuts) < w
    for a, b in zip(cuts[:-1][short], cuts[1:][short]):
        chosen[a + int(h[a:b].argmin())] = True
    if n >= w:
        view = np.lib.stride_tricks.sliding_window_view(h, w)
        step = 1 << 16
        for a in range(0, len(view), step):
            at = np.arange(a, min(a + step, len(view)))
            same = doc[at] == doc[at + w - 1]
            at = at[same]
            chosen[at + view[at].argmin(axis=1)] = True
    return np.flatnonzero(chosen)


def seeds(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, hash, pos: arrays of each text's seeds; of equal seeds the first."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batch.column(1), lower=True):
            words, doc = piece.word_hashes()
            h, at = ngrams(words, doc, SEED_WORDS)
            own = minimizers(h, doc[at])
            h, at = h[own], at[own]
            of, first = doc[at], np.searchsorted(doc, np.arange(len(piece)))
            order = np.lexsort((at, h, of))
            h, at, of = h[order], at[order], of[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            h, at, of = h[new], at[new], of[new]
            cuts = pa.array(np.searchsorted(of, np.arange(len(piece) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (h.view(np.int64), (at - first[of]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), *lists], ["doc_id", "hash", "pos"])

    return map_batches(docs, each, "doc_id long, hash array<long>, pos array<int>")


def _window_hashes(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of `size` words that begin at `at`, from one running hash."""
    up, down = powers(len(words))
    run = np.concatenate([[U64(0)], np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return mix((run[at + size] - run[at]) * down[at] + U64(size))


def windows(docs: DataFrame, size: int = MIN_WORDS) -> DataFrame:
    """documents -> doc_id, hash, pos, key: for each text windows of `size` words, by the seed with their smallest hash; of equal windows the first.

    Of WINDOW_STEP neighbours the window with the smallest hash is taken, so that texts which share
    size + WINDOW_STEP - 1 words share a window. A window in two documents has the same smallest seed in both, and `seeds` has it in both.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for piece in pieces(batch.column(1), lower=True):
            words, doc = piece.word_hashes()
            if len(words) < size:
                continue
            at = np.flatnonzero(doc[: len(words) - size + 1] == doc[size - 1 :])
            key = _window_hashes(words, at, size)
            own = minimizers(key, doc[at], WINDOW_STEP)
            key, at = key[own], at[own]
            if not len(key):
                continue
            h, starts = ngrams(words, doc, SEED_WORDS)
            low = np.lib.stride_tricks.sliding_window_view(h, size - SEED_WORDS + 1)[np.searchsorted(starts, at)].min(axis=1)
            of = doc[at]
            order = np.lexsort((at, key, of))
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (of[order][1:] != of[order][:-1])
            own = order[new]
            own = own[np.lexsort((at[own], low[own], of[own]))]
            key, at, low, of = key[own], at[own], low[own], of[own]
            begins = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (of[1:] != of[:-1])))
            cuts = pa.array(np.append(begins, len(own)), pa.int32())
            pos = (at - np.searchsorted(doc, of)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (pos, key.view(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(ids[piece.first + of[begins]], pa.int64()), pa.array(low[begins].view(np.int64)), *lists], ["doc_id", "hash", "pos", "key"])

    return map_batches(docs, each, "doc_id long, hash long, pos array<int>, key array<long>")


def _first_holders(each: DataFrame, key: str) -> DataFrame:
    """(doc_id, key, pos) -> key, center, pos_c: the first document of each key that several have."""
    first = each.groupBy(key).agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.max("doc_id").alias("last")).filter("at.doc_id < last")
    return cut(first.select(key, F.col("at.doc_id").alias("center"), F.col("at.pos").alias("pos_c")))


def _matches(each: DataFrame, first: DataFrame, key: str, size: int) -> DataFrame:
    """(doc_id, key, pos) and first holders -> center, doc_id, pos_c, pos, size. First holders grow with the data, so they are joined by shuffle at any size."""
    rows = each.join(first.hint("merge"), key).filter("doc_id <> center")
    return rows.select("center", "doc_id", "pos_c", "pos", F.lit(size).alias("size"))


def chain(a: list[int], b: list[int], k: int = SEED_WORDS, gap: float = GAP_COST) -> list[list[int]]:
    """Collinear chains of the matches (a[i], b[i]), which come by a, then b: lists of match numbers.

    A chain's score is k for each match less `gap` for each word skipped on either side. As
    that cost is linear, the best predecessor is the largest score + gap * (a + b) among the matches
    before i on both sides; a Fenwick tree over the ranks of b has it in logarithmic time.
    A match without a predecessor that pays begins a chain. Chains are taken best first, and each match is in
    one: a branch that leaves a better chain is a chain of its own.
    """
    rank = {v: r + 1 for r, v in enumerate(sorted(set(b)))}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(rank) + 1)
    score, parent, root = [0.0] * len(a), [-1] * len(a), list(range(len(a)))
    i, n = 0, len(a)
    while i < n:
        j = i
        while j < n and a[j] == a[i]:  # matches of one position don't precede each other
            r, best = rank[b[j]] - 1, (-1e18, -1)
            while r > 0:
                if tree[r] > best:
                    best = tree[r]
                r -= r & -r
            gain = best[0] - gap * (a[j] + b[j] - 2 * k)
            if best[1] >= 0 and gain > 0:
                p = best[1]
                score[j], parent[j], root[j] = gain + min(k, a[j] - a[p], b[j] - b[p]), p, root[p]
            else:
                score[j] = float(k)
            j += 1
        for m in range(i, j):
            entry, r = (score[m] + gap * (a[m] + b[m]), m), rank[b[m]]
            while r < len(tree):
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
        i = j
    out, used = [], [False] * n
    for m in sorted(range(n), key=lambda m: (-score[m], m)):
        path = []
        while m >= 0 and not used[m]:
            used[m] = True
            path.append(m)
            m = parent[m]
        if path:
            out.append(path[::-1])
    return out


def seeds_of(matches: list[tuple[int, int, int]], k: int = SEED_WORDS, step: int = 32) -> list[tuple[int, int]]:
    """Sorted matches (a, b, words) -> matches of k words: long ones that overlap on a diagonal become the first and last k words of their union, and some between."""
    out, runs = set(), {}
    for a, b, size in matches:
        if size == k:
            out.add((a, b))
        else:
            runs.setdefault(b - a, []).append((a, a + size))
    for shift, spans in runs.items():
        at, end = spans[0]
        for begin, stop in [*spans[1:], (1 << 60, 0)]:
            if begin <= end:
                end = max(end, stop)
                continue
            out.update((x, x + shift) for x in [*range(at, end - k, step), end - k])
            at, end = begin, stop
    return sorted(out)


def _chains(matches: DataFrame) -> DataFrame:
    """(center, doc_id, pos_c, pos, size) -> center, doc_id, a, b: the positions of each chain's matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []
        out: dict[str, list] = {k: [] for k in ("center", "doc_id", "a", "b")}

        def close() -> None:
            if of is None or max(x[0] + x[2] for x in held) - held[0][0] < MIN_WORDS // 4:
                return
            a, b = map(list, zip(*seeds_of(held)))
            for path in chain(a, b):
                first, last = path[0], path[-1]
                if max(a[last] - a[first], b[last] - b[first]) + SEED_WORDS >= MIN_WORDS // 4:
                    out["center"].append(of[0])
                    out["doc_id"].append(of[1])
                    out["a"].append([a[m] for m in path])
                    out["b"].append([b[m] for m in path])

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))
            for v in out.values():
                v.clear()
            return batch

        for batch in batches:
            for center, doc, *match in zip(*(c.to_pylist() for c in batch.columns)):
                if of != (center, doc):
                    close()
                    of, held = (center, doc), []
                held.append(tuple(match))
            if out["center"]:
                yield flush()
        close()
        yield flush()

    rows = matches.select("center", "doc_id", "pos_c", "pos", "size").repartition("center", "doc_id").sortWithinPartitions("center", "doc_id", "pos_c", "pos")
    return map_iter(rows, run, "center long, doc_id long, a array<int>, b array<int>")


def _slices(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, lo, hi) -> w_id, lo, hi, words: hashes of those words of the texts."""
    lists = cut(wanted.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("parts")).withColumnRenamed("doc_id", "p_id"))
    texts = docs.join(lists.select("p_id").hint(join_hint(lists)), F.col("doc_id") == F.col("p_id"), "left_semi").dropDuplicates(["doc_id"])
    rows = texts.join(lists.hint("merge"), F.col("doc_id") == F.col("p_id")).select("doc_id", "text", "parts")

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, parts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for piece in pieces(batch.column(1), lower=True):
            words, doc = piece.word_hashes()
            words = (words & U64(0x7FFFFFFF)).astype(np.int32)
            cuts = np.searchsorted(doc, np.arange(len(piece) + 1))
            out = [(ids[piece.first + i], p["lo"], p["hi"], words[cuts[i] + p["lo"] : min(cuts[i + 1], cuts[i] + p["hi"])]) for i in range(len(piece)) for p in parts[piece.first + i]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.list_(pa.int32()))], ["w_id", "lo", "hi", "words"])

    return cut(map_batches(rows, each, "w_id long, lo int, hi int, words array<int>"))


def _extend(x: np.ndarray, y: np.ndarray, drop: int = 12) -> tuple[int, int]:
    """Ungapped extension from the start of x and y: words taken and how many are equal; ends where the score falls by `drop`."""
    n = min(len(x), len(y))
    if not n:
        return 0, 0
    equal = x[:n] == y[:n]
    score = np.cumsum(np.where(equal, 1, -2))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score >= drop)
    if len(fallen):
        score, equal = score[: fallen[0]], equal[: fallen[0]]
    if not len(score) or score.max() <= 0:
        return 0, 0
    take = int(score.argmax()) + 1
    return take, int(equal[:take].sum())


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Words of x and y that an alignment makes equal: at equal length those in equal places, else the longest common subsequence."""
    if len(x) == len(y):
        return int((x == y).sum())
    if len(x) > len(y):
        x, y = y, x
    x = x[np.isin(x, y)]  # others have no part in it
    row = np.zeros(len(y) + 1, dtype=np.int32)
    for w in x:
        new = row.copy()
        np.maximum(row[:-1] + (y == w), row[1:], out=new[1:])
        row = np.maximum.accumulate(new)
    return int(row[-1])


def align_chain(a: list[int], b: list[int], x: np.ndarray, y: np.ndarray, k: int = SEED_WORDS) -> tuple[int, int, int, int, int]:
    """A chain's passage in both word sequences: (from, to) in x, (from, to) in y, number of equal words."""
    back, equal_back = _extend(x[: a[0]][::-1], y[: b[0]][::-1])
    ahead, equal_ahead = _extend(x[a[-1] + k :], y[b[-1] + k :])
    equal, end_a, end_b = k, a[0] + k, b[0] + k
    for p, q in zip(a[1:], b[1:]):
        if p < end_a or q < end_b:  # seeds overlap
            new = max(0, min(p + k - end_a, q + k - end_b))
            equal += new
        else:
            equal += _common(x[end_a:p], y[end_b:q]) + k
        end_a, end_b = max(end_a, p + k), max(end_b, q + k)
    return a[0] - back, end_a + ahead, b[0] - back, end_b + ahead, equal + equal_back + equal_ahead


def _units(a: list[int], b: list[int], x: np.ndarray, y: np.ndarray, k: int = SEED_WORDS) -> list[list[int]]:
    """A chain cut where its alignment worsens: (from, to) in x, (from, to) in y, equal words, 1 where a part may begin or end.

    Seeds and what extends them without a gap may; what remains of the gaps between may not.
    """
    back, equal_back = _extend(x[: a[0]][::-1], y[: b[0]][::-1])
    ahead, equal_ahead = _extend(x[a[-1] + k :], y[b[-1] + k :])
    out: list[list[int]] = []

    def add(end_a: int, end_b: int, equal: int, outer: int) -> None:
        p, q = (out[-1][1], out[-1][3]) if out else (a[0] - back, b[0] - back)
        if end_a == p and end_b == q:
            return
        whole = equal == end_a - p == end_b - q
        if whole and out and out[-1][5] and out[-1][4] == out[-1][1] - out[-1][0] == out[-1][3] - out[-1][2]:
            out[-1][1], out[-1][3], out[-1][4] = end_a, end_b, out[-1][4] + equal
        else:
            out.append([p, end_a, q, end_b, equal, outer])

    add(a[0], b[0], equal_back, 1)
    end_a, end_b = a[0] + k, b[0] + k
    add(end_a, end_b, k, 1)
    for p, q in zip(a[1:], b[1:]):
        if p < end_a or q < end_b:  # seeds overlap
            equal = max(0, min(p + k - end_a, q + k - end_b))
            end_a, end_b = max(end_a, p + k), max(end_b, q + k)
            add(end_a, end_b, equal, 1)
            continue
        left, equal_left = _extend(x[end_a:p], y[end_b:q])
        right, equal_right = _extend(x[end_a + left : p][::-1], y[end_b + left : q][::-1])
        add(end_a + left, end_b + left, equal_left, 1)
        add(p - right, q - right, _common(x[end_a + left : p - right], y[end_b + left : q - right]), 0)
        add(p, q, equal_right, 1)
        end_a, end_b = p + k, q + k
        add(end_a, end_b, k, 1)
    add(end_a + ahead, end_b + ahead, equal_ahead, 1)
    return out


def align_parts(a: list[int], b: list[int], x: np.ndarray, y: np.ndarray, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> list[tuple[int, int, int, int, int]]:
    """The passages of a chain: all of it where it is equal enough, else its longest part that is, and so on left and right of that."""
    p, q, r, s, equal = align_chain(a, b, x, y)
    if min(q - p, s - r) >= min_words and equal >= min_identity * max(q - p, s - r):
        return [(p, q, r, s, equal)]
    u = np.array(_units(a, b, x, y), dtype=np.int64)
    total = np.append(0, np.cumsum(u[:, 4]))
    out, todo = [], [(0, len(u))]
    while todo:
        lo, hi = todo.pop()
        best, at = 0, (0, 0)
        for i in range(lo, hi):
            in_x, in_y = u[i:hi, 1] - u[i, 0], u[i:hi, 3] - u[i, 2]
            if min(in_x[-1], in_y[-1]) < min_words:
                break
            size = np.maximum(in_x, in_y)
            if not u[i, 5] or size[-1] <= best:
                continue
            fine = (u[i:hi, 5] == 1) & (np.minimum(in_x, in_y) >= min_words) & (total[i + 1 : hi + 1] - total[i] >= min_identity * size)
            j = np.flatnonzero(fine)
            if len(j) and size[j[-1]] > best:
                best, at = int(size[j[-1]]), (i, i + int(j[-1]) + 1)
        if best:
            i, j = at
            out.append((int(u[i, 0]), int(u[j - 1, 1]), int(u[i, 2]), int(u[j - 1, 3]), int(total[j] - total[i])))
            todo += [(lo, i), (j, hi)]
    return sorted(out)


def _aligned(texts: DataFrame, matches: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """(center, doc_id, pos_c, pos, size) -> the passages of each pair: its chains, aligned on the words of both texts."""
    side = lambda low, high: ((F.floor((low - SLICE) / SLICE).cast("int") * SLICE), (F.floor((high + SEED_WORDS) / SLICE).cast("int") + 2) * SLICE)
    rows = _chains(matches)
    for name in ("a", "b"):
        lo, hi = side(F.col(name)[0], F.element_at(name, -1))
        rows = rows.withColumn(f"lo_{name}", F.greatest(lo, F.lit(0))).withColumn(f"hi_{name}", hi)
    rows = cut(rows)
    wanted = rows.select(F.col("center").alias("doc_id"), F.col("lo_a").alias("lo"), F.col("hi_a").alias("hi")).unionByName(rows.select("doc_id", F.col("lo_b").alias("lo"), F.col("hi_b").alias("hi")))
    words = _slices(texts, wanted)
    for name, key in (("a", "center"), ("b", "doc_id")):
        w = words.select("w_id", F.col("lo").alias("w_lo"), F.col("hi").alias("w_hi"), F.col("words").alias(f"words_{name}")).hint("merge")
        rows = rows.join(w, (F.col(key) == F.col("w_id")) & (F.col(f"lo_{name}") == F.col("w_lo")) & (F.col(f"hi_{name}") == F.col("w_hi"))).drop("w_id", "w_lo", "w_hi")

    def aligned(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "other_id", "first", "last", "other_first", "other_last", "equal", "identity")
        out: dict[str, list] = {k: [] for k in names}
        for center, doc, a, b, lo_a, lo_b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = np.array(x, dtype=np.int32), np.array(y, dtype=np.int32)
            for p, q, r, s, equal in align_parts([v - lo_a for v in a], [v - lo_b for v in b], x, y, min_words, min_identity):
                size = max(q - p, s - r)
                for k, v in zip(names, (doc, center, r + lo_b, s + lo_b - 1, p + lo_a, q + lo_a - 1, equal, equal / size)):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([*[pa.array(out[k], pa.int64()) for k in names[:-1]], pa.array(out["identity"], pa.float64())], list(names))

    rows = rows.select("center", "doc_id", "a", "b", "lo_a", "lo_b", "words_a", "words_b")
    return map_batches(rows, aligned, "doc_id long, other_id long, first long, last long, other_first long, other_last long, equal long, identity double")


def _representatives(each: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, hash, pos) and passages -> doc_id, hash, pos: the holders of a key, one of those whose rows lead to one place of one smaller document.

    A row that covers the key leads to a place of another document. If that document has the key inside the passage, the holder is a member of its class, else
    (its seeds there are others) the first of all holders that are led to the same place stands for them: they are linked through that document.
    """
    spans = found.select(F.col("doc_id").alias("f_doc"), "other_id", F.col("first").alias("f_first"), F.col("last").alias("f_last"), "other_first", "other_last")
    place = F.col("other_first") + F.col("pos") - F.col("f_first")
    inside = cut(each.join(spans.hint(join_hint(spans)), (F.col("doc_id") == F.col("f_doc")) & F.col("pos").between(F.col("f_first"), F.col("f_last"))).select("doc_id", "hash", "other_id", "other_first", "other_last", place.alias("place")))
    others = cut(found.select("other_id").distinct())
    held = each.select(F.col("doc_id").alias("other_id"), "hash", F.col("pos").alias("other_pos")).join(others.hint(join_hint(others)), "other_id", "left_semi")
    members = inside.join(held.hint("merge"), ["other_id", "hash"]).filter("other_pos between other_first and other_last").select("doc_id", "hash").distinct()
    led = inside.groupBy("doc_id", "hash").agg(F.min(F.struct("other_id", "place")).alias("root"))
    rows = each.join(members.hint("merge"), ["doc_id", "hash"], "left_anti").join(led.hint("merge"), ["doc_id", "hash"], "left")
    own = F.coalesce("root", F.struct(F.col("doc_id").alias("other_id"), F.lit(None).cast("long").alias("place")))
    return cut(rows.groupBy("hash", own.alias("root")).agg(F.min(F.struct("doc_id", "pos")).alias("at")).select("at.doc_id", "hash", "at.pos"))


def contexts(docs: DataFrame, wanted: DataFrame, size: int = MIN_WORDS, identity: float = MIN_IDENTITY) -> DataFrame:
    """(doc_id, hash, pos, holders) -> doc_id, hash, holders, grams, paths, whole, marks, ways: what lies round each seed.

    `grams` are hashes of the grams of GRAM words within REACH words of the seed, equal ones told apart by their number; `paths`, in the same order, those of all
    words from the seed to the gram, so that two holders share a path where they are alike from the seed on. For keys with more than FEW holders, `whole` are the windows of
    `size` words that the seed lies in, `marks` the same grams, each with its distance from the seed, and the text's other seeds nearer than 2 * `size` words, and `ways` the
    marks' paths. Of a passage some part of fewer than 2 * `size` words is as equal as the whole, so that in both texts a seed of it has nearly the same distance from
    another: a seed is marked twice, each time with a range of distances, of which texts that are so equal share one.
    """
    drift = int(np.ceil((1 - identity) * 2 * size))
    lists = cut(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("hash", "pos", "holders")).alias("parts")).withColumnRenamed("doc_id", "p_id"))
    texts = docs.join(lists.select("p_id").hint(join_hint(lists)), F.col("doc_id") == F.col("p_id"), "left_semi").dropDuplicates(["doc_id"])
    rows = texts.join(lists.hint("merge"), F.col("doc_id") == F.col("p_id")).select("doc_id", "text", "parts")
    code = lambda h: (h & U64(0x7FFFFFFF)).astype(np.int32)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, parts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for piece in pieces(batch.column(1), lower=True):
            words, doc = piece.word_hashes()
            h, at = ngrams(words, doc, GRAM)
            up, down = powers(len(words))
            run = np.concatenate([[U64(0)], np.cumsum(words * up[: len(words)], dtype=np.uint64)])
            ends = np.searchsorted(doc, np.arange(len(piece) + 1))
            others, where = ngrams(words, doc, SEED_WORDS)
            own = minimizers(others, doc[where])
            own = own[np.lexsort((where[own], others[own], doc[where[own]]))]
            new = np.append(True, (others[own][1:] != others[own][:-1]) | (doc[where[own]][1:] != doc[where[own]][:-1]))[: len(own)]
            own = np.sort(own[new])  # of equal seeds the first, as in `seeds`
            others, where = others[own], where[own]

            def path(x: np.ndarray, k: int, n: int) -> np.ndarray:
                a, b = np.minimum(x, k), np.maximum(x + n, k + SEED_WORDS)
                return code(mix(mix((run[b] - run[a]) * down[a]) + (x - k).astype(np.uint64)))

            out: dict[str, list] = {k: [] for k in ("doc_id", "hash", "holders", "grams", "paths", "whole", "marks", "ways")}
            for i in range(len(piece)):
                for p in parts[piece.first + i]:
                    k = ends[i] + p["pos"]
                    lo, hi = np.searchsorted(at, [max(k - REACH, ends[i]), min(k + SEED_WORDS + REACH - GRAM + 1, ends[i + 1])])
                    g, x = h[lo:hi], at[lo:hi]
                    order = np.lexsort((np.where(x >= k, x - k, REACH + SEED_WORDS + k - x), g))  # equal ones are numbered from the seed to the right, then to the left
                    g, x = g[order], x[order]
                    number = np.arange(len(g)) - np.searchsorted(g, g, side="left")
                    grams, paths = code(mix(g + number.astype(np.uint64))), path(x, k, GRAM)
                    begin = marks = ways = x[:0]
                    if p["holders"] > FEW:
                        begin = np.arange(max(ends[i], k + SEED_WORDS - size), min(k, ends[i + 1] - size) + 1)
                        lo, hi = np.searchsorted(where, [max(k - 2 * size + 1, ends[i]), min(k + 2 * size, ends[i + 1])])
                        at_seed, ranges = path(where[lo:hi], k, SEED_WORDS), [2 * ((where[lo:hi] - k + n) // (2 * drift)) + (n > 0) for n in (0, drift)]
                        marks = np.concatenate([code(mix(mix(g) + (x - k).astype(np.uint64))), *(code(mix(~mix(others[lo:hi]) + r.astype(np.uint64))) for r in ranges)])
                        ways = np.concatenate([paths, at_seed, at_seed])
                    whole = mix((run[begin + size] - run[begin]) * down[begin] + U64(size))
                    for name, v in zip(out, (ids[piece.first + i], p["hash"], p["holders"], grams, paths, whole.view(np.int64), marks, ways)):
                        out[name].append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return map_batches(rows, each, "doc_id long, hash long, holders long, grams array<int>, paths array<int>, whole array<long>, marks array<int>, ways array<int>")


def _apart(rows: DataFrame) -> DataFrame:
    """(hash, mark, way, doc_id) -> hash, a, b: holders with a mark in common that they reach by different ways."""
    by = Window.partitionBy("hash", "mark")
    rows = cut(rows.withColumn("low", F.min("way").over(by)).withColumn("high", F.max("way").over(by)).filter("low < high").drop("low", "high"))
    other = rows.withColumnsRenamed({"doc_id": "b", "way": "other_way"})
    met = rows.withColumnRenamed("doc_id", "a").join(other.hint("merge"), ["hash", "mark"]).filter("way < other_way and a <> b")
    return cut(met.select("hash", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _close_holders(docs: DataFrame, holders: DataFrame, least: int, size: int = MIN_WORDS, identity: float = MIN_IDENTITY) -> DataFrame:
    """(doc_id, hash, pos) -> a, b: holders of one key that can share a passage of `size` words round it.

    These have `least` grams or more in common, and not all of them in the one run of equal words that the seed lies in, unless that run has `size` words: a passage goes on
    beyond a shorter run, and its ends are seeds or extensions, either of which has a gram. So a stock line alone makes no pair.
    Keys with few holders compare all. For the others, stock lines mostly, holders meet by what lies beyond the run that they share: a gram at the same distance, where an
    extension goes on, or another seed at nearly the same distance, where a chain does; those of equal windows of `size` words meet the first of them.
    """
    count = cut(holders.groupBy("hash").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1"))
    wanted = holders.join(count.hint(join_hint(count)), "hash")
    held = cut(contexts(docs, wanted, size, identity).filter(F.size("grams") >= least))
    same, run = F.size(F.array_intersect("grams", "other_grams")), F.size(F.array_intersect("paths", "other_paths"))
    close = (same >= least) & ((same > run) | (run + GRAM - 1 >= size))
    few = held.filter(F.col("holders") <= FEW).select("hash", "doc_id", "grams", "paths").repartition("hash")  # one shuffle serves both sides
    other = {"doc_id": "b", "grams": "other_grams", "paths": "other_paths"}
    pairs = few.withColumnRenamed("doc_id", "a").join(few.withColumnsRenamed(other).hint("merge"), "hash").filter("a < b").filter(close)
    many = held.filter(F.col("holders") > FEW)
    met = _apart(many.select("hash", "doc_id", F.inline(F.arrays_zip("marks", "ways"))).withColumnsRenamed({"marks": "mark", "ways": "way"}))
    side = many.select("hash", "doc_id", "grams", "paths")
    near = met.join(side.withColumnRenamed("doc_id", "a").hint("merge"), ["hash", "a"]).join(side.withColumnsRenamed(other).hint("merge"), ["hash", "b"]).filter(close)
    whole = many.select("hash", F.col("doc_id").alias("b"), F.explode("whole").alias("window"))
    alike = whole.withColumn("a", F.min("b").over(Window.partitionBy("hash", "window"))).filter("a < b")
    return pairs.select("a", "b").unionByName(near.select("a", "b")).unionByName(alike.select("a", "b")).distinct()


def _common_seeds(each: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) -> center, doc_id, pos_c, pos, size: all seeds that both hold."""
    first, last = (cut(pairs.select(c).distinct()) for c in ("a", "b"))
    one = each.select(F.col("doc_id").alias("a"), "hash", F.col("pos").alias("pos_c")).join(first.hint(join_hint(first)), "a", "left_semi")
    two = each.select(F.col("doc_id").alias("b"), "hash", "pos").join(last.hint(join_hint(last)), "b", "left_semi")
    rows = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), ["b", "hash"])
    return rows.select(F.col("a").alias("center"), F.col("b").alias("doc_id"), "pos_c", "pos", F.lit(SEED_WORDS).alias("size"))


def _of_first_holders(texts: DataFrame, min_words: int, min_identity: float) -> tuple[DataFrame, DataFrame]:
    """documents -> doc_id, hash, pos: the seeds that several may have; and the passages that each document shares with the first holders of its seeds and windows."""
    each = cut(seeds(texts)).select("doc_id", F.inline(F.arrays_zip("hash", "pos")))
    first = _first_holders(each, "hash")
    repeated = bitmap_of(first, "hash")
    each = maybe_in(each, "hash", repeated)
    matches = _matches(each, first, "hash", SEED_WORDS)
    if min_words >= SEED_WINDOW + SEED_WORDS - 1:  # each window has a seed of its own
        long = cut(maybe_in(windows(texts, min_words), "hash", repeated).select("doc_id", F.inline(F.arrays_zip("key", "pos"))))
        matches = matches.unionByName(_matches(long, _first_holders(long, "key"), "key", min_words))
    let_go(texts.sparkSession)
    return each, cut(_aligned(texts, matches, min_words, min_identity))


def fuzzy_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """documents -> doc_id, other_id, first, last, other_first, other_last, equal, identity; one row per passage found.

    A passage of doc_id (words first to last, from 0, both included) occurs, exactly or with edits,
    in other_id: at least `min_words` words, of which the share `identity` is equal. First other_id is the smallest
    id that has a seed of the passage or a window of `min_words` words of it. A document that shares a seed's passage with a smaller one is a
    member of its class by that row; then the classes' representatives, those documents that are no member at the seed, are compared with each other,
    whichever of them is first, by all seeds that two share; of holders that are led to one place of one document the first stands for all. So a passage in n documents gives
    about n rows and one for each two representatives that are near, not n squared, and members of two classes are linked through these. Representatives are aligned if they share
    as many grams of GRAM words round the seed as `min_words` words with `min_identity` equal must have, words replaced, and one of these outside the run of equal words that the seed
    is in, if that is shorter than `min_words`; two texts that differ there by many single insertions and deletions on both sides can have fewer.
    Every document that holds a passage of min_words + WINDOW_STEP - 1 words verbatim has a row for it, as doc_id or as other_id,
    whatever else the first holders of its seeds are; for edited and for shorter passages that depends on seeds alone.

    Seeds are the five-word windows with the smallest hash of SEED_WINDOW neighbours; a seed
    that several documents have matches each of them with the first. As the first holder of a seed may hold little else
    of a passage, windows of `min_words` words, sampled in the same way, match each of their holders with the first too; windows
    whose smallest seed no other document has are left out beforehand, by a bitmap of fixed size. The matches of two documents are chained
    and the chains aligned on the words of both texts. A chain that runs across unrelated words is split there, and
    each part that is a passage has a row. Matching is on lower-cased A-Z.

    Null, empty and short texts give nothing; repeats within one document don't count. Rows that share a doc_id
    are one document, of which one is read for the alignment; rows without a doc_id have no name to report and are left out. Of equal
    seeds in a text the first counts. Empty table: empty result. Columns other than doc_id and text are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    each, found = _of_first_holders(texts, min_words, min_identity)
    let_go(docs.sparkSession)
    least = max(2, int(np.ceil(min_identity * min_words)) - (GRAM - 1) * (min_words - int(np.ceil(min_identity * min_words)) + 1))
    holders = _representatives(each, found)
    let_go(docs.sparkSession)
    pairs = cut(_close_holders(texts, holders, least, min_words, min_identity))
    let_go(docs.sparkSession)
    more = _aligned(texts, _common_seeds(each, pairs), min_words, min_identity)
    known = found.select(F.col("doc_id").alias("k_doc"), F.col("other_id").alias("k_other"), F.col("first").alias("k_first"), F.col("last").alias("k_last"))
    same = (F.col("doc_id") == F.col("k_doc")) & (F.col("other_id") == F.col("k_other")) & (F.col("first") <= F.col("k_last")) & (F.col("k_first") <= F.col("last"))
    return found.unionByName(more.join(known.hint(join_hint(known)), same, "left_anti"))
