"""Exact repeats of long byte strings: suffixes at anchors, merge-sorted with their common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm.lcp_merge import LoserTree, front_code
from ticketflow.llm.text import U64, Piece, bitmap_of, cut, join_hint, map_batches, map_iter, maybe_in, mix, pieces, prefix_hash, span_hash

#: Length of a repeat in bytes; start positions that share one anchor at most; bytes of an anchor's gram.
LENGTH, REACH, GRAM = 200, 128, 16
#: Contexts of a key that are merged as one group at most, and the widths of the cells into which stretches of a key with more are cut.
FEW, CELLS = 64, (32, 8, 1)
PIECE = 1 << 19
#: Suffixes of a bucket, about: one task merges their runs.
BUCKET = 10_000
#: Of a gram's hash the upper bits count, then its place.
LOW = U64(32)


def _argmin_windows(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the first smallest value of each w consecutive ones."""
    n, low = len(h), LOW
    packed = (h >> low << low) | np.arange(n, dtype=np.uint64)
    pad = np.full((-n) % w, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks = np.concatenate([packed, pad]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[: n - w + 1], left[w - 1 : n]) & ((U64(1) << low) - U64(1))).astype(np.int64)


def _stretches(piece: Piece, run: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal stretches of start positions with one anchor: (text number, first start, starts, key, context).

    A start's anchor is the position with the smallest gram hash among the REACH positions from
    it; equal strings of LENGTH bytes have it at the same place. The key is the hash of the
    LENGTH - REACH + 1 bytes from the anchor, which lie in every string of the stretch; the context is the hash of all bytes that its strings cover.
    """
    size = len(piece.data)
    if size < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    gram_at = np.arange(size - GRAM + 1)
    anchor = _argmin_windows(span_hash(run, gram_at, gram_at + GRAM), REACH)
    x = np.arange(size - LENGTH + 1)
    doc = np.searchsorted(piece.end, x, side="left")
    x = x[x + LENGTH <= piece.end[doc]]
    doc, anchor = np.searchsorted(piece.end, x, side="left"), anchor[x]
    new = np.ones(len(x), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(x)))
    first, a = x[begin], anchor[begin]
    key = span_hash(run, a, a + LENGTH - REACH + 1)
    context = span_hash(run, first, first + count - 1 + LENGTH)
    return doc[begin], first - piece.start[doc[begin]], count, key, mix(context ^ mix((a - first).astype(np.uint64)))


def stretches(docs: DataFrame) -> DataFrame:
    """documents -> row_id, first, n, key, context as arrays, one row per text."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batch.column(1), most=PIECE):
            doc, first, n, key, context = _stretches(piece, prefix_hash(piece.data))
            cuts = pa.array(np.searchsorted(doc, np.arange(len(piece) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v, t)) for v, t in ((first, pa.int32()), (n, pa.int32()), (key.view(np.int64), pa.int64()), (context.view(np.int64), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), *lists], ["row_id", "first", "n", "key", "context"])

    return map_batches(docs, each, "row_id long, first array<int>, n array<int>, key array<long>, context array<long>")


def _anchors(run: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The anchor of each start: all starts of a stretch have the same."""
    if not len(first):
        return np.zeros(0, np.int64)
    at = first[:, None] + np.arange(REACH)
    return first + (span_hash(run, at, at + GRAM) >> LOW).argmin(axis=1)


def _parts(batch: pa.RecordBatch, piece: Piece) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(row_id, text, parts) rows -> for each part of the piece's texts the text number, and the parts' fields, `first` counted from the piece."""
    lists = batch.column("parts").slice(piece.first, len(piece))
    flat, count = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(piece)), count)
    fields = {flat.type.field(k).name: flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)}
    fields["first"] = fields["first"].astype(np.int64) + piece.start[doc]
    return doc, fields


def _cells(texts: DataFrame, width: int) -> DataFrame:
    """(row_id, text, parts) -> row_id, first, n, key, context, lead, alone: the parts' stretches, cut into cells of `width` starts.

    A cell holds the starts that lie c * width to (c + 1) * width - 1 bytes before the anchor, so strings that are equal are
    in the same cell of equal stretches. Its key is the hash of the LENGTH - width + 1 bytes that all its strings have in
    common; they begin `lead` bytes before the anchor. A narrower cell has a longer key, and at width 1 the key is the string.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("row_id").to_numpy(zero_copy_only=False)
        for piece in pieces(batch.column("text"), most=PIECE):
            doc, f = _parts(batch, piece)
            if not len(doc):
                continue
            run = prefix_hash(piece.data)
            anchor = _anchors(run, f["first"])
            far = anchor - f["first"]
            near = far - f["n"] + 1
            cells = far // width - near // width + 1
            of = np.repeat(np.arange(len(doc)), cells)
            c = near[of] // width + np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
            lead = c * width
            high, low = np.minimum(far[of], lead + width - 1), np.maximum(near[of], lead)
            first, n, begin = anchor[of] - high, high - low + 1, anchor[of] - lead
            key = mix(span_hash(run, begin, begin + LENGTH - width + 1) ^ mix(c.astype(np.uint64)))
            context = mix(span_hash(run, first, first + n - 1 + LENGTH) ^ mix((begin - first).astype(np.uint64)))
            owner = doc[of]
            columns = [pa.array(ids[piece.first + owner]), pa.array((first - piece.start[owner]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(lead.astype(np.int32)), pa.array(f["alone"][of])]
            yield pa.RecordBatch.from_arrays(columns, ["row_id", "first", "n", "key", "context", "lead", "alone"])

    return map_batches(texts.select("row_id", "text", "parts"), each, "row_id long, first int, n int, key long, context long, lead int, alone boolean")


def _runs(texts: DataFrame, buckets: int) -> DataFrame:
    """(row_id, text, parts) -> bucket, common, shared, rest, left, row_id, first, n, alone: sorted runs of the parts' suffixes.

    A suffix begins with the bytes that all strings of its key have in common, `common` of them, and ends with the
    part's last string; `left` are the bytes before it from the part's first string on. Each batch sorts its suffixes, one
    run a bucket, and front-codes them. A bucket takes all suffixes of its keys.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("row_id").to_pylist()
        of: dict[tuple[int, int], list[tuple]] = {}
        for piece in pieces(batch.column("text"), most=PIECE):
            doc, f = _parts(batch, piece)
            data = piece.data.tobytes()
            anchor = _anchors(prefix_hash(piece.data), f["first"])
            start = piece.start[doc]
            for d, s, a, first, n, key, alone, lead, common in zip(doc.tolist(), start.tolist(), anchor.tolist(), *(f[k].tolist() for k in ("first", "n", "key", "alone", "lead", "common"))):
                begin = a - lead
                of.setdefault((key % buckets, common), []).append((data[begin : first + n - 1 + LENGTH], data[first:begin], ids[piece.first + d], first - s, n, alone))
        out: list[list] = [[] for _ in range(9)]
        for (bucket, common), suffixes in of.items():
            suffixes.sort()
            shared, rest = front_code([x[0] for x in suffixes])
            for column, v in zip(out, (bucket, common, shared, rest, *zip(*[x[1:] for x in suffixes]))):
                column.append(v)
        kinds = [pa.int64(), pa.int32(), *map(pa.list_, (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["bucket", "common", "shared", "rest", "left", "row_id", "first", "n", "alone"])

    schema = "bucket long, common int, shared array<int>, rest array<binary>, left array<binary>, row_id array<long>, first array<int>, n array<int>, alone array<boolean>"
    return map_batches(texts.select("row_id", "text", "parts"), each, schema)


def _agreements(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(row_id, first, n): the starts of a key's lone contexts whose string another of its contexts has.

    Contexts are laid over each other at their anchors. Two that agree on `left` bytes before and on
    `right` from there share the strings that begin up to `left` before the anchor and end within `right`.
    """
    before, after = max(x[3] for x in group), max(len(x[5]) - x[3] for x in group)
    table = np.full((len(group), before + after), -1, dtype=np.int16)
    for i, x in enumerate(group):
        table[i, before - x[3] : before - x[3] + len(x[5])] = np.frombuffer(x[5], dtype=np.uint8)
    for i, (row_id, first, n, anchor, alone, _) in enumerate(group):
        if not alone:
            continue
        differ = (table != table[i]) | (table[i] < 0)
        left = np.argmax(np.concatenate([differ[:, :before][:, ::-1], np.ones((len(group), 1), bool)], axis=1), axis=1)
        right = np.argmax(np.concatenate([differ[:, before:], np.ones((len(group), 1), bool)], axis=1), axis=1)
        left[i] = -1
        marks = np.zeros(n + 1, dtype=np.int64)
        for lo, hi in zip(anchor - left, anchor + right - LENGTH):  # starts lo to hi, from the context's first
            lo, hi = max(0, int(lo)), min(n - 1, int(hi))
            if lo <= hi:
                marks[lo] += 1
                marks[hi + 1] -= 1
        on = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(marks[:-1]) > 0).view(np.int8), [0]])))
        for lo, hi in zip(on[::2], on[1::2]):
            yield row_id, first + int(lo), int(hi - lo)


def _settle(texts: DataFrame, suffixes: int) -> DataFrame:
    """All contexts of keys with few of them -> row_id, first, n of repeated starts.

    The runs of a bucket are merged by a loser tree; neighbours that share the bytes of a key form a group.
    """

    def merged(runs: list[dict]) -> Iterator[tuple[int, int, int]]:
        group: list[tuple] = []
        for i, k, suffix, shared in LoserTree([(r["shared"], r["rest"]) for r in runs]):
            r = runs[i]
            if shared < r["common"] and group:
                yield from _agreements(group) if len(group) > 1 else ()
                group = []
            group.append((r["row_id"][k], r["first"][k], r["n"][k], len(r["left"][k]), r["alone"][k], r["left"][k] + suffix))
        yield from _agreements(group) if len(group) > 1 else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            for k in range(batch.num_rows):
                r = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                if (r["bucket"], r["common"]) != of:
                    yield _starts(list(merged(held)))
                    held, of = [], (r["bucket"], r["common"])
                held.append(r)
        yield _starts(list(merged(held)))

    buckets = max(1, -(-suffixes // BUCKET))
    dealt = _runs(texts, buckets).repartition(buckets, "bucket", "common").sortWithinPartitions("bucket", "common")
    return map_iter(dealt, run, "row_id long, first int, n int")


def _starts(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["row_id", "first", "n"])


def _with_parts(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """The texts that have parts, each with an array of its own: row_id, text, parts."""
    lists = cut(parts.groupBy("row_id").agg(F.collect_list(F.struct(*[c for c in parts.columns if c != "row_id"])).alias("parts")))
    ids = lists.select(F.col("row_id").alias("p_id"))
    return docs.join(ids.hint(join_hint(ids)), F.col("row_id") == F.col("p_id"), "left_semi").join(lists.hint("merge"), "row_id")


def _sorted_out(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stretches or cells (row_id, first, n, key, context, lead, alone) -> (row_id, first, n) of lone ones that repeat as a whole, and one of each context of the keys that have several: key, k (how many), row_id, first, n, lead, alone.

    Contexts are the same if both their hashes are. Keys and contexts grow with the data, so they are joined by shuffle at any size. `alone` are those whose strings are not yet known to repeat.
    """
    contexts = cut(rows.groupBy("key", "context").agg(F.count(F.lit(1)).alias("c"), F.max("alone").alias("open"), F.min(F.struct("row_id", "first", "n", "lead")).alias("at")))
    full = cut(contexts.filter("c > 1 and open").select("key", "context"))
    whole = rows.filter("alone").join(full.hint("merge"), ["key", "context"], "left_semi").select("row_id", "first", "n")
    alone = (F.col("c") == 1) & F.col("open")
    several = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(alone).alias("any")).filter("k > 1 and any").select("key", "k")
    return whole, cut(contexts.join(several.hint("merge"), "key").select("key", "k", "at.row_id", "at.first", "at.n", "at.lead", alone.alias("alone")))


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(row_id, text) -> row_id, first, n: ranges of start positions whose LENGTH bytes also start elsewhere."""
    rows = cut(stretches(docs))
    keys = cut(rows.select(F.explode("key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"))
    each = rows.select("row_id", F.inline(F.arrays_zip("first", "n", "key", "context")), F.lit(0).alias("lead"), F.lit(True).alias("alone"))
    level = maybe_in(each, "key", bitmap_of(keys, "key")).join(keys.hint("merge"), "key", "left_semi")
    out, few, width = None, None, REACH
    for narrower in (*CELLS, None):
        whole, left = _sorted_out(level)
        part = left.filter(F.col("k") <= FEW).select("row_id", "key", "first", "n", "alone", "lead", F.lit(LENGTH - width + 1).alias("common"))
        out = whole if out is None else out.unionByName(whole)
        few = part if few is None else few.unionByName(part)
        hot = left.filter(F.col("k") > FEW)
        if hot.isEmpty():
            break
        level, width = cut(_cells(_with_parts(docs, hot.select("row_id", "first", "n", "alone")), narrower)), narrower
    return out.unionByName(_settle(_with_parts(docs, few), few.count()))


def _covered(parts: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that the strings starting in the given ranges cover."""
    out: list[list[int]] = []
    for first, end in sorted((x["first"], x["first"] + x["n"] - 1 + LENGTH) for x in parts):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, min(end, size)])
    return [(a, min(b, size)) for a, b in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256; one row per row of documents, over whole texts as UTF-8.

    Every byte goes that lies in a string of LENGTH bytes which starts more than once in all of the
    documents. Start positions are not exchanged one by one: neighbours that share an anchor
    form a stretch, about one for 64 bytes. A stretch whose key occurs once cannot repeat. One whose whole context
    occurs twice repeats entirely, and copies of a context count once from there on, so that a passage in a third of the
    documents is one row. What is left, the edges of repeats, is sorted: tasks exchange front-coded sorted runs of the suffixes at the
    anchors, which loser trees merge without comparing known prefixes again; neighbours that share a key's bytes are laid
    over each other. Stretches of a key with many contexts are first cut into cells, with longer keys: cells inside
    the repeat are alike and go at once, and only those at its edges are cut again, until the groups are small.

    Null and empty texts: no bytes, the digest of nothing. Matches inside one document count;
    overlaps too. Repeated rows are copies of each other. Rows are told apart by a number
    of their own, not by doc_id, which may be null or shared. Empty table: empty result. Columns other than doc_id and text are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    unclear = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or doc_id is null")
    if unclear.isEmpty():
        numbered = base.withColumn("row_id", F.col("doc_id"))
    else:
        numbered = cut(base.withColumn("row_id", F.monotonically_increasing_id()))
    starts = repeated_starts(numbered.select("row_id", "text"))
    lists = cut(starts.groupBy("row_id").agg(F.collect_list(F.struct("first", "n")).alias("parts")))
    ids = lists.select(F.col("row_id").alias("p_id"))
    touched = F.col("row_id") == F.col("p_id")
    hint = join_hint(ids)
    joined = numbered.join(ids.hint(hint), touched, "left_semi").join(lists.hint("merge"), "row_id").select("doc_id", "text", "parts")
    others = numbered.join(ids.hint(hint), touched, "left_anti").select("doc_id", "text", F.lit(None).cast(lists.schema["parts"].dataType).alias("parts"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")}
        for text, parts in zip(batch.column("text").cast(pa.binary()), batch.column("parts")):
            text, parts = text.as_py() or b"", parts.as_py()
            spans = _covered(parts or [], len(text))
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept = b"".join([*kept, text[at:]])
            for k, v in zip(out, (len(text), len(text) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest())):
                out[k].append(v)
        kinds = [pa.int64()] * 3 + [pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, k) for v, k in zip(out.values(), kinds)]], ["doc_id", *out])

    return map_batches(joined.unionByName(others), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
