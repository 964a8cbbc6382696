"""N-gram Jaccard join: size bands, hashed bitmap signatures, exact intersection of sorted arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm.graph import components
from ticketflow.llm.text import U64, Piece, cut, join_hint, map_batches, map_iter, mix, pieces, shingles

#: Similarity in hundredths, and words of a shingle.
SIMILARITY, WORDS = 80, 5
#: Sets below this size are keyed by single shingles; larger ones by parts of about PART shingles, KEYS of them.
SMALL, PART, KEYS = 45, 3, 67
#: Documents of a tile's side; up to how many of a key's documents are paired by a plain self join.
TILE, SELF_JOIN = 1024, 32

def bands(n: int) -> list[tuple[int, int]]:
    """The size bands (low, high) in which a set of n shingles needs keys; (0, 0) is the single-shingle scheme, for pairs with a set under SMALL.

    Two sets that link differ in size by a factor of 100 / SIMILARITY at most; the band of
    the larger one counts, so a set also takes the next band if its partners may lie there.
    """
    out = [(0, 0)] if n * SIMILARITY <= 100 * (SMALL - 1) else []
    if n >= SMALL:
        low = SMALL
        while n >= 2 * low:
            low *= 2
        out.append((low, 2 * low - 1))
        if n * 100 >= SIMILARITY * 2 * low:
            out.append((2 * low, 4 * low - 1))
    return out


def band_keys(tokens: np.ndarray, owner: np.ndarray, count: int, band: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (key, set number) of the sets of one band. tokens: all their shingles, sorted in each set; owner: 0 to count - 1.

    Band 0: the first n - 0.8 n + 1 shingles in hash order; by the prefix argument two linked sets share one of these.
    Others: the hash space is cut into parts of about PART shingles; a key is the hash of all
    of a set's shingles in one part. Linked sets differ in a ninth of their summed size at
    most, so each part is the same in both, and not empty, with a chance of about a half; with KEYS parts
    the chance that none is lies under that of a 64-bit hash collision. A passage shared by
    many texts does not make a hot key, unless a part holds nothing else.
    """
    low, high = band
    if not low:
        size = np.bincount(owner, minlength=count)
        first = np.cumsum(size) - size
        take = size - -(-SIMILARITY * size // 100) + 1
        at = np.arange(len(tokens)) - first[owner]
        own = at < take[owner]
        return mix(tokens[own] + U64(11)), owner[own]
    parts = math.ceil(high / PART)
    used = min(parts, KEYS)
    out_k, out_o = [], []
    for seed in range(math.ceil(KEYS / used)):
        part = (mix(tokens ^ U64(0xA24BAED4963EE407 + seed * 0x9FB21C651E98DF25 & (1 << 64) - 1)) % U64(parts)).astype(np.int64)
        own = part < used
        group = owner[own] * used + part[own]
        order = np.argsort(group, kind="stable")
        group, value = group[order], mix(tokens[own][order] + U64(seed + 1))
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        if len(starts):
            g = group[starts]
            salt = (g % used).astype(np.uint64) + U64(1000 * seed + 100_000 * low)
            out_k.append(mix(np.add.reduceat(value, starts) + mix(salt)))
            out_o.append(g // used)
    if not out_k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_k), np.concatenate(out_o)


def bitmap(tokens: np.ndarray) -> bytes:
    """Hashed bitmap of a set, of a power of two bits, twice as many as shingles at least (8192 at most)."""
    width = 1 << min(13, max(6, (2 * len(tokens) - 1).bit_length()))
    bits = np.zeros(width, dtype=bool)
    bits[(tokens & U64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: bytes, width: int) -> np.ndarray:
    """A bitmap narrowed to `width` bits, as words."""
    x = np.frombuffer(bits, dtype=np.uint64)
    while len(x) * 64 > width:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def may_link(n_a: int, bits_a: np.ndarray, n_b: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """Whether the bitmaps leave room for a link: bits only one set has are shingles only it has, which bounds the overlap from above."""
    only_a = np.bitwise_count(bits_a & ~bits_b).sum(axis=-1)
    only_b = np.bitwise_count(bits_b & ~bits_a).sum(axis=-1)
    most = np.minimum(n_a - only_a.astype(np.int64), n_b - only_b.astype(np.int64))
    return 100 * most >= SIMILARITY * (n_a + n_b - most)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test on two sorted arrays of distinct shingles."""
    if 100 * min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * both >= SIMILARITY * (len(a) + len(b) - both)


def _spans(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n + 1))


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    order = np.argsort(owner, kind="stable")
    return pa.ListArray.from_arrays(pa.array(_spans(owner[order], n), pa.int32()), pa.array(values[order].view(np.int64)))


def _set_hashes(tokens: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One hash of each set: two order-free sums of its shingles and its size, scrambled."""
    sums = []
    for salt in (0, 0x5851F42D4C957F2D):
        run = np.concatenate([[U64(0)], np.cumsum(mix(tokens ^ U64(salt)))]).astype(np.uint64)
        sums.append(run[cuts[1:]] - run[cuts[:-1]])
    return mix(mix(sums[0]) + U64(3) * sums[1] + np.diff(cuts).astype(np.uint64))


def _signatures(piece: Piece) -> dict[str, pa.Array]:
    """Of each text: set size, node (the hash of its set), keys, bitmap."""
    n = len(piece)
    tokens, owner = shingles(piece, WORDS)
    cuts = _spans(owner, n)
    size = np.diff(cuts)
    of_band: dict[tuple[int, int], list[int]] = {}
    for i in np.flatnonzero(size):
        for b in bands(int(size[i])):
            of_band.setdefault(b, []).append(i)
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b, docs in of_band.items():
        docs = np.array(docs)
        own = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in docs])
        k, o = band_keys(tokens[own], np.repeat(np.arange(len(docs)), size[docs]), len(docs), b)
        keys.append(k)
        owners.append(docs[o])
    return {
        "n": pa.array(size, pa.int64()), "node": pa.array(_set_hashes(tokens, cuts).view(np.int64)),
        "keys": _lists(np.concatenate(keys), np.concatenate(owners), n), "bits": pa.array([bitmap(tokens[cuts[i] : cuts[i + 1]]) for i in range(n)], pa.binary()),
    }


def signatures(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n, node, keys, bits. Texts with the same set of shingles have the same node."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batch.column(1), lower=True):
            s = _signatures(piece)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), *s.values()], ["doc_id", *s])

    return map_batches(docs, each, "doc_id long, n long, node long, keys array<long>, bits binary")


def _tokens(docs: DataFrame) -> DataFrame:
    """documents -> node, tokens: the sorted distinct shingles."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batch.column(1), lower=True):
            t, owner = shingles(piece, WORDS)
            node = _set_hashes(t, _spans(owner, len(piece)))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), _lists(t, owner, len(piece))], ["node", "tokens"])

    return map_batches(docs, each, "node long, tokens array<long>")


def _few(ids: DataFrame) -> DataFrame:
    """A kept table of ids or keys with the hint for joining it."""
    return ids.hint(join_hint(ids))


def _likely(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidate (a, b) whose sizes and bitmaps leave room for a link."""
    left = facts.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = facts.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    size = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SIMILARITY
    rows = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter(size)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for n_a, bits_a, n_b, bits_b in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
            width = 8 * min(len(bits_a), len(bits_b))
            keep.append(bool(may_link(n_a, fold(bits_a, width), n_b, fold(bits_b, width))))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(rows.select("a", "b", "n_a", "bits_a", "n_b", "bits_b"), each, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, held: DataFrame) -> DataFrame:
    """Candidate nodes (a, b) -> those that link, by the exact test on their texts' shingles. held: node, doc_id of one text that has it.

    The b's of an a meet it in one task, or, if there are many, in several that each get a copy of a.
    """
    pairs = cut(pairs)
    if pairs.isEmpty():
        return pairs
    active = cut(pairs.select(F.explode(F.array("a", "b")).alias("a_node")).distinct())
    wanted = cut(held.join(_few(active), F.col("node") == F.col("a_node"), "left_semi").select(F.col("doc_id").alias("w_id"), F.col("node").alias("w_node")))
    tokens = _tokens(texts.join(_few(wanted.select("w_id").distinct()), F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi"))
    tokens = cut(tokens.join(_few(wanted), F.col("node") == F.col("w_node"), "left_semi"))
    again = tokens.groupBy("node").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")  # rows that share an id and the set
    if not again.isEmpty():
        tokens = cut(tokens.dropDuplicates(["node"]))
    count = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    dealt = pairs.join(count.hint("merge"), "a").select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / TILE)).alias("salt"), "b")
    dealt = cut(dealt)
    right = dealt.join(tokens.hint("merge"), F.col("b") == F.col("node")).select("a", "salt", F.lit(1).alias("role"), "b", "tokens")
    left = dealt.select("a", "salt").distinct().join(tokens.hint("merge"), F.col("a") == F.col("node")).select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, of = np.zeros(0, np.uint64), None
        for batch in batches:
            a, salt, role, b = (batch.column(i).to_pylist() for i in range(4))
            lists = batch.column(4)
            cuts, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
            out_a, out_b = [], []
            for i in range(len(a)):
                t = flat[cuts[i] : cuts[i + 1]]
                if role[i] == 0:
                    mine, of = t.copy(), (a[i], salt[i])
                elif of == (a[i], salt[i]) and linked(mine, t):
                    out_a.append(a[i])
                    out_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    rows = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "b")
    return map_iter(rows, run, "a long, b long")


def _tile_pairs(rows: DataFrame) -> DataFrame:
    """Open keys with many documents -> candidate (a, b) of different components that the bitmaps let through.

    A key's documents are dealt over blocks of about TILE, and each pair of blocks is a tile:
    a task compares the bitmaps of one tile at a time.
    """
    blocks = F.ceil(F.col("c") / TILE)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    tiled = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "component", "bits")

    def pairs_of(group: list[tuple], i: int, j: int) -> Iterator[tuple[int, int]]:
        left = [x for x in group if x[0] == i]
        right = [x for x in group if x[0] == j]
        if not left or not right:
            return
        width = min(len(x[4]) for x in group) * 8
        n_b, comp_b, id_b = np.array([x[2] for x in right]), np.array([x[3] for x in right]), np.array([x[1] for x in right])
        bits_b = np.stack([fold(x[4], width) for x in right])
        for _, node, n, comp, bits in left:
            ok = (comp_b != comp) & (100 * np.minimum(n, n_b) >= SIMILARITY * np.maximum(n, n_b))
            if i == j:
                ok &= id_b > node
            at = np.flatnonzero(ok)
            if len(at):
                for k in at[may_link(n, fold(bits, width), n_b[at], bits_b[at])]:
                    yield min(node, int(id_b[k])), max(node, int(id_b[k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None

        def tile() -> Iterator[pa.RecordBatch]:
            pairs = pairs_of(held, of[1], of[2])
            while part := list(islice(pairs, 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for key, i, j, block, node, n, comp, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if of != (key, i, j):
                    if of is not None:
                        yield from tile()
                    held, of = [], (key, i, j)
                held.append((block, node, n, comp, bits))
        if of is not None:
            yield from tile()

    dealt = tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "node")
    return map_iter(dealt, run, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id; one row per row of documents, over whole texts.

    Two documents link if their sets of 5-word shingles (lower-cased A-Z) have a Jaccard
    similarity of 0.8 or more; the component is the smallest doc_id that links lead to.

    Equal sets are one node, so copies are never paired. Nodes meet in tiles: those that share a key of a size
    band (see band_keys) with the same first node, the one with the smallest doc_id, as copies come after what they were made from. In each tile the first node is compared with the others, and where this
    linked most of them a second one; what is then still in several components is compared pairwise, in tiles of bounded size, through
    the bitmaps, which drop most pairs, before the exact intersection. A pair inside one
    component needs no comparison, so that a group of many near copies costs its size, not its square.

    Null, empty and wordless texts: n_shingles 0, linked with nothing; their component_id is their doc_id. Repeated rows: each
    gets the same answer. Rows that share a doc_id but not the text are versions of one document: links of one
    count for all that have words. A null doc_id names no document: such rows are
    linked by their texts alone, and the component is the smallest doc_id that is known, null if none is. Empty table: empty
    result. Columns other than doc_id and text are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = cut(signatures(texts))
    full = sig.filter("n > 0")
    sets = cut(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")))
    first_rows = sets.select(F.col("node").alias("s_node"), F.col("doc_id").alias("s_id"))
    own = full.join(_few(first_rows), (F.col("node") == F.col("s_node")) & F.col("doc_id").eqNullSafe(F.col("s_id")), "left_semi")

    keyed = own.select(F.explode("keys").alias("key"), "node", "n", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("place"))
    shared = cut(keyed.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"))
    met = keyed.join(_few(shared), "key").distinct()
    first = met.groupBy("key").agg(F.min(F.struct("place", "node", "n")).alias("low"), F.min("node").alias("least"), F.max("node").alias("last")).filter("least < last")
    met = met.join(first.select("key", F.col("low.node").alias("center"), F.col("low.n").alias("n_center")).hint("merge"), "key")
    # keys with the same first node are one tile: near copies share dozens of keys and would be compared in each
    met = cut(met.select(F.col("center").alias("key"), "node", "n", "place", "center", "n_center").distinct())
    facts = own.select(F.col("node").alias("id"), "n", "bits").dropDuplicates(["id"])

    close = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * SIMILARITY
    stars = cut(met.filter("node <> center").filter(close("n", "n_center")).select(F.col("center").alias("a"), F.col("node").alias("b")).distinct())
    ids = full.select("doc_id", "node").filter("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    ids = cut(ids.select("doc_id", "a"))  # of documents in several versions
    versions = full.select("doc_id", F.col("node").alias("b")).join(_few(ids), "doc_id").filter("a <> b").select("a", "b").distinct()
    links = cut(verified(_likely(stars, facts), texts, sets).unionByName(versions))

    def placed(links: DataFrame) -> DataFrame:
        """Rows of keys whose nodes lie in several components, with the component."""
        label = _few(components(links).select(F.col("node").alias("l_node"), "component"))
        rows = met.join(label, F.col("node") == F.col("l_node"), "left").select("key", "node", "n", "place", "center", F.coalesce("component", "node").alias("component"))
        main = F.max(F.when(F.col("node") == F.col("center"), F.col("component"))).alias("main")
        open_ = rows.groupBy("key").agg(main, F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("c"), F.countDistinct("component").alias("parts")).filter("low < high")
        return cut(rows.join(open_.hint("merge"), "key"))

    rows = placed(links)
    joined = rows.filter("2 * parts <= c")  # keys whose first node linked most others; a second one may link more
    seconds = joined.filter("component <> main").groupBy("key").agg(F.min(F.struct("place", "node", "n", "component")).alias("s")).select("key", F.col("s.node").alias("second"), F.col("s.n").alias("n_second"), F.col("s.component").alias("c_second"))
    again = joined.join(seconds.hint("merge"), "key").filter("node <> second and component <> c_second and center <> second and node <> center").filter(close("n", "n_second")).select(F.least("node", "second").alias("a"), F.greatest("node", "second").alias("b")).distinct()
    again = cut(_likely(again.join(stars.hint("merge"), ["a", "b"], "left_anti"), facts))
    if not again.isEmpty():
        links = cut(links.unionByName(verified(again, texts, sets)))
        rows = placed(links)
    few = rows.filter(f"c <= {SELF_JOIN}").select("key", "node", "n", "component")
    right = few.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"))
    by_join = few.hint("merge").join(right, "key").filter((F.col("node") < F.col("b")) & close("n", "n_b") & (F.col("component") != F.col("c_b"))).select(F.col("node").alias("a"), "b")
    many = rows.filter(f"c > {SELF_JOIN}").join(facts.select("id", "bits").hint("merge"), F.col("node") == F.col("id")).select("key", "node", "n", "component", "bits", "c")
    rest = by_join.unionByName(_tile_pairs(many)).distinct().join(stars.hint("merge"), ["a", "b"], "left_anti")
    links = cut(links.unionByName(verified(_likely(rest, facts), texts, sets)))

    label = components(links).select(F.col("node").alias("l_node"), "component")
    placed_sets = cut(sets.select("node", "doc_id").join(_few(label), F.col("node") == F.col("l_node")).select("node", "doc_id", "component"))
    names = placed_sets.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = cut(placed_sets.join(_few(cut(names)), "component").select(F.col("node").alias("c_node"), "component_id"))
    alone = sets.select(F.col("node").alias("s_node"), F.col("doc_id").alias("s_id"))
    answer = cut(alone.join(_few(of_set), F.col("s_node") == F.col("c_node"), "left").select("s_node", F.coalesce("component_id", "s_id").alias("component_id")))
    worded = full.select("doc_id", "n", "node").join(_few(answer), F.col("node") == F.col("s_node"), "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return worded.unionByName(sig.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
