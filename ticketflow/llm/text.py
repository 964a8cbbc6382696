"""Array helpers for tasks: words, hashes and shingles of many texts at once.

Spark deals the rows out; these helpers turn the texts of one Arrow batch into numpy
arrays. A batch is cut into pieces of a few MB, so that memory follows the piece and
the longest text, not the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 18
#: Bytes of an Arrow batch, so that a worker's memory does not follow the number of rows.
BATCH_BYTES = 2 << 20
#: Bytes of a side that is broadcast at most, and what a row of a few longs takes as a hashed relation.
BROADCAST_BYTES, HASHED_ROW_BYTES = 48 << 20, 64
#: Bits of a bitmap that says which hashes may be in a table.
BITMAP_BITS = 1 << 28
U64 = np.uint64

_PRIME = 0x9E3779B97F4A7C15
_STEP = _PRIME | 1
_INVERSE = pow(_STEP, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_POWERS = {"n": 0}

#: Bytes that separate words: space, tab, newline, vertical tab, form feed, return.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def shared_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable: in the cluster's shared folder, or, in local mode without one, in a folder of our own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local["):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ticketflow-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are kept in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Free the disk of what no table needs any more: files of shuffles and checkpoints go once the driver's JVM has collected their owners, which by itself it may do long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_hint(df: DataFrame, row_bytes: int = HASHED_ROW_BYTES) -> str:
    """How to join a kept table of ids or keys: by broadcast if it was counted to fit BROADCAST_BYTES, else by shuffle."""
    return "broadcast" if df.count() * row_bytes <= BROADCAST_BYTES else "merge"


def bitmap_of(keys: DataFrame, key: str) -> DataFrame:
    """The bits of a table of hashes -> bucket, bits: 2 ** 28 bits, hence 32 MB, whatever the table's size."""
    at = F.col(key).bitwiseAND(F.lit(BITMAP_BITS - 1)) + 1
    return cut(keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")))


def maybe_in(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """The rows whose bit is set: all of those whose key is in the bitmap's table, and some others, the more the larger that table is.

    The bitmap is broadcast, so most rows that a join would drop need no shuffle.
    """
    at = F.col(key).bitwiseAND(F.lit(BITMAP_BITS - 1)) + 1
    place = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.join(bitmap.hint("broadcast"), F.bitmap_bucket_number(at) == F.col("bucket"))
    return held.filter(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0).drop("bucket", "bits")


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that all bits depend on all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to n."""
    if _POWERS["n"] < n + 1:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, _STEP, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS.update(n=size, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: the hash of data[a:b] is (out[b] - out[a]) * down[a]."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of many slices, by their content alone."""
    _, down = powers(len(run))
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


class Piece:
    """A run of whole texts in one byte array, a newline after each."""

    def __init__(self, texts: list[bytes | None], first: int, lower: bool = False):
        self.texts = [t or b"" for t in texts]
        self.first = first
        data = np.frombuffer(b"\n".join([*self.texts, b""]), dtype=np.uint8)
        self.data = _LOWER[data] if lower else data
        size = np.fromiter(map(len, self.texts), dtype=np.int64, count=len(self.texts))
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size

    def __len__(self) -> int:
        return len(self.texts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each word."""
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[:-1] = ~_SPACE[self.data]
        step = np.diff(inside, prepend=np.int8(0))
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return start, end, np.searchsorted(self.end, start, side="left")

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of each word."""
        start, end, doc = self.words()
        return span_hash(prefix_hash(self.data), start, end), doc


def pieces(column: pa.Array, lower: bool = False, most: int = PIECE_BYTES) -> Iterator[Piece]:
    """A text column as pieces of about `most` bytes; a longer text is a piece of its own."""
    column = column if pa.types.is_binary(column.type) else column.cast(pa.binary())
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()
    first, held = 0, 0
    for i, n in enumerate([*size, most]):
        if i > first and (held + n > most or i == len(size)):
            yield Piece(column.slice(first, i - first).to_pylist(), first, lower)
            first, held = i, 0
        held += n + 1


def ngrams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's number of each n-word window that stays inside one text."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        h = h * U64(_STEP) + words[at + k]
    return mix(h + U64(n)), at


def shingles(piece: Piece, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, as (hash, text number), sorted by text, then hash.

    A text of fewer words has its whole sequence as the one shingle; a text without words has none.
    """
    words, doc = piece.word_hashes()
    h, at = ngrams(words, doc, n)
    owner = doc[at]
    per = np.bincount(doc, minlength=len(piece))
    short = np.flatnonzero((per > 0) & (per < n))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(n - 1):
            has = k < per[short]
            extra[has] = extra[has] * U64(_STEP) + words[first[has] + k]
        h = np.concatenate([h, mix(extra + per[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def _give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and idle ones would keep what their largest text took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_iter(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow on batches of BATCH_BYTES at most, or fewer where the session asks for fewer."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(task, schema)


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """map_iter with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return map_iter(df, run, schema)
