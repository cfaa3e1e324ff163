"""Helpers shared by the operators: tables, shared folders, text blocks and
vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlift.session import ensure_checkpoint_dir

#: Text handled at once inside a task, in bytes.  One longer text is one block.
BLOCK_BYTES = 1 << 18


#: Arrow batches of texts, in bytes.  Spark's default is sixteen times as much,
#: of which a task holds several copies on and off the heap.
ARROW_BATCH, ARROW_DEFAULT = "4m", str(64 << 20) + "b"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound of Arrow batches, unless it has been set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == ARROW_DEFAULT:
        spark.conf.set(key, ARROW_BATCH)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table; other columns are not read."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under one folder per application."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/donorlift-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Rows of a narrow table in one file, if their number is known.
FILE_ROWS = 500_000


def materialise(df: DataFrame, name: str, compact: bool = False, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts
    the lineage and survives lost executors.  ``compact`` is for what comes
    out of a shuffle: at most two files per core of the cluster, not one per
    shuffle partition; and with a bound of their number, a file per FILE_ROWS
    ``rows`` if these are fewer."""
    small_batches(df.sparkSession)
    if compact:
        files = 2 * df.sparkSession.sparkContext.defaultParallelism
        df = df.coalesce(files if rows is None else max(1, min(files, -(-rows // FILE_ROWS))))
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def train_fold(doc_id: str = "doc_id") -> Column:
    """Rows that labels may be learned from: crc32(id as text) mod 3 is not 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(id as text) mod 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drawn(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """At most ``n`` rows, those of least hash of ``key``.  Rows beyond the
    share that is needed are left out before the ordering, so that no task
    brings more than its part of them, however many tasks there are."""
    total = df.count()
    share = min(1.0, (1.2 * n + 100) / max(1, total))
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    return df.where(place < int(share * (1 << 30))).orderBy(place, key).limit(n)


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column in one array, and n + 1 offsets into
    it; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def row_blocks(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` bytes together."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def byte_class(separators: bytes) -> np.ndarray:
    """256 flags: True for bytes that belong to words."""
    keep = np.ones(256, bool)
    keep[list(separators)] = False
    return keep


#: A-Z to a-z on UTF-8 bytes; other bytes stay.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def word_bounds(buf: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each
    text (n + 1 values).  Words do not cross texts."""
    inside = keep[buf]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offs[:-1][offs[:-1] < len(buf)]
    starts[cut] = inside[cut]
    cut = cut[cut > 0]
    ends[cut - 1] = inside[cut - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offs)


_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


#: Words up to this many bytes are hashed by 8-byte blocks, all at once.
SHORT_WORD = 32
_BLOCK_ODD = _rng.integers(1, 1 << 63, SHORT_WORD // 8, dtype=np.uint64) | np.uint64(1)


def word_hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: its 8-byte blocks go through a finaliser one
    after another, so different words of up to 8 bytes and equal length never
    meet, and no sum of byte terms can cancel out; longer ones than SHORT_WORD
    are rare and take BLAKE2b."""
    lens = last - first
    h = mix(lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    at_byte = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))  # 8 bytes from every position
    some = np.flatnonzero(lens <= SHORT_WORD)
    for b in range(SHORT_WORD // 8):
        some = some[lens[some] > 8 * b]
        if not len(some):
            break
        left = np.minimum(8, lens[some] - 8 * b).astype(np.uint64)
        block = at_byte[first[some] + 8 * b] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - left) * np.uint64(8)))
        h[some] = mix(h[some] + block * _BLOCK_ODD[b])
    for w in np.flatnonzero(lens > SHORT_WORD).tolist():
        h[w] = int.from_bytes(hashlib.blake2b(buf[first[w] : last[w]].tobytes(), digest_size=8).digest(), "little")
    return h


def share(spark: SparkSession, value) -> Callable:
    """Broadcast a value of bounded size; the returned function gives it in a
    task.  It travels with its classes, so executors need no copy of them."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    """A record batch from columns in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def tidy(run: Callable) -> Callable:
    """A task function that gives freed memory back when it ends: Python
    workers live on and are reused by later tasks."""

    def tidied(*args):
        yield from run(*args)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def keep_rows(docs: DataFrame, column: str, model: Callable, decide: Callable[[object, pa.Array], np.ndarray]) -> DataFrame:
    """Rows for which ``decide`` gives True for the shared model and the value
    of ``column``; all columns pass unchanged, whatever their names.  Repeated
    rows are judged alike and stay repeated."""

    def run(it):
        m = model()
        for b in it:
            yield b.filter(pa.array(decide(m, b.column(b.schema.get_field_index(column)))))

    return docs.mapInArrow(tidy(run), docs.schema)
