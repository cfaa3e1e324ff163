"""Token-id output (operator 9): best-fit-decreasing packing into id matrices.

Documents are encoded (operator 8's ids), cut into segments of at most the row
length, without loss, and packed into rows: longest segments first, each into
the row with the least free place that still holds it.  A segment tree over
capacities finds that place: a node tells how many open rows have a capacity in
its range, and the search descends to the least capacity that is large enough.

A task packs shards of bounded size; all segments of a document lie in one
shard.  A shard is one row of the output table, written by Spark: an id matrix
(unsigned 16- or 32-bit little-endian, padded), per matrix row its cumulative
segment lengths, the places where position ids start again at 0, and which part
of which document a segment is.

Defined results: null and empty texts have no segment but keep their place in
the list of documents; a text of any length is cut, never shortened; repeated
rows are packed as often as they occur; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from donorlift.llm.bpe import ENCODE_BYTES, WordBPE, default_vocabulary
from donorlift.llm.common import batch, materialise, row_blocks, share, table, text_buffer, tidy
from donorlift.llm.queries import query

ROW_LENGTH = 2048
#: Tokens after which a shard is closed.
SHARD_TOKENS = 1 << 20


class Capacities:
    """Segment tree over capacities 0 .. most: open rows by free places."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        k = self.leaves + capacity
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) of the least capacity >= ``least``, taken out."""
        k = self.leaves + least
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):  # up to the first range on the right with rows
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:  # down to its least capacity
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        row = self.rows[capacity].pop()
        while k:
            self.count[k] -= 1
            k >>= 1
        return capacity, row


def best_fit(lengths: Sequence[int], most: int) -> list[list[int]]:
    """Rows of segment numbers; lengths lie in 1 .. most."""
    open_rows, rows = Capacities(most), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        got = open_rows.take(lengths[k])
        if got is None:
            got = most, len(rows)
            rows.append([])
        capacity, row = got
        rows[row].append(k)
        if capacity > lengths[k]:
            open_rows.put(capacity - lengths[k], row)
    return rows


SHARD = "rows long, row_length int, id_bytes int, ids binary, cu_lengths binary, row_starts binary, resets binary, doc_ids array<long>, segment_doc binary, segment_start binary"
_SHARD = pa.schema([("rows", pa.int64()), ("row_length", pa.int32()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("cu_lengths", pa.binary()), ("row_starts", pa.binary()), ("resets", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("segment_doc", pa.binary()), ("segment_start", pa.binary())])


def pack(doc_ids: list, tokens: list[np.ndarray], row_length: int, pad: int, dtype: str) -> pa.RecordBatch:
    """One shard of the given documents.

    ``cu_lengths`` holds, for every row, 0 and the running sums of its segment
    lengths; row k's values begin at ``row_starts[k]``.  ``resets`` are places in
    the flattened matrix.  Segments are listed in the order of rows.
    """
    seg_doc, seg_start, lengths = [], [], []
    for d, t in enumerate(tokens):
        for at in range(0, len(t), row_length):
            seg_doc.append(d)
            seg_start.append(at)
            lengths.append(min(row_length, len(t) - at))
    rows = best_fit(lengths, row_length)
    ids = np.full((len(rows), row_length), pad, dtype)
    cu, starts, resets, order = [], [0], [], []
    for r, segments in enumerate(rows):
        at = 0
        cu.append(0)
        for k in segments:
            ids[r, at : at + lengths[k]] = tokens[seg_doc[k]][seg_start[k] : seg_start[k] + lengths[k]]
            resets.append(r * row_length + at)
            at += lengths[k]
            cu.append(at)
            order.append(k)
        starts.append(len(cu))
    raw = lambda x, t: np.array(x, t).tobytes()
    return batch(_SHARD, [len(rows)], [row_length], [ids.itemsize], [ids.tobytes()], [raw(cu, "<i4")], [raw(starts, "<i8")], [raw(resets, "<i8")], [doc_ids], [raw([seg_doc[k] for k in order], "<i8")], [raw([seg_start[k] for k in order], "<i8")])


def pack_documents(docs: DataFrame, row_length: int = ROW_LENGTH, vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS, pad: int | None = None) -> DataFrame:
    """Packed shards of all documents (doc_id, text)."""
    bpe = WordBPE(vocabulary or default_vocabulary())
    pad = max(bpe.specials.values(), default=0) if pad is None else pad
    dtype = "<u2" if bpe.width <= 1 << 16 else "<u4"
    model = share(docs.sparkSession, bpe)

    def run(it: Iterator[pa.RecordBatch]):
        m, held_ids, held, size = model(), [], [], 0
        for b in it:
            _, offs = text_buffer(b.column(1))
            for lo, hi in row_blocks(offs, ENCODE_BYTES):
                for i, t in zip(b.column(0).slice(lo, hi - lo).to_pylist(), m.encode(b.column(1).slice(lo, hi - lo).to_pylist()), strict=True):
                    held_ids.append(i)
                    held.append(t.astype(dtype))
                    size += len(t)
                if size >= shard_tokens:
                    yield pack(held_ids, held, row_length, pad, dtype)
                    held_ids, held, size = [], [], 0
        if held:
            yield pack(held_ids, held, row_length, pad, dtype)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SHARD)


def unpack(shard: dict) -> Iterator[tuple[int, np.ndarray, int]]:
    """(doc_id, ids, number of segments) of a shard's documents, checked: the
    segment lengths fit the resets and the documents are without gaps."""
    row_length = shard["row_length"]
    flat = np.frombuffer(shard["ids"], f"<u{shard['id_bytes']}")
    cu, starts = np.frombuffer(shard["cu_lengths"], "<i4"), np.frombuffer(shard["row_starts"], "<i8")
    doc, begin, resets = (np.frombuffer(shard[k], "<i8") for k in ("segment_doc", "segment_start", "resets"))
    lengths = np.diff(cu)
    inner = np.ones(len(lengths), bool)
    inner[starts[1:-1] - 1] = False  # from one row to the next
    lengths = lengths[inner[: len(lengths)]]
    firsts = cu[:-1][inner] if len(cu) else cu
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts) - 1)
    if not (resets == row * row_length + firsts).all():
        raise ValueError("position resets do not fit the segment lengths")
    order = np.lexsort((begin, doc))
    edges = np.searchsorted(doc[order], np.arange(len(shard["doc_ids"]) + 1))
    for d, doc_id in enumerate(shard["doc_ids"]):
        own = order[edges[d] : edges[d + 1]]
        if not (begin[own] == np.cumsum(lengths[own]) - lengths[own]).all():
            raise ValueError(f"segments of document {doc_id} leave a gap")
        parts = [flat[resets[k] : resets[k] + lengths[k]] for k in own]
        yield doc_id, np.concatenate(parts) if parts else flat[:0], len(own)


RESULT = "doc_id long, n_tokens long, n_segments long, ids_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_segments", pa.int64()), ("ids_sha256", pa.string())])


def read_back(shards: DataFrame) -> DataFrame:
    """Per document, from the shards: tokens, segments and the digest of its
    ids as little-endian unsigned 32-bit integers."""

    def run(it):
        for b in it:
            for j in range(b.num_rows):
                rows = [(i, len(t), n, hashlib.sha256(t.astype("<u4").tobytes()).hexdigest()) for i, t, n in unpack({c: b.column(k)[j].as_py() for k, c in enumerate(b.schema.names)})]
                if rows:
                    yield batch(_RESULT, *zip(*rows, strict=True))

    return shards.mapInArrow(tidy(run), RESULT)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(materialise(pack_documents(table(spark, sf_dir, "documents", "doc_id", "text")), "packed"))
