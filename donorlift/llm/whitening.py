"""Embedding whitening (operator 12) with MLlib's BlockMatrix.

Vectors become integers x = floor(64 c) + 1,000,000.  Rows are gathered into
blocks of equal size where they are read, and written once; per-dimension sums S
are exact integers.  Centred rows (n x - S) / n, an integer difference and one
rounding, form the distributed blocks of a matrix: block i holds rows i R to
(i + 1) R, the last block of a partition is filled up with rows of zeros, which
add nothing.  The scatter is the transposed BlockMatrix times itself; its
middle dimension, the rows, is split over tasks, so that no task meets all
blocks of the one result block.  Its eigenvectors are found locally (numpy's
eigh on d x d numbers), and a BlockMatrix multiplication by the whitening matrix
(components divided by the roots of their eigenvalues) projects the rows.  For
that the blocks are laid out as a square-like grid against a block-diagonal
matrix that repeats the whitening matrix, because MLlib deals a grid of result
blocks to tasks by rows and columns alike: a single column of blocks would meet
only the square root of the tasks.  The covariance of the projected rows is
measured in the same way as the first, not derived.

More blocks than MATRIX_BLOCKS are taken as several matrices one after another,
since MLlib keeps the list of a matrix's blocks on the driver; their scatters
are added up.  Blocks and projections are Parquet tables, so a lost executor
costs its tasks only.

Defined results: vectors that are null or hold a null or a component that is not
finite are dropped; components beyond 2^46 in size count as that; vectors of
different lengths are fitted apart, each length with its own n, sums and
components; empty vectors give no rows, neither do components without variance
(at most LEAST of the greatest: in double precision the scatter does not tell
them well enough to whiten; so all of a single row);
null and repeated vec_ids are rows of their own; ``deviation`` is exact, and
null where it exceeds 64 bits; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from donorlift.llm.common import batch, materialise, share, table, tidy
from donorlift.llm.queries import query

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 46
COMPONENTS = 32
#: Share of the greatest variance up to which a component counts as constant.
LEAST = 1e-10
#: Numbers in one block of rows, blocks of one matrix, and bytes of blocks that
#: one task of a multiplication holds.
BLOCK_NUMBERS = 1 << 17
MATRIX_BLOCKS = 50_000
TASK_BYTES = 64 << 20


def integers(df: DataFrame) -> DataFrame:
    """(vec_id, x): the integer vectors of the rows that take part."""
    v = F.col("embedding")
    usable = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c.cast("double")))
    return df.where(usable).select("vec_id", F.transform(v, lambda c: (F.floor(held(c) * SCALE) + SHIFT).cast("long")).alias("x"))


_ROWS = pa.schema([("dims", pa.int32()), ("rows", pa.int32()), ("ids", pa.list_(pa.int64())), ("x", pa.binary())])


def row_blocks(vectors: DataFrame) -> DataFrame:
    """(dims, block, rows, ids, x): blocks of rows of equal length, packed and
    numbered in the order of the written partitions; block numbers of one length
    are 0, 1, 2, ... without gaps."""

    def run(it):
        held: dict[int, list] = {}
        for b in it:
            lens = b.column(1).value_lengths().to_numpy()
            flat = b.column(1).flatten().to_numpy()
            ahead = np.cumsum(lens) - lens
            for d in np.unique(lens).tolist():
                if d == 0:
                    continue
                at = np.flatnonzero(lens == d)
                have = held.setdefault(d, [[], []])
                have[0].append(b.column(0).take(pa.array(at)))
                have[1].append(flat[ahead[at][:, None] + np.arange(d)])
                if sum(map(len, have[1])) >= rows_of(d):
                    yield from cut(d, have, rows_of(d))
        for d, have in held.items():
            yield from cut(d, have, 1)

    def cut(d, have, least):
        ids, x = pa.concat_arrays(have[0]), np.concatenate(have[1])
        size = rows_of(d)
        while len(x) >= least:
            part, ids, x = (ids[:size], x[:size]), ids[size:], x[size:]
            yield batch(_ROWS, [d], [len(part[1])], pa.array([part[0]], pa.list_(pa.int64())), [packed(part[1])])
        have[0], have[1] = [ids], [x]

    made = vectors.mapInArrow(tidy(run), "dims int, rows int, ids array<long>, x binary")
    made = materialise(made.withColumn("at", F.monotonically_increasing_id()), "rows")
    # ordinal of a block of its length: those of earlier tasks, and earlier ones in its task
    by_task = made.groupBy("dims", F.shiftright("at", 33).cast("int").alias("task"))
    counts = by_task.agg(F.count("*").alias("n"), F.collect_list("at").alias("ats"))
    rows, before = [], {}
    for r in counts.select("dims", "task", "n").orderBy("dims", "task").collect():  # a row per task
        rows.append((r.dims, r.task, before.get(r.dims, 0)))
        before[r.dims] = before.get(r.dims, 0) + r.n
    first = made.sparkSession.createDataFrame(rows, "dims int, task int, ahead long")
    placed = counts.join(first, ["dims", "task"]).select("dims", "ahead", F.posexplode(F.array_sort("ats")).alias("k", "at"))
    placed = materialise(placed, "places", compact=True)
    return made.join(placed, ["dims", "at"]).select("dims", (F.col("ahead") + F.col("k")).alias("block"), "rows", "ids", "x")


def packed(x: np.ndarray) -> bytes:
    """x less the shift, in the least of 2, 4 or 8 bytes that holds all of it."""
    y = x - SHIFT
    most = int(np.abs(y).max(initial=0))
    return y.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def unpacked(x: pa.Scalar, rows: int, dims: int) -> np.ndarray:
    buf = x.as_buffer()
    return np.frombuffer(buf, f"<i{buf.size // (rows * dims)}").reshape(rows, dims).astype(np.int64) + SHIFT


def rows_of(dims: int) -> int:
    """Most rows in one block."""
    return max(16, BLOCK_NUMBERS // dims)


def sums(blocks: DataFrame) -> dict[int, tuple[int, list[int], int, int]]:
    """For each length: n, the sum of every dimension, the number of blocks and
    the rows of the largest."""

    def run(it):
        for b in it:
            for d, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                m = unpacked(x, n, d)
                low, high = (m & 0xFFFFFFFF).sum(0), (m >> 32).sum(0)  # no overflow inside a block
                yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)], ["dims", "dim", "n", "high", "low"])

    part = blocks.select("dims", "rows", "x").mapInArrow(tidy(run), "dims int, dim int, n long, high long, low long")
    whole = part.groupBy("dims", "dim").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.count("*").alias("blocks"), F.max("n").alias("most"))
    out: dict[int, tuple] = {}
    for r in whole.orderBy("dims", "dim").collect():
        so_far = out.get(r.dims, (r.n, [], r.blocks, r.most))[1]
        out[r.dims] = (r.n, [*so_far, (r.high << 32) + r.low], r.blocks, r.most)
    return out


def differences(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exactly: 64-bit where that holds them, else Python's integers."""
    small = int(np.abs(x).max(initial=0)) * n < 1 << 62 and max(map(abs, total)) < 1 << 62
    return x * np.int64(n) - np.array(total, np.int64) if small else x.astype(object) * n - np.array(total, object)


def deviations(diff: np.ndarray) -> list:
    """Sum of squares of each row, exactly; null beyond 64 bits."""
    if diff.dtype != object and int(np.abs(diff).max(initial=0)) ** 2 * diff.shape[1] < 1 << 63:
        return (diff * diff).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in row) for row in diff)]


_MATRIX = [("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())]
_BLOCK = pa.schema([("_1", pa.struct([("_1", pa.int64()), ("_2", pa.int64())])), ("_2", pa.struct(_MATRIX))])
BLOCK = StructType([StructField("_1", StructType([StructField("_1", LongType()), StructField("_2", LongType())])), StructField("_2", MatrixUDT())])


def block_matrix(numbers: DataFrame, read, across: int, size: int, width: int, count: int) -> BlockMatrix:
    """BlockMatrix of the blocks of ``numbers`` (block from 0, ...): ``read``
    gives a batch's rows as arrays of at most ``size`` x ``width``; block b
    lies in row b // across and column b % across of the grid."""

    def run(it):
        for b in it:
            for block, m in read(b):
                full = np.zeros((size, width))
                full[: len(m)] = m
                where = {"_1": block // across, "_2": block % across}
                matrix = {"type": 1, "numRows": size, "numCols": width, "colPtrs": None, "rowIndices": None, "values": full.ravel(), "isTransposed": True}
                yield pa.RecordBatch.from_arrays([pa.array([where], _BLOCK.field(0).type), pa.array([matrix], _BLOCK.field(1).type)], schema=_BLOCK)

    made = numbers.mapInArrow(tidy(run), BLOCK)
    grid_rows = -(-count // across)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", made, size, width, grid_rows * size, across * width), size, width)


def scatter(spark: SparkSession, blocks: DataFrame, read, size: int, width: int, count: int) -> np.ndarray:
    """Transposed rows times rows, width x width.  MLlib's second argument
    splits the middle dimension: each split is a task of its own."""
    tall = block_matrix(blocks, read, 1, size, width, count)
    splits = max(spark.sparkContext.defaultParallelism, -(-count * size * width * 16 // TASK_BYTES))
    splits = min(splits, count)
    left, right = tall.transpose(), tall
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, width, width).toLocalMatrix().toArray()


def project(spark: SparkSession, blocks: DataFrame, read, size: int, whitener: np.ndarray, count: int) -> DataFrame:
    """(block, z): every block of rows times the whitening matrix, as row-major
    doubles."""
    width, k = whitener.shape
    across = max(1, int(count**0.5))
    grid = block_matrix(blocks, read, across, size, width, count)
    one = Matrices.dense(width, k, whitener.ravel(order="F").tolist())
    diagonal = BlockMatrix(spark.sparkContext.parallelize([((j, j), one) for j in range(across)], min(across, 64)), width, k)
    product = grid.multiply(diagonal)  # the wrapper lets go of the JVM's matrix when it goes
    made = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model)

    def run(it):
        for b in it:
            where, m = b.column(0), b.column(1)
            for at, v in zip(where.to_pylist(), m, strict=True):
                i, j = at.values()
                block, z = i * across + j, np.asarray(v["values"].values)
                if block < count:
                    z = z.reshape(size, k) if v["isTransposed"].as_py() else z.reshape(k, size).T
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.ascontiguousarray(z).astype("<f8").tobytes()], pa.binary())], ["block", "z"])

    return made.mapInArrow(tidy(run), "block long, z binary")


def _reader(d: int, model, base: int):
    """Centred rows of integer blocks, numbered from ``base``."""

    def read(b):
        n, total = model()
        for block, rows, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            diff = differences(unpacked(x, rows, d), n, total)
            yield block - base, diff.astype(np.float64) / n

    return read


def _strips(blocks: DataFrame, count: int):
    """Parts of at most MATRIX_BLOCKS blocks: (first block, number, table)."""
    for base in range(0, count, MATRIX_BLOCKS):
        yield base, min(MATRIX_BLOCKS, count - base), blocks.where((F.col("block") >= base) & (F.col("block") < base + MATRIX_BLOCKS))


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per vector of ``vectors`` (vec_id, x) and component, as OUT."""
    spark = vectors.sparkSession
    blocks = row_blocks(vectors)
    out = spark.createDataFrame([], OUT)
    for d, (n, total, count, size) in sums(blocks).items():  # lengths of vectors
        model = share(spark, (n, total))
        own = blocks.where(F.col("dims") == d)
        found = np.zeros((d, d))
        for base, part, strip in _strips(own.select("block", "rows", "x"), count):
            found += scatter(spark, strip, _reader(d, model, base), size, d, part)
        values, vectors_ = np.linalg.eigh((found + found.T) / (2 * n))
        values, vectors_ = values[::-1], vectors_[:, ::-1]
        trace, k = float(values.sum()), int((values[:components] > LEAST * max(values[0], 0)).sum())
        if k == 0:
            continue
        whitener = vectors_[:, :k] / np.sqrt(values[:k])
        parts = [project(spark, strip, _reader(d, model, base), size, whitener, part).withColumn("block", F.col("block") + base) for base, part, strip in _strips(own.select("block", "rows", "x"), count)]
        projected = parts[0]
        for p in parts[1:]:
            projected = projected.unionAll(p)
        projected = materialise(projected, "projected")
        again = np.zeros((k, k))
        for base, part, strip in _strips(projected, count):
            again += scatter(spark, strip, _plain(k, size, base), size, k, part)
        error = float(np.abs(again / n - np.eye(k)).max())
        out = out.unionAll(_rows(own, projected, d, k, n, model, values[:k] / trace, error))
    return out


def _plain(k: int, size: int, base: int):
    def read(b):
        for block, z in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            yield block - base, np.frombuffer(z.as_buffer(), "<f8").reshape(size, k)

    return read


def _rows(blocks: DataFrame, projected: DataFrame, d: int, k: int, n: int, model, explained: np.ndarray, error: float) -> DataFrame:
    """The blocks' ids beside their projections, a row per component."""

    def run(it):
        _, total = model()
        for b in it:
            for ids, x, z in zip(b.column(0), b.column(1), b.column(2), strict=True):
                ids = ids.values
                rows = len(ids)
                dev = deviations(differences(unpacked(x, rows, d), n, total))
                w = np.frombuffer(z.as_buffer(), "<f8").reshape(-1, k)[:rows]
                each = pa.array(np.repeat(np.arange(rows), k))
                yield batch(_OUT, ids.take(each), np.tile(np.arange(1, k + 1, dtype=np.int32), rows), np.full(rows * k, n), pa.array(dev, pa.int64()).take(each), w.ravel(), np.tile(explained, rows), np.full(rows * k, error))

    return blocks.join(projected, "block").select("ids", "x", "z").mapInArrow(tidy(run), OUT)


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(integers(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))
