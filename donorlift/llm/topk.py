"""Exact top-k search (operator 6) over a bit-sliced index.

Components are quantised to integers, floor(1024 x).  The index cuts the rows
into blocks; in a block each attribute, less its least value there, is stored
as bit slices: bitmap b holds bit b of all rows.  The score of a query is a sum
of attribute values times query weights, that is of slices times powers of two:
weights are split into signed powers of two, slices of equal weight are added
by carry-save bitmap adders (three bitmaps in, a sum and a carry out), for all
rows of a block together, until every power has one bitmap left.  Negative
terms are added up in the same way, as complements.  The slices are stored once,
in the index table, and used from there by every tile of queries.

The best rows of a block are selected from the most significant slice downward:
if enough candidates have a one there, the others leave, else those with a one
are taken.  Rows equal to the last place are resolved exactly by vec_id.  The
best rows of all blocks are merged by a window with a rank limit before the
shuffle.

Defined results: vectors that are null or hold a null or a component that is
not finite take no part; components count as at most 2^63 / 1024 in size; rows
are ranked by their exact scores at any size, of which the score column holds
the nearest 64-bit value (so far beyond it, the least or greatest one); fewer
than k other rows give fewer results; vectors of other lengths
than a query's are no candidates of it; repeated vec_ids are rows of their own
and rank by score, id; a query's own row is every row with its id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from donorlift.llm.common import batch, materialise, table, tidy
from donorlift.llm.queries import query

SCALE = 1024
K = 10
#: Rows of one index block and queries of one block of queries.
BLOCK_ROWS = 1 << 15
BLOCK_QUERIES = 256
#: Blocks of queries that meet a block of rows in one tile.
TILE_BLOCKS = 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): integer vectors of the rows that take part."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(usable).select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("q"))


class SlicedBlock:
    """Bit slices of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, slices: list[list[np.ndarray]]):
        self.ids, self.least, self.slices = ids, least, slices
        words = -(-len(ids) // 64)
        self.valid = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)

    @classmethod
    def sliced(cls, ids: np.ndarray, q: np.ndarray) -> SlicedBlock:
        least = q.min(0)
        off = q.astype(np.uint64) - least.astype(np.uint64)  # modulo 2^64: right for any spread
        words = -(-len(ids) // 64)
        slices = []
        for k in range(q.shape[1]):
            col = off[:, k]
            bits = []
            for b in range(int(col.max()).bit_length()):
                on = np.zeros(words * 64, np.uint8)
                on[: len(ids)] = (col >> np.uint64(b)) & np.uint64(1)
                bits.append(np.packbits(on, bitorder="little").view(np.uint64))
            slices.append(bits)
        return cls(ids, least, slices)

    def stored(self) -> bytes:
        """Least values, number of slices of each attribute, slices."""
        widths = np.array([len(bits) for bits in self.slices], np.int64)
        return b"".join([self.least.astype("<i8").tobytes(), widths.tobytes(), *[s.tobytes() for bits in self.slices for s in bits]])

    @classmethod
    def loaded(cls, ids: np.ndarray, dims: int, data) -> SlicedBlock:
        least, widths = np.frombuffer(data, "<i8", dims), np.frombuffer(data, "<i8", dims, 8 * dims)
        words = -(-len(ids) // 64)
        bits = np.frombuffer(data, np.uint64, offset=16 * dims).reshape(int(widths.sum()), words)
        ends = np.cumsum(widths)
        return cls(ids, least, [list(bits[e - w : e]) for e, w in zip(ends.tolist(), widths.tolist(), strict=True)])

    def score_slices(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of weights . vector for all rows, least significant first,
        and the number to add to their value."""
        offset = int(sum(int(w) * int(m) for w, m in zip(weights, self.least, strict=True)))
        terms: dict[int, list[np.ndarray]] = {}
        for w, bits in zip(weights.tolist(), self.slices, strict=True):
            for power, sign in signed_powers(w):
                for b, s in enumerate(bits):
                    if sign > 0:
                        terms.setdefault(b + power, []).append(s)
                    else:  # -s = (1 - s) - 1
                        terms.setdefault(b + power, []).append(~s)
                        offset -= 1 << (b + power)
        out, power = [], 0
        while terms:
            here = terms.pop(power, [])
            up = terms.get(power + 1, [])
            while len(here) > 2:
                a, b, c = here.pop(), here.pop(), here.pop()
                half = a ^ b
                up.append((a & b) | (half & c))
                here.append(half ^ c)
            if len(here) == 2:
                a, b = here
                up.append(a & b)
                here = [a ^ b]
            if up:
                terms[power + 1] = up
            out.append(here[0] if here else np.zeros(len(self.valid), np.uint64))
            power += 1
        return out, offset

    def best(self, weights: np.ndarray, own, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows, without rows of id ``own``."""
        slices, offset = self.score_slices(weights)
        left = self.valid.copy()
        for row in np.flatnonzero(self.ids == own).tolist():
            left[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        taken, need = np.zeros(len(left), np.uint64), k
        for s in reversed(slices):  # most significant first
            ones = left & s
            n = int(np.bitwise_count(ones).sum())
            if n > need:
                left = ones
            else:
                taken |= ones
                need -= n
                left &= ~s
                if need == 0:
                    break
        sure, tied = rows_of(taken), rows_of(left) if need else np.zeros(0, np.int64)
        tied = tied[np.argsort(self.ids[tied], kind="stable")[:need]]  # equal scores: smaller ids
        rows = np.concatenate([sure, tied])
        kind = np.int64 if len(slices) < 62 and abs(offset) < 1 << 62 else object  # Python's integers hold any score
        scores = np.full(len(rows), offset, kind)
        for power, s in enumerate(slices):
            on = ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            scores = scores + on.astype(kind) * (1 << power)
        return self.ids[rows], scores


def signed_powers(w: int) -> list[tuple[int, int]]:
    """w as a sum of signed powers of two, no two of them adjacent."""
    out, power = [], 0
    while w:
        if w & 1:
            sign = 2 - (w & 3)
            out.append((power, sign))
            w -= sign
        w >>= 1
        power += 1
    return out


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


_HELD = pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("q", pa.binary())])
HELD = "dims int, ids binary, q binary"


def plain(ids: np.ndarray, q: np.ndarray) -> bytes:
    return q.astype("<i8").tobytes()


def slices(ids: np.ndarray, q: np.ndarray) -> bytes:
    return SlicedBlock.sliced(ids, q).stored()


def blocks(vectors: DataFrame, rows: int, form) -> DataFrame:
    """Rows (dims, ids, q): vectors of equal length, a block in each, as
    ``form(ids, vectors)``."""

    def run(it):
        held: dict[int, list] = {}
        for b in it:
            q = b.column(1)
            lens = q.value_lengths().to_numpy()
            ids = b.column(0).to_numpy()
            flat = q.flatten().to_numpy()
            ahead = np.cumsum(lens) - lens
            for d in np.unique(lens).tolist():
                at = np.flatnonzero(lens == d)
                m = flat[ahead[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0), np.int64)
                have = held.setdefault(d, [np.zeros(0, np.int64), np.zeros((0, d), np.int64)])
                have[0], have[1] = np.concatenate([have[0], ids[at]]), np.concatenate([have[1], m])
                while len(have[0]) >= rows:
                    yield batch(_HELD, [d], [have[0][:rows].tobytes()], [form(have[0][:rows], have[1][:rows])])
                    have[0], have[1] = have[0][rows:], have[1][rows:]
        for d, (ids, m) in held.items():
            if len(ids):
                yield batch(_HELD, [d], [ids.tobytes()], [form(ids, m)])

    return vectors.mapInArrow(tidy(run), HELD)


#: A score is high * 2^62 + low.
LOW = (1 << 62) - 1
RESULT = "query_id long, vec_id long, high decimal(38,0), low long"
_RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("high", pa.decimal128(38, 0)), ("low", pa.int64())])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` (vec_id, q)
    for every row of ``queries`` (vec_id, q)."""
    index = materialise(blocks(vectors, BLOCK_ROWS, slices).withColumn("block", F.monotonically_increasing_id()), "slices")
    asked = materialise(blocks(queries, BLOCK_QUERIES, plain).withColumn("block", F.monotonically_increasing_id()), "queries")
    # tiles: a block of rows and a few blocks of queries; both sides are sent to
    # the tiles of their row or column, so no task meets all of either
    across, down = max(1, index.count()), max(1, -(-asked.count() // TILE_BLOCKS))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    rows = index.withColumn("i", place(across)).withColumn("j", spread(down))
    sought = asked.select("dims", F.col("ids").alias("q_ids"), F.col("q").alias("q_q"), place(down).alias("j")).withColumn("i", spread(across))
    pairs = rows.join(sought, ["dims", "i", "j"])

    def run(it):
        last, held = None, None
        for b in it:
            for j in range(b.num_rows):
                block, d = b.column(0)[j].as_py(), b.column(3)[j].as_py()
                if block != last:
                    held, last = SlicedBlock.loaded(np.frombuffer(b.column(1)[j].as_py(), np.int64), d, b.column(2)[j].as_py()), block
                q_ids = np.frombuffer(b.column(4)[j].as_py(), np.int64)
                weights = np.frombuffer(b.column(5)[j].as_py(), "<i8").reshape(len(q_ids), d)
                for q, w in zip(q_ids.tolist(), weights, strict=True):
                    ids, scores = held.best(w, q, k)
                    yield batch(_RESULT, np.full(len(ids), q), ids, [int(v) >> 62 for v in scores], [int(v) & LOW for v in scores])

    found = pairs.select("block", "ids", "q", "dims", "q_ids", "q_q").mapInArrow(tidy(run), RESULT)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id"))
    # high * 2^62 + low, or the end of the 64-bit range that it lies beyond
    score = F.when(F.col("high") > 1, F.lit((1 << 63) - 1)).when(F.col("high") < -2, F.lit(-(1 << 63))).otherwise(F.col("high") * (1 << 62) + F.col("low"))
    found = found.withColumn("score", score.cast("long"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op6_topk", SQL)
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
