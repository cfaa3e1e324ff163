"""Mixing sources to target weights (operator 11) by hash-threshold histograms.

Every document has a 60-bit hash of its id and text.  Words are summed by
(source, leading hash bits); running sums over these at most 4,096 buckets of a
source say in which bucket its budget ends.  Only that bucket is read again, by
its next bits, until it holds few rows; then the hash value is found at which
the taken words come nearest to the budget.  The mix is a filter on the hash:
nothing is sorted, a rerun takes the same rows, and since every budget of a
source is a threshold on the same hash, the rows of a smaller budget are among
those of a greater one.

Targets: sources in code point order, null last, weigh ``weights`` in turn and
share the budget; a target stops at ``cap`` times its source's words, and the
excess is shared again by weight until none is above.  With shares of water
level l, sum(min(cap, weight * l)) = budget; l is found by Newton steps, each an
aggregation over the sources that ends in one row.  A target of r whole sources
and a rest takes every document r times, and those under the threshold once more.

All of it are DataFrame operations.  Rows are aggregated per (source, bucket)
before they are shuffled, so a hot source costs no more than any other; per
source tables are broadcast after their count, else joined in salted parts.

Defined results: null texts have no words; a null id hashes like a blank one;
rows of equal id and text have equal hashes and go together, also where they
repeat; sources without words have target 0; a mix of no words takes nothing;
empty tables give no rows; other columns are not read, or pass unchanged
(``mixed``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from donorlift.llm.common import materialise, table
from donorlift.llm.queries import query
from donorlift.operators.ordering import with_positions

WEIGHTS = (5, 2, 1)
CAP = 3
#: Bits of a hash, and of one level of the histogram.
BITS, LEVEL = 60, 12
#: A boundary bucket of at most so many rows is summed by whole hashes.
FINE_ROWS = 4_096
#: Tables of one row per source and budget up to this are broadcast; larger
#: ones are joined in so many salted parts.
BROADCAST_SOURCES = 100_000
PARTS = 16


def words_in(text: Column) -> Column:
    """Number of runs of characters that are not spaces or tabs to returns.
    Each run becomes one letter, then what is no letter goes: the memory is
    that of the text, not of a list of words."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(runs, " \t\n\x0b\f\r", "")).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 leading bits of the MD5 of an id and its text's MD5."""
    of = F.concat(F.coalesce(doc_id.cast("string"), F.lit(" ")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(of.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def with_source(rows: DataFrame, per_source: DataFrame, on: Column | None = None) -> DataFrame:
    """Inner join of rows (with source and h) and a table by source, null
    sources included; the table's source column is named ``of``."""
    same = F.col("source").eqNullSafe(F.col("of"))
    if on is not None:
        same = same & on
    if per_source.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(per_source), same)
    spread = per_source.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    salted = rows.withColumn("_salt", F.pmod("h", F.lit(PARTS)).cast("int"))
    return salted.join(spread, same & (F.col("_salt") == F.col("_part"))).drop("_salt", "_part")


def water_level(sources: DataFrame, budget: int) -> tuple[int, int]:
    """(num, den): sum(min(cap, weight * num / den)) over the sources is the
    budget.  Every step takes the sources below the level as capped."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    num, den = budget, 0
    while True:
        above = wide("cap") * F.lit(den) < wide("weight") * F.lit(num).cast("decimal(38,0)") if den else F.lit(False)
        got = sources.agg(F.sum(F.when(above, F.col("cap"))).alias("c"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if not got.w or (budget - (got.c or 0), got.w) == (num, den):  # all capped, or settled
            return num, max(1, den)
        num, den = budget - (got.c or 0), got.w


def thresholds(narrow: DataFrame, shares: Sequence[float] = (1.0,), weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(of, source_size, mix) for every source of ``narrow`` (source, size, h):
    mix is an array of (target, repeats, limit), one for each share of all words
    that the mix shall have; rows of h <= limit are taken once more."""
    first = F.shiftright("h", BITS - LEVEL).alias("p")
    histogram = materialise(narrow.groupBy("source", first).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "histogram", compact=True)
    sized = histogram.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("unknown", F.col("source").isNull())
    placed = with_positions(sized, [("unknown", True), ("source", True)])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_pos") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = materialise(
        placed.select(F.col("source").alias("of"), "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * cap).alias("cap")), "sources", compact=True
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    goals = None
    for k, share in enumerate(shares):
        num, den = water_level(sources, min(cap * total, round(share * total)))
        level = F.col("weight") * F.lit(float(num)) / F.lit(float(den))
        goal = sources.select("of", "source_size", F.lit(k).alias("k"), F.least(F.col("cap").cast("double"), level).alias("target"))
        goals = goal if goals is None else goals.unionAll(goal)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("repeats", whole).withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size"))
    goals = materialise(goals, "goals", compact=True)

    # the bucket in which each budget ends, level by level
    ends = goals.select("of", "k", "rest", F.lit(0).cast("long").alias("prefix"))
    bits = LEVEL
    while True:
        ends = materialise(_ending(histogram, ends, bits == BITS), "ends", compact=True)
        if bits == BITS:
            break
        most = ends.agg(F.max("n")).first()[0]
        step = BITS - bits if most is None or most <= FINE_ROWS else LEVEL
        inside = F.shiftright("h", BITS - bits) == F.col("prefix")
        bits += step
        finer = F.shiftright("h", BITS - bits).alias("p")
        rows = with_source(narrow, ends.select("of", "prefix").distinct(), inside)
        # one row per (source, open bucket, bucket inside it); budgets may share a bucket
        histogram = rows.groupBy("source", "prefix", finer).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    limit = F.col("prefix") - F.when(F.col("words") - F.col("rest") < F.col("rest"), 0).otherwise(1)
    found = ends.select(F.col("of").alias("at"), F.col("k").alias("at_k"), limit.alias("limit"))
    every = (1 << BITS) - 1  # a budget that ends in no bucket takes the whole source
    mix = goals.join(found, F.col("of").eqNullSafe(F.col("at")) & (F.col("k") == F.col("at_k")), "left")
    one = F.struct("k", "target", "repeats", F.coalesce("limit", F.lit(every)).alias("limit"))
    return materialise(mix.groupBy("of", "source_size").agg(F.array_sort(F.collect_list(one)).alias("mix")), "thresholds", compact=True)


def _ending(histogram: DataFrame, ends: DataFrame, last: bool) -> DataFrame:
    """For each (of, k, rest, prefix): the bucket p of the histogram in which
    running words pass the rest, as the new prefix, and the rest within it."""
    same = F.col("source").eqNullSafe(F.col("of"))
    if "prefix" in histogram.columns:
        histogram = histogram.withColumnRenamed("prefix", "outer")
        same = same & (F.col("outer") == F.col("prefix"))
    met = histogram.join(ends.select("of", "k", "rest", "prefix"), same)
    upto = F.sum("words").over(Window.partitionBy("of", "k").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("after", upto).withColumn("before", F.col("after") - F.col("words"))
    hit = met.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("after")))
    return hit.select("of", "k", (F.col("rest") - F.col("before")).alias("rest"), F.col("p").alias("prefix"), "words", "n")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of every document, written once."""
    return materialise(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h")), "sized")


def copies_of(k: int) -> Column:
    """How often a row is in the mix of the k-th share."""
    m = F.col("mix")[k]
    return m["repeats"] + F.when(F.col("h") <= m["limit"], 1).otherwise(0)


def mixed(docs: DataFrame, shares: Sequence[float] = (1.0,), weights: Sequence[int] = WEIGHTS, cap: int = CAP, k: int = 0) -> DataFrame:
    """The documents of the mix of the k-th share, each as often as it is
    taken, with the columns of ``docs``."""
    per_source = thresholds(sized(docs), shares, weights, cap)
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    taken = with_source(rows, per_source).withColumn("copies", copies_of(k)).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ' '), ':', md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((pos - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS w, 3 * source_size AS cap FROM s),
f AS (SELECT a.pos, (SELECT sum(source_size) FROM s) - coalesce(sum(b.cap) FILTER (b.cap * a.w < a.cap * b.w), 0) AS num,
             sum(b.w) FILTER (b.cap * a.w >= a.cap * b.w) AS den FROM w a, w b GROUP BY a.pos),
l AS (SELECT arg_max(CAST(num AS DOUBLE), num / den) AS num, arg_max(CAST(den AS DOUBLE), num / den) AS den FROM f),
p AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w.w * num / den) AS target FROM w, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM p),
c AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.repeats, q.target - q.repeats * q.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS after, sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       size * (repeats + CASE WHEN after <= rest OR (after - same <= rest AND after - rest < rest - (after - same)) THEN 1 ELSE 0 END) AS taken FROM c
"""


@query("op11_mixing", SQL)
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sized(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    met = with_source(rows, thresholds(rows))
    return met.select("doc_id", "size", "source_size", F.col("mix")[0]["target"].alias("target"), (F.col("size") * copies_of(0)).alias("taken"))
