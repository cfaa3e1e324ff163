"""Connected components of an edge table, by least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlift.llm.common import materialise


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the least
    node of its component.

    Each round gives every node the least label among its own and its
    neighbours' (an aggregation), then replaces it by that label's own label.
    Rounds go on until nothing changes; each one is written to the shared
    folder.  Only node rows move by label, through joins that Spark can split
    where one label is hot.  ``rows``: a bound of the number of edges, if known.
    """
    edges = materialise(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", compact=True, rows=rows)
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels", compact=True, rows=rows)
    while True:
        of = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        near = both.join(of, "a").select(F.col("b").alias("node"), F.col("la").alias("label")).unionAll(labels.select("node", "label"))
        least = materialise(near.groupBy("node").agg(F.min("label").alias("label")), "labels", compact=True, rows=rows)
        up = least.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        short = materialise(least.join(up, "label").select("node", F.col("higher").alias("label")), "labels", compact=True, rows=rows)
        changed = short.join(labels.select("node", F.col("label").alias("old")), "node").where(F.col("label") != F.col("old"))
        if changed.isEmpty():
            return short
        labels = short
