"""File sources and sinks.

S1  comma-separated member files read with every column as text, per-column
    missing-value codes turned into NULL in one projection (a blank is a
    value for flag columns, so ``nullValue`` is left unset);
S4/S5  stage tables written to / read from Parquet under a store root;
S6  a stage is produced on demand: read it if stored, else build it from
    the stage before it and store it (a Parquet cut between stages);
S2  the targets file of the validation set: (key, responded, amount);
S3  the centroid file, its columns renamed to (key, lat, lon);
S9  the result file: (key, predicted amount) as CSV, written and read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_coded_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    na_codes: Mapping[str, Sequence[str]] | None = None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """All columns as strings (never inferred), then per-column NA
    codes -> NULL and ``try_cast`` to the given types, in one select."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    na_codes = na_codes or {}
    types = types or {}
    out = []
    for c in columns:
        e = F.col(c)
        codes = list(na_codes.get(c, []))
        if codes:
            e = F.when(e.isin(codes), F.lit(None).cast("string")).otherwise(e)
        if c in types:
            e = e.try_cast(types[c])
        out.append(e.alias(c))
    return raw.select(*out)


def write_result_csv(df: DataFrame, key: str, value: str, path: str) -> None:
    """The result file of the cup, (key, predicted amount)."""
    df.select(key, value).write.mode("overwrite").option("header", True).csv(path)


def read_result_csv(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """S9 read back: one row per line; a value that is no number is null."""
    return read_coded_csv(spark, path, [key, value], types={key: "bigint", value: "double"})


def read_targets(spark: SparkSession, path: str, key: str, flag: str, amount: str) -> DataFrame:
    """The targets of a validation set, to be attached by ``key``."""
    return read_coded_csv(spark, path, [key, flag, amount], types={key: "bigint", flag: "int", amount: "double"})


def read_centroids(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """S3: the file's key, latitude and longitude ``columns`` as (key, lat,
    lon), numbers; lines without a key are left out."""
    types = dict(zip(columns, ("bigint", "double", "double"), strict=True))
    rows = read_coded_csv(spark, path, columns, types=types)
    return rows.toDF("key", "lat", "lon").where(F.col("key").isNotNull())


class StageStore:
    """Stages as Parquet directories under ``root`` (a shared folder
    on a cluster).  ``provide`` returns a stored stage or builds it from the
    stage it depends on, stores it, and returns the stored copy."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(jvm.org.apache.hadoop.fs.Path(self.path(name) + "/_SUCCESS"))

    def read(self, name: str) -> DataFrame | None:
        """The stored stage, or None when it is missing."""
        return self.spark.read.parquet(self.path(name)) if self.exists(name) else None

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """S4."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def provide(
        self,
        name: str,
        stages: Sequence[str],
        build: Mapping[str, Callable[[DataFrame | None], DataFrame]],
    ) -> DataFrame:
        """``stages`` is the ordered stage list; ``build[s]`` makes stage
        s from the previous stage (None for the first)."""
        got = self.read(name)
        if got is not None:
            return got
        i = list(stages).index(name)
        prev = self.provide(stages[i - 1], stages, build) if i > 0 else None
        return self.write(name, build[name](prev))
