"""The corpus pipeline: from raw documents to token ids.

Five stages, each calling one training-data operator on all that its
predecessor kept: language identification (rejected documents go), toxicity
(toxic documents go), n-gram Jaccard join (the document with the least id of
each group of near copies stays), benchmark decontamination (hit spans are cut
out of the texts, documents stay), BPE encoding and decoding.  Every stage's
result is written as Parquet in the shared folder and read again by the next.

All stages but the last return the columns of the documents they were given.
Fitted stages learn from the documents they are given.  Defined results: null
texts and texts without a letter leave at the first stage; repeated rows leave
at the third; empty tables give empty results; extra columns pass through the
first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from donorlift.llm.bpe import bpe_digests
from donorlift.llm.common import materialise, table
from donorlift.llm.decontam import decontaminate
from donorlift.llm.langid import fit_language_models, keeps_language
from donorlift.llm.ngram_join import one_of_each
from donorlift.llm.toxicity import fit_toxicity, keeps_clean


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keeps_language(docs, fit_language_models(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keeps_clean(docs, fit_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

#: Fitted models and byte-pair merges are not SQL; tests/llm holds the pipeline
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
