"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Stages work on all rows that the stage before kept and return the columns of documents; the last one adds the ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import wayfold
from wayfold.llm import bpe, decontaminate, linededup, neardup, store, toxicity

# Kernels travel to the executors by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(wayfold)


#: Similarity from which the near dedup stage calls documents near duplicates; op7's contract has 85.
NEAR_PERCENT = 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; the model is learned from the labels of those that have one."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, keep=docs.columns)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document with a smaller id has too; n_chars follows the text."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    gone = neardup.near_duplicates(docs, percent=NEAR_PERCENT).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ids, restored (whether the ids decode to the text's bytes) and n_tokens; a name that the
    documents have already gets underscores at its end."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(docs, ranks, restored="restored")
    n_tokens = store.free_names(["n_tokens"], coded.columns)[0]
    return coded.withColumn(n_tokens, F.size(coded.columns[-2]).cast("long"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte-level BPE", bpe_stage),
]

#: Learned weights, sketches and token ids are not for SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
