"""The corpus pipeline: quality filter, line dedup, near-duplicate removal, benchmark
decontamination, BPE encoding.

Every stage takes all that the one before kept, written as Parquet in the shared
folder and read again, so a lost executor costs tasks of one stage only. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daycast.llm import bpe, decontaminate, jaccard, lines, quality
from daycast.llm.common import prepare, table
from daycast.session import checkpoint_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score >= 0.5)."""
    prepare(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals.

    A document that loses its last word this way goes; one that had none stays.
    ``n_chars`` follows the text where lines went.
    """
    prepare(spark)
    out = lines.dedup(docs).where("__left > 0 or __dropped = 0")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.char_length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents, the one with the smallest id; rows of one id
    are one document, which stays or goes whole; rows without an id stay."""
    prepare(spark)
    groups = jaccard.groups(docs)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    key = F.col("doc_id").cast("long")
    return (docs.where("doc_id is not null").join(first, key == F.col("__id"), "left_semi")
            .unionByName(docs.where("doc_id is null")))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded text."""
    from daycast.llm.queries import vocabulary_path
    prepare(spark)
    return bpe.digest(docs, vocabulary_path(), with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", decontaminate_documents),
    ("BPE encoding", encode_documents),
]

# Learned scores, near-duplicate joins and merges are beyond SQL; tests compare
# the stages with brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and reread."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
