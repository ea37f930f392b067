"""Registered queries of the text operators: thin, whole-table, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from daycast.llm import (audit, bpe, curve, decontaminate, html, jaccard, lines, maxent, negatives, quality, tokenfile,
                         toxicity, vectors)
from daycast.llm.common import fold, prepare, table

WORD_VOCABULARY = "word_bpe_49k.json"
QUALITY_FOLDS, QUALITY_HELD = 3, 1
LM_FOLDS, LM_HELD = 7, 2
LM_WORD_ROUNDS = 1                 # gradient rounds over the features of words


def _scored(docs: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    held = F.coalesce(fold("doc_id", QUALITY_FOLDS) == QUALITY_HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, quality.score(docs, weights), 0.5)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs).select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), "text")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return html.extract(table(spark, sf_dir, "pages"))


def op6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(WORD_VOCABULARY)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    learn = F.coalesce(fold("doc_id", LM_FOLDS) != LM_HELD, F.lit(True))
    return maxent.score(docs, learn, maxent.train(docs, learn, LM_WORD_ROUNDS))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, toxicity.score(docs, model), 0.7)


def op9_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = tokenfile.new_folder(spark)
    tokenfile.write(table(spark, sf_dir, "documents"), vocabulary_path(), folder)
    return tokenfile.read(spark, folder)


def op11_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return curve.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_quality": op1_quality,
    "op2_jaccard": op2_jaccard,
    "op3_lines": op3_lines,
    "op4_html": op4_html,
    "op5_bpe": op5_bpe,
    "op6_templates": op6_templates,
    "op7_maxent": op7_maxent,
    "op8_toxicity": op8_toxicity,
    "op9_pca": op9_pca,
    "op10_repair": op10_repair,
    "op11_hilbert": op11_hilbert,
    "op12_audit": op12_audit,
    "op13_negatives": op13_negatives,
}
SQL: dict[str, str] = {"op12_audit": audit.SQL, "op13_negatives": negatives.SQL}
