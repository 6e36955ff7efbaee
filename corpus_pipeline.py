"""The corpus pipeline: quality rules, quality classifier, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Every stage takes all that its predecessor kept, written as Parquet and reread. The first four return the columns of
documents; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import ngram_join, quality_knn, quality_rules, suffix_dedup, token_pack
from fieldloom.llm.common import bounded_batches, delete_written, materialize, written

BATCH_ROWS = 1000  # documents that a worker gets at once
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; lines that are frequent on their host are removed from the text."""
    bounded_batches(spark, BATCH_ROWS)
    return quality_rules.kept_documents(docs.select(*COLUMNS))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, takes for good."""
    bounded_batches(spark, BATCH_ROWS)
    docs = docs.select(*COLUMNS)
    model = quality_knn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_knn.score_documents(docs, model).where("score >= 0.3").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates."""
    bounded_batches(spark, BATCH_ROWS)
    docs = docs.select(*COLUMNS)
    gone = ngram_join.jaccard_components(docs, with_links=False).where("component_id <> doc_id").select("doc_id")
    return docs.join(materialize(gone, "gone"), "doc_id", "left_anti").select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without bytes that repeat earlier strings of 100 bytes; what is left of a cut character goes too."""
    bounded_batches(spark, BATCH_ROWS)
    out = suffix_dedup.remove_repeats(docs.select(*COLUMNS), as_text=True)
    changed = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return changed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens."""
    bounded_batches(spark, BATCH_ROWS)
    return token_pack.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), block=1 << 20)


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the classifier, nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and reread; what a stage has read and written on the way
    is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
            delete_written(spark, mark, keep=1)
    return docs
