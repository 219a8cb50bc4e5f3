"""The corpus pipeline: five stages, each written and read again as the next one's documents.

Defined results: an empty table gives an empty one. Null and empty texts are never toxic or contaminated and lose
no passage; of all documents without words one stays, as of all other near-duplicates. Rows are told apart by id and
text, so null or shared ids cost no unlike text; of rows that repeat in full one stays. Of a group of near-duplicates
the least doc_id stays (null last; a hash of the text decides ties). Columns besides doc_id, text, lang, source and
n_chars are ignored, whatever their names. The last stage has a row for each document left, with the words taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, mixing, simhash, suffix_tree, toxicity
from tessera.llm.common import shared_dir, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go; the fold kept for testing is not learned from."""
    small_batches(spark)
    model = toxicity.fitted(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"), folds=5)
    return toxicity.clean(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a similarity of 0.8 or more on five-word shingles, one stays."""
    small_batches(spark)
    return simhash.representatives(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside passages of 35 words or more that also occur elsewhere are cut out; n_chars follows."""
    small_batches(spark)
    found = suffix_tree.deduplicated(docs.select("doc_id", "text", "lang", "source", "n_chars"), keep=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return found.select("doc_id", "text", "lang", "source", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    small_batches(spark)
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mixed(docs.select("doc_id", "text", "source"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
]

#: Fingerprints and edit distances have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
