"""A corpus from raw documents to token ids in five stages, each over all that the stage before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next.
All stages but the last return the columns of docs, whatever their names and also further ones, and tell rows apart by
id and text; an empty table gives an empty one. Null texts count as empty and stay null where they are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, ngram_join, pieces, pii, quality
from tidemark.llm.shared import durable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and short texts by the base rules. Repeated rows are judged each."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    measures = durable(quality.features(docs), "quality-measures")
    chosen = quality.cutoffs(measures, labels)
    return quality.judged(quality.features(docs, carry=True), chosen).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the row with the least (doc_id, hash of the text) stays.

    Repeats of id and text count once. Null ids, and null and empty texts with an id of their own, stay.
    """
    return ngram_join.deduplicated(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go; rows with a null id are judged as well, null and empty texts stay."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text. No row goes, repeated rows stay."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else out


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them for each row; a null or empty text has the end id alone."""
    return pieces.encoded(docs, pieces.model_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentence_pieces", sentence_pieces),
]

#: No SQL expresses the stages (certified cutoffs, retrieval, merges); tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
