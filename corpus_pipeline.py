"""The corpus pipeline: quality classifier, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet under the
shared folder and gives the reread table to the next stage. All but the last return the columns of
documents. A stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskpark.llm.common import ship, table, work_dir
from deskpark.llm.queries import PIECES, RADIUS, SHINGLE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts; it learns from the labelled rows of this stage's input."""
    from deskpark.llm import quality_classifier as q

    ship(spark)
    return q.keep_good(docs, q.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id."""
    from deskpark.llm import simhash

    ship(spark)
    return simhash.one_of_each_group(docs, SHINGLE, RADIUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no item of the benchmark."""
    from deskpark.llm import decontaminate

    ship(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts masked; n_chars is that of the new text where it was known."""
    from deskpark.llm import pii

    ship(spark)
    masked = docs.withColumn("text", pii.masked_column(F.col("text"), pii.train(docs)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return masked.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_equal of every row."""
    import public_tokenizers

    from deskpark.llm import sentencepiece_hf

    ship(spark)
    return sentencepiece_hf.encode(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("template_decontamination", decontamination),
    ("pii", personal_data),
    ("sentencepiece", tokens),
]

#: Trained models, bit counts and token merges are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
