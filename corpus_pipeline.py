"""From raw documents to a training mix: quality, near-duplicates, test items, personal data, source weights.

``STAGES`` are applied in turn; each one's rows are written as Parquet and read again as the next one's
input. All but the last return the columns of ``documents``; the last returns the mix: which
documents are taken, and how many words of each (over its size where a document is taken again).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstream.llm import decontaminate, mixing, pii, quality, simhash
from gavelstream.llm.common import bounded, few, written
from gavelstream.llm.queries import held_out


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject (score under 0.5); it learns from the labels that are not held out."""
    bounded(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    return quality.scored(docs, model, score_col="quality_score").where("quality_score >= 0.5").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group tied by fingerprints within three bits."""
    bounded(spark)
    return simhash.representatives(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the five-word shingles of every benchmark item; items of fewer words are looked for whole."""
    bounded(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named, unnamed = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    found = decontaminate.contained(named, items, short_items=True).select("doc_id").distinct()
    kept = named.join(few(found), "doc_id", "left_anti")
    found = decontaminate.contained(unnamed, items, id_col="text", short_items=True).select(F.col("doc_id").alias("text")).distinct()
    return kept.select(docs.columns).unionByName(unnamed.join(few(found), "text", "left_anti").select(docs.columns))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: ``doc_id, source, size, source_size, target, taken`` where ``taken`` is over 0."""
    bounded(spark)
    return mixing.mix(docs).where("taken > 0")


STAGES = [("quality", keep_good), ("simhash", drop_near_duplicates), ("decontamination", drop_test_items),
          ("pii", redact), ("mixing", mix)]

#: SQL has neither zstandard nor the anchor parsers; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
