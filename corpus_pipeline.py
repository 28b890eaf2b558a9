"""A cleaning pipeline over documents: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm.neardup import near_duplicates
from loglathe.llm.quality import assessments
from loglathe.llm.queries import packed, quality, table, toxic
from loglathe.llm.repeats import repeated_spans, without_spans
from loglathe.sources.staging import stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    found = quality(docs, table(spark, sf_dir, "labels"), assessments).where("_found.good")
    return found.select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select("doc_id", "text", row)
    return toxic(rows, table(spark, sf_dir, "labels")).where("score < 0.7").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    found = near_duplicates(docs)
    gone = found.where("component < id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier document has; n_chars follows."""
    left = without_spans(docs, repeated_spans(docs, grouped=True))
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences."""
    return packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash near-dedup", neardup_stage),
    ("suffix-array dedup", repeats_stage),
    ("best-fit packing", packing_stage),
]

#: No stage but the third can be told in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
