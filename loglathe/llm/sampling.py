"""Bounded samples of labelled texts for training, and remainders of identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHARACTERS = 1 << 26  # of a sample's texts in all

def remainder(id_col: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), "UTF-8")), F.lit(divisor))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, rows: int, where: Column | None = None, characters: int = CHARACTERS
) -> DataFrame:
    """(doc_id, text, label): at most ``rows`` labelled documents with ``characters`` in all, the
    first by hash of the id, so that the sample does not depend on order or partitions.

    Conflicting labels of an id count as 1; of several texts of an id the smallest is taken. Rows
    without id or label are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("doc_id is not null and label is not null")
    if where is not None:
        known = known.where(where)
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # at most ``rows`` ids
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    whole = one.withColumn("upto", F.sum(F.length("text")).over(order)).where(F.col("upto") <= characters)
    return whole.select("doc_id", "text", "label")
