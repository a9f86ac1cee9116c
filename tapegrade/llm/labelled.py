"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text leaves 0 modulo 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, y of at most ``bound`` labelled rows that are not held out, by smallest hash of the id.

    Labels that are null, and ids that are null, teach nothing; an id with several labels takes the largest, one with several texts
    the text of the smallest hash.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    # ``bound`` ids at most, so this side may be broadcast
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    met = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")
    # of rows that repeat an id, the text of the smallest hash: ``bound`` rows at most, whatever the ids
    return met.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
