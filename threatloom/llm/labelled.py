"""Labelled documents a classifier may learn from: a bounded sample, the same for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo; a null id counts as 0."""
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)), F.lit(modulus)).cast("int")


def training_labels(labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """`doc_id` and `label` of at most `rows` labelled documents outside the held-out part.

    Which ones is decided by a hash of the id. Where an id has several labels, the largest counts.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    usable = usable.where(remainder(F.col("doc_id"), modulus) != held_out)
    return (
        usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
