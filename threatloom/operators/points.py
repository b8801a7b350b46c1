"""Shape rows into points of a vector collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.operators.embed import Encoder, embed_text
from threatloom.schemas import CVE_PAYLOAD, SNIPPET_PAYLOAD


def payload_of(df: DataFrame, payload: T.StructType) -> DataFrame:
    """Fold the payload columns into one struct, keeping the rest."""
    names = payload.fieldNames()
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.struct(*names).alias("payload"))


def snippet_points(embedded: DataFrame) -> DataFrame:
    return _points(embedded, SNIPPET_PAYLOAD)


def cve_points(embedded: DataFrame) -> DataFrame:
    return _points(embedded, CVE_PAYLOAD)


def _points(rows: DataFrame, payload: T.StructType) -> DataFrame:
    """Points of the rows; without vectors where these are yet to be added."""
    vector = ["embedding"] if "embedding" in rows.columns else []
    return payload_of(rows, payload).select("id", *vector, "payload")


def late_embedding(
    with_text: Callable[[DataFrame], DataFrame], encoder: Callable[[], Encoder]
) -> tuple[str, Callable[[DataFrame, str, Column], DataFrame]]:
    """The vectors of points as a late column of an upsert, packed; `with_text` adds the text to rows with the payload's columns."""

    def add(points: DataFrame, out: str, wanted: Column) -> DataFrame:
        texts = with_text(points.select("*", "payload.*")).withColumn("text", F.when(wanted, F.col("text")))
        return embed_text(texts, "text", out, encoder, skip_null=True, packed=True).select(*points.columns, out)

    return "embedding", add
