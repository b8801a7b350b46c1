"""Labelled-function datasets with varying column names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from threatloom import constants as const
from threatloom.functions.templates import snippet_text
from threatloom.functions.text import (
    first_usable,
    label_from_target,
    normalize_cwe,
    not_blank,
    of_target,
    record_id,
    stable_id,
    truncate,
)
from threatloom.operators.stats import observed

SNIPPET_COLUMNS = (
    "id", "id_key", "code_snippet", "label", "cwe_id", "source",
    "language", "function_name", "file_path", "source_rank", "order_text", "order_pos",
)


def labelled_rows(
    raw: DataFrame,
    columns: Mapping[str, tuple[str, ...]],
    *,
    source: str,
    id_prefix: str,
    source_rank: int,
    row_order: str | None = None,
    id_chars: int | None = None,
    seen: Observation | None = None,
) -> DataFrame:
    """Normalise one dataset to snippet rows.

    A row's key holds the md5 of its whole code. With `id_chars` it holds that many characters of it and
    the record id is short, which merges versions of a function that begin alike.

    Rows with blank code, a weakness out of scope, or a target other than 0/1
    are dropped. `row_order` names a LONG column giving the dataset's row order;
    without one, rows are ordered by content so that re-runs agree. An observation counts the rows read (`rows`) and
    those left after each filter: `with_code`, `in_scope`, `labelled`.
    """
    raw, columns, row_order = _unambiguous(raw, columns, row_order)
    slots = {
        "code": first_usable(raw, columns["code"]),
        "cwe_id": normalize_cwe(first_usable(raw, columns["cwe"])),
        "cve": F.coalesce(F.nullif(first_usable(raw, columns["cve"]), F.lit("")), F.lit("unknown")),
        "label": label_from_target(raw, columns["target"]),
        "order_pos": F.col(row_order) if row_order else F.lit(0).cast("long"),
    }
    rows = raw.select(*[column.alias(name) for name, column in slots.items()])
    with_code = not_blank(F.col("code"))
    in_scope = with_code & of_target(F.col("cwe_id"))
    labelled = in_scope & F.col("label").isNotNull()
    kept = observed(rows, seen, with_code=with_code, in_scope=in_scope, labelled=labelled).where(labelled)
    order_text = F.lit("") if row_order else F.md5("code")
    return snippet_rows(
        kept,
        snippet=truncate(F.col("code")),
        id_key=F.concat(
            F.lit(f"{id_prefix}:"), F.col("cve"), F.lit(":"),
            F.substring("code", 1, id_chars) if id_chars else F.md5("code"),
        ),
        short_id=id_chars is not None,
        language=F.lit("C"),
        function_name=F.lit(""),
        file_path=F.col("cve"),
        source=source,
        source_rank=source_rank,
        order_text=order_text,
        order_pos=F.col("order_pos"),
    )


def _unambiguous(
    raw: DataFrame, columns: Mapping[str, tuple[str, ...]], row_order: str | None
) -> tuple[DataFrame, dict[str, tuple[str, ...]], str | None]:
    """Rename by position: some datasets have columns that differ only in case."""
    renamed = {name: f"c{at}" for at, name in enumerate(raw.columns)}
    present = {slot: tuple(renamed[n] for n in names if n in renamed) for slot, names in columns.items()}
    return raw.toDF(*renamed.values()), present, renamed[row_order] if row_order else None


def dataset_a(
    raw: DataFrame, row_order: str | None = None, id_chars: int | None = None, seen: Observation | None = None
) -> DataFrame:
    return labelled_rows(
        raw, const.DATASET_A_COLUMNS, source=const.DATASET_A_SOURCE,
        id_prefix=const.DATASET_A_PREFIX, source_rank=1, row_order=row_order, id_chars=id_chars, seen=seen,
    )


def dataset_b(
    raw: DataFrame, row_order: str | None = None, id_chars: int | None = None, seen: Observation | None = None
) -> DataFrame:
    return labelled_rows(
        raw, const.DATASET_B_COLUMNS, source=const.DATASET_B_SOURCE,
        id_prefix=const.DATASET_B_PREFIX, source_rank=2, row_order=row_order, id_chars=id_chars, seen=seen,
    )


def snippet_rows(
    rows: DataFrame,
    *,
    snippet: Column,
    id_key: Column,
    language: Column,
    function_name: Column,
    file_path: Column,
    source: str,
    source_rank: int,
    order_text: Column,
    order_pos: Column,
    short_id: bool = False,
) -> DataFrame:
    """Shape rows holding `label` and `cwe_id` into SNIPPET_COLUMNS.

    (source_rank, order_text, order_pos) is the order in which first-wins
    de-duplication sees the rows.
    """
    shaped = rows.select(
        id_key.alias("id_key"),
        snippet.alias("code_snippet"),
        "label",
        "cwe_id",
        F.lit(source).alias("source"),
        language.alias("language"),
        function_name.alias("function_name"),
        file_path.alias("file_path"),
        F.lit(source_rank).alias("source_rank"),
        order_text.alias("order_text"),
        order_pos.cast("long").alias("order_pos"),
    )
    key = F.col("id_key")
    return shaped.withColumn("id", stable_id(key) if short_id else record_id(key)).select(*SNIPPET_COLUMNS)


def with_text(snippets: DataFrame) -> DataFrame:
    """Add the text to embed; best after de-duplication, which then moves each snippet once, not twice."""
    text = snippet_text(F.col("cwe_id"), F.col("language"), F.col("label"), F.col("code_snippet"))
    return snippets.withColumn("text", text)
