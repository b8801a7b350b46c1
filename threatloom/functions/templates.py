"""Text templates: what gets embedded, and what a text model is asked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom.constants import PROMPT_HEAD, PROMPT_TAIL


def snippet_text(cwe_id: Column, language: Column, label: Column, snippet: Column) -> Column:
    return F.concat(
        F.lit("CWE: "), cwe_id, F.lit(" | Language: "), language,
        F.lit(" | Label: "), label, F.lit("\n\n"), snippet,
    )


def cve_text(cve_id: Column, description: Column, cwe_ids: Column) -> Column:
    weakness = F.when(
        F.size(cwe_ids) > 0,
        F.concat(F.lit(" Weakness: "), F.array_join(cwe_ids, ", "), F.lit(".")),
    )
    return F.concat(cve_id, F.lit(": "), description, F.coalesce(weakness, F.lit("")))


def prompt(code: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), code, F.lit(PROMPT_TAIL))
