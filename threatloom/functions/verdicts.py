"""From a text model's answer to normalised verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom.constants import DEFAULT_SEVERITY
from threatloom.functions.text import strip
from threatloom.schemas import VERDICTS


def verdict_array(response: Column) -> Column:
    """Verdicts named in the answer: the whole text as JSON, else its outermost braces.

    Text without usable JSON gives an empty array.
    """
    text = strip(response)
    # the parser ignores what follows a complete value, so prose must not reach it first
    json_like = text.rlike(r'(?s)^(\{.*|\[.*\]|".*")$')
    whole = F.when(json_like, F.try_parse_json(text))
    braced = F.try_parse_json(F.regexp_extract(response, r"(?s)\{.*\}", 0))
    found = F.try_variant_get(
        F.coalesce(whole, braced), "$.vulnerabilities", VERDICTS.simpleString()
    )
    return F.coalesce(found, F.array().cast(VERDICTS))


def finding_cwe(raw: Column) -> Column:
    return F.replace(F.upper(raw), F.lit(" "), F.lit("-"))


def finding_severity(raw: Column) -> Column:
    return F.upper(F.coalesce(raw, F.lit(DEFAULT_SEVERITY)))


def finding_description(raw: Column) -> Column:
    return F.coalesce(raw, F.lit(""))
