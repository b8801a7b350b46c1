"""Declared schemas of every stage."""

from pyspark.sql import types as T

_STR = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SNIPPET_PAYLOAD = _struct(
    code_snippet=_STR, label=_STR, cwe_id=_STR, source=_STR,
    language=_STR, function_name=_STR, file_path=_STR,
)

CVE_PAYLOAD = _struct(
    cve_id=_STR, description=_STR, cvss_score=T.DoubleType(), severity=_STR,
    cwe_ids=T.ArrayType(_STR), cpe=T.ArrayType(_STR), published=_STR, last_modified=_STR,
)

# One line of the landed CVE feed.
CVE_FEED = _struct(
    id=_STR,
    descriptions=T.ArrayType(_struct(lang=_STR, value=_STR)),
    score=T.ArrayType(_STR),
    cwe=T.ArrayType(_struct(value=_STR)),
    cpe=T.ArrayType(_struct(criteria=_STR)),
    published=_STR,
    lastModified=_STR,
)

VERDICTS = T.ArrayType(_struct(cwe_id=_STR, severity=_STR, description=_STR))


#: Columns of payloads whose values hardly repeat, for which files need no dictionaries and no least and greatest value.
DISTINCT_VALUES = ("payload.code_snippet", "payload.file_path")


def point_schema(payload: T.StructType) -> T.StructType:
    """A vector collection: id, embedding, payload."""
    return _struct(id=T.LongType(), embedding=T.ArrayType(T.FloatType()), payload=payload)


SNIPPET_POINT = point_schema(SNIPPET_PAYLOAD)
CVE_POINT = point_schema(CVE_PAYLOAD)
