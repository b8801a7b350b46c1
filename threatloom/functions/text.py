"""Scalar text functions on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.constants import (
    MIN_FUNCTION_CHARS,
    RECORD_ID_DIGITS,
    SAFE,
    SHORT_ID_DIGITS,
    SNIPPET_CHARS,
    TARGET_CWES,
    UNKNOWN,
    VULNERABLE,
)

# Unicode white space plus the four information separators that count as blank too.
_BLANK = r"[\s\x1c-\x1f]"


def stable_id(key: Column, hex_digits: int = SHORT_ID_DIGITS) -> Column:
    """The first hex digits of the key's md5 as a LONG; by default an unsigned 32-bit id."""
    return F.conv(F.substring(F.md5(key), 1, hex_digits), 16, 10).cast("long")


def record_id(key: Column) -> Column:
    """Id of a stored record: 60 bits of the key's md5, so that a billion keys share none to speak of."""
    return stable_id(key, RECORD_ID_DIGITS)


def truncate(text: Column, max_chars: int = SNIPPET_CHARS) -> Column:
    """At most `max_chars` characters, longer text cut there and marked with `...`."""
    # characters are counted only in texts of more bytes than that
    short = (F.octet_length(text) <= max_chars) | (F.length(text) <= max_chars)
    return F.when(short, text).otherwise(
        F.concat(F.substring(text, 1, max_chars), F.lit("..."))
    )


def normalize_cwe(raw: Column) -> Column:
    """First digit run as `CWE-n`; `UNKNOWN` where there is none."""
    digits = F.regexp_extract(raw, r"(?U)(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("CWE-"), digits)).otherwise(F.lit(UNKNOWN))


def cwe_from_path(path: Column) -> Column:
    """`CWE-n` of the first path component naming one."""
    digits = F.regexp_extract(path, r"(?iU)CWE-?(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("CWE-"), digits)).otherwise(F.lit(UNKNOWN))


def of_target(cwe_id: Column, targets: Sequence[str] = TARGET_CWES) -> Column:
    """True for weaknesses in scope; null and others are not."""
    return F.coalesce(cwe_id.isin(*targets), F.lit(False))


def long_enough(code: Column, least: int = MIN_FUNCTION_CHARS) -> Column:
    """True for functions of at least so many characters."""
    return F.coalesce(F.length(code) >= least, F.lit(False))


def label_from_name(name: Column) -> Column:
    """`bad` marks a vulnerable function and wins over `good`, which marks a safe one."""
    return F.when(name.rlike("(?i)bad"), VULNERABLE).when(name.rlike("(?i)good"), SAFE)


def language_of(path: Column) -> Column:
    return F.when(path.endswith(".cpp"), "C++").otherwise("C")


def relative_to(path: Column, root: Column) -> Column:
    """Path below `root`; paths elsewhere are left as they are."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+\z", "")


def not_blank(text: Column) -> Column:
    """True when some character is not white space; null and empty text are blank."""
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def first_usable(df: DataFrame, names: tuple[str, ...]) -> Column:
    """First non-empty value, as text, among those of `names` the frame has; else ''."""
    present = [_usable_text(df, name) for name in names if name in df.columns]
    return F.coalesce(*present, F.lit(""))


def _usable_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(column) > 0, column.cast("string"))
    if isinstance(kind, T.BooleanType):
        return F.when(column, F.lit("True"))
    if isinstance(kind, T.NumericType):
        return F.when(column != 0, column.cast("string"))
    return F.nullif(column.cast("string"), F.lit(""))


def label_from_target(df: DataFrame, names: tuple[str, ...]) -> Column:
    """1 -> vulnerable, 0 -> safe, anything else (text included) -> null."""
    name = next((n for n in names if n in df.columns), None)
    if name is None or not isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType)):
        return F.lit(None).cast("string")
    target = F.col(f"`{name}`").cast("double")
    return F.when(target == 1, VULNERABLE).when(target == 0, SAFE)


def iso_utc(moment: Column) -> Column:
    """ISO text with microseconds; the session time zone is expected to be UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def utc_now() -> Column:
    return F.concat(iso_utc(F.current_timestamp()), F.lit("+00:00"))
