"""Code, datasets, CVE feeds and model answers derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.constants import TARGET_CWES
from threatloom.schemas import CVE_FEED
from threatloom.session import computed_once, spread

Expr = str | tuple[str, str]  # one text for both engines, or (Spark, DuckDB)

NL = "chr(10)"
#: Rows of a table of few narrow columns that are sent to every task at most, so that the texts joined with them stay in place.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: str, items: Sequence[str]) -> str:
    """SQL choosing the item at a position."""
    return f"split_part('{'|'.join(items)}', '|', cast({index} + 1 as int))"


def text_of(expr: str) -> str:
    return f"cast({expr} as string)"


def sql_in(items: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{item}'" for item in items) + ")"


@dataclass(frozen=True)
class StandIn:
    """A table with derived columns; later steps may use the columns of earlier ones."""

    tables: tuple[str, ...]
    steps: tuple[dict[str, Expr], ...]
    join_on: str | None = None

    def frame(self, spark: SparkSession, sf_dir: str, *, heavy: bool = False) -> DataFrame:
        """`heavy` spreads the rows over all cores for the work to come."""
        df = table(spark, sf_dir, self.tables[0])
        df = spread(df) if heavy else df
        for name in self.tables[1:]:
            other = table(spark, sf_dir, name)
            df = df.join(F.broadcast(other) if other.count() <= BROADCAST_ROWS else other, self.join_on, "left")
        return self.derive(df)

    def derive(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.selectExpr("*", *[f"{_for(e, 0)} AS {name}" for name, e in step.items()])
        return df

    def sql(self) -> str:
        source = self.tables[0] + "".join(f" LEFT JOIN {t} USING ({self.join_on})" for t in self.tables[1:])
        for step in self.steps:
            columns = ", ".join(f"{_for(e, 1)} AS {name}" for name, e in step.items())
            source = f"(SELECT *, {columns} FROM {source})"
        return source


def _for(expr: Expr, engine: int) -> str:
    return expr if isinstance(expr, str) else expr[engine]


def iso(column: str) -> Expr:
    return (
        f"date_format({column}, 'yyyy-MM-dd\\'T\\'HH:mm:ss.SSSSSS')",
        f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f')",
    )


# --- a source tree: one C file per line item, with a vulnerable and a safe function -------------

_DIRS = (
    "CWE119_Bounds", "CWE-120_Copy", "CWE121_Stack", "CWE122_Heap", "cwe125_Read", "CWE787_Write",
    "CWE416_Use", "CWE-415_Free", "CWE476_Null", "CWE190_Over", "CWE191_Under", "CWE134_Format",
    "CWE362_Race", "CWE78_Command", "CWE20_Input", "CWE999_Other", "plain", "CWE79_Web",
)

SOURCE_FILES = StandIn(
    ("lineitem",),
    (
        {
            "cwe_dir": pick("l_partkey % 18", _DIRS),
            "suffix": "CASE WHEN l_linestatus = 'F' THEN '.cpp' ELSE '.c' END",
            "case_name": f"'case_' || {text_of('l_orderkey')}",
            "uses": "cast(floor(l_quantity) as int)",
        },
        {
            "rel_path": f"cwe_dir || '/s0' || {text_of('l_suppkey % 5')} || '/' || case_name || '_' || "
                        f"{text_of('l_linenumber')} || '_' || {text_of('l_partkey')} || suffix",
            "bad_name": "case_name || '_bad'",
            "bad_code": f"'void ' || case_name || '_bad(int n)' || {NL} || '{{' || {NL} || '    if (n > ' || "
                        f"{text_of('l_linenumber')} || ') {{' || {NL} || '        sink(n);' || {NL} || "
                        f"'    }}' || {NL} || '}}'",
            "good_code": f"'static void goodG2B(int a,' || {NL} || '    int b)' || {NL} || '{{' || {NL} || "
                         f"repeat('    use(a, b);' || {NL}, uses) || '}}'",
        },
        {
            "text": f"'/* part ' || {text_of('l_partkey')} || ' */' || {NL} || bad_code || {NL} || {NL} || "
                    f"good_code || {NL}",
        },
    ),
)

# --- two labelled datasets: documents with their labels ---------------------------------------

_RAW_CWES = (
    "CWE-119", "120", "CWE121", "CWE-122", "cwe 125", "CWE-787", "CWE-416", "CWE-415", "CWE-476", "190",
    "CWE-191", "CWE-134", "CWE-362", "CWE-78", "CWE-20", "NVD-CWE-noinfo", "CWE-79", "", "CWE-119,CWE-120",
    "CWE-0120", "none", "CWE-999",
)


def _dataset(cwe_index: str, cve_spread: int) -> StandIn:
    return StandIn(
        ("documents", "labels"),
        (
            {
                "code_1": "CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END",
                "code_2": "CASE WHEN doc_id % 10 = 0 THEN chr(9) || chr(10) || ' ' ELSE text END",
                "cwe_1": pick(cwe_index, _RAW_CWES),
                "cwe_2": "CASE WHEN doc_id % 3 = 0 THEN 'CWE-20' END",
                "cve_1": f"CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'CVE-2023-' || {text_of(f'n_chars % {cve_spread}')} END",
                "cve_2": "CASE WHEN doc_id % 14 = 0 THEN NULL ELSE 'CVE-2022-7' END",
            },
        ),
        join_on="doc_id",
    )


DATASET_A = _dataset("doc_id % 22", 50)
DATASET_B = _dataset("n_chars % 22", 7)


def dataset_a_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = DATASET_A.frame(spark, sf_dir)
    return rows.select(
        "doc_id", F.col("code_1").alias("func"), F.col("code_2").alias("func_before"),
        F.col("cwe_1").alias("CWE ID"), F.col("cwe_2").alias("cwe_id"),
        F.col("cve_1").alias("CVE ID"), F.col("cve_2").alias("cve_id"), F.col("quality").alias("target"),
    )


def dataset_b_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = DATASET_B.frame(spark, sf_dir)
    return rows.select(
        "doc_id", F.col("code_1").alias("func_before"), F.col("code_2").alias("code"),
        F.col("cwe_1").alias("cwe"), F.col("cwe_2").alias("cwe_id"),
        F.col("cve_1").alias("CVE_ID"), F.col("cve_2").alias("cve_id"),
        F.col("quality").cast("double").alias("target"),
    )


# --- a CVE feed: two states of a CVE per pair of events --------------------------------------

_FEED_CWES = (*TARGET_CWES, "CWE-79", "CWE-89", "NVD-CWE-Other")

FEED = StandIn(
    ("events",),
    (
        {"k": "cast(regexp_extract(props, '([0-9]+)', 1) as int)"},
        {
            "cve_id": f"'CVE-2024-' || {text_of('event_id - event_id % 2')}",
            "descr": "CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN '' "
                     f"WHEN 2 THEN 'Buffer Overflow in ' || event_type || ' handler ' || {text_of('user_id')} "
                     f"WHEN 3 THEN 'A use after free of session ' || {text_of('user_id')} "
                     "WHEN 4 THEN 'Remote memory corruption while parsing ' || event_type "
                     f"WHEN 5 THEN 'OS command injection by field ' || {text_of('k')} "
                     "WHEN 6 THEN 'Improper input validation and buffer overflow in ' || event_type "
                     f"ELSE 'An unchecked length in ' || event_type || ' step ' || {text_of('k % 20')} END",
            "score_len": "CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 1 ELSE 3 END",
            "score_sev": pick("cast(floor(value) as int) % 4", ("CRITICAL", "HIGH", "MEDIUM", "LOW")),
            "score_num": f"{text_of('k % 10')} || '.' || {text_of('k % 7')}",
            "n_cwe": "k % 4",
            **{f"cwe_{i}": pick(f"(k + {7 * i}) % 18", _FEED_CWES) for i in (1, 2, 3)},
            "n_cpe": "k % 8",
            "modified": iso("ts"),
        },
    ),
)


def nested_feed(rows: DataFrame) -> DataFrame:
    """The feed's columns folded into the raw, nested record."""
    descriptions = F.when(
        F.col("descr").isNotNull(), F.array(F.struct(F.lit("en").alias("lang"), F.col("descr").alias("value")))
    ).otherwise(F.array())
    numbers = F.slice(F.sequence(F.lit(1), F.lit(7)), F.lit(1), F.col("n_cpe"))
    weaknesses = F.array(*[F.struct(F.col(f"cwe_{i}").alias("value")) for i in (1, 2, 3)])
    parts = {
        "id": F.col("cve_id"),
        "descriptions": descriptions,
        "score": F.slice(F.array(F.lit("V31"), "score_sev", "score_num"), F.lit(1), F.col("score_len")),
        "cwe": F.slice(weaknesses, F.lit(1), F.col("n_cwe")),
        "cpe": F.transform(numbers, lambda i: F.struct(F.concat(F.lit("cpe:2.3:a:v"), i).alias("criteria"))),
        "published": F.col("modified"),
        "lastModified": F.col("modified"),
    }
    return rows.select(*[parts[f.name].cast(f.dataType).alias(f.name) for f in CVE_FEED.fields])


def feed(spark: SparkSession, sf_dir: str, source: StandIn = FEED, *, heavy: bool = False) -> DataFrame:
    return computed_once(nested_feed(source.frame(spark, sf_dir, heavy=heavy)))


def flat_cves_sql(source: StandIn) -> str:
    """The flat record as SQL, with the moment it was modified at."""
    return f"""(
    SELECT cve_id, descr AS description,
           CASE WHEN score_len = 3 THEN cast(score_num AS DOUBLE) END AS cvss_score,
           CASE WHEN score_len = 3 THEN score_sev ELSE 'UNKNOWN' END AS severity,
           list_slice([cwe_1, cwe_2, cwe_3], 1, n_cwe) AS cwe_ids,
           list_slice(['cpe:2.3:a:v1', 'cpe:2.3:a:v2', 'cpe:2.3:a:v3', 'cpe:2.3:a:v4', 'cpe:2.3:a:v5'],
                      1, n_cpe) AS cpe,
           modified AS published, modified AS last_modified, ts AS modified_at
    FROM {source.sql()} WHERE descr <> '')"""


FLAT_CVES_SQL = flat_cves_sql(FEED)

# The same feed with moments in three forms, whose order as text is not their order in time.
_FORMS = (
    ("date_format(ts, 'yyyy-MM-dd\\'T\\'HH:mm:ss.SSSSSS')", "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"),
    ("date_format(ts - interval 5 hours, 'yyyy-MM-dd HH:mm:ss.SSSSSS') || '-05:00'",
     "strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S.%f') || '-05:00'"),
    ("date_format(ts + interval 14 hours, 'yyyy-MM-dd\\'T\\'HH:mm:ss.SSSSSS') || '+14:00'",
     "strftime(ts + INTERVAL 14 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+14:00'"),
)
_MIXED = tuple(
    f"CASE k % 3 WHEN 0 THEN {_FORMS[0][e]} WHEN 1 THEN {_FORMS[1][e]} ELSE {_FORMS[2][e]} END" for e in (0, 1)
)
MIXED_FEED = StandIn(FEED.tables, (FEED.steps[0], {**FEED.steps[1], "modified": _MIXED}))
FLAT_MIXED_SQL = flat_cves_sql(MIXED_FEED)

# --- answers of a text model: one function per event -----------------------------------------

ANSWER_CWES = ("CWE-120", "cwe 120", "cwe-78", "CWE-79", "Cwe 416", "CWE-20")
ANSWER_LEVELS = ("high", "Critical", "LOW", "info")


def _verdict(cwe: str, severity: str, description: str) -> str:
    return (
        f"""'{{"cwe_id": "' || {cwe} || '", "severity": "' || {severity} || """
        f"""'", "description": "' || {description} || '"}}'"""
    )


ANSWERS = StandIn(
    ("events",),
    (
        {"k": "cast(regexp_extract(props, '([0-9]+)', 1) as int)"},
        {
            "file_path": f"'src/' || event_type || '/f_' || {text_of('event_id')} || '.c'",
            "name": f"'fn_' || {text_of('event_id')}",
            "cwe_a": pick("k % 6", ANSWER_CWES),
            "cwe_b": pick("(k + 1) % 6", ANSWER_CWES),
            "level_a": pick("k % 4", ANSWER_LEVELS),
            "level_b": pick("(k + 3) % 4", ANSWER_LEVELS),
            "about_a": f"'unchecked length in ' || event_type || ' step ' || {text_of('k % 20')}",
            "about_b": f"'buffer overflow by field ' || {text_of('k % 10')}",
        },
        {
            "code": f"'int ' || name || '(int k)' || {NL} || '{{' || {NL} || '    return k + ' || "
                    f"{text_of('k')} || ';' || {NL} || '}}'",
            "response": f"""CASE event_type
                WHEN 'click' THEN {NL} || '{{"vulnerabilities": [' || {_verdict('cwe_a', 'level_a', 'about_a')} || ']}}  '
                WHEN 'view' THEN 'Sure, here it is: ```json ' || '{{"vulnerabilities": ['
                    || {_verdict('cwe_a', 'level_a', 'about_a')} || ', '
                    || {_verdict('cwe_b', 'level_b', 'about_b')} || ']}}' || ' ``` done'
                WHEN 'purchase' THEN '{{"vulnerabilities": [{{"cwe_id": "' || cwe_a || '"}}, '
                    || {_verdict("'CWE-79'", "'HIGH'", "'markup'")} || ']}}'
                WHEN 'error' THEN '{{oops ' || {text_of('k')}
                ELSE 'No issues found in this function.' END""",
        },
        {"text": f"'#include <stdio.h>' || {NL} || {NL} || code || {NL}"},
    ),
)

# All verdicts of the answers, before filtering and normalising.
VERDICTS_SQL = f"""(
    SELECT *, 0 AS pos, cwe_a AS raw_cwe,
           CASE WHEN event_type = 'purchase' THEN NULL ELSE level_a END AS raw_level,
           CASE WHEN event_type = 'purchase' THEN NULL ELSE about_a END AS raw_about
    FROM {ANSWERS.sql()} WHERE event_type IN ('click', 'view', 'purchase')
    UNION ALL
    SELECT *, 1, CASE WHEN event_type = 'view' THEN cwe_b ELSE 'CWE-79' END,
           CASE WHEN event_type = 'view' THEN level_b ELSE 'HIGH' END,
           CASE WHEN event_type = 'view' THEN about_b ELSE 'markup' END
    FROM {ANSWERS.sql()} WHERE event_type IN ('view', 'purchase'))"""

FINDINGS_SQL = f"""(
    SELECT event_id, name AS function_name, file_path, code, pos,
           replace(upper(raw_cwe), ' ', '-') AS cwe_id,
           upper(coalesce(raw_level, 'MEDIUM')) AS severity,
           coalesce(raw_about, '') AS description
    FROM {VERDICTS_SQL}
    WHERE replace(upper(raw_cwe), ' ', '-') IN {sql_in(TARGET_CWES)})"""
