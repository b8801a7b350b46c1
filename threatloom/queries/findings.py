"""Queries from model answers to reported findings."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.constants import TARGET_CWES
from threatloom.functions import verdicts as vd
from threatloom.operators.embed import embed_text
from threatloom.operators.findings import explode_verdicts, findings_of, report_rows
from threatloom.operators.score import answer_collection, join_responses, score_batches
from threatloom.operators.stats import severity_summary, severity_totals
from threatloom.plans.scan import scan_with_model, scan_with_responses
from threatloom.plans.threats import ingest_threats, threat_records
from threatloom.plans.verify import verify_findings
from threatloom.queries.snippets import sql_token_weights
from threatloom.queries.standins import (
    ANSWER_CWES,
    ANSWER_LEVELS,
    ANSWERS,
    FINDINGS_SQL,
    VERDICTS_SQL,
    feed,
    sql_in,
    table,
)
from threatloom.queries.threats import TEXT_SQL, THREAT_ROWS_SQL
from threatloom.schemas import CVE_POINT
from threatloom.session import run_dir, stored
from threatloom.sources.collection import Collection
from threatloom.sources.feed import with_text
from threatloom.sources.state import Watermark


def json_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = ANSWERS.frame(spark, sf_dir, heavy=True).select("event_id", vd.verdict_array(F.col("response")).alias("verdicts"))
    first = F.get(F.col("verdicts.cwe_id"), F.lit(0))
    return answers.select(
        "event_id", F.size("verdicts").cast("long").alias("n_verdicts"), F.coalesce(first, F.lit("")).alias("first_cwe")
    )


JSON_FALLBACK = f"""SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 2
        ELSE 0 END AS n_verdicts,
        CASE WHEN event_type IN ('click', 'view', 'purchase') THEN cwe_a ELSE '' END AS first_cwe
    FROM {ANSWERS.sql()}"""


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ANSWERS.frame(spark, sf_dir, heavy=True).select(
        "event_id", "name", "code", F.lit(3).alias("start_line"), F.lit(6).alias("end_line"), "file_path", "response"
    )


def findings_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings_of(_answered(spark, sf_dir))
    return found.select(
        "function_name", "file_path", F.md5("code").alias("code_md5"), "start_line", "end_line", "language",
        "cwe_id", "severity", "description", "verdict_pos",
    )


FINDINGS_ROWS = f"""SELECT function_name, file_path, md5(code) AS code_md5, 3 AS start_line, 6 AS end_line,
        'C' AS language, cwe_id, severity, description, pos AS verdict_pos FROM {FINDINGS_SQL}"""


def findings_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = explode_verdicts(_answered(spark, sf_dir).select("event_id", "response"))
    return flat.select("event_id", "verdict_pos", "verdict.*")


FINDINGS_FLAT = f"""SELECT event_id, pos AS verdict_pos, raw_cwe AS cwe_id, raw_level AS severity,
        raw_about AS description FROM {VERDICTS_SQL}"""


def finding_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("p_type") != "PROMO", F.lower("p_type"))
    description = F.when(F.col("p_size") >= 10, F.col("p_brand"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        vd.finding_cwe(F.col("p_name")).alias("cwe_id"),
        vd.finding_severity(severity).alias("severity"),
        vd.finding_description(description).alias("description"),
    )


FINDING_NORMALIZE = """SELECT p_partkey, replace(upper(p_name), ' ', '-') AS cwe_id,
        CASE WHEN p_type = 'PROMO' THEN 'MEDIUM' ELSE p_type END AS severity,
        CASE WHEN p_size >= 10 THEN p_brand ELSE '' END AS description FROM part"""


def finding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ANSWERS.frame(spark, sf_dir, heavy=True)
    numbers = F.transform(
        F.sequence(F.lit(0), F.col("k") % 6),
        lambda i: F.when(i % 2 == 0, F.concat(F.lit("CVE-"), i + F.col("k"))).otherwise(""),
    )
    ids = F.when(F.col("k") % 7 > 0, numbers)
    findings = rows.select(
        F.when(F.col("k") % 5 > 0, F.col("level_a")).alias("severity"), F.col("name").alias("function_name"),
        F.col("cwe_a").alias("cwe_id"), F.col("k").alias("start_line"), F.col("about_a").alias("description"),
        ids.alias("ids"),
    )
    return report_rows(findings, "ids")


FINDING_REPORT = f"""SELECT CASE WHEN k % 5 > 0 THEN upper(level_a) ELSE 'MEDIUM' END AS severity,
        name AS function_name, cwe_a AS cwe_id, k AS start_line, about_a AS description,
        CASE WHEN k % 7 = 0 THEN 'none' ELSE 'CVE-' || cast(k AS VARCHAR)
             || CASE WHEN k % 6 >= 2 THEN ', CVE-' || cast(k + 2 AS VARCHAR) ELSE '' END
             || CASE WHEN k % 6 >= 4 THEN ', CVE-' || cast(k + 4 AS VARCHAR) ELSE '' END END AS related_cves
    FROM {ANSWERS.sql()}"""

_LEVEL_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'HIGH'
        WHEN '3-MEDIUM' THEN NULL WHEN '4-NOT SPECIFIED' THEN 'INFO' ELSE 'low' END"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(f"{_LEVEL_SQL} AS severity")


def severity_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity_summary(_levels(spark, sf_dir)).orderBy("level_rank")


SEVERITY_SUMMARY = f"""SELECT l.severity, l.level_rank, count(o.severity) AS n
    FROM (VALUES ('CRITICAL', 0), ('HIGH', 1), ('MEDIUM', 2), ('LOW', 3)) l(severity, level_rank)
    LEFT JOIN (SELECT upper(coalesce({_LEVEL_SQL}, 'MEDIUM')) AS severity FROM orders) o USING (severity)
    GROUP BY l.severity, l.level_rank"""


def severity_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity_totals(_levels(spark, sf_dir))


SEVERITY_TOTAL = f"""SELECT count(*) FILTER (s = 'CRITICAL') AS critical, count(*) FILTER (s = 'HIGH') AS high,
        count(*) FILTER (s = 'MEDIUM') AS medium, count(*) FILTER (s = 'LOW') AS low, count(*) AS total
    FROM (SELECT upper(coalesce({_LEVEL_SQL}, 'MEDIUM')) AS s FROM orders)"""


def responses_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.md5("text").alias("prompt_md5"))
    answers = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    joined = join_responses(asked, answers, ["conv_id", "turn"])
    return joined.select("conv_id", "turn", "prompt_md5", F.coalesce(F.md5("response"), F.lit("none")).alias("response_md5"))


def _last_word() -> Callable[[Sequence[str]], list[str | Exception]]:
    """A responder that answers with the prompt's last word and fails on prompts of an odd length."""

    def answer(prompts: Sequence[str]) -> list[str | Exception]:
        return [ValueError("odd") if len(p) % 2 else p.split(" ")[-1] for p in prompts]

    return answer


def score_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn put to a responder in batches, with the failures kept apart."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return score_batches(turns, "text", _last_word).select("conv_id", "turn", "response", "response_error")


SCORE_RESPONSES = """SELECT conv_id, turn, CASE WHEN length(text) % 2 = 0 THEN string_split(text, ' ')[-1] END AS response,
        CASE WHEN length(text) % 2 = 1 THEN 'ValueError: odd' END AS response_error FROM conversations"""

RESPONSES_JOIN = """SELECT q.conv_id, q.turn, md5(q.text) AS prompt_md5, coalesce(md5(a.text), 'none') AS response_md5
    FROM conversations q LEFT JOIN conversations a
      ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
    WHERE q.role = 'user'"""


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threats ingested; source texts to functions, stored answers to findings, each with its five nearest threats."""
    root = run_dir(spark, "scan")
    threats = Collection(spark, f"{root}/threats", CVE_POINT)
    ingest_threats(feed(spark, sf_dir, heavy=True), threats, Watermark(spark, f"{root}/watermark"))
    files = ANSWERS.frame(spark, sf_dir, heavy=True)
    found = scan_with_responses(
        files.select("file_path", "text"),
        files.select("file_path", "name", F.lit(3).alias("start_line"), "response"), threats.read(),
    )
    return found.select(
        "function_name", "file_path", "start_line", "end_line", "cwe_id", "severity", "description", "verdict_pos",
        F.array_join("cve_matches.cve_id", ",").alias("cves"),
    )


_PROBES = f"(SELECT DISTINCT description FROM {FINDINGS_SQL})"
_CORPUS = f"(SELECT id, cve_id, {TEXT_SQL} AS text FROM {THREAT_ROWS_SQL})"


def sql_float_weights(source: str, key: str, text: str) -> str:
    """Weights as stored: single precision."""
    return f"(SELECT {key}, bucket, cast(cast(weight AS FLOAT) AS DOUBLE) AS w FROM {sql_token_weights(source, key, text)})"


_SCORED = f"""
    WITH probe AS {sql_float_weights(f"(SELECT description, description AS body FROM {_PROBES})", "description", "body")},
    entry AS {sql_float_weights(_CORPUS, "id", "text")},
    probe_norm AS (SELECT description, sqrt(sum(w * w)) AS len FROM probe GROUP BY 1),
    entry_norm AS (SELECT id, sqrt(sum(w * w)) AS len FROM entry GROUP BY 1),
    dots AS (SELECT p.description, e.id, sum(p.w * e.w) AS dot
             FROM probe p JOIN entry e USING (bucket) GROUP BY 1, 2),
    scored AS (SELECT p.description, e.id,
                      round(coalesce(d.dot, 0) / (p.len * e.len), 6) AS score
               FROM probe_norm p CROSS JOIN entry_norm e
               LEFT JOIN dots d ON d.description = p.description AND d.id = e.id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY score DESC, id) AS rank FROM scored)"""
SCAN_FINDINGS = f"""{_SCORED},
    best AS (SELECT r.description, string_agg(c.cve_id, ',' ORDER BY r.rank) AS cves
             FROM ranked r JOIN {_CORPUS} c USING (id) WHERE rank <= 5 GROUP BY 1)
    SELECT f.function_name, f.file_path, 3 AS start_line, 6 AS end_line, f.cwe_id, f.severity, f.description,
           f.pos AS verdict_pos, coalesce(b.cves, '') AS cves
    FROM {FINDINGS_SQL} f LEFT JOIN best b USING (description)"""

def _field_model() -> Callable[[Sequence[str]], list[str | Exception]]:
    """A stand-in for a text model: its answers, and its failures, depend on the one number in the code."""

    def answer(prompts: Sequence[str]) -> list[str | Exception]:
        out: list[str | Exception] = []
        for text in prompts:
            k = int(re.search(r"return k \+ (\d+);", text).group(1))
            verdict = {"cwe_id": ANSWER_CWES[k % 6], "severity": ANSWER_LEVELS[k % 4],
                       "description": f"buffer overflow by field {k % 10}"}
            told = json.dumps({"vulnerabilities": [verdict]}) if k % 3 else "No issues found in this function."
            out.append(TimeoutError(f"field {k}") if k % 10 == 9 else told)
        return out

    return answer


def scan_with_model_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source texts put to a model, in a scan that begins where one of half the files has ended, with the nearest threats."""
    root = run_dir(spark, "scan")
    records = with_text(stored(threat_records(feed(spark, sf_dir, heavy=True)), "records"))
    threats = stored(embed_text(records, "text").select("id", "embedding", F.struct("cve_id").alias("payload")), "threats")
    files = stored(ANSWERS.frame(spark, sf_dir, heavy=True).select("event_id", "file_path", "text"), "files")
    answers = answer_collection(spark, f"{root}/answers", buckets=8)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the model fails on purpose
        scan_with_model(files.where("event_id % 2 = 0"), _field_model, threats, answers)
        found = scan_with_model(files, _field_model, threats, answers)
    return found.select(
        "function_name", "file_path", "start_line", "end_line", "cwe_id", "severity", "description",
        F.array_join("cve_matches.cve_id", ",").alias("cves"),
    )


SCAN_WITH_MODEL = f"""{_SCORED},
    best AS (SELECT r.description, string_agg(c.cve_id, ',' ORDER BY r.rank) AS cves
             FROM ranked r JOIN {_CORPUS} c USING (id) WHERE rank <= 5 GROUP BY 1)
    SELECT name AS function_name, file_path, 3 AS start_line, 6 AS end_line, replace(upper(cwe_a), ' ', '-') AS cwe_id,
           upper(level_a) AS severity, 'buffer overflow by field ' || cast(k % 10 AS VARCHAR) AS description,
           coalesce(b.cves, '') AS cves
    FROM {ANSWERS.sql()} a LEFT JOIN best b ON b.description = 'buffer overflow by field ' || cast(a.k % 10 AS VARCHAR)
    WHERE k % 3 <> 0 AND k % 10 <> 9 AND replace(upper(cwe_a), ' ', '-') IN {sql_in(TARGET_CWES)}"""

# similarities of the stand-ins are middling
_DEFINITE, _AMBIGUOUS_ABOVE = 0.45, 0.3


def verify_findings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings judged by their nearest records, of which the severe ones count as vulnerable."""
    records = with_text(stored(threat_records(feed(spark, sf_dir, heavy=True)), "records"))
    label = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "vulnerable").otherwise("safe")
    snippets = embed_text(records, "text").select(
        "id", "embedding", F.struct(label.alias("label"), "cve_id").alias("payload")
    )
    findings = stored(findings_of(_answered(spark, sf_dir)), "findings")
    kept = verify_findings(
        findings, stored(snippets, "snippets"), text="description", definite=_DEFINITE, ambiguous_above=_AMBIGUOUS_ABOVE
    )
    return kept.select(
        "function_name", "cwe_id", "verdict_pos", "verdict", "confidence",
        F.coalesce(F.array_join("top_matches.cve_id", ","), F.lit("")).alias("cves"),
    )


VERIFY_FINDINGS = f"""{_SCORED},
    votes AS (SELECT r.description, string_agg(c.cve_id, ',' ORDER BY r.rank) AS cves,
                     sum(CASE WHEN c.severity IN ('CRITICAL', 'HIGH') THEN greatest(r.score, 0) ELSE 0 END) AS v,
                     sum(CASE WHEN c.severity IN ('CRITICAL', 'HIGH') THEN 0 ELSE greatest(r.score, 0) END) AS s
              FROM ranked r JOIN {THREAT_ROWS_SQL} c USING (id) WHERE rank <= 5 GROUP BY 1),
    judged AS (SELECT *, round(greatest(v, s) / 5, 6) AS confidence,
                      CASE WHEN round(greatest(v, s) / 5, 6) < {_DEFINITE} THEN 'ambiguous'
                           WHEN v >= s THEN 'vulnerable' ELSE 'false_positive' END AS verdict FROM votes)
    SELECT f.function_name, f.cwe_id, f.pos AS verdict_pos, j.verdict, j.confidence, coalesce(j.cves, '') AS cves
    FROM {FINDINGS_SQL} f LEFT JOIN judged j USING (description)
    WHERE j.verdict IS NULL OR j.verdict = 'vulnerable'
       OR (j.verdict = 'ambiguous' AND j.confidence > {_AMBIGUOUS_ABOVE})"""


QUERIES = {
    "json_fallback": (json_fallback, JSON_FALLBACK),
    "findings_rows": (findings_rows, FINDINGS_ROWS),
    "findings_flat": (findings_flat, FINDINGS_FLAT),
    "finding_normalize": (finding_normalize, FINDING_NORMALIZE),
    "finding_report": (finding_report, FINDING_REPORT),
    "severity_summary": (severity_summary_query, SEVERITY_SUMMARY),
    "severity_total": (severity_total, SEVERITY_TOTAL),
    "responses_join": (responses_join, RESPONSES_JOIN),
    "score_responses": (score_responses, SCORE_RESPONSES),
    "scan_findings": (scan_findings, SCAN_FINDINGS),
    "scan_with_model": (scan_with_model_query, SCAN_WITH_MODEL),
    "verify_findings": (verify_findings_query, VERIFY_FINDINGS),
}
