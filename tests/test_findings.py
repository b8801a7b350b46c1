"""Model answers, findings, and the scan job."""

import sys

import os

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from threatloom.functions.templates import prompt
from threatloom.operators.findings import findings_of, report_rows, shown_ids
from threatloom.operators.score import answer_collection, join_responses, one_by_one, score_open, score_text
from threatloom.plans.scan import prompts, scan_with_model, scan_with_responses
from threatloom.schemas import CVE_POINT

# the workers cannot import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])

V = '{"vulnerabilities": [{"cwe_id": "CWE-120", "severity": "high", "description": "d"}]}'
ANSWERS = [
    ("clean", V, 1),
    ("spaces around", f"\n\t {V} \n", 1),
    ("prose and fence", f"Sure: ```json\n{V}\n``` bye", 1),
    ("trailing words", f"{V} thanks", 1),
    ("two objects", f"{V} and {V}", 1),
    ("leading number", f"1 finding: {V}", 1),
    ("single quotes", V.replace('"', "'"), 0),
    ("trailing comma", V[:-2] + ",]}", 0),
    ("cut off", "{oops", 0),
    ("no json", "none found", 0),
    ("empty", "", 0),
    ("no answer", None, 0),
    ("list", "[1]", 0),
    ("list of objects", f"[{V}]", 0),
    ("other object", '{"a": 1}', 0),
    ("null array", '{"vulnerabilities": null}', 0),
    ("empty array", '{"vulnerabilities": []}', 0),
    ("null cwe", '{"vulnerabilities": [{"cwe_id": null}]}', 0),
    ("number cwe", '{"vulnerabilities": [{"cwe_id": 120}]}', 0),
    ("defaults", '{"vulnerabilities": [{"cwe_id": "cwe 120"}]}', 1),
    ("mixed array", '{"vulnerabilities": [{"cwe_id": "CWE-20", "severity": "LOW", "description": "d"}, "x"]}', 1),
    ("out of scope", '{"vulnerabilities": [{"cwe_id": "CWE-79"}]}', 0),
    ("twice", '{"vulnerabilities": [{"cwe_id": "CWE-20"}, {"cwe_id": "CWE-20"}]}', 2),
]


def test_answers(spark):
    functions = spark.createDataFrame(
        [(name, "code", 1, 2, "f.c", answer) for name, answer, _ in ANSWERS],
        "name string, code string, start_line int, end_line int, file_path string, response string",
    )
    found = findings_of(functions).collect()
    counts = {name: sum(r.function_name == name for r in found) for name, _, _ in ANSWERS}
    assert counts == {name: n for name, _, n in ANSWERS}
    by_name = {r.function_name: r for r in found}
    defaults = by_name["defaults"]
    assert (defaults.cwe_id, defaults.severity, defaults.description) == ("CWE-120", "MEDIUM", "")
    assert by_name["clean"].severity == "HIGH"


def test_shown_ids(spark):
    cases = [(["", "a", None, "b", "c", "d"], "a, b, c"), ([""], "none"), ([], "none"), (None, "none")]
    df = spark.createDataFrame([(i, ids) for i, (ids, _) in enumerate(cases)], "i int, ids array<string>")
    rows = df.select("i", shown_ids(F.col("ids")).alias("v")).orderBy("i").collect()
    assert [r.v for r in rows] == [shown for _, shown in cases]


def test_prompt_holds_the_code(spark):
    text = spark.range(1).select(prompt(F.lit("int x;")).alias("p")).first().p
    assert "```c\nint x;\n```" in text
    assert text.endswith('If no vulnerabilities found: {"vulnerabilities": []}')


def failing_responder():
    def answer(text):
        if "explode" in text:
            raise RuntimeError("no model")
        return text.upper()

    return answer


def test_a_failed_call_gives_no_answer(spark):
    df = spark.createDataFrame([("a",), ("explode",)], "p string")
    assert {r.p: r.response for r in score_text(df, "p", failing_responder).collect()} == {"a": "A", "explode": None}


def test_join_responses_keeps_unanswered(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    stored = spark.createDataFrame([(1, "x")], "k int, response string")
    assert {r.k: r.response for r in join_responses(df, stored, ["k"]).collect()} == {1: "x", 2: None}


def responder():
    return one_by_one(answer_about_strcpy)


def answer_about_strcpy(text):
    if "strcpy" in text:
        return 'Found: {"vulnerabilities": [{"cwe_id": "CWE-120", "severity": "high", "description": "strcpy into buffer"}]}'
    return '{"vulnerabilities": []}'


@pytest.fixture(scope="module")
def threats(spark):
    from threatloom.operators.embed import embed_text
    from threatloom.operators.points import cve_points

    rows = [(i, f"CVE-{i}", text) for i, text in enumerate(["strcpy into buffer", "buffer", "race", "strcpy"])]
    cves = spark.createDataFrame(rows, "id long, cve_id string, description string").select(
        "*", F.lit(None).cast("double").alias("cvss_score"), F.lit("HIGH").alias("severity"),
        F.array(F.lit("CWE-120")).alias("cwe_ids"), F.array().cast("array<string>").alias("cpe"),
        F.lit("").alias("published"), F.lit("").alias("last_modified"),
    )
    return cve_points(embed_text(cves, "description"))


CODE = "void copy(char *a, char *b)\n{\n    strcpy(a, b);\n}\n\nint safe_one(int a)\n{\n    return a + 1;\n}\n"


def test_scan(spark, threats, tmp_path):
    files = spark.createDataFrame([("x.c", CODE)], "file_path string, text string")
    found = scan_with_model(files, responder, threats, answer_collection(spark, str(tmp_path / "answers")), k=2)
    [row] = found.collect()
    assert (row.function_name, row.start_line, row.end_line, row.file_path) == ("copy", 1, 4, "x.c")
    assert [m.cve_id for m in row.cve_matches] == ["CVE-0", "CVE-1"]
    assert report_rows(found).first().related_cves == "CVE-0, CVE-1"

    responses = prompts(files).select("file_path", "name", "start_line", F.lit(answer_about_strcpy("strcpy")).alias("response"))
    stored = scan_with_responses(files, responses, threats.limit(0))
    assert {(r.function_name, len(r.cve_matches)) for r in stored.collect()} == {("copy", 0), ("safe_one", 0)}
    assert {r.related_cves for r in report_rows(stored).collect()} == {"none"}


def test_scan_without_functions(spark, threats, tmp_path):
    files = spark.createDataFrame([("x.c", "int a;")], "file_path string, text string")
    answers = answer_collection(spark, str(tmp_path / "answers"))
    assert scan_with_model(files, responder, threats, answers).count() == 0


def test_point_schema(threats):
    assert [f.name for f in threats.schema] == CVE_POINT.fieldNames()
    assert threats.schema["embedding"].dataType == CVE_POINT["embedding"].dataType


def noting(folder, fail_on="", only=None):
    """A responder that notes each prompt it is asked in a file, fails on some and breaks the job on others."""
    import uuid
    from pathlib import Path

    def start():
        def answer(asked):
            Path(folder, uuid.uuid4().hex).write_text("\n".join(asked))
            if only is not None and any(p not in only for p in asked):
                os._exit(1)
            return [ValueError("no") if p == fail_on else p.upper() for p in asked]

        return answer

    return start


def asked_in(folder):
    return sorted(line for f in folder.iterdir() for line in f.read_text().split("\n"))


def test_a_second_run_asks_nothing(spark, tmp_path):
    first, second, third = (tmp_path / n for n in ("first", "second", "third"))
    for folder in (first, second, third):
        folder.mkdir()
    answers = answer_collection(spark, str(tmp_path / "answers"), buckets=4)
    rows = [(i, f"p{i % 20}") for i in range(60)] + [(60, None), (61, "bad")]
    df = spark.createDataFrame(rows, "i int, p string").withColumn("response", F.lit("own"))
    got = {r.i: (r.response, r.response_error) for r in score_open(df, "p", noting(str(first), "bad"), answers, wave_prompts=8).collect()}
    assert got == {i: (None, "ValueError: no") if p == "bad" else (p and p.upper(), None) for i, p in rows}
    assert asked_in(first) == sorted({p for _, p in rows if p})
    # what has failed is asked again, and nothing else
    again = score_open(df, "p", noting(str(second)), answers)
    assert asked_in(second) == ["bad"] and again.where("response_error IS NOT NULL").count() == 0
    assert {r.i: r.response for r in again.collect()} == {i: p and p.upper() for i, p in rows}
    score_open(df, "p", noting(str(third)), answers).collect()
    assert asked_in(third) == []


def test_a_broken_run_keeps_the_waves_before(spark, tmp_path):
    folder, after = tmp_path / "asked", tmp_path / "after"
    folder.mkdir()
    after.mkdir()
    answers = answer_collection(spark, str(tmp_path / "answers"), buckets=4)
    df = spark.createDataFrame([(f"p{i}",) for i in range(40)], "p string")
    waves = df.select("p", F.pmod(F.xxhash64(F.sha2("p", 256)), F.lit(4)).alias("wave")).collect()
    done = {r.p for r in waves if r.wave < 2}
    with pytest.raises(Exception):
        score_open(df, "p", noting(str(folder), only=done), answers, wave_prompts=10)
    assert {r.response for r in answers.read().collect()} == {p.upper() for p in done}
    assert score_open(df, "p", noting(str(after)), answers).where("response = upper(p)").count() == 40
    assert asked_in(after) == sorted({r.p for r in waves} - done)


def test_answers_of_a_wave_touch_no_older_files(spark, tmp_path):
    """Each wave adds files; what earlier waves have written is not written again, and each prompt is asked once."""
    answers = answer_collection(spark, str(tmp_path / "answers"), buckets=2)
    df = spark.createDataFrame([(i, f"p{i % 60}") for i in range(90)], "i long, p string")
    seen = []
    insert = answers.insert

    def noted(rows):
        insert(rows)
        seen.append({str(f) for f in (tmp_path / "answers" / "data").glob("key_bucket=*/*.parquet")})

    answers.insert = noted
    got = score_open(df, "p", lambda: one_by_one(str.upper), answers, wave_prompts=10)
    assert got.where("response = upper(p)").count() == 90
    assert len(seen) > 3 and all(before <= after for before, after in zip(seen, seen[1:]))
    assert answers.read().count() == answers.read().select("prompt_id").distinct().count() == 60
