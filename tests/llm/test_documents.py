"""Odd rows through every operator and stage that takes documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from threatloom.llm import (
    decontaminate, line_dedup, packing, quality_rules, rule_ensemble, secrets, simhash, token_shards, toxicity,
)
from threatloom.session import run_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(40_000))
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven", "en", "a", 5),
    (1, "one two three four five six seven eight nine ten eleven", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (4, " \n\t \n", None, "b", 3),
    (None, "a row without an id", "en", "b", 3),
    (5, LONG, "en", "b", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (7, "é ü 日本 🙂\x1c x\x85y   z", "xx", "c", 9),
]
CLASHES = ["n_words", "kept", "score", "spans", "_found", "_row", "_words", "fp", "key", "ids", "th", "_nth", "_drops"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(documents):
    return documents.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, "two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, "!!"), (5, "without an id")],
        "item_id long, text string",
    )


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 0)],
                                 "doc_id long, quality int, toxic int")


def operators(documents, benchmark, labels):
    spark = documents.sparkSession
    return {
        "quality_rules": lambda d: quality_rules.quality_rules(d, quality_rules.trusted_ids(labels)),
        "line_dedup": line_dedup.dedup_lines,
        "simhash": simhash.near_duplicates,
        "one_per_group": simhash.one_per_group,
        "contamination": lambda d: decontaminate.contamination(d, benchmark),
        "decontaminate": lambda d: decontaminate.decontaminate(d, benchmark),
        "pack": packing.pack,
        "shards": lambda d: token_shards.read_sequences(token_shards.write_shards(d, run_dir(spark, "shards"))),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "secrets": lambda d: secrets.scan_secrets(d, secrets.fit(d)),
        "rules": lambda d: rule_ensemble.with_statistics(d.select("doc_id", "text")).withColumn(
            "score", rule_ensemble.rule_score(rule_ensemble.fit(d, labels))),
    }


NAMES = ["quality_rules", "line_dedup", "simhash", "one_per_group", "contamination", "decontaminate", "pack", "shards",
         "toxicity", "secrets", "rules"]
STAGE_LIKE = ["line_dedup", "one_per_group", "decontaminate"]
ROW_FOR_ROW = ["quality_rules", "simhash", "contamination", "toxicity", "secrets", "rules"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(documents, clashing, benchmark, labels, name):
    operator = operators(documents, benchmark, labels)[name]
    rows = operator(clashing).collect()
    if name in ROW_FOR_ROW:
        assert len(rows) == len(ROWS)
    if name in STAGE_LIKE:
        assert rows and list(rows[0].asDict()) == clashing.columns
        assert all(r["kept"] == "own kept" and r["_found"] == "own _found" and r["th"] == "own th" for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(documents, benchmark, labels, name):
    empty = documents.limit(0)
    assert operators(empty, benchmark, labels)[name](empty).collect() == []


def test_quality_stage_keeps_columns(spark, clashing, tmp_path):
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = quality_rules.stage(spark, clashing, str(tmp_path))
    assert kept.columns == clashing.columns
    assert {r.n_words for r in kept.collect()} <= {"own n_words"}


def test_line_dedup_results(documents):
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents).collect()}
    assert got[1] == ROWS[0][1] and got[None] == "a row without an id"
    assert got[2] is None and got[3] == "" and got[4] == ROWS[4][1]
    assert got[5] == LONG and 6 not in got  # the later copy lost its only line


def test_one_per_group_results(documents):
    got = sorted((r.doc_id or -1) for r in simhash.one_per_group(documents).collect())
    # 2, 3 and 4 have no words and one fingerprint, 5 and 6 are equal, 1 stands twice
    assert got == [-1, 1, 2, 5, 7]


def test_contamination_results(documents, benchmark):
    got = {r.doc_id: r["_found"] for r in decontaminate.contamination(documents, benchmark).collect()}
    assert (got[1].n_hit, got[1].items, got[1].n_words) == (10, ["1"], 11)
    assert (got[None].n_hit, got[None].items) == (3, ["5"])
    assert all(got[d].n_hit == 0 for d in (2, 3, 4, 5, 6, 7)) and got[2].n_words == 0
    assert decontaminate.contamination(documents, benchmark.limit(0)).where("_found.n_hit > 0").count() == 0
