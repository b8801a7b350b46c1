"""From raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; it is written to the shared folder as
Parquet and read again. All but the last return the columns of `documents`.

1. quality rules: documents that fail the rules or read unlike trusted ones go;
2. line dedup: lines that stand earlier, alike or nearly alike, go, and documents left without words;
3. near-dedup: of documents joined by a Jaccard similarity of 0.8 over five-word shingles the smallest doc_id stays;
4. benchmark decontamination: passages of test items are cut out, documents that are mostly such passages go;
5. packing: the documents' tokens, in pieces placed into sequences.

Nulls, empty texts, repeated rows and further columns are dealt with as the stages' modules say; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threatloom.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from threatloom.llm.scratch import store

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: Hashes of words, fingerprints and token ids have no counterpart in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = store(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
