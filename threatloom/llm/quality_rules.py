"""Quality rules: word and line rules, and the log-likelihood ratio of hashed n-grams (native).

Trusted documents give one multinomial over hashed word n-grams, all documents another. An n-gram of frequency f tells
itself from the rest of its bucket if f exceeds what a bucket holds of the rest, one in as many as there are buckets; so a
verdict depends on their number, not on how many n-grams share one. The number grows with the cube root of the text: what is
gathered grows with the corpus, and the ratios stay small enough for one constant of the plan (4 million of them at 100 TB), so
that every document is scored within its row, at every size alike. A document is kept if it passes
the rules and its mean log ratio per n-gram reaches a fixed threshold; no random draw is made.

Nulls and empty texts have no words and fail the rules; a null doc_id is reported like any other and is never trusted.
Repeated rows are counted and reported row by row. Without trusted documents every ratio is 0. Further columns are left alone.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm.scratch import is_small, once, store

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Buckets for up to `BUCKET_BYTES` of text; from there their number grows with the cube root of the text.
BUCKETS = 1 << 14
BUCKET_BYTES = 32 << 20
#: Added to the trusted count of each bucket and to the count expected of raw text of that size, so that buckets with few
#: trusted words say little and small sets of trusted documents reject no clean text.
SMOOTHING = 50.0
#: Smoothing is at least this share of a bucket's mean trusted count, so that ratios stay comparable as counts grow.
RELATIVE_SMOOTHING = 0.5
THRESHOLD = -0.033
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: At most so many trusted ids are broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def split_words(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def repeated_words(frame: DataFrame, words: str, name: str) -> DataFrame:
    """Add the number of words that lie in a window of three words found twice or more in the same text.

    Windows are compared by 64-bit hashes: sorted with their places, equal ones are neighbours. Everything is
    within the row, so that nothing is shuffled.
    """
    w = F.col(words)
    windows = F.when(
        F.size(w) > 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
        ),
    )
    ordered = F.when(F.size(F.array_distinct(F.col("_win.h"))) < F.size("_win"), F.sort_array("_win"))
    places = F.sort_array(
        F.transform(
            F.filter(
                F.col("_ordered"),
                lambda x, i: (x["h"] == F.get(F.col("_ordered"), i + 1)["h"])
                | (x["h"] == F.get(F.col("_ordered"), i - 1)["h"]),
            ),
            lambda x: x["p"],
        )
    )
    covered = F.aggregate(
        F.col("_places"),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    return (
        frame.withColumn("_win", windows)
        .withColumn("_ordered", ordered)
        .withColumn("_places", places)
        .withColumn(name, F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("_win", "_ordered", "_places")
    )


def rule_columns(frame: DataFrame, text: str = "_text", words: str = "_words") -> DataFrame:
    """Add the counts of the rules and `base_failed`."""
    w, t = F.col(words), F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: F.length(F.trim(F.translate(line, "\t\x0b\x0c\r", "    "))) > 0)
    counted = frame.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
        "_lines": lines,
    }).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    return repeated_words(counted, words, "n_repeat_words").withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED_PERCENT) * F.col("n_words")),
    )


def _hashes(w: Column, i: Column) -> tuple[Column, Column]:
    """Hashes of the word at a place and of it with the next; the last word is paired with an empty one."""
    word = F.get(w, i)
    return F.xxhash64(word), F.xxhash64(word, F.coalesce(F.get(w, i + 1), F.lit("")))


def _buckets(w: Column, i: Column, buckets: int) -> tuple[Column, Column]:
    """Buckets of the two n-grams at a place."""
    one, two = (F.pmod(h, F.lit(buckets)).cast("int") for h in _hashes(w, i))
    return one, two


def _places(w: Column) -> Column:
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the trusted documents: those labelled good."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def _grams(documents: DataFrame) -> DataFrame:
    """A row per n-gram with its hash `h`, next to all columns but `text`; without lambdas, which are not compiled."""
    own = [c for c in documents.columns if c != "text"]
    words = documents.select(*own, once(split_words(F.col("text"))).alias("_words"))
    pairs = F.arrays_zip(F.col("_words").alias("one"), F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))).alias("two"))
    placed = words.select(*own, F.explode(pairs).alias("x"))
    one, two = F.col("x.one"), F.coalesce(F.col("x.two"), F.lit(""))
    return placed.select(*own, F.explode(F.array(F.xxhash64(one), F.xxhash64(one, two))).alias("h"))


def bucket_number(documents: DataFrame) -> int:
    """A power of two that grows with the cube root of the bytes of text, from `BUCKETS` on."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    times = (max(size, BUCKET_BYTES) / BUCKET_BYTES) ** (1 / 3)
    return BUCKETS << math.ceil(math.log2(times) - 1e-9)


def ratio_table(documents: DataFrame, trusted: DataFrame, buckets: int, smoothing: float = SMOOTHING,
                relative: float = RELATIVE_SMOOTHING) -> DataFrame:
    """Per bucket that occurs, `micro`: millionths of the log of the smoothed trusted over the raw probability.

    Counted over all documents and stored. Smoothing is at least `relative` times the mean trusted count of a bucket.
    """
    marks = trusted.select("doc_id", F.lit(True).alias("_trusted"))
    if is_small(marks, BROADCAST_IDS):
        marks = F.broadcast(marks)
    marked = documents.select("doc_id", "text").join(marks, "doc_id", "left")
    counts = store(
        _grams(marked.select(F.col("_trusted").isNotNull().alias("_trusted"), "text"))
        .groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"))
        .agg(F.count("*").alias("raw"), F.count_if("_trusted").alias("target")),
        "bucket-counts",
    )
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    if not target:
        return counts.select("bucket", F.lit(0).cast("long").alias("micro"))
    add = F.lit(float(max(smoothing, relative * target / buckets)))
    ratio = F.log((F.col("target") + add) / (F.col("raw") * F.lit(target / raw) + add))
    return counts.select("bucket", F.round(ratio * 1e6).cast("long").alias("micro"))


def mean_ratio(words: str, micros: list[int]) -> Column:
    """Mean log ratio over a document's n-grams, from the millionths of each bucket; 0 without words."""
    w, n = F.col(words), len(micros)
    table = F.from_json(F.lit(json.dumps(micros, separators=(",", ":"))), "array<int>")  # folded to one constant

    def add(acc: Column, i: Column) -> Column:
        one, two = _buckets(w, i, n)
        return acc + F.get(table, one) + F.get(table, two)

    total = F.aggregate(_places(w), F.lit(0).cast("long"), add)
    return F.coalesce(total / (F.lit(2) * F.size(w)) / F.lit(1e6), F.lit(0.0))


def quality_rules(documents: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD,
                  buckets: int | None = None) -> DataFrame:
    """Every document with its counts, `base_failed`, `log_ratio` and `kept`; the document's columns stay first.

    The number of buckets follows the amount of text unless it is given. Names that a document's further columns share with the
    result are replaced by the result's.
    """
    buckets = buckets or bucket_number(documents)
    micros = [0] * buckets
    for row in ratio_table(documents, trusted, buckets).collect():  # a row per bucket
        micros[row.bucket] = row.micro
    ruled = rule_columns(documents.withColumn("_words", split_words(F.col("text"))), "text")
    scored = ruled.withColumn("log_ratio", mean_ratio("_words", micros)).drop("_words")
    return scored.withColumn("kept", once(~F.col("base_failed") & (F.col("log_ratio") >= threshold)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(documents, trusted_ids(labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("log_ratio", 6).alias("log_ratio"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select("doc_id", "text", F.struct("*").alias("_row"))  # apart from the names used here
    return quality_rules(rows, trusted_ids(labels)).where("kept").select("_row.*")
