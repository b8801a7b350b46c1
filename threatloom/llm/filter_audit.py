"""Filter interaction audit: what five filters remove in every order, and what each is worth on average.

Every document gets a mask of the filters it fails. Counts per mask tabulate what each of the 32 coalitions of filters
removes; the steps of any order are differences of two coalitions. Shapley values are the exact solution of the least
squares problem over coalitions with the Shapley kernel as weights and the constraint that the values add up to what all
filters remove. Its normal equations do not depend on the counts: they are solved once, in rationals, for the coefficients
that turn coalition counts into values, and Spark applies these to whole numbers.

Failing is decided text by text in Arrow batches but for equal texts: those meet by a digest, grouped before any shuffle. A null text is
empty. A null id has no smaller and no larger one, so its row neither fails the test of equal texts nor makes others fail
it; rows that repeat an id do not fail it for each other. An id with several labels counts as good (toxic) if one says so.
A null `lang` is the part ''. An empty table has no parts. Further columns are left alone.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import string
from collections.abc import Iterator
from fractions import Fraction
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm.scratch import store

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
MARKS = b"#$%&*|"
MEASURES = ("n", "good", "toxic")
_UPPER = string.ascii_uppercase.encode()


def own_mask(text: str) -> int:
    """The filters A to D that a text fails; bytes.split separates at ASCII white space only."""
    raw = text.encode()
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, _UPPER))
    failures = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * upper > MAX_UPPER_PERCENT * len(text),
        len(raw.translate(None, MARKS)) < len(raw),
    )
    return sum(1 << at for at, fails in enumerate(failures) if fails)


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, part, digest of the text and mask of every document."""
    for batch in batches:
        own, digests = [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            own.append(own_mask(text))
            digests.append(hashlib.sha256(text.encode()).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(own, pa.int32())],
            names=["doc_id", "part", "digest", "own"],
        )


def failure_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters they fail, bit 0 for the first filter."""
    texts = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    narrow = store(
        texts.mapInArrow(_masked, f"doc_id {id_type}, part string, digest binary, own int")
        .groupBy("digest", "doc_id", "part", "own").agg(F.count("*").alias("n")),
        "audit-documents",
    )
    # one id per text: joined by text and id, a text with many copies is spread over its ids
    first = narrow.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    copies = narrow.join(first.withColumn("_first", F.lit(True)), ["digest", "doc_id"], "left")
    last = 1 << (len(FILTERS) - 1)
    mask = F.col("own") + F.when(F.col("doc_id").isNotNull() & F.col("_first").isNull(), last).otherwise(0)
    known = store(
        labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("_good"),
            F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("_toxic"),
        ).where("_good OR _toxic"),
        "audit-labels",
    )
    masked = copies.select("doc_id", "part", mask.cast("int").alias("mask"), "n")
    return masked.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("_good"), F.col("n"))), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.when(F.col("_toxic"), F.col("n"))), F.lit(0)).alias("toxic"),
    )


def coalition_removals(counts: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """Per part `total` and, for each measure, an array of what every coalition of filters removes."""

    def removed(measure: str) -> Column:
        sums = [f"coalesce(sum({measure}) FILTER (WHERE mask & {s} <> 0), 0L)" for s in range(1 << filters)]
        return F.expr(f"array({', '.join(sums)})").alias(measure)

    return counts.groupBy("part").agg(F.sum("n").cast("long").alias("total"), *[removed(m) for m in MEASURES])


def solve_rational(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The X of matrix X = right, by elimination in rationals."""
    rows = [[*a, *b] for a, b in zip(matrix, right)]
    size = len(rows)
    for at in range(size):
        pivot = next(r for r in range(at, size) if rows[r][at])
        rows[at], rows[pivot] = rows[pivot], rows[at]
        rows[at] = [x / rows[at][at] for x in rows[at]]
        for r in range(size):
            if r != at and rows[r][at]:
                rows[r] = [x - rows[r][at] * y for x, y in zip(rows[r], rows[at])]
    return [row[size:] for row in rows]


def shapley_coefficients(filters: int) -> list[list[Fraction]]:
    """For each filter, what the removal of each coalition counts towards its Shapley value.

    Minimises the sum over coalitions S, none and all left out, of k(S) (sum of the values in S - removal of S)^2 under the
    constraint that all values add up to the removal of all, with k(S) = (f - 1) / (C(f, |S|) |S| (f - |S|)).
    """
    full = (1 << filters) - 1
    kernel = {
        s: Fraction(filters - 1, comb(filters, size) * size * (filters - size))
        for s in range(1, full) for size in [s.bit_count()]
    }
    has = lambda s, i: s >> i & 1
    matrix = [
        [*[sum((k for s, k in kernel.items() if has(s, i) and has(s, j)), Fraction(0)) for j in range(filters)], Fraction(1)]
        for i in range(filters)
    ]
    matrix.append([*[Fraction(1)] * filters, Fraction(0)])
    right = [[kernel.get(s, Fraction(0)) * has(s, i) for s in range(full + 1)] for i in range(filters)]
    right.append([Fraction(int(s == full)) for s in range(full + 1)])
    return solve_rational(matrix, right)[:filters]


def shapley_sums(filters: int) -> list[list[int]]:
    """The coefficients times the number of orders: what a filter removes, summed over all orders."""
    scaled = [[c * factorial(filters) for c in row] for row in shapley_coefficients(filters)]
    if any(c.denominator != 1 for row in scaled for c in row):
        raise ArithmeticError("the sums over all orders are not whole numbers")
    return [[int(c) for c in row] for row in scaled]


def order_steps(filters: str = FILTERS) -> list[dict]:
    """Every step of every order: the filter applied and the coalition before it."""
    steps = []
    for order in itertools.permutations(range(len(filters))):
        before = 0
        for step, at in enumerate(order, 1):
            steps.append({"filter_order": "".join(filters[i] for i in order), "step": step, "at": at, "before": before})
            before |= 1 << at
    return steps


def audit(removals: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order and step, from the table of coalitions."""
    full = (1 << len(filters)) - 1
    values = [" + ".join(f"({c}L * n[{s}])" for s, c in enumerate(row) if c) for row in shapley_sums(len(filters))]
    steps = F.from_json(
        F.lit(json.dumps(order_steps(filters))), "array<struct<filter_order: string, step: int, at: int, before: int>>"
    )
    rows = removals.withColumn("values", F.expr(f"array({', '.join(values)})")).withColumn("s", F.explode(steps)).select("*", "s.*")
    own = F.expr("shiftleft(1, at)")
    with_it = F.col("before").bitwiseOR(own)

    def of(measure: str, coalition: Column) -> Column:
        return F.get(F.col(measure), coalition)

    removed = of("n", with_it) - of("n", F.col("before"))
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - of("n", with_it)).alias("kept"),
        removed.alias("removed"),
        (of("n", own) - removed).alias("redundant"),
        (of("n", F.lit(full)) - of("n", F.lit(full).bitwiseXOR(own))).alias("unique_fails"),
        (of("good", with_it) - of("good", F.col("before"))).alias("good_lost"),
        (of("toxic", with_it) - of("toxic", F.col("before"))).alias("toxic_lost"),
        F.get(F.col("values"), F.col("at")).alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit(coalition_removals(failure_counts(documents, labels)))


_BITS = ", ".join(f"('{letter}', {1 << at})" for at, letter in enumerate(FILTERS))
SQL = rf"""
    WITH worded AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
               list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
        FROM documents),
    marked AS (
        SELECT doc_id, part, min(doc_id) OVER (PARTITION BY t) AS first_id,
               CASE WHEN len(words) < {MIN_WORDS} THEN 1 ELSE 0 END
               + CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words) THEN 2 ELSE 0 END
               + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MAX_UPPER_PERCENT} * length(t)
                      THEN 4 ELSE 0 END
               + CASE WHEN regexp_matches(t, '[{MARKS.decode()}]') THEN 8 ELSE 0 END AS own FROM worded),
    known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    masks AS (
        SELECT part, own + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask, count(*) AS n,
               count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
        FROM marked LEFT JOIN known USING (doc_id) GROUP BY 1, 2),
    letters(letter, bit) AS (VALUES {_BITS}),
    orders AS (
        SELECT [a, b, c, d, e] AS places FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
    steps AS (
        SELECT array_to_string(list_transform(places, lambda p: p.letter), '') AS filter_order, step, places[step].letter AS letter,
               places[step].bit AS bit, coalesce(list_sum(list_transform(places[:step - 1], lambda p: p.bit)), 0)::INTEGER AS before
        FROM orders, (VALUES (1), (2), (3), (4), (5)) s(step)),
    counted AS (
        SELECT part, filter_order, step, letter,
               coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
               coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
               coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
               coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
               coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
               coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
        FROM steps, masks GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
           unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
           (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
    FROM counted"""
