"""Quality classifier: an ensemble of sparse rules over text statistics.

Statistics of each text are Spark columns. Trees are grown on a bounded sample of labelled documents; each path from a
root to a node is a conjunctive rule. A logistic regression with an L1 penalty weighs the rules and leaves most at zero;
the others are compiled into one Spark column expression that scores every document, without Python.

A null text is an empty one; an empty text has all statistics 0 and is scored like any other. Every row is scored
by its text alone. Without labels of both kinds the score is the share of good labels (0.5 without any).
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm.labelled import remainder, training_labels
from threatloom.llm.scratch import store

#: At most so many labelled documents are learned from.
TRAINING_ROWS = 20_000
MODULUS, HELD_OUT = 4, 2
TREES, DEPTH = 24, 3
PENALTY = 1e-3
THRESHOLD = 0.7

_WHITE = r"[\x20\x09-\x0D]+"
STATISTICS = (
    "n_words", "word_length", "distinct_words", "distinct_lines", "symbols", "upper", "bangs", "bars", "digits",
    "stops", "commas", "words_per_line", "longest_word",
)

#: (statistic, upper bound?, value): the statistic is at most, or above, the value
Condition = tuple[str, bool, float]
Rule = tuple[Condition, ...]


class RuleModel(NamedTuple):
    rules: tuple[tuple[Rule, float], ...]
    bias: float


def with_statistics(documents: DataFrame) -> DataFrame:
    """`doc_id` and the statistics of each text, and what else the frame has but its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = documents.withColumns({
        "_t": text, "_chars": F.length(text), "_w": F.array_remove(F.split(text, _WHITE), ""),
        "_l": F.filter(F.split(text, "\n"), lambda line: line != ""),
    })
    n = F.greatest(F.size("_w"), F.lit(1))
    chars = F.greatest(F.col("_chars"), F.lit(1))

    def lost(pattern: str) -> Column:
        return (F.col("_chars") - F.length(F.regexp_replace("_t", pattern, ""))) / chars

    def of(char: str) -> Column:
        return (F.col("_chars") - F.length(F.replace("_t", F.lit(char), F.lit("")))) / n

    return split.withColumns({
        "n_words": F.size("_w").cast("double"),
        "word_length": F.length(F.array_join("_w", "")) / n,
        "distinct_words": F.size(F.array_distinct("_w")) / n,
        "distinct_lines": F.size(F.array_distinct("_l")) / F.greatest(F.size("_l"), F.lit(1)),
        "symbols": lost(r"[#*$%&<>]+"),
        "upper": lost(r"\p{Lu}+"),
        "bangs": of("!"), "bars": of("|"), "digits": lost("[0-9]+"), "stops": of("."), "commas": of(","),
        "words_per_line": n / F.greatest(F.size("_l"), F.lit(1)),
        "longest_word": F.coalesce(F.array_max(F.transform("_w", F.length)), F.lit(0)).cast("double"),
    }).drop("text", "_t", "_chars", "_w", "_l")


def _simplified(path: list[Condition]) -> Rule:
    """One bound per statistic and side, in fixed order."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, upper, value in path:
        key = (name, upper)
        bounds[key] = value if key not in bounds else (min if upper else max)(bounds[key], value)
    return tuple((name, upper, value) for (name, upper), value in sorted(bounds.items()))


def _paths(node, path: list[Condition], out: set[Rule]) -> None:
    """Rules of all nodes below one of a fitted tree."""
    if path:
        out.add(_simplified(path))
    if node.numDescendants() == 0:
        return
    split = node.split()
    name, value = STATISTICS[split.featureIndex()], round(split.threshold(), 9)
    _paths(node.leftChild(), [*path, (name, True, value)], out)
    _paths(node.rightChild(), [*path, (name, False, value)], out)


def rule_column(rule: Rule) -> Column:
    conditions = [F.col(name) <= value if upper else F.col(name) > value for name, upper, value in rule]
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


def fit_rules(training: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """Rules and weights from rows of statistics with an integer `label`."""
    kinds = {r.label: r["count"] for r in training.groupBy("label").count().collect()}
    good, bad = kinds.get(1, 0), kinds.get(0, 0)
    if not good or not bad:
        return RuleModel((), math.log((good + 0.5) / (bad + 0.5)))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(
        training.withColumn("label", F.col("label").cast("double"))
    )
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxBins=64, seed=7, minInstancesPerNode=5, featureSubsetStrategy="onethird"
    ).fit(vectors)
    found: set[Rule] = set()
    for tree in forest._java_obj.trees():
        _paths(tree.rootNode(), [], found)
    rules = sorted(found)
    if not rules:
        return RuleModel((), math.log(good / bad))
    marked = training.select(F.col("label").cast("double").alias("label"), F.array(
        *[rule_column(r).cast("double") for r in rules]).alias("_rules"))
    inputs = marked.select("label", _to_vector(F.col("_rules")).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(inputs)
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel(tuple((r, w) for r, w in zip(rules, weights) if w), lasso.intercept)


def _to_vector(array: Column) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(array)


def rule_score(model: RuleModel) -> Column:
    """The model as one column expression over the statistics, from 0 to 1."""
    total = F.lit(float(model.bias))
    for rule, weight in model.rules:
        total = total + F.when(rule_column(rule), F.lit(float(weight))).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = MODULUS,
        held_out: int = HELD_OUT, rows: int = TRAINING_ROWS) -> RuleModel:
    """Learn from at most `rows` labelled documents outside the held-out part, each distinct text once."""
    chosen = training_labels(labels, label, modulus, held_out, rows)  # bounded, so it may be broadcast
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    training = store(
        with_statistics(texts).groupBy(*STATISTICS).agg(F.max("label").cast("int").alias("label")), "quality-training"
    )
    return fit_rules(training)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_statistics(documents).select(
        "doc_id", (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), rule_score(model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
