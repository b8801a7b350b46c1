"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding maps letters to lower case without marks, look-alike letters of other scripts and digits or signs written for
letters to one form; everything else separates words. The lexicon is learned from labelled documents, each distinct
text once: words, and stems of words, that toxic documents have far more often, weighted by their log odds. Phrases of
a lexicon word with a neighbour that stand mostly in clean documents are exceptions: hits within them do not count.
The sum of the weights of a document's hits per words is calibrated to a probability by a logistic curve.

Null and empty texts have no hits. Every row is scored by its text alone. Without labelled documents of both kinds, or
without lexicon words, the score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm.labelled import remainder, training_labels
from threatloom.llm.scratch import store

#: At most so many labelled documents are learned from.
TRAINING_ROWS = 30_000
MODULUS, HELD_OUT = 5, 0
MIN_TEXTS = 3
MIN_WEIGHT = 2.0
#: Lengths of stems that may enter.
STEM_CHARS = (4, 5, 6, 7, 8)
#: A stem needs so many different words, so that it is more than one of them.
MIN_STEM_WORDS = 3
THRESHOLD = 0.5

# fixed values: letters of other scripts, digits and signs that are written for Latin letters
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "α": "a", "β": "b", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "l": "i",
}


class _FoldTable(dict):
    """Code point -> folded text, filled as code points are met."""

    def __missing__(self, point: int) -> str:
        out = ""
        for char in unicodedata.normalize("NFKD", chr(point).lower()):
            char = LOOK_ALIKE.get(char, char)
            out += char if char.isalnum() else "" if unicodedata.combining(char) or char == "​" else " "
        self[point] = out
        return out


_FOLDED = _FoldTable()


def fold(text: str | None) -> str:
    """Folded words; `l` and `1` both become `i`."""
    return text.translate(_FOLDED) if text else ""


class Lexicon(NamedTuple):
    words: dict[str, float]
    stems: dict[str, float]
    exceptions: tuple[str, ...] = ()


class Matcher:
    """Aho-Corasick automaton over whole words, beginnings of words and exception phrases."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.stems.items():
            self.automaton.add_word(f" {entry}", (len(entry) + 1, weight))
        for entry, weight in lexicon.words.items():
            self.automaton.add_word(f" {entry} ", (len(entry) + 2, weight))
        for phrase in lexicon.exceptions:
            folded = " ".join(fold(phrase).split())
            if folded:
                self.automaton.add_word(f" {folded} ", (len(folded) + 2, None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> tuple[float, int, list[tuple[int, int]]]:
        """Sum of weights, number of words and places of the hits in the folded words; a word counts once."""
        folded = fold(text).split()
        if self.empty or not folded:
            return 0.0, len(folded), []
        line = f" {' '.join(folded)} "
        best: dict[int, tuple[float, int]] = {}
        excepted = []
        for end, (length, weight) in self.automaton.iter(line):
            begin = end - length + 1
            if weight is None:
                excepted.append((begin, end))
            elif begin not in best or weight > best[begin][0]:
                best[begin] = (weight, line.index(" ", begin + 1))
        excepted.sort()
        kept, n, reach = [], 0, -1  # one pass over both: the furthest end of the phrases begun so far
        for begin, (weight, end) in sorted(best.items()):
            while n < len(excepted) and excepted[n][0] <= begin:
                reach = max(reach, excepted[n][1])
                n += 1
            if reach < end:
                kept.append((weight, begin + 1, end))
        return sum(w for w, _, _ in kept), len(folded), [(b, e) for _, b, e in kept]


def features(total: float, words: int) -> tuple[float, float]:
    """Weight per thousand words and per square root of the words, on log scales; very short texts count as 20 words.

    The first is the normalised sum; the second keeps a long text with several hits apart from one with a chance hit.
    """
    size = max(words, 20)
    return math.log1p(1000 * total / size), math.log1p(10 * total / math.sqrt(size))


_matchers: dict[str, Matcher] = {}


def _matcher(key: str, lexicon: Broadcast) -> Matcher:
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(lexicon.value)
    return _matchers[key]


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, labels = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            own = set(fold(text).split())
            words += own
            labels += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32())], names=["word", "label"])


def _phrases(key: str, lexicon: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, lexicon)
        for batch in batches:
            rows = set()
            for n, (text, label) in enumerate(zip(batch.column("text").to_pylist(), batch.column("label").to_pylist())):
                line = f" {' '.join(fold(text).split())} "
                for begin, end in matcher.hits(text)[2]:
                    before, after = line[: begin - 1].rpartition(" ")[2], line[end + 1 :].partition(" ")[0]
                    rows |= {(n, f"{before} {line[begin:end]}", label)} if before else set()
                    rows |= {(n, f"{line[begin:end]} {after}", label)} if after else set()
            ordered = sorted(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in ordered], pa.string()), pa.array([r[2] for r in ordered], pa.int32())],
                names=["word", "label"])

    return run


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def learn_lexicon(training: DataFrame, min_texts: int = MIN_TEXTS, min_weight: float = MIN_WEIGHT) -> Lexicon:
    """Lexicon from distinct `text`, `label` rows; word counts are aggregated by Spark, entries are few."""
    totals = training.agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).first()
    if not totals.t or not totals.c:
        return Lexicon({}, {})
    toxic, clean = F.col("toxic"), F.col("clean")
    weight = F.log((toxic + 0.5) / (totals.t + 1)) - F.log((clean + 0.5) / (totals.c + 1))
    # likelihood ratio against the same share in both kinds of text
    share = totals.t / (totals.t + totals.c)
    both = toxic + clean
    ratio = 2 * (toxic * F.log(toxic / (both * share)) + F.when(clean > 0, clean * F.log(clean / (both * (1 - share)))).otherwise(0))
    words = store(_counted(training.mapInArrow(_document_words, "word string, label int")), "toxic-words")
    stems = (
        words.select(
            "toxic", "clean",
            F.explode(F.array_compact(F.array(*[
                F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEM_CHARS
            ]))).alias("word"),
        )
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("words"))
        .where(f"words >= {MIN_STEM_WORDS}")
        .drop("words")
    )
    # so strict that about one of all words would enter by chance
    chance = 2 * math.log(max(words.count(), 2))
    entry = (toxic >= min_texts) & (weight >= min_weight) & (ratio >= chance)
    found = [
        {r.word: round(r.w, 6) for r in frame.where(entry).select("word", weight.alias("w")).collect()}
        for frame in (words, stems)
    ]
    return Lexicon(*found)


def learn_exceptions(training: DataFrame, lexicon: Lexicon, min_texts: int = MIN_TEXTS) -> Lexicon:
    """The lexicon with phrases that stand in clean documents for the most part."""
    shared = training.sparkSession.sparkContext.broadcast(lexicon)
    phrases = _counted(training.mapInArrow(_phrases(uuid.uuid4().hex, shared), "word string, label int"))
    rows = phrases.where(F.col("clean") >= F.greatest(F.lit(min_texts), 3 * F.col("toxic"))).select("word").collect()
    return lexicon._replace(exceptions=(*lexicon.exceptions, *sorted(r.word for r in rows)))


def _scorer(key: str, lexicon: Broadcast, slopes: tuple[float, ...], bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, lexicon)
        for batch in batches:
            scores, counts = [], []
            for text in batch.column("text").to_pylist():
                total, words, places = matcher.hits(text)
                margin = bias + sum(s * x for s, x in zip(slopes, features(total, words)))
                scores.append(1 / (1 + math.exp(-min(max(margin, -30), 30))))
                counts.append(len(places))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(scores, pa.float64()), pa.array(counts, pa.int64())],
                names=batch.schema.names)

    return run


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Logistic curve by Newton steps, with a small ridge."""
    design = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(design.shape[1]), np.full(design.shape[1], 1e-2)
    ridge[-1] = 1e-4
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hessian, design.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w[:-1].tolist()), float(w[-1])


class ToxicityModel(NamedTuple):
    lexicon: Lexicon
    slopes: tuple[float, ...]
    bias: float


def _densities(key: str, lexicon: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, lexicon)
        for batch in batches:
            values = [features(*matcher.hits(t)[:2]) for t in batch.column("text").to_pylist()]
            columns = [pa.array([v[i] for v in values], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("label")], names=["x1", "x2", "label"])

    return run


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = MODULUS, held_out: int = HELD_OUT,
        rows: int = TRAINING_ROWS, exceptions: tuple[str, ...] = ()) -> ToxicityModel:
    """Learn from at most `rows` labelled documents outside the held-out part; `exceptions` are further phrases."""
    chosen = training_labels(labels, label, modulus, held_out, rows)  # bounded, so it may be broadcast
    training = store(
        documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .where("text IS NOT NULL").groupBy("text").agg(F.max("label").cast("int").alias("label")),
        "toxic-training",
    )
    lexicon = learn_lexicon(training)._replace(exceptions=exceptions)
    lexicon = learn_exceptions(training, lexicon)
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)
    pairs = training.mapInArrow(_densities(uuid.uuid4().hex, shared), "x1 double, x2 double, label int").toPandas()
    y = pairs["label"].to_numpy(float)
    if not len(y):
        return ToxicityModel(lexicon, (0.0, 0.0), -30.0)
    return ToxicityModel(lexicon, *_calibrate(pairs[["x1", "x2"]].to_numpy(float), y))


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """Documents with `score` and `n_hits`, which replace columns of these names."""
    shared = documents.sparkSession.sparkContext.broadcast(model.lexicon)
    frame = documents.drop("score", "n_hits").withColumns({"score": F.lit(0.0), "n_hits": F.lit(0).cast("long")})
    return frame.mapInArrow(_scorer(uuid.uuid4().hex, shared, model.slopes, model.bias), frame.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model).select(
        "doc_id", (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits",
    )
