"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. A document's words are streamed through it, keeping the length
of the longest run that ends at each word; where that run reaches a window of an item, its words are hit. Item
windows are `window` words long, or the whole item if it has fewer.

Nulls and empty texts have no words and are clean; items without words have no windows; equal items all count. Every
row gets its own result, whatever its doc_id. Without items nothing is hit. Results are in one struct column, so that
a document's own columns cannot clash with them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
#: Words of the items in one automaton; more items are scanned for in further passes.
BLOCK_WORDS = 200_000
#: A document with more than this share of its words hit goes; of others the hit spans go.
MAX_COVERAGE = 0.5

#: words in text that is not lower-cased yet
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("runs", T.ArrayType(T.ArrayType(T.IntegerType()))),  # [first, end) in words, merged
    T.StructField("text", T.StringType()),
])


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Suffix automaton of word sequences, with the item windows marked on its states."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((item, ids))
            last = 0
            for word in ids:
                last = self._extend(last, word)
        #: state -> {length of a window: items that have it}
        self.marks: dict[int, dict[int, set[str]]] = {}
        self.shortest = 1 << 30
        for item, ids in coded:
            size = min(window, len(ids))
            if not size:
                continue
            self.shortest = min(self.shortest, size)
            state = 0
            for end, word in enumerate(ids, 1):
                state = self.next[state][word]
                if end >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    self.marks.setdefault(at, {}).setdefault(size, set()).add(item)
        # the nearest state with marks, from each state on, along the links
        self.marked = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.marked[state] = state if state in self.marks else self.marked[self.link[state]]

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0)
        while last != -1 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last != -1:
            target = self.next[last][word]
            exact = self.length[target] == self.length[last] + 1
            self.link[new] = target if exact else self._split(last, word, target)
        return new

    def _split(self, last: int, word: int, target: int) -> int:
        copy = self._state(self.length[last] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while last != -1 and self.next[last].get(word) == target:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def matches(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged runs of hit words, and the items whose windows occur."""
        runs: list[list[int]] = []
        found: set[str] = set()
        find = self.vocabulary.get
        ids = np.fromiter((find(w, -1) for w in words), np.int32, len(words))
        # a word of no item ends every run: only stretches of known words that can hold a window are streamed
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        for begin, end in edge.reshape(-1, 2)[edge[1::2] - edge[::2] >= self.shortest].tolist():
            self._stream(ids[begin:end].tolist(), begin, runs, found)
        return runs, found

    def _stream(self, ids: list[int], begin: int, runs: list[list[int]], found: set[str]) -> None:
        edges, link, lengths, marked, marks = self.next, self.link, self.length, self.marked, self.marks
        state = size = 0
        for end, word in enumerate(ids, begin + 1):
            while state and word not in edges[state]:
                state = link[state]
                size = lengths[state]
            state = edges[state].get(word, 0)
            size = size + 1 if state else 0
            at, longest = marked[state], 0
            while at > 0:
                for length, items in marks[at].items():
                    if length <= size:
                        longest = max(longest, length)
                        found |= items
                at = marked[link[at]]
            if longest:
                if runs and runs[-1][1] >= end - longest:
                    # a later match may begin before an earlier one
                    first = min(runs[-1][0], end - longest)
                    runs[-1][:] = [first, end]
                    while len(runs) > 1 and runs[-2][1] >= runs[-1][0]:
                        runs[-2][:] = [min(runs[-2][0], runs[-1][0]), runs[-1][1]]
                        runs.pop()
                else:
                    runs.append([end - longest, end])


_automata: dict[str, ItemAutomaton] = {}


def _automaton(key: str, items: Broadcast, window: int) -> ItemAutomaton:
    """One automaton per worker process and block of items."""
    if key not in _automata:
        while len(_automata) > 1:
            _automata.pop(next(iter(_automata)))
        _automata[key] = ItemAutomaton(items.value, window)
    return _automata[key]


def _merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, end in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def without_runs(text: str, runs: list[list[int]]) -> str:
    """The text without the given runs of words, and what lies between a run's words; one space stands for each run."""
    spans = [m.span() for m in _WORD.finditer(text)]
    parts, at = [], 0
    for first, end in runs:
        parts.append(text[at : spans[first][0]])
        at = spans[end - 1][1]
    return " ".join([*(p.rstrip(" ") for p in parts), text[at:].lstrip(" ")]) if parts else text


def _scanner(items: Broadcast, window: int, cleaned: bool):
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, items, window)
        kind = pa.struct([
            ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
            ("runs", pa.list_(pa.list_(pa.int32()))), ("text", pa.string()),
        ])
        for batch in batches:
            rows = []
            for text, before in zip(batch.column("text").to_pylist(), batch.column("_found").to_pylist()):
                words = words_of(text)
                runs, found = automaton.matches(words)
                runs = _merged(runs + before["runs"])
                rows.append({
                    "n_words": len(words), "n_hit": sum(b - a for a, b in runs),
                    "items": sorted(found.union(before["items"])), "runs": runs,
                    "text": without_runs(text, runs) if cleaned and runs else None,
                })
            columns = [*batch.columns[:-1], pa.array(rows, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return scan


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, read one partition at a time, in blocks of bounded size."""
    block, size = [], 0
    for row in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        if words := words_of(row.text):
            if block and size + len(words) > block_words:
                yield block
                block, size = [], 0
            block.append((str(row.item_id), words))
            size += len(words)
    yield block


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, cleaned: bool = False,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document row with `_found` (which replaces a column of this name): its words, hit words, items, hit runs and, if asked for, the text without them
    (null where nothing is hit). Nothing is shuffled; each block of items is broadcast, its size is bounded."""
    spark = documents.sparkSession
    empty = "named_struct('n_words', 0L, 'n_hit', 0L, 'items', array(), 'runs', array(), 'text', null)"
    frame = documents.drop("_found").withColumn("_found", F.expr(empty).cast(FOUND))
    for block in item_blocks(benchmark, block_words):
        frame = frame.mapInArrow(_scanner(spark.sparkContext.broadcast(block), window, cleaned), frame.schema)
    return frame


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """Documents with hit spans cut out; those with more than `max_coverage` of their words hit go."""
    inner = {c: f"c{i}" for i, c in enumerate(documents.columns) if c != "text"}  # apart from the names used here
    found = contamination(documents.withColumnsRenamed(inner), benchmark, window, cleaned=True)
    return found.where(F.col("_found.n_hit") <= max_coverage * F.col("_found.n_words")).select(
        *(F.coalesce("_found.text", "text").alias(c) if c == "text" else F.col(inner[c]).alias(c) for c in documents.columns)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "_found.n_words", "_found.n_hit", F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_found.items", ","), 256).alias("items_sha256"),
        (F.col("_found.n_hit") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS t
        FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p
              FROM b WHERE len(w) > 0)),
     dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS t
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw)
              WHERE len(w) >= n)),
     m AS (SELECT doc_id, item_id, p, n FROM dw JOIN bw USING (n, t)),
     h AS (SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
     i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
