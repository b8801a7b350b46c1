"""Groups of documents whose sets of word shingles have a Jaccard similarity of at least a bound.

The join is exact. Two sets of similarity t share at least t of each of them, so that under one order of all shingles they
share one of the first n - ceil(t n) + 1 of each (prefix filter). The order puts shingles of rare cells first: shingles are
hashed into `CELLS` cells whose counts are taken over all documents, so that a common passage is a key of few documents.

0. Links between documents that a method such as op7's fingerprints has found may be given; they are verified by the
   documents' sets and joined first, so that the join looks only for what they leave apart.
1. Each document gives the digest of its set of hashed shingles and its keys; documents of equal sets are one node.
2. In each key's bucket, nodes are paired with the first one that is not too short for them; pairs that share enough of some
   more shingles in that order are verified by their sets, and verified ones joined into components.
3. Of buckets of three and more, pairs of nodes in different components are verified too. So a large group of near copies
   gives few pairs, and no similar pair is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.components import connected_components
from threatloom.llm.scratch import drop_table, is_small, store, write_table

#: A mark of a text, and links `a`, `b` between marks of a column `fp` that are close.
Marks = tuple[Callable[[str | None], int], Callable[[DataFrame], DataFrame]]

SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
CELLS = 1 << 18
#: Share of a set that is kept beside its keys, to leave out pairs before their sets are made.
AHEAD = 0.15
#: At most so many rows (node and component) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Hashes of one batch of sets, and pairs of one batch of candidates.
_FLUSH = 1 << 20


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of a text's word shingles in their order; bytes.split separates at ASCII white space only."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle, len(words))
    begins = np.concatenate(([0], ends[: len(words) - size] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(begins, ends[size - 1 :].tolist())], "<u8")


def shingle_set(text: str | None, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle."""
    return np.unique(shingle_hashes(text, shingle))


def _least_shared(n: int, similarity: float) -> int:
    """How many of its `n` shingles a set shares with any set similar to it."""
    return math.ceil(similarity * n - 1e-9)


def _cells(shingle: int):
    """Counts of the cells of a task's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(counts, (shingle_set(text.as_py(), shingle) % np.uint64(CELLS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["cell", "n"])

    return run


def _node_of(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw, 7)


def _ahead(n: int) -> int:
    """How many shingles two similar sets share at least among those that are kept of them.

    If sets share all but r of the n shingles of one, they share l among its first r + l, and so for the other.
    """
    return max(1, math.ceil(AHEAD * n))


def _keyed(shingle: int, similarity: float, ranks, mark: Callable[[str | None], int]):
    """Per document: its node, how many shingles it has, its first shingles, how many of these are its keys, and its mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = ranks.value
        for batch in batches:
            ids, begin, held = batch.column("doc_id"), 0, 0
            rows: list[tuple] = []
            for at, text in enumerate(batch.column("text")):
                own = shingle_set(text.as_py(), shingle)
                order = np.lexsort((own, counts[(own % np.uint64(CELLS)).astype(np.int64)]))
                spare = len(own) - _least_shared(len(own), similarity)
                first = own[order[: spare + _ahead(len(own))]]
                rows.append((_node_of(own.tobytes()), len(own), first.view(np.int64), min(len(first), spare + 1), mark(text.as_py())))
                held += len(first)
                if held > _FLUSH or at == len(ids) - 1:
                    nodes, sizes, firsts, keyed, marks = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(begin, len(rows)), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                         pa.array(sizes, pa.int32()), pa.array(list(firsts), pa.list_(pa.int64())), pa.array(keyed, pa.int32()),
                         pa.array(np.array(marks, np.uint64).view(np.int64))],
                        names=["doc_id", "node", "n", "first", "keyed", "fp"])
                    begin, held, rows = at + 1, 0, []

    return run


def _sets(shingle: int):
    """Node and set of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for at, text in enumerate(batch.column("text")):
                raw = shingle_set(text.as_py(), shingle).tobytes()
                rows.append((_node_of(raw), raw))
                held += len(raw)
                if held > 8 * _FLUSH or at == batch.num_rows - 1:
                    nodes, raws = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(raws, pa.binary())], names=["node", "members"])
                    held, rows = 0, []

    return run


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole buckets of sorted rows, columns as arrays; a bucket may lie across batches."""
    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        new = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
        cut = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
        if cut:
            yield tuple(x[:cut] for x in held)
            held = tuple(x[cut:] for x in held)
    if held is not None and len(held[0]):
        yield held


def _pair_batch(a: list, b: list) -> pa.RecordBatch:
    both = np.unique(np.sort(np.array([a, b], np.int64).T, axis=1), axis=0) if a else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def _stars(similarity: float):
    """Pairs of each node with the first of its bucket that is not too short for it, if not in one component already.

    Rows are sorted by key, n and node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sizes, nodes, parts in _bucketed(batches):
            edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            a, b = [], []
            for begin, end in zip(edge[:-1][np.diff(edge) > 1].tolist(), edge[1:][np.diff(edge) > 1].tolist()):
                hub = begin
                for at in range(begin + 1, end):
                    if sizes[hub] < _least_shared(int(sizes[at]), similarity):
                        hub = at
                    elif parts[at] != parts[hub]:
                        a.append(nodes[hub])
                        b.append(nodes[at])
            yield _pair_batch(a, b)

    return run


def _crossing(similarity: float):
    """Pairs of a bucket's nodes that lie in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sizes, nodes, parts in _bucketed(batches):
            edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            a, b = [], []
            for begin, end in zip(edge[:-1][np.diff(edge) > 2].tolist(), edge[1:][np.diff(edge) > 2].tolist()):
                if (parts[begin:end] == parts[begin]).all():
                    continue
                for at in range(begin + 1, end):
                    least = _least_shared(int(sizes[at]), similarity)
                    other = np.arange(begin + np.searchsorted(sizes[begin:at], least), at)
                    other = other[parts[other] != parts[at]]
                    a += nodes[other].tolist()
                    b += [nodes[at]] * len(other)
                    if len(a) > _FLUSH:
                        yield _pair_batch(a, b)
                        a, b = [], []
            yield _pair_batch(a, b)

    return run


def _verified(similarity: float):
    """Pairs whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for one, two in zip(batch.column("one"), batch.column("two")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (one, two))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    return run


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that share as many of the shingles kept of them as similar sets do."""
    for batch in batches:
        near = []
        for n, one, m, two in zip(*(batch.column(c) for c in ("n", "one", "m", "two"))):
            x, y = (v.values.to_numpy() for v in (one, two))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            near.append(shared >= min(_ahead(n.as_py()), _ahead(m.as_py()), len(x), len(y)))
        yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _few(rows: DataFrame, name: str) -> DataFrame:
    """A stored table, to be broadcast if it is small."""
    kept = store(rows, name)
    return F.broadcast(kept) if is_small(kept, BROADCAST_ROWS) else kept


def _similar_pairs(pairs: DataFrame, texts: DataFrame, every: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs `a`, `b` that are similar, stored.

    Their first shingles, which are at hand, leave out what shares a passage only; nothing similar is lost by that. The sets
    of the rest are made again from one text each.
    """
    pairs = store(pairs.distinct(), "pairs")
    firsts = every.select("node", "n", "first").join(_few(_nodes_of(pairs), "paired-nodes"), "node", "left_semi").groupBy(
        "node").agg(F.first("n").alias("n"), F.first("first").alias("first"))
    firsts = store(firsts, "paired-firsts")
    both = pairs.join(firsts.select(F.col("node").alias("a"), "n", F.col("first").alias("one")), "a").join(
        firsts.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("first").alias("two")), "b"
    )
    left = store(both.select("a", "b", "n", "one", "m", "two").mapInArrow(_promising, "a long, b long"), "promising")
    sets = store(_sets_of(_nodes_of(left), texts, every, shingle), "paired-sets")
    whole = left.join(sets.select(F.col("node").alias("a"), F.col("members").alias("one")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("members").alias("two")), "b"
    )
    return store(whole.select("a", "b", "one", "two").mapInArrow(_verified(similarity), "a long, b long"), "similar-pairs")


def _sets_of(nodes: DataFrame, texts: DataFrame, every: DataFrame, shingle: int) -> DataFrame:
    """Node and set of some nodes, made again from one text of each."""
    nodes = _few(nodes, "wanted-nodes")
    of_node = every.select("doc_id", "node").join(nodes, "node", "left_semi")
    # an id may be null, which a struct keeps
    first = of_node.groupBy("node").agg(F.min(F.struct("doc_id")).alias("one")).select(F.col("one.doc_id").alias("_id"))
    ids = _few(first.distinct(), "wanted-ids")
    chosen = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    made = chosen.select("text").mapInArrow(_sets(shingle), "node long, members binary")
    # an id may stand for other texts as well
    return made.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("members").alias("members"))


def _marked_pairs(every: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs of nodes with equal marks, or with linked ones, each mark standing for its smallest node."""
    marked = store(every.select("fp", "node").distinct(), "marked-nodes")
    first = store(marked.groupBy("fp").agg(F.min("node").alias("least")), "marks")
    equal = marked.join(first, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    found = links(first.select("fp")).join(first.select(F.col("fp").alias("a"), F.col("least").alias("one")), "a").join(
        first.select(F.col("fp").alias("b"), F.col("least").alias("two")), "b"
    )
    linked = found.where("one <> two").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
    return equal.union(linked)


def similar_groups(
    documents: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, marks: Marks | None = None
) -> DataFrame:
    """`doc_id`, `node` and `component_id`, the smallest doc_id reachable by similar pairs, of every row.

    With `marks`, links between close marks are candidates before all others.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    cells = texts.select("text").mapInArrow(_cells(shingle), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts, found = np.zeros(CELLS, np.int64), cells.toArrow()  # at most a row per cell
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    ranks = spark.sparkContext.broadcast(counts)
    # sets are not kept: they are as large as the texts, and only those of pairs are wanted
    every = store(
        texts.mapInArrow(
            _keyed(shingle, similarity, ranks, marks[0] if marks else lambda text: 0),
            f"doc_id {id_type}, node long, n int, first array<long>, keyed int, fp long",
        ),
        "shingle-keys",
    )
    distinct = every.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    # one row per set before keys are dealt: a key gets no more rows from a text with many copies
    keyed = every.select("node", "n", F.slice("first", F.lit(1), F.col("keyed")).alias("keys"))
    once = keyed.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    dealt = once.select(F.explode("keys").alias("key"), "n", "node")
    shared_path = write_table(
        dealt.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1"), "shared-shingles",
    )
    shared = spark.read.schema("key long, n int, node long, size long").parquet(shared_path)
    def sorted_buckets(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "n", "node")

    def parted(rows: DataFrame, links: DataFrame | None) -> DataFrame:
        """Rows of buckets with the component of each node."""
        if links is None:
            return rows.select("key", "n", "node", F.col("node").alias("part"))
        parts = connected_components(links).select(F.col("a").alias("node"), F.col("b").alias("part"))
        if is_small(parts, BROADCAST_ROWS):
            parts = F.broadcast(parts)
        return rows.join(parts, "node", "left").select("key", "n", "node", F.coalesce("part", "node").alias("part"))

    links = _similar_pairs(_marked_pairs(every, marks[1]), texts, every, shingle, similarity) if marks else None
    stars = sorted_buckets(parted(shared, links)).mapInArrow(_stars(similarity), "a long, b long")
    found = _similar_pairs(stars, texts, every, shingle, similarity)
    links = found if links is None else links.union(found)
    more = parted(shared.where("size > 2"), links)
    crossing = sorted_buckets(more).mapInArrow(_crossing(similarity), "a long, b long")
    links = links.union(_similar_pairs(crossing, texts, every, shingle, similarity))
    drop_table(spark, shared_path)  # read for the last time
    roots = connected_components(links)
    members = store(
        distinct.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
        .select("node", "first_id", F.coalesce("root", "node").alias("root")),
        "similar-members",
    )
    least = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return every.select("doc_id", "node").join(members.join(least, "root").select("node", "component_id"), "node").select(
        "doc_id", "node", "component_id"
    )
