"""Exact nearest neighbours of many query vectors in a collection, by cosine.

Scoring is a matrix product per block inside Arrow batches. A collection small
enough to broadcast goes to the queries, and nothing is shuffled. Failing that,
queries few enough to broadcast go to the collection: each partition keeps its
best `k` per query and only those are shuffled. If both sides are large, each is
written once, without a shuffle, as one folder per cell, the vectors nearest to
one of a number of pivots. The queries go to the collection in passes of many
chunks of near vectors, so that the number of times the collection is read is that
of the passes, however small a chunk is. A chunk is compared with the cells of its
own queries first. That gives each query a k-th best score, and by the largest
angle in a cell between its vectors and the pivot, all cells that can hold nothing
better are left out for the chunk: files that no chunk of a pass needs are not
opened. No path writes out pairs beyond the best `k`, and none loses any.

Products are taken in single precision first; whatever that may have misjudged
is scored again in double. Scores are rounded before ranking, so that the result
does not depend on the order in which a product was summed; ties go to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.operators.dedup import limit_per_group
from threatloom.session import run_dir

SCORE_DIGITS = 6
# vector elements of a side that is broadcast: 32,768 vectors of 384, 100 MB per Python worker
BROADCAST_CELLS = 12 << 20
# pivots per side of which both are large; as many folders and, for each vector, products
CELLS = 256
# vector elements of a chunk at most, as its angles to all pivots are taken on the driver
_CHUNK_CELLS = 1 << 18
# vector elements of the queries of a pass, 33 MB per Python worker; a pass reads the collection once
_PASS_CELLS = 4 << 20
_PASSES_AT_ONCE = 2
# angles near zero are known to about this much
_ROUNDING = 1e-6
# scores computed at once: so many queries by so many rows, 4 MB; fewer rows until a query has a k-th best
_SCORED_QUERIES, _SCORED_ROWS, _FIRST_ROWS = 512, 2048, 256
# vector elements gathered at once for scores in double precision, 32 MB per side
_GATHERED_CELLS = 4 << 20


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    corpus_id: str = "id",
    corpus_vector: str = "embedding",
    broadcast_cells: int = BROADCAST_CELLS,
    cells: int = CELLS,
) -> DataFrame:
    """(query_id, id, score, rank) of the `k` most similar rows, rank 1 first.

    Ids are unique on each side. Vectors that are zero or not finite are similar
    to nothing: they get no row and are in no result.
    """
    left = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector"))
    right = corpus.select(F.col(corpus_id).cast("long").alias("id"), F.col(corpus_vector).alias("vector"))
    usable_left, usable_right = (side.where(F.col("vector").isNotNull()) for side in (left, right))
    schema = T.StructType([
        left.schema["query_id"],
        T.StructField("id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ])
    small = _small_table(usable_right, broadcast_cells)
    if small is not None:
        return _with_corpus_broadcast(usable_left, small, k, schema)
    _, dim = _shape(usable_right, "collection")
    query_rows, query_dim = _shape(usable_left, "queries")
    if query_rows and query_dim != dim:
        raise ValueError(f"queries have {query_dim} dimensions, the collection {dim}")
    if query_rows * dim <= broadcast_cells:
        return _with_queries_broadcast(usable_left, usable_right, k, schema)
    return _by_cells(
        usable_left, usable_right, k, schema, cells,
        chunk_rows=max(1, min(broadcast_cells, _CHUNK_CELLS) // max(1, dim)), pass_rows=max(1, _PASS_CELLS // max(1, dim)),
    )


def _shape(side: DataFrame, what: str) -> tuple[int, int]:
    """Number and dimension of the vectors of one side, from all of them."""
    seen = side.agg(
        F.count("*").alias("rows"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")
    ).first()
    if seen.rows and not (seen.least == seen.most and seen.least > 0):
        raise ValueError(f"vectors of the {what} have between {seen.least} and {seen.most} dimensions")
    return seen.rows, seen.most or 0


def _small_table(side: DataFrame, most: int) -> pa.Table | None:
    """All rows of a side of at most so many vector elements, in one pass after a look at one row; None if it has more."""
    first = side.select(F.size("vector").alias("dim")).first()
    rows = most // max(1, first.dim) if first else 0
    if first and not rows:
        return None
    table = side.limit(rows + 1).toArrow()
    if len(table) > rows:
        return None
    sizes = set(pc.unique(pc.list_value_length(table["vector"])).to_pylist())
    if len(table) and (len(sizes) > 1 or 0 in sizes):
        raise ValueError(f"vectors of the collection have between {min(sizes)} and {max(sizes)} dimensions")
    return table


def _with_corpus_broadcast(queries: DataFrame, corpus: pa.Table, k: int, schema: T.StructType) -> DataFrame:
    ids, matrix = _unit_rows(corpus, "id")
    shared = queries.sparkSession.sparkContext.broadcast((ids.to_numpy(), matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus_ids, corpus_matrix = shared.value
        for batch in batches:
            yield from _best(pa.Table.from_batches([batch]), corpus_ids, corpus_matrix, k, schema).to_batches()

    return queries.mapInArrow(score, schema)


def _with_queries_broadcast(queries: DataFrame, corpus: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    # its size was checked by the caller
    shared = corpus.sparkSession.sparkContext.broadcast(_unit_rows(queries.toArrow(), "query_id"))
    return _merged(_partial_best(shared, corpus, k, schema), k)


def _partial_best(
    queries: Broadcast, corpus: DataFrame, k: int, schema: T.StructType,
    asking: dict[int, list[tuple[int, int]]] | None = None, floor: Broadcast | None = None,
) -> DataFrame:
    """The best `k` of each query in each partition of the collection, as far as they reach the query's floor.

    `asking` has the ranges of queries that are compared with the rows of a cell; without it all are, with all rows.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = queries.value
        least = np.full(len(vectors), -np.inf) if floor is None else floor.value.copy()
        best, new, size = tuple(np.zeros(0, dtype) for dtype in (np.int64, np.int64, np.float64)), [], 0
        for batch in batches:
            for rows, ranges in _with_ranges(pa.Table.from_batches([batch]), asking, len(vectors)):
                ids, matrix = _unit_rows(rows, "id")
                for start, stop in ranges:
                    owner, found, scores = _best_indices(vectors[start:stop], ids.to_numpy(), matrix, k, least[start:stop])
                    new.append((owner + start, found, scores))
                    size += len(owner)
            if size > k * len(vectors):
                best, new, size = _raised(best, new, k, least), [], 0
        owner, found, scores = _raised(best, new, k, least)
        kept, rank = _ranked(owner, found, scores, k)
        yield from _as_table(query_ids, owner[kept], found[kept], scores[kept], rank, schema).to_batches()

    return corpus.mapInArrow(score, schema)


def _with_ranges(
    rows: pa.Table, asking: dict[int, list[tuple[int, int]]] | None, queries: int
) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows with the ranges of queries that ask for them."""
    if asking is None:
        yield rows, [(0, queries)]
        return
    for cell in pc.unique(rows["cell"]).to_pylist():
        yield rows.filter(pc.equal(rows["cell"], cell)), asking[cell]


def _raised(best: tuple[np.ndarray, ...], new: list[tuple[np.ndarray, ...]], k: int, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """The best `k` of both; a query that has so many needs nothing below the last of them any more."""
    owner, ids, scores = (np.concatenate(columns) for columns in zip(best, *new))
    kept, rank = _ranked(owner, ids, scores, k)
    last = kept[rank == k]
    least[owner[last]] = np.maximum(least[owner[last]], scores[last])
    return owner[kept], ids[kept], scores[kept]


def _pivots(corpus: DataFrame, cells: int) -> np.ndarray:
    """Unit vectors of some rows of the collection, by a hash of their ids."""
    usable = corpus.where(F.exists("vector", lambda x: x != 0))
    rows = usable.orderBy(F.xxhash64("id"), "id").limit(cells).toArrow()
    return _unit_rows(rows, "id")[1]


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0)) if len(vectors) else np.zeros((0, len(pivots)))


def _celled(side: DataFrame, key: str, pivots: np.ndarray) -> DataFrame:
    """Rows with the nearest pivot and the angle to it; zero vectors have neither and are left out."""
    shared = side.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([
        side.schema[key], T.StructField("vector", side.schema["vector"].dataType),
        T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()),
    ])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).select([key, "vector"])
            kept = table.filter(_usable(table))
            angles = _angles(_unit_rows(kept, key)[1], shared.value)
            cell = angles.argmin(axis=1) if len(angles) else np.zeros(0, np.int64)
            kept = kept.append_column("cell", pa.array(cell.astype(np.int32)))
            kept = kept.append_column("angle", pa.array(angles[np.arange(len(cell)), cell].astype(np.float64)))
            yield from kept.to_batches()

    return side.select(key, "vector").mapInArrow(assign, schema)


def _usable(table: pa.Table) -> pa.Array:
    """Which rows have a direction."""
    return pa.array(_directed(table)[1])


def _directed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors as a matrix, which of them are finite and other than zero, and their lengths."""
    lists = table["vector"].combine_chunks()
    rows = len(lists)
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    matrix = flat.reshape(rows, -1) if rows else np.zeros((0, 0))
    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    usable = lengths > 0
    if np.isinf(lengths).any():
        usable &= np.isfinite(matrix).all(axis=1)
    return matrix, usable, lengths


def _in_folders(side: DataFrame, key: str, pivots: np.ndarray, name: str) -> DataFrame:
    """The rows in one folder per cell; each task writes a file per cell it meets, so nothing is shuffled."""
    placed = _celled(side, key, pivots)
    path = run_dir(side.sparkSession, name)
    placed.write.partitionBy("cell").parquet(path)
    return side.sparkSession.read.schema(placed.schema).parquet(path)


def _by_cells(
    queries: DataFrame, corpus: DataFrame, k: int, schema: T.StructType, cells: int, *, chunk_rows: int, pass_rows: int
) -> DataFrame:
    spark = corpus.sparkSession
    pivots = _pivots(corpus, cells)
    if not len(pivots):
        return spark.createDataFrame([], schema)
    collection = _in_folders(corpus, "id", pivots, "cells")
    # a row per cell: how far its vectors lie from the pivot at most
    reach = {r.cell: r.angle for r in collection.groupBy("cell").agg(F.max("angle").alias("angle")).collect()}
    asked = _in_folders(queries, "query_id", pivots, "queries")
    counts = {r.cell: r["count"] for r in asked.groupBy("cell").count().collect()}
    chain = _chain(pivots)

    def answer(some: tuple[list[int], int, int]) -> str | None:
        some_cells, slices, part = some
        rows = asked.where(F.col("cell").isin(some_cells))
        if slices > 1:
            rows = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == part)
        # at most `pass_rows`, and a little more of a slice
        table = rows.select("query_id", "vector", "cell").toArrow()
        near = np.argsort(np.argsort(chain)[table["cell"].to_numpy()], kind="stable")
        return _pass_best(table.take(pa.array(near)), chunk_rows, collection, pivots, reach, k, schema) if len(table) else None

    passes = _chunks({cell: counts[cell] for cell in chain if cell in counts}, pass_rows)
    # while one is prepared on the driver or has its last tasks, another fills the cluster
    with ThreadPoolExecutor(_PASSES_AT_ONCE) as pool:
        parts = [path for path in pool.map(answer, passes) if path]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def _chain(pivots: np.ndarray) -> list[int]:
    """The pivots, each followed by the nearest of those left."""
    left, order = set(range(1, len(pivots))), [0]
    while left:
        near = pivots @ pivots[order[-1]]
        order.append(max(left, key=lambda cell: (near[cell], -cell)))
        left.remove(order[-1])
    return order


def _chunks(counts: dict[int, int], rows: int) -> Iterator[tuple[list[int], int, int]]:
    """Cells of queries, put together in their order up to a number of rows; a cell of more is cut into slices."""
    held, size = [], 0
    for cell, count in counts.items():
        if count > rows:
            slices = -(-2 * count // rows)
            yield from (([cell], slices, part) for part in range(slices))
            continue
        if size + count > rows:
            yield held, 1, 0
            held, size = [], 0
        held.append(cell)
        size += count
    if held:
        yield held, 1, 0


def _pass_best(
    queries: pa.Table, chunk_rows: int, collection: DataFrame, pivots: np.ndarray, reach: dict[int, float], k: int, schema: T.StructType
) -> str:
    """The best `k` of each query of a pass, as a table; a chunk's own cells are read first, then those that may hold better."""
    spark = collection.sparkSession
    chunks = {at: queries.slice(at, chunk_rows) for at in range(0, len(queries), chunk_rows)}
    own = {at: pc.unique(chunk["cell"]).to_pylist() for at, chunk in chunks.items()}
    shared = spark.sparkContext.broadcast(_unit_rows(queries, "query_id"))

    def compared(cells: dict[int, Iterable[int]], floor: Broadcast | None = None) -> DataFrame | None:
        asking = _asking(cells, chunk_rows, len(queries))
        rows = collection.where(F.col("cell").isin(list(asking))).select("id", "vector", "cell")
        return _partial_best(shared, rows, k, schema, asking, floor) if asking else None

    path = run_dir(spark, "near")
    _merged(compared(own), k).write.parquet(path)
    best = spark.read.schema(schema).parquet(path)
    # a row per query of the pass
    last = best.where(F.col("rank") == k).select("query_id", "score").toArrow()
    scores = dict(zip(last["query_id"].to_pylist(), last["score"].to_pylist()))
    kth = [scores.get(i) for i in queries["query_id"].to_pylist()]
    rest = {}
    for at, chunk in chunks.items():
        near = pa.table({"query_id": chunk["query_id"], "score": pa.array(kth[at:at + chunk_rows], pa.float64())})
        near = near.filter(near["score"].is_valid())
        rest[at] = needed_cells(chunk, near.append_column("rank", pa.array([k] * len(near), pa.int32())), own[at], pivots, reach, k)
    floor = spark.sparkContext.broadcast(np.array([-np.inf if score is None else score for score in kth]))
    if (far := compared(rest, floor)) is not None:
        path = run_dir(spark, "best")
        _merged(best.unionByName(far), k).write.parquet(path)
    # else their files stay on the driver
    for sent in (shared, floor):
        sent.destroy()
    return path


def _asking(cells: dict[int, Iterable[int]], rows: int, end: int) -> dict[int, list[tuple[int, int]]]:
    """The ranges of queries that ask for a cell, of the cells asked for by the chunk of so many rows that begins there."""
    ranges: dict[int, list[tuple[int, int]]] = {}
    for at in sorted(cells):
        for cell in cells[at]:
            held = ranges.setdefault(cell, [])
            start = held.pop()[0] if held and held[-1][1] == at else at
            held.append((start, min(at + rows, end)))
    return ranges


def needed_cells(
    queries: pa.Table, near: pa.Table, own: list[int], pivots: np.ndarray, reach: dict[int, float], k: int
) -> set[int]:
    """Cells besides `own` in which some query may find a vector as good as its k-th best so far.

    A vector at most `reach` away from a pivot is no nearer to a query than the query's angle to the pivot less that reach.
    """
    ids, vectors = _unit_rows(queries, "query_id")
    kth = {i: s for i, s, r in zip(*(near[c].to_pylist() for c in ("query_id", "score", "rank"))) if r == k}
    # a score may have been rounded up, and ties count
    floor = np.array([kth.get(i, -2.0) for i in ids.to_pylist()]) - 2 * 10.0**-SCORE_DIGITS
    nearest = _angles(vectors, pivots)
    return {
        cell for cell, most in reach.items()
        if cell not in own and (np.cos(np.maximum(nearest[:, cell] - most - _ROUNDING, 0.0)) >= floor).any()
    }


def _merged(partial: DataFrame, k: int) -> DataFrame:
    """The best `k` per query of the partial results."""
    order = [F.col("score").desc(), F.col("id")]
    merged = limit_per_group(partial.drop("rank"), ["query_id"], order, k, rank_name="rank")
    return merged.select("query_id", "id", "score", "rank")


def _unit_rows(table: pa.Table, key: str) -> tuple[pa.ChunkedArray, np.ndarray]:
    """Ids and unit-length vectors of the rows with a direction."""
    matrix, usable, lengths = _directed(table)
    return table[key].filter(pa.array(usable)), matrix[usable] / lengths[usable, None]


def _best(queries: pa.Table, ids: np.ndarray, matrix: np.ndarray, k: int, schema: T.StructType) -> pa.Table:
    """The `k` best collection rows of each query of a block."""
    query_ids, vectors = _unit_rows(queries, "query_id")
    owner, found, score = _best_indices(vectors, ids, matrix, k)
    kept, rank = _ranked(owner, found, score, k)
    return _as_table(query_ids, owner[kept], found[kept], score[kept], rank, schema)


def _best_indices(
    vectors: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, least: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """Query row, id and score of the best `k` of each query, as far as they may be as good as `least`."""
    least = np.full(len(vectors), -np.inf) if least is None else least
    single = matrix.astype(np.float32)
    parts = []
    for at in range(0, len(vectors), _SCORED_QUERIES):
        block = slice(at, at + _SCORED_QUERIES)
        owner, found, score = _best_of_block(vectors[block], least[block].copy(), ids, matrix, single, k)
        parts.append((owner + at, found, score))
    if not parts:
        return tuple(np.zeros(0, dtype) for dtype in (np.int64, np.int64, np.float64))
    return tuple(np.concatenate(columns) for columns in zip(*parts))


def _best_of_block(
    vectors: np.ndarray, least: np.ndarray, ids: np.ndarray, matrix: np.ndarray, single: np.ndarray, k: int
) -> tuple[np.ndarray, ...]:
    queries = vectors.astype(np.float32)
    # twice the error of a product of unit vectors in single precision
    error = (matrix.shape[1] + 8) * 2.0**-23
    # a score may have been rounded up, and ties count
    rounded = 2 * 10.0**-SCORE_DIGITS
    best, new = tuple(np.zeros(0, dtype) for dtype in (np.int64, np.int64, np.float64)), []
    at, rows = 0, max(_FIRST_ROWS, 2 * k)
    while at < len(ids):
        scores = queries @ single[at:at + rows].T
        if np.isneginf(least).any() and scores.shape[1] >= k:
            least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k] - error)
        low = (least - rounded - error).astype(np.float32)
        # most queries find nothing better in most blocks
        near = np.flatnonzero(scores.max(axis=1) >= low)
        row, column = np.nonzero(scores[near] >= low[near, None])
        if len(row):
            new.append((near[row], ids[at + column], _exact(vectors, matrix[at:at + rows], near[row], column)))
            if sum(len(part[0]) for part in new) > k * len(vectors):
                best, new = _raised(best, new, k, least), []
        at, rows = at + rows, max(min(2 * rows, _SCORED_ROWS), 2 * k)
    return _raised(best, new, k, least)


def _exact(vectors: np.ndarray, matrix: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Rounded scores of pairs in double precision; of many pairs, from all products."""
    if 16 * len(row) > len(vectors) * len(matrix):
        scores = (vectors @ matrix.T)[row, column]
    else:
        step = max(1, _GATHERED_CELLS // matrix.shape[1])
        scores = np.concatenate([
            np.einsum("ij,ij->i", vectors[row[at:at + step]], matrix[column[at:at + step]]) for at in range(0, len(row), step)
        ])
    return np.round(scores, SCORE_DIGITS) + 0.0  # no negative zero


def _ranked(owner: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the best `k` of each owner, best first with ties by id, and their ranks."""
    order = np.lexsort((ids, -score, owner))
    ordered = owner[order]
    rank = np.arange(len(ordered)) - np.searchsorted(ordered, ordered) + 1
    return order[rank <= k], rank[rank <= k]


def _as_table(
    query_ids: pa.ChunkedArray, owner: np.ndarray, ids: np.ndarray, score: np.ndarray, rank: np.ndarray, schema: T.StructType
) -> pa.Table:
    columns = {
        "query_id": pc.take(query_ids, pa.array(owner, pa.int64())),
        "id": pa.array(ids, pa.int64()),
        "score": pa.array(score, pa.float64()),
        "rank": pa.array(rank.astype(np.int32), pa.int32()),
    }
    return pa.table(columns).select(schema.fieldNames())
