"""Token-id shards: best-fit-decreasing packing into id matrices, written as binary files.

A task collects documents up to a bounded number of tokens, cuts those longer than a sequence into full pieces and a
rest, and places the pieces longest first, each into the fullest row that still has room. The row is found in a
segment tree over the free space. Nothing is shuffled, and no token is dropped.

Per shard three files are written: `.ids` (little-endian ids, rows of `capacity`, padded with 0), `.cu` (int32 cumulative
segment lengths, each row from 0 on) and `.seg` (int64 triples: doc_id, place in its document where positions begin
again, tokens of the document). The manifest names the shards that finished.

A null or empty text is the closing id alone. Repeated rows are packed repeatedly; further columns are ignored. A null
doc_id is written as the smallest int64 and read back as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm.files import attempt_name, read_range, write_file
from threatloom.llm.scratch import store
from threatloom.llm.tokens import word_bpe
from threatloom.session import run_dir

CAPACITY = 2048
#: Tokens a task packs at once.
SHARD_TOKENS = 8 << 20
_NULL_ID = -(1 << 63)

MANIFEST = "shard string, shard_id long, sequences long, segments long, tokens long"
_MANIFEST_TYPE = pa.schema([
    ("shard", pa.string()), ("shard_id", pa.int64()), ("sequences", pa.int64()), ("segments", pa.int64()),
    ("tokens", pa.int64()),
])
SEQUENCE = (
    "sequence_id long, ids array<int>, cu_seqlens array<int>, doc_ids array<long>, starts array<long>, "
    "doc_tokens array<long>"
)


class FreeSpace:
    """Rows by free space, with a segment tree that finds the least space that suffices."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: dict[int, list[int]] = {}

    def put(self, space: int, row: int) -> None:
        self.rows.setdefault(space, []).append(row)
        node = self.width + space
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least space of at least `need`, and that space."""
        count, node = self.count, self.width + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if count[2 * node] else 2 * node + 1
        space = node - self.width
        row = self.rows[space].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return row, space


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and offset of each piece, and the number of rows."""
    row, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free, rows = FreeSpace(capacity), 0
    for piece in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[piece])
        found = free.take(length) if length < capacity else None
        if found is None:
            found, rows = (rows, capacity), rows + 1
        row[piece], offset[piece] = found[0], capacity - found[1]
        if found[1] > length:
            free.put(found[1] - length, found[0])
    return row, offset, rows


def _shard(folder: str, number: int, documents: list[tuple[int | None, np.ndarray]], capacity: int) -> dict:
    lengths, docs, starts = [], [], []
    for at, (_, ids) in enumerate(documents):
        for start in range(0, len(ids), capacity):
            lengths.append(min(capacity, len(ids) - start))
            docs.append(at)
            starts.append(start)
    row, offset, rows = best_fit_decreasing(np.array(lengths), capacity)
    matrix = np.zeros((rows, capacity), "<u2")
    order = np.lexsort((offset, row)).tolist()
    cumulative: list[int] = []
    segments = np.empty((len(order), 3), "<i8")
    for n, piece in enumerate(order):
        doc_id, ids = documents[docs[piece]]
        begin, length, start = int(offset[piece]), lengths[piece], starts[piece]
        matrix[row[piece], begin : begin + length] = ids[start : start + length]
        segments[n] = (_NULL_ID if doc_id is None else doc_id, start, len(ids))
        if begin == 0:
            cumulative.append(0)
        cumulative.append(begin + length)
    shard = f"{folder}/{attempt_name()}-{number:05d}"
    for suffix, data in (("ids", matrix), ("cu", np.array(cumulative, "<i4")), ("seg", segments)):
        write_file(f"{shard}.{suffix}", [data.tobytes()])
    return {
        "shard": shard, "shard_id": TaskContext.get().partitionId() << 20 | number, "sequences": rows,
        "segments": len(order), "tokens": sum(lengths),
    }


def _writer(folder: str, tokenizer: str | None, capacity: int, shard_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_bpe(tokenizer).documents
        held, tokens, rows = [], 0, []
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                held.append((doc_id, ids))
                tokens += len(held[-1][1])
                if tokens >= shard_tokens:
                    rows.append(_shard(folder, len(rows), held, capacity))
                    held, tokens = [], 0
        if held:
            rows.append(_shard(folder, len(rows), held, capacity))
        yield pa.RecordBatch.from_pylist(rows, _MANIFEST_TYPE)

    return write


def write_shards(documents: DataFrame, folder: str, tokenizer: str | None = None, capacity: int = CAPACITY,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Tokenise, pack and write documents below a folder that all executors reach; the manifest."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return store(texts.mapInArrow(_writer(folder, tokenizer, capacity, shard_tokens), MANIFEST), "shard-manifest")


def _shard_arrays(row: dict, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, segments = row["sequences"], row["segments"]
    ids = np.frombuffer(read_range(f"{row['shard']}.ids", 0, 2 * size * capacity), "<u2").reshape(size, capacity)
    cumulative = np.frombuffer(read_range(f"{row['shard']}.cu", 0, 4 * (size + segments)), "<i4")
    places = np.frombuffer(read_range(f"{row['shard']}.seg", 0, 24 * segments), "<i8").reshape(segments, 3)
    return ids, cumulative, places


def _sequences(capacity: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                ids, cumulative, places = _shard_arrays(shard, capacity)
                first = np.flatnonzero(cumulative == 0).tolist() + [len(cumulative)]
                rows = []
                for n in range(len(ids)):
                    own = cumulative[first[n] : first[n + 1]]
                    held = places[first[n] - n : first[n + 1] - n - 1]
                    rows.append({
                        "sequence_id": shard["shard_id"] << 24 | n, "ids": ids[n].astype(np.int32),
                        "cu_seqlens": own, "starts": held[:, 1], "doc_tokens": held[:, 2],
                        "doc_ids": [None if d == _NULL_ID else d for d in held[:, 0].tolist()],
                    })
                    if len(rows) == 512 or n + 1 == len(ids):
                        yield pa.RecordBatch.from_pylist(rows, pa.schema([
                            ("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())),
                            ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
                            ("doc_tokens", pa.list_(pa.int64())),
                        ]))
                        rows = []

    return read


def read_sequences(manifest: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of all shards: padded ids, cumulative segment lengths, and per segment its document and place."""
    return manifest.mapInArrow(_sequences(capacity), SEQUENCE)


def _pieces(capacity: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                ids, cumulative, places = _shard_arrays(shard, capacity)
                ends = np.flatnonzero(cumulative > 0)
                begins = cumulative[ends - 1]
                row = np.cumsum(cumulative == 0)[ends] - 1
                crc = [
                    zlib.crc32(ids[r, a:b].astype("<u4").tobytes())
                    for r, a, b in zip(row.tolist(), begins.tolist(), cumulative[ends].tolist())
                ]
                doc_ids = pa.array(places[:, 0], pa.int64(), mask=places[:, 0] == _NULL_ID)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, *(pa.array(x, pa.int64()) for x in (
                        places[:, 1], cumulative[ends] - begins, crc, places[:, 2],
                        (shard["shard_id"] << 24) + row, begins))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return read


def read_pieces(manifest: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A row per segment of the shards, with the CRC-32 of the ids read back."""
    return manifest.mapInArrow(
        _pieces(capacity),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shards of all documents hold, read back from the files."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_shards(documents, run_dir(spark, "llm-shards"))
    cores = spark.sparkContext.defaultParallelism
    return read_pieces(manifest.repartition(max(cores, manifest.rdd.getNumPartitions()), "shard"))
