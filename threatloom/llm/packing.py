"""Bounded-space online packing of documents into token sequences.

Each partition keeps a fixed number of open windows. A piece goes to the open window it leaves least room in; if none
has room, the fullest window is emitted and a new one opened. What is open at the end of a partition is merged: the
pieces of a fixed number of partitions are packed anew, longest first, in one task of bounded size.

Documents longer than a sequence are cut into full sequences and a rest. A null or empty text is the closing id alone.
Every row is a document of its own, so repeated rows are packed repeatedly; further columns are ignored. Sequence ids
are unique, their order means nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm.scratch import store
from threatloom.llm.tokens import word_bpe

CAPACITY = 2048
OPEN_WINDOWS = 128
#: Partitions whose open windows are merged in one task.
MERGED_PARTITIONS = 64
#: Pieces of emitted windows that are given on at once, and rows of open windows that are read at once.
_GIVEN, _READ = 512, 512

_FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32())),
    ("open", pa.bool_()), ("merge_group", pa.int64()),
]
_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "ids array<int>, open boolean, merge_group long"
)


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class WindowPacker:
    """Best fit over a bounded number of open windows; a piece is any tuple, its length is given."""

    def __init__(self, capacity: int, open_windows: int, first_id: int):
        self.capacity, self.most = capacity, open_windows
        self.room: list[tuple[int, int]] = []  # (room left, sequence id), ascending
        self.held: dict[int, list[tuple[tuple, int]]] = {}
        self.next_id = first_id
        self.done: list[tuple[tuple, int, int]] = []  # (piece, sequence id, offset)

    def add(self, piece: tuple, length: int) -> None:
        if length == self.capacity:
            self.done.append((piece, self._new_id(), 0))
            return
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            room, sequence = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                self._emit(self.room.pop(0)[1])
            room, sequence = self.capacity, self._new_id()
            self.held[sequence] = []
        self.held[sequence].append((piece, self.capacity - room))
        if room == length:
            self._emit(sequence)
        else:
            insort(self.room, (room - length, sequence))

    def _new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _emit(self, sequence: int) -> None:
        self.done += [(piece, sequence, offset) for piece, offset in self.held.pop(sequence)]

    def take_done(self) -> list[tuple[tuple, int, int]]:
        done, self.done = self.done, []
        return done

    def take_open(self) -> list[tuple[tuple, int, int]]:
        for _, sequence in self.room:
            self._emit(sequence)
        self.room = []
        return self.take_done()


def _id_lists(parts: list[np.ndarray | None]) -> pa.Array:
    if not parts or parts[0] is None:
        return pa.nulls(len(parts), pa.list_(pa.int32()))
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), pa.int32()))


def _rows(placed: list[tuple[tuple, int, int]], is_open: bool, group: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(placed), _GIVEN):
        some = placed[at : at + _GIVEN]
        values = [(*piece[:5], sequence, offset, None, is_open, group) for piece, sequence, offset in some]
        columns = [
            _id_lists([piece[5] for piece, _, _ in some]) if name == "ids" else pa.array(column, kind)
            for column, (name, kind) in zip(zip(*values), _FIELDS)
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in _FIELDS])


def _packed(tokenizer: str | None, capacity: int, open_windows: int, with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        encode = word_bpe(tokenizer).documents
        packer = WindowPacker(capacity, open_windows, partition << 32)
        group = partition // MERGED_PARTITIONS
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                total = len(ids)
                for start in range(0, total, capacity):
                    part = ids[start : start + capacity]
                    kept = part.astype(np.int32) if with_ids else None
                    packer.add((doc_id, start, len(part), ids_crc32(part), total, kept), len(part))
                if len(packer.done) >= _GIVEN:
                    yield from _rows(packer.take_done(), False, group)
        yield from _rows(packer.take_done(), False, group)
        yield from _rows(packer.take_open(), True, group)

    return pack


def _merged(capacity: int, open_windows: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, None
        for batch in (part.slice(at, _READ) for part in batches for at in range(0, len(part), _READ)):
            # ids stay arrays: as Python numbers they would take ten times as much
            for row, ids in zip(batch.drop_columns(["ids"]).to_pylist(), batch.column("ids")):
                if row["merge_group"] != group:
                    if packer:
                        yield from _rows(packer.take_open(), False, group)
                    group = row["merge_group"]
                    packer = WindowPacker(capacity, open_windows, 1 << 62 | group << 32)
                kept = ids.values.to_numpy().copy() if ids.is_valid else None  # a view would hold its whole batch
                piece = (*(row[name] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), kept)
                packer.add(piece, row["length"])
            if packer:
                yield from _rows(packer.take_done(), False, group)
        if packer:
            yield from _rows(packer.take_open(), False, group)

    return merge


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
         open_windows: int = OPEN_WINDOWS, with_ids: bool = True) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, its ids and their CRC-32.

    `tokenizer` is a path that every executor can read; without one, the public file of each machine is used.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = store(texts.mapInArrow(_packed(tokenizer, capacity, open_windows, with_ids), _SCHEMA), "pack")
    left = pieces.where("open")
    groups = max(1, -(-texts.rdd.getNumPartitions() // MERGED_PARTITIONS))
    merged = (
        left.repartition(groups, "merge_group")
        .sortWithinPartitions("merge_group", F.desc("length"), "doc_id", "start", "ids_crc32")
        .mapInArrow(_merged(capacity, open_windows), _SCHEMA)
    )
    out = pieces.where("NOT open").unionByName(merged).drop("open", "merge_group")
    return out if with_ids else out.drop("ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids."""
    return pack(docs)
