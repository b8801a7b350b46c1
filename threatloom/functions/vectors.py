"""Vector arithmetic on ARRAY columns, in DOUBLE, and vectors as bytes, which Spark writes many times faster than arrays.

Bytes of a vector are little-endian, in units of two: a zero and the float32 cells in turn or, where that is shorter, the
number of cells and, for each that is not zero, its place and float32 value. Both keep every bit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())
#: A count of cells takes two bytes.
_MOST_CELLS = (1 << 16) - 1


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; null where either vector is all zero."""
    return F.try_divide(dot(left, right), norm(left) * norm(right))


def pack_rows(parts: Sequence[np.ndarray], empty: np.ndarray) -> pa.Array:
    """The float32 rows of all parts as bytes, with null where `empty`."""
    packed = [_packed_units(np.ascontiguousarray(part, "<f4")) for part in parts]
    sizes = np.zeros(len(empty), np.int64)
    sizes[~empty] = np.concatenate([units for units, _ in packed]) if packed else 0
    ends = np.concatenate(([0], np.cumsum(2 * sizes))).astype(np.int32)
    flat = np.concatenate([data for _, data in packed]) if packed else np.zeros(0, "<u2")
    valid = pa.array(~empty).buffers()[1] if empty.any() else None
    return pa.BinaryArray.from_buffers(pa.binary(), len(empty), [valid, pa.py_buffer(ends), pa.py_buffer(flat)])


def _packed_units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of each row, and all of them in turn."""
    count, dim = rows.shape
    used = np.flatnonzero(rows.view("<u4") != 0)
    if 3 * len(used) >= 2 * rows.size or dim > _MOST_CELLS:
        units = np.zeros((count, 1 + 2 * dim), "<u2")
        units[:, 1:] = rows.view("<u2")
        return np.full(count, 1 + 2 * dim), units.reshape(-1)
    row, place = np.divmod(used, dim)
    cells = np.empty((len(used), 3), "<u2")
    cells[:, 0] = place
    cells[:, 1:] = rows.reshape(-1)[used].view("<u2").reshape(-1, 2)
    sizes = 1 + 3 * np.bincount(row, minlength=count)
    units = np.empty(sizes.sum(), "<u2")
    heads = np.cumsum(sizes) - sizes
    body = np.ones(len(units), bool)
    body[heads] = False
    units[heads] = dim
    units[body] = cells.reshape(-1)
    return sizes, units


def unpack_rows(packed: pa.Array) -> pa.Array:
    """The vectors of packed bytes."""
    empty = packed.is_null().to_numpy(zero_copy_only=False)
    units = [np.frombuffer(value, "<u2") for value in packed.drop_null().to_pylist()]
    rows = [np.ascontiguousarray(u[1:]).view("<f4") if not u[0] else None for u in units]
    sizes = np.array([int(u[0]) if r is None else len(r) for u, r in zip(units, rows)], np.int64)
    begins = np.cumsum(sizes) - sizes
    flat = np.zeros(sizes.sum(), "<f4")
    for begin, row in zip(begins.tolist(), rows):
        if row is not None:
            flat[begin : begin + len(row)] = row
    few = [u[1:] for u, r in zip(units, rows) if r is None]
    if few:
        cells = np.concatenate(few).reshape(-1, 3)
        sparse = np.array([r is None for r in rows])
        at = np.repeat(begins[sparse], [len(u) // 3 for u in few]) + cells[:, 0]
        flat[at] = np.ascontiguousarray(cells[:, 1:]).view("<f4").reshape(-1)
    lengths = np.zeros(len(empty), np.int64)
    lengths[~empty] = sizes
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(empty) if empty.any() else None)


def _pack_lists(vectors: pa.Array) -> pa.Array:
    empty = vectors.is_null().to_numpy(zero_copy_only=False)
    values = vectors.flatten()
    if values.null_count:
        raise ValueError("a vector with a null in it")
    ends = np.cumsum(np.diff(vectors.drop_null().offsets.to_numpy()))
    rows = np.split(values.to_numpy(), ends[:-1]) if len(ends) else []
    return pack_rows([row.reshape(1, -1) for row in rows], empty)


def packed(vector: Column) -> Column:
    """The bytes of an array of floats."""

    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _pack_lists(batch)

    return F.arrow_udf(pack, T.BinaryType())(vector)


def unpacked(vector: Column) -> Column:
    """The array of floats of packed bytes."""

    def unpack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield unpack_rows(batch)

    return F.arrow_udf(unpack, VECTOR)(vector)
