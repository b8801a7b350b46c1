"""Batch text encoding.

An encoder factory is called once per task and returns a function from a list
of texts to a (n, dim) float array, so a model is loaded once per task and sees
whole Arrow batches. The default needs no model: hashed token counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.constants import VECTOR_SIZE
from threatloom.functions.vectors import pack_rows

Encoder = Callable[[Sequence[str]], np.ndarray]

_TOKEN_BYTES = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: ASCII in lower case, with a blank for all that is in no token.
_TO_TOKENS = bytes(low if (low := ord(chr(byte).lower())) in _TOKEN_BYTES else 32 for byte in range(128)) + b" " * 128
#: Tokens whose buckets a task remembers, and the longest of them: some 20 MB.
_CACHED_TOKENS, _CACHED_BYTES = 1 << 17, 64
#: Text that is encoded at once; lists of its tokens take some twenty times as much. Short texts count for a 1024th of it, as
#: their vectors take more than they do.
_SLICE_BYTES = 1 << 20


class _Buckets(dict):
    """Token -> bucket, remembered up to a bound."""

    def __init__(self, dim: int):
        super().__init__()
        self._dim = dim

    def __missing__(self, token: bytes) -> int:
        bucket = int.from_bytes(hashlib.md5(token).digest()[:4]) % self._dim
        if len(token) <= _CACHED_BYTES:
            if len(self) >= _CACHED_TOKENS:
                self.clear()
            self[token] = bucket
        return bucket


def hashed_tokens(dim: int = VECTOR_SIZE) -> Encoder:
    """Counts of lower-case ASCII tokens in `dim` md5 buckets, scaled to length 1.

    Text without tokens gives the zero vector, which is similar to nothing.
    """
    bucket_of = _Buckets(dim)

    def encode(texts: Sequence[str]) -> np.ndarray:
        tokens = _tokens(texts)
        # every distinct token is looked up once
        found = tokens.values.dictionary_encode()
        whole = np.int32 if len(texts) * dim < 1 << 31 else np.int64
        buckets = np.array([bucket_of[token] if token else -1 for token in found.dictionary.to_pylist()], whole)
        bucket = buckets[found.indices.to_numpy()]
        cells = np.repeat(np.arange(len(texts), dtype=whole) * whole(dim), np.diff(tokens.offsets.to_numpy())) + bucket
        cells = np.sort(cells[bucket >= 0])
        first = np.flatnonzero(np.diff(cells, prepend=whole(-1)))
        used = cells[first]
        count, row = np.diff(first, append=len(cells)).astype(np.float64), used // whole(dim)
        lengths = np.sqrt(np.bincount(row, count * count, minlength=len(texts)))
        vectors = np.zeros(len(texts) * dim, np.float32)
        vectors[used] = count / lengths[row]
        return vectors.reshape(-1, dim)

    return encode


def _tokens(texts: Sequence[str]) -> pa.ListArray:
    """Lower-case ASCII tokens of each text, as bytes, perhaps with empty ones between."""
    # what is not ASCII becomes a `?`, and with the rest of the non-token bytes a blank
    plain = [
        text if not text or text.isascii() else text.lower().encode("ascii", "replace").decode() for text in texts
    ]
    array = pa.array(plain, pa.large_string()).fill_null("")
    _, ends, data = array.buffers()
    blanked = pa.py_buffer((data.to_pybytes() if data else b"").translate(_TO_TOKENS))
    split = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(array), ends, blanked))
    return pa.LargeListArray.from_arrays(split.offsets, split.values.cast(pa.large_binary()))


def text_list(texts: pa.Array) -> list[str | None]:
    """As `to_pylist`; texts in ASCII are cut out of one."""
    if texts.null_count or not pa.types.is_string(texts.type):
        return texts.to_pylist()
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist() if len(texts) else [0]
    whole = data.slice(ends[0], ends[-1] - ends[0]).to_pybytes() if data else b""
    if not whole.isascii():
        return texts.to_pylist()
    whole, least = whole.decode("ascii"), ends[0]
    return [whole[begin - least : end - least] for begin, end in zip(ends, ends[1:])]


def text_slices(texts: pa.Array, most: int, least: int = 0) -> Iterator[pa.Array]:
    """The texts in turn, each slice of about so many bytes at most, where a text counts for `least` bytes at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    place = np.cumsum(np.maximum(sizes, least), dtype=np.int64) // most
    edges = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True]))) if len(place) else np.zeros(1, int)
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield texts.slice(begin, end - begin)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    return text_slices(texts, _SLICE_BYTES, _SLICE_BYTES >> 10)


def _float_rows(encode_texts: Encoder, texts: pa.Array) -> np.ndarray:
    return np.asarray(encode_texts(text_list(texts)), dtype=np.float32)


def _list_array(parts: list[np.ndarray], empty: np.ndarray) -> pa.Array:
    """The rows of all parts as lists, with null where `empty`."""
    dim = parts[0].shape[1] if parts else 0
    ends = np.concatenate(([0], np.cumsum(~empty))).astype(np.int32) * np.int32(dim)
    flat = np.concatenate([part.reshape(-1) for part in parts]) if parts else np.zeros(0, np.float32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(empty) if empty.any() else None)


def embed_text(
    df: DataFrame, text: str, out: str = "embedding", encoder: Callable[[], Encoder] = hashed_tokens, skip_null: bool = False,
    packed: bool = False,
) -> DataFrame:
    """Add the vector of a text column. Filter and de-duplicate first: this is the dear step.

    With `skip_null` a null text has no vector and the encoder does not see it. With `packed` vectors are bytes, for a
    collection to store (`functions.vectors`).
    """
    as_array = pack_rows if packed else _list_array

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode_texts = encoder()
        # the vectors of a slice leave before the next are made: those of a whole batch take more than its texts
        for part in (part for batch in batches for part in _slices(batch)):
            empty = part.is_null() if skip_null else pa.repeat(False, len(part))
            kept = part.drop_null() if skip_null else part
            yield as_array([_float_rows(encode_texts, kept)] if len(kept) else [], empty.to_numpy(zero_copy_only=False))

    vector = F.arrow_udf(encode, T.BinaryType() if packed else T.ArrayType(T.FloatType()))
    return df.withColumn(out, vector(F.col(text)))
