"""SimHash near-duplicates, found with pivot distance tables.

A document's fingerprint takes the majority of each bit over the XXH64 hashes of its word shingles. Every fingerprint
gets its Hamming distances to many fixed reference fingerprints (pivots). Two fingerprints at most `bits` apart differ
by at most `bits` in every such distance, so a pair with a larger difference in any coordinate is discarded; of the
others the exact distance is verified.

So that not all pairs meet, the table also holds the distances within each of six blocks of the bits: at most four
differing bits leave at least two blocks alone, so linked fingerprints agree in all distances of at least one pair of
blocks. Each distinct fingerprint is dealt to the 15 buckets of its block pairs; copies of a text meet nowhere. Within a
bucket only links that join two parts are emitted. A bucket of more than `BUCKET` fingerprints is dealt as pairs of
chunks, so that no task holds more than two chunks of one bucket at once.

The pipeline's stage takes the links of fingerprints as its candidates and verifies them by the exact similarity of the
documents' sets of shingles. A similarity of 0.8 may lie beyond four bits, so `one_per_group` then looks for similar pairs among
documents that these links leave apart (module `similar`).

A null or empty text has fingerprint zero and links like any other. Rows that share a doc_id are one document with
several texts; each row is reported. A null doc_id never becomes a component's id unless all its members have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatloom.llm.components import connected_components
from threatloom.llm.scratch import store
from threatloom.llm.similar import SIMILAR_SHINGLE, SIMILARITY, shingle_hashes, similar_groups

SHINGLE_WORDS = 4
MAX_BITS = 4
BLOCKS = 6
BUCKET = 4096
N_PIVOTS = 16


def _pivots(n: int) -> list[int]:
    """Fixed reference fingerprints: XXH64 of the numbers 0, 1, ..."""
    return [xxhash.xxh64_intdigest(str(i).encode(), 42) for i in range(n)]


PIVOTS = _pivots(N_PIVOTS)
_BLOCK_MASKS = [
    sum(1 << bit for bit in range(64 * i // BLOCKS, 64 * (i + 1) // BLOCKS)) for i in range(BLOCKS)
]


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint of one text; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the memory of very long texts
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            columns = [batch.column("doc_id"), pa.array(marks.view(np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp"])

    return run


def fingerprints(documents: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """`doc_id` and fingerprint `fp`, as a signed long, of every row."""
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_fingerprints(shingle), f"doc_id {id_type}, fp long")


def _mix(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit key of two words and a number, by multiplications that wrap."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint with its buckets: one for each pair of blocks, from the distances to all pivots within them."""
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        blocks = []
        for mask in _BLOCK_MASKS:
            # a block has at most 11 bits, so that 16 distances of four bits make one word
            word = np.zeros(len(fps), np.uint64)
            for n, pivot in enumerate(PIVOTS):
                word |= np.bitwise_count((fps ^ np.uint64(pivot)) & np.uint64(mask)).astype(np.uint64) << np.uint64(4 * n)
            blocks.append(word)
        keys = [_mix(blocks[i], blocks[j], n) for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(fps, len(keys)).view(np.int64)), pa.array(np.concatenate(keys).view(np.int64))],
            names=["fp", "key"])


def _close(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray, bits: int) -> np.ndarray:
    """Whether the pairs are linked: discarded by the coordinates first, the rest verified."""
    near = np.ones(len(a), bool)
    for coordinate in range(ca.shape[1]):
        at = np.flatnonzero(near)
        near[at] = np.abs(ca[at, coordinate] - cb[at, coordinate]) <= bits
        if len(at) < 64:
            break
    at = np.flatnonzero(near)
    near[at] = np.bitwise_count(a[at] ^ b[at]) <= bits
    return near


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of one bucket that join its parts, each from a member to the first of its part."""
    pivots = np.array(PIVOTS, np.uint64)
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        first, left = left[0], left[1:]
        front = [first]
        while front and len(left):
            at = front.pop()
            n = len(left)
            near = _close(np.full(n, fps[at]), fps[left], np.broadcast_to(table[at], (n, table.shape[1])), table[left], bits)
            hit = left[near]
            out += [(int(first), int(x)) for x in hit]
            front += hit.tolist()
            left = left[~near]
    return out


def _links(bits: int):
    """Verified links of buckets whose rows come sorted; a bucket may lie across batches."""

    def of(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        pairs_a, pairs_b = [], []
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        sizes = np.diff(edge)
        # buckets of two are verified all at once
        two = edge[:-1][sizes == 2]
        if len(two):
            pivots = np.array(PIVOTS, np.uint64)
            a, b = fps[two], fps[two + 1]
            ca, cb = (np.bitwise_count(x[:, None] ^ pivots).astype(np.int8) for x in (a, b))
            near = _close(a, b, ca, cb, bits)
            pairs_a.append(a[near])
            pairs_b.append(b[near])
        for begin, size in zip(edge[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = fps[begin : begin + size]
            if found := _forest(own, bits):
                at = np.array(found)
                pairs_a.append(own[at[:, 0]])
                pairs_b.append(own[at[:, 1]])
        none = [np.empty(0, np.uint64)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x or none).view(np.int64)) for x in (pairs_a, pairs_b)], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column("key").to_numpy()))
            fps = np.concatenate((fps, batch.column("fp").to_numpy().view(np.uint64)))
            cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last bucket may go on
            if cut:
                yield of(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield of(keys, fps)

    return run


def near_links(marks: DataFrame, bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links `a`, `b` between distinct fingerprints `fp` that join all fingerprints at most `bits` apart."""
    if bits >= BLOCKS - 1:
        raise ValueError(f"{BLOCKS} blocks find at most {BLOCKS - 2} differing bits")
    dealt = marks.select("fp").mapInArrow(_bucket_rows, "fp long, key long")
    large = dealt.groupBy("key").count().where(F.col("count") > bucket).select(
        "key", F.ceil(F.col("count") / bucket).cast("int").alias("chunks")
    )
    # a member of a large bucket goes to each pair of chunks that its own is part of
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    pairs = F.when(
        F.col("chunks").isNull(), F.array(F.col("key"))
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("chunks") - 1),
            lambda other: F.xxhash64(F.col("key"), F.least(own, other), F.greatest(own, other)),
        )
    )
    spread = dealt.join(large, "key", "left").select("fp", F.explode(pairs).alias("key"))
    grouped = spread.repartition("key").sortWithinPartitions("key", "fp")
    return grouped.mapInArrow(_links(bits), "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """`doc_id`, `fp` and `component_id`, the smallest doc_id reachable by links, of every row."""
    every = store(fingerprints(documents, shingle), "fingerprints")
    distinct = every.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(near_links(distinct.select("fp"), bits))
    members = store(
        distinct.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left")
        .select("fp", "first_id", F.coalesce("root", "fp").alias("root")),
        "members",
    )
    least = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return every.join(members.join(least, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def one_per_group(documents: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Documents without their near-duplicates: of each component of similar documents the smallest doc_id stays.

    Fingerprints linked through the pivot tables are verified first, an exact join finds what they leave apart. Of rows that share a doc_id the one with the smallest text stays; rows without a doc_id all stay.
    """
    groups = similar_groups(documents, shingle, similarity, (fingerprint, near_links))
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy("text")
    rows = documents.select("doc_id", "text", F.struct("*").alias("_row"))  # apart from the names used here
    return (
        rows.join(gone, "doc_id", "left_anti")
        .withColumn("_nth", F.when(F.col("doc_id").isNull(), 1).otherwise(F.row_number().over(order)))
        .where("_nth = 1")
        .select("_row.*")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(documents).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs)
