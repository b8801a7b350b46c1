"""Encoding, exact top-k, votes and verification."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threatloom.functions.vectors import cosine
from threatloom.operators.embed import embed_text, hashed_tokens
from threatloom.operators import knn
from threatloom.operators.enrich import attach_matches
from threatloom.operators.knn import knn_join
from threatloom.operators.vote import keep_verified, vote
from threatloom.plans.verify import verify_findings

VECTORS = "id long, embedding array<float>"


def brute_force(queries, corpus, k):
    out = {}
    for q, u in queries:
        if not any(u):
            continue
        scored = []
        for i, v in corpus:
            if any(v):
                a, b = np.array(u, dtype=float), np.array(v, dtype=float)
                scored.append((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6), i))
        for rank, (score, i) in enumerate(sorted(scored)[:k], 1):
            out[q, rank] = (i, -score)
    return out


def random_vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    # few distinct values, so that there are many ties
    return [(i, [float(x) for x in rng.integers(-2, 3, dim)]) for i in range(n)]


# collection broadcast, queries broadcast (160 elements against 244), cells with chunks of 10 and of 25 queries
@pytest.mark.parametrize(
    "options", [{}, {"broadcast_cells": 200}, {"broadcast_cells": 40, "cells": 3}, {"broadcast_cells": 100, "cells": 7}]
)
def test_knn_equals_brute_force(spark, options):
    queries, corpus = random_vectors(40, 4, 1), random_vectors(60, 4, 2)
    corpus.append((100, [0.0] * 4))
    found = knn_join(
        spark.createDataFrame(queries, "query_id long, embedding array<float>").repartition(3),
        spark.createDataFrame(corpus, VECTORS).repartition(5), 5, **options,
    ).collect()
    got = {(r.query_id, r.rank): (r.id, pytest.approx(r.score, abs=1e-9)) for r in found}
    assert got == brute_force(queries, corpus, 5)


@pytest.mark.parametrize("options", [{}, {"broadcast_cells": 7}, {"broadcast_cells": 0}])
def test_knn_edges(spark, options):
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("zero", [0.0, 0.0]), ("none", None)], "query_id string, embedding array<float>")
    corpus = spark.createDataFrame([(2, [2.0, 0.0]), (1, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, None)], VECTORS)
    rows = [tuple(r) for r in knn_join(queries, corpus, 10, **options).orderBy("rank").collect()]
    assert rows == [("q", 1, 1.0, 1), ("q", 2, 1.0, 2), ("q", 3, -1.0, 3)]
    assert knn_join(queries, corpus.limit(0), 5, **options).count() == 0
    assert knn_join(queries.limit(0), corpus, 5, **options).count() == 0


def clustered(n, seed):
    """Vectors near one of eight directions of sixteen."""
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.eye(16)[i % 8] + rng.normal(0, 0.03, 16)]) for i in range(n)]


def test_far_cells_are_not_read(spark, monkeypatch):
    left_out = []
    real = knn.needed_cells

    def seen(queries, near, own, pivots, reach, k):
        needed = real(queries, near, own, pivots, reach, k)
        left_out.append((len(needed), len(reach) - len(set(own) & set(reach))))
        return needed

    monkeypatch.setattr(knn, "needed_cells", seen)
    queries, corpus = clustered(40, 3), clustered(400, 4)
    found = knn_join(
        spark.createDataFrame(queries, "query_id long, embedding array<float>"), spark.createDataFrame(corpus, VECTORS),
        3, broadcast_cells=16 * 10, cells=24,
    ).collect()
    got = {(r.query_id, r.rank): (r.id, pytest.approx(r.score, abs=1e-6)) for r in found}
    assert got == brute_force(queries, corpus, 3)
    # pairs of a chunk and a cell that are dropped, beside the chunk's own cells
    needed, others = (sum(x) for x in zip(*left_out))
    assert len(left_out) > 2 and needed < 0.5 * others


def test_a_pruned_cell_is_not_opened(spark):
    pivots = np.eye(3)
    queries = pa.table({"query_id": [1], "vector": [[1.0, 0.1, 0.0]]})
    near = pa.table({"query_id": [1], "score": [0.9], "rank": [1]})
    assert knn.needed_cells(queries, near, [0], pivots, {0: 0.1, 1: 0.2, 2: 1.3}, 1) == {2}
    # one match of two wanted: nothing may be dropped
    assert knn.needed_cells(queries, near, [0], pivots, {0: 0.1, 1: 0.2, 2: 1.3}, 2) == {1, 2}


def test_small_chunks_share_a_pass(spark, monkeypatch):
    """The collection is not read again for each chunk of queries; vectors and results are the same in one pass and in several."""
    reads = []
    real = knn._partial_best

    def seen(*args, **options):
        reads.append(1)
        return real(*args, **options)

    monkeypatch.setattr(knn, "_partial_best", seen)
    queries, corpus = random_vectors(90, 6, 5), random_vectors(120, 6, 6)
    left = spark.createDataFrame(queries, "query_id long, embedding array<float>").repartition(2)
    right = spark.createDataFrame(corpus, VECTORS).repartition(3)
    want = brute_force(queries, corpus, 4)
    # 30 chunks of 3 queries: their own cells, then the others
    for elements, most in ((knn.BROADCAST_CELLS, 2), (6 * 30, 20)):
        monkeypatch.setattr(knn, "_PASS_CELLS", elements, raising=False)
        reads.clear()
        rows = knn_join(left, right, 4, broadcast_cells=18, cells=5).collect()
        assert {(r.query_id, r.rank): (r.id, pytest.approx(r.score, abs=1e-9)) for r in rows} == want
        assert 0 < len(reads) <= most


def test_scores_too_near_for_single_precision():
    """Differences below what a product in single precision shows decide the order; many blocks, ties and unusable rows."""
    rng = np.random.default_rng(8)
    base, other = rng.normal(size=(2, 1, 32))
    side = other - (other @ base.T) / (base @ base.T) * base
    angles = 0.01 + np.repeat(rng.permutation(2_500), 2) * 2e-7
    matrix = base / np.linalg.norm(base) * np.cos(angles)[:, None] + side / np.linalg.norm(side) * np.sin(angles)[:, None]
    ids = rng.permutation(5_000)
    vectors = np.concatenate([base / np.linalg.norm(base), matrix[:600]])
    owner, found, score = knn._best_indices(vectors, ids, matrix, 7)
    kept, _ = knn._ranked(owner, found, score, 7)
    for query in (0, 1, 300, 600):
        scores = np.round(matrix @ vectors[query], 6)
        want = np.lexsort((ids, -scores))[:7]
        of_query = kept[owner[kept] == query]
        assert found[of_query].tolist() == ids[want].tolist() and score[of_query] == pytest.approx(scores[want], abs=1e-9)


def test_vectors_without_a_direction_hide_no_others(spark):
    bad = [(100, [float("inf"), 0.0]), (101, [float("nan"), 1.0]), (102, [0.0, 0.0])]
    queries, corpus = random_vectors(12, 2, 9), random_vectors(20, 2, 10)
    left = spark.createDataFrame(queries + bad, "query_id long, embedding array<float>").coalesce(1)
    right = spark.createDataFrame(corpus + bad, VECTORS).coalesce(1)
    for options in ({}, {"broadcast_cells": 8, "cells": 3}):
        rows = knn_join(left, right, 3, **options).collect()
        assert {(r.query_id, r.rank): (r.id, pytest.approx(r.score, abs=1e-9)) for r in rows} == brute_force(queries, corpus, 3)


def test_enrichment_scans_vectors_and_payloads_once(spark, tmp_path):
    rows = spark.range(200).select("id", F.concat(F.lit("word"), "id").alias("text"))
    points = embed_text(rows, "text").select("id", "embedding", F.struct("text").alias("payload"))
    points.write.parquet(f"{tmp_path}/points")
    collection = spark.read.parquet(f"{tmp_path}/points")
    found = rows.limit(20).select(F.col("text").alias("description"))
    scans = []
    real = type(collection).toArrow

    def counted(frame):
        scans.append(frame._jdf.queryExecution().executedPlan().toString())
        return real(frame)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(collection), "toArrow", counted)
        matched = attach_matches(found, collection, k=2)
    assert len(scans) == 1 and "payload" not in scans[0] and "embedding" in scans[0]
    plan = matched._jdf.queryExecution().executedPlan().toString()
    # paths are cut short in plans, so that the columns tell the scans apart
    scanned = [line.split("]")[0] for line in plan.splitlines() if "FileScan" in line]
    of_points = [columns for columns in scanned if "payload#" in columns]
    assert len(of_points) == 1 and not any("embedding#" in columns for columns in scanned)
    assert all(r.cve_matches[0].text == r.description for r in matched.collect())


def test_verification_joins_findings_once(spark):
    snippets = embed_text(spark.createDataFrame([(1, "a b", "safe"), (2, "a c", "vulnerable")], "id long, text string, label string"), "text")
    points = snippets.select("id", "embedding", F.struct("label").alias("payload"))
    findings = spark.createDataFrame([("f", "a b")], "name string, code string")
    plan = verify_findings(findings, points, k=2)._jdf.queryExecution().optimizedPlan().toString()
    # matches with payloads, their ids with the entries, findings with the outcome
    assert plan.count("Join ") == 3


def test_cosine_of_a_zero_vector_is_null(spark):
    df = spark.createDataFrame([([1.0, 1.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<float>, b array<float>")
    assert [r.s for r in df.select(F.round(cosine("a", "b"), 9).alias("s")).collect()] == [None, 1.0]


def test_encoder_edges():
    vectors = hashed_tokens(8)(["", "Abc abc!", None])
    assert not vectors[0].any() and not vectors[2].any()
    assert np.isclose(vectors[1], 1.0).sum() == 1


def test_embedding_no_rows(spark):
    assert embed_text(spark.createDataFrame([], "text string"), "text").count() == 0


def test_vote(spark):
    matches = spark.createDataFrame(
        [("sure", 1, 1.0), ("sure", 2, 0.9), ("sure", 3, 0.5), ("weak", 1, 0.2), ("weak", 3, -0.9), ("safe", 3, 0.9), ("safe", 4, 0.9), ("safe", 1, 0.1)],
        "query_id string, id long, score double",
    )
    labels = spark.createDataFrame([(1, "vulnerable"), (2, "vulnerable"), (3, "safe"), (4, "safe")], "id long, label string")
    rows = {r.query_id: (r.verdict, r.confidence) for r in vote(matches, labels, 3, definite=0.5).collect()}
    assert rows == {"sure": ("vulnerable", 0.633333), "weak": ("ambiguous", 0.066667), "safe": ("false_positive", 0.6)}


def test_keep_rule(spark):
    cases = [("vulnerable", 0.1, True), ("ambiguous", 0.61, True), ("ambiguous", 0.6, False), ("false_positive", 0.75, False),
             ("false_positive", 0.74, True), (None, None, True)]
    df = spark.createDataFrame([(i, v, c) for i, (v, c, _) in enumerate(cases)], "i int, verdict string, confidence double")
    assert {r.i for r in keep_verified(df).collect()} == {i for i, case in enumerate(cases) if case[2]}


def test_verify(spark):
    snippets = spark.createDataFrame([(1, "strcpy buffer", "vulnerable"), (2, "strcpy buffer bound", "vulnerable"), (3, "return sum", "safe"), (4, "return sum total", "safe")], "id long, text string, label string")
    points = embed_text(snippets, "text").select("id", "embedding", F.struct("label", "text").alias("payload"))
    findings = spark.createDataFrame([("f", "strcpy buffer"), ("g", "return sum"), ("h", "other words")], "name string, code string")
    rows = {r.name: r for r in verify_findings(findings, points, k=2).collect()}
    assert set(rows) == {"f"}
    assert rows["f"].verdict == "vulnerable" and [m.text for m in rows["f"].top_matches] == ["strcpy buffer", "strcpy buffer bound"]
    assert verify_findings(findings, points.limit(0), k=2).count() == 3


@pytest.mark.parametrize("vectors", [[[], [1.0, 0.0]], [[1.0], [1.0, 0.0]]])
def test_ragged_vectors_are_refused(spark, vectors):
    corpus = spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    with pytest.raises(ValueError, match="dimensions"):
        knn_join(queries, corpus, 1, broadcast_cells=10)


def test_texts_are_encoded_in_slices(spark, monkeypatch):
    """A batch of long texts is shown to the encoder in bounded parts, with the same vectors; skipped nulls have none."""
    import numpy as np
    import pyarrow as pa

    from threatloom.operators import embed

    monkeypatch.setattr(embed, "_SLICE_BYTES", 100)
    texts = pa.array(["a b " * n for n in range(30)] + [None, ""])
    parts = list(embed._slices(texts))
    assert [t for part in parts for t in part.to_pylist()] == texts.to_pylist()
    assert len(parts) > 10
    encode = embed.hashed_tokens()
    got = embed._list_array([embed._float_rows(encode, part) for part in parts], np.zeros(32, bool))
    assert got.to_pylist() == embed._float_rows(embed.hashed_tokens(), texts).tolist()
    frame = spark.createDataFrame([("a b",), (None,), ("",)], "text string")
    rows = {r.text: r.embedding for r in embed.embed_text(frame, "text", skip_null=True).collect()}
    assert rows[None] is None and len(rows["a b"]) == len(rows[""]) == 384


def test_vectors_of_a_batch_leave_in_slices(spark):
    """Short texts are cut by their number, as their vectors take more than they do; the rows of a large batch are all there."""
    import pyarrow as pa

    from threatloom.operators import embed

    texts = pa.array(["a b"] * 5_000)
    parts = [len(part) for part in embed._slices(texts)]
    assert max(parts) <= 1_025 and sum(parts) == 5_000
    frame = spark.range(5_000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("w"), F.col("id") % 7)).alias("text"))
    got = embed.embed_text(frame.coalesce(1), "text", skip_null=True).select("id", "text", F.size("embedding").alias("n"))
    assert got.where("(text IS NULL) <> (n IS NULL OR n < 0)").count() == 0 and got.where("n = 384").count() == 3_333


def test_packed_vectors_keep_every_bit():
    """Sparse, dense and ragged vectors, negative zeros, infinities and NaN come back as they were; nulls stay null."""
    from threatloom.functions import vectors as module

    rng = np.random.default_rng(1)
    dense, sparse = rng.random((6, 9), np.float32), np.zeros((5, 300), np.float32)
    dense[0, 0], dense[1, 1], dense[2] = -0.0, np.nan, 0.0
    sparse[0, 3], sparse[1, 299], sparse[3, 0], sparse[3, 7] = -0.0, np.inf, np.nan, 0.25
    parts = [dense, sparse, np.zeros((1, 0), np.float32), np.zeros((1, 70_000), np.float32)]
    empty = np.array([False] * 4 + [True] + [False] * 9 + [True])
    packed = module.pack_rows(parts, empty)
    assert len(packed[6].as_py()) < 4 * 300 and packed.is_null().to_pylist() == empty.tolist()
    bits = np.concatenate([part.reshape(-1) for part in parts]).tobytes()
    for form in (packed, module._pack_lists(module.unpack_rows(packed))):
        vectors = module.unpack_rows(form)
        assert vectors.flatten().to_numpy().tobytes() == bits and vectors.is_null().to_pylist() == empty.tolist()
        assert [len(v) for v in vectors.drop_null().to_pylist()] == [9] * 6 + [300] * 5 + [0, 70_000]
    assert module.unpack_rows(module.pack_rows([], np.ones(2, bool))).to_pylist() == [None, None]
    with pytest.raises(ValueError, match="null"):
        module._pack_lists(pa.array([[1.0, None]], pa.list_(pa.float32())))


def test_encoder_counts_tokens():
    """As counted one by one, over texts with letters that only lower-casing makes ASCII, blanks of all kinds and long tokens."""
    import hashlib
    import re

    texts = ["", None, "a b a", "Straße \u212aelvin I\u0307x \u0130y", "x" * 100 + "\x00y\x1c9\u00a0z", " lead\ttrail ", "ÀB-c_D", "aA" * 40]
    want = np.zeros((len(texts), 16))
    for row, text in enumerate(texts):
        for token in re.findall("[a-z0-9]+", (text or "").lower()):
            want[row, int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 16] += 1
    lengths = np.sqrt((want * want).sum(1))[:, None]
    want = np.divide(want, lengths, out=want, where=lengths > 0).astype(np.float32)
    assert (np.asarray(hashed_tokens(16)(texts), np.float32) == want).all()
    assert hashed_tokens(16)([]).shape == (0, 16)
