"""Vector queries: similarity, exact top-k, enrichment and the label vote.

The probes are the table's own vectors read backwards, so that no vector finds itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.functions.vectors import cosine
from threatloom.operators.enrich import collect_matches
from threatloom.operators.knn import knn_join
from threatloom.operators.vote import keep_verified, vote
from threatloom.queries.standins import table
from threatloom.session import stored

_K = 5
# The test vectors are far apart, so their votes are weak.
_DEFINITE, _AMBIGUOUS_ABOVE = 0.25, 0.2


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with its successor."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return vectors.join(after, "vec_id").select("vec_id", F.round(cosine("embedding", "next"), 6).alias("score"))


COSINE_PAIRS = """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.reverse("embedding").alias("embedding")
    )


def _collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("label") % 2 == 1, "vulnerable").otherwise("safe")
    payload = F.struct(label.alias("label"), F.concat(F.lit("v"), "vec_id").alias("name"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", payload.alias("payload"))


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join(_probes(spark, sf_dir), _collection(spark, sf_dir), _K)


_RANKED = """(SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
    FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label,
                 round(list_cosine_similarity(list_reverse(q.embedding)::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
          FROM embeddings q CROSS JOIN embeddings c))"""
KNN_TOPK = f"SELECT query_id, id, score, rank FROM {_RANKED} WHERE rank <= {_K}"


def knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `knn_topk`, over the cells and chunks used when both sides are too large to broadcast."""
    return knn_join(_probes(spark, sf_dir), _collection(spark, sf_dir), _K, broadcast_cells=64 * 450, cells=16)


def enrich_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    collection = _collection(spark, sf_dir)
    matches = stored(knn_join(_probes(spark, sf_dir), collection, _K), "matches")
    nearest = collect_matches(matches, collection, out="matches")
    return nearest.select("query_id", F.array_join("matches.name", ",").alias("names"))


ENRICH_MATCHES = f"""SELECT query_id, string_agg('v' || cast(id AS VARCHAR), ',' ORDER BY rank) AS names
    FROM {_RANKED} WHERE rank <= {_K} GROUP BY query_id"""


def knn_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    collection = _collection(spark, sf_dir)
    labels = collection.select("id", "payload.label")
    return vote(knn_join(_probes(spark, sf_dir), collection, _K), labels, _K, definite=_DEFINITE)


_SUMS = f"""(SELECT query_id, sum(CASE WHEN label % 2 = 1 THEN greatest(score, 0) ELSE 0 END) AS v,
           sum(CASE WHEN label % 2 = 0 THEN greatest(score, 0) ELSE 0 END) AS s
    FROM {_RANKED} WHERE rank <= {_K} GROUP BY query_id)"""
KNN_VERDICT = f"""SELECT query_id, CASE WHEN round(greatest(v, s) / {_K}, 6) < {_DEFINITE} THEN 'ambiguous'
        WHEN v >= s THEN 'vulnerable' ELSE 'false_positive' END AS verdict,
        round(greatest(v, s) / {_K}, 6) AS confidence FROM {_SUMS}"""


def verified_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_verified(knn_verdict(spark, sf_dir), definite=_DEFINITE, ambiguous_above=_AMBIGUOUS_ABOVE)


VERIFIED_KEEP = f"""SELECT * FROM ({KNN_VERDICT})
    WHERE verdict = 'vulnerable' OR (verdict = 'ambiguous' AND confidence > {_AMBIGUOUS_ABOVE})"""


QUERIES = {
    "cosine_pairs": (cosine_pairs, COSINE_PAIRS),
    "knn_topk": (knn_topk, KNN_TOPK),
    "knn_blocks": (knn_blocks, KNN_TOPK),
    "enrich_matches": (enrich_matches, ENRICH_MATCHES),
    "knn_verdict": (knn_verdict, KNN_VERDICT),
    "verified_keep": (verified_keep, VERIFIED_KEEP),
}
