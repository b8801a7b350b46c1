"""Labelled corpus: source tree and two datasets to one de-duplicated collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.constants import TARGET_CWES, TREE_SOURCE
from threatloom.functions.text import truncate
from threatloom.operators.dedup import first_wins
from threatloom.operators.embed import Encoder, hashed_tokens
from threatloom.operators.extract import labelled_functions
from threatloom.operators.points import late_embedding, snippet_points
from threatloom.session import stored
from threatloom.sources.collection import Collection
from threatloom.sources.labelled import snippet_rows, with_text

#: Ids that rows share, and first rows of these, that are sent to every task at most.
BROADCAST_IDS = 1_000_000
_ROW, _FIRST = "__row", "__first"
#: Texts and keys hardly repeat, so that dictionaries and least values of them are kept in vain; blocks are small, to be read
#: by many tasks.
_WRITTEN = {
    "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false", "parquet.block.size": str(32 << 20),
    "parquet.compression.codec.zstd.level": "1",
}
_ORDER = ("source_rank", "order_text", "order_pos", "cwe_id", "label", "code_snippet")


def tree_snippets(tree: DataFrame) -> DataFrame:
    """Snippet rows of a scanned tree (rel_path, cwe_id, language, text).

    Files out of scope are dropped by their path before their text is looked at.
    Order: `.c` files, then `.cpp`, each by path and offset.
    """
    in_scope = tree.where(F.col("cwe_id").isin(*TARGET_CWES))
    functions = labelled_functions(in_scope, carry=["rel_path", "cwe_id", "language"])
    suffix_rank = F.when(F.col("language") == "C", "0:").otherwise("1:")
    return snippet_rows(
        functions,
        snippet=truncate(F.col("code_snippet")),
        id_key=F.concat(F.lit(f"{TREE_SOURCE}:"), F.col("rel_path"), F.lit(":"), F.col("function_name")),
        language=F.col("language"),
        function_name=F.col("function_name"),
        file_path=F.col("rel_path"),
        source=TREE_SOURCE,
        source_rank=0,
        order_text=F.concat(suffix_rank, F.col("rel_path")),
        order_pos=F.col("start_offset"),
    )


def dedup_snippets(snippets: DataFrame, dedup_on: str = "id_key") -> DataFrame:
    """First row per key over tree, dataset A, dataset B.

    With short ids, `dedup_on="id"` also merges a few snippets of different keys.
    """
    return first_wins(snippets, [dedup_on], _ORDER)


def stored_unique(snippets: DataFrame, dedup_on: str = "id_key") -> DataFrame:
    """As `dedup_snippets`, of rows that are stored before, for many of which few share their key.

    A key has one id, so a row whose id no other row has is the first of its key. Only rows that share their id are compared;
    the others are neither shuffled nor sorted. If ids of more than `BROADCAST_IDS` are shared, all rows are compared.
    """
    rows = stored(snippets.withColumn(_ROW, F.monotonically_increasing_id()), "snippets", **_WRITTEN)
    if dedup_on in ("id", "id_key"):
        shared = stored(rows.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "shared")
        if shared.count() <= BROADCAST_IDS:
            compared = rows.select(*{"id", dedup_on}, *_ORDER, _ROW).join(F.broadcast(shared), "id", "left_semi")
            first = stored(dedup_snippets(compared, dedup_on).select("id", F.col(_ROW).alias(_FIRST)), "first")
            if first.count() <= BROADCAST_IDS:
                known = rows.join(F.broadcast(first), "id", "left")
                return known.where(F.col(_FIRST).isNull() | (F.col(_FIRST) == F.col(_ROW))).drop(_FIRST, _ROW)
    return stored(dedup_snippets(rows, dedup_on), "unique").drop(_ROW)


def build_corpus(
    snippets: DataFrame, collection: Collection, *, encoder: Callable[[], Encoder] = hashed_tokens, dedup_on: str = "id_key"
) -> DataFrame:
    """De-duplicate, embed and upsert; returns the stored collection, from which statistics are taken.

    Rows are stored without vectors; the upsert encodes those that are first as it writes. Should two different keys share
    an id, which 60 bits make all but impossible, the upsert keeps one of them.
    """
    collection.create()
    unique = stored_unique(snippets, dedup_on)
    collection.upsert(snippet_points(unique), unique=True, stored=True, late=late_embedding(with_text, encoder))
    return collection.read()
