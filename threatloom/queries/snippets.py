"""Labelled-corpus queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from threatloom.constants import ID_CODE_CHARS, PROMPT_HEAD, PROMPT_TAIL, TARGET_CWES, TREE_SOURCE
from threatloom.functions import text as tx
from threatloom.functions.templates import prompt, snippet_text
from threatloom.operators.dedup import first_wins
from threatloom.operators.embed import embed_text
from threatloom.operators.extract import all_functions, labelled_functions
from threatloom.operators.points import payload_of
from threatloom.operators.stats import count_by, coverage
from threatloom.operators.union import union_all
from threatloom.plans.corpus import build_corpus, dedup_snippets, tree_snippets
from threatloom.queries.standins import (
    DATASET_A,
    DATASET_B,
    SOURCE_FILES,
    dataset_a_raw,
    dataset_b_raw,
    sql_in,
    table,
)
from threatloom.schemas import SNIPPET_PAYLOAD, SNIPPET_POINT
from threatloom.session import open_folders, run_dir
from threatloom.sources.collection import Collection
from threatloom.sources.labelled import dataset_a, dataset_b
from threatloom.sources.tree import scan_tree as scan_source_tree

_TARGETS = sql_in(TARGET_CWES)


def sql_id(key: str, digits: int = 8) -> str:
    return f"cast('0x' || substr(md5({key}), 1, {digits}) AS BIGINT)"


def sql_record_id(key: str) -> str:
    return sql_id(key, 15)


def sql_truncate(text: str) -> str:
    return f"CASE WHEN length({text}) <= 512 THEN {text} ELSE substr({text}, 1, 512) || '...' END"


def sql_cwe(raw: str) -> str:
    return f"""CASE WHEN regexp_extract({raw}, '([0-9]+)', 1) <> ''
        THEN 'CWE-' || regexp_extract({raw}, '([0-9]+)', 1) ELSE 'UNKNOWN' END"""


# --- scalar functions -------------------------------------------------------------------------


def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = F.concat(F.lit("src:"), "source", F.lit(":"), F.substring("text", 1, 32))
    return docs.select("doc_id", tx.stable_id(key).alias("id"))


STABLE_ID = f"""SELECT doc_id, {sql_id("'src:' || source || ':' || substr(text, 1, 32)")} AS id FROM documents"""


def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "documents").select("doc_id", tx.truncate(F.col("text")).alias("cut"))
    return cut.select("doc_id", F.md5("cut").alias("cut_md5"), F.length("cut").cast("long").alias("cut_length"))


TRUNCATE_TEXT = f"""SELECT doc_id, md5(cut) AS cut_md5, length(cut) AS cut_length
    FROM (SELECT doc_id, {sql_truncate("text")} AS cut FROM documents)"""


def normalize_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    brand = F.when(F.col("p_size") > 5, F.col("p_brand")).otherwise(F.col("p_type"))
    return parts.select("p_partkey", tx.normalize_cwe(brand).alias("cwe_id"))


NORMALIZE_CODE = f"""SELECT p_partkey, {sql_cwe("CASE WHEN p_size > 5 THEN p_brand ELSE p_type END")} AS cwe_id
    FROM part"""


def code_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = F.replace(F.replace("url", F.lit("/en/"), F.lit("/CWE-")), F.lit("/fr/"), F.lit("/x_cwe"))
    return pages.select("page_id", tx.cwe_from_path(path).alias("cwe_id"))


CODE_FROM_PATH = """SELECT page_id,
        CASE WHEN n <> '' THEN 'CWE-' || n ELSE 'UNKNOWN' END AS cwe_id
    FROM (SELECT page_id, regexp_extract(
            replace(replace(url, '/en/', '/CWE-'), '/fr/', '/x_cwe'), '(?i)CWE-?([0-9]+)', 1) AS n
          FROM pages)"""


def coalesce_falsy(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = dataset_a_raw(spark, sf_dir)
    return raw.select(
        "doc_id",
        F.md5(tx.first_usable(raw, ("func", "missing", "func_before"))).alias("code_md5"),
        tx.first_usable(raw, ("CWE ID", "cwe_id")).alias("cwe_raw"),
        tx.first_usable(raw, ("CVE ID", "cve_id")).alias("cve_raw"),
    )


COALESCE_FALSY = f"""SELECT doc_id, md5(coalesce(nullif(code_1, ''), nullif(code_2, ''), '')) AS code_md5,
        coalesce(nullif(cwe_1, ''), nullif(cwe_2, ''), '') AS cwe_raw,
        coalesce(nullif(cve_1, ''), nullif(cve_2, ''), '') AS cve_raw
    FROM {DATASET_A.sql()}"""


def label_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    name = F.replace(F.replace("p_name", F.lit("small"), F.lit("smallBad")), F.lit("bolt"), F.lit("GOODbolt"))
    return parts.select("p_partkey", tx.label_from_name(name).alias("label"))


LABEL_FROM_NAME = """SELECT p_partkey, CASE WHEN lower(n) LIKE '%bad%' THEN 'vulnerable'
        WHEN lower(n) LIKE '%good%' THEN 'safe' END AS label
    FROM (SELECT p_partkey, replace(replace(p_name, 'small', 'smallBad'), 'bolt', 'GOODbolt') AS n FROM part)"""


def language_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.replace("url", F.lit(".html"), F.lit(".cpp"))
    return table(spark, sf_dir, "pages").select("page_id", tx.language_of(path).alias("language"))


LANGUAGE_TAG = """SELECT page_id, CASE WHEN replace(url, '.html', '.cpp') LIKE '%.cpp' THEN 'C++' ELSE 'C' END
    AS language FROM pages"""


def relative_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", tx.relative_to(F.col("url"), host).alias("rel_path"))


RELATIVE_PATH = """SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS rel_path FROM pages"""


# --- projections and filters ------------------------------------------------------------------


def prompt_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select("doc_id", prompt(F.col("text")).alias("prompt"))
    return asked.select(
        "doc_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("prompt_length")
    )


PROMPT_COLUMN = f"""SELECT doc_id, md5(p) AS prompt_md5, length(p) AS prompt_length
    FROM (SELECT doc_id, '{PROMPT_HEAD}' || text || '{PROMPT_TAIL}' AS p FROM documents)"""


def snippet_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    label = tx.label_from_target(docs, ("quality",))
    text = snippet_text(tx.normalize_cwe(F.col("source")), F.col("lang"), label, tx.truncate(F.col("text")))
    return docs.select("doc_id", F.md5(text).alias("text_md5"))


SNIPPET_TEXT = f"""SELECT doc_id, md5('CWE: ' || {sql_cwe("source")} || ' | Language: ' || lang || ' | Label: '
        || CASE quality WHEN 1 THEN 'vulnerable' ELSE 'safe' END || chr(10) || chr(10)
        || {sql_truncate("text")}) AS text_md5
    FROM documents JOIN labels USING (doc_id)"""


def point_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = dataset_a_raw(spark, sf_dir)
    points = payload_of(dataset_a(raw), SNIPPET_PAYLOAD).select("id", "payload")
    return points.select(
        "id", "payload.label", "payload.cwe_id", "payload.source", "payload.language", "payload.file_path",
        F.md5("payload.code_snippet").alias("snippet_md5"),
    )


def target_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [f"Brand#{n}" for n in range(1, 16)]
    return table(spark, sf_dir, "part").where(tx.of_target(F.col("p_brand"), wanted)).select("p_partkey", "p_brand")


TARGET_FILTER = f"""SELECT p_partkey, p_brand FROM part
    WHERE p_brand IN {sql_in([f"Brand#{n}" for n in range(1, 16)])}"""


def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = DATASET_A.frame(spark, sf_dir).select("doc_id", "code_2").where(tx.not_blank(F.col("code_2")))
    return code.select("doc_id", F.md5(tx.strip(F.col("code_2"))).alias("stripped_md5"))


BLANK_FILTER = rf"""SELECT doc_id, md5(regexp_replace(code_2, '^\s+|\s+$', '', 'g')) AS stripped_md5
    FROM {DATASET_A.sql()} WHERE regexp_matches(code_2, '[^\s]')"""


def min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).where(tx.long_enough(F.col("name")))


MIN_LENGTH = """SELECT p_partkey, name FROM (SELECT p_partkey, p_name || ' ' || p_type AS name FROM part)
    WHERE length(name) >= 20"""


def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("target", F.col("quality") + F.col("toxic"))
    label = tx.label_from_target(labels, ("target",))
    return labels.select("doc_id", label.alias("label")).where(F.col("label").isNotNull())


LABEL_MAP = """SELECT doc_id, CASE quality + toxic WHEN 1 THEN 'vulnerable' ELSE 'safe' END AS label
    FROM labels WHERE quality + toxic IN (0, 1)"""


# --- datasets, union, de-duplication, statistics ----------------------------------------------


def _sql_dataset(standin: str, source: str, prefix: str, rank: int, code_key: str = "md5(code)", digits: int = 15) -> str:
    return f"""(
    SELECT *, {sql_id("id_key", digits)} AS id, {rank} AS source_rank, md5(code) AS order_text, 0 AS order_pos,
           {sql_truncate("code")} AS code_snippet, '{source}' AS source, 'C' AS language,
           '' AS function_name, cve AS file_path
    FROM (SELECT *, '{prefix}:' || cve || ':' || {code_key} AS id_key
          FROM (SELECT coalesce(nullif(code_1, ''), nullif(code_2, ''), '') AS code,
                       {sql_cwe("coalesce(nullif(cwe_1, ''), nullif(cwe_2, ''), '')")} AS cwe_id,
                       coalesce(nullif(cve_1, ''), nullif(cve_2, ''), 'unknown') AS cve,
                       CASE quality WHEN 1 THEN 'vulnerable' WHEN 0 THEN 'safe' END AS label
                FROM {standin})
          WHERE regexp_matches(code, '[^\\s]') AND cwe_id IN {_TARGETS} AND label IS NOT NULL))"""


A_SQL = _sql_dataset(DATASET_A.sql(), "BigVul", "bigvul", 1)
B_SQL = _sql_dataset(DATASET_B.sql(), "PrimeVul", "primevul", 2)

_SNIPPETS = "id, label, cwe_id, source, language, function_name, file_path, md5(code_snippet) AS snippet_md5"


def _shown(snippets: DataFrame) -> DataFrame:
    return snippets.select(
        "id", "label", "cwe_id", "source", "language", "function_name", "file_path",
        F.md5("code_snippet").alias("snippet_md5"),
    )


def labelled_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(dataset_a(dataset_a_raw(spark, sf_dir)))


def labelled_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(dataset_b(dataset_b_raw(spark, sf_dir)))


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [
        table(spark, sf_dir, name).select(F.lit(rank).alias("source_rank"), F.md5("text").alias("text_md5"))
        for rank, name in enumerate(("documents", "benchmark", "conversations"))
    ]
    return union_all(*frames)


UNION_SOURCES = " UNION ALL ".join(
    f"SELECT {rank} AS source_rank, md5(text) AS text_md5 FROM {name}"
    for rank, name in enumerate(("documents", "benchmark", "conversations"))
)


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        tx.stable_id(F.col("text")).alias("id"), "source", "doc_id", "lang"
    )
    return first_wins(docs, ["id"], ["source", "doc_id"])


DEDUP_FIRST = f"""SELECT id, source, doc_id, lang FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY source, doc_id) AS rn
        FROM (SELECT {sql_id("text")} AS id, source, doc_id, lang FROM documents)) WHERE rn = 1"""


def coverage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    snippets = union_all(dataset_a(dataset_a_raw(spark, sf_dir)), dataset_b(dataset_b_raw(spark, sf_dir)))
    return coverage(dedup_snippets(snippets)).orderBy("cwe_id")


_COVERAGE = """cwe_id, cast(count(*) FILTER (label = 'vulnerable') AS BIGINT) AS vulnerable,
        cast(count(*) FILTER (label = 'safe') AS BIGINT) AS safe, count(*) AS total"""


def _sql_first(*sources: str) -> str:
    columns = "id, source_rank, order_text, order_pos, cwe_id, label, code_snippet, source"
    rows = " UNION ALL ".join(f"SELECT {columns} FROM {source}" for source in sources)
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_rank, order_text,
        order_pos, cwe_id, label, code_snippet) AS rn FROM ({rows})) WHERE rn = 1)"""


COVERAGE_PIVOT = f"SELECT {_COVERAGE} FROM {_sql_first(A_SQL, B_SQL)} GROUP BY cwe_id"


def coverage_short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `coverage_pivot`, with the short ids over code prefixes, which merge different functions."""
    snippets = union_all(
        dataset_a(dataset_a_raw(spark, sf_dir), id_chars=ID_CODE_CHARS),
        dataset_b(dataset_b_raw(spark, sf_dir), id_chars=ID_CODE_CHARS),
    )
    return coverage(dedup_snippets(snippets, "id")).orderBy("cwe_id")


_SHORT = [
    _sql_dataset(DATASET_A.sql(), "BigVul", "bigvul", 1, "substr(code, 1, 32)", 8),
    _sql_dataset(DATASET_B.sql(), "PrimeVul", "primevul", 2, "substr(code, 1, 32)", 8),
]
COVERAGE_SHORT_IDS = f"SELECT {_COVERAGE} FROM {_sql_first(*_SHORT)} GROUP BY cwe_id"


def count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by(table(spark, sf_dir, "documents"), "source")


COUNT_BY_SOURCE = "SELECT source, count(*) AS n FROM documents GROUP BY source"


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a dataset after each filter, observed while the dataset is read once."""
    seen = Observation()
    dataset_a(dataset_a_raw(spark, sf_dir), seen=seen).write.format("noop").mode("overwrite").save()
    counts = seen.get
    stages = [("read", "rows"), ("with_code", "with_code"), ("in_scope", "in_scope"), ("labelled", "labelled")]
    return spark.createDataFrame([(stage, counts[name]) for stage, name in stages], "stage string, n long")


_FLAGS = f"""(SELECT regexp_matches(coalesce(nullif(code_1, ''), nullif(code_2, ''), ''), '[^\\s]') AS has_code,
        ({sql_cwe("coalesce(nullif(cwe_1, ''), nullif(cwe_2, ''), '')")}) IN {_TARGETS} AS in_scope,
        coalesce(quality IN (0, 1), false) AS labelled FROM {DATASET_A.sql()})"""
STAGE_COUNTS = f"""SELECT 'read' AS stage, count(*) AS n FROM {_FLAGS}
    UNION ALL SELECT 'with_code', count(*) FROM {_FLAGS} WHERE has_code
    UNION ALL SELECT 'in_scope', count(*) FROM {_FLAGS} WHERE has_code AND in_scope
    UNION ALL SELECT 'labelled', count(*) FROM {_FLAGS} WHERE has_code AND in_scope AND labelled"""


# --- extraction -------------------------------------------------------------------------------


def _source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SOURCE_FILES.frame(spark, sf_dir, heavy=True).select("rel_path", "text")


def extract_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labelled_functions(_source_files(spark, sf_dir), carry=["rel_path"])
    return found.select("rel_path", "function_name", "label", F.md5("code_snippet").alias("snippet_md5"))


_BLOCKS = f"""(
    SELECT rel_path, bad_name AS function_name, 'vulnerable' AS label, bad_code AS code_snippet, 0 AS pos,
           cwe_dir, suffix, text FROM {SOURCE_FILES.sql()}
    UNION ALL
    SELECT rel_path, 'goodG2B', 'safe', good_code, 1, cwe_dir, suffix, text FROM {SOURCE_FILES.sql()})"""
EXTRACT_BLOCKS = f"SELECT rel_path, function_name, label, md5(code_snippet) AS snippet_md5 FROM {_BLOCKS}"


def extract_functions_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _source_files(spark, sf_dir).withColumnRenamed("rel_path", "file_path")
    found = all_functions(files)
    return found.select("file_path", "name", "start_line", "end_line", F.md5("code").alias("code_md5"))


EXTRACT_FUNCTIONS_LINES = f"""
    SELECT rel_path AS file_path, bad_name AS name, 2 AS start_line, 7 AS end_line, md5(bad_code) AS code_md5
    FROM {SOURCE_FILES.sql()}
    UNION ALL
    SELECT rel_path, 'goodG2B', 9, 12 + uses, md5(good_code) FROM {SOURCE_FILES.sql()}"""


def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lands the source texts as gzip files in one folder per weakness, then scans that tree."""
    root = run_dir(spark, "tree")
    texts = SOURCE_FILES.frame(spark, sf_dir, heavy=True).select("cwe_dir", "text")
    # a file is read whole, so it holds some 10 MB at most
    with open_folders(spark, 32):
        texts.write.partitionBy("cwe_dir").option("compression", "gzip").option("maxRecordsPerFile", 20_000).text(root)
    tree = scan_source_tree(spark, root, suffixes=("txt",), packed=True)
    in_scope = tree.where(F.col("cwe_id").isin(*TARGET_CWES))
    found = labelled_functions(in_scope, carry=["rel_path", "cwe_id", "language"])
    folder = F.regexp_extract("rel_path", "^cwe_dir=([^/]+)/", 1)
    return found.select(
        folder.alias("folder"), "cwe_id", "language", "function_name", F.md5("code_snippet").alias("snippet_md5")
    )


_DIR_CWE = """'CWE-' || regexp_extract(cwe_dir, '(?i)CWE-?([0-9]+)', 1)"""
SCAN_TREE = f"""SELECT cwe_dir AS folder, {_DIR_CWE} AS cwe_id, 'C' AS language, function_name,
        md5(code_snippet) AS snippet_md5
    FROM {_BLOCKS} WHERE {_DIR_CWE} IN {_TARGETS}"""


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cells = embed_text(docs, "text").select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
    return cells.where("weight > 0").select("doc_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight"))


def sql_token_weights(source: str, key: str, text: str) -> str:
    """(key, bucket, weight) of the default encoding."""
    return f"""(SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight
        FROM (SELECT {key}, cast({sql_id("token")} % 384 AS INTEGER) AS bucket, cast(count(*) AS DOUBLE) AS n
              FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^a-z0-9]+')) AS token FROM {source})
              WHERE token <> '' GROUP BY 1, 2))"""


HASH_EMBED = f"""SELECT doc_id, bucket, round(cast(cast(weight AS FLOAT) AS DOUBLE), 6) AS weight
    FROM {sql_token_weights("documents", "doc_id", "text")}"""


# --- the whole corpus job ---------------------------------------------------------------------


def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree and both datasets to a stored collection; coverage by weakness and source."""
    tree = SOURCE_FILES.frame(spark, sf_dir, heavy=True).select(
        "rel_path", tx.cwe_from_path(F.col("rel_path")).alias("cwe_id"),
        tx.language_of(F.col("rel_path")).alias("language"), "text",
    )
    snippets = union_all(
        tree_snippets(tree), dataset_a(dataset_a_raw(spark, sf_dir)), dataset_b(dataset_b_raw(spark, sf_dir))
    )
    stored = build_corpus(snippets, Collection(spark, run_dir(spark, "corpus"), SNIPPET_POINT))
    return coverage(stored.select("payload.cwe_id", "payload.source", "payload.label"), ("cwe_id", "source"))


_TREE = f"""(SELECT *, {sql_record_id("id_key")} AS id FROM (
    SELECT '{TREE_SOURCE}:' || rel_path || ':' || function_name AS id_key, 0 AS source_rank,
           CASE WHEN suffix = '.c' THEN '0:' ELSE '1:' END || rel_path AS order_text, pos AS order_pos,
           {_DIR_CWE} AS cwe_id, label, {sql_truncate("code_snippet")} AS code_snippet, '{TREE_SOURCE}' AS source
    FROM {_BLOCKS} WHERE {_DIR_CWE} IN {_TARGETS}))"""
CORPUS_BUILD = f"SELECT source, {_COVERAGE} FROM {_sql_first(_TREE, A_SQL, B_SQL)} GROUP BY cwe_id, source"


QUERIES = {
    "stable_id": (stable_id, STABLE_ID),
    "truncate_text": (truncate_text, TRUNCATE_TEXT),
    "normalize_code": (normalize_code, NORMALIZE_CODE),
    "code_from_path": (code_from_path, CODE_FROM_PATH),
    "coalesce_falsy": (coalesce_falsy, COALESCE_FALSY),
    "label_from_name": (label_from_name, LABEL_FROM_NAME),
    "language_tag": (language_tag, LANGUAGE_TAG),
    "relative_path": (relative_path, RELATIVE_PATH),
    "prompt_column": (prompt_column, PROMPT_COLUMN),
    "snippet_text": (snippet_text_query, SNIPPET_TEXT),
    "point_struct": (
        point_struct,
        f"SELECT id, label, cwe_id, source, language, file_path, md5(code_snippet) AS snippet_md5 FROM {A_SQL}",
    ),
    "target_filter": (target_filter, TARGET_FILTER),
    "blank_filter": (blank_filter, BLANK_FILTER),
    "min_length": (min_length, MIN_LENGTH),
    "label_map": (label_map, LABEL_MAP),
    "labelled_a": (labelled_a, f"SELECT {_SNIPPETS} FROM {A_SQL}"),
    "labelled_b": (labelled_b, f"SELECT {_SNIPPETS} FROM {B_SQL}"),
    "union_sources": (union_sources, UNION_SOURCES),
    "dedup_first": (dedup_first, DEDUP_FIRST),
    "coverage_pivot": (coverage_pivot, COVERAGE_PIVOT),
    "coverage_short_ids": (coverage_short_ids, COVERAGE_SHORT_IDS),
    "count_by_source": (count_by_source, COUNT_BY_SOURCE),
    "stage_counts": (stage_counts, STAGE_COUNTS),
    "extract_blocks": (extract_blocks, EXTRACT_BLOCKS),
    "extract_functions_lines": (extract_functions_lines, EXTRACT_FUNCTIONS_LINES),
    "scan_tree": (scan_tree, SCAN_TREE),
    "hash_embed": (hash_embed, HASH_EMBED),
    "corpus_build": (corpus_build, CORPUS_BUILD),
}
