"""Line de-duplication by a deletion-neighbourhood join over the words of lines (native).

Lines are compared by their lower-cased words. A line goes if an equal line stands earlier, or, from `MIN_WORDS` words
on, if a line at most one word edit away (insertion, deletion or replacement) stands earlier; documents are in the order
of doc_id and then of their text's hash, lines in their own. So the earliest of any near lines always stays.

1. Every line becomes hashes of its words; equal lines keep the first place.
2. One edit leaves the first or the last half of the shorter line's words alone. Distinct lines that share no half with
   another line have no near line and go no further; this loses none and keeps the next steps small.
3. The others emit their whole neighbourhood within the edit bound as hashed keys: the line, and the line without each
   word. A variant's hash is a sum over (word, place), from running sums, so that a line costs as much as its words.
4. Equal keys meet: two lines that lost the word of the same place differ by a replacement; a whole line and one that
   lost a word differ by an insertion. The first are compared with the earliest of their key alone, so that no key
   emits all its pairs. Each pair is verified word by word.

Nulls and empty texts have no lines; lines without words always stay. A null doc_id sorts first. Repeated rows of equal
doc_id and text are one document and each gets its result. Further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatloom.llm.scratch import once, store

WHITE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 10
#: At most so many rows of keys, or of documents with candidate lines, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_LINE = ["h1", "h2", "n"]


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), WHITE), "")


def _half_keys(w: Column, n: Column) -> list[Column]:
    """Hashes of the halves of a line, as the equal or shorter line of a pair and as the longer one."""
    keys = []
    for role in (0, 1):
        size = n - role
        first = F.floor(size / 2).cast("int")
        keys += [
            F.xxhash64(size, F.lit("first"), F.slice(w, F.lit(1), first)),
            F.xxhash64(size, F.lit("last"), F.slice(w, n - (size - first) + 1, size - first)),
        ]
    return keys


def line_hashes(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per line with words: its place, its hashes and, where it is long enough, those of its halves."""
    lines = documents.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n"))).select(
        "doc_id", "th", F.col("pos").alias("line_no"), once(_words(F.col("col"))).alias("w")
    )
    sized = lines.withColumn("n", F.size("w")).where("n > 0")
    keys = _half_keys(F.col("w"), F.col("n"))
    return sized.select(
        F.struct("doc_id", "th", "line_no").alias("place"), F.xxhash64("w").alias("h1"), F.hash("w").alias("h2"), "n",
        *[F.when(F.col("n") >= min_words, k).alias(f"k{i}") for i, k in enumerate(keys)],
    )


def _semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among `keys`: by broadcast if those are few, else by a shuffle."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if few else keys, on, "left_semi")


def _lines_with_partner(distinct: DataFrame) -> DataFrame:
    """Distinct lines that share a half with another one."""
    dealt = distinct.where("k0 IS NOT NULL").select("h1", F.explode(F.array("k0", "k1", "k2", "k3")).alias("k"))
    shared = dealt.groupBy("k").count().where("count > 1").select("k")
    wanted = store(dealt.join(shared, "k", "left_semi").select("h1").distinct(), "partner-lines")
    return _semi(distinct.where("k0 IS NOT NULL"), wanted, "h1").select(*_LINE, "first")


def _with_words(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines with their words, fetched from the documents at their first places, and a number `line` in their order."""
    wanted = store(
        lines.groupBy(F.col("first.doc_id").alias("_doc"), F.col("first.th").alias("_th"))
        .agg(F.collect_list(F.struct(*_LINE, "first")).alias("_wanted")),
        "wanted-lines",
    )
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    found = documents.select("doc_id", F.xxhash64("text").alias("th"), "text").join(
        wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))
    )
    split = found.select("_wanted", F.split("text", "\n").alias("_lines"))
    picked = F.transform(
        F.col("_wanted"), lambda x: F.struct(x.alias("line"), F.get(F.col("_lines"), x["first"]["line_no"]).alias("text"))
    )
    worded = split.select(F.explode(picked).alias("x")).select("x.line.*", _words(F.col("x.text")).alias("w"))
    # numbered once in a stored table, so that the numbers stay what they are
    return worded.dropDuplicates(_LINE).orderBy("first").withColumn("line", F.monotonically_increasing_id())


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """Hashed keys of all variants: a row per deleted word `at`, and one with `at` -1 for the whole line."""
    words = lines.select("line", "n", F.posexplode("w").alias("at", "word"))
    # sums of 40-bit values stay exact for lines of millions of words

    def value(seed: int, place: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "word", place), 24)

    terms = words.select(
        "line", "n", "at",
        *[value(seed, F.col("at")).alias(f"a{seed}") for seed in (1, 2)],
        *[value(seed, F.col("at") - 1).alias(f"b{seed}") for seed in (1, 2)],
    )
    line = Window.partitionBy("line")
    upto = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = terms.select(
        "line", "n", "at",
        *[
            # words before the place, and words after it moved up by one
            (F.sum(f"a{s}").over(upto) - F.col(f"a{s}") + F.sum(f"b{s}").over(line) - F.sum(f"b{s}").over(upto)).alias(f"v{s}")
            for s in (1, 2)
        ],
        *[F.sum(f"a{s}").over(upto).alias(f"whole{s}") for s in (1, 2)],
    )
    last = F.col("at") == F.col("n") - 1
    variants = F.array(
        F.struct("at", (F.col("n") - 1).alias("size"), "v1", "v2"),
        F.when(last, F.struct(F.lit(-1).alias("at"), F.col("n").alias("size"), F.col("whole1").alias("v1"),
                              F.col("whole2").alias("v2"))),
    )
    return summed.select("line", F.explode(F.array_compact(variants)).alias("x")).select("line", "x.*").withColumn(
        "key", F.xxhash64("size", "v1", "v2")
    )


def _shared_variants(variants: DataFrame) -> DataFrame:
    """Variants whose key another line has too."""
    shared = variants.groupBy("key").count().where("count > 1").select("key")
    return _semi(variants, store(shared, "shared-variants"), "key")


def _near_pairs(variants: DataFrame) -> DataFrame:
    """Pairs (later line, earlier line, place) whose variants are equal."""
    key = ["size", "v1", "v2"]
    cut = variants.where("at >= 0")
    # replacements: lines without the word of the same place; each meets the earliest of its key
    earliest = cut.groupBy(*key, "at").agg(F.min("line").alias("early"))
    replaced = cut.join(earliest, [*key, "at"]).where("line > early").select(F.col("line").alias("late"), "early", "at")
    # insertions: a line without a word is another whole line
    whole = variants.where("at < 0").select(*key, F.col("line").alias("short"))
    inserted = cut.join(whole, key).select(
        F.greatest("line", "short").alias("late"), F.least("line", "short").alias("early"), "at"
    )
    return replaced.union(inserted)


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Later lines of pairs that are one word edit apart."""
    both = (
        pairs.join(lines.select(F.col("line").alias("late"), *_LINE, F.col("w").alias("wl")), "late")
        .join(lines.select(F.col("line").alias("early"), F.col("w").alias("we")), "early")
    )

    def before(w: str) -> Column:
        return F.slice(w, F.lit(1), F.col("at"))

    def after(w: str, skipped: int) -> Column:
        return F.slice(F.col(w), F.col("at") + 1 + skipped, F.greatest(F.size(w) - F.col("at") - skipped, F.lit(0)))

    longer = F.size("wl") - F.size("we")
    same = (before("wl") == before("we")) & (
        F.when(longer == 0, after("wl", 1) == after("we", 1))
        .when(longer == 1, after("wl", 1) == after("we", 0))
        .when(longer == -1, after("wl", 0) == after("we", 1))
        .otherwise(False)
    )
    return both.where(same).select(*_LINE).distinct()


def line_drops(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document with lines to drop: `doc_id`, `th` (hash of its text), `drops` and, of those, `near` line numbers."""
    lines = store(line_hashes(documents, min_words), "lines")
    distinct = store(
        lines.groupBy(*_LINE).agg(
            F.min("place").alias("first"), F.count("*").alias("times"),
            *[F.any_value(f"k{i}").alias(f"k{i}") for i in range(4)],
        ),
        "distinct-lines",
    )
    candidates = store(_with_words(documents, _lines_with_partner(distinct)), "candidate-lines")
    variants = store(_neighbourhood(candidates), "line-variants")
    near = store(_verified(_near_pairs(store(_shared_variants(variants), "met-variants")), candidates), "near-lines")
    marked = distinct.select(*_LINE, "first", "times").join(near.withColumn("near", F.lit(True)), _LINE, "left")
    marked = store(marked.where("times > 1 OR near").drop("times"), "marked-lines")
    if marked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marked = F.broadcast(marked)
    fates = lines.select(*_LINE, "place").join(marked, _LINE)
    repeated = F.col("place") > F.col("first")
    return (
        fates.where(repeated | F.col("near"))
        .groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.th").alias("th"))
        .agg(
            F.sort_array(F.collect_set("place.line_no")).alias("drops"),
            F.sort_array(F.collect_set(F.when(~repeated, F.col("place.line_no")))).alias("near"),
        )
    )


def _joined(documents: DataFrame, drops: DataFrame) -> DataFrame:
    """Documents with `_drops` and `_near`, null where no line goes."""
    drops = drops.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_dth"), F.col("drops").alias("_drops"),
                         F.col("near").alias("_near"))
    return documents.withColumn("_th", F.xxhash64("text")).join(
        drops, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_th") == F.col("_dth")), "left"
    )


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without repeated and near-repeated lines. A document that loses all its words goes."""
    rows = documents.select("doc_id", "text", F.struct("*").alias("_row"))  # apart from the names used here
    joined = _joined(rows, line_drops(documents, min_words))
    kept = F.array_join(
        F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("_drops"), i)), "\n"
    )
    text = F.when(F.col("_drops").isNull(), F.col("text")).otherwise(kept)
    return (
        joined.withColumn("_kept", once(text))
        .where(F.col("_drops").isNull() | F.col("_kept").rlike(r"[^\x20\x09-\x0D]"))
        .select(*(F.col("_kept" if c == "text" else f"_row.`{c}`").alias(c) for c in documents.columns))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go and which."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sized = documents.select(
        "doc_id", "text", F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("long").alias("n_lines")
    )
    joined = _joined(sized, line_drops(documents))
    return joined.select(
        "doc_id", "n_lines", F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.size("_near"), F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.array_join("_drops", ","), F.lit("")).alias("dropped"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


SQL = r"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM raw),
     o AS (SELECT doc_id, line_no,
                  list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w FROM l),
     k AS (SELECT doc_id, line_no, w, len(w) AS n,
                  row_number() OVER (PARTITION BY w ORDER BY doc_id, line_no) AS nth,
                  row_number() OVER (ORDER BY doc_id, line_no) AS place FROM o WHERE len(w) > 0),
     f AS (SELECT * FROM k WHERE nth = 1 AND n >= 10),
     p AS (SELECT a.place AS pa, b.place AS pb FROM f a JOIN f b ON a.n = b.n AND a.place < b.place
           WHERE list_sum(list_transform(range(1, a.n + 1), lambda i : CAST(a.w[i] <> b.w[i] AS INT))) = 1
           UNION ALL
           SELECT a.place, b.place FROM f a JOIN f b ON b.n = a.n + 1
           WHERE len(list_filter(range(0, b.n), lambda i : list_concat(b.w[1:i], b.w[i + 2:]) = a.w)) > 0),
     near AS (SELECT DISTINCT w FROM f WHERE place IN (SELECT greatest(pa, pb) FROM p)),
     d AS (SELECT k.doc_id, k.line_no, nth = 1 AS is_near FROM k LEFT JOIN near ON k.w = near.w
           WHERE nth > 1 OR near.w IS NOT NULL),
     g AS (SELECT doc_id, count(*) AS n_dropped, count(*) FILTER (WHERE is_near) AS n_near,
                  string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS dropped FROM d GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(array_to_string(ls, ' ')) > 0 OR len(ls) > 1 THEN CAST(len(ls) AS BIGINT) ELSE 0 END AS n_lines,
       coalesce(n_dropped, 0) AS n_dropped, coalesce(n_near, 0) AS n_near, coalesce(dropped, '') AS dropped
FROM raw LEFT JOIN g USING (doc_id)
"""
