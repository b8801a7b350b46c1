"""Recursive scan of source trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from threatloom.functions.text import cwe_from_path, language_of, relative_to
from threatloom.operators.stats import observed

SOURCE_SUFFIXES = ("c", "cpp")


def scan_files(
    spark: SparkSession, path: str | Sequence[str], suffixes: Sequence[str] | None = SOURCE_SUFFIXES, strict: bool = True,
    packed: bool = False,
) -> DataFrame:
    """(location, path, content) of every file below `path` with one of the suffixes, or of every file.

    With `packed` the files are gzip files, whose `path` and content are those of the files in them.

    A file that vanishes or cannot be read ends the job; without `strict` it gives no row, and `unread_files` tells which.
    The glob prunes the listing, and so does a filter on `location`, the path as
    file metadata: files ruled out by either are never opened.
    """
    reader = (
        spark.read.format("text" if packed else "binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", str(not strict).lower())
        .option("ignoreCorruptFiles", str(not strict).lower())
    )
    if suffixes is not None:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}" + (".gz" if packed else ""))
    if packed:
        # bytes of whole files; the path of file metadata is encoded as in a URI
        own = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        return reader.option("wholetext", "true").load(path).select(
            F.col("_metadata.file_path").alias("location"),
            F.regexp_replace(F.regexp_replace(own, r"^file:/*", "/"), r"\.gz$", "").alias("path"),
            F.col("value").cast("binary").alias("content"),
        )
    return (
        reader.load(path)
        .select(
            F.col("_metadata.file_path").alias("location"),
            F.regexp_replace("path", r"^file:/*", "/").alias("path"),
            "content",
        )
    )


def unread_files(
    spark: SparkSession, path: str | Sequence[str], read: DataFrame, suffixes: Sequence[str] | None = SOURCE_SUFFIXES
) -> DataFrame:
    """(path, bytes, reason) of files that are listed below `path` but not among the stored rows `read` (path).

    A file is listed without being opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    if suffixes is not None:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
    listed = reader.load(path).select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), F.col("length").alias("bytes"))
    return listed.join(read.select("path").distinct(), "path", "left_anti").withColumn("reason", F.lit("unreadable"))


def raw_text(content: Column) -> Column:
    """UTF-8 text with undecodable bytes replaced, line ends kept."""
    return F.make_valid_utf8(content.cast("string"))


def read_text(content: Column) -> Column:
    """As `raw_text`, with every line end turned into a line feed."""
    return F.regexp_replace(raw_text(content), r"\r\n?", "\n")


def scan_tree(
    spark: SparkSession, root: str, suffixes: Sequence[str] = SOURCE_SUFFIXES, *, strict: bool = True,
    seen: Observation | None = None, packed: bool = False,
) -> DataFrame:
    """Source files with text, and the weakness, language and relative path their location tells.

    An observation counts the files read (`rows`) and those with bytes that are no UTF-8, which are replaced (`repaired`).
    """
    files = scan_files(spark, root, suffixes, strict, packed)
    files = observed(files, seen, repaired=~F.is_valid_utf8(F.col("content").cast("string")))
    path = F.col("path")
    return files.select(
        relative_to(path, F.lit(root)).alias("rel_path"),
        cwe_from_path(F.col("location")).alias("cwe_id"),
        language_of(path).alias("language"),
        read_text(F.col("content")).alias("text"),
    )


def _is_file(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(target) and system.getFileStatus(target).isFile()


def read_sources(
    spark: SparkSession, path: str | Sequence[str], suffixes: Sequence[str] = SOURCE_SUFFIXES, strict: bool = True
) -> DataFrame:
    """(file_path, text) of one file, several, or a whole tree, line ends kept.

    The suffixes choose the files of a tree; a file that is named is read whatever it is called.
    """
    paths = [path] if isinstance(path, str) else list(path)
    named = [p for p in paths if _is_file(spark, p)]
    trees = [p for p in paths if p not in named]
    parts = [scan_files(spark, named, None, strict)] if named else []
    parts += [scan_files(spark, trees, suffixes, strict)] if trees or not named else []
    files = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return files.select(F.col("path").alias("file_path"), raw_text(F.col("content")).alias("text"))
