"""Reading and writing raw text files and file catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import universal_newlines, utf8_lossy
from textloom.runtime import cut, running

# Fixed value: the sentence an empty source may fall back to.
DUMMY_TEXT = "Hello world. This is dummy text for testing."


class EmptySource(ValueError):
    """No file matched and no fallback was asked for."""


def scan_files(
    spark: SparkSession,
    path: str,
    pattern: str = "*.py",
    recursive: bool = False,
    on_empty: str = "raise",
    on_error: str = "raise",
) -> DataFrame:
    """``(path, name, text)``, one row per file; invalid bytes dropped, newlines normalised.

    ``on_empty``: ``raise``, ``empty`` (no rows) or ``dummy`` (one fixed sentence).
    ``on_error``: ``raise``, or ``report``: a file that cannot be read is a row without text,
    which screening counts as skipped (``unreadable``).
    """
    raw = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .option("ignoreCorruptFiles", str(on_error == "report").lower())
        .load(path)
    )
    texts = raw.select(
        "path",
        F.regexp_extract("path", "[^/]+$", 0).alias("name"),
        universal_newlines(utf8_lossy(F.col("content"))).alias("text"),
    )
    if on_error == "report":
        listed = catalogue(spark, path, pattern, recursive).select("path")
        # the content has to be read to know; it stays where it is read
        read = raw.filter(F.octet_length("content") >= 0).select("path")
        unread = listed.join(read, "path", "left_anti")
        texts = texts.unionByName(
            unread.select("path", F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.lit(None).cast("string").alias("text"))
        )
    if on_empty == "empty" or catalogue(spark, path, pattern, recursive).limit(1).count():
        return texts
    if on_empty == "dummy":
        return spark.createDataFrame([("", "", DUMMY_TEXT)], texts.schema)
    raise EmptySource(f"no {pattern} under {path}")


def scan_code(spark: SparkSession, path: str, **options) -> DataFrame:
    return scan_files(spark, path, "*.py", **options)


def scan_books(spark: SparkSession, path: str, **options) -> DataFrame:
    return scan_files(spark, path, "*.txt", **options)


def scan_corpus(spark: SparkSession, path: str, on_empty: str = "raise") -> DataFrame:
    """Corpus text files, nested folders included, in path order."""
    return scan_files(spark, path, "*.txt", recursive=True, on_empty=on_empty).orderBy("path")


def lines_of(files: DataFrame) -> DataFrame:
    """``(name, line_no, line)``; the newline is not part of the line."""
    return files.select("name", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def scan_lines(spark: SparkSession, path: str, pattern: str = "*.txt", line_sep: str | None = None) -> DataFrame:
    """``(path, line_no, place, line)`` of text files, nested folders included: ``place`` numbers the lines of all files in path order.

    A large file is read in splits, as many tasks as it has. Only line counts of splits are added up: a line's number in
    its split is known where it is read, so lines are neither sorted nor moved. All kinds of newlines end a line unless
    ``line_sep`` is given; invalid bytes are dropped.
    """
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    raw = (reader.option("lineSep", line_sep) if line_sep else reader).text(path)
    lines = cut(
        raw.select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_id"),
            utf8_lossy(F.col("value").cast("binary")).alias("line"),
        ),
        "lines",
    )
    # the lines of a split have consecutive ids
    splits = lines.groupBy("path", "_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    placed = running(splits, [], ["path", "_split"], {"_ahead": ("sum", F.col("_lines"))})
    files = placed.groupBy("path").agg(F.min("_ahead").alias("_begin"))
    numbered = lines.join(placed, ["path", "_split"]).join(files, "path")
    at = F.col("_ahead") + F.col("_id") - F.col("_first")
    return numbered.select("path", (at - F.col("_begin")).alias("line_no"), at.alias("place"), "line")


def catalogue(spark: SparkSession, path: str, pattern: str = "*.pt", recursive: bool = False) -> DataFrame:
    """``(path, size_bytes, modified)`` of files; the content column is never read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    )


def write_corpus_text(pieces: DataFrame, path: str, order=("section", "copy", "place", "name"), partitions=None) -> None:
    """Corpus text in part files whose name order is the corpus order.

    ``piece`` ends with a newline, which the text writer adds itself.
    """
    ordered = pieces.repartitionByRange(partitions, *order) if partitions else pieces.repartitionByRange(*order)
    (
        ordered.sortWithinPartitions(*order)
        .select(F.regexp_replace("piece", r"\n\z", "").alias("value"))
        .write.option("lineSep", "\n")
        .text(path)
    )


def write_corpus_table(corpus: DataFrame, path: str) -> None:
    corpus.write.partitionBy("kind").parquet(path)


def read_corpus_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
