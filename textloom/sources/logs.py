"""Reading and writing training logs and evaluation results (JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_FIELDS = "step bigint, loss double, perplexity double, lr double, val_loss double, val_perplexity double"
LOG_SCHEMA = "run string, " + LOG_FIELDS

_DETAIL = (
    "array<struct<prompt: string, expected: string, acceptable: array<string>, keywords: array<string>,"
    " predicted: string, completion: string, docstring: string, passed: boolean>>"
)
_TEST = f"struct<score: double, details: {_DETAIL}>"
SUITE_TESTS = (
    "bracket_completion",
    "keyword_completion",
    "indentation_awareness",
    "function_completion",
    "docstring_completion",
)
SUITE_SCHEMA = ", ".join(
    [f"{t} {_TEST}" for t in SUITE_TESTS]
    + [
        "code_perplexity struct<average_perplexity: double,"
        " samples: array<struct<sample: string, perplexity: double>>, score: double>",
        "summary struct<syntax_score: double, generation_score: double, perplexity_score: double,"
        " overall_score: double>",
        "checkpoint_info struct<path: string, name: string, step: int>",
    ]
)
BASELINE_SCHEMA = (
    "loss double, perplexity double, bracket_test int, repeat_test int, alphabet_test int,"
    " sentence_test int, sample_generation string"
)


def _run_of_path():
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_log_array(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """A log written as one JSON array of training and validation rows; absent keys are null."""
    rows = spark.read.schema(LOG_FIELDS).json(path, multiLine=True)
    return rows.select((F.lit(run) if run else _run_of_path()).alias("run"), "*")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """A log of JSON lines; a cut row is dropped, :func:`log_intake` counts it."""
    return drop_corrupt(_log_lines(spark, path))


def _log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(with_corrupt(LOG_SCHEMA)).json(path, mode="PERMISSIVE")


def log_intake(spark: SparkSession, path: str) -> DataFrame:
    """``(file, whole, cut)``: rows that :func:`read_log_lines` keeps and drops in each file."""
    whole = F.col("_corrupt_record").isNull() & F.col("step").isNotNull()
    lines = _log_lines(spark, path).select(F.input_file_name().alias("file"), "step", "_corrupt_record")
    return lines.groupBy("file").agg(F.count_if(whole).alias("whole"), F.count_if(~whole).alias("cut"))


def with_corrupt(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema).add("_corrupt_record", "string")


def drop_corrupt(rows: DataFrame) -> DataFrame:
    """Keep whole rows. Every log row has a step; naming it lets Spark count the rows, too."""
    return rows.filter(F.col("_corrupt_record").isNull() & F.col("step").isNotNull()).drop("_corrupt_record")


def append_log(log: DataFrame, path: str) -> None:
    """Add rows to a JSON-lines log; finished files appear at once, absent values are left out."""
    log.write.mode("append").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Flat results with ``run`` from the file name."""
    rows = spark.read.schema(BASELINE_SCHEMA).json(path, multiLine=True)
    return rows.select(_run_of_path().alias("run"), "*")


def read_suite_results(spark: SparkSession, path: str) -> DataFrame:
    """Nested results, one row per run."""
    rows = spark.read.schema(SUITE_SCHEMA).json(path, multiLine=True)
    return rows.select(_run_of_path().alias("run"), "*")


def suite_metrics(results: DataFrame) -> DataFrame:
    """Nested results as ``(run, metric, value)``."""
    pairs = [F.struct(F.lit(t).alias("metric"), F.col(f"{t}.score").alias("value")) for t in SUITE_TESTS]
    pairs.append(
        F.struct(F.lit("code_perplexity").alias("metric"), F.col("code_perplexity.average_perplexity").alias("value"))
    )
    return results.select("run", F.inline(F.array(*pairs))).filter("value is not null")


def suite_details(results: DataFrame) -> DataFrame:
    """Nested results as one row per probe."""
    tests = F.array(
        *[F.struct(F.lit(t).alias("test"), F.col(f"{t}.details").alias("details")) for t in SUITE_TESTS]
    )
    return results.select("run", F.inline(tests)).select("run", "test", F.inline("details"))


def write_results(results: DataFrame, path: str, by: str = "run") -> None:
    """One folder of JSON per run."""
    results.write.partitionBy(by).json(path)
