"""The test tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.numbers import perplexity, scheduled_lr
from textloom.runtime import position

# Parameters of the queries over run logs: the tables hold short runs.
WARMUP, TOTAL, BASE_LR = 10, 60, 1e-4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str, key: str, *columns: str) -> DataFrame:
    """A text table with at least one partition per core; a large one is left as it is."""
    df = table(spark, folder, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    wanted = columns or ("doc_id", "text", "lang", "source")
    return texts(spark, folder, "documents", "doc_id", *wanted)


def _is_code(source):
    return F.regexp_extract(source, r"\d+", 0).cast("int") < 10


def code_and_books(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents as ``(name, text)``: sources 0 to 9 stand for code, the others for books."""
    docs = documents(spark, folder, "doc_id", "source", "text")
    name = F.format_string("%s/%09d", F.col("source"), F.col("doc_id")).alias("name")
    code = _is_code(F.col("source"))
    return docs.filter(code).select(name, "text"), docs.filter(~code).select(name, "text")


#: Users with more than this share of all events are numbered over several tasks; there are at most 1 / share of them.
LARGE_SHARE = 0.02


def numbered(events: DataFrame, share: float = LARGE_SHARE) -> DataFrame:
    """Add ``step`` (from 1), the place in the run of the user: a window for most users, range partitions for large ones."""
    most = share * events.count()
    large = [r.user_id for r in events.groupBy("user_id").count().filter((F.col("count") > most) & F.col("user_id").isNotNull()).collect()]
    in_run = Window.partitionBy("user_id").orderBy("ts", "event_id")
    is_large = F.col("user_id").isin(large)
    small = events.filter(~is_large | F.col("user_id").isNull()).withColumn("step", F.row_number().over(in_run).cast("bigint"))
    if not large:
        return small
    placed = position(events.filter(is_large), ["user_id"], ["ts", "event_id"], "step")
    return small.unionByName(placed.withColumn("step", F.col("step") + 1))


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their place ``step`` (from 1) in the run of their user."""
    return numbered(table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value"))


def log_columns() -> list:
    """A training-log row from an event: purchases validate, the rest train."""
    value = F.col("value")
    is_val = F.col("event_type") == "purchase"
    off = F.when(F.col("event_type") == "error", value / F.lit(1000.0)).otherwise(0.0)
    lr = scheduled_lr(F.col("step"), BASE_LR, WARMUP, TOTAL) * (1.0 + off)
    return [
        F.col("user_id").cast("string").alias("run"),
        "step",
        F.when(~is_val, value).alias("loss"),
        F.when(~is_val, perplexity(value)).alias("perplexity"),
        F.when(~is_val, lr).alias("lr"),
        F.when(is_val, value).alias("val_loss"),
        F.when(is_val, perplexity(value)).alias("val_perplexity"),
    ]


def training_log(spark: SparkSession, folder: str) -> DataFrame:
    return steps(spark, folder).select(*log_columns())


LOG_SQL = """
  log AS (
    SELECT run, step,
      CASE WHEN NOT is_val THEN value END AS loss,
      CASE WHEN NOT is_val THEN exp(least(value, 20.0::DOUBLE)) END AS perplexity,
      CASE WHEN NOT is_val THEN
        1e-4::DOUBLE * (CASE WHEN step < 10 THEN step / 10.0::DOUBLE
          ELSE 0.1::DOUBLE + 0.9::DOUBLE * (0.5::DOUBLE * (1.0::DOUBLE + cos(pi() * ((step - 10) / 50.0::DOUBLE)))) END)
        * (1.0::DOUBLE + CASE WHEN event_type = 'error' THEN value / 1000.0::DOUBLE ELSE 0.0::DOUBLE END) END AS lr,
      CASE WHEN is_val THEN value END AS val_loss,
      CASE WHEN is_val THEN exp(least(value, 20.0::DOUBLE)) END AS val_perplexity
    FROM (
      SELECT CAST(user_id AS VARCHAR) AS run, event_type, value, event_type = 'purchase' AS is_val,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step
      FROM events))
"""
