"""Metric logs as streams: newest record, best so far, interval means, improvements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators import runlog
from textloom.runtime import scratch_path
from textloom.sources.logs import LOG_SCHEMA, drop_corrupt, with_corrupt

# Fixed value: how often the log folder is looked at.
REFRESH = "10 seconds"


def log_stream(spark: SparkSession, folder: str, schema: str = LOG_SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    """Finished JSON-lines files of a growing log folder; cut rows are dropped."""
    reader = spark.readStream.schema(with_corrupt(schema)).option("mode", "PERMISSIVE")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return drop_corrupt(reader.json(folder))


def newest(log: DataFrame) -> DataFrame:
    """The newest record of each run, whatever order the files arrive in."""
    return runlog.newest(log)


def best_so_far(log: DataFrame) -> DataFrame:
    """Lowest validation loss of each run and its first step."""
    best = F.min(F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "step"))).alias("best")
    return log.groupBy("run").agg(best).filter("best is not null").select(
        "run", F.col("best.step").alias("step"), F.col("best.val_loss").alias("val_loss")
    )


def interval_means(log: DataFrame, interval: int = runlog.LOG_EVERY) -> DataFrame:
    """Streaming form of the interval means: the state is one sum per run and interval."""
    return runlog.interval_means(log, interval)


def improvements(log: DataFrame) -> DataFrame:
    """An event for each new best validation loss: ``(run, step, val_loss, late)``.

    A row that comes after rows of later steps is passed on as it is, marked ``late``: whether it was the
    best of its time is known no more, but it counts for the rows that follow. No row is lost.
    """

    def better(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, best = state.get if state.exists else (-1, float("inf"))
        rows = pd.concat(list(batches)).sort_values("step")
        late, rows = rows[rows["step"] <= last], rows[rows["step"] > last]
        best = float(min(best, late["val_loss"].min())) if len(late) else best
        before = rows["val_loss"].cummin().shift(1).fillna(float("inf")).clip(upper=best)
        events = rows[rows["val_loss"] < before]
        if len(rows):
            last, best = int(rows["step"].iloc[-1]), float(min(best, rows["val_loss"].min()))
        state.update((last, best))
        for part, is_late in ((late, True), (events, False)):
            yield pd.DataFrame({"run": key[0], "step": part["step"], "val_loss": part["val_loss"], "late": is_late})

    return (
        log.filter("val_loss is not null")
        .select("run", "step", "val_loss")
        .groupBy("run")
        .applyInPandasWithState(
            better,
            "run string, step bigint, val_loss double, late boolean",
            "last bigint, best double",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


def to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return its result as a written table.

    In complete mode the last batch holds the whole result; in append mode all batches do.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, "stream")
    saved: list[int] = []

    def save(batch: DataFrame, batch_id: int) -> None:
        saved.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", scratch_path(spark, "stream-progress"))
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()
    if not saved:
        return spark.createDataFrame([], stream.schema)
    with_batch = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    table = spark.read.schema(with_batch).parquet(out)
    if mode == "complete":
        table = table.filter(F.col("batch") == saved[-1])
    return table.drop("batch")


def follow(log: DataFrame, path: str, checkpoint: str, every: str = REFRESH):
    """Keep the newest record of each run in ``path`` up to date; returns the running query.

    Each batch is a version of its own, which :func:`current` finds once it is whole.
    """
    return (
        newest(log)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/version={number}"))
        .start()
    )


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version of a followed table; None before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "version=*/_SUCCESS")) or []
    versions = [int(f.getPath().getParent().getName().split("=")[1]) for f in done]
    return spark.read.parquet(f"{path}/version={max(versions)}") if versions else None
