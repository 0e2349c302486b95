"""Catalogue of checkpoint files: steps, order, latest ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import stem, step_of_name


def described(files: DataFrame) -> DataFrame:
    """``(path, size_bytes, modified)`` with ``name``, ``step`` and ``size_mb``."""
    name = stem(F.col("path"))
    return files.select(
        "path",
        name.alias("name"),
        step_of_name(name).alias("step"),
        (F.col("size_bytes") / F.lit(1024.0 * 1024.0)).alias("size_mb"),
        "modified",
    )


def by_step(artifacts: DataFrame) -> DataFrame:
    return artifacts.orderBy("step", "name")


def newest(artifacts: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` newest artifacts, each with the number of artifacts not shown.

    Two small aggregations: a top-n, and a count.
    """
    total = artifacts.agg(F.count(F.lit(1))).scalar()
    return (
        artifacts.orderBy(F.desc("modified"), "name")
        .limit(n)
        .withColumn("more", F.greatest(total - n, F.lit(0)))
    )


def latest_best(artifacts: DataFrame) -> DataFrame:
    """The ``best_step_*`` artifact of the highest step, or the newest one when there is none."""
    is_best = F.col("name").startswith("best_step_")
    step = F.element_at(F.split("name", "_"), -1).try_cast("int")
    return (
        artifacts.withColumn("_best", is_best)
        .orderBy(F.desc("_best"), F.when(F.col("_best"), step).desc_nulls_last(), F.desc("modified"), "name")
        .limit(1)
        .drop("_best")
    )
