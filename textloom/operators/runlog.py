"""Analytics on training logs: one row per logged step of a run.

A log has ``run, step, loss, perplexity, lr, val_loss, val_perplexity``; a training row
has ``loss``, a validation row ``val_loss``, and absent values are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import numbers as nm
from textloom.runtime import running

# Planned steps, hours per 10000 steps, warm-up, base rate, and intervals.
TOTAL_STEPS = 20000
HOURS_PER_10K = 2.0
WARMUP_STEPS = 500
BASE_LR = 1e-4
LOG_EVERY, EVAL_EVERY, CHECKPOINT_EVERY = 20, 500, 2000


def training_rows(log: DataFrame) -> DataFrame:
    return log.filter("loss is not null")


def validation_rows(log: DataFrame) -> DataFrame:
    return log.filter("val_loss is not null")


def every(log: DataFrame, interval: int) -> DataFrame:
    """Rows of the steps at which something periodic happens."""
    return log.filter(F.col("step") % interval == 0)


def first_steps(log: DataFrame, limit: int, step: str = "step") -> DataFrame:
    return log.filter(F.col(step) < limit)


def interval_means(steps: DataFrame, interval: int = LOG_EVERY, loss: str = "loss") -> DataFrame:
    """Mean loss of each complete run of ``interval`` steps, labelled with its last step."""
    block = F.floor((F.col("step") - 1) / interval)
    return (
        steps.groupBy("run", block.alias("_block"))
        .agg(F.max("step").alias("step"), F.avg(loss).alias("loss"), F.count(loss).alias("_n"))
        .filter(F.col("_n") == interval)
        .select("run", "step", "loss", nm.perplexity(F.col("loss")).alias("perplexity"))
    )


def improvements(log: DataFrame, order: Sequence[str] = ("step",)) -> DataFrame:
    """Validation rows strictly better than all earlier ones of their run."""
    scanned = running(validation_rows(log), ["run"], list(order), {"best_before": ("min", F.col("val_loss"))})
    return scanned.filter(F.col("best_before").isNull() | (F.col("val_loss") < F.col("best_before")))


def validation_mean(batches: DataFrame, max_batches: int = 50, order: Sequence[str] = ("batch_no",)) -> DataFrame:
    """Mean loss of the first batches per run and its perplexity; no row for a run without any.

    The rank filter is applied in each task before the shuffle (window group limit).
    """
    place = F.row_number().over(Window.partitionBy("run").orderBy(*order))
    return (
        batches.withColumn("_place", place)
        .filter(F.col("_place") <= max_batches)
        .groupBy("run")
        .agg(F.count("loss").alias("batches"), F.avg("loss").alias("val_loss"))
        .withColumn("val_perplexity", nm.perplexity(F.col("val_loss")))
    )


def newest(log: DataFrame) -> DataFrame:
    """The newest record of each run; a validation row comes after the training row of its step."""
    at = F.struct("step", F.col("val_loss").isNotNull().alias("is_val"))
    rest = [c for c in log.columns if c != "run"]
    return log.groupBy("run").agg(F.max_by(F.struct(*rest), at).alias("r")).select("run", "r.*")


def summary(log: DataFrame) -> DataFrame:
    """Initial, current and best values per run in one aggregation.

    With a single training row there is no improvement, with a single validation row no best.
    """
    train, val = F.col("loss").isNotNull(), F.col("val_loss").isNotNull()
    point = F.struct("step", "loss", "perplexity")
    v_point = F.struct("step", "val_loss", "val_perplexity")
    at = F.col("step")
    agg = log.groupBy("run").agg(
        F.count_if(train).alias("n_train"),
        F.min_by(point, F.when(train, at)).alias("first"),
        F.max_by(point, F.when(train, at)).alias("last"),
        F.count_if(val).alias("n_val"),
        F.max_by(v_point, F.when(val, at)).alias("v_last"),
        F.min_by(v_point, F.when(val, F.struct("val_loss", "step"))).alias("v_best"),
    )
    several = F.col("n_val") > 1
    return agg.select(
        "run",
        F.col("last.step").alias("steps_completed"),
        F.col("first.loss").alias("initial_loss"),
        F.col("last.loss").alias("current_loss"),
        F.col("first.perplexity").alias("initial_perplexity"),
        F.col("last.perplexity").alias("current_perplexity"),
        F.when(F.col("n_train") > 1, F.col("first.loss") - F.col("last.loss")).alias("loss_improvement"),
        F.col("v_last.val_loss").alias("latest_val_loss"),
        F.col("v_last.val_perplexity").alias("latest_val_perplexity"),
        F.when(several, F.col("v_best.val_loss")).alias("best_val_loss"),
        F.when(several, F.col("v_best.step")).alias("best_val_step"),
    )


def lr_audit(
    log: DataFrame,
    base: float = BASE_LR,
    warmup: int = WARMUP_STEPS,
    total: int = TOTAL_STEPS,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Rows whose logged rate differs from the schedule, with the expected rate."""
    return (
        log.filter("lr is not null")
        .withColumn("expected_lr", nm.scheduled_lr(F.col("step"), base, warmup, total))
        .filter(F.abs(F.col("lr") - F.col("expected_lr")) > tolerance)
    )


def progress(
    log: DataFrame,
    total: int = TOTAL_STEPS,
    hours_per_10k: float = HOURS_PER_10K,
    is_running: Column | None = None,
) -> DataFrame:
    """Percent done, hours left, state and improvement of each run.

    A run is ``complete`` from the planned number of steps on; else ``running`` or ``stopped``.
    """
    going = F.lit(False) if is_running is None else is_running
    train = F.col("loss").isNotNull()
    gains = log.groupBy("run").agg(
        (F.min_by("loss", F.when(train, F.col("step"))) - F.max_by("loss", F.when(train, F.col("step")))).alias(
            "improvement"
        ),
        F.max_by(
            F.struct("step", "loss", "perplexity", "val_loss", "val_perplexity"),
            F.struct("step", F.col("val_loss").isNotNull().alias("is_val")),
        ).alias("r"),
    )
    step = F.col("r.step")
    return gains.select(
        "run",
        "r.*",
        F.coalesce("improvement", F.lit(0.0)).alias("improvement"),
        (step / F.lit(float(total)) * 100).alias("percent"),
        F.when(step > 0, (F.lit(total) - step) / F.lit(10000.0) * hours_per_10k).alias("hours_left"),
        F.when(going, "running").when(step >= total, "complete").when(step > 0, "stopped").otherwise("none").alias("state"),
    )
