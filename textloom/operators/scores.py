"""Pass rates, macro scores and run comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.matching import matches
from textloom.functions.numbers import percent_gain

# Which improved test stands for which baseline test, and which score is a mean of what.
METRIC_MAP = (
    ("bracket_test", "bracket_completion"),
    ("repeat_test", "keyword_completion"),
    ("alphabet_test", "indentation_awareness"),
    ("sentence_test", "function_completion"),
    ("perplexity", "code_perplexity"),
)
LOWER_IS_BETTER = ("perplexity",)


def judged(predictions: DataFrame, probes: DataFrame, key: Sequence[str] = ("probe_id",)) -> DataFrame:
    """Pair predictions with their probes and add ``passed``. An equi-join; the rule is a column.

    Probes are few per suite and the optimizer broadcasts them when their size allows.
    """
    return predictions.join(probes, list(key)).withColumn(
        "passed", matches(F.col("match_kind"), F.col("predicted"), F.col("acceptable"), F.col("prompt"))
    )


def every_run(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """Each run with each probe of the suite it is evaluated on: an equi-join on ``suite``."""
    return runs.join(probes, "suite")


def pass_rates(outcomes: DataFrame, by: Sequence[str] = ("run", "test"), passed: str = "passed") -> DataFrame:
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(passed)).alias("passed"),
        F.avg(F.col(passed).cast("double")).alias("score"),
    )


def pass_total(outcomes: DataFrame, by: Sequence[str] = (), passed: str = "passed") -> DataFrame:
    return (
        outcomes.groupBy(*by)
        .agg(F.count_if(F.col(passed)).alias("passed"), F.count(F.lit(1)).alias("total"))
        .withColumn("rate", F.try_divide("passed", "total"))
    )


def macro_scores(tests: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """``(by, test, category, score)`` to category means and their mean, none weighted by probe count."""
    categories = tests.groupBy(*by, "category").agg(F.avg("score").alias("category_score"))
    overall = categories.groupBy(*by).agg(F.avg("category_score").alias("overall_score"))
    return categories.join(overall, list(by))


def wide_scores(tests: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """One row per run: syntax, generation, perplexity and overall score."""
    per_category = tests.groupBy(*by).pivot("category", ["syntax", "generation", "perplexity"]).agg(F.avg("score"))
    named = per_category.select(
        *by, *[F.col(c).alias(f"{c}_score") for c in ("syntax", "generation", "perplexity")]
    )
    return named.withColumn(
        "overall_score", (F.col("syntax_score") + F.col("generation_score") + F.col("perplexity_score")) / 3
    )


def metric_map(spark) -> DataFrame:
    return spark.createDataFrame(METRIC_MAP, "baseline_metric string, improved_metric string")


def compared(baseline: DataFrame, improved: DataFrame, pairs: DataFrame, lower_is_better: Sequence[str] = LOWER_IS_BETTER) -> DataFrame:
    """Pair ``(metric, value)`` tables of two runs through ``pairs``; a missing side stays null.

    ``change`` is the difference in percentage points, or the percent gain for metrics
    that are better when lower.
    """
    left = pairs.join(
        baseline.select(F.col("metric").alias("baseline_metric"), F.col("value").alias("baseline_value")),
        "baseline_metric",
        "left",
    )
    both = left.join(
        improved.select(F.col("metric").alias("improved_metric"), F.col("value").alias("improved_value")),
        "improved_metric",
        "left",
    ).filter("baseline_value is not null or improved_value is not null")
    before, after = F.col("baseline_value"), F.col("improved_value")
    lower = F.col("baseline_metric").isin(*lower_is_better)
    return both.select(
        "baseline_metric",
        "improved_metric",
        "baseline_value",
        "improved_value",
        F.when(lower, percent_gain(before, after)).otherwise((after - before) * 100).alias("change"),
    )


def long_metrics(results: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("run",)) -> DataFrame:
    """Unpivot wide results to ``(by, metric, value)``."""
    return results.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(by), list(metrics), "metric", "value"
    )


def report(scores: DataFrame) -> DataFrame:
    """The comparison report: one row per run with clipped name, in step order."""
    return scores.select(
        F.substring("name", 1, 28).alias("name"),
        "step", "overall_score", "syntax_score", "generation_score", "average_perplexity",
    ).orderBy("step", "name")
