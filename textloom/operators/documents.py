"""Screening of source documents and corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx


def screen(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``reason``: null for usable documents, else why they are rejected."""
    return docs.withColumn("reason", tx.reject_reason(F.col(text)))


def usable(docs: DataFrame, text: str = "text") -> DataFrame:
    return screen(docs, text).filter("reason is null").drop("reason")


def rejected(docs: DataFrame, text: str = "text") -> DataFrame:
    return screen(docs, text).filter("reason is not null")


def intake_counts(screened: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Processed and skipped documents; needs ``reason`` from :func:`screen`."""
    return screened.groupBy(*by).agg(
        F.count_if(F.col("reason").isNull()).alias("processed"),
        F.count_if(F.col("reason").isNotNull()).alias("skipped"),
    )


def _totals(text: str):
    t = F.col(text)
    return [
        F.sum(tx.n_lines(t)).alias("lines"),
        F.sum(tx.n_words(t)).alias("words"),
        F.sum(F.length(t).cast("bigint")).alias("chars"),
    ]


def corpus_stats(docs: DataFrame, by: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Lines, words and characters; sums of per-document values, so partial sums do the work."""
    return docs.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), *_totals(text))


def intake_report(docs: DataFrame, by: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Intake counts and statistics of the kept documents in one pass over the text."""
    kept = F.col("reason").isNull()
    return (
        screen(docs, text)
        .groupBy(*by)
        .agg(
            F.count_if(kept).alias("processed"),
            F.count_if(~kept).alias("skipped"),
            F.sum(F.when(kept, tx.n_lines(F.col(text)))).alias("lines"),
            F.sum(F.when(kept, tx.n_words(F.col(text)))).alias("words"),
            F.sum(F.when(kept, F.length(text).cast("bigint"))).alias("chars"),
        )
    )
