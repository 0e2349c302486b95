"""Pre-token and symbol-pair counts, the inputs of tokenizer training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx


def word_counts(docs: DataFrame, scheme: str = "byte", normalise: bool = True, text: str = "text") -> DataFrame:
    """``(word, n)`` over all texts. Counts are combined per task before the shuffle."""
    source = tx.nfkc(F.col(text)) if normalise else F.col(text)
    return (
        docs.select(F.explode(tx.pretokens(source, scheme)).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def symbols(words: DataFrame, scheme: str) -> DataFrame:
    """Add ``signs``: the word as the characters the merges work on."""
    return words.withColumn(
        "signs", tx.bytes_to_signs(F.col("word")) if scheme == "byte" else F.col("word")
    )


PIECE = 512


def sign_pairs(words: DataFrame, signs: str) -> DataFrame:
    """``(pair, n)`` rows: neighbouring characters as two-character strings.

    Long words are first cut into pieces that overlap by one character, since finding the
    n-th character of a string takes time proportional to n.
    """
    last = F.floor((F.length("_s") - 2) / PIECE).cast("int")
    starts = F.when(F.length("_s") >= 2, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return (
        words.select(F.col(signs).alias("_s"), "n")
        .select("_s", "n", F.explode(starts).alias("_k"))
        .select(F.substring("_s", F.col("_k") * PIECE + 1, F.lit(PIECE + 1)).alias("_s"), "n")
        .select("_s", "n", F.explode(F.sequence(F.lit(1), F.length("_s") - 1)).alias("_i"))
        .select(F.substring("_s", F.col("_i"), F.lit(2)).alias("pair"), "n")
    )


def pair_counts(signed: DataFrame, min_frequency: int = 2) -> DataFrame:
    """``(left, right, n)`` for neighbouring characters, weighted by word count."""
    pairs = sign_pairs(signed, "signs").groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.filter(F.col("n") >= min_frequency).select(
        F.substring("pair", 1, 1).alias("left"), F.substring("pair", 2, 1).alias("right"), "n"
    )
