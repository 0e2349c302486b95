"""Token and id tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.bpe import SPECIALS


def most_frequent(docs: DataFrame, size: int, tokens: str = "tokens") -> DataFrame:
    """``(token, id)`` of the ``size`` most frequent tokens; ids follow the special tokens."""
    top = (
        docs.select(F.explode(tokens).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(size)
    )
    # only the limited table is ranked
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token"))
    return top.select("token", (place + len(SPECIALS) - 1).alias("id"))


def lookup(tokens: DataFrame, vocab: DataFrame, unknown: int = 0) -> DataFrame:
    """Add ``id`` to ``token`` rows; Spark broadcasts a vocabulary that is small enough."""
    return tokens.join(vocab, "token", "left").withColumn(
        "id", F.coalesce("id", F.lit(unknown))
    )


def spelled(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``token`` to ``id`` rows."""
    return ids.join(vocab, "id", "left")
