"""Connected components over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import cut, remove_path, scratch_path


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)``: the smallest node of the component of every node that has an edge.

    Large-star and small-star rounds: each node links its larger neighbours, then itself and
    its smaller ones, to the least of them, until every component is a star. Edges stay at most as
    many as they were, each round ends in a written table, and minima are taken map-side, so a
    hub is no single task's burden. Rounds grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now, path = _kept(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = _kept(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        small, small_path = _kept(small.distinct())
        same = _digest(small) == _digest(now)
        for old in (path, large_path):
            remove_path(spark, old)
        now, path = small, small_path
        if same:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return cut(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components")


def _kept(df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, "edges")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _digest(df: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
