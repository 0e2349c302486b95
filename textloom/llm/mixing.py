"""Mixing sources to target weights by systematic sampling.

Every source gets a target share of all words, at most ``most_copies`` times what it has;
each of its documents is expected ``target / source size`` times. In an order by size the
expected copies are summed up from one random offset, the best of ``OFFSETS`` drawn ones, and a document is taken once for
each whole number its stretch of the sum crosses. The sum is a running sum over range
partitions, so a source of any size is spread over many tasks.

A null text has no words and a null source is a source of its own. Repeated rows are
documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import WORD, free_name, text_key
from textloom.runtime import cut, position, running

#: Offsets drawn for each source.
OFFSETS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float], most_copies: int) -> DataFrame:
    """``(source, source_size, target)`` of ``(source, source_size)``, one row per source.

    Weights repeat in the order of source names, null last. A source whose share passes its
    limit stops there and the rest is shared anew by weight: with the limit per weight in
    rising order, the sources that stop are a beginning of that order, so running sums of
    limits and weights tell each one's level without iteration.
    """
    placed = position(sizes, [], [F.col("source").isNull(), "source"], "_place").select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")).cast("double").alias("_weight"),
        (F.col("source_size") * most_copies).cast("double").alias("_limit"),
    )
    placed = cut(placed, "sources")
    total = placed.agg(F.sum("source_size").cast("double").alias("_total"), F.sum("_weight").alias("_weights"))
    ordered = running(
        placed,
        [],
        [F.col("_limit") / F.col("_weight"), F.col("source").isNull(), "source"],
        {"_limits": ("sum", F.col("_limit")), "_used": ("sum", F.col("_weight"))},
    )
    # one row; without sources there is none to join it to
    levels = ordered.join(F.broadcast(total), F.lit(True)).withColumn(
        "_level",
        (F.col("_total") - F.coalesce("_limits", F.lit(0.0))) / (F.col("_weights") - F.coalesce("_used", F.lit(0.0))),
    )
    stops = F.col("_limit") <= F.col("_level") * F.col("_weight")
    # the level of the sources that do not stop is that of the first of them; of equals it has the highest
    first = F.struct(F.col("_limit") / F.col("_weight"), (-F.col("_level")).alias("_below"))
    level = levels.filter(~stops).agg((-F.min(first)["_below"]).alias("_first"))
    return (
        levels.drop("_level")
        .join(F.broadcast(level), F.lit(True))
        .select(
            "source",
            "source_size",
            F.least("_limit", F.coalesce(F.col("_first") * F.col("_weight"), F.col("_limit"))).alias("target"),
        )
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    most_copies: int = 3,
    seed: int = 42,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """``key``, source and size of each document with ``source_size``, ``target`` and ``copies``.

    ``t1`` and ``t2`` are hashes of the text. No text passes a shuffle.
    """
    sized = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *text_key(F.col(text))
    )
    sized = cut(sized, "sizes")
    plan = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_copies), "targets")
    placed = position(
        sized, ["source"], ["size", F.xxhash64(F.lit(seed), "key"), "key", "t1"], "_place"
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # the table of sources is joined by size: Spark broadcasts it when it is small and splits a hot source when not
    plan = plan.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    placed = cut(placed.join(plan, same, "left").drop("_source").withColumn("rate", rate), "places")

    def copies(offset: Column) -> Column:
        """Whole numbers that a document's stretch of the sum crosses."""
        before, after = (F.floor((F.col("_place") + k) * F.col("rate") + offset) for k in (0, 1))
        return F.least(after - before, F.lit(most_copies)).cast("int")

    # one random offset a source: of OFFSETS drawn ones that which brings it nearest to its target
    drawn = [
        F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "source"), F.lit(1 << 40)) / F.lit(float(1 << 40)) for k in range(OFFSETS)
    ]
    taken = placed.groupBy("source", "target").agg(*[F.sum(copies(u) * F.col("size")).alias(f"_{k}") for k, u in enumerate(drawn)])
    nearest = F.least(*[F.struct(F.abs(F.col(f"_{k}") - F.col("target")).alias("far"), u.alias("offset")) for k, u in enumerate(drawn)])
    offsets = cut(taken.select(F.col("source").alias("_source"), nearest["offset"].alias("_offset")), "offsets")
    return (
        placed.join(offsets, same, "left")
        .withColumn("copies", copies(F.col("_offset")))
        .select("key", "source", "t1", "t2", "size", "source_size", "target", "copies")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: rows of ``docs`` with their columns, each as often as it is taken."""
    key, source, text = options.get("key", "doc_id"), options.get("source", "source"), options.get("text", "text")
    names = [free_name(docs, n) for n in ("_k", "_s", "_t1", "_t2", "_copies", "_rows", "_nth")]
    k, s, t1, t2, copies, rows, nth = names
    one, two = text_key(F.col(text))
    chosen = mix(docs, **options).select(
        F.col("key").alias(k), F.col("source").alias(s), F.col("t1").alias(t1), F.col("t2").alias(t2), "copies"
    )
    chosen = cut(
        chosen.groupBy(k, s, t1, t2).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)), "copies"
    )
    same = F.col(key).eqNullSafe(F.col(k)) & F.col(source).eqNullSafe(F.col(s)) & (one == F.col(t1)) & (two == F.col(t2))
    taken = docs.join(chosen.filter(F.col(copies) > 0), same, "inner")
    times = F.col(copies)
    if chosen.filter(F.col(rows) > 1).limit(1).count():
        # equal rows share their copies as evenly as whole numbers allow
        taken = taken.withColumn(nth, F.row_number().over(Window.partitionBy(k, s, t1, t2).orderBy(F.lit(1))))
        times = F.floor(times / F.col(rows)) + (F.col(nth) <= times % F.col(rows)).cast("int")
    return taken.withColumn(free_name(docs, "_each"), F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(
        *docs.columns
    )
