"""Filtering of next-token distributions and reproducible draws from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.numbers import clean_logit, draw
from textloom.operators.ngram import greedy
from textloom.runtime import cut, running

MASKED = -1e10
MIN_TEMPERATURE = 1e-8
DRAW_CELLS = 32


def softmax(dist: DataFrame, by: str = "context", logit: str = "logit", out: str = "probability", place: str | None = None) -> DataFrame:
    """Probabilities per context. Peak and mass are aggregates, so a large context is no single task.

    ``place`` names a column that is zero where a context's rows are to be together, and deals those of a large context
    over places above zero. Then peaks and masses are taken place by place, where the rows lie, and those of
    large contexts, which must be few enough to be listed, are put together from their places.
    """
    if place is not None:
        return _placed_softmax(dist, by, logit, out, place)
    peaks = dist.groupBy(by).agg(F.max(logit).alias("_peak"))
    with_peak = dist.join(peaks, by).withColumn("_mass", F.exp(F.col(logit) - F.col("_peak")))
    masses = with_peak.groupBy(by).agg(F.sum("_mass").alias("_total"))
    return with_peak.join(masses, by).withColumn(out, F.col("_mass") / F.col("_total")).drop(
        "_peak", "_mass", "_total"
    )


def _placed_softmax(dist: DataFrame, by: str, logit: str, out: str, place: str) -> DataFrame:
    here = Window.partitionBy(by, place)
    local = dist.filter(F.col(by).isNotNull()).withColumn("_peak", F.max(logit).over(here))
    local = local.withColumn("_mass", F.sum(F.exp(F.col(logit) - F.col("_peak"))).over(here))
    parts = local.filter(F.col(place) > 0).groupBy(by, place).agg(F.first("_peak").alias("_peak"), F.first("_mass").alias("_mass"))
    tops = parts.withColumn("_top", F.max("_peak").over(Window.partitionBy(by)))
    whole = tops.groupBy(by).agg(
        F.first("_top").alias("_top"), F.sum(F.col("_mass") * F.exp(F.col("_peak") - F.col("_top"))).alias("_whole")
    )
    met = local.join(F.broadcast(whole), by, "left")
    share = F.exp(F.col(logit) - F.coalesce("_top", "_peak")) / F.coalesce("_whole", "_mass")
    return met.select(by, *[c for c in dist.columns if c not in (by, out)], share.alias(out))


def keep_top_k(dist: DataFrame, k: int, by: str = "context", logit: str = "logit") -> DataFrame:
    """The ``k`` best tokens per context and everything tied with the last of them.

    Spark filters by rank in each task before the shuffle (window group limit), so a hot
    context arrives with few rows.
    """
    if k <= 0:
        return dist
    ranked = dist.withColumn("_rank", F.rank().over(Window.partitionBy(by).orderBy(F.desc(logit))))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def mask_below_top_k(dist: DataFrame, k: int, by: str = "context", logit: str = "logit") -> DataFrame:
    """Like :func:`keep_top_k`, but the other tokens stay with a vanishing logit."""
    if k <= 0:
        return dist
    edges = keep_top_k(dist.select(by, logit), k, by, logit).groupBy(by).agg(F.min(logit).alias("_edge"))
    return dist.join(edges, by).withColumn(
        logit, F.when(F.col(logit) < F.col("_edge"), F.lit(MASKED)).otherwise(F.col(logit))
    ).drop("_edge")


def cumulative(dist: DataFrame, by: str = "context", probability: str = "probability") -> DataFrame:
    """Add ``before``, ``upto`` and ``place``: mass ahead of each token, mass with it, its rank.

    Tokens go from likely to unlikely, by token on ties; see :func:`textloom.runtime.running`
    for contexts of any size.
    """
    scanned = running(
        dist,
        [by],
        [F.desc(probability), F.asc("token")],
        {"before": ("sum", F.col(probability)), "place": ("sum", F.lit(1))},
    )
    return scanned.withColumn("upto", F.col("before") + F.col(probability))


def keep_top_p(
    dist: DataFrame, p: float, nucleus: str = "standard", by: str = "context", logit: str = "logit"
) -> DataFrame:
    """Nucleus filter: new ``probability`` and the stretch ``low`` to ``high`` of [0, 1).

    ``standard`` keeps the token that crosses ``p``. ``strict`` drops it, and spreads
    the mass evenly over the whole context when nothing is left; it masks tokens rather
    than removing them, see :func:`mask_below_top_k`. The kept tokens are the first ones
    in order, so their stretches follow from the sums already made.
    """
    probability, before = F.col("probability"), F.col("before")
    scanned = cumulative(softmax(dist, by, logit), by)
    if p >= 1.0:
        return scanned.select(by, "token", "probability", before.alias("low"), F.col("upto").alias("high"))
    if nucleus == "standard":
        kept = scanned.filter((before < p) | (before == 0))
        masses = kept.groupBy(by).agg(F.sum("probability").alias("_left"))
        even, left = F.lit(False), probability
    elif nucleus == "strict":
        kept = scanned
        left = F.when(F.col("upto") > p, 0.0).otherwise(probability)
        masses = scanned.groupBy(by).agg(F.sum(left).alias("_left"), F.count(F.lit(1)).alias("_size"))
        even = F.col("_left") == 0
    else:
        raise ValueError(f"unknown nucleus rule {nucleus!r}")
    share = 1.0 / F.col("_size") if nucleus == "strict" else F.lit(None).cast("double")
    return kept.join(masses, by).select(
        by,
        "token",
        F.when(even, share).otherwise(left / F.col("_left")).alias("probability"),
        F.when(even, F.col("place") * share).otherwise(before / F.col("_left")).alias("low"),
        F.when(even, (F.col("place") + 1) * share).otherwise((before + left) / F.col("_left")).alias("high"),
    )


def next_token_distribution(
    dist: DataFrame,
    temperature: float = 1.0,
    top_k: int = 50,
    top_p: float = 1.0,
    nucleus: str = "standard",
    by: str = "context",
) -> DataFrame:
    """``(by, token, probability, low, high)`` after cleaning, temperature, top-k and top-p."""
    cleaned = dist.withColumn("logit", clean_logit(F.col("logit")))
    if temperature == 0:
        sure = {"probability": F.lit(1.0), "low": F.lit(0.0), "high": F.lit(1.0)}
        return greedy(cleaned, [by]).withColumns(sure)
    scaled = cleaned.withColumn("logit", F.col("logit") / max(temperature, MIN_TEMPERATURE))
    limit = keep_top_k if nucleus == "standard" or top_p >= 1.0 else mask_below_top_k
    # the limited table is used several times below
    limited = cut(limit(scaled, top_k, by), "limited")
    shaped = keep_top_p(limited, top_p, nucleus, by)
    return shaped.filter("probability > 0")


def intervals(shaped: DataFrame, by: str = "context") -> DataFrame:
    """``(by, token, low, high, cell)``: the stretch of [0, 1) each token owns.

    The stretch is repeated for every cell of a fixed grid it meets, which turns the
    search for a draw into an equi-join on (context, cell).
    """
    # rounding may leave the last stretch short of 1, so the last token takes the rest
    lasts = shaped.groupBy(by).agg(F.max(F.struct("low", "token")).alias("_last"))
    low, high = F.col("low"), F.col("high")
    return (
        shaped.join(lasts, by)
        .select(
            by,
            "token",
            "low",
            F.when(F.col("token") == F.col("_last.token"), 1.0).otherwise(high).alias("high"),
        )
        .filter(low < high)
        .withColumn(
            "cell",
            F.explode(
                F.sequence(
                    F.least(F.floor(low * DRAW_CELLS), F.lit(DRAW_CELLS - 1)),
                    F.least(F.floor(high * DRAW_CELLS), F.lit(DRAW_CELLS - 1)),
                )
            ),
        )
    )


def sample(asked: DataFrame, stretches: DataFrame, u: Column, by: str = "context") -> DataFrame:
    """Add the drawn ``token`` for each row of ``asked``; null for an unknown context."""
    placed = asked.withColumn("_u", u).withColumn("cell", F.floor(F.col("_u") * DRAW_CELLS))
    right = stretches.withColumnRenamed(by, "_by").withColumnRenamed("cell", "_cell")
    hit = (
        (F.col(by) == F.col("_by"))
        & (F.col("cell") == F.col("_cell"))
        & (F.col("_u") >= F.col("low"))
        & (F.col("_u") < F.col("high"))
    )
    return placed.join(right, hit, "left").drop("_u", "cell", "_by", "_cell", "low", "high")


def sample_next(
    asked: DataFrame, dist: DataFrame, key: str, seed: int = 0, **shape
) -> DataFrame:
    """One drawn token per row of ``asked(key, context)``; the draw depends on seed and key only."""
    stretches = intervals(cut(next_token_distribution(dist, **shape), "shaped"))
    return sample(asked, stretches, draw(seed, F.col(key)))
