"""Next-token distributions over the whole vocabulary, and draws from them.

A count model gives every token it has not seen after a context the same small mass. That
residual is one row of a context, a number of tokens and their mass, not a row a token. A context is
one row, ``shape``: its kept tokens from likely to unlikely, where each begins in [0, 1), and where
the residual begins. A draw finds its context by one join and its token by halving the row; a
draw that meets the residual takes a place among the unseen tokens, which are in the order of
the vocabulary, and finds the token by that place.

A context without counts has the residual alone: all tokens are equally likely. The row of a context holds the
tokens that top-k keeps, the ones tied with the last of them included, never more than the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.numbers import draw
from textloom.operators.generation import last_context, next_context
from textloom.operators.ngram import HOT_SHARE, GLUE, Model
from textloom.operators.sampling import MIN_TEMPERATURE, keep_top_k
from textloom.runtime import cut, position, salted_lookup


@dataclass(frozen=True)
class Whole:
    """``shapes``, one row a context, and ``vocabulary(token, place)``; both written tables, if it is for draws.

    ``alone`` is the number of tokens that a context without counts draws from.
    """

    shapes: DataFrame
    vocabulary: DataFrame | None
    alone: int
    order: int


def vocabulary(model: Model) -> DataFrame:
    """``token, place``: every token of the counted texts, in order."""
    if model.order == 2:
        tokens = model.contexts.select(F.col("context").alias("token"))
    else:
        parts = model.contexts.select(F.explode(F.split("context", GLUE)).alias("token"))
        tokens = parts.union(model.counts.select("token")).distinct()
    return cut(position(tokens, [], ["token"], "place"), "vocabulary")


def nucleus_alone(tokens: int, top_p: float, nucleus: str) -> int:
    """Of so many equally likely tokens, how many the nucleus keeps."""
    if top_p >= 1.0 or not tokens:
        return tokens
    import math

    each = 1.0 / tokens
    kept = math.ceil(top_p / each) if nucleus == "standard" else math.floor(top_p / each)
    return min(tokens, kept) or tokens


def shapes(
    model: Model,
    tokens: DataFrame | None,
    temperature: float = 1.0,
    top_k: int = 50,
    top_p: float = 1.0,
    nucleus: str = "standard",
) -> DataFrame:
    """One row a context: ``tokens``, ``low`` (where each begins), ``each`` (its probability), ``rest`` (where the
    residual begins), ``spread`` (tokens the residual stands for), ``even`` (it stands for all, not for the unseen
    ones) and ``seen`` (places of the seen tokens, where the residual needs them). Only draws look at places: without
    ``tokens``, the vocabulary, there is no ``seen``.

    Top-k keeps ties, so unseen tokens stay where fewer than ``top_k`` are seen. ``strict`` drops the token that
    crosses ``top_p`` and spreads the mass evenly over the vocabulary when nothing is left.
    """
    if nucleus not in ("standard", "strict"):
        raise ValueError(f"unknown nucleus rule {nucleus!r}")
    size, heat = float(model.vocabulary), 1.0 / max(temperature, MIN_TEMPERATURE)
    placed, places = keep_top_k(model.counts.filter("context IS NOT NULL"), top_k, logit="n"), []
    if tokens is not None:
        hot = model.counts.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        share = HOT_SHARE * max(1, model.observed)
        placed = salted_lookup(placed, tokens, ["token"], hot.filter(F.col("n") >= share), ["context"])
        places = [F.array_sort(F.collect_list(F.col("place").cast("int"))).alias("_places")]

    # one shuffle by context; windows and lists use it
    order = Window.partitionBy("context").orderBy(F.desc("n"), "token")
    weight = F.exp(F.log((F.col("n") + model.alpha) / (F.first("n").over(order) + model.alpha)) * heat)
    weighed = placed.withColumn("_w", weight).withColumn("_i", F.row_number().over(order))
    summed = weighed.withColumn(
        "_before", F.coalesce(F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    )
    rows = summed.groupBy("context").agg(
        F.array_sort(F.collect_list(F.struct("_i", "token", "_w", "_before"))).alias("_rows"),
        F.sum("_w").alias("_mass"),
        F.max("n").alias("_most"),
        *places,
    )

    # a context with fewer than top_k rows has kept all it has seen
    kept_all = F.lit(top_k <= 0) | (F.size("_rows") < top_k)
    left = F.when(kept_all, size - F.size("_rows")).otherwise(0.0)
    unseen = F.exp(F.log(model.alpha / (F.col("_most") + model.alpha)) * heat)
    rows = rows.withColumn("_left", left).withColumn("_u", unseen).withColumn("_z", F.col("_mass") + F.col("_left") * F.col("_u"))
    z, p = F.col("_z"), top_p
    room = (p - F.col("_mass") / z) / (F.col("_u") / z)
    if top_p >= 1.0:
        kept, spread = F.size("_rows"), F.col("_left")
    elif nucleus == "standard":
        kept = F.size(F.filter("_rows", lambda r: (r["_before"] / z < p) | (r["_i"] == 1)))
        spread = F.least("_left", F.greatest(F.lit(0.0), F.ceil(room).cast("double")))
    else:
        kept = F.size(F.filter("_rows", lambda r: (r["_before"] + r["_w"]) / z <= p))
        spread = F.least("_left", F.greatest(F.lit(0.0), F.floor(room).cast("double")))
    rows = rows.withColumn("_kept", kept).withColumn("_spread", spread)
    rows = rows.withColumn("even", (F.col("_kept") == 0) & (F.col("_spread") == 0))
    prefix = F.when(F.col("_kept") < F.size("_rows"), F.get(F.col("_rows._before"), F.col("_kept"))).otherwise(F.col("_mass"))
    rows = rows.withColumn("_prefix", prefix).withColumn("_total", F.col("_prefix") + F.col("_spread") * F.col("_u"))
    first = F.slice("_rows", F.lit(1), F.col("_kept"))
    return rows.select(
        "context",
        F.transform(first, lambda r: r["token"]).alias("tokens"),
        F.transform(first, lambda r: r["_before"] / F.col("_total")).alias("low"),
        F.transform(first, lambda r: r["_w"] / F.col("_total")).alias("each"),
        F.when(F.col("even"), 0.0).when(F.col("_spread") > 0, F.col("_prefix") / F.col("_total")).otherwise(1.0).alias("rest"),
        F.when(F.col("even"), size).otherwise(F.col("_spread")).cast("long").alias("spread"),
        F.when(F.col("even"), 1.0 / max(size, 1.0)).when(F.col("_spread") > 0, F.col("_u") / F.col("_total")).alias("each_unseen"),
        "even",
        *[F.when((F.col("_spread") > 0) & ~F.col("even"), F.col("_places")).alias("seen") for _ in places],
    )


def fit_whole(
    model: Model, temperature: float = 1.0, top_k: int = 50, top_p: float = 1.0, nucleus: str = "standard", draws: bool = True
) -> Whole:
    """The shapes of all contexts; see :func:`shapes`. Without ``draws`` they can be listed, and no token gets a place."""
    tokens = vocabulary(model) if draws else None
    shaped = shapes(model, tokens, temperature, top_k, top_p, nucleus)
    # a list reads them once
    return Whole(cut(shaped, "shapes") if draws else shaped, tokens, nucleus_alone(model.vocabulary, top_p, nucleus), model.order)


def listed(whole: Whole) -> DataFrame:
    """``context, token, probability, tokens``: a row a kept token, and one with null for those of the residual."""
    rows = F.transform(F.arrays_zip("tokens", "each"), lambda r: F.struct(r["tokens"].alias("token"), r["each"].alias("probability"), F.lit(1).cast("long").alias("tokens")))
    rest = F.struct(F.lit(None).cast("string").alias("token"), F.col("each_unseen").alias("probability"), F.col("spread").alias("tokens"))
    both = F.concat(rows, F.when(F.col("spread") > 0, F.array(rest)).otherwise(F.slice(F.array(rest), 1, 0)))
    return whole.shapes.select("context", F.explode(both).alias("r")).select("context", "r.*")


def _halved(size: Column, beyond) -> Column:
    """The first index for which ``beyond(index)`` holds, ``size`` if none; it holds for all after one that does."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(size + 1.0)).cast("int"))

    def half(s, _):
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        on = (s["lo"] < s["hi"]) & ~beyond(middle)
        return F.struct(F.when(on, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(on | (s["lo"] >= s["hi"]), s["hi"]).otherwise(middle).alias("hi"))

    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), size.cast("int").alias("hi")), half, lambda s: s["lo"])


#: Contexts of a step that are listed to every task.
LISTED = 1_000_000


def _asked_shapes(asked: DataFrame, shapes: DataFrame) -> DataFrame:
    """The shapes of the contexts of ``asked``, found without a shuffle of all shapes; all of them for more than ``LISTED``."""
    contexts = asked.select("context").filter("context IS NOT NULL").distinct()
    if contexts.limit(LISTED + 1).count() > LISTED:
        return shapes
    return shapes.join(F.broadcast(contexts), "context", "left_semi")


def sample(asked: DataFrame, whole: Whole, u: Column) -> DataFrame:
    """Add the drawn ``token`` to each row of ``asked(…, context)``; null only where the vocabulary is empty."""
    met = asked.withColumn("_x", u).join(_asked_shapes(asked, whole.shapes), "context", "left")
    unknown = F.col("even").isNull()
    rest, spread = F.coalesce("rest", F.lit(0.0)), F.coalesce("spread", F.lit(whole.alone))
    x = F.col("_x")
    index = _halved(F.size("low"), lambda i: F.get("low", i) > x) - 1
    among = F.least(F.floor((x - rest) / (1.0 - rest) * spread), spread - 1)
    met = met.withColumn("_among", F.when(unknown | (x >= rest) & (spread > 0), among))
    ahead = _halved(F.size("seen"), lambda i: F.get("seen", i) - i > F.col("_among"))
    place = F.when(F.col("seen").isNull(), F.col("_among")).otherwise(F.col("_among") + ahead)
    found = met.select(
        *asked.columns, F.when(F.col("_among").isNull(), F.get("tokens", index)).alias("_known"), place.cast("long").alias("_place")
    )
    tokens = whole.vocabulary.select(F.col("token").alias("_unseen"), F.col("place").alias("_place"))
    return found.join(tokens, "_place", "left").select(*asked.columns, F.coalesce("_known", "_unseen").alias("token"))


def sample_next(asked: DataFrame, whole: Whole, key: str, seed: int = 0) -> DataFrame:
    """One drawn token per row of ``asked(key, context)``; the draw depends on seed and key only."""
    return sample(asked, whole, draw(seed, F.col(key)))


def continue_sampled(prompts: DataFrame, whole: Whole, key: str, max_tokens: int = 50, seed: int = 0, tokens: str = "tokens") -> DataFrame:
    """Add ``new_tokens``, drawn one at a time; the draw depends on seed, key and step.

    Only ``(key, context, new_tokens)`` goes through the loop. Each step is written, as the next one lists its contexts first.
    """
    state = prompts.select(
        key, last_context(F.col(tokens), whole.order).alias("context"), F.array().cast("array<string>").alias("new_tokens")
    )
    state = cut(state, "continued")
    for step in range(max_tokens):
        drawn = sample(state, whole, draw(seed, F.col(key), F.lit(step)))
        state = drawn.select(
            key,
            next_context(F.col("context"), F.col("token"), whole.order).alias("context"),
            F.concat("new_tokens", F.array("token")).alias("new_tokens"),
        )
        state = cut(state, "continued")
    return prompts.join(state.select(key, "new_tokens"), key)
