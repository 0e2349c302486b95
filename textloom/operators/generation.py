"""Greedy and sampled continuation of prompts with a next-token model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.numbers import draw
from textloom.operators import ngram
from textloom.operators.sampling import intervals, next_token_distribution, sample
from textloom.runtime import cut

CUT_EVERY = 4


def last_context(tokens: Column, order: int = 2) -> Column:
    """The context that predicts what follows a token list; null when it is too short."""
    reach = order - 1
    tail = F.slice(tokens, F.greatest(F.size(tokens) - reach + 1, F.lit(1)), reach)
    return F.when(F.size(tokens) >= reach, F.array_join(tail, ngram.GLUE))


def next_context(context: Column, token: Column, order: int = 2) -> Column:
    if order == 2:
        return token
    kept = F.substring_index(context, ngram.GLUE, -(order - 2))
    return F.concat(kept, F.lit(ngram.GLUE), token)


def _reachable(step: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The rows of ``step`` that paths from ``asked(context)`` come to within ``length`` tokens.

    Greedy paths soon run into each other and into a ring, so a few rounds find all of them; a round joins the
    contexts that are new in it, each once.
    """
    known = frontier = cut(step.join(asked.filter("context IS NOT NULL").distinct(), "context", "left_semi"), "paths")
    for _ in range(length - 1):
        ahead = frontier.select(F.col("reached").alias("context")).distinct().join(known.select("context"), "context", "left_anti")
        frontier = cut(step.join(ahead, "context", "left_semi"), "paths")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return cut(known, "paths")


def greedy_paths(model: ngram.Model, length: int, fallback: bool = True, asked: DataFrame | None = None) -> DataFrame:
    """``(context, path)``: the greedy continuation of ``length`` tokens from each context, or of ``asked(context)``.

    With ``asked`` only the contexts that its paths reach are looked at.

    Greedy choice makes the contexts a function table, so paths are doubled: a path of
    2k tokens is a path of k tokens followed by the path from where it ends. That takes
    log2(length) joins over the contexts instead of ``length`` joins over the prompts.
    A token without a known successor is followed by the most frequent token when
    ``fallback`` is set (one-token contexts only); otherwise the path ends there.
    """
    best = ngram.greedy(model.counts, weight="n")
    step = best.select(
        "context",
        F.array("token").alias("path"),
        next_context(F.col("context"), F.col("token"), model.order).alias("reached"),
    )
    if fallback and model.order == 2:
        # tokens that only ever end a text have no successor of their own
        common = ngram.greedy_unigram(model)
        ends = model.contexts.filter("total = 0")
        step = step.unionByName(
            ends.select("context", F.array(F.lit(common)).alias("path"), F.lit(common).alias("reached"))
        )
    step = cut(step, "paths")
    if asked is not None:
        step = _reachable(step, asked, length)
    result, doubled, left = None, step, length
    while left:
        if left & 1:
            result = doubled if result is None else _then(result, doubled)
        left >>= 1
        if left:
            doubled = cut(_then(doubled, doubled), "paths")
    if result is None:
        return step.select("context", F.slice("path", 1, 0).alias("path"))
    return result.select("context", "path")


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """Append to each path the path from where it ends.

    Many paths may end in one context. The join key that is hot on the left meets one row
    on the right, and adaptive execution may split it.
    """
    after = second.select(
        F.col("context").alias("reached"), F.col("path").alias("_more"), F.col("reached").alias("_end")
    )
    return first.join(after, "reached", "left").select(
        "context",
        F.when(F.col("_more").isNull(), F.col("path")).otherwise(F.concat("path", "_more")).alias("path"),
        F.coalesce("_end", "reached").alias("reached"),
    )


def stop_at_token(path: Column, hit) -> Column:
    """Cut a path after the first token for which ``hit`` holds."""
    found = F.filter(F.sequence(F.lit(1), F.size(path)), lambda i: hit(F.get(path, i - 1)))
    return F.when(F.size(path) == 0, path).otherwise(
        F.slice(path, 1, F.coalesce(F.get(found, F.lit(0)), F.size(path)))
    )


def stop_at_text(path: Column, hit, glue: str = "") -> Column:
    """Cut a path at the first length for which the text so far satisfies ``hit``."""
    found = F.filter(
        F.sequence(F.lit(1), F.size(path)), lambda i: hit(F.array_join(F.slice(path, 1, i), glue))
    )
    return F.when(F.size(path) == 0, path).otherwise(
        F.slice(path, 1, F.coalesce(F.get(found, F.lit(0)), F.size(path)))
    )


def _code_block_ended(text: Column) -> Column:
    later = F.substring(text, 6, F.length(text))
    return (F.length(text) > 5) & (
        F.contains(text, F.lit("\n\n")) | F.contains(later, F.lit("def ")) | F.contains(later, F.lit("class "))
    )


def stopped(path: Column, kind: Column | str, glue: str = "") -> Column:
    """Apply a stop rule: ``none``, ``newline``, ``docstring`` or ``block``."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return (
        F.when(kind == "newline", stop_at_token(path, lambda t: F.contains(t, F.lit("\n"))))
        .when(kind == "docstring", stop_at_text(path, lambda t: F.contains(t, F.lit('"""')), glue))
        .when(kind == "block", stop_at_text(path, _code_block_ended, glue))
        .otherwise(path)
    )


def continue_greedily(
    prompts: DataFrame, model: ngram.Model, max_tokens: int = 50, stop: str = "none", tokens: str = "tokens"
) -> DataFrame:
    """Add ``new_tokens`` to each prompt; prompt and new tokens stay apart."""
    asked = prompts.withColumn("context", last_context(F.col(tokens), model.order))
    common = ngram.greedy_unigram(model)
    starts = asked.select("context")
    if common is not None and model.order == 2:
        starts = starts.unionByName(starts.sparkSession.createDataFrame([(common,)], "context string"))
    paths = cut(greedy_paths(model, max_tokens, asked=starts), "paths")
    # an unseen prompt end takes the most frequent token, then follows that token's path:
    # one row of at most max_tokens tokens, which becomes a constant
    start = paths.filter(F.col("context") == F.lit(common)).first()
    first_tokens = [common, *start.path][:max_tokens] if start and model.order == 2 else []
    constant = F.array(*[F.lit(t) for t in first_tokens]).cast("array<string>")
    path = F.coalesce("path", constant)
    joined = asked.join(paths, "context", "left")
    return joined.withColumn("new_tokens", stopped(path, stop)).drop("path", "context")


def continue_sampled(
    prompts: DataFrame,
    model: ngram.Model,
    key: str,
    max_tokens: int = 50,
    temperature: float = 0.8,
    top_k: int = 50,
    top_p: float = 0.95,
    nucleus: str = "standard",
    seed: int = 0,
    tokens: str = "tokens",
) -> DataFrame:
    """Add ``new_tokens`` drawn one at a time; the draw depends on seed, key and step.

    Only ``(key, context, new_tokens)`` goes through the loop. A prompt whose context has
    no successor ends there. The lineage is cut every few rounds.
    """
    shaped = cut(next_token_distribution(model.distribution(), temperature, top_k, top_p, nucleus), "shaped")
    stretches = cut(intervals(shaped), "stretches")
    state = prompts.select(
        key,
        last_context(F.col(tokens), model.order).alias("context"),
        F.array().cast("array<string>").alias("new_tokens"),
    )
    for step in range(max_tokens):
        drawn = sample(state, stretches, draw(seed, F.col(key), F.lit(step)))
        state = drawn.select(
            key,
            F.when(F.col("token").isNotNull(), next_context(F.col("context"), F.col("token"), model.order)).alias("context"),
            F.when(F.col("token").isNull(), F.col("new_tokens"))
            .otherwise(F.concat("new_tokens", F.array("token")))
            .alias("new_tokens"),
        )
        if (step + 1) % CUT_EVERY == 0:
            state = cut(state, "continued")
    return prompts.join(state.select(key, "new_tokens"), key)
