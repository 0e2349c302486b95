"""Next-token counts as a model: distributions, scores, greedy choice.

The table keeps the contract of a language model's logits, ``(context, token, logit)``;
the logits are smoothed log probabilities of n-gram counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import numbers as nm
from textloom.runtime import cut, salted_lookup

# Joins the tokens of a context of more than one token.
GLUE = "\x1f"
HOT_SHARE = 0.001
#: Places over which the rows of a hot context are dealt.
PLACES = 16


@dataclass(frozen=True)
class Model:
    """Counts of the next tokens of ``texts``. A table is written when it is first asked for."""

    texts: DataFrame
    order: int
    alpha: float
    tokens: str = "tokens"

    @cached_property
    def counts(self) -> DataFrame:
        """``(context, token, n)``."""
        return cut(pair_counts(self.texts, self.order, self.tokens), "ngram-counts")

    @cached_property
    def contexts(self) -> DataFrame:
        """``(context, total)``.

        With one-token contexts the table also has the tokens that only end a text, with a total of zero, and so lists
        the whole vocabulary, and ``used``, how often the token follows another one.
        """
        uses, sums = self.counts.select("context", "n"), [F.sum("n").alias("total")]
        if self.order == 2:
            none = F.lit(0).cast("bigint")
            ends = self.counts.select(F.col("token").alias("context"), none.alias("n"), F.col("n").alias("used"))
            uses, sums = uses.withColumn("used", none).unionByName(ends), [*sums, F.sum("used").alias("used")]
        return cut(uses.groupBy("context").agg(*sums), "ngram-contexts")

    @cached_property
    def words(self) -> DataFrame:
        """``(token, n)`` of the counted texts."""
        counted = self.texts.select(F.explode(F.when(F.size(self.tokens) >= self.order, F.col(self.tokens))).alias("token"))
        return cut(counted.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "ngram-words")

    @cached_property
    def _size(self):
        return self.contexts.agg(F.count(F.lit(1)).alias("types"), F.coalesce(F.sum("total"), F.lit(0)).alias("observed")).first()

    @cached_property
    def vocabulary(self) -> int:
        """How many tokens the counted texts have."""
        return self._size.types if self.order == 2 else self.words.count()

    @property
    def observed(self) -> int:
        return self._size.observed

    def pairs(self) -> DataFrame:
        """``(context, token, n, total)``: with the total, a seen pair needs one lookup only."""
        return salted_lookup(self.counts, self.totals(), ["context"], self.hot_contexts(), ["token"])

    def totals(self) -> DataFrame:
        return self.contexts.select("context", "total")

    def distribution(self, placed: bool = False) -> DataFrame:
        """``(context, token, logit)`` of the seen pairs, by one shuffle of them: rows of a context come together and are added up.

        Rows of hot contexts, whose totals are listed to every task, are dealt over ``PLACES`` by token. ``placed`` adds
        the ``place``: zero where all rows of the context are together.
        """
        hot = F.broadcast(_hot(self.totals(), "total", self.observed))
        place = F.when(F.col("total").isNotNull(), 1 + F.pmod(F.xxhash64("token"), F.lit(PLACES))).otherwise(F.lit(0).cast("bigint"))
        met = self.counts.join(hot, "context", "left").select("context", "token", "n", "total", place.alias("place"))
        summed = F.when(F.col("context").isNotNull(), F.sum("n").over(Window.partitionBy("context", "place")))
        logit = self.log_probability(F.col("n"), F.col("total")).alias("logit")
        dist = met.withColumn("total", F.coalesce("total", summed)).select("context", "token", logit, "place")
        return dist if placed else dist.drop("place")

    def log_probability(self, n: Column, total: Column, vocabulary: int | None = None) -> Column:
        size = self.vocabulary if vocabulary is None else vocabulary
        return F.log((F.coalesce(n, F.lit(0)) + self.alpha) / (F.coalesce(total, F.lit(0)) + self.alpha * size))

    def hot_contexts(self) -> DataFrame:
        return _hot(self.contexts, "total", self.observed).select("context")

    def hot_pairs(self) -> DataFrame:
        return _hot(self.counts, "n", self.observed).select("context", "token")


def _hot(counted: DataFrame, n: str, observed: int) -> DataFrame:
    """Keys with at least ``HOT_SHARE`` of all pairs: no more than ``1 / HOT_SHARE`` of them."""
    return counted.filter(F.col(n) >= HOT_SHARE * observed)


def transitions(
    docs: DataFrame, keep: Sequence[str] = (), order: int = 2, tokens: str = "tokens", among: Sequence[str] | None = None
) -> DataFrame:
    """One row ``(*keep, at, context, token)`` per token that has a full context before it, of tokens ``among`` these if given."""
    reach = order - 1
    last = F.size(tokens) - reach
    places = F.when(last >= 1, F.sequence(F.lit(1), last))
    at = F.col("at")
    context = F.get(tokens, at - 1) if order == 2 else F.array_join(F.slice(tokens, at, reach), GLUE)
    rows = docs.select(*keep, tokens, F.explode(places).alias("at"))
    for i in range(reach if among is not None else 0):
        rows = rows.filter(F.get(tokens, at - 1 + i).isin(among))
    return rows.select(
        *keep, "at", context.alias("context"), F.get(tokens, at + reach - 1).alias("token")
    )


def pair_counts(docs: DataFrame, order: int = 2, tokens: str = "tokens") -> DataFrame:
    """``(context, token, n)``; counted in each task before the shuffle."""
    rows = transitions(docs, (), order, tokens)
    return rows.groupBy("context", "token").agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, order: int = 2, alpha: float = 0.1, tokens: str = "tokens") -> Model:
    """Count n-grams. The vocabulary is every token of the counted texts."""
    return Model(docs, order, alpha, tokens)


def own_counts(model: Model, key: Sequence[str]) -> DataFrame:
    """``(*key, n, total)``, a row for each token of the model's own texts that has a context, by one shuffle of them.

    Rows of a context come together and are counted there. Contexts with at least ``HOT_SHARE`` of all rows, and pairs
    as frequent, consist of tokens as frequent, so they are counted before, in each task first: no more than
    ``1 / HOT_SHARE`` of each. Rows of such a context are dealt by token, rows of such a pair over 64 places.
    """
    least = HOT_SHARE * model.words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = [r.token for r in model.words.filter((F.col("n") >= least) & F.col("token").isNotNull()).collect()]
    rows = transitions(model.texts, key, model.order, model.tokens)
    likely = transitions(model.texts, (), model.order, model.tokens, among=often)
    known = likely.groupBy("context", F.when(F.col("token").isin(often), F.col("token")).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    known = cut(known, "ngram-hot")
    totals = known.groupBy("context").agg(F.sum("n").alias("_total")).filter(F.col("_total") >= least)
    pairs = known.filter((F.col("n") >= least) & F.col("token").isNotNull()).withColumnRenamed("n", "_n")

    met = rows.join(F.broadcast(totals), "context", "left").join(F.broadcast(pairs), ["context", "token"], "left")
    place = F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64(*key, "at"), F.lit(64)))
    place = place.when(F.col("_total").isNotNull(), F.xxhash64("token")).otherwise(F.lit(0).cast("bigint"))
    dealt = met.select(*key, "context", "token", "_n", "_total", place.alias("_place")).repartition("context", "_place")
    near = dealt.sortWithinPartitions("context", "_place", "token")
    total = F.count(F.lit(1)).over(Window.partitionBy("context", "_place"))
    n = F.count(F.lit(1)).over(Window.partitionBy("context", "_place", "token"))
    return near.select(*key, F.coalesce("_n", n).alias("n"), F.coalesce("_total", total).alias("total"))


#: Contexts that are listed to every task.
LISTED = 1_000_000


def _asked_of(asked: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The rows of ``tables`` with contexts of ``asked``, so that few texts do not shuffle a model; all rows for more than ``LISTED``."""
    contexts = asked.select("context").filter("context IS NOT NULL").distinct()
    if contexts.limit(LISTED + 1).count() > LISTED:
        return list(tables)
    return [table.join(F.broadcast(contexts), "context", "left_semi") for table in tables]


def text_loss(
    docs: DataFrame, model: Model, key: Sequence[str], tokens: str = "tokens", in_sample: bool = False
) -> DataFrame:
    """Mean negative log probability of the next tokens of each text; unseen pairs are smoothed.

    Lookups of the model are salted for the pairs and contexts that its counts show to be
    hot. ``in_sample`` says that the model was fitted on these very texts: every pair is
    known, so the totals come with the pairs and the lookup of contexts is left out. Given the same
    table, the texts are counted where they are scored, see :func:`own_counts`. Texts of fewer
    than two tokens (or fewer than ``order``) have no row.
    """
    if in_sample and tokens == model.tokens and docs.sameSemantics(model.texts):
        loss = -model.log_probability(F.col("n"), F.col("total"), model.words.count())
        return own_counts(model, key).groupBy(*key).agg(F.count(F.lit(1)).alias("targets"), F.avg(loss).alias("loss"))
    asked = transitions(docs, key, model.order, tokens)
    spread = [*key, "at"]
    if in_sample:
        known = salted_lookup(asked, model.pairs(), ["context", "token"], model.hot_pairs(), spread)
    else:
        counts, totals = _asked_of(asked, model.counts, model.totals())
        known = salted_lookup(asked, counts, ["context", "token"], model.hot_pairs(), spread)
        known = salted_lookup(known, totals, ["context"], model.hot_contexts(), spread)
    loss = -model.log_probability(F.col("n"), F.col("total"))
    return known.groupBy(*key).agg(F.count(F.lit(1)).alias("targets"), F.avg(loss).alias("loss"))


def text_perplexity(
    docs: DataFrame, model: Model, key: Sequence[str], tokens: str = "tokens", in_sample: bool = False
) -> DataFrame:
    scored = text_loss(docs, model, key, tokens, in_sample)
    return scored.withColumn("perplexity", nm.perplexity(F.col("loss"), capped=False))


def mean_perplexity(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Arithmetic mean of the texts' perplexities and its score; null when there are none."""
    return (
        scored.groupBy(*by)
        .agg(F.avg("perplexity").alias("average_perplexity"))
        .withColumn("score", nm.perplexity_score(F.col("average_perplexity")))
    )


def greedy(dist: DataFrame, by: Sequence[str] = ("context",), weight: str = "logit") -> DataFrame:
    """The best token of each context, the lowest one on ties. One aggregation, no sort."""
    return (
        dist.groupBy(*by)
        .agg(F.min(F.struct((-F.col(weight)).alias("cost"), "token")).alias("best"))
        .select(*by, F.col("best.token").alias("token"))
    )


def greedy_unigram(model: Model) -> str | None:
    """The most frequent next token overall, for contexts the model has not seen."""
    if model.order == 2:
        uses = model.contexts.filter("used > 0").select(F.col("context").alias("token"), F.col("used").alias("n"))
    else:
        uses = model.counts.groupBy("token").agg(F.sum("n").alias("n"))
    row = (
        uses.agg(F.min(F.struct((-F.col("n")).alias("cost"), "token")).alias("best"))
        .first()
    )
    return row.best.token if row.best else None
