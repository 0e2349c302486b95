"""Whole distributions against a dictionary of all tokens."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import ngram, whole

ALPHA = 0.1


def texts(seed=5):
    rnd = random.Random(seed)
    return [[rnd.choice("aaaabbbccdefghijklm") for _ in range(rnd.randint(0, 9))] for _ in range(40)] + [["z"], ["a"] * 6]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(t,) for t in texts()], "tokens array<string>")
    return ngram.fit(docs, alpha=ALPHA)


def brute(context, temperature, top_k, top_p, nucleus):
    """Tokens in order with their probabilities, from all tokens of the vocabulary."""
    pairs = [p for t in texts() for p in zip(t, t[1:])]
    tokens = sorted({t for p in pairs for t in p})
    n = {t: pairs.count((context, t)) for t in tokens}
    ranked = sorted(tokens, key=lambda t: (-n[t], t))
    if top_k and n[ranked[min(top_k, len(ranked)) - 1]]:
        edge = n[ranked[min(top_k, len(ranked)) - 1]]
        ranked = [t for t in ranked if n[t] >= edge]
    w = {t: ((n[t] + ALPHA) / (n[ranked[0]] + ALPHA)) ** (1 / temperature) for t in ranked}
    z, before, kept = math.fsum(w.values()), 0.0, []
    for k, t in enumerate(ranked):
        if top_p >= 1 or (before / z < top_p or k == 0 if nucleus == "standard" else (before + w[t]) / z <= top_p):
            kept.append(t)
        before += w[t]
    if not kept:
        return dict.fromkeys(tokens, 1 / len(tokens))
    mass = math.fsum(w[t] for t in kept)
    return {t: w[t] / mass for t in kept}


RULES = [(1.0, 0, 1.0, "standard"), (0.8, 4, 1.0, "standard"), (0.7, 50, 0.83, "standard"), (1.3, 3, 0.55, "strict"), (1.0, 0, 0.2, "strict"), (1.0, 0, 0.01, "strict")]


@pytest.mark.parametrize("rule", RULES)
def test_kept_tokens_and_draws(spark, model, rule):
    fitted = whole.fit_whole(model, *rule)
    vocabulary = [r.token for r in fitted.vocabulary.orderBy("place").collect()]
    shapes = {r.context: r for r in fitted.shapes.collect()}
    points = [(c, (k + 0.5) / 997) for c in ("a", "b", "m", "unheard", None) for k in range(997)]
    asked = spark.createDataFrame(points, "context string, x double")
    drawn = whole.sample(asked, fitted, F.col("x")).collect()
    assert len(drawn) == len(points)
    for context in ("a", "b", "m", "unheard", None):
        want = brute(context, *rule)
        row = shapes.get(context)
        if row is not None:
            given = dict(zip(row.tokens, row.each))
            rest = [t for t in vocabulary if row.even or t not in {v for v in vocabulary if vocabulary.index(v) in (row.seen or [])}]
            given |= {t: row.each_unseen for t in rest[: row.spread]}
            assert given == pytest.approx(want)
        # tokens own stretches in this order
        edges, at = [], 0.0
        for t, p in want.items():
            edges.append((at, at + p, t))
            at += p
        for r in (r for r in drawn if r.context == context):
            assert [t for lo, hi, t in edges if lo <= r.x < hi] == [r.token], (context, r.x)


def test_listed_masses_are_whole(model):
    for rule in RULES:
        sums = whole.listed(whole.fit_whole(model, *rule)).groupBy("context").agg(F.sum(F.col("probability") * F.col("tokens")).alias("s"))
        assert all(r.s == pytest.approx(1.0) for r in sums.collect())


def test_longer_contexts_and_no_counts(spark):
    docs = spark.createDataFrame([(list("abcabd"),)], "tokens array<string>")
    fitted = whole.fit_whole(ngram.fit(docs, order=3, alpha=ALPHA), top_k=0)
    asked = spark.createDataFrame([("a\x1fb", 0.01), ("q\x1fq", 0.99)], "context string, x double")
    assert sorted(r.token for r in whole.sample(asked, fitted, F.col("x")).collect()) == ["c", "d"]
    empty = whole.fit_whole(ngram.fit(docs.limit(0), alpha=ALPHA))
    assert [r.token for r in whole.sample(asked, empty, F.col("x")).collect()] == [None, None]
    with pytest.raises(ValueError, match="nucleus"):
        whole.fit_whole(ngram.fit(docs, alpha=ALPHA), nucleus="other")


def test_continuations_go_on_after_unknown_words(spark, model):
    prompts = spark.createDataFrame([("p", ["unheard"]), ("q", ["a", "b"]), ("r", [])], "key string, tokens array<string>")
    fitted = whole.fit_whole(model)
    first, again = ({r.key: r.new_tokens for r in whole.continue_sampled(prompts, fitted, "key", 6, seed=3).collect()} for _ in range(2))
    assert first == again and all(len(v) == 6 and None not in v for v in first.values())


def test_a_draw_shuffles_the_shapes_of_its_contexts_only(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [f"w{i}", f"w{i + 1}", "x"]) for i in range(300)], "doc_id int, tokens array<string>")
    fitted = whole.fit_whole(ngram.fit(docs), 0.8, 50, 0.9)
    asked = spark.createDataFrame([(k, f"w{k}") for k in range(3)] + [(3, None), (4, "never")], "k int, context string")
    needed = whole._asked_shapes(asked, fitted.shapes)
    assert {r.context for r in needed.collect()} == {"w0", "w1", "w2"}
    few = {r.k: r.token for r in whole.sample_next(asked, fitted, "k", 5).collect()}
    monkeypatch.setattr(whole, "LISTED", 2)
    assert few == {r.k: r.token for r in whole.sample_next(asked, fitted, "k", 5).collect()} and len(few) == 5


@pytest.mark.parametrize("rule", RULES)
def test_a_list_needs_no_places(spark, model, rule):
    drawn, plain = whole.fit_whole(model, *rule), whole.fit_whole(model, *rule, draws=False)
    assert plain.vocabulary is None and "seen" not in plain.shapes.columns
    assert sorted(map(tuple, whole.listed(plain).collect()), key=str) == sorted(map(tuple, whole.listed(drawn).collect()), key=str)
    assert "Join" not in plain.shapes._jdf.queryExecution().executedPlan().toString()
