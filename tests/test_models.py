import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import generation, ngram, sampling, suites

DIST = "context string, token string, logit double"


def shaped(spark, rows, **options):
    out = sampling.next_token_distribution(spark.createDataFrame(rows, DIST), **options)
    return {(r.context, r.token): r.probability for r in out.collect()}


def test_ties_at_rank_k_are_kept(spark):
    rows = [("c", "a", 3.0), ("c", "b", 2.0), ("c", "d", 2.0), ("c", "e", 1.0)]
    assert set(shaped(spark, rows, top_k=2)) == {("c", "a"), ("c", "b"), ("c", "d")}
    assert len(shaped(spark, rows, top_k=0)) == 4 and len(shaped(spark, rows, top_k=99)) == 4


def test_confident_context(spark):
    rows = [("c", "a", 10.0), ("c", "b", 0.0), ("c", "d", 0.0), ("c", "e", -1.0)]
    assert shaped(spark, rows, top_p=0.9) == {("c", "a"): 1.0}
    strict = shaped(spark, rows, top_k=2, top_p=0.9, nucleus="strict")
    assert strict == {("c", t): 0.25 for t in "abde"}


def test_cumulative_equal_to_p_is_kept(spark):
    half = math.log(0.5)
    rows = [("c", "a", half), ("c", "b", math.log(0.25)), ("c", "d", math.log(0.25))]
    assert shaped(spark, rows, top_p=0.5, nucleus="strict") == {("c", "a"): 1.0}
    assert shaped(spark, rows, top_p=0.5) == {("c", "a"): 1.0}
    assert set(shaped(spark, rows, top_p=0.6)) == {("c", "a"), ("c", "b")}


def test_unclean_logits_and_zero_temperature(spark):
    rows = [("c", "a", float("nan")), ("c", "b", float("-inf")), ("c", "d", -1.0)]
    assert shaped(spark, rows, temperature=0) == {("c", "a"): 1.0}
    assert shaped(spark, rows + [("c", "e", float("inf"))])[("c", "e")] == 1.0


@pytest.mark.parametrize("nucleus", ["standard", "strict"])
@pytest.mark.parametrize("top_k, top_p", [(0, 1.0), (3, 1.0), (0, 0.7), (5, 0.5), (2, 0.2)])
def test_probabilities_and_stretches_sum_to_one(spark, nucleus, top_k, top_p):
    rows = [(f"c{c}", f"t{t}", float((c * t) % 7)) for c in range(6) for t in range(9)]
    out = sampling.next_token_distribution(spark.createDataFrame(rows, DIST), 0.8, top_k, top_p, nucleus)
    by = {}
    for r in out.collect():
        by.setdefault(r.context, []).append(r)
    assert len(by) == 6
    for members in by.values():
        assert sum(r.probability for r in members) == pytest.approx(1.0)
        members.sort(key=lambda r: r.low)
        assert members[0].low == 0 and members[-1].high == pytest.approx(1.0)
        for a, b in zip(members, members[1:]):
            assert a.high == pytest.approx(b.low)
        for r in members:
            assert r.high - r.low == pytest.approx(r.probability)


def test_draws_follow_the_distribution(spark):
    rows = [("c", "a", math.log(0.6)), ("c", "b", math.log(0.3)), ("c", "d", math.log(0.1)), ("x", "only", 0.0)]
    asked = spark.range(3000).select("id", F.when(F.col("id") < 2990, "c").when(F.col("id") < 2995, "x").otherwise("?").alias("context"))
    got = sampling.sample_next(asked, spark.createDataFrame(rows, DIST), "id", seed=3).collect()
    assert len(got) == 3000
    n = Counter(r.token for r in got)
    assert n["only"] == 5 and n[None] == 5
    assert abs(n["a"] / 2990 - 0.6) < 0.03 and abs(n["d"] / 2990 - 0.1) < 0.02
    again = sampling.sample_next(asked.repartition(3), spark.createDataFrame(rows, DIST), "id", seed=3).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def docs_of(spark, *texts):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "doc_id int, tokens array<string>")


TEXTS = ("a b a b c", "a b d", "x", "", "b a")


def brute_loss(tokens, texts, order, alpha):
    pairs, totals, types = Counter(), Counter(), set()
    for t in (t.split() for t in texts):
        if len(t) >= order:
            types |= set(t)
        for i in range(len(t) - order + 1):
            c = tuple(t[i : i + order - 1])
            pairs[c, t[i + order - 1]] += 1
            totals[c] += 1
    losses = []
    for i in range(len(tokens) - order + 1):
        c = tuple(tokens[i : i + order - 1])
        losses.append(-math.log((pairs[c, tokens[i + order - 1]] + alpha) / (totals[c] + alpha * len(types))))
    return sum(losses) / len(losses) if losses else None


@pytest.mark.parametrize("order", [2, 3])
def test_loss_of_seen_and_unseen_texts(spark, order):
    model = ngram.fit(docs_of(spark, *TEXTS), order, 0.1)
    asked = TEXTS + ("a zzz b", "q r s t", "b c a a")
    got = {r.doc_id: r.loss for r in ngram.text_loss(docs_of(spark, *asked), model, ["doc_id"]).collect()}
    want = {i: brute_loss(t.split(), TEXTS, order, 0.1) for i, t in enumerate(asked)}
    assert got == pytest.approx({i: v for i, v in want.items() if v is not None})
    inside = {r.doc_id: r.loss for r in ngram.text_loss(docs_of(spark, *TEXTS), model, ["doc_id"], in_sample=True).collect()}
    assert inside == pytest.approx({i: got[i] for i in inside}) and len(inside) == sum(len(t.split()) >= order for t in TEXTS)


def test_no_texts_no_perplexity(spark):
    model = ngram.fit(docs_of(spark, *TEXTS))
    scored = ngram.text_perplexity(docs_of(spark, "", "one"), model, ["doc_id"])
    row = ngram.mean_perplexity(scored).first()
    assert row.average_perplexity is None and row.score is None


def test_greedy_ties_take_the_lowest_token(spark):
    rows = [("c", "b", 1.0), ("c", "a", 1.0), ("c", "z", 0.5)]
    assert ngram.greedy(spark.createDataFrame(rows, DIST)).first().token == "a"


def brute_greedy(texts, prompt, n):
    pairs, tokens = {}, Counter()
    for t in (t.split() for t in texts):
        for a, b in zip(t, t[1:]):
            pairs.setdefault(a, Counter())[b] += 1
            tokens[b] += 1
    best = lambda c: min(c, key=lambda k: (-c[k], k))
    out, at = [], prompt.split()[-1]
    for _ in range(n):
        at = best(pairs[at]) if at in pairs else best(tokens)
        out.append(at)
    return out


@pytest.mark.parametrize("n", [0, 1, 5, 12])
def test_greedy_continuation(spark, n):
    model = ngram.fit(docs_of(spark, *TEXTS))
    prompts = docs_of(spark, "a", "x y c", "d", "unknown", "b")
    got = {r.doc_id: r.new_tokens for r in generation.continue_greedily(prompts, model, n).collect()}
    assert got == {i: brute_greedy(TEXTS, p, n) for i, p in enumerate(["a", "x y c", "d", "unknown", "b"])}


def test_greedy_continuation_with_longer_contexts(spark):
    model = ngram.fit(docs_of(spark, "a b c d e", "z b q"), 3)
    prompts = docs_of(spark, "a b", "c d", "nothing known", "a")
    got = {r.doc_id: r.new_tokens for r in generation.continue_greedily(prompts, model, 5).collect()}
    assert got == {0: ["c", "d", "e"], 1: ["e"], 2: [], 3: []}


def test_stop_rules(spark):
    def cut(kind, *tokens):
        df = spark.createDataFrame([(list(tokens),)], "p array<string>")
        return df.select(generation.stopped(F.col("p"), kind)).first()[0]

    assert cut("newline", "a", " b\n", "c") == ["a", " b\n"]
    assert cut("docstring", "a", '"', '""', "b") == ["a", '"', '""']
    assert cut("block", "ab", "\n\n", "cdef", "x") == ["ab", "\n\n", "cdef"]
    assert cut("block", "def ", "f(x)", " def ", "y") == ["def ", "f(x)", " def "]
    assert cut("none", "a", "\n") == ["a", "\n"] and cut("newline") == []


def test_sampled_continuation_is_reproducible_and_possible(spark):
    model = ngram.fit(docs_of(spark, *TEXTS))
    prompts = docs_of(spark, "a", "b", "unknown", "d")
    run = lambda: {r.doc_id: r.new_tokens for r in generation.continue_sampled(prompts, model, "doc_id", 6, seed=2).collect()}
    first = run()
    assert first == run() and first[2] == [] and first[3] == []
    seen = {(a, b) for t in TEXTS for a, b in zip(t.split(), t.split()[1:])}
    for start, out in (("a", first[0]), ("b", first[1])):
        assert out and all(p in seen for p in zip([start] + out, out))


def test_suites(spark):
    probes = suites.probes(spark)
    assert {r.suite: r["count"] for r in probes.groupBy("suite").count().collect()} == {"micro": 4, "prompt": 19, "code": 5}
    texts = ["( ) def add", "import torch os", "hello hello hello"]
    model = ngram.fit(spark.createDataFrame([(t.split(),) for t in texts], "tokens array<string>"))
    judged = suites.evaluate(probes, model, "word")
    by = {(r.suite, r.probe_id): (r.predicted, r.passed) for r in judged.collect()}
    assert by["micro", 0] == (")", True) and by["micro", 1] == ("hello", True)
    assert by["prompt", 3] == (")", True) and by["prompt", 6] == ("torch", True)
    strict = judged.filter("test = 'function_completion'").filter("passed").count()
    loose = suites.evaluate(suites.probes(spark, compat=True), model, "word").filter("test = 'function_completion'").filter("passed").count()
    assert loose >= 2 >= strict
    table = suites.compare_runs(spark, {"ok": model, "bad": ValueError("no weights")})
    rows = {r.run: r for r in table.collect()}
    assert rows["bad"].error == "no weights" and rows["bad"].overall_score is None
    assert 0 <= rows["ok"].overall_score <= 1


def test_greedy_paths_look_at_reached_contexts_only(spark):
    docs = spark.createDataFrame([(list("abcabcabd"),), (list("xyzxyz"),), (["q", "a"],)], "tokens array<string>")
    model = ngram.fit(docs)
    asked = spark.createDataFrame([("q",), ("q",), ("nowhere",), (None,)], "context string")
    every = {r.context: r.path for r in generation.greedy_paths(model, 9).collect()}
    got = {r.context: r.path for r in generation.greedy_paths(model, 9, asked=asked).collect()}
    assert got == {c: every[c] for c in "qabc"} and set("xyz") < set(every)


def test_most_frequent_token_comes_from_the_contexts(spark):
    model = ngram.fit(docs_of(spark, "a b a c", "c b", "d"))
    assert {r.context: r.used for r in model.contexts.collect()} == {"a": 1, "b": 2, "c": 1}
    vars(model)["counts"] = None
    assert ngram.greedy_unigram(model) == "b"


def test_few_texts_look_at_their_own_contexts(spark):
    model = ngram.fit(docs_of(spark, *TEXTS))
    asked = ngram.transitions(docs_of(spark, "b zz b"), ["doc_id"])
    counts, totals = ngram._asked_of(asked, model.counts, model.totals())
    assert {tuple(r) for r in counts.collect()} == {("b", "a", 2), ("b", "c", 1), ("b", "d", 1)}
    assert [tuple(r) for r in totals.collect()] == [("b", 4)]


@pytest.mark.parametrize("order", [2, 3])
def test_texts_are_counted_where_they_are_scored(spark, order):
    import random

    rnd = random.Random(order)
    # frequent pairs, a frequent context with rare tokens, many rare tokens, texts too short, copies
    texts = [" ".join(rnd.choice(["a b", "a", "of", f"w{rnd.randint(0, 1500)}"]) for _ in range(rnd.randint(0, 40))) for _ in range(120)]
    texts += ["a b " * 30, "a b", "x", "", texts[0]]
    docs = docs_of(spark, *texts)
    model = ngram.fit(docs, order)
    got = {r.doc_id: (r.targets, r.loss) for r in ngram.text_loss(docs, model, ["doc_id"], in_sample=True).collect()}
    assert not {"counts", "contexts"} & set(vars(model))
    want = {i: brute_loss(t.split(), texts, order, 0.1) for i, t in enumerate(texts)}
    assert set(got) == {i for i, v in want.items() if v is not None}
    for i, (targets, loss) in got.items():
        assert targets == len(texts[i].split()) - order + 1 and loss == pytest.approx(want[i])


@pytest.mark.parametrize("share", [0.05, 2.0])
def test_placed_softmax_equals_that_of_whole_contexts(spark, monkeypatch, share):
    """Large contexts dealt over places, and none of them; a context of null has no probabilities, but logits."""
    monkeypatch.setattr(ngram, "HOT_SHARE", share)
    texts = [["a", f"w{i % 37}", "b", None, "a", "a", f"w{i % 5}"] for i in range(60)] + [["z"], [], None]
    model = ngram.fit(spark.createDataFrame([(t,) for t in texts], "tokens array<string>"))
    n = Counter((x, y) for t in texts if t for x, y in zip(t, t[1:]))
    total, size = Counter(), len({x for t in texts if t and len(t) > 1 for x in t})
    for (x, _), count in n.items():
        total[x] += count if x is not None else 0
    logits = {(x, y): math.log((count + 0.1) / (total[x] + 0.1 * size)) for (x, y), count in n.items()}
    dist = model.distribution(placed=True)
    got = {(r.context, r.token): r.logit for r in dist.collect()}
    assert got == pytest.approx(logits) and model.distribution().columns == ["context", "token", "logit"]
    places = {x: {r.place for r in dist.filter(F.col("context") == x).collect()} for x in ("a", "w36")}
    assert places["w36"] == {0} and (len(places["a"]) > 1 and 0 not in places["a"] if share < 1 else places["a"] == {0})
    mass = Counter()
    for (x, _), logit in logits.items():
        mass[x] += math.exp(logit)
    want = {(x, y): math.exp(logit) / mass[x] for (x, y), logit in logits.items() if x is not None}
    for found in (sampling.softmax(dist, place="place"), sampling.softmax(model.distribution())):
        assert {(r.context, r.token): r.probability for r in found.collect()} == pytest.approx(want)
    far = spark.createDataFrame([("c", "a", 900.0, 1), ("c", "b", 899.0, 2), ("c", "d", -900.0, 3)], f"{DIST}, place long")
    found = {r.token: r.probability for r in sampling.softmax(far, place="place").collect()}
    assert found == pytest.approx({"a": 1 / (1 + math.exp(-1)), "b": 1 / (1 + math.e), "d": 0})


def test_softmax_of_a_model_shuffles_its_counts_once(spark):
    model = ngram.fit(spark.createDataFrame([(["a", "b", "a", "c"],)], "tokens array<string>"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sampling.softmax(model.distribution(placed=True), place="place")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(context" in plan
