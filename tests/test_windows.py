import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus, windows


def docs_of(spark, sizes):
    rows, at = [], 0
    for i, n in enumerate(sizes):
        rows.append((i, list(range(at, at + n))))
        at += n
    return spark.createDataFrame(rows, "doc_id int, tokens array<int>")


def naive(n, block, stride):
    return {s: (list(range(s, s + block)), list(range(s + 1, s + block + 1))) for s in range(0, max(n - block - 1, 0), stride)}


@pytest.mark.parametrize("sizes", [[0], [4], [5], [6], [53], [1, 0, 9, 30, 0, 13], [3] * 17])
@pytest.mark.parametrize("stride, bucket", [(1, 10), (4, 10), (3, 7), (7, 5)])
def test_samples_equal_the_naive_loop(spark, sizes, stride, bucket):
    got = windows.samples(docs_of(spark, sizes), ["doc_id"], 4, stride, bucket=bucket)
    assert {r.start: (r.x, r.y) for r in got.collect()} == naive(sum(sizes), 4, stride)


def test_number_of_samples(spark):
    for n, want in [(0, 0), (4, 0), (5, 0), (6, 1), (53, 48)]:
        size = windows.dataset_size(docs_of(spark, [n]), 4).first()
        assert (size.tokens, size.samples) == (n, want)
        assert windows.samples(docs_of(spark, [n]), ["doc_id"], 4, 1).count() == want


def test_one_huge_document(spark):
    docs = docs_of(spark, [3, 20000, 5])
    got = windows.samples(docs, ["doc_id"], 64, bucket=512)
    want = naive(20008, 64, 64)
    assert {r.start: (r.x, r.y) for r in got.collect()} == want


def test_bucket_must_hold_a_window(spark):
    with pytest.raises(ValueError):
        windows.samples(docs_of(spark, [9]), ["doc_id"], 4, bucket=3)


def test_token_stream(spark):
    rows = windows.token_stream(docs_of(spark, [2, 0, 3]), ["doc_id"]).collect()
    assert sorted((r.pos, r.token) for r in rows) == [(i, i) for i in range(5)]


def test_shifted_and_blocks(spark):
    df = docs_of(spark, [0, 1, 5])
    x, y = windows.shifted(F.col("tokens"))
    assert [(r.x, r.y) for r in df.select(x.alias("x"), y.alias("y")).collect()] == [([], []), ([], []), ([1, 2, 3, 4], [2, 3, 4, 5])]
    cut = windows.blocks(windows.within_length(df, 2, "tokens"), 2, "tokens").collect()
    assert [(r.block_no, r.tokens, r.too_long) for r in cut] == [
        (0, [0], False), (0, [1, 2], True), (1, [3, 4], True), (2, [5], True),
    ]
    assert windows.scorable(df, "tokens").count() == 1


@pytest.mark.parametrize("n, fraction", [(1000, 0.05), (37, 0.1), (10, 0.05), (64, 1.0), (5, 0.5)])
def test_split_by_sample_is_exact(spark, n, fraction):
    split = corpus.split_by_sample(spark.range(n), "id", fraction, seed=1, prefix_digits=2)
    parts = {r.part: r["count"] for r in split.groupBy("part").count().collect()}
    assert parts.get("validation", 0) == int(n * fraction) and sum(parts.values()) == n


def test_group_split_keeps_copies_together(spark):
    df = spark.createDataFrame([(i, f"text {i % 20}") for i in range(400)], "id int, text string")
    split = corpus.split_by_group(df, F.col("text"), 0.3)
    assert split.groupBy("text").agg(F.count_distinct("part").alias("n")).filter("n > 1").count() == 0
    audit = windows.split_overlap(split, F.col("text")).first()
    assert audit.leaked == 0 and audit.clean == audit.validation > 0
    leaky = windows.split_overlap(corpus.split_by_sample(df, "id", 0.3), F.col("text")).first()
    assert leaky.leaked > 0


def test_shuffle_is_a_reproducible_permutation(spark):
    df = spark.range(200)
    a = [r.id for r in corpus.shuffled(df, "id", 1).collect()]
    assert a == [r.id for r in corpus.shuffled(df.repartition(5), "id", 1).collect()]
    assert sorted(a) == list(range(200)) and a != sorted(a)
    places = {r.id: r.place for r in corpus.shuffle_places(df, "id", 1).collect()}
    assert [i for i, _ in sorted(places.items(), key=lambda kv: kv[1])] == a


def test_weight_for_share(spark):
    random.seed(1)
    code = spark.createDataFrame([("a", "x" * 100)], "name string, text string")
    books = spark.createDataFrame([("b", "y" * 200)], "name string, text string")
    row = corpus.weight_for_share(code, books, 0.6).first()
    assert (row.code_weight, row.code_share) == (3, 0.6)


def brute_windows(parts, block):
    """Windows of each part's stream at every start; the last one is left out, as in samples()."""
    streams = {p: [t for _, tokens in sorted(docs) for t in tokens] for p, docs in parts.items()}
    return {p: [tuple(s[i : i + block]) for i in range(len(s) - block - 1)] for p, s in streams.items()}


@pytest.mark.parametrize("block, bucket", [(4, None), (4, 5), (16, 17), (128, None)])
def test_window_leak_equals_brute_force(spark, block, bucket):
    import random

    rnd = random.Random(block)
    phrase = [rnd.choice("abcdef") for _ in range(40)]
    parts = {"train": [], "validation": []}
    for i in range(60):
        tokens = [rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.4:
            tokens[5:5] = phrase
        parts[rnd.choice(["train", "validation"])].append((i, tokens))
    rows = [(p, i, t) for p, docs in parts.items() for i, t in docs]
    split = spark.createDataFrame(rows, "part string, id int, tokens array<string>")
    found = brute_windows(parts, block)
    trained = set(found["train"])
    leaked = sum(w in trained for w in found["validation"])
    assert windows.window_overlap(split, ["id"], block).first().asDict() == {
        "validation": len(found["validation"]), "leaked": leaked, "clean": len(found["validation"]) - leaked
    }
    assert leaked or block > 16
    # equal hashes and equal windows are the same thing, whatever the buckets
    hashes = windows.window_hashes(split.filter("part = 'train'"), ["id"], block, bucket=bucket).orderBy("start").collect()
    assert [r.start for r in hashes] == list(range(len(found["train"])))
    assert len({(r.h1, r.h2, r.h3) for r in hashes}) == len(trained) == len({(w, r.h1, r.h2, r.h3) for w, r in zip(found["train"], hashes)})


def test_window_sums_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, [str(j % 7) for j in range(i % 5)]) for i in range(40)], "id int, tokens array<string>")
    stream = [int(t) for r in docs.orderBy("id").collect() for t in r.tokens]
    got = windows.window_sums(docs, ["id"], 3, F.col("token").cast("int"), bucket=7).orderBy("start").collect()
    want = []
    for i in range(len(stream) - 4):
        x, y = stream[i : i + 3], stream[i + 1 : i + 4]
        want.append((i, sum(x), x[1] + 2 * x[2], sum(y), y[1] + 2 * y[2]))
    assert [tuple(r) for r in got] == want
    assert windows.window_sums(docs.limit(0), ["id"], 3, F.lit(1)).count() == 0


def test_windows_are_not_repeated_by_token(spark):
    docs = spark.createDataFrame([(1, ["a"])], "id int, tokens array<string>")
    for df in (windows.window_sums(docs, ["id"], 128, F.length("token")), windows.window_hashes(docs, ["id"], 128)):
        text = df._jdf.queryExecution().executedPlan().toString()
        # windows use the partitioning of the buckets
        assert text.count("Exchange hashpartitioning(bucket") == 1 and "Python" not in text.replace("PythonRDD", "")


def test_windows_are_not_counted_before_they_are_dealt(spark):
    split = spark.createDataFrame([("train", 1, ["a"]), ("validation", 2, ["b"])], "part string, id int, tokens array<string>")
    plan = windows.window_overlap(split, ["id"], 4)._jdf.queryExecution().executedPlan().toString()
    dealt = plan.index("Exchange hashpartitioning(k")
    # both counts by window stand above the exchange of the windows, which moves two numbers a window
    assert "HashAggregate(keys=[k" in plan[:dealt] and "HashAggregate(keys=[k" not in plan[dealt:]
