import math

import numpy as np

from textloom.llm import topk

LONG = 2**63 - 1


def brute(rows, every, k):
    ok = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    asks = {}
    for i, v in sorted(ok):
        if i % every == 0:
            asks.setdefault(i, v)
    out = []
    for q, v in asks.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)
        out += [(q, rank + 1, i, max(-LONG, min(LONG, -s))) for rank, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_every_score_and_tie(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1) * (rng.random(6) < 0.5)]) for i in range(400)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(400, 700)]
    rows += [(700, None), (701, []), (702, [1.0, None]), (703, [float("nan")]), (704, [float("inf")]), (None, [9.0]), (705, [3.5]), (750, [0.1] * 9), (750, [0.1] * 9), (705, [3.5])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    want = brute(rows, 50, 5)
    for query_block, candidate_block in ((4096, 4096), (4, 90)):
        got = topk.top_k(table, 50, 5, query_block=query_block, candidate_block=candidate_block)
        assert sorted((r.query_id, r.rank, r.id, r.score) for r in got.collect()) == want


def test_large_numbers_and_few_rows(spark):
    rows = [(0, [1e7, -2.5e6]), (1, [3e7, 1e6]), (2, [-1e9, 4.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.top_k(table, 50, 5).collect()
    assert sorted((r.query_id, r.rank, r.id, r.score) for r in got) == brute(rows, 50, 5)
    assert topk.top_k(table.limit(0), 50, 5).count() == 0
    huge = spark.createDataFrame([(0, [1e15]), (1, [1e15]), (2, [-1e15])], "vec_id bigint, embedding array<double>")
    assert [r.id for r in topk.top_k(huge, 50, 5).orderBy("rank").collect()] == [1, 2]
