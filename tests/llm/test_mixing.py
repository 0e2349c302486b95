from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import odd
from textloom.llm import mixing


def fixed_point(sizes, weights, most):
    """Shares by weight; what passes a limit is shared anew among the others."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, free = float(sum(sizes.values())), {}, set(names)
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 1000, "c": 5, None: 40}, {"a": 0, "b": 7}, {"a": 5}, {"x": 1, "y": 1, "z": 10000, "b": 3}]
    + [{"a": 100, "b": 100, "c": 100, "d": 100, "e": 1}, dict.fromkeys("abcdefg", 50)],
)
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(table, (1, 2, 3), 3).collect()}
    assert got == pytest.approx(fixed_point(sizes, (1, 2, 3), 3))


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.pow(F.col("id") % 97, 2) / 30 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
    )
    first, again = (mixing.mix(docs).orderBy("key").collect() for _ in range(2))
    assert first == again
    taken, target, largest = Counter(), {}, Counter()
    for r in first:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 3
    assert sum(target.values()) == pytest.approx(sum(r.size for r in first))
    for s in target:
        assert abs(taken[s] - target[s]) <= 3 * largest[s]


def test_odd_rows(spark):
    docs = odd.documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert {r.size for r in rows if r.key in (3, 4, 5)} == {0}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in rows:
        want[r.key] += r.copies
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({k: n for k, n in want.items() if n})
    assert mixing.mix(odd.nothing(spark)).count() == 0 and mixing.mixed(odd.nothing(spark)).count() == 0
