import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm import odd
from textloom.llm import fingerprints as fp


def jaccard(a, b):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in (a, b))
    both = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in both) / sum(max(a[w], b[w]) for w in both) if both else 1.0


def test_likeness_is_generalised_jaccard_and_order_crosses_buckets(spark):
    rng = np.random.default_rng(3)
    # documents near each other share words, others do not, so that chance evens out
    texts = [" ".join(f"{i // 10}w{k}" for k in rng.integers(0, 60, rng.integers(0, 120))) for i in range(400)]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(7)
    got = {r.doc_id // 3: r for r in fp.fingerprints(docs, samples=48, bucket_rows=37).collect()}
    assert len(got) == 400
    errors = []
    for i, text in enumerate(texts):
        following = texts[i - 1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [got[i].near_edited - jaccard(text, edited), got[i].near_next - jaccard(text, following)]
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.1


def test_odd_rows(spark):
    docs = odd.documents(spark)
    for bucket_rows in (2000, 1):
        rows = fp.fingerprints(docs, samples=8, bucket_rows=bucket_rows).collect()
        assert len(rows) == docs.count()
        by_id = {r.doc_id: r for r in rows}
        assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[3].fingerprint == by_id[5].fingerprint
        assert by_id[2].n_chars == len(odd.rows()[1][1]) and by_id[4].near_next == 1.0
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
        # the last in order, without id, is followed by the first
        assert by_id[None].edited_sha256 in {
            hashlib.sha256(e.encode()).hexdigest() for e in ("no id" + "12345", "no id" + "no id")
        }
    assert fp.fingerprints(odd.nothing(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = fp.fingerprints(odd.documents(spark), samples=4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_buckets_by_binary_search(spark):
    bounds = [3, 10, 11, 40]
    keys = spark.createDataFrame([(k,) for k in (None, -1, 3, 4, 10, 11, 12, 40, 41, 99)], "k bigint")
    got = {r.k: r.b for r in keys.select("k", fp._bucket_of(F.col("k"), bounds).alias("b")).collect()}
    assert got == {None: -1} | {k: sum(b < k for b in bounds) for k in (-1, 3, 4, 10, 11, 12, 40, 41, 99)}
