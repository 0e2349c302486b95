import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm import odd
from textloom.llm import simhash
from textloom.llm.components import components


def fingerprint(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(values, radius):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    array = np.array(values, np.uint64)
    for x, y in zip(*np.nonzero(np.bitwise_count(array[:, None] ^ array[None, :]) <= radius)):
        a, b = find(x), find(y)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(values))]


def test_masks_cover_every_pair_within_the_radius():
    rnd = random.Random(2)
    for radius in (1, 2, 4):
        masks = simhash.masks(radius)
        for _ in range(3000):
            differing = sum(1 << b for b in rnd.sample(range(64), radius))
            assert any(m & differing == 0 for m in masks)


def test_fingerprint_of_odd_texts():
    for text in [r[1] for r in odd.rows()] + ["A b", "a\x1cb c\x85d e f", "X " * 9]:
        assert simhash.fingerprint(text, 4) == fingerprint(text, 4)


def test_links_of_near_fingerprints_in_blocks(spark, monkeypatch):
    rnd = random.Random(7)
    values = [rnd.getrandbits(64) for _ in range(150)]
    for center in values[:5]:
        for _ in range(40):
            values.append(center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 7))))
    chain = rnd.getrandbits(64)
    for k in range(12):
        values.append(chain := chain ^ (0b1111 << (4 * k)))
    values = sorted(set(values))
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "f bigint")
    want = classes(values, 4)
    for block in (4096, 16):
        monkeypatch.setattr(simhash, "BLOCK", block)
        roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components(simhash.links(table, 4)).collect()}
        got = [roots.get(v, v) for v in values]
        assert len(set(got)) == len(set(want))
        assert len({(g, w) for g, w in zip(got, want)}) == len(set(want))


def test_long_chains_end_in_one_component(spark):
    edges = spark.range(300).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    assert components(edges).select("root").distinct().count() == 1
    assert components(edges.limit(0)).count() == 0


def test_odd_rows(spark):
    docs = odd.documents(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    texts = {r[0]: r[1] for r in odd.rows()}
    for r in got:
        assert r.fingerprint == format(fingerprint(texts[r.doc_id], 4), "016x")
    assert {r.doc_id: r.component for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8, 9: 9, None: None}
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8, 9]
    assert simhash.near_duplicates(odd.nothing(spark)).count() == 0 and simhash.dedup(odd.nothing(spark)).count() == 0
