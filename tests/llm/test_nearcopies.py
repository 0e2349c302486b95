import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import odd
from textloom.llm import nearcopies, simhash


def sets(texts, words=5):
    found = [(t or "").lower().split() for t in texts]
    return [{tuple(f[i : i + words]) for i in range(max(1, len(f) - words + 1))} for f in found]


def classes(texts, least):
    """Every pair compared; the class of a text is its first member."""
    shingled, label = sets(texts), list(range(len(texts)))
    for x in range(len(texts)):
        for y in range(x):
            shared = len(shingled[x] & shingled[y])
            if shared >= least * (len(shingled[x]) + len(shingled[y]) - shared):
                a, b = sorted((label[x], label[y]))
                label = [a if v == b else v for v in label]
    return label


def altered(rnd, body, number):
    """``body`` with so many words replaced, apart from each other."""
    out = list(body)
    for at in rnd.sample(range(3, len(body) - 3, 6), number):
        out[at] = f"x{rnd.getrandbits(40)}"
    return out


def planted(groups=60, words=400):
    """Pairs with similarities about 0.8, 0.9 and 0.95 and just below 0.8."""
    rnd, rows = random.Random(11), []
    for g in range(groups):
        body = [f"w{rnd.getrandbits(40)}" for _ in range(words)]
        for number in (0, (2, 4, 8, 12)[g % 4]):
            rows.append(" ".join(altered(rnd, body, number)))
    return rows


@pytest.mark.parametrize("block", [16 << 20, 1000])
def test_every_pair_of_the_similarity_is_found_and_no_other(spark, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rnd = random.Random(5)
    body = [f"w{rnd.getrandbits(40)}" for _ in range(120)]
    crowd = [" ".join(altered(rnd, body, rnd.randrange(1, 8))) for _ in range(60)]
    texts = planted() + crowd + ["a b", "A  b", "a c", None, " ", "one two three four five six"]
    want = classes(texts, 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.key: r.f if r.root is None else r.root for r in nearcopies.classed(docs).collect()}
    assert len({(got[i], want[i]) for i in range(len(texts))}) == len(set(want)) == len(set(got.values()))
    assert sorted(r.doc_id for r in nearcopies.dedup(docs).collect()) == sorted(set(want))
    # four shingle bits of SimHash miss most of these
    assert len(set(want)) < simhash.dedup(docs).count()


def test_texts_of_one_template_make_no_large_group(spark, monkeypatch):
    """Pairs at about 0.4: chains of shared bands run through most of them, and none is a link."""
    rnd = random.Random(7)
    body = [f"w{rnd.getrandbits(40)}" for _ in range(100)]
    texts = [" ".join(altered(rnd, body, 8)) for _ in range(300)]
    met = {}

    def watched(members, words, least, compare=nearcopies._links_in_keys):
        met["texts"] = members.groupBy("m", "band", "i", "j").count().agg(F.max("count")).first()[0]
        return compare(members, words, least)

    monkeypatch.setattr(nearcopies, "_links_in_keys", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert nearcopies.dedup(docs).count() == len(set(classes(texts, 0.8)))
    assert met["texts"] < 100


def test_one_large_key_is_cut_by_texts(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "MEMBERS", 7)
    rnd = random.Random(8)
    body = [f"w{rnd.getrandbits(40)}" for _ in range(120)]
    texts = [" ".join(altered(rnd, body, rnd.randrange(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert nearcopies.dedup(docs).count() == len(set(classes(texts, 0.8)))


def test_odd_rows(spark):
    kept = nearcopies.dedup(odd.documents(spark))
    assert kept.columns == odd.documents(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8, 9]
    assert nearcopies.dedup(odd.nothing(spark)).count() == 0


def test_long_texts_hash_alike_in_parts(monkeypatch):
    hashes = nearcopies.shingles("some words and more of them " * 50 + "end", 5)[1]
    whole = nearcopies.bands(hashes)
    monkeypatch.setattr(nearcopies, "_CHUNK", 3)
    assert (whole == nearcopies.bands(hashes)).all() and np.unique(whole).size == nearcopies.BANDS
