import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm import odd
from textloom.llm import suffixdedup


def brute(texts, span):
    seen = Counter(t[p : p + span] for t in texts for p in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - span + 1):
            if seen[t[p : p + span]] > 1:
                gone[p : p + span] = b"\x01" * span
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((bytes(c for c, g in zip(t, gone) if not g), sum(gone), spans))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefé ü") for _ in range(rnd.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, short = prose(150), prose(45)
    out = [prose(rnd.randrange(1, 300)) for _ in range(30)]
    out += [prose(rnd.randrange(20)) + shared[: rnd.randrange(300, 900)] + prose(rnd.randrange(20)) for _ in range(12)]
    out += [prose(30) + short + prose(40) for _ in range(8)]
    out += [prose(10) + shared[100:520] + prose(5) + shared[130:700], out[3], out[3], "ab" * 500, "x" * 450, "x" * 399, "", None]
    for t in out[:6]:
        cut = rnd.randrange(len(t))
        out.append(t[:cut] + "#" + t[cut + 1 :])
    return out


@pytest.mark.parametrize("most", [2000, 1])
def test_bytes_of_repeated_strings_go(spark, texts, monkeypatch, most):
    monkeypatch.setattr(suffixdedup, "MOST", most)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    got = suffixdedup.dedup(docs, span=400).collect()
    want = brute([(t or "").encode() for t in texts], 400)
    assert sorted((bytes(r.kept), r.n_removed, r.n_spans) for r in got) == want
    assert sum(w[1] for w in want) > 5000


def test_anchors_own_every_window_once_whatever_the_chunks(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    whole = suffixdedup.anchors(data, 400)
    monkeypatch.setattr(suffixdedup, "_CHUNK", 700)
    for x, a, b, g in (whole, suffixdedup.anchors(data, 400)):
        assert a[0] == 0 and b[-1] == 4600 and (a[1:] == b[:-1] + 1).all()
        assert ((a <= x) & (b <= x) & (x + suffixdedup.GRAM <= a + 400)).all()
    assert set(whole[3].tolist()) == set(suffixdedup.anchors(data, 400)[3].tolist())
    assert len(suffixdedup.anchors(data[:399], 400)[0]) == 0


def test_odd_rows(spark):
    docs = odd.documents(spark)
    got = suffixdedup.dedup(docs, span=400)
    assert got.columns == [*docs.columns, "_kept", "_n_removed", "n_spans"]
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == docs.count()
    assert (rows[6]["_n_removed"], rows[6].n_spans, bytes(rows[6]["_kept"])) == (len(odd.LONG), 1, b"")
    assert hashlib.sha256(bytes(rows[7]["_kept"])).digest() == hashlib.sha256(odd.rows()[7][1].encode()).digest()
    assert rows[3]["_n_removed"] == rows[4].n_spans == 0 and bytes(rows[3]["_kept"]) == b""
    assert suffixdedup.dedup(odd.nothing(spark)).count() == 0
