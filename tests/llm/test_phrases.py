import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import odd
from textloom.llm import phrases


def brute(rows, least=10, longest=3, share=50, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = set()
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            inner = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= share * a and inner(q) for q, b in found.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = phrases.collocations(docs, **options).collect()
    want = brute(rows, **options)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    return want


def texts(seed, n, words, langs=("en", "de", None, "und")):
    rnd = random.Random(seed)
    sep = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", " !? ", "\x0b", "\x1c"]
    return [(rnd.choice(langs), "".join(rnd.choice(words) + rnd.choice(sep) for _ in range(rnd.randint(0, 80)))) for _ in range(n)]


def test_tiles_count_like_a_dictionary():
    rng = np.random.default_rng(2)
    left, right = np.minimum(rng.zipf(1.3, 20_000), 5000) - 1, np.minimum(rng.zipf(1.5, 20_000), 5000) - 1
    want = Counter(zip(left.tolist(), right.tolist()))
    for side, dense in ((1024, 1 << 17), (16, 50), (1024, 1), (1, 1)):
        keys, counts = phrases.tile_counts(left, right, side, dense)
        assert keys.tolist() == sorted(a << 32 | b for a, b in want)
        assert {(k >> 32, k & 0xFFFFFFFF): n for k, n in zip(keys.tolist(), counts.tolist())} == want
    assert not len(phrases.tile_counts(left[:0], right[:0])[0])


def test_streams_pack():
    for values in ([], [-1], [0, -1, 70_000, 2**31 - 1]):
        assert phrases.unpacked(phrases.packed(np.array(values, np.int64))).tolist() == values


@pytest.mark.parametrize("seed, words", [(1, ["a", "B", "c"]), (2, ["the", "Éa", "éa", "x.y", "日本", "of", "new", "york", "NEW"])])
def test_collocations_equal_brute_force(spark, seed, words):
    assert len(check(spark, texts(seed, 400, words))) > 20


def test_longer_phrases_and_limits(spark):
    rows = texts(3, 300, ["a", "b", "c", "d e f g"])
    check(spark, rows, longest=4, least=3)
    check(spark, rows, top=5, share=90)


def test_blocks_of_one_group_add_up(spark, monkeypatch):
    """Many small blocks, and words that are frequent over all of them only."""
    rows = texts(4, 200, ["a", "b", *[f"w{k}" for k in range(30)]], langs=("en",))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(60)
    assert {tuple(r) for r in phrases.collocations(docs).collect()} == brute(rows)


def test_scores_pass_64_bits(spark):
    big = 3_000_000_001
    table = spark.createDataFrame([(["x", "y"], big, [big + 7], [big * 2])], "words array<string>, n long, heads array<long>, tails array<long>")
    row = table.select(phrases._lowest_cut().alias("c")).select("c.*").first()
    assert row.score == 10**6 * big * big // ((big + 7) * big * 2)


def test_odd_rows_and_empty_tables(spark):
    docs = odd.documents(spark)
    want = brute([(r[2], r[1]) for r in odd.rows()])
    assert want and {tuple(r) for r in phrases.collocations(docs).collect()} == want
    assert phrases.collocations(odd.nothing(spark)).count() == 0


@pytest.mark.parametrize("stretch", [1, 3, 7, 1 << 16])
def test_pairs_of_a_stream_are_found_in_any_stretch(monkeypatch, stretch):
    monkeypatch.setattr(phrases, "STRETCH", stretch)
    stream, ids = np.array([0, 1, 2, -1, 1, 2, 0, 1, 2, 2]), [40, 50, 60]
    found = [{"left": a, "right": b, "id": 100 + k, "total": n} for k, (a, b, n) in enumerate([(40, 50, 2), (50, 60, 3), (60, 60, 1)])]
    batch = pa.RecordBatch.from_pylist([{"block": 1, "grp": "en", "stream": phrases.packed(stream), "ids": ids, "found": found}])
    (out,) = phrases._recode_pairs(iter([batch]))
    numbers, names = phrases.unpacked(out.column("stream")[0].as_py()), out.column("ids")[0].as_py()
    assert [None if n < 0 else names[n] for n in numbers] == [100, 101, None, None, 101, None, 100, 101, 102]


def test_pairs_of_words_are_named_by_their_ids():
    stream, ids = np.array([0, 1, -1, 1, 0, 1]), [4, 9]
    found = [{"left": 4, "right": 9, "total": 2}, {"left": 9, "right": 4, "total": 1}]
    batch = pa.RecordBatch.from_pylist([{"block": 1, "grp": "en", "stream": phrases.packed(stream), "ids": ids, "found": found}])
    (out,) = phrases._recode_pairs(iter([batch]))
    numbers, names = phrases.unpacked(out.column("stream")[0].as_py()), out.column("ids")[0].as_py()
    assert [None if n < 0 else (names[n] >> 32, names[n] & 0xFFFFFFFF) for n in numbers] == [(4, 9), None, None, (9, 4), (4, 9)]


def test_tables_of_a_level_go_with_the_next(spark, tmp_path, monkeypatch):
    """Blocks, streams and pairs take as much room as the texts; phrases, words and totals stay until they are read."""
    monkeypatch.setattr("textloom.runtime.shared_folder", lambda _: str(tmp_path))
    rows = texts(5, 300, ["a", "b", "c", "d"])
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = phrases.collocations(docs, longest=4)
    left = {path.name.rsplit("-", 1)[0] for path in tmp_path.iterdir()}
    assert left == {"phrase-counts", "phrase-totals", "phrases", "running"}
    assert {tuple(r) for r in found.collect()} == brute(rows, longest=4)
