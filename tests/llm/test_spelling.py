import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import queries, spelling


def is_near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if is_near(v, w)]
        form = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = [form if form is not None and counts[form] >= ratio * n else None, n, len(near)]
    rows = set()
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, near, counts[form] if form is not None else None))
    return rows


def check(spark, counts, **options):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.variants(df, **options).collect()
    assert len(got) == len(counts)
    assert {tuple(r) for r in got} == brute(counts)


@pytest.mark.parametrize("letters, longest, levels", [("ab", 6, 48), ("abcdefgh", 4, 48), ("aß\U0001f600", 5, 2)])
def test_variants_equal_brute_force(spark, letters, longest, levels):
    """Few letters give runs, ties and dense tries; few levels send most words to the halves."""
    rnd = random.Random(longest)
    words = {"".join(rnd.choices(letters, k=rnd.randint(1, longest))) for _ in range(150)}
    check(spark, {w: 6 ** rnd.randint(0, 5) for w in sorted(words)}, levels=levels)


def test_long_words_and_ties(spark):
    base = "".join(random.Random(1).choices("abcdefgh", k=300))
    words = [base, base[1:], base[:-1], base[:150] + "z" + base[151:], base + base, "a" * 48, "a" * 49, "a" * 50, "b" + "a" * 47, "b" + "a" * 48]
    words += ["ha" * 40, "ha" * 39 + "h", "ha" * 40 + "h", "kitten", "mitten", "sitten"]
    check(spark, {w: 10 + 40 * (k % 3) for k, w in enumerate(words)})


def test_chains_of_forms(spark):
    words = {"a" * k + "b": 6**k for k in range(1, 12)}
    check(spark, words)


def test_null_and_no_words(spark):
    odd = spark.createDataFrame([(None, 3), ("word", 4), ("", 1), ("x", 9)], "word string, n long")
    got = {tuple(r) for r in spelling.variants(odd).collect()}
    assert got == {("word", None, "word", 4, 0, None), ("", "x", "x", 1, 1, 9), ("x", None, "x", 9, 1, None)}
    assert spelling.variants(odd.filter("n < 0")).count() == 0


def test_query_counts_words_by_its_rule(spark, tmp_path):
    """Every run, null and odd texts included, against Python."""
    import re

    from tests.llm import odd

    texts = [(r[0], r[1]) for r in odd.rows()] + [(k, "Größe GRÖSSE größe wordlike Wordlike wordlikes " * 9) for k in range(100, 500)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    counts, damaged = Counter(), 0
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                damaged += 1
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    got = {tuple(r) for r in queries.op11_spelling_variants(spark, str(tmp_path)).collect()}
    assert damaged and got == brute({w: n for w, n in counts.items() if n >= 5})
