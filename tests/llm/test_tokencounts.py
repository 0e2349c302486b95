import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import odd
from textloom.llm import tokencounts
from textloom.llm.queries import piece_file, tokenizer_file

PLAIN = ["doc_id", "text", "lang"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_file())


def random_text(rnd, n):
    words = ["the", "Straße", "日本語", "\n\n", "  ", "hello", "<s>", "</s>", "▁", "\x00", "ﬁ", "😀", "aaaa", "1234", "- - -", "\t", "ÀÉ"]
    return " ".join(rnd.choice(words) for _ in range(n))


def test_boundaries_are_stable_and_counts_before_them_right(library):
    rnd, counts = random.Random(3), tokencounts.Counter(piece_file())
    for _ in range(60):
        text = random_text(rnd, 40)
        ids = np.array(counts.ids([text])[0])
        places = counts.stable(text)
        there, n = counts.before(ids, places)
        assert there.tolist() == places.tolist() and len(places) > 30
        for p, k in zip(places.tolist(), n.tolist()):
            assert library.encode(text[:p]) == ids[:k].tolist()


@pytest.mark.parametrize("chunk, overlap", [(200, 8), (1000, 64), (50, 1)])
def test_counts_equal_the_library(spark, library, chunk, overlap):
    rnd = random.Random(chunk)
    texts = [random_text(rnd, rnd.choice([0, 1, 5, 300, 900])) for _ in range(60)]
    # runs without a boundary: overlaps widen, up to the end of the text
    texts += ["a" * 5000, "x " * 300 + "a" * 3000 + " y" * 400, "=" * 2000, "ab" * 100 + " " * 900 + "cd" * 300, "日本" * 800, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = tokencounts.token_counts(docs, piece_file(), chunk=chunk, overlap=overlap).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.n_bytes) == (len(library.encode(texts[r.doc_id])), len(texts[r.doc_id].encode())), r.doc_id


def test_widened_overlaps(library):
    counts = tokencounts.Counter(piece_file())
    text = "some words " * 20 + "a" * 1000 + " and more words" * 40
    parts = list(tokencounts.chunks(text, counts, 100, 4))
    assert max(len(c[1]) for c in parts) > 1000 and len(parts) > 3
    assert all(set(a[3]) == set(b[2]) for a, b in zip(parts, parts[1:]))
    assert len(list(tokencounts.chunks("a" * 5000, counts, 100, 4))) == 1


def test_neighbours_without_a_common_boundary_have_no_sum(spark):
    rows = [(1, 0, 5, [], [], [7, 9], [3, 4]), (1, 6, 4, [9], [1], [], []), (2, 0, 5, [], [], [7], [3]), (2, 6, 4, [8], [2], [], [])]
    got = {r._key: r._total for r in tokencounts._spliced(spark.createDataFrame(rows, tokencounts._CHUNKED)).collect()}
    assert got == {1: 4 + 4 - 1, 2: None}


def test_texts_whose_chunks_do_not_meet_are_encoded_whole(spark, library, monkeypatch):
    texts = ["internationalisation " * 60, "short", "the cat sat on the mat " * 50, "x\n" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spliced = tokencounts._spliced
    monkeypatch.setattr(tokencounts, "_spliced", lambda encoded: spliced(encoded).withColumn("_total", F.lit(None).cast("long")))
    got = {r.doc_id: r.n_tokens for r in tokencounts.token_counts(docs, piece_file(), chunk=64, overlap=2).collect()}
    assert got == {k: len(library.encode(t)) for k, t in enumerate(texts)}


def test_other_tokenizers_take_texts_whole(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    texts = ["Some text. " * 30, "<|endoftext|> is special", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.n_tokens for r in tokencounts.token_counts(docs, tokenizer_file(), chunk=50, overlap=4).collect()}
    assert got == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_odd_rows_and_empty_tables(spark, library):
    got = tokencounts.token_counts(odd.documents(spark).select(*PLAIN, "key", "size"), piece_file())
    assert got.columns == ["doc_id", "lang", "key", "size", "n_bytes", "n_tokens"]
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in odd.rows())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert tokencounts.token_counts(odd.nothing(spark).select(*PLAIN), piece_file()).count() == 0
    with pytest.raises(ValueError, match="n_bytes"):
        tokencounts.token_counts(odd.documents(spark).withColumn("n_bytes", F.lit(1)), piece_file())
