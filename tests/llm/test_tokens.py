import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import odd
from textloom.llm import dac, packing
from textloom.llm.queries import tokenizer_file
from textloom.llm.tokens import Encoder
from textloom.runtime import scratch_path

ODD = ["", " ", "a\x1cb c", "Ç̌a ǅ İstanbul ΣΑΣ", "don't we'll 'sx x's", "x <|endoftext|> y <|ENDOFTEXT|>", "a,'b ''. 1a2", "́x"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_file(), remember=500)


def test_ids_are_those_of_the_library(encoder):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("aàÀßZ'’.,!\x1c  \n\t1²ЖΣ́<|>_-日") for _ in range(40)) for _ in range(800)]
    assert encoder.wordwise
    flat, edges = encoder.encode(pa.array([None, *texts]).slice(1))
    for k, text in enumerate(texts):
        assert flat[edges[k] : edges[k + 1]].tolist() == encoder.whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_codes_give_every_token_and_all_of_them():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = np.minimum(rng.zipf(1.3, n), 2**32 - 1).astype(np.uint32)
        shard = dac.Shard(dac.encode(ids))
        assert len(shard) == n and shard.all().tolist() == ids.tolist()
        assert [shard[i] for i in range(n)] == ids.tolist()
    with pytest.raises(IndexError):
        dac.Shard(dac.encode(ids))[n]


def test_shards_round_trip(spark, encoder):
    path = scratch_path(spark, "codes")
    dac.write(odd.documents(spark), path, tokenizer_file(), 1, shards=3)
    got = sorted(dac.read(spark, path).collect(), key=lambda r: r.start)
    want = sorted(odd.rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    start = 0
    for row in got:
        ids = np.frombuffer(row.ids, "<u4").tolist()
        texts = [r[1] or "" for r in want if r[0] == row.doc_id]
        assert ids in [[*encoder.whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert (row.start, row.n_tokens) == (start, len(ids))
        start += len(ids)


def test_empty_tables(spark):
    path = scratch_path(spark, "codes")
    dac.write(odd.nothing(spark), path, tokenizer_file(), 1)
    assert dac.read(spark, path).count() == 0
    assert packing.packed(odd.nothing(spark), tokenizer_file(), 1, 4096).count() == 0


def test_packing_holds_every_piece_once(spark, encoder):
    got = packing.packed(odd.documents(spark), tokenizer_file(), 1, 64).collect()
    want = sum(len(encoder.whole.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in odd.rows())
    assert sum(r.length for r in got) == want and all(0 < r.length <= 64 for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    # only longer documents are cut, the last piece may be shorter
    long = sorted((r.start, r.length) for r in got if r.doc_id == 6)
    assert len(long) > 100 and all(n == 64 for _, n in long[:-1]) and [s for s, _ in long] == [64 * k for k in range(len(long))]


def brute_bins(lengths, room):
    best = len(lengths)

    def place(k, spaces):
        nonlocal best
        if len(spaces) >= best:
            return
        if k == len(lengths):
            best = len(spaces)
            return
        for i, s in enumerate(spaces):
            if s >= lengths[k]:
                place(k + 1, [*spaces[:i], s - lengths[k], *spaces[i + 1 :]])
        place(k + 1, [*spaces, room - lengths[k]])

    place(0, [])
    return best


def test_bin_completion_finds_the_least_number_of_sequences():
    rng = np.random.default_rng(3)
    better = 0
    for _ in range(60):
        lengths = np.sort(rng.integers(15, 60, 9))[::-1]
        got = packing.pack_lengths(lengths, 100)
        assert sorted(n for b in got for n in b) == sorted(lengths.tolist()) and all(sum(b) <= 100 for b in got)
        assert packing.least_bins(lengths, 100) <= len(got) == brute_bins(lengths.tolist(), 100)
        better += len(got) < len(packing.best_fit(lengths, 100))
    few = np.array([44, 40, 36, 34, 24, 22])
    assert better and len(packing.best_fit(few, 100)) == 3
    assert len(packing.pack_lengths(few, 100)) == 2


def test_groups_of_any_number_lose_at_most_one_sequence_each(spark):
    rows = spark.range(3000).select((F.col("id") % 700 + 1).alias("length"))
    for group_rows in (100_000, 500):
        got = packing.pack(rows, 1000, group_rows=group_rows)
        tokens, sequences = got.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
        assert tokens == sum(i % 700 + 1 for i in range(3000))
        assert sequences <= -(-tokens // 1000) + 3000 // group_rows + 3
