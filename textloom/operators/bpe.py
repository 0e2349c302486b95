"""Byte-pair encoding: training over distributed word counts, encoding, decoding, quality.

While training, a word is a string in which one character stands for one symbol; see
:mod:`textloom.operators.merging` for the merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.numbers import compression_band
from textloom.operators import merging
from textloom.operators.pretokens import sign_pairs, symbols, word_counts
from textloom.runtime import cut, remove_path, scratch_path, shuffle_width

# Special tokens in id order.
SPECIALS = ("[UNK]", "[PAD]", "[BOS]", "[EOS]")
UNKNOWN = "[UNK]"

VOCAB_SCHEMA = "token string, id int"
MERGES_SCHEMA = "rank int, left string, right string"


@dataclass(frozen=True)
class Tokenizer:
    """A trained tokenizer. Both lists are bounded by the vocabulary size."""

    vocab: tuple[str, ...]
    merges: tuple[tuple[str, str], ...]
    scheme: str = "byte"
    specials: tuple[str, ...] = SPECIALS

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, i) for i, t in enumerate(self.vocab)], VOCAB_SCHEMA)

    def merges_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(self.merges)], MERGES_SCHEMA)


def _stand_in(symbol_id: int) -> str:
    """The character for a symbol id; code points rise with the id and skip the surrogates."""
    point = 0x100 + symbol_id
    return chr(point if point < 0xD800 else point + 0x800)


def _symbol_id(char: str) -> int:
    point = ord(char)
    return (point if point < 0xD800 else point - 0x800) - 0x100


def _round(
    words: DataFrame, vocabulary: merging.Vocabulary, min_frequency: int, candidates: int, pieces: int, symbols_held: int, fitted: int
) -> tuple[np.ndarray, dict[str, str], int] | None:
    """One round of merges: the pairs looked at, what becomes of each piece, and the pairs to begin with in the next
    round; None when no pair is left. ``fitted`` is that number from the round before.
    """
    ranked = [
        (r.pair, r.n)
        for r in merging.pair_counts(words)
        .filter(F.col("n") >= min_frequency)
        .orderBy(F.desc("n"), "pair")
        .limit(candidates + 1)
        .collect()
    ]
    if not ranked:
        return None
    looked_at = min(candidates, len(ranked), fitted)
    while True:
        # pairs as frequent as the first one left out are left out, too
        floor = ranked[looked_at][1] + 1 if looked_at < len(ranked) else min_frequency
        frequent = [pair for pair, n in ranked[:looked_at] if n >= floor]
        # of nothing but ties the first is merged alone: it is the best of all
        most = None if frequent else 1
        keys = np.array(sorted(frequent or [ranked[0][0]]), np.int64)
        # one more than may be held tells that there are too many
        found = merging.piece_counts(words, keys)
        found = cut(found if most else found.limit(pieces + 1), "bpe-pieces")
        size = found.agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.length("piece")).alias("symbols")).first()
        # the stretches of a single pair are that pair, or runs of one symbol
        if most or (size.pieces <= pieces and size.symbols <= symbols_held):
            rows = [(r.piece, r.n) for r in found.collect()]
            break
        looked_at //= 2
    room = min(pieces // max(1, size.pieces), symbols_held // max(1, size.symbols or 0))
    left = merging.merge_pieces([([_symbol_id(c) for c in p], n) for p, n in rows], vocabulary, floor if not most else ranked[0][1], most)
    return keys, {p: "".join(map(_stand_in, parts)) for (p, _), parts in zip(rows, left)}, max(1, looked_at) * max(1, min(room, 16))


def train(
    counts: DataFrame,
    vocab_size: int = 8000,
    min_frequency: int = 2,
    scheme: str = "byte",
    byte_alphabet: bool = False,
    specials: Sequence[str] = SPECIALS,
    candidates: int = 50_000,
    pieces: int = 200_000,
    symbols_held: int = 4_000_000,
) -> Tokenizer:
    """Learn merges from ``(word, n)``, the same ones as one-at-a-time training.

    Merges are made in rounds, see :mod:`textloom.operators.merging`. A round looks at up to
    ``candidates`` pairs, fewer if their words fall into more than ``pieces`` distinct pieces or
    ``symbols_held`` symbols, which bounds the driver's part; more words then mean more rounds. A round begins with as
    many pairs as the last one could hold, or more if there was room. Each round writes
    the words it changed to the shared folder and removes the older table.
    """
    spark = counts.sparkSession
    signed = symbols(counts, scheme)
    path = scratch_path(spark, "bpe-words")
    width = shuffle_width(spark)
    signed.groupBy("signs").agg(F.sum("n").alias("n")).repartition(width, "signs").write.parquet(path)
    base = spark.read.schema("signs string, n bigint").parquet(path)

    # at most one row per Unicode character
    seen = base.select(F.explode(F.split("signs", "")).alias("c")).distinct()
    alphabet = {r.c for r in seen.collect()}
    if byte_alphabet:
        alphabet |= {chr(b) for b in range(256)} - set(tx.HIDDEN_BYTES) | set(tx.HIDDEN_SIGNS)
    vocabulary = merging.Vocabulary([*specials, *sorted(alphabet)], vocab_size)

    spelled = "".join(vocabulary.tokens[len(specials):])
    codes = "".join(_stand_in(i) for i in range(len(specials), len(vocabulary.tokens)))
    words = base.select(F.translate("signs", spelled, codes).alias("s"), "n").filter(F.length("s") > 1)
    fitted = candidates
    while not vocabulary.full:
        done = _round(words, vocabulary, min_frequency, candidates, pieces, symbols_held, fitted)
        if done is None or vocabulary.full:
            break
        *merged, fitted = done
        fresh = scratch_path(spark, "bpe-words")
        merging.exchanged(words, *merged).write.parquet(fresh)
        remove_path(spark, path)
        path, words = fresh, spark.read.schema("s string, n bigint").parquet(fresh)

    remove_path(spark, path)
    return Tokenizer(tuple(vocabulary.tokens), tuple(vocabulary.merges), scheme, tuple(specials))


def train_on_texts(docs: DataFrame, scheme: str = "byte", normalise: bool = True, **options) -> Tokenizer:
    """Normalise, pre-tokenize, count, train."""
    return train(word_counts(docs, scheme, normalise), scheme=scheme, **options)


def _merge_word(signs: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """Apply the merges to one word, best rank first and leftmost first."""
    parts = list(signs)
    while len(parts) > 1:
        best = min(zip(parts, parts[1:]), key=lambda pair: rank.get(pair, len(rank)))
        if best not in rank:
            break
        joined, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                joined.append(parts[i] + parts[i + 1])
                i += 2
            else:
                joined.append(parts[i])
                i += 1
        parts = joined
    return parts


def _encoder(tokenizer: Tokenizer, remember: int = 1 << 18):
    """Ids of a sign word; each worker remembers recent words."""
    rank: dict[tuple[str, str], int] = {}
    for i, pair in enumerate(tokenizer.merges):
        rank.setdefault(pair, i)
    ids = {token: i for i, token in enumerate(tokenizer.vocab)}
    special = set(tokenizer.specials)
    unknown = ids[UNKNOWN]
    memory: dict[str, list[int]] = {}

    def encode(word: str | None) -> list[int] | None:
        if word is None:
            return None
        found = memory.get(word)
        if found is None:
            found = [ids.get(p, unknown) if p not in special else unknown for p in _merge_word(word, rank)]
            if len(memory) >= remember:
                memory.clear()
            memory[word] = found
        return found

    return encode


#: Bytes of words of a batch that are encoded at a time.
HANDED = 4 << 20


def _ids_udf(tokenizer: Tokenizer):
    """Lists of sign words to lists of their ids; a word is looked up once a batch, a null stays null."""
    shared = SparkSession.active().sparkContext.broadcast(tokenizer)

    @F.arrow_udf("array<array<int>>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _encoder(shared.value)

        def coded(rows: pa.Array) -> pa.Array:
            edges = np.asarray(rows.offsets)
            words = rows.values.slice(int(edges[0]), int(edges[-1] - edges[0])).dictionary_encode()
            lists = pa.array([encode(w) for w in words.dictionary.to_pylist()], pa.list_(pa.int32()))
            return pa.ListArray.from_arrays(pa.array(edges - edges[0]), lists.take(words.indices), mask=rows.is_null())

        for rows in batches:
            step = max(1, int(len(rows) * HANDED / max(rows.nbytes, 1)))
            parts = [coded(rows.slice(at, step)) for at in range(0, len(rows), step)] or [coded(rows)]
            yield pa.concat_arrays(parts)

    return ids


FREQUENT, BUCKETS = 8192, 4096


def frequent_codes(counts: DataFrame, tokenizer: Tokenizer, size: int = FREQUENT) -> Column:
    """Ids of the ``size`` most frequent words of ``(word, n)`` as a constant: maps in an array, addressed by hash.

    Each word is encoded once. The constant holds ``size`` words at most, and a map about two.
    """
    top = counts.orderBy(F.desc("n"), "word").limit(size)
    rows = encode_words(top, tokenizer).select(F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).alias("bucket"), "word", "ids").collect()
    maps: list[dict[str, list[int]]] = [{} for _ in range(BUCKETS)]
    for r in rows:
        maps[r.bucket][r.word] = r.ids
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string, array<int>>>")


def encode(
    docs: DataFrame,
    tokenizer: Tokenizer,
    normalise: bool = True,
    text: str = "text",
    out: str = "ids",
    codes: Column | None = None,
) -> DataFrame:
    """Add token ids to each document.

    Pre-tokens are cut in the JVM and encoded in the same task: no row per word and no
    shuffle, whatever the size of the text. Words of ``codes`` (see :func:`frequent_codes`) get
    their ids in the JVM; only the others are handed to Python, once for each distinct one a worker remembers.
    """
    source = tx.nfkc(F.col(text)) if normalise else F.col(text)
    spelt = tx.bytes_to_signs if tokenizer.scheme == "byte" else lambda w: w
    split = docs.withColumn("_words", tx.pretokens(source, tokenizer.scheme))
    if codes is None:
        return split.withColumn(out, F.flatten(_ids_udf(tokenizer)(F.transform("_words", spelt)))).drop("_words")
    known = split.withColumn(
        "_known", F.transform("_words", lambda w: F.get(codes, F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))[w])
    )
    # nulls stand for the words that are known
    rare = known.withColumn("_rare", F.zip_with("_words", "_known", lambda w, k: F.when(k.isNull(), spelt(w))))
    coded = rare.withColumn("_coded", _ids_udf(tokenizer)("_rare"))
    return coded.withColumn(out, F.flatten(F.zip_with("_known", "_coded", lambda k, c: F.coalesce(k, c)))).drop("_words", "_known", "_rare", "_coded")


def encode_words(counts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Add ``ids`` to each distinct word of ``(word, n)``."""
    return (
        symbols(counts, tokenizer.scheme)
        .withColumn("ids", F.flatten(_ids_udf(tokenizer)(F.array("signs"))))
        .drop("signs")
    )


def _token_array(tokenizer: Tokenizer) -> Column:
    """The vocabulary as one constant array, indexable by id."""
    used = set("".join(tokenizer.vocab))
    separator = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in used)
    return F.split(F.lit(separator.join(tokenizer.vocab)), separator)


def tokens_of(ids: Column, tokenizer: Tokenizer) -> Column:
    table = _token_array(tokenizer)
    return F.transform(ids, lambda i: F.get(table, i))


def decoded(ids: Column, tokenizer: Tokenizer) -> Column:
    """Text of the ids. Special tokens vanish; the word scheme puts a space between tokens."""
    kept = F.filter(ids, lambda i: i >= len(tokenizer.specials))
    tokens = tokens_of(kept, tokenizer)
    if tokenizer.scheme == "byte":
        return tx.signs_to_text(F.array_join(tokens, ""))
    return F.array_join(tokens, " ")


def quality(
    docs: DataFrame, tokenizer: Tokenizer, normalise: bool = True, text: str = "text", codes: Column | None = None
) -> DataFrame:
    """Per document: tokens, characters per token, single-letter tokens, round trip."""
    ids = F.col("ids")
    n = F.size(ids)
    return (
        encode(docs, tokenizer, normalise, text, codes=codes)
        .withColumn("chars", F.length(text).cast("bigint"))
        .withColumn("tokens", n.cast("bigint"))
        .withColumn("ratio", F.when(n > 0, F.col("chars") / n).otherwise(0.0))
        .withColumn(
            "single_letters",
            F.exists(tokens_of(ids, tokenizer), lambda t: t.rlike(r"^\p{IsAlphabetic}$")),
        )
        .withColumn("round_trip", decoded(ids, tokenizer) == F.col(text))
        .drop("ids")
    )


def quality_summary(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pooled compression and its band, round-trip failures, single-letter flag."""
    return (
        report.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.sum("chars").alias("chars"),
            F.sum("tokens").alias("tokens"),
            F.count_if("round_trip").alias("round_trips"),
            F.bool_or("single_letters").alias("single_letters"),
        )
        .withColumn("ratio", F.try_divide("chars", "tokens"))
        .withColumn("band", compression_band(F.col("ratio")))
    )
