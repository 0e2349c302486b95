"""Queries on pre-tokens, tokenizers and token windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.numbers import COMPRESSION_GOOD, COMPRESSION_LOW
from textloom.operators import bpe, corpus, pretokens, vocabulary, windows
from textloom.plans import tables
from textloom.plans.corpus import draw_sql
from textloom.plans.registry import query
from textloom.runtime import scratch_path
from textloom.sources import tokenizer_files

VOCAB_SIZE = 8000
TOP_WORDS = 8000
BLOCK = 128
LONGEST = 1024

# DuckDB forms of the pre-token patterns; its own \w is ASCII and it has no look-ahead.
WORDS_SQL = r"regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]+')"
BYTE_WORDS_SQL = (
    r"regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')"
)
# byte value -> printable character, counted up from 256 for the hidden bytes
_SIGN_SQL = """chr(CAST(CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 THEN b
  WHEN b <= 32 THEN 256 + b WHEN b <= 160 THEN 256 + b - 94 ELSE 323 END AS INTEGER))"""
SIGNS_SQL = f"""
  signed AS (
    SELECT word, any_value(n) AS n, string_agg({_SIGN_SQL}, '' ORDER BY i) AS signs
    FROM (SELECT word, n, i, CAST('0x' || substr(hex(encode(word)), 2 * i - 1, 2) AS INTEGER) AS b
      FROM (SELECT word, n, unnest(range(1, CAST(octet_length(encode(word)) AS BIGINT) + 1)) AS i FROM counted))
    GROUP BY word)
"""


def _pretoken_report(spark, folder, scheme):
    docs = tables.documents(spark, folder, "doc_id", "text")
    words = tx.pretokens(F.col("text"), scheme)
    return docs.withColumn("w", words).select(
        "doc_id", F.size("w").cast("bigint").alias("tokens"), F.md5(F.array_join("w", "|")).alias("digest")
    )


@query(f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens, md5(array_to_string(w, '|')) AS digest
FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)
""")
def pretok_ws(spark, folder):
    return _pretoken_report(spark, folder, "word")


@query(f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens, md5(array_to_string(w, '|')) AS digest
FROM (SELECT doc_id, {BYTE_WORDS_SQL} AS w FROM documents)
""")
def pretok_bytelevel(spark, folder):
    return _pretoken_report(spark, folder, "byte")


@query(f"""
WITH counted AS (SELECT word, count(*) AS n FROM (SELECT unnest({BYTE_WORDS_SQL}) AS word FROM documents) GROUP BY word), {SIGNS_SQL}
SELECT signs, n FROM signed
""")
def word_counts(spark, folder):
    docs = tables.documents(spark, folder, "text", "doc_id")
    return pretokens.symbols(pretokens.word_counts(docs, "byte"), "byte").select("signs", "n")


@query(f"""
WITH counted AS (SELECT word, count(*) AS n FROM (SELECT unnest({BYTE_WORDS_SQL}) AS word FROM documents) GROUP BY word), {SIGNS_SQL}
SELECT substr(signs, i, 1) AS "left", substr(signs, i + 1, 1) AS "right", CAST(sum(n) AS BIGINT) AS n
FROM (SELECT signs, n, unnest(range(1, length(signs))) AS i FROM signed) GROUP BY 1, 2 HAVING sum(n) >= 2
""")
def pair_counts(spark, folder):
    docs = tables.documents(spark, folder, "text", "doc_id")
    return pretokens.pair_counts(pretokens.symbols(pretokens.word_counts(docs, "byte"), "byte"))


_SAVED: dict[tuple[str, str, str], str] = {}


def _trained(spark, docs, key, scheme="byte"):
    """The tokenizer of all texts and a table of their words; both made once per session and content, then loaded."""
    content = docs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(key, "text"))).first()
    saved = (spark.sparkContext.applicationId, str(tuple(content)), scheme)
    if saved not in _SAVED:
        path = scratch_path(spark, "tokenizer")
        pretokens.word_counts(docs, scheme).write.parquet(f"{path}/words")
        trained = bpe.train(spark.read.parquet(f"{path}/words"), VOCAB_SIZE, scheme=scheme)
        tokenizer_files.save_tokenizer(spark, trained, path)
        _SAVED[saved] = path
    path = _SAVED[saved]
    return tokenizer_files.load_tokenizer(spark, path, scheme), spark.read.parquet(f"{path}/words")


def _tokenizer(spark, folder, scheme="byte"):
    docs = tables.documents(spark, folder)
    return docs, _trained(spark, docs, "doc_id", scheme)[0]


def _coded(spark, docs, key):
    """The tokenizer and the codes of the most frequent words."""
    tokenizer, words = _trained(spark, docs, key)
    return tokenizer, bpe.frequent_codes(words, tokenizer)


@query()
def normalised_docs(spark, folder):
    """Unicode NFKC of every text; DuckDB has no such function."""
    docs = tables.documents(spark, folder, "doc_id", "text").withColumn("normal", tx.nfkc(F.col("text")))
    return docs.select("doc_id", F.md5("normal").alias("digest"), (F.col("normal") != F.col("text")).alias("changed"))


@query()
def bpe_merges(spark, folder):
    _, tokenizer = _tokenizer(spark, folder)
    return tokenizer.merges_table(spark)


@query()
def bpe_merges_ws(spark, folder):
    _, tokenizer = _tokenizer(spark, folder, "word")
    return tokenizer.merges_table(spark)


@query()
def bpe_encode(spark, folder):
    docs = tables.documents(spark, folder)
    tokenizer, codes = _coded(spark, docs, "doc_id")
    return bpe.encode(docs, tokenizer, codes=codes).select(
        "doc_id", "ids", bpe.tokens_of(F.col("ids"), tokenizer).alias("tokens")
    )


@query("""
SELECT doc_id, TRUE AS same FROM documents
""")
def bpe_roundtrip(spark, folder):
    """Byte-level decoding gives back every text."""
    docs = tables.documents(spark, folder)
    tokenizer, codes = _coded(spark, docs, "doc_id")
    encoded = bpe.encode(docs, tokenizer, codes=codes)
    return encoded.select("doc_id", (bpe.decoded(F.col("ids"), tokenizer) == F.col("text")).alias("same"))


@query()
def tokenizer_quality(spark, folder):
    docs = tables.documents(spark, folder)
    tokenizer, codes = _coded(spark, docs, "doc_id")
    report = bpe.quality(docs, tokenizer, codes=codes)
    return bpe.quality_summary(report, ["lang"]).withColumn("ratio", F.round("ratio", 6))


@query()
def tokenizer_artifact(spark, folder):
    """The vocabulary of a saved and loaded tokenizer."""
    _, tokenizer = _tokenizer(spark, folder)
    return tokenizer.vocab_table(spark)


# One merge a step over the words of ``benchmark``: a symbol is the character 256 + its id, so that
# characters are in the order of ids. No merge there makes a token that another one made before.
_BENCHMARK_SQL = f"""
  RECURSIVE split AS (SELECT item_id, text, {BYTE_WORDS_SQL} AS w FROM benchmark),
  counted AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM split) GROUP BY word), {SIGNS_SQL},
  alphabet AS (
    SELECT sign, 3 + row_number() OVER (ORDER BY sign) AS id
    FROM (SELECT DISTINCT substr(signs, i, 1) AS sign FROM (SELECT signs, unnest(range(1, length(signs) + 1)) AS i FROM signed))),
  train AS (
    SELECT 0 AS step, word, n, string_agg(chr(CAST(256 + id AS INTEGER)), '' ORDER BY i) AS s, NULL::VARCHAR AS pair
    FROM (SELECT word, n, signs, unnest(range(1, length(signs) + 1)) AS i FROM signed) JOIN alphabet ON sign = substr(signs, i, 1)
    GROUP BY word, n
    UNION ALL
    SELECT step + 1, word, n, replace(s, best.pair, chr(CAST(260 + (SELECT count(*) FROM alphabet) + step AS INTEGER))), best.pair
    FROM train, (
      SELECT substr(s, i, 2) AS pair FROM (SELECT s, n, unnest(range(1, length(s))) AS i FROM train)
      GROUP BY 1 HAVING sum(n) >= 2 ORDER BY sum(n) DESC, 1 LIMIT 1) best
    WHERE 4 + (SELECT count(*) FROM alphabet) + step < {VOCAB_SIZE}),
  merges AS (SELECT DISTINCT step, unicode(pair[1]) - 259 AS l, unicode(pair[2]) - 259 AS r FROM train WHERE step > 0),
  names AS (
    SELECT 0 AS step, (SELECT list(sign ORDER BY id) FROM alphabet) AS v
    UNION ALL
    SELECT m.step, list_append(v, v[l] || v[r]) FROM names JOIN merges m ON m.step = names.step + 1),
  vocabulary AS (SELECT v FROM names ORDER BY step DESC LIMIT 1),
  coded AS (
    SELECT word, [unicode(s[i]) - 256 FOR i IN range(1, length(s) + 1)] AS ids
    FROM train WHERE step = (SELECT max(step) FROM train)),
  encoded AS (
    SELECT item_id, any_value(text) AS text, flatten(list(ids ORDER BY i)) AS ids
    FROM (SELECT item_id, text, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split) JOIN coded USING (word) GROUP BY item_id)
"""


def _benchmark(spark, folder):
    return tables.texts(spark, folder, "benchmark", "item_id", "item_id", "text")


@query(f"""WITH {_BENCHMARK_SQL}
SELECT CAST(m.step - 1 AS INTEGER) AS rank, v[l] AS "left", v[r] AS "right" FROM merges m, vocabulary
""")
def bpe_merges_benchmark(spark, folder):
    return _trained(spark, _benchmark(spark, folder), "item_id")[0].merges_table(spark)


@query(f"""WITH {_BENCHMARK_SQL}
SELECT item_id, ids, [v[i - 3] FOR i IN ids] AS tokens FROM encoded, vocabulary
""")
def bpe_encode_benchmark(spark, folder):
    items = _benchmark(spark, folder)
    tokenizer, codes = _coded(spark, items, "item_id")
    return bpe.encode(items, tokenizer, codes=codes).select(
        "item_id", "ids", bpe.tokens_of(F.col("ids"), tokenizer).alias("tokens")
    )


@query(f"""WITH {_BENCHMARK_SQL},
  report AS (
    SELECT length(text) AS chars, len(ids) AS tokens,
      len([1 FOR i IN ids IF regexp_full_match(v[i - 3], '[\\p{{L}}\\p{{Nl}}]')]) > 0 AS single_letters
    FROM encoded, vocabulary)
SELECT count(*) AS documents, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS round_trips,
  bool_or(single_letters) AS single_letters, round(sum(chars) / sum(tokens)::DOUBLE, 6) AS ratio,
  CASE WHEN sum(chars) / sum(tokens)::DOUBLE < {COMPRESSION_LOW} THEN 'low' WHEN sum(chars) / sum(tokens)::DOUBLE < {COMPRESSION_GOOD} THEN 'moderate' ELSE 'good' END AS band
FROM report
""")
def tokenizer_quality_benchmark(spark, folder):
    items = _benchmark(spark, folder)
    tokenizer, codes = _coded(spark, items, "item_id")
    summary = bpe.quality_summary(bpe.quality(items, tokenizer, codes=codes))
    return summary.withColumn("ratio", F.round("ratio", 6))


_VOCAB_SQL = f"""
  words AS (SELECT doc_id, unnest({WORDS_SQL}) AS token FROM documents),
  vocab AS (SELECT token, 3 + row_number() OVER (ORDER BY n DESC, token) AS id
    FROM (SELECT token, count(*) AS n FROM words GROUP BY token) ORDER BY n DESC, token LIMIT {TOP_WORDS})
"""


@query(f"""WITH {_VOCAB_SQL}
SELECT doc_id, count(*) AS tokens, count(*) FILTER (id IS NULL) AS unknown, CAST(sum(coalesce(id, 0)) AS BIGINT) AS id_sum
FROM words LEFT JOIN vocab USING (token) GROUP BY doc_id
""")
def token_lookup(spark, folder):
    """Token to id through a vocabulary table of the most frequent words, unknown ones to 0."""
    docs = tables.documents(spark, folder, "doc_id", "text").withColumn("tokens", tx.words_of(F.col("text")))
    vocab = vocabulary.most_frequent(docs, TOP_WORDS)
    found = vocabulary.lookup(docs.select("doc_id", F.explode("tokens").alias("token")), vocab)
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("tokens"),
        F.count_if(F.col("id") == 0).alias("unknown"),
        F.sum("id").cast("bigint").alias("id_sum"),
    )


def _tokenized(spark, folder):
    docs = tables.documents(spark, folder, "doc_id", "text")
    return docs.select("doc_id", tx.byte_words_of(F.col("text")).alias("tokens"))


@query(f"""
SELECT doc_id, n_tokens, CAST(coalesce(sum(n_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM (SELECT doc_id, CAST(len({BYTE_WORDS_SQL}) AS BIGINT) AS n_tokens FROM documents)
""")
def token_offsets(spark, folder):
    return windows.token_offsets(_tokenized(spark, folder), ["doc_id"])


@query(f"""
WITH tokens AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS token
    FROM (SELECT doc_id, {BYTE_WORDS_SQL} AS w FROM documents)),
stream AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, token, lead(token) OVER (ORDER BY doc_id, i) AS following FROM tokens)
SELECT pos // {BLOCK} * {BLOCK} AS start, string_agg(token, '|' ORDER BY pos) AS x, string_agg(following, '|' ORDER BY pos) AS y
FROM stream GROUP BY 1 HAVING start <= (SELECT count(*) FROM tokens) - {BLOCK} - 2
""")
def samples(spark, folder):
    """Consecutive windows of the whole token stream."""
    cut = windows.samples(_tokenized(spark, folder), ["doc_id"], BLOCK)
    return cut.select("start", F.array_join("x", "|").alias("x"), F.array_join("y", "|").alias("y"))


@query(f"""
WITH tokens AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS token
    FROM (SELECT doc_id, {BYTE_WORDS_SQL} AS w FROM documents)),
stream AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, length(token) * 1000 + unicode(token) AS sign FROM tokens),
totals AS (SELECT pos, coalesce(sum(sign) OVER near, 0) AS s, coalesce(sum(pos * sign) OVER near, 0) AS p FROM stream
  WINDOW near AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ahead AS (SELECT pos, s, p, lead(s) OVER w AS s1, lead(p) OVER w AS p1, lead(s, {BLOCK}) OVER w AS s_end, lead(p, {BLOCK}) OVER w AS p_end,
    lead(s, {BLOCK + 1}) OVER w AS s1_end, lead(p, {BLOCK + 1}) OVER w AS p1_end FROM totals WINDOW w AS (ORDER BY pos))
SELECT pos AS start, CAST(s_end - s AS BIGINT) AS x_sum, CAST(p_end - p - pos * (s_end - s) AS BIGINT) AS x_places,
  CAST(s1_end - s1 AS BIGINT) AS y_sum, CAST(p1_end - p1 - (pos + 1) * (s1_end - s1) AS BIGINT) AS y_places
FROM ahead WHERE pos <= (SELECT count(*) FROM tokens) - {BLOCK} - 2
""")
def samples_every_start(spark, folder):
    """A window at every token, each with sums that tell its tokens and their places."""
    sign = F.char_length("token").cast("bigint") * 1000 + F.ascii("token")
    return windows.window_sums(_tokenized(spark, folder), ["doc_id"], BLOCK, sign)


@query(f"""
SELECT n AS tokens, greatest(n - {BLOCK} - 1, 0) AS samples
FROM (SELECT CAST(sum(len({BYTE_WORDS_SQL})) AS BIGINT) AS n FROM documents)
""")
def dataset_size(spark, folder):
    return windows.dataset_size(_tokenized(spark, folder), BLOCK)


@query(f"""
WITH w AS (SELECT doc_id, {BYTE_WORDS_SQL} AS w FROM documents)
SELECT doc_id, b AS block_no, CAST(len(list_slice(w, b * {LONGEST} + 1, b * {LONGEST} + {LONGEST})) AS BIGINT) AS tokens,
  md5(array_to_string(list_slice(w, b * {LONGEST} + 1, b * {LONGEST} + {LONGEST}), '|')) AS digest, len(w) > {LONGEST} AS too_long
FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / {LONGEST}.0) AS BIGINT))) AS b FROM w)
""")
def length_blocks(spark, folder):
    """The sequence-length rule: too long texts are marked and cut into blocks."""
    marked = windows.within_length(_tokenized(spark, folder), LONGEST, "tokens")
    return windows.blocks(marked, LONGEST, "tokens").select(
        "doc_id",
        F.col("block_no").cast("bigint").alias("block_no"),
        F.size("tokens").cast("bigint").alias("tokens"),
        F.md5(F.array_join("tokens", "|")).alias("digest"),
        "too_long",
    )


_SAMPLE_SPLIT_SQL = """CASE WHEN row_number() OVER (ORDER BY md5('7:' || doc_id)) <= floor((SELECT count(*) FROM documents) * 0.2::DOUBLE)
  THEN 'validation' ELSE 'train' END"""


def _leak_sql(part):
    return f"""
SELECT CAST(count(*) AS BIGINT) AS validation, count(*) FILTER (text IN (SELECT text FROM s WHERE part = 'train')) AS leaked,
  count(*) FILTER (text NOT IN (SELECT text FROM s WHERE part = 'train')) AS clean
FROM (SELECT text FROM s WHERE part = 'validation')"""


@query(f"WITH s AS (SELECT text, {_SAMPLE_SPLIT_SQL} AS part FROM documents) {_leak_sql('part')}")
def split_leak(spark, folder):
    """Copies make a split by single rows leak."""
    docs = tables.documents(spark, folder, "doc_id", "text")
    split = corpus.split_by_sample(docs, "doc_id", 0.2, seed=7)
    return windows.split_overlap(split, F.col("text"))


@query(f"""
WITH s AS (SELECT text, CASE WHEN {draw_sql("'7:' || text")} < 0.2 THEN 'validation' ELSE 'train' END AS part FROM documents)
{_leak_sql('part')}
""")
def split_leak_grouped(spark, folder):
    """A split by content does not."""
    docs = tables.documents(spark, folder, "doc_id", "text")
    return windows.split_overlap(corpus.split_by_group(docs, F.col("text"), 0.2, seed=7), F.col("text"))


@query(f"""
WITH s AS (SELECT doc_id, text, {_SAMPLE_SPLIT_SQL} AS part FROM documents)
SELECT doc_id FROM s WHERE part = 'validation' AND text NOT IN (SELECT text FROM s WHERE part = 'train')
""")
def unleaked_validation(spark, folder):
    docs = tables.documents(spark, folder, "doc_id", "text")
    split = corpus.split_by_sample(docs, "doc_id", 0.2, seed=7).withColumn("digest", F.md5("text"))
    train, validation = split.filter("part = 'train'"), split.filter("part = 'validation'")
    return windows.unleaked(validation, train, "digest").select("doc_id")


# Equal windows by doubling: windows of k tokens have equal numbers if they are equal, and two of them make one of 2 k.
_DOUBLED_SQL = ",\n".join(
    f"""  d{2 * k} AS (SELECT part, pos, dense_rank() OVER (ORDER BY a, b) AS id FROM (
    SELECT part, pos, id AS a, lead(id, {k}) OVER (PARTITION BY part ORDER BY pos) AS b FROM d{k}) WHERE b IS NOT NULL)"""
    for k in (1, 2, 4, 8, 16, 32, 64)
)


@query(f"""
WITH s AS (SELECT doc_id, text, {_SAMPLE_SPLIT_SQL} AS part FROM documents),
  tokens AS (SELECT part, doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM (SELECT part, doc_id, {BYTE_WORDS_SQL} AS w FROM s)),
  d1 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY doc_id, i) - 1 AS pos, dense_rank() OVER (ORDER BY token) AS id FROM tokens),
{_DOUBLED_SQL},
  windows AS (SELECT part, id FROM d{BLOCK} JOIN (SELECT part, count(*) AS n FROM d1 GROUP BY part) USING (part) WHERE pos <= n - {BLOCK} - 2)
SELECT count(*) AS validation, count(*) FILTER (id IN (SELECT id FROM windows WHERE part = 'train')) AS leaked,
  count(*) FILTER (id NOT IN (SELECT id FROM windows WHERE part = 'train')) AS clean
FROM windows WHERE part = 'validation'
""")
def window_leak(spark, folder):
    """Windows of the validation stream that the training stream has, too, after a split by single rows."""
    docs = tables.documents(spark, folder, "doc_id", "text")
    split = corpus.split_by_sample(docs, "doc_id", 0.2, seed=7)
    tokenized = split.select("part", "doc_id", tx.byte_words_of(F.col("text")).alias("tokens"))
    return windows.window_overlap(tokenized, ["doc_id"], BLOCK)
