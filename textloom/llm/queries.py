"""The operators as queries over the test tables, with the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import dac, fingerprints, langid, linededup, mixing, packing, phrases, simhash, spelling, suffixdedup, tokencounts, topk, toxicity
from textloom.llm.common import ascii_lower, held_out, table, text_key
from textloom.runtime import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rules of the contracts.
END_ID, ROOM = 1, 4096


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


LINES_SQL = """
  lines AS (
    SELECT doc_id, text, generate_subscripts(ls, 1) AS place, unnest(ls) AS line
    FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
  keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
  frequent AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
"""


@query(
    f"""
    WITH {LINES_SQL}
    SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (f.key IS NULL), '')) AS kept_sha256
    FROM keyed LEFT JOIN frequent f USING (key)
    GROUP BY doc_id
    """
)
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = linededup.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query()
def op4_token_codes(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-codes")
    dac.write(table(spark, folder, "documents"), path, tokenizer_file(), END_ID)
    return dac.read(spark, path, wanted=F.crc32("ids").alias("ids_crc32"))


@query(
    """
    WITH whole AS (
      SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
      FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
      WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    WHERE rank <= 5
    """
)
def op6_top_k(spark: SparkSession, folder: str) -> DataFrame:
    best = topk.top_k(table(spark, folder, "embeddings"), every=50, k=5, scale=256.0)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


@query()
def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        F.col("key").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


@query()
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), tokenizer_file(), END_ID, ROOM)


@query()
def op2_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), words=4, radius=4)
    return found.select("doc_id", "fingerprint", F.col("component").alias("component_id"))


@query()
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id")))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query()
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"), ~held_out(F.col("doc_id")))
    found = toxicity.totals(docs, model)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "total"
    )


@query()
def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    lost = suffixdedup.cut_texts(docs, span=400).select(
        "t1", "t2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
    body = F.coalesce("text", F.lit("")).cast("binary")
    whole = docs.select(
        "doc_id", *text_key(F.col("text")), F.octet_length(body).cast("bigint").alias("n_bytes"), F.sha2(body, 256).alias("sha")
    )
    # no text meets this join: checksums of whole and of cut texts only
    return whole.join(lost, ["t1", "t2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


@query()
def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = tokencounts.token_counts(table(spark, folder, "documents").select("doc_id", "text"), piece_file())
    return found.withColumn("over_limit", F.col("n_tokens") > ROOM)


LOWER_SQL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Rules of the contract of query 11.
LETTER_RUN, DAMAGE_EVERY = "[A-Za-z\\u00C0-\\u00FF]+", 199


def _spelt_words(docs: DataFrame) -> DataFrame:
    """``word, n``: letter runs of at least six code points, some of them damaged, that occur five times."""
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(LETTER_RUN), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("run")).filter(F.char_length("run") >= 6)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = rows.withColumn("h", h).select(F.when(F.col("h") % DAMAGE_EVERY == 0, less).otherwise(F.col("run")).alias("word"))
    counts = words.filter(F.char_length("word") >= 6).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n >= 5")


@query(
    f"""
    WITH RECURSIVE table_of_8 AS (
        SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
        FROM (SELECT unnest(range(256)) AS i)),
      runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, {LOWER_SQL}), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
      long AS (SELECT DISTINCT doc_id, run FROM runs WHERE length(run) >= 6),
      spelt AS (SELECT doc_id, run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM long),
      summed AS (
        SELECT doc_id, run, xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) FOR i IN range(length(h) // 2)]),
            lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1]))) AS h
        FROM spelt, table_of_8),
      words AS (
        SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
        FROM runs JOIN summed USING (doc_id, run)),
      counted AS (SELECT word, count(*) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
      less AS (SELECT DISTINCT word, i, left(word, i) || substr(word, i + 2) AS part FROM (SELECT word, unnest(range(length(word))) AS i FROM counted)),
      near AS (
        SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.part = b.part AND length(a.word) = length(b.word) AND a.word <> b.word
        UNION SELECT l.word, c.word FROM less l JOIN counted c ON l.part = c.word
        UNION SELECT c.word, l.word FROM less l JOIN counted c ON l.part = c.word),
      best AS (
        SELECT p.word, count(*) AS n_near, max(n) AS most, min(near) FILTER (n = top) AS form
        FROM (SELECT p.word, near, n, max(n) OVER (PARTITION BY p.word) AS top FROM near p JOIN counted c ON p.near = c.word) p GROUP BY p.word),
      formed AS (
        SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN form END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n
        FROM counted LEFT JOIN best USING (word)),
      chain AS (
        SELECT word, word AS root, form AS next FROM formed
        UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN formed f ON f.word = c.next)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)
    """
)
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_spelt_words(table(spark, folder, "documents").select("doc_id", "text")), ratio=5)


@query(
    f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {LOWER_SQL}), '[.,;:!?\\n-\\r]')) AS piece FROM documents),
      listed AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
      placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
      f1 AS (SELECT lang, w[i] AS phrase, count(*) AS f FROM placed GROUP BY ALL),
      f2 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM placed WHERE i < len(w) GROUP BY ALL HAVING f >= 10),
      f3 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM placed WHERE i + 1 < len(w) GROUP BY ALL HAVING f >= 10),
      total AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
      held AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
      cuts AS (
        SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, x.f AS l, y.f AS r, 1 AS k
        FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.phrase = p.w1 JOIN f1 y ON y.lang = p.lang AND y.phrase = p.w2
          LEFT JOIN held h ON h.lang = p.lang AND h.w1 = p.w1 AND h.w2 = p.w2
        WHERE h.f IS NULL OR 100 * h.f < 50 * p.f
        UNION ALL
        SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, x.f, y.f, 1
        FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.phrase = p.w1 JOIN f2 y ON y.lang = p.lang AND y.w1 = p.w2 AND y.w2 = p.w3
        UNION ALL
        SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, x.f, y.f, 2
        FROM f3 p JOIN f2 x ON x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2 JOIN f1 y ON y.lang = p.lang AND y.phrase = p.w3),
      scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
      lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) JOIN total USING (lang)
    WHERE rank <= 2000
    """
)
def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    found = phrases.collocations(table(spark, folder, "documents").select("lang", "text"))
    return found.withColumnRenamed("grp", "lang")
