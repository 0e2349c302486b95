"""Queries on documents, corpora and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import corpus, documents, order
from textloom.operators.order import BASES, PRIME
from textloom.plans import tables
from textloom.plans.registry import query
from textloom.runtime import scratch_path
from textloom.sources import files

BOOK_LINES = 20
CODE_WEIGHT = 3

# DuckDB forms of the text rules.
_STRIPPED = r"regexp_replace(text, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g')"
REASON_SQL = f"""CASE WHEN {_STRIPPED} = '' THEN 'blank'
      WHEN {_STRIPPED} = '404: Not Found' THEN 'not_found'
      WHEN length(text) < 10 THEN 'short' END"""
LINES_SQL = "CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT)"
WORDS_SQL = r"CAST(len(regexp_extract_all(text, '[^\s\x{85}\p{Z}]+')) AS BIGINT)"
IS_CODE_SQL = "CAST(regexp_extract(source, '[0-9]+') AS INTEGER) < 10"
EXCERPT_SQL = f"""CASE WHEN len(string_split(text, chr(10))) > {BOOK_LINES}
      THEN array_to_string(list_slice(string_split(text, chr(10)), 1, {BOOK_LINES}), chr(10)) || chr(10)
      ELSE text END"""
NAME_SQL = "source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0')"


@query(f"""
SELECT source, count(*) FILTER (reason IS NULL) AS processed, count(*) FILTER (reason IS NOT NULL) AS skipped,
  CAST(sum(CASE WHEN reason IS NULL THEN {LINES_SQL} END) AS BIGINT) AS lines,
  CAST(sum(CASE WHEN reason IS NULL THEN {WORDS_SQL} END) AS BIGINT) AS words,
  CAST(sum(CASE WHEN reason IS NULL THEN length(text) END) AS BIGINT) AS chars
FROM (SELECT *, {REASON_SQL} AS reason FROM documents) GROUP BY source
""")
def corpus_stats(spark, folder):
    return documents.intake_report(tables.documents(spark, folder), ["source"])


@query(f"""
SELECT doc_id, reason, left(replace(text, chr(10), '\\n'), 50) AS shown
FROM (SELECT *, {REASON_SQL} AS reason FROM documents) WHERE reason IS NOT NULL
""")
def invalid_docs(spark, folder):
    bad = documents.rejected(tables.documents(spark, folder, "doc_id", "text"))
    return bad.select("doc_id", "reason", tx.clip(F.col("text"), 50).alias("shown"))


@query(f"""
SELECT doc_id, {LINES_SQL} AS lines, CAST(length(text) AS BIGINT) AS chars, md5(text) AS digest
FROM (SELECT doc_id, {EXCERPT_SQL} AS text FROM documents WHERE NOT ({IS_CODE_SQL}))
""")
def book_excerpt(spark, folder):
    books = tables.documents(spark, folder, "doc_id", "text", "source").filter(~tables._is_code(F.col("source")))
    text = F.col("text")
    return corpus.excerpts(books, BOOK_LINES).select(
        "doc_id", tx.n_lines(text).alias("lines"), F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("digest")
    )


_PIECES_SQL = f"""
  mixed AS (
    SELECT 1 AS section, copy, 'code' AS kind, {NAME_SQL} AS name, text
    FROM (SELECT *, {REASON_SQL} AS reason FROM documents WHERE {IS_CODE_SQL}), range(1, {CODE_WEIGHT} + 1) r(copy)
    WHERE reason IS NULL
    UNION ALL
    SELECT 2, 1, 'book', {NAME_SQL}, {EXCERPT_SQL} FROM documents WHERE NOT ({IS_CODE_SQL})),
  pieces AS (
    SELECT section, copy, 1 AS place, kind, name,
      CASE WHEN kind = 'code' THEN '# File: ' || regexp_extract(name, '[^/]+$') || chr(10)
        ELSE chr(10) || '# === BOOK EXCERPT: ' || regexp_extract(name, '[^/]+$') || ' ===' || chr(10) || chr(10) END
      || text || chr(10) || chr(10) AS piece
    FROM mixed
    UNION ALL
    SELECT 1, i, 0, 'mark', '', '# === CODE SECTION ' || i || '/{CODE_WEIGHT} ===' || chr(10) || chr(10)
    FROM range(1, {CODE_WEIGHT} + 1) r(i)
    UNION ALL
    SELECT 1, i, 2, 'mark', '', chr(10) || chr(10) FROM range(1, {CODE_WEIGHT} + 1) r(i))
"""


def _mixture(spark, folder):
    code, books = tables.code_and_books(spark, folder)
    return corpus.mixture(code, books, CODE_WEIGHT, BOOK_LINES)


@query(f"""WITH {_PIECES_SQL}
SELECT CAST(section AS BIGINT) AS section, CAST(copy AS BIGINT) AS copy, CAST(place AS BIGINT) AS place, kind, name,
  CAST(length(piece) AS BIGINT) AS chars, md5(piece) AS digest FROM pieces
""")
def mixed_corpus(spark, folder):
    pieces = corpus.rendered(_mixture(spark, folder), CODE_WEIGHT)
    return pieces.select(
        *[F.col(c).cast("bigint").alias(c) for c in ("section", "copy", "place")],
        "kind", "name", F.length("piece").cast("bigint").alias("chars"), F.md5("piece").alias("digest"),
    )


@query(f"""WITH {_PIECES_SQL}
SELECT kind, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars,
  round(sum(length(text)) / sum(sum(length(text))) OVER (), 6) AS share
FROM mixed GROUP BY kind
""")
def corpus_share(spark, folder):
    return corpus.shares(_mixture(spark, folder)).withColumn("share", F.round("share", 6))


@query(f"""
WITH {_PIECES_SQL}, t AS (
  SELECT sum(length(text)) FILTER (kind = 'code' AND copy = 1)::DOUBLE AS c, sum(length(text)) FILTER (kind = 'book')::DOUBLE AS b
  FROM mixed),
w AS (SELECT c, b, greatest(floor(b * 0.8::DOUBLE / (c * 0.2::DOUBLE)), 1) AS lo,
  greatest(ceil(b * 0.8::DOUBLE / (c * 0.2::DOUBLE)), 1) AS hi FROM t),
p AS (SELECT *, CASE WHEN abs(lo * c / (lo * c + b) - 0.8) <= abs(hi * c / (hi * c + b) - 0.8) THEN lo ELSE hi END AS k FROM w)
SELECT CAST(c AS BIGINT) AS code_chars, CAST(b AS BIGINT) AS book_chars, CAST(k AS BIGINT) AS code_weight,
  round(k * c / (k * c + b), 6) AS code_share FROM p
""")
def share_weight(spark, folder):
    code, books = tables.code_and_books(spark, folder)
    return corpus.weight_for_share(code, books, 0.8, BOOK_LINES).withColumn("code_share", F.round("code_share", 6))


@query(f"""WITH {_PIECES_SQL}
SELECT kind, count(*) AS documents, CAST(sum({LINES_SQL}) AS BIGINT) AS lines, CAST(sum({WORDS_SQL}) AS BIGINT) AS words,
  CAST(sum(length(text)) AS BIGINT) AS chars FROM mixed GROUP BY kind
""")
def corpus_status(spark, folder):
    return documents.corpus_stats(_mixture(spark, folder), ["kind"])


def _digest_sql(base: int, first: int) -> str:
    """Eight digits of each line's MD5 times the base to the power of its place, which has up to 24 bits."""
    powers = ", ".join(f"CASE WHEN (i >> {k}) & 1 = 1 THEN {pow(base, 1 << k, PRIME)} ELSE 1 END" for k in range(24))
    sign = f"CAST('0x' || substr(md5(line), {first}, 8) AS BIGINT) % {PRIME}"
    return f"sum(({sign}) * list_reduce([{powers}]::BIGINT[], lambda a, b: a * b % {PRIME}) % {PRIME}) % {PRIME}"


@query(f"""WITH {_PIECES_SQL},
whole AS (SELECT string_agg(piece, '' ORDER BY section, copy, place, name) AS text FROM pieces),
listed AS (SELECT generate_subscripts(w, 1) - 1 AS i, unnest(w) AS line FROM (SELECT string_split(left(text, length(text) - 1), chr(10)) AS w FROM whole))
SELECT {LINES_SQL} - 1 AS newlines, {WORDS_SQL} AS words, CAST(length(text) AS BIGINT) AS chars,
  (SELECT CAST(({_digest_sql(BASES[0], 1)}) * {1 << 31} + {_digest_sql(BASES[1], 9)} AS BIGINT) FROM listed) AS digest
FROM whole
""")
def corpus_text_roundtrip(spark, folder):
    """Write the corpus text, read its lines back in splits, count, and prove their order."""
    path = scratch_path(spark, "corpus")
    files.write_corpus_text(corpus.rendered(_mixture(spark, folder), CODE_WEIGHT), path)
    also = [F.sum(tx.n_words(F.col("line"))).alias("words"), F.sum(F.length("line").cast("bigint") + 1).alias("chars")]
    proof = order.order_digest(files.scan_lines(spark, path, line_sep="\n"), "place", "line", also=also)
    return proof.withColumnRenamed("rows", "newlines")


@query(f"""WITH {_PIECES_SQL}
SELECT CAST(copy AS BIGINT) AS copy, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars
FROM mixed WHERE kind = 'code' GROUP BY copy
""")
def corpus_table_roundtrip(spark, folder):
    """Write the corpus partitioned by kind, read one kind back."""
    path = scratch_path(spark, "corpus-table")
    files.write_corpus_table(_mixture(spark, folder), path)
    return (
        files.read_corpus_table(spark, path).filter("kind = 'code'")
        .groupBy(F.col("copy").cast("bigint").alias("copy"))
        .agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text").cast("bigint")).alias("chars"))
    )


@query("""
SELECT name, CAST(i - 1 AS BIGINT) AS line_no, md5(lines[i]) AS digest
FROM (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name, string_split(text, chr(10)) AS lines FROM documents),
  LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)
""")
def source_lines(spark, folder):
    code, books = tables.code_and_books(spark, folder)
    return files.lines_of(code.unionByName(books)).select(
        "name", F.col("line_no").cast("bigint").alias("line_no"), F.md5("line").alias("digest")
    )


def draw_sql(text: str) -> str:
    """DuckDB form of a draw: 52 bits of an MD5 as a number in [0, 1)."""
    return f"(CAST('0x' || left(md5({text}), 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


@query(f"""
SELECT doc_id, CASE WHEN {draw_sql("'7:' || text")} < 0.05 THEN 'validation' ELSE 'train' END AS part FROM documents
""")
def split_group(spark, folder):
    docs = tables.documents(spark, folder, "doc_id", "text")
    return corpus.split_by_group(docs, F.col("text"), 0.05, seed=7).select("doc_id", "part")


@query("""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('7:' || doc_id)) <= floor((SELECT count(*) FROM documents) * 0.05::DOUBLE)
  THEN 'validation' ELSE 'train' END AS part FROM documents
""")
def split_sample(spark, folder):
    docs = tables.table(spark, folder, "documents").select("doc_id")
    return corpus.split_by_sample(docs, "doc_id", 0.05, seed=7)


@query("""
SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS place FROM documents
""")
def shuffle_order(spark, folder):
    """The place of each document in the shuffled order."""
    docs = tables.table(spark, folder, "documents").select("doc_id")
    return corpus.shuffle_places(docs, "doc_id", seed=7)
