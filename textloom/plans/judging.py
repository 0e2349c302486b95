"""Queries on probe outcomes, scores and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import matching
from textloom.functions import text as tx
from textloom.operators import documents, scores, suites
from textloom.plans import models, tables
from textloom.plans.corpus import IS_CODE_SQL, LINES_SQL, REASON_SQL, WORDS_SQL
from textloom.plans.registry import query
from textloom.runtime import scratch_path
from textloom.sources import logs

# Language of a document -> category of the score.
CATEGORIES = {"en": "syntax", "fr": "generation", "de": "perplexity", "es": "perplexity"}
_CATEGORY_SQL = f"CASE lang {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in CATEGORIES.items())} END"
_OUTCOME_SQL = f"""
  outcomes AS (SELECT CASE WHEN {IS_CODE_SQL} THEN 'code' ELSE 'books' END AS run, source AS test, lang, {_CATEGORY_SQL} AS category,
    quality = 1 AS passed FROM labels JOIN documents USING (doc_id)),
  tests AS (SELECT run, category, test, count(*) AS total, count(*) FILTER (passed) AS n_passed, avg(CAST(passed AS INTEGER)) AS score FROM outcomes GROUP BY ALL)"""


def _category():
    category = F.lit(None).cast("string")
    for lang, name in CATEGORIES.items():
        category = F.when(F.col("lang") == lang, name).otherwise(category)
    return category.alias("category")


def _outcomes(spark, folder):
    """Labels as probe outcomes: a document of good quality has passed the test of its source."""
    docs = tables.table(spark, folder, "documents").select("doc_id", "source", "lang")
    return tables.table(spark, folder, "labels").join(docs, "doc_id").select(
        F.when(tables._is_code(F.col("source")), "code").otherwise("books").alias("run"),
        F.col("source").alias("test"),
        _category(),
        (F.col("quality") == 1).alias("passed"),
    )


def _tests(spark, folder):
    return scores.pass_rates(_outcomes(spark, folder), ["run", "category", "test"])


@query(f"WITH {_OUTCOME_SQL} SELECT run, category, test, total, n_passed AS passed, round(score, 6) AS score FROM tests")
def pass_rate(spark, folder):
    return _tests(spark, folder).withColumn("score", F.round("score", 6))


@query(f"WITH {_OUTCOME_SQL} SELECT run, count(*) FILTER (passed) AS passed, count(*) AS total, round(count(*) FILTER (passed) / count(*), 6) AS rate FROM outcomes GROUP BY run")
def pass_total(spark, folder):
    return scores.pass_total(_outcomes(spark, folder), ["run"]).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_OUTCOME_SQL}, c AS (SELECT run, category, avg(score) AS s FROM tests GROUP BY ALL)
SELECT run, category, round(s, 6) AS category_score, round(avg(s) OVER (PARTITION BY run), 6) AS overall_score FROM c
""")
def macro_score(spark, folder):
    """Means of means: no test or category weighs more because it has more probes."""
    out = scores.macro_scores(_tests(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in ("category_score", "overall_score")})


@query(f"""WITH {_OUTCOME_SQL}, c AS (SELECT run, category, avg(score) AS s FROM tests GROUP BY ALL)
SELECT run, round(max(s) FILTER (category = 'syntax'), 6) AS syntax_score, round(max(s) FILTER (category = 'generation'), 6) AS generation_score,
  round(max(s) FILTER (category = 'perplexity'), 6) AS perplexity_score,
  round((max(s) FILTER (category = 'syntax') + max(s) FILTER (category = 'generation') + max(s) FILTER (category = 'perplexity')) / 3, 6) AS overall_score
FROM c GROUP BY run
""")
def score_table(spark, folder):
    wide = scores.wide_scores(_tests(spark, folder))
    return wide.select("run", *[F.round(c, 6).alias(c) for c in wide.columns if c != "run"])


@query(f"""WITH o AS (SELECT source, {_CATEGORY_SQL} AS category, lang, quality FROM labels JOIN documents USING (doc_id)),
t AS (SELECT source, category, lang, avg(quality) AS score FROM o GROUP BY ALL),
c AS (SELECT source, category, avg(score) AS s FROM t GROUP BY ALL),
w AS (SELECT source, max(s) FILTER (category = 'syntax') AS a, max(s) FILTER (category = 'generation') AS b, max(s) FILTER (category = 'perplexity') AS d FROM c GROUP BY source)
SELECT 'best_step_' || regexp_extract(source, '[0-9]+') AS name, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS step,
  round((a + b + d) / 3, 6) AS overall_score, round(a, 6) AS syntax_score, round(b, 6) AS generation_score, round(p, 6) AS average_perplexity
FROM w JOIN (SELECT source, avg(n_chars) AS p FROM documents GROUP BY source) USING (source)
""")
def checkpoint_report(spark, folder):
    """Sources as checkpoints, their languages as tests, their mean length in place of a perplexity."""
    docs = tables.table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    number = F.regexp_extract("source", "[0-9]+", 0)
    outcomes = tables.table(spark, folder, "labels").join(docs, "doc_id").select(
        "source", F.col("lang").alias("test"), _category(), (F.col("quality") == 1).alias("passed")
    )
    wide = scores.wide_scores(scores.pass_rates(outcomes, ["source", "category", "test"]), ["source"])
    lengths = docs.groupBy("source").agg(F.avg("n_chars").alias("average_perplexity"))
    named = wide.join(lengths, "source").select(
        F.concat(F.lit("best_step_"), number).alias("name"), number.cast("bigint").alias("step"),
        *[F.round(c, 6).alias(c) for c in ("overall_score", "syntax_score", "generation_score", "average_perplexity")],
    )
    return scores.report(named)


_TURN_SQL = r"""
  turns AS (SELECT conv_id, turn, text AS predicted, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM conversations),
  judged AS (SELECT conv_id, turn, predicted, prompt, regexp_extract_all(lower(prompt), '[\p{L}\p{N}\p{M}_]+') AS acceptable
    FROM turns WHERE prompt IS NOT NULL)"""


def _kinds_sql() -> str:
    return ", ".join(
        f"(SELECT {models.MATCH_SQL} FROM (SELECT '{kind}' AS match_kind)) AS {kind}" for kind in matching.MATCH_KINDS
    )


@query(f"WITH {_TURN_SQL} SELECT conv_id, turn, {_kinds_sql()} FROM judged")
def probe_match(spark, folder):
    """Each turn judged against the words of the turn before it, by every rule."""
    turns = tables.texts(spark, folder, "conversations", "conv_id", "conv_id", "turn", "text")
    # a conversation is a bounded exchange, so the turn before is a self-join on (conversation, turn)
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    probes = before.withColumn(
        "acceptable", F.regexp_extract_all(F.lower("prompt"), F.lit(r"(?U)\w+"), F.lit(0))
    )
    paired = turns.join(probes, ["conv_id", "turn"])
    rules = matching.match_columns(F.col("text"), F.col("acceptable"), F.col("prompt"))
    return paired.select("conv_id", "turn", *[rule.alias(kind) for kind, rule in rules.items()])


@query(f"""
SELECT source AS run, suite, CAST(probe_id AS BIGINT) AS probe_id, test, prompt
FROM (SELECT DISTINCT source, CASE CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 3 WHEN 0 THEN 'micro' WHEN 1 THEN 'prompt' ELSE 'code' END AS suite FROM documents)
JOIN {models._probe_values()} USING (suite)
""")
def run_probes(spark, folder):
    """Every run with each probe of the suite it is evaluated on."""
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int") % 3
    runs = tables.table(spark, folder, "documents").select(
        F.col("source").alias("run"),
        F.when(number == 0, "micro").when(number == 1, "prompt").otherwise("code").alias("suite"),
    ).distinct()
    return scores.every_run(runs, suites.probes(spark)).select(
        "run", "suite", F.col("probe_id").cast("bigint").alias("probe_id"), "test", "prompt"
    )


_METRICS = ("lines", "words", "chars")
_METRIC_SQL = f"""
  totals AS (SELECT {IS_CODE_SQL} AS is_code, avg({LINES_SQL}) AS lines, avg({WORDS_SQL}) AS words, avg(length(text)) AS chars FROM documents GROUP BY 1),
  metrics AS (UNPIVOT totals ON lines, words, chars INTO NAME metric VALUE value)"""


@query(f"""WITH {_METRIC_SQL}
SELECT b.metric AS baseline_metric, i.metric AS improved_metric, round(b.value, 6) AS baseline_value, round(i.value, 6) AS improved_value,
  round(CASE WHEN b.metric = 'chars' THEN (b.value - i.value) / b.value * 100 ELSE (i.value - b.value) * 100 END, 4) AS change
FROM metrics b JOIN metrics i ON b.metric = i.metric AND b.is_code AND NOT i.is_code
UNION ALL SELECT 'words', 'absent', round(value, 6), NULL, NULL FROM metrics WHERE is_code AND metric = 'words'
""")
def run_compare(spark, folder):
    """Two runs (code and books) compared metric by metric; a metric without a partner stays."""
    docs = tables.documents(spark, folder)
    t = F.col("text")
    wide = docs.groupBy(tables._is_code(F.col("source")).alias("is_code")).agg(
        F.avg(tx.n_lines(t)).alias("lines"), F.avg(tx.n_words(t)).alias("words"), F.avg(F.length(t)).alias("chars")
    )
    metrics = scores.long_metrics(wide, _METRICS, ["is_code"])
    pairs = spark.createDataFrame(
        [(m, m) for m in _METRICS] + [("words", "absent")], "baseline_metric string, improved_metric string"
    )
    out = scores.compared(metrics.filter("is_code"), metrics.filter("not is_code"), pairs, ["chars"])
    return out.withColumns(
        {"baseline_value": F.round("baseline_value", 6), "improved_value": F.round("improved_value", 6), "change": F.round("change", 4)}
    )


@query(f"""WITH {_OUTCOME_SQL}
SELECT run, test, count(*) AS rows, count(*) FILTER (passed) AS passed FROM outcomes GROUP BY ALL
""")
def result_roundtrip(spark, folder):
    """Write outcomes as JSON per run, read them back."""
    path = scratch_path(spark, "results")
    logs.write_results(_outcomes(spark, folder), path)
    back = spark.read.schema("test string, category string, passed boolean, run string").json(path)
    return back.groupBy("run", "test").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("passed").alias("passed")
    )


@query(f"""WITH {_OUTCOME_SQL}
SELECT test, processed, skipped, lines, round(score, 6) AS score FROM
  (SELECT test, avg(CAST(passed AS INTEGER)) AS score FROM outcomes GROUP BY test) JOIN
  (SELECT source AS test, count(*) FILTER (reason IS NULL) AS processed, count(*) FILTER (reason IS NOT NULL) AS skipped,
      CAST(sum({LINES_SQL}) FILTER (reason IS NULL) AS BIGINT) AS lines
    FROM (SELECT *, {REASON_SQL} AS reason FROM documents) GROUP BY source) USING (test)
""")
def source_report(spark, folder):
    """Intake and quality of each source side by side."""
    intake = documents.intake_report(tables.documents(spark, folder), ["source"]).withColumnRenamed("source", "test")
    rates = scores.pass_rates(_outcomes(spark, folder), ["test"])
    return rates.join(intake, "test").select("test", "processed", "skipped", "lines", F.round("score", 6).alias("score"))
