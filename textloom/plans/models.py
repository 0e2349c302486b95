"""Queries on next-token models: scores, distributions, draws, continuations, probe suites."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as tx

from textloom.operators import generation, ngram, sampling, suites, whole
from textloom.plans import tables
from textloom.plans.corpus import draw_sql
from textloom.plans.registry import query
from textloom.plans.tokens import BYTE_WORDS_SQL, WORDS_SQL

ALPHA, SEED = 0.1, 11
TEMPERATURE, TOP_K, TOP_P = 0.8, 50, 0.9
GREEDY_TOKENS, SAMPLED_TOKENS = 50, 50


def _docs(spark, folder, scheme="word", *columns):
    docs = tables.documents(spark, folder, "doc_id", "text", *columns)
    return docs.select("doc_id", *columns, tx.pretokens(F.col("text"), scheme).alias("tokens"))


def _model(spark, folder, scheme="word"):
    return ngram.fit(_docs(spark, folder, scheme), alpha=ALPHA)


def _model_sql(words: str = WORDS_SQL, order: int = 2) -> str:
    context = "w[i]" if order == 2 else "w[i] || chr(31) || w[i + 1]"
    return f"""
  words AS (SELECT doc_id, source, {words} AS w FROM documents),
  seen AS (SELECT doc_id, source, {context} AS context, w[i + {order - 1}] AS token
    FROM (SELECT doc_id, source, w, unnest(range(1, CAST(len(w) AS BIGINT) - {order - 2})) AS i FROM words)),
  pairs AS MATERIALIZED (SELECT context, token, count(*) AS n FROM seen GROUP BY ALL),
  contexts AS MATERIALIZED (SELECT context, sum(n) AS total FROM pairs GROUP BY context),
  size AS (SELECT count(*)::DOUBLE AS v FROM (SELECT unnest(w) AS t FROM words WHERE len(w) >= {order} GROUP BY 1)),
  dist AS MATERIALIZED (SELECT context, token, n, ln((n + 0.1::DOUBLE) / (total + 0.1::DOUBLE * v)) AS logit
    FROM pairs JOIN contexts USING (context), size)"""


_CHOICE_SQL = """
  greedy AS MATERIALIZED (SELECT context, token FROM (SELECT context, token, row_number() OVER (PARTITION BY context ORDER BY n DESC, token) AS k FROM pairs) WHERE k = 1),
  common AS MATERIALIZED (SELECT token FROM (SELECT token, sum(n) AS n FROM pairs GROUP BY token) ORDER BY n DESC, token LIMIT 1)"""


@query(f"WITH {_model_sql()} SELECT context, token, round(logit, 6) AS logit FROM dist")
def bigram_model(spark, folder):
    return _model(spark, folder).distribution().withColumn("logit", F.round("logit", 6))


_LOSS_SQL = """
SELECT {key}, count(*) AS targets, round(avg(-ln((coalesce(n, 0) + 0.1::DOUBLE) / (coalesce(total, 0) + 0.1::DOUBLE * v))), 6) AS loss,
  round(exp(avg(-ln((coalesce(n, 0) + 0.1::DOUBLE) / (coalesce(total, 0) + 0.1::DOUBLE * v)))), 3) AS perplexity
FROM asked LEFT JOIN pairs USING (context, token) LEFT JOIN contexts USING (context), size GROUP BY ALL"""


def _shown(scored):
    return scored.withColumns({"loss": F.round("loss", 6), "perplexity": F.round("perplexity", 3)})


@query(f"WITH {_model_sql()}, asked AS (SELECT doc_id, context, token FROM seen) {_LOSS_SQL.format(key='doc_id')}")
def doc_perplexity(spark, folder):
    docs = _docs(spark, folder)
    return _shown(ngram.text_perplexity(docs, ngram.fit(docs, alpha=ALPHA), ["doc_id"], in_sample=True))


@query(f"WITH {_model_sql(order=3)}, asked AS (SELECT doc_id, context, token FROM seen) {_LOSS_SQL.format(key='doc_id')}")
def trigram_perplexity(spark, folder):
    docs = _docs(spark, folder)
    return _shown(ngram.text_perplexity(docs, ngram.fit(docs, order=3, alpha=ALPHA), ["doc_id"], in_sample=True))


@query(f"""WITH {_model_sql()},
asked AS (SELECT conv_id, turn, w[i] AS context, w[i + 1] AS token FROM
  (SELECT conv_id, turn, w, unnest(range(1, CAST(len(w) AS BIGINT))) AS i FROM (SELECT conv_id, turn, {WORDS_SQL} AS w FROM conversations)))
{_LOSS_SQL.format(key='conv_id, turn')}""")
def heldout_perplexity(spark, folder):
    """Conversations under a model of the documents: many pairs are unseen."""
    turns = tables.texts(spark, folder, "conversations", "conv_id", "conv_id", "turn", "text")
    turns = turns.select("conv_id", "turn", tx.words_of(F.col("text")).alias("tokens"))
    return _shown(ngram.text_perplexity(turns, _model(spark, folder), ["conv_id", "turn"]))


@query(f"""WITH {_model_sql()},
scored AS (SELECT source, doc_id, exp(avg(-logit)) AS p FROM seen JOIN dist USING (context, token) GROUP BY ALL)
SELECT source, round(avg(p), 3) AS average_perplexity, CASE WHEN avg(p) < 50 THEN 1.0::DOUBLE WHEN avg(p) < 100 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM scored GROUP BY source
""")
def mean_perplexity(spark, folder):
    docs = _docs(spark, folder, "word", "source")
    scored = ngram.text_perplexity(docs, ngram.fit(docs, alpha=ALPHA), ["source", "doc_id"], in_sample=True)
    return ngram.mean_perplexity(scored, ["source"]).withColumn(
        "average_perplexity", F.round("average_perplexity", 3)
    )


@query(f"WITH {_model_sql()}, {_CHOICE_SQL} SELECT context, token FROM greedy")
def next_token(spark, folder):
    # within a context the order of counts is that of probabilities
    return ngram.greedy(_model(spark, folder).counts, weight="n")


def _logged(dist):
    # logarithms, because probabilities often lie exactly between two rounded values
    return dist.select("context", "token", F.round(F.log("probability"), 6).alias("log_probability"))


@query(f"""WITH {_model_sql()}, peak AS (SELECT *, max(logit) OVER (PARTITION BY context) AS m FROM dist)
SELECT context, token, round(ln(exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY context)), 6) AS log_probability FROM peak
""")
def softmax_probability(spark, folder):
    dist = sampling.softmax(_model(spark, folder).distribution(placed=True), place="place")
    return _logged(dist)


def _whole_sql(keep: str, spread: str) -> str:
    """Kept tokens of each context, ``laid``, and what the unseen ones get, ``rests``."""
    return f"""
  vocabulary AS MATERIALIZED (SELECT t AS token, row_number() OVER (ORDER BY t) - 1 AS place
    FROM (SELECT DISTINCT unnest(w) AS t FROM words WHERE len(w) >= 2)),
  stats AS (SELECT context, count(*) AS seen, max(n) AS most FROM pairs GROUP BY context),
  ranked AS (
    SELECT context, token, n, most, CASE WHEN seen < {TOP_K} THEN v - seen ELSE 0 END AS others,
      exp(ln((n + 0.1::DOUBLE) / (most + 0.1::DOUBLE)) * {1 / TEMPERATURE}::DOUBLE) AS w,
      exp(ln(0.1::DOUBLE / (most + 0.1::DOUBLE)) * {1 / TEMPERATURE}::DOUBLE) AS u
    FROM (SELECT *, rank() OVER (PARTITION BY context ORDER BY n DESC) AS r FROM pairs) JOIN stats USING (context), size WHERE r <= {TOP_K}),
  summed AS (
    SELECT *, row_number() OVER near AS i, coalesce(sum(w) OVER (near ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(w) OVER (PARTITION BY context) AS mass, sum(w) OVER (PARTITION BY context) + others * u AS z
    FROM ranked WINDOW near AS (PARTITION BY context ORDER BY n DESC, token)),
  marked AS (SELECT *, {keep} AS keep FROM summed),
  rests AS MATERIALIZED (
    SELECT *, kept = 0 AND spread = 0 AS even, prefix + spread * u AS whole FROM (
      SELECT context, any_value(u) AS u, count(*) FILTER (keep) AS kept, coalesce(max(before + w) FILTER (keep), 0) AS prefix,
        least(any_value(others), greatest(0, {spread}((any_value({TOP_P} - mass / z)) / any_value(u / z)))) AS spread
      FROM marked GROUP BY context)),
  laid AS MATERIALIZED (
    SELECT context, token, w / whole AS probability, before / whole AS low,
      coalesce(lead(before / whole) OVER (PARTITION BY context ORDER BY i), CASE WHEN spread > 0 THEN prefix / whole ELSE 2 END) AS high
    FROM marked JOIN rests USING (context) WHERE keep)"""


_STANDARD_SQL = _whole_sql(f"before / z < {TOP_P} OR row_number() OVER (PARTITION BY context ORDER BY n DESC, token) = 1", "ceil")
_STRICT_SQL = _whole_sql(f"(before + w) / z <= {TOP_P}", "floor")
_LISTED_SQL = """
SELECT context, token, round(ln(probability), 6) AS log_probability, 1::BIGINT AS tokens FROM laid
UNION ALL
SELECT context, NULL, round(ln(CASE WHEN even THEN 1 / v ELSE u / whole END), 6), CAST(CASE WHEN even THEN v ELSE spread END AS BIGINT)
FROM rests, size WHERE even OR spread > 0"""


def _whole(spark, folder, nucleus="standard", draws=True):
    return whole.fit_whole(_model(spark, folder), TEMPERATURE, TOP_K, TOP_P, nucleus, draws)


def _listed(kept):
    rows = whole.listed(kept)
    return rows.select("context", "token", F.round(F.log("probability"), 6).alias("log_probability"), "tokens")


@query(f"WITH {_model_sql()}, {_STANDARD_SQL} {_LISTED_SQL}")
def topk_topp(spark, folder):
    """Kept tokens of each context; those that were never seen after it are one row."""
    return _listed(_whole(spark, folder, draws=False))


@query(f"WITH {_model_sql()}, {_STRICT_SQL} {_LISTED_SQL}")
def topk_topp_strict(spark, folder):
    """The nucleus rule without a shift: the crossing token goes, too, and with nothing left all tokens are as likely."""
    return _listed(_whole(spark, folder, "strict", draws=False))


# the tokens unseen after a context are addressed by their place in the order of the vocabulary
_DRAW_SQL = f"""
  places AS MATERIALIZED (
    SELECT context, list(place ORDER BY place) AS places FROM pairs JOIN vocabulary USING (token)
    WHERE context IN (SELECT context FROM rests WHERE spread > 0) GROUP BY context),
  alone AS (SELECT least(v, ceil({TOP_P} / (1 / v))) AS alone FROM size)"""


def _drawn_sql(asked: str) -> str:
    """``asked(*, context, x)`` with the drawn ``token``."""
    return f"""(
    SELECT d.* EXCLUDE (inner_token, among, places), coalesce(inner_token, t.token) AS token
    FROM (
      SELECT a.*, l.token AS inner_token, p.places,
        CASE WHEN r.context IS NULL THEN least(floor(x * alone), alone - 1)
          WHEN r.spread > 0 AND x >= prefix / whole THEN least(floor((x - prefix / whole) / (1 - prefix / whole) * spread), spread - 1) END AS among
      FROM {asked} a LEFT JOIN rests r ON r.context = a.context LEFT JOIN places p ON p.context = a.context AND r.spread > 0
        LEFT JOIN laid l ON l.context = a.context AND x >= l.low AND x < l.high, alone) d
    LEFT JOIN vocabulary t ON t.place = among + coalesce(len(list_filter(places, lambda s, i: s - i + 1 <= among)), 0))"""


def _prompts(spark, folder):
    turns = tables.texts(spark, folder, "conversations", "conv_id", "conv_id", "turn", "role", "text")
    return turns.filter("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("prompt_id"), tx.words_of(F.col("text")).alias("tokens")
    )


_PROMPTS_SQL = f"""
  prompts AS (SELECT conv_id || '-' || turn AS prompt_id, w[-1] AS context FROM
    (SELECT conv_id, turn, {WORDS_SQL} AS w FROM conversations WHERE role = 'user'))"""


@query(f"""WITH {_model_sql()}, {_STANDARD_SQL}, {_DRAW_SQL}, {_PROMPTS_SQL},
asked AS (SELECT *, {draw_sql(f"'{SEED}:' || prompt_id")} AS x FROM prompts)
SELECT prompt_id, token FROM {_drawn_sql("asked")}
""")
def sample_next(spark, folder):
    """A token for each prompt; one that ends in an unknown word draws from the whole vocabulary."""
    asked = _prompts(spark, folder).select("prompt_id", generation.last_context(F.col("tokens")).alias("context"))
    return whole.sample_next(asked, _whole(spark, folder), "prompt_id", SEED).select("prompt_id", "token")


@query(f"""WITH RECURSIVE {_model_sql()}, {_STANDARD_SQL}, {_DRAW_SQL}, {_PROMPTS_SQL},
walk AS (
  SELECT prompt_id, 0 AS step, context, '' AS continuation FROM prompts
  UNION ALL
  SELECT prompt_id, step + 1, token, continuation || ' ' || token
  FROM {_drawn_sql(f"(SELECT *, {draw_sql(f"'{SEED}:' || prompt_id || ':' || step")} AS x FROM walk WHERE step < {SAMPLED_TOKENS})")})
SELECT prompt_id, trim(continuation) AS continuation FROM walk WHERE step = {SAMPLED_TOKENS}
""")
def sample_continue(spark, folder):
    done = whole.continue_sampled(_prompts(spark, folder), _whole(spark, folder), "prompt_id", SAMPLED_TOKENS, seed=SEED)
    return done.select("prompt_id", F.array_join("new_tokens", " ").alias("continuation"))


@query(f"""WITH RECURSIVE {_model_sql()}, {_CHOICE_SQL}, {_PROMPTS_SQL},
walk AS (
  SELECT prompt_id, 0 AS step, context, '' AS continuation FROM prompts
  UNION ALL
  SELECT prompt_id, step + 1, t, continuation || ' ' || t FROM (
    SELECT prompt_id, step, continuation, coalesce(g.token, c.token) AS t
    FROM walk w LEFT JOIN greedy g ON g.context = w.context, common c WHERE step < {GREEDY_TOKENS}))
SELECT prompt_id, trim(continuation) AS continuation FROM walk WHERE step = {GREEDY_TOKENS}
""")
def greedy_continue(spark, folder):
    done = generation.continue_greedily(_prompts(spark, folder), _model(spark, folder), GREEDY_TOKENS)
    return done.select("prompt_id", F.array_join("new_tokens", " ").alias("continuation"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _probe_values() -> str:
    rows = [
        f"({_quoted(suite)}, {i}, {_quoted(test)}, {_quoted(category)}, {_quoted(kind)}, {n}, {_quoted(stop)}, {_quoted(prompt)},"
        f" CAST([{', '.join(map(_quoted, answers))}] AS VARCHAR[]))"
        for suite, members in suites.PROBES.items()
        for i, (test, category, kind, n, stop, prompt, answers) in enumerate(members)
    ]
    return f"(VALUES {', '.join(rows)}) p(suite, probe_id, test, category, match_kind, max_tokens, stop_kind, prompt, acceptable)"


def _prompt_word_sql() -> str:
    return BYTE_WORDS_SQL.replace("(text,", "(prompt,")


_STRIP_SQL = r"regexp_replace(predicted, '^\s+|\s+$', '', 'g')"
_FIVE_SQL = "|".join(c * 5 for c in "abcdefghijklmnopqrstuvwxyz")
MATCH_SQL = f"""CASE match_kind WHEN 'equal' THEN predicted = acceptable[1]
    WHEN 'stripped_equal' THEN {_STRIP_SQL} = acceptable[1]
    WHEN 'lower_contains_any' THEN len(list_filter(acceptable, lambda a: contains(lower(predicted), a))) > 0
    WHEN 'contains' THEN contains(predicted, acceptable[1])
    WHEN 'starts_or_contains_any' THEN len(list_filter(acceptable, lambda a: contains({_STRIP_SQL}, a))) > 0
    WHEN 'not_closing' THEN {_STRIP_SQL} NOT IN ('}}', ')', ']', '')
    WHEN 'keyword_anywhere' THEN len(list_filter(acceptable, lambda a: contains(prompt || predicted, a))) > 0
    WHEN 'stripped_starts' THEN starts_with({_STRIP_SQL}, acceptable[1])
    WHEN 'contains_any' THEN len(list_filter(acceptable, lambda a: contains({_STRIP_SQL}, a))) > 0
    WHEN 'docstring' THEN length({_STRIP_SQL}) > 5 AND NOT regexp_matches(predicted, '{_FIVE_SQL}') END"""


_ANSWER_SQL = f"""
walk AS (
  SELECT suite, probe_id, 0 AS step, context, '' AS predicted, FALSE AS done FROM asked
  UNION ALL
  SELECT suite, probe_id, step + 1, t, predicted || t, CASE stop_kind WHEN 'newline' THEN contains(t, chr(10))
      WHEN 'docstring' THEN contains(predicted || t, '\"\"\"')
      WHEN 'block' THEN length(predicted || t) > 5 AND (contains(predicted || t, chr(10) || chr(10))
        OR contains(substr(predicted || t, 6), 'def ') OR contains(substr(predicted || t, 6), 'class ')) ELSE FALSE END
  FROM (SELECT w.suite, w.probe_id, step, predicted, stop_kind, coalesce(g.token, c.token) AS t
    FROM walk w JOIN asked USING (suite, probe_id) LEFT JOIN greedy g ON g.context = w.context, common c
    WHERE NOT done AND step < max_tokens))
"""


@query(f"""WITH RECURSIVE {_model_sql(BYTE_WORDS_SQL)}, {_CHOICE_SQL},
asked AS MATERIALIZED (SELECT *, {_prompt_word_sql()}[-1] AS context FROM {_probe_values()}), {_ANSWER_SQL},
final AS (SELECT suite, probe_id, arg_max(predicted, step) AS predicted FROM walk GROUP BY ALL)
SELECT suite, CAST(probe_id AS BIGINT) AS probe_id, test, predicted, {MATCH_SQL} AS passed FROM final JOIN asked USING (suite, probe_id)
""")
def suite_answers(spark, folder):
    """Every probe of every suite, answered by a model of the documents."""
    judged = suites.evaluate(suites.probes(spark), _model(spark, folder, "byte"))
    return judged.select("suite", F.col("probe_id").cast("bigint").alias("probe_id"), "test", "predicted", "passed")


@query()
def suite_scores(spark, folder):
    """The prompt suite for two models, one of code sources and one of books."""
    docs = _docs(spark, folder, "byte", "source")
    is_code = tables._is_code(F.col("source"))
    models = {"code": ngram.fit(docs.filter(is_code), alpha=ALPHA), "books": ngram.fit(docs.filter(~is_code), alpha=ALPHA)}
    return suites.compare_runs(spark, models)
