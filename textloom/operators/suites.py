"""The probe suites and their evaluation on next-token models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import generation, ngram, scores

# The probes of each suite, as (test, category, match kind, new tokens, stop rule, prompt, answers).
PROBES = {
    "micro": (
        ("bracket_test", "micro", "equal", 1, "none", "(", [")"]),
        ("repeat_test", "micro", "stripped_equal", 1, "none", "hello hello ", ["hello"]),
        ("alphabet_test", "micro", "stripped_equal", 1, "none", "a b c ", ["d"]),
        ("sentence_test", "micro", "lower_contains_any", 1, "none", "Once upon a", ["time", "a"]),
    ),
    "prompt": (
        ("bracket_completion", "syntax", "contains", 1, "none", "(", [")"]),
        ("bracket_completion", "syntax", "contains", 1, "none", "[", ["]"]),
        ("bracket_completion", "syntax", "contains", 1, "none", "{", ["}"]),
        ("bracket_completion", "syntax", "contains", 1, "none", "def func(", [")"]),
        ("bracket_completion", "syntax", "contains", 1, "none", "my_list[", ["]"]),
        ("keyword_completion", "syntax", "starts_or_contains_any", 1, "none", "def ",
         ["func", "main", "test", "get", "set", "is"]),
        ("keyword_completion", "syntax", "starts_or_contains_any", 1, "none", "import ",
         ["torch", "os", "sys", "numpy", "math"]),
        ("keyword_completion", "syntax", "starts_or_contains_any", 1, "none", "class ",
         ["M", "G", "T", "C", "A"]),
        ("keyword_completion", "syntax", "starts_or_contains_any", 1, "none", "if ",
         ["x", "i", "not", "True", "False"]),
        ("keyword_completion", "syntax", "starts_or_contains_any", 1, "none", "for ",
         ["i", "x", "item", "key", "value"]),
        ("indentation_awareness", "syntax", "not_closing", 1, "none", "def func():\n    ", []),
        ("indentation_awareness", "syntax", "not_closing", 1, "none", "if True:\n    ", []),
        ("indentation_awareness", "syntax", "not_closing", 1, "none", "for i in range(10):\n    ", []),
        ("function_completion", "generation", "contains_any", 20, "newline",
         "def add(a, b):\n    return ", ["a", "+", "b"]),
        ("function_completion", "generation", "contains_any", 20, "newline",
         "def factorial(n):\n    if n == 0:\n        return ", ["1", "0"]),
        ("function_completion", "generation", "contains_any", 20, "newline",
         "def is_even(x):\n    return x % ", ["2", "==", "0"]),
        ("docstring_completion", "generation", "docstring", 30, "docstring",
         'def quick_sort(collection: list) -> list:\n    """', []),
        ("docstring_completion", "generation", "docstring", 30, "docstring", 'def add(a, b):\n    """', []),
        ("docstring_completion", "generation", "docstring", 30, "docstring", 'class GPTModel:\n    """', []),
    ),
    "code": (
        ("max", "code", "stripped_starts", 20, "block",
         "def maximum(a, b):\n    if a > b:\n        return ", ["a"]),
        ("is_even", "code", "stripped_starts", 5, "block", "def is_even(n):\n    return n % 2 == ", ["0"]),
        ("sum", "code", "contains_any", 10, "block",
         "def sum_list(items):\n    total = 0\n    for item in items:\n        total += ", ["item"]),
        ("reverse", "code", "contains_any", 10, "block",
         "def reverse_list(lst):\n    return lst[", ["::-1", "-1]"]),
        ("upper", "code", "lower_contains_any", 10, "block",
         "def make_uppercase(text):\n    return text.", ["upper"]),
    ),
}
PERPLEXITY_SAMPLES = (
    "def add(a, b):\n    return a + b",
    "for i in range(10):\n    print(i)",
    "import torch\nfrom torch import nn",
    "class Model(nn.Module):\n    def __init__(self):\n        super().__init__()",
)
BASELINE_SAMPLE = "Hello world. This is a test sentence for evaluating perplexity."

PROBE_SCHEMA = (
    "suite string, probe_id int, test string, category string, match_kind string, max_tokens int,"
    " stop_kind string, prompt string, acceptable array<string>"
)


def probes(spark: SparkSession, compat: bool = False) -> DataFrame:
    """All probes. ``compat`` lets the function test find its keywords in the prompt, too."""
    rows = [
        (suite, i, test, category,
         "keyword_anywhere" if compat and test == "function_completion" else kind, *rest)
        for suite, members in PROBES.items()
        for i, (test, category, kind, *rest) in enumerate(members)
    ]
    return spark.createDataFrame(rows, PROBE_SCHEMA)


def perplexity_samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PERPLEXITY_SAMPLES)), "sample_id int, text string")


def answers(asked: DataFrame, model: ngram.Model, scheme: str = "byte") -> DataFrame:
    """Greedy completions of ``prompt``, cut to each probe's token count and stop rule."""
    longest = max(p[3] for members in PROBES.values() for p in members)
    ready = asked.withColumn("tokens", tx.pretokens(F.col("prompt"), scheme))
    continued = generation.continue_greedily(ready, model, longest)
    path = F.slice("new_tokens", 1, F.col("max_tokens"))
    glue = "" if scheme == "byte" else " "
    return continued.withColumn(
        "predicted", F.array_join(generation.stopped(path, F.col("stop_kind"), glue), glue)
    ).drop("tokens", "new_tokens")


def evaluate(asked: DataFrame, model: ngram.Model, scheme: str = "byte") -> DataFrame:
    """Probes with ``predicted`` and ``passed``."""
    return answers(asked, model, scheme).withColumn(
        "passed",
        scores.matches(F.col("match_kind"), F.col("predicted"), F.col("acceptable"), F.col("prompt")),
    )


def perplexity_test(spark: SparkSession, model: ngram.Model, scheme: str = "byte") -> DataFrame:
    """Mean perplexity on the code samples and its score, one row."""
    texts = perplexity_samples(spark).withColumn("tokens", tx.pretokens(F.col("text"), scheme))
    return ngram.mean_perplexity(ngram.text_perplexity(texts, model, ["sample_id"]))


def run_suite(spark: SparkSession, model: ngram.Model, run: str, scheme: str = "byte", compat: bool = False) -> DataFrame:
    """Test scores ``(run, test, category, score)`` of the prompt suite, perplexity included."""
    judged = evaluate(probes(spark, compat).filter(F.col("suite") == "prompt"), model, scheme)
    tests = scores.pass_rates(judged, ["test", "category"]).select(
        F.lit(run).alias("run"), "test", "category", "score"
    )
    ppl = perplexity_test(spark, model, scheme).select(
        F.lit(run).alias("run"), F.lit("code_perplexity").alias("test"), F.lit("perplexity").alias("category"), "score"
    )
    return tests.unionByName(ppl)


def compare_runs(spark: SparkSession, models: dict[str, ngram.Model | Exception], scheme: str = "byte") -> DataFrame:
    """Suite scores of several models, one row each; a model that failed is a row with ``error``."""
    tables = []
    for run, model in models.items():
        if isinstance(model, Exception):
            tables.append(spark.createDataFrame([(run, str(model))], "run string, error string"))
        else:
            wide = scores.wide_scores(run_suite(spark, model, run, scheme))
            tables.append(wide.withColumn("error", F.lit(None).cast("string")))
    combined = tables[0]
    for table in tables[1:]:
        combined = combined.unionByName(table, allowMissingColumns=True)
    return combined
