import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import matching, numbers
from textloom.functions import text as tx


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("out")).first().out


@pytest.mark.parametrize(
    "text, reason",
    [
        ("404: Not Found", "not_found"),
        (" 404: Not Found\n", "not_found"),
        ("x = 1\ny = 2\nprint(x+y)", None),
        (" " * 12, "blank"),
        (" " * 12, "blank"),
        ("", "blank"),
        ("a" * 9, "short"),
        ("a" * 10, None),
        ("a" + " " * 9, None),
        (None, "unreadable"),
    ],
)
def test_reject_reason(spark, text, reason):
    assert one(spark, tx.reject_reason(F.col("t")), t=text) == reason


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 1001, 2500])
@pytest.mark.parametrize("final_newline", [True, False])
def test_first_lines(spark, n, final_newline):
    text = "\n".join(f"line {i}" for i in range(n)) + ("\n" if final_newline and n else "")
    want = "".join(text.splitlines(keepends=True)[:1000])
    assert one(spark, tx.first_lines(F.col("t"), 1000), t=text) == want


@pytest.mark.parametrize("text", ["", "a", "a\nb", "a\n", "\n\n", "a  b", "a b", "é😀 x\ty"])
def test_counts(spark, text):
    assert one(spark, tx.n_lines(F.col("t")), t=text) == len(text.split("\n"))
    assert one(spark, tx.n_words(F.col("t")), t=text) == len(text.split())
    assert one(spark, F.length("t"), t=text) == len(text)


@pytest.mark.parametrize(
    "name, step",
    [
        ("best_step_500", 500),
        ("best_step_6500", 6500),
        ("checkpoint_step_2000", 2000),
        ("best_step_x", 0),
        ("final-ckpt", 999999),
        ("a_step_1_step_7", 7),
    ],
)
def test_step_of_name(spark, name, step):
    assert one(spark, tx.step_of_name(F.col("t")), t=name) == step


def test_small_text_functions(spark):
    assert one(spark, tx.nfkc(F.col("t")), t="Ａﬁ") == "Afi"
    assert one(spark, tx.universal_newlines(F.col("t")), t="a\r\nb\rc\n") == "a\nb\nc\n"
    assert one(spark, tx.clip(F.col("t"), 5), t="ab\ncdef") == "ab\\nc"
    assert one(spark, tx.first_block(F.col("t")), t="a\nb\n\nc\n\nd") == "a\nb"
    assert one(spark, tx.after_prompt(F.col("t"), F.lit("def ")), t="def add") == "add"
    assert one(spark, tx.stem(F.col("t")), t="/a/b.c/best_step_5.pt") == "best_step_5"
    raw = spark.createDataFrame([(bytearray(b"ok \xff\xfe\xc3\xa9"),)], "c binary")
    assert raw.select(tx.utf8_lossy(F.col("c"))).first()[0] == "ok é"


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",))), min_size=1, max_size=20))
def test_byte_signs_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    signs = tx.bytes_to_signs(F.col("t"))
    rows = df.select("t", signs.alias("s"), tx.signs_to_text(signs).alias("back")).collect()
    assert all(r.back == r.t and len(r.s) == len(r.t.encode()) and " " not in r.s for r in rows)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(), min_size=1, max_size=20))
def test_nfkc_is_python_nfkc(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.nfkc(F.col("t")).alias("n")).collect()
    assert all(r.n == unicodedata.normalize("NFKC", r.t) for r in rows)


def test_numbers(spark):
    v = F.col("v")
    assert one(spark, numbers.perplexity(v), v=25.0) == pytest.approx(485165195.4097903)
    assert [one(spark, numbers.perplexity_score(v), v=x) for x in (49.9, 50.0, 99.9, 100.0)] == [1, 0.5, 0.5, 0]
    assert [one(spark, numbers.compression_band(v), v=x) for x in (1.9, 2.0, 3.0)] == ["low", "moderate", "good"]
    assert [one(spark, numbers.perplexity_band(v), v=x) for x in (49.0, 50.0, 100.0, 200.0)] == [
        "excellent", "good", "okay", "poor",
    ]
    got = [one(spark, numbers.clean_logit(v), v=x) for x in (float("nan"), float("inf"), float("-inf"), 1.5)]
    assert got == [0.0, 1e4, -1e4, 1.5]
    lr = [one(spark, numbers.scheduled_lr(v, 1.0, 500, 20000), v=float(s)) for s in (0, 499, 500, 20000, 20001)]
    assert lr == pytest.approx([0.0, 0.998, 1.0, 0.1, 0.1], abs=1e-6) and lr[4] > lr[3] - 1e-12


def test_draws_are_uniform_and_reproducible(spark):
    df = spark.range(4000).select(numbers.draw(5, F.col("id")).alias("u"))
    a, b = [r.u for r in df.collect()], [r.u for r in df.collect()]
    assert a == b and all(0 <= u < 1 for u in a) and abs(sum(a) / len(a) - 0.5) < 0.02


@pytest.mark.parametrize(
    "kind, predicted, acceptable, prompt, passed",
    [
        ("equal", ")", [")"], "(", True),
        ("equal", " )", [")"], "(", False),
        ("stripped_equal", " hello\n", ["hello"], "", True),
        ("lower_contains_any", "TIME", ["time", "a"], "", True),
        ("contains", "x)", [")"], "", True),
        ("starts_or_contains_any", " os", ["torch", "os"], "", True),
        ("not_closing", " ", [], "", False),
        ("not_closing", " ) ", [], "", False),
        ("not_closing", "x", [], "", True),
        ("keyword_anywhere", "zzz", ["a"], "def add(a)", True),
        ("contains_any", "zzz", ["a"], "def add(a)", False),
        ("stripped_starts", "\n a", ["a"], "", True),
        ("docstring", "Sort the list", [], "", True),
        ("docstring", "  short  ", [], "", False),
        ("docstring", "aaaaa is bad", [], "", False),
        ("docstring", "AAAAA is fine", [], "", True),
        ("unheard_of", "x", ["x"], "", None),
    ],
)
def test_matches(spark, kind, predicted, acceptable, prompt, passed):
    row = spark.createDataFrame(
        [(kind, predicted, acceptable, prompt)], "k string, p string, a array<string>, q string"
    )
    got = row.select(matching.matches(F.col("k"), F.col("p"), F.col("a"), F.col("q"))).first()[0]
    assert got is passed
