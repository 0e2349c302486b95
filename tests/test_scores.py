import pytest

from textloom.operators import scores


def test_roll_up_is_a_mean_of_means(spark):
    rows = [
        ("r", "bracket", "syntax", 0.0), ("r", "keyword", "syntax", 0.2), ("r", "indentation", "syntax", 0.0),
        ("r", "function", "generation", 2 / 3), ("r", "docstring", "generation", 1.0), ("r", "perplexity", "perplexity", 0.0),
    ]
    tests = spark.createDataFrame(rows, "run string, test string, category string, score double")
    long = {r.category: (r.category_score, r.overall_score) for r in scores.macro_scores(tests).collect()}
    assert long["syntax"] == pytest.approx((0.0667, 0.30), abs=1e-4)
    assert long["generation"] == pytest.approx((0.8333, 0.30), abs=1e-4)
    wide = scores.wide_scores(tests).first()
    assert (wide.syntax_score, wide.generation_score, wide.overall_score) == pytest.approx((0.0667, 0.8333, 0.30), abs=1e-4)


def test_pass_rates_and_totals(spark):
    outcomes = spark.createDataFrame([("r", "t", True), ("r", "t", False), ("r", "u", True)], "run string, test string, passed boolean")
    assert {r.test: r.score for r in scores.pass_rates(outcomes).collect()} == {"t": 0.5, "u": 1.0}
    total = scores.pass_total(outcomes).first()
    assert (total.passed, total.total) == (2, 3) and total.rate == pytest.approx(2 / 3)
    assert scores.pass_total(outcomes.filter("false")).first().rate is None


def test_judged_and_every_run(spark):
    probes = spark.createDataFrame(
        [("s", 1, "contains", [")"], "("), ("s", 2, "equal", ["x"], "q"), ("other", 3, "equal", ["x"], "q")],
        "suite string, probe_id int, match_kind string, acceptable array<string>, prompt string",
    )
    predictions = spark.createDataFrame([("r", 1, "a)"), ("r", 2, "y")], "run string, probe_id int, predicted string")
    assert {r.probe_id: r.passed for r in scores.judged(predictions, probes).collect()} == {1: True, 2: False}
    runs = spark.createDataFrame([("r1", "s"), ("r2", "s")], "run string, suite string")
    paired = scores.every_run(runs, probes)
    assert paired.count() == 4
    plan = paired._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_compared_keeps_missing_sides(spark):
    baseline = spark.createDataFrame([("bracket_test", 0.0), ("perplexity", 247.96)], "metric string, value double")
    improved = spark.createDataFrame([("bracket_completion", 0.2), ("code_perplexity", 123.98), ("keyword_completion", 0.5)], "metric string, value double")
    rows = {r.baseline_metric: r for r in scores.compared(baseline, improved, scores.metric_map(spark)).collect()}
    assert set(rows) == {"bracket_test", "repeat_test", "perplexity"}
    assert rows["bracket_test"].change == pytest.approx(20.0)
    assert rows["perplexity"].change == pytest.approx(50.0)
    assert rows["repeat_test"].baseline_value is None and rows["repeat_test"].change is None


def test_report_and_long_metrics(spark):
    wide = spark.createDataFrame(
        [("a" * 40, 2, 0.1, 0.2, 0.3, 9.0), ("b", 1, 0.1, 0.2, 0.3, 9.0)],
        "name string, step int, overall_score double, syntax_score double, generation_score double, average_perplexity double",
    )
    assert [r.name for r in scores.report(wide).collect()] == ["b", "a" * 28]
    long = scores.long_metrics(wide, ["overall_score", "syntax_score"], ["name"])
    assert long.count() == 4
