import math

import pytest
from pyspark.sql import functions as F

from textloom.operators import runlog
from textloom.sources.logs import LOG_SCHEMA


def train(run, step, loss, lr=None):
    return (run, step, loss, math.exp(min(loss, 20)), lr, None, None)


def val(run, step, loss):
    return (run, step, None, None, None, loss, math.exp(min(loss, 20)))


@pytest.fixture()
def log(spark):
    rows = [
        train("a", 20, 5.0), train("a", 40, 4.0), train("a", 500, 3.0),
        val("a", 100, 4.5), val("a", 200, 4.1), val("a", 300, 4.1), val("a", 400, 4.2), val("a", 500, 4.0),
        train("b", 20, 25.0),
        val("c", 500, 2.0),
    ]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def test_newest_record_prefers_validation(log):
    rows = {r.run: r for r in runlog.newest(log).collect()}
    assert rows["a"].step == 500 and rows["a"].val_loss == 4.0 and rows["a"].loss is None
    assert rows["b"].loss == 25.0 and rows["b"].perplexity == pytest.approx(math.exp(20))


def test_improvements_are_strict(log):
    rows = sorted((r.run, r.step) for r in runlog.improvements(log).collect())
    assert rows == [("a", 100), ("a", 200), ("a", 500), ("c", 500)]


def test_summary(log):
    rows = {r.run: r for r in runlog.summary(log).collect()}
    a = rows["a"]
    assert (a.steps_completed, a.initial_loss, a.current_loss, a.loss_improvement) == (500, 5.0, 3.0, 2.0)
    assert (a.latest_val_loss, a.best_val_loss, a.best_val_step) == (4.0, 4.0, 500)
    assert rows["b"].loss_improvement is None and rows["b"].latest_val_loss is None
    assert rows["c"].initial_loss is None and rows["c"].best_val_loss is None


def test_first_best_step_wins(spark):
    log = spark.createDataFrame([val("r", 2, 1.0), val("r", 1, 1.0), val("r", 3, 2.0)], LOG_SCHEMA)
    row = runlog.summary(log).first()
    assert (row.best_val_loss, row.best_val_step) == (1.0, 1)


def test_interval_means(spark):
    steps = spark.createDataFrame([("r", s, float(s)) for s in range(1, 46)], "run string, step bigint, loss double")
    rows = [(r.step, r.loss) for r in runlog.interval_means(steps, 20).orderBy("step").collect()]
    assert rows == [(20, 10.5), (40, 30.5)]


def test_validation_mean(spark):
    batches = spark.createDataFrame(
        [("r", i, float(i)) for i in range(80)] + [("s", 0, 30.0)], "run string, batch_no int, loss double"
    )
    rows = {r.run: r for r in runlog.validation_mean(batches).collect()}
    assert (rows["r"].batches, rows["r"].val_loss) == (50, 24.5)
    assert rows["s"].val_perplexity == pytest.approx(math.exp(20))
    assert runlog.validation_mean(batches.filter("false")).count() == 0


def test_lr_audit(spark):
    def lr(step):
        if step < 500:
            return 1e-4 * step / 500
        return 1e-4 * (0.1 + 0.9 * 0.5 * (1 + math.cos(math.pi * (step - 500) / 19500)))

    rows = [train("r", s, 1.0, lr(s)) for s in (0, 499, 500, 10000, 20000, 20001, 25000)]
    rows.append(train("r", 7, 1.0, lr(7) * 1.01))
    wrong = runlog.lr_audit(spark.createDataFrame(rows, LOG_SCHEMA)).collect()
    assert [r.step for r in wrong] == [7] and wrong[0].expected_lr == pytest.approx(lr(7))


def test_progress(log, spark):
    rows = {r.run: r for r in runlog.progress(log, 500).collect()}
    assert rows["a"].state == "complete" and rows["a"].percent == 100.0 and rows["a"].improvement == 2.0
    assert rows["b"].state == "stopped" and rows["b"].hours_left == pytest.approx(0.096)
    assert rows["c"].loss is None and rows["c"].improvement == 0
    going = runlog.progress(log, 500, is_running=F.col("run") == "b")
    assert {r.run: r.state for r in going.collect()}["b"] == "running"


def test_row_filters(log):
    assert runlog.every(log, 500).count() == 3
    assert runlog.training_rows(log).count() == 4 and runlog.validation_rows(log).count() == 6
    assert runlog.first_steps(log, 40).count() == 2


def test_empty_log(spark):
    empty = spark.createDataFrame([], LOG_SCHEMA)
    for operator in (runlog.newest, runlog.summary, runlog.progress, runlog.improvements, runlog.interval_means):
        assert operator(empty).count() == 0
