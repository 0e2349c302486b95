import os

import pytest

from textloom.operators import runlog
from textloom.sources.logs import LOG_SCHEMA, append_log
from textloom.streaming import monitor

ROWS = [("r", s, 3.0 - s / 100, 2.0, 1e-4, None, None) for s in range(1, 46)]
ROWS += [("r", s, None, None, None, v, 2.0) for s, v in ((10, 3.0), (20, 2.5), (30, 2.5), (40, 2.0))]
ROWS += [("q", 5, None, None, None, 9.0, 1.0)]


def write(folder, rows, at):
    """One finished JSON-lines file with its own modification time."""
    import json

    names = ("run", "step", "loss", "perplexity", "lr", "val_loss", "val_perplexity")
    path = folder / f"log-{at:03}.json"
    hidden = folder / f".tmp-{at}"
    hidden.write_text("".join(json.dumps({k: v for k, v in zip(names, r) if v is not None}) + "\n" for r in rows))
    os.utime(hidden, (1_700_000_000 + at, 1_700_000_000 + at))
    hidden.rename(path)
    return path


def bag(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_order_independent_outputs_equal_the_batch(spark, tmp_path, order):
    for at, part in enumerate(order):
        write(tmp_path, ROWS[part::3], at)
    log = spark.createDataFrame(ROWS, LOG_SCHEMA)
    stream = lambda: monitor.log_stream(spark, str(tmp_path), files_per_batch=1)
    assert bag(monitor.to_table(monitor.newest(stream()))) == bag(runlog.newest(log))
    best = monitor.to_table(monitor.best_so_far(stream()))
    assert bag(best) == [("q", 5, 9.0), ("r", 40, 2.0)]
    train = log.filter("loss is not null")
    means = monitor.to_table(monitor.interval_means(stream().filter("loss is not null")))
    assert bag(means.selectExpr("run", "step", "round(loss, 9)")) == bag(
        runlog.interval_means(train).selectExpr("run", "step", "round(loss, 9)")
    )


def test_improvement_events_of_ordered_files(spark, tmp_path):
    rows = sorted((r for r in ROWS), key=lambda r: r[1])
    for at in range(4):
        write(tmp_path, rows[at * 13 : (at + 1) * 13], at)
    stream = monitor.log_stream(spark, str(tmp_path), files_per_batch=1)
    events = monitor.to_table(monitor.improvements(stream), "append")
    want = runlog.improvements(spark.createDataFrame(ROWS, LOG_SCHEMA)).select("run", "step", "val_loss")
    assert bag(events.filter("NOT late").drop("late")) == bag(want) == [("q", 5, 9.0), ("r", 10, 3.0), ("r", 20, 2.5), ("r", 40, 2.0)]


def test_late_rows_are_marked_and_count_for_what_follows(spark, tmp_path):
    write(tmp_path, [r for r in ROWS if r[5] and r[1] == 40], 0)
    write(tmp_path, [r for r in ROWS if r[5] and r[1] < 40], 1)
    stream = lambda: monitor.log_stream(spark, str(tmp_path), files_per_batch=1)
    events = bag(monitor.to_table(monitor.improvements(stream()), "append"))
    assert {("r", 40, 2.0, False), ("r", 30, 2.5, True), ("r", 20, 2.5, True), ("r", 10, 3.0, True)} <= set(events)
    assert ("r", 40, 2.0) in bag(monitor.to_table(monitor.best_so_far(stream())))


def test_cut_rows_and_empty_folder(spark, tmp_path):
    assert monitor.to_table(monitor.newest(monitor.log_stream(spark, str(tmp_path)))).count() == 0
    path = write(tmp_path, ROWS[:3], 0)
    with open(path, "a") as f:
        f.write('{"run": "r", "step": 99, "los')
    rows = monitor.to_table(monitor.newest(monitor.log_stream(spark, str(tmp_path)))).collect()
    assert [r.step for r in rows] == [3]


def test_appended_log_is_a_stream_source(spark, tmp_path):
    log = spark.createDataFrame(ROWS, LOG_SCHEMA)
    append_log(log.filter("step <= 20"), str(tmp_path / "log"))
    append_log(log.filter("step > 20"), str(tmp_path / "log"))
    stream = monitor.log_stream(spark, str(tmp_path / "log"))
    assert bag(monitor.to_table(monitor.newest(stream))) == bag(runlog.newest(log))


def test_follow_keeps_a_table_up_to_date(spark, tmp_path):
    folder, out = tmp_path / "log", str(tmp_path / "newest")
    folder.mkdir()
    query = monitor.follow(monitor.log_stream(spark, str(folder)), out, str(tmp_path / "progress"), "1 second")
    try:
        for at, rows in enumerate((ROWS[:5], ROWS[5:9])):
            write(folder, rows, at)
            query.processAllAvailable()
            assert [r.step for r in monitor.current(spark, out).collect()] == [rows[-1][1]]
    finally:
        query.stop()
