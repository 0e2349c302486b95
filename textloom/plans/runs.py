"""Queries on run logs, artifacts and streams of log rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.numbers import perplexity_band
from textloom.operators import artifacts, runlog
from textloom.plans import tables
from textloom.plans.registry import query
from textloom.plans.tables import LOG_SQL
from textloom.runtime import scratch_path
from textloom.sources import logs
from textloom.streaming import monitor

TOTAL, MAX_BATCHES, INTERVAL = 60, 5, 20


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {LOG_SQL}
SELECT run, max(step) AS step, round(avg(coalesce(loss, val_loss)), 6) AS loss,
  round(exp(least(avg(coalesce(loss, val_loss)), 20.0::DOUBLE)), 3) AS perplexity
FROM log GROUP BY run, (step - 1) // {INTERVAL} HAVING count(*) = {INTERVAL}
""")
def loss_tumbling(spark, folder):
    """Mean of every 20 raw losses; the incomplete rest of a run is left out."""
    steps = tables.training_log(spark, folder).select("run", "step", F.coalesce("loss", "val_loss").alias("loss"))
    means = runlog.interval_means(steps, INTERVAL)
    return means.select("run", "step", F.round("loss", 6).alias("loss"), F.round("perplexity", 3).alias("perplexity"))


@query(f"""WITH {LOG_SQL}
SELECT run, step, val_loss FROM (
  SELECT run, step, val_loss, min(val_loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
  FROM log WHERE val_loss IS NOT NULL) WHERE b IS NULL OR val_loss < b
""")
def best_val(spark, folder):
    return runlog.improvements(tables.training_log(spark, folder)).select("run", "step", "val_loss")


@query(f"""WITH {LOG_SQL},
t AS (SELECT run, count(loss) AS n_train, count(val_loss) AS n_val,
  max(step) FILTER (loss IS NOT NULL) AS steps_completed,
  arg_min(loss, step) FILTER (loss IS NOT NULL) AS initial_loss,
  arg_max(loss, step) FILTER (loss IS NOT NULL) AS current_loss,
  arg_min(perplexity, step) FILTER (loss IS NOT NULL) AS initial_perplexity,
  arg_max(perplexity, step) FILTER (loss IS NOT NULL) AS current_perplexity,
  arg_max(val_loss, step) FILTER (val_loss IS NOT NULL) AS latest_val_loss,
  arg_max(val_perplexity, step) FILTER (val_loss IS NOT NULL) AS latest_val_perplexity,
  min(val_loss) AS best FROM log GROUP BY run),
b AS (SELECT run, min(step) AS best_step FROM log JOIN t USING (run) WHERE val_loss = best GROUP BY run)
SELECT run, steps_completed, initial_loss, current_loss, round(initial_perplexity, 3) AS initial_perplexity,
  round(current_perplexity, 3) AS current_perplexity,
  round(CASE WHEN n_train > 1 THEN initial_loss - current_loss END, 6) AS loss_improvement,
  latest_val_loss, round(latest_val_perplexity, 3) AS latest_val_perplexity,
  CASE WHEN n_val > 1 THEN best END AS best_val_loss, CASE WHEN n_val > 1 THEN best_step END AS best_val_step
FROM t LEFT JOIN b USING (run)
""")
def run_summary(spark, folder):
    out = runlog.summary(tables.training_log(spark, folder))
    out = _rounded(out, "initial_perplexity", "current_perplexity", "latest_val_perplexity", digits=3)
    return _rounded(out, "loss_improvement")


@query(f"""WITH {LOG_SQL},
t AS (SELECT run, max(step) AS step, arg_min(loss, step) FILTER (loss IS NOT NULL) - arg_max(loss, step) FILTER (loss IS NOT NULL) AS gain FROM log GROUP BY run)
SELECT run, step, loss, val_loss, round(coalesce(gain, 0), 6) AS improvement, round(step / {TOTAL}.0::DOUBLE * 100, 6) AS percent,
  round(({TOTAL} - step) / 10000.0::DOUBLE * 2.0::DOUBLE, 6) AS hours_left,
  CASE WHEN step >= {TOTAL} THEN 'complete' WHEN step > 0 THEN 'stopped' ELSE 'none' END AS state
FROM t JOIN log USING (run, step)
""")
def run_progress(spark, folder):
    out = runlog.progress(tables.training_log(spark, folder), TOTAL)
    return _rounded(
        out.select("run", "step", "loss", "val_loss", "improvement", "percent", "hours_left", "state"),
        "improvement", "percent", "hours_left",
    )


@query(f"""WITH {LOG_SQL}
SELECT run, count(*) AS batches, round(avg(val_loss), 6) AS val_loss, round(exp(least(avg(val_loss), 20.0::DOUBLE)), 3) AS val_perplexity
FROM (SELECT run, val_loss, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM log WHERE val_loss IS NOT NULL)
WHERE k <= {MAX_BATCHES} GROUP BY run
""")
def val_mean_first_n(spark, folder):
    """Validation mean over the first batches of each run; the events are already in batch order."""
    batches = tables.table(spark, folder, "events").filter("event_type = 'purchase'").select(
        F.col("user_id").cast("string").alias("run"), "ts", "event_id", F.col("value").alias("loss")
    )
    out = runlog.validation_mean(batches, MAX_BATCHES, ["ts", "event_id"])
    return _rounded(_rounded(out, "val_loss"), "val_perplexity", digits=3)


@query(f"""WITH {LOG_SQL}
SELECT run, step, round(lr * 1e6, 6) AS lr_millionths, round(expected * 1e6, 6) AS expected_millionths
FROM (SELECT *, 1e-4::DOUBLE * (CASE WHEN step < 10 THEN step / 10.0::DOUBLE
          ELSE 0.1::DOUBLE + 0.9::DOUBLE * (0.5::DOUBLE * (1.0::DOUBLE + cos(pi() * ((step - 10) / 50.0::DOUBLE)))) END) AS expected FROM log)
WHERE lr IS NOT NULL AND abs(lr - expected) > 1e-9
""")
def lr_audit(spark, folder):
    wrong = runlog.lr_audit(tables.training_log(spark, folder), tables.BASE_LR, tables.WARMUP, tables.TOTAL)
    return wrong.select(
        "run", "step",
        F.round(F.col("lr") * 1e6, 6).alias("lr_millionths"),
        F.round(F.col("expected_lr") * 1e6, 6).alias("expected_millionths"),
    )


@query(f"""WITH {LOG_SQL}
SELECT run, step, loss, val_loss FROM log WHERE step % {INTERVAL} = 0
""")
def periodic_rows(spark, folder):
    return runlog.every(tables.training_log(spark, folder), INTERVAL).select("run", "step", "loss", "val_loss")


@query(f"""WITH {LOG_SQL}
SELECT CASE WHEN p < 50 THEN 'excellent' WHEN p < 100 THEN 'good' WHEN p < 200 THEN 'okay' ELSE 'poor' END AS band, count(*) AS rows
FROM (SELECT coalesce(perplexity, val_perplexity) AS p FROM log) GROUP BY 1
""")
def perplexity_bands(spark, folder):
    log = tables.training_log(spark, folder)
    band = perplexity_band(F.coalesce("perplexity", "val_perplexity"))
    return log.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("rows"))


@query(f"""WITH {LOG_SQL}
SELECT run, count(*) AS rows, count(loss) AS train_rows, count(val_loss) AS val_rows, max(step) AS step,
  round(sum(coalesce(loss, val_loss)), 6) AS total FROM log GROUP BY run
""")
def log_roundtrip(spark, folder):
    """Append the log as JSON lines, read it back."""
    path = scratch_path(spark, "log")
    logs.append_log(tables.training_log(spark, folder), path)
    log = logs.read_log_lines(spark, path)
    return log.groupBy("run").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("loss").alias("train_rows"),
        F.count("val_loss").alias("val_rows"),
        F.max("step").alias("step"),
        F.round(F.sum(F.coalesce("loss", "val_loss")), 6).alias("total"),
    )


# Documents as checkpoint files: even-numbered sources are best ones, the others periodic ones.
_ARTIFACT_SQL = """
  files AS (SELECT CASE WHEN CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 2 = 0 THEN 'best_step_' || doc_id
      WHEN source = 'src1' THEN 'best_step_x' || doc_id WHEN source = 'src3' THEN 'ckpt-' || doc_id
      ELSE 'checkpoint_step_' || doc_id END AS name,
    n_chars / 1048576.0::DOUBLE AS size_mb, doc_id, (doc_id * 7919) % 100003 AS age FROM documents),
  artifacts AS (SELECT *, CASE WHEN name NOT LIKE '%step#_%' ESCAPE '#' THEN 999999
      ELSE coalesce(TRY_CAST(string_split(name, 'step_')[-1] AS INTEGER), 0) END AS step FROM files)
"""


def _artifacts(spark, folder):
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    label = (
        F.when(number % 2 == 0, "best_step_")
        .when(F.col("source") == "src1", "best_step_x")
        .when(F.col("source") == "src3", "ckpt-")
        .otherwise("checkpoint_step_")
    )
    files = tables.table(spark, folder, "documents").select(
        F.concat(F.lit("/checkpoints/"), label, F.col("doc_id").cast("string"), F.lit(".pt")).alias("path"),
        F.col("n_chars").alias("size_bytes"),
        F.timestamp_seconds((F.col("doc_id") * 7919) % 100003).alias("modified"),
    )
    return artifacts.described(files)


@query(f"WITH {_ARTIFACT_SQL} SELECT name, CAST(step AS BIGINT) AS step, round(size_mb, 9) AS size_mb FROM artifacts")
def artifact_steps(spark, folder):
    listed = artifacts.by_step(_artifacts(spark, folder))
    return listed.select("name", F.col("step").cast("bigint").alias("step"), F.round("size_mb", 9).alias("size_mb"))


@query(f"""WITH {_ARTIFACT_SQL}
SELECT name, strftime(to_timestamp(age), '%H:%M:%S') AS at, greatest((SELECT count(*) FROM artifacts) - 5, 0) AS more
FROM artifacts ORDER BY age DESC, name LIMIT 5
""")
def artifact_latest(spark, folder):
    newest = artifacts.newest(_artifacts(spark, folder), 5)
    return newest.select("name", F.date_format("modified", "HH:mm:ss").alias("at"), "more")


@query(f"""WITH {_ARTIFACT_SQL}
SELECT name FROM artifacts ORDER BY name LIKE 'best#_step#_%' ESCAPE '#' DESC,
  CASE WHEN name LIKE 'best#_step#_%' ESCAPE '#' THEN TRY_CAST(string_split(name, '_')[-1] AS INTEGER) END DESC NULLS LAST, age DESC, name LIMIT 1
""")
def artifact_best(spark, folder):
    return artifacts.latest_best(_artifacts(spark, folder)).select("name")


def _streamed_events(spark, folder):
    """The events file as a stream of log rows; the step of a streamed row is its event id."""
    source = spark.readStream.schema(tables.table(spark, folder, "events").schema)
    events = source.option("pathGlobFilter", "events.parquet").parquet(folder)
    return events.withColumn("step", F.col("event_id")).select(*tables.log_columns())


_EVENT_LOG_SQL = """
  log AS (SELECT CAST(user_id AS VARCHAR) AS run, event_id AS step,
    CASE WHEN event_type <> 'purchase' THEN value END AS loss, CASE WHEN event_type = 'purchase' THEN value END AS val_loss
  FROM events)
"""


@query(f"WITH {_EVENT_LOG_SQL} SELECT run, max(step) AS step, arg_max(coalesce(loss, val_loss), step) AS newest FROM log GROUP BY run")
def stream_latest(spark, folder):
    latest = monitor.to_table(monitor.newest(_streamed_events(spark, folder)))
    return latest.select("run", "step", F.coalesce("loss", "val_loss").alias("newest"))


@query(f"""WITH {_EVENT_LOG_SQL}, b AS (SELECT run, min(val_loss) AS val_loss FROM log GROUP BY run)
SELECT run, min(step) AS step, val_loss FROM log JOIN b USING (run, val_loss) GROUP BY run, val_loss
""")
def stream_best(spark, folder):
    return monitor.to_table(monitor.best_so_far(_streamed_events(spark, folder)))


@query(f"""WITH {_EVENT_LOG_SQL}
SELECT run, step, val_loss FROM (
  SELECT run, step, val_loss, min(val_loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
  FROM log WHERE val_loss IS NOT NULL) WHERE b IS NULL OR val_loss < b
""")
def stream_improvements(spark, folder):
    """One file in one batch, hence in order."""
    found = monitor.to_table(monitor.improvements(_streamed_events(spark, folder)), "append")
    return found.filter("NOT late").drop("late")


@query(f"""WITH {_EVENT_LOG_SQL}, parts AS (SELECT *, step % 4 = 3 AS after FROM log WHERE val_loss IS NOT NULL),
bests AS (
  SELECT run, step, val_loss, after, max(CASE WHEN NOT after THEN step END) OVER (PARTITION BY run) AS last,
    min(CASE WHEN NOT after THEN val_loss END) OVER (PARTITION BY run) AS least,
    min(val_loss) OVER (PARTITION BY run, after ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM parts),
lates AS (SELECT run, min(val_loss) AS late_least FROM bests WHERE after AND step <= last GROUP BY run)
SELECT run, step, val_loss, coalesce(after AND step <= last, FALSE) AS late FROM (
  SELECT *, CASE WHEN after THEN (SELECT min(x) FROM (VALUES (least), (late_least), (new_before)) t(x)) ELSE before END AS b FROM (
    SELECT bests.*, late_least, min(CASE WHEN step > coalesce(last, -1) THEN val_loss END) OVER
      (PARTITION BY run, after ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS new_before
    FROM bests LEFT JOIN lates USING (run)))
WHERE coalesce(after AND step <= last, FALSE) OR b IS NULL OR val_loss < b
""")
def stream_improvements_late(spark, folder):
    """Two batches: every fourth event comes after all others, so state is carried and rows are late."""
    path = scratch_path(spark, "late-events")
    events = tables.table(spark, folder, "events")
    for after in (False, True):
        events.filter((F.col("event_id") % 4 == 3) == after).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    log = source.withColumn("step", F.col("event_id")).select(*tables.log_columns())
    return monitor.to_table(monitor.improvements(log), "append")


@query(f"""WITH {_EVENT_LOG_SQL}
SELECT '0' AS run, max(step) AS step, round(avg(coalesce(loss, val_loss)), 6) AS loss FROM (SELECT step + 1 AS step, loss, val_loss FROM log)
GROUP BY (step - 1) // {INTERVAL} HAVING count(*) = {INTERVAL}
""")
def stream_interval_means(spark, folder):
    """Means of every 20 events of one run made of all events."""
    log = _streamed_events(spark, folder).select(
        F.lit("0").alias("run"), (F.col("step") + 1).alias("step"), F.coalesce("loss", "val_loss").alias("loss")
    )
    means = monitor.to_table(monitor.interval_means(log, INTERVAL))
    return means.select("run", "step", F.round("loss", 6).alias("loss"))
