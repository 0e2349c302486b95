"""Line dedup with levelled sorted runs of line hashes.

A run is a table of ``(h1, h2, docs)``: a line's 128-bit hash and in how many documents of
some batches it was seen, bucketed and sorted by hash, so joins with runs move the new batch
only. Each batch is merge-anti-joined with the lines that the runs have already settled as
frequent and adds the rest as a run of level 0; ``fanout`` runs of a level are compacted into
one of the next. When all batches are in, the runs are compacted once more, and the lines of
at least ``min_docs`` documents lose their places in every document.

A line's key is the line without white space at its ends and with A-Z in lower case. A null
or empty text is one empty line. Empty keys are never dropped. A text all of whose lines go
becomes empty. Repeated rows are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import BLANKS, ascii_lower, free_name, slices, text_key
from textloom.runtime import cut, remove_path, scratch_path, shuffle_width


class LineRuns:
    """Runs of line hashes by level; :meth:`add` a batch at a time, then read :meth:`frequent`."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4, buckets: int | None = None) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or min(shuffle_width(spark), 4096)
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, counts: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch_path(self.spark, "line-run")
        (
            counts.repartition(self.buckets, "h1")
            .write.bucketBy(self.buckets, "h1")
            .sortBy("h1", "h2")
            .option("path", path)
            .format("parquet")
            .saveAsTable(name)
        )
        return name, path

    def _forget(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        remove_path(self.spark, run[1])

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        # read by path: a union of bucketed tables may be taken for one that is grouped by bucket already
        rows = self.spark.read.schema("h1 bigint, h2 bigint, docs bigint").parquet(*[path for _, path in runs])
        return rows.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))

    def add(self, lines: DataFrame) -> None:
        """Take in ``(h1, h2)``, one row for each document and line of a batch."""
        batch = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"))
        for level in self.levels:
            for name, _ in level:
                settled = self.spark.table(name).filter(F.col("docs") >= self.min_docs)
                batch = batch.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._push(0, self._write(batch))

    def _push(self, level: int, run: tuple[str, str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(self._merged(full)))
            for old in full:
                self._forget(old)

    def frequent(self) -> DataFrame:
        """``(h1, h2)`` of the lines found in at least ``min_docs`` documents; the runs are gone afterwards."""
        runs = [run for level in self.levels for run in level]
        found = cut(self._merged(runs).filter(F.col("docs") >= self.min_docs).select("h1", "h2"), "frequent-lines")
        for run in runs:
            self._forget(run)
        self.levels = []
        return found


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup(
    docs: DataFrame,
    min_chars: int = 1,
    min_docs: int = 10,
    batches: int = 4,
    fanout: int = 2,
    text: str = "text",
) -> DataFrame:
    """``docs`` with ``text`` cut down to the lines that stay, and ``n_lines`` and ``n_dropped`` of each row.

    The two counts get underscores in front where ``docs`` has columns of their names.
    """
    spark = docs.sparkSession
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)

    def hashed(line: Column) -> Column:
        key = line_key(line)
        return F.when(
            F.char_length(key) >= min_chars,
            F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")),
        )

    keyed = docs.select(*text_key(F.col(text)), F.transform(lines, hashed).alias("hashes"))
    keyed = cut(keyed.withColumn("batch", F.pmod(F.xxhash64("t2"), F.lit(max(1, batches))).cast("int")), "line-hashes")

    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(max(1, batches)):
        mine = keyed.filter(F.col("batch") == batch)
        runs.add(mine.select(F.explode(F.array_distinct("hashes")).alias("h")).filter("h is not null").select("h.*"))
    frequent = runs.frequent()

    places = keyed.select("t1", "t2", F.posexplode("hashes").alias("place", "h")).filter("h is not null")
    places = places.select("t1", "t2", "place", "h.h1", "h.h2").join(frequent, ["h1", "h2"], "left_semi")
    # a line has one row for each copy of its text until here; what is collected is bounded by one text's lines
    dropped = places.groupBy("t1", "t2").agg(F.collect_set("place").alias("places"))

    names = [free_name(docs, n) for n in ("_t1", "_t2", "_places")]
    dropped = cut(dropped.toDF(*names), "dropped-lines")
    one, two = text_key(F.col(text))
    joined = docs.join(dropped, (one == F.col(names[0])) & (two == F.col(names[1])), "left").drop(*names[:2])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    added = [free_name(docs, n) for n in ("n_lines", "n_dropped")]
    schema = ", ".join([*fields, *(f"`{n}` bigint" for n in added)])
    return joined.mapInArrow(_strip(docs.columns, added, text, names[2]), schema)


def _strip(columns: list[str], added: list[str], text: str, places: str):
    """Take the lines at the given places out of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            kept, n_lines, n_dropped = [], [], []
            for whole, gone in zip(batch.column(text).to_pylist(), batch.column(places)):
                lines = (whole or "").split("\n")
                stay = np.ones(len(lines), bool)
                if gone.is_valid:
                    stay[np.asarray(gone.values)] = False
                n_lines.append(len(lines))
                n_dropped.append(int(len(lines) - stay.sum()))
                kept.append("\n".join([x for x, s in zip(lines, stay.tolist()) if s]) if n_dropped[-1] else whole or "")
            arrays = [pa.array(kept, batch.schema.field(text).type) if c == text else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                [*columns, *added],
            )

    return work
