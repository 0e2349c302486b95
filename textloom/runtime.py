"""Session set-up, lineage cuts and the skew-proof building blocks shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(app: str = "textloom", cores: int | str = "*", **conf) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="textloom-")
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at the written table, so a lost executor never replays what
    came before, and later uses prune columns on it like on any parquet table.
    """
    return cut_to(df, label)[0]


def cut_to(df: DataFrame, label: str = "cut") -> tuple[DataFrame, str]:
    """:func:`cut`, and the path of the table for :func:`remove_path`."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`cut` once a newer one replaces it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_RUNNING = {
    "sum": (F.sum, lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))),
    "min": (F.min, lambda before, here: F.least(before, here)),
    "max": (F.max, lambda before, here: F.greatest(before, here)),
}


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    scans: Mapping[str, tuple[str, Column]],
    partitions: int | None = None,
) -> DataFrame:
    """Exclusive running aggregates per group, in order, without one task per group.

    ``scans`` maps an output column to ``("sum" | "min" | "max", value)``; each row gets
    the aggregate of the rows *before* it. Rows are range partitioned by (group, order),
    so a group of any size is spread over as many partitions as it needs. A partition
    boundary cuts at most one group, hence the table of carried-over values holds at most
    one row per partition and may be broadcast.
    """
    spark = df.sparkSession
    width = partitions or shuffle_width(spark)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    names = list(scans)
    staged = cut(
        df.select("*", *[value.alias(f"_v_{n}") for n, (_, value) in scans.items()])
        .repartitionByRange(width, *[F.col(g) for g in group], *order_cols)
        .withColumn("_part", F.spark_partition_id()),
        "running",
    )

    per_part = staged.groupBy(*group, "_part").agg(
        *[_RUNNING[scans[n][0]][0](f"_v_{n}").alias(f"_v_{n}") for n in names]
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_part.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("_part").alias("_g_part"),
        F.count(F.lit(1)).over(earlier).alias("_parts_before"),
        *[_RUNNING[scans[n][0]][0](f"_v_{n}").over(earlier).alias(f"_b_{n}") for n in names],
    ).filter("_parts_before > 0")

    here = Window.partitionBy(*group, "_part").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = staged.select(
        "*", *[_RUNNING[scans[n][0]][0](f"_v_{n}").over(here).alias(f"_h_{n}") for n in names]
    )
    match = F.col("_part") == F.col("_g_part")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return local.join(F.broadcast(carried), match, "left").select(
        *df.columns,
        *[_RUNNING[scans[n][0]][1](F.col(f"_b_{n}"), F.col(f"_h_{n}")).alias(n) for n in names],
    )


def position(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Zero-based place of each row in its group; :func:`running` with a count."""
    return running(df, group, order, {name: ("sum", F.lit(1).cast("bigint"))})


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    hot: DataFrame,
    spread_by: Sequence[str],
    salts: int = 16,
) -> DataFrame:
    """Left join to a table with unique ``keys``, spreading the hot keys.

    ``hot`` lists the keys known to hold a large share of ``left``; the caller bounds it
    (at most ``1/share`` keys can each hold ``share`` of all rows). Rows of a hot key go
    to ``salts`` sub-keys chosen by ``spread_by``, and its row of ``right`` is repeated
    for each of them.
    """
    marked = F.broadcast(hot.select(*keys).distinct().withColumn("_hot", F.lit(True)))
    salted_left = left.join(marked, list(keys), "left").withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")).otherwise(0),
    )
    salted_right = right.join(marked, list(keys), "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        ),
    )
    return salted_left.drop("_hot").join(salted_right.drop("_hot"), [*keys, "_salt"], "left").drop("_salt")
