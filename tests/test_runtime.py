import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from textloom import runtime


def brute_running(rows):
    """{(group, place): (sum, min, count) of earlier values}"""
    out, state = {}, {}
    for g, at, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        s, m, c = state.get(g, (0, None, 0))
        out[(g, at)] = (s, m, c)
        if v is not None:
            s, m = s + v, v if m is None else min(m, v)
        state[g] = (s, m, c + 1)
    return out


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_running_with_a_hot_group(spark, partitions):
    random.seed(3)
    rows = [("hot", i, random.randint(-50, 50)) for i in range(700)]
    rows += [(f"g{i % 90}", i, random.choice([None, i % 13])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, at int, v int")
    got = runtime.running(
        df,
        ["g"],
        ["at"],
        {"s": ("sum", F.col("v")), "m": ("min", F.col("v")), "c": ("sum", F.lit(1))},
        partitions,
    )
    assert {(r.g, r.at): (r.s, r.m, r.c) for r in got.collect()} == brute_running(rows)


def test_running_splits_one_group_over_partitions(spark):
    df = spark.range(1000).select(F.lit("only").alias("g"), F.col("id").alias("at"))
    spread = df.repartitionByRange(8, "g", "at").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread == 8
    got = runtime.position(df, ["g"], ["at"], "place").filter("place != at").count()
    assert got == 0


def test_running_without_group_and_with_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, at int")
    assert sorted((r.g or "", r.at, r.k) for r in runtime.position(df, ["g"], ["at"], "k").collect()) == [
        ("", 1, 0), ("", 2, 1), ("a", 1, 0),
    ]
    assert [r.k for r in runtime.position(df, [], ["g", "at"], "k").orderBy("k").collect()] == [0, 1, 2]


def test_running_empty(spark):
    df = spark.createDataFrame([], "g string, at int")
    assert runtime.position(df, ["g"], ["at"], "k").count() == 0


def test_salted_lookup_equals_left_join(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i int")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 300, 2)], "k string, v int")
    hot = spark.createDataFrame([("hot",), ("unused",)], "k string")
    got = runtime.salted_lookup(left, right, ["k"], hot, ["i"], 4)
    want = left.join(right, "k", "left")
    assert sorted(map(tuple, got.select("k", "i", "v").collect()), key=str) == sorted(
        map(tuple, want.select("k", "i", "v").collect()), key=str
    )


def session_with(folder, master):
    context = SimpleNamespace(getCheckpointDir=lambda: None, master=master, applicationId="x")
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)


def test_shared_folder_follows_the_session():
    assert runtime.scratch_path(session_with("hdfs:///shared/", "yarn"), "t").startswith("hdfs:///shared/t-")


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        runtime.shared_folder(session_with(None, "yarn"))
