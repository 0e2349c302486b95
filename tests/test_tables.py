from pyspark.sql import functions as F

from textloom.plans import tables


def test_a_large_run_is_numbered_over_several_tasks(spark):
    events = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500 + 100).alias("user_id"),
        F.pmod(F.col("id") * 7919, F.lit(6000)).alias("ts"),
        F.col("id").alias("event_id"),
    ).unionByName(spark.createDataFrame([(None, 5, 1), (None, 4, 2)], "user_id long, ts long, event_id long"))
    got = tables.numbered(events)
    plain = tables.numbered(events, share=1.0)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    steps = sorted(r.step for r in got.filter("user_id = 7").collect())
    assert steps == list(range(1, 2001))
    tasks = got.filter("user_id = 7").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) > 3 and max(r["count"] for r in tasks) < 1000
