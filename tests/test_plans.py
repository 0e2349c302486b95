"""The shape of plans: what is read, what is shuffled, what stays out."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from textloom.functions import text as tx
from textloom.operators import bpe, pretokens, sampling, windows
from textloom.plans import tables

FOLDER = "/root/testdata/sf0.001"
# One-row tables meet their counterpart through a scalar or a flag, never through a product.
NO_JAVA_ONLY = {"bpe_merges", "bpe_merges_ws", "bpe_encode", "bpe_roundtrip", "tokenizer_quality", "tokenizer_artifact", "suite_scores"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning")


@pytest.mark.parametrize("name", sorted(set(queries()) - NO_JAVA_ONLY))
def test_no_products(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_labels_read_no_text(spark):
    text = plan(queries()["pass_rate"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in text.replace("source:string,lang:string", "lang:string,source:string")


def test_filters_reach_the_scan(spark):
    assert "EqualTo(event_type,purchase)" in plan(queries()["val_mean_first_n"](spark, FOLDER))


def test_pretokens_and_encoding_do_not_shuffle(spark):
    docs = tables.table(spark, FOLDER, "documents").select("doc_id", "text")
    words = docs.select("doc_id", tx.byte_words_of(F.col("text")))
    assert shuffles(words) == 0 and "Python" not in plan(words)
    tokenizer = bpe.Tokenizer((*bpe.SPECIALS, "a", "b", "ab"), (("a", "b"),))
    assert shuffles(bpe.encode(docs, tokenizer)) == 0


def test_counts_are_combined_before_their_one_shuffle(spark):
    docs = tables.table(spark, FOLDER, "documents").select("text")
    counts = pretokens.word_counts(docs, normalise=False)
    assert shuffles(counts) == 1 and "partial_count" in plan(counts)


def test_windows_shuffle_slices_not_tokens(spark):
    docs = tables.table(spark, FOLDER, "documents").select("doc_id", tx.byte_words_of(F.col("text")).alias("tokens"))
    text = plan(windows.samples(docs, ["doc_id"], 64))
    # the one single partition holds the carried sums, at most one row per partition
    assert "hashpartitioning(bucket" in text and text.count("Exchange SinglePartition") == 1


def test_top_k_is_limited_before_the_shuffle(spark):
    dist = spark.range(10).select(F.lit("c").alias("context"), F.col("id").cast("string").alias("token"), F.rand(1).alias("logit"))
    assert plan(sampling.keep_top_k(dist, 3)).count("WindowGroupLimit") == 2


def test_validation_mean_is_limited_before_the_shuffle(spark):
    assert plan(queries()["val_mean_first_n"](spark, FOLDER)).count("WindowGroupLimit") == 2


def test_greedy_choice_does_not_sort(spark):
    from textloom.operators import ngram

    dist = spark.range(10).select(F.lit("c").alias("context"), F.col("id").cast("string").alias("token"), F.rand(1).alias("logit"))
    text = plan(ngram.greedy(dist))
    assert "Window" not in text and text.count("Exchange") == 1


def test_ascii_texts_are_not_handed_to_python(spark):
    from textloom.functions import text as tx

    docs = spark.createDataFrame([("plain",), ("é",), (None,)], "t string")
    plan = docs.select(tx.nfkc(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.splitlines() if "EvalPython" in x)
    # the argument is null for ASCII texts
    assert "_nfkc_udf(CASE WHEN" in plan or "_nfkc_udf(_" in line, plan
