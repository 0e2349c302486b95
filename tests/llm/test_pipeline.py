import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import difference, duck
from tests.llm import odd
from tests.llm.test_nearcopies import classes
from textloom.llm import simhash
from textloom.llm.queries import ORACLES, QUERIES
from textloom.runtime import cut

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_with_sql(spark, name):
    assert difference(spark, duck(FOLDER), FOLDER, name, QUERIES, ORACLES) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_keep_columns_and_their_decisions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.unionByName(docs.limit(5)).unionByName(
        spark.createDataFrame([(10**9, "привет мир как дела у вас сегодня", "en", "src1", 30), (10**9 + 1, None, "en", "src2", 0)], docs.schema)
    )
    left = [cut(docs, "start")]
    for name, stage in corpus_pipeline.STAGES:
        left.append(cut(stage(spark, left[-1], FOLDER), name))
    assert all(df.columns == docs.columns for df in left[:-1])
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in left]
    assert ids[0] - ids[1] == {10**9, 10**9 + 1} and ids[1] == ids[2]
    lines = Counter(x.strip().lower() for r in left[1].collect() for x in set(r.text.split("\n")))
    after = {x.strip().lower() for r in left[2].collect() for x in r.text.split("\n")} - {""}
    assert after and not any(lines[x] >= 20 for x in after)
    # every pair by brute force, at five words and 0.8
    alone = len(set(classes([r.text for r in left[2].collect()], 0.8)))
    assert left[3].count() == len(ids[3]) == alone < left[2].count()
    words = [df.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] for df in left[3:5]]
    assert abs(words[0] - words[1]) < 0.2 * words[0]
    assert {r.doc_id for r in left[5].collect()} == ids[4]
    full = left[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count(F.lit(1)), F.sum("n")).first()
    assert full[0] <= 4096 and full[1] <= -(-full[2] // 4096) + 1


def test_stages_take_odd_rows_and_nothing(spark):
    for docs in (odd.documents(spark), odd.nothing(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, FOLDER), name)
        assert docs.columns[0] == "doc_id"


def test_the_library_does_without():
    code = "import sys; sys.modules['textloom.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    root = str(Path(corpus_pipeline.__file__).parent)
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 50, out.stderr


def test_near_copies_are_those_of_the_simhash_query_and_of_the_similarity(spark):
    # seven words again and again: the same majorities, but most shingles stand in one text only
    body = " ".join(["one two three four five six seven"] * 60)
    ends = [" ".join(f"{x}{i}" for i in range(20)) for x in "uv"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    made = [(10**9 + i, f"{body} {end}", "en", "src1", 0) for i, end in enumerate(ends)]
    docs = cut(docs.unionByName(spark.createDataFrame(made, docs.schema)), "start")
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    kept = {r.doc_id for r in stage(spark, docs, FOLDER).collect()}
    of_op2 = {r.doc_id: r.component for r in simhash.near_duplicates(docs, words=4, radius=4).collect()}
    assert len({of_op2[i] for i in kept}) == len(kept)
    assert len(set(classes([f"{body} {end}" for end in ends], 0.8))) == 2 and kept & {10**9, 10**9 + 1} == {10**9}
