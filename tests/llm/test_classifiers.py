import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import odd
from textloom.llm import langid, toxicity
from textloom.llm.common import held_out
from textloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def learn():
    return ~held_out(F.col("doc_id"))


def test_language_on_held_out_documents(spark):
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op5_language_id"](spark, FOLDER).join(truth, "doc_id")
    right, held, least, most = (
        got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    )
    assert right > 0.97 and held > 100 and 0 <= least <= most <= 1
    assert got.filter("rejected").count() == 0


def test_language_of_odd_rows(spark):
    docs = odd.documents(spark)
    got = langid.predict(docs, langid.fit(docs, learn()))
    assert got.columns == [*docs.columns, "lang_pred", "_score", "_rejected"]
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[i].lang_pred for i in (3, 4, 5, 9)] == ["und"] * 4
    assert all(rows[i]["_rejected"] and rows[i]["_score"] == 0 for i in (3, 4, 5, 9))
    assert {rows[i].lang_pred for i in (1, 2, 6, 7, 8)} <= {"en", "de"}
    kept = langid.keep_known(docs, learn())
    assert kept.columns == docs.columns and {3, 4, 5, 9}.isdisjoint({r.doc_id for r in kept.collect()})
    model = langid.fit(odd.nothing(spark), learn())
    assert model.langs == [] and langid.predict(odd.nothing(spark), model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}


def test_far_texts_are_rejected_and_seams_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(docs, learn())
    strange = ["привет мир как дела у вас", "これは日本語のテキストです", "xq zqx wvv kjq xzzk qqj", "Von.", "the thing is that it was on"]
    rows = spark.createDataFrame(list(enumerate(strange)), "doc_id int, text string")
    assert [r.rejected for r in langid.predict(rows, model).orderBy("doc_id").collect()] == [True, True, True, False, False]
    text = "Some words, été 12  and\n more-" * 30
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "_CHUNK", 17)
    assert (whole == langid.counts(text)).all()


def test_small_clusters_are_left_out():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.abs(rng.normal(size=(100, 8)) * 0.1 + c) for c in np.eye(8)[:2]] + [np.eye(8)[7:8]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centers = langid.cluster(x, 4)
    assert (centers @ np.eye(8)[7] < 0.9).all() and all((centers @ np.eye(8)[k]).max() > 0.9 for k in (0, 1))


def labelled(spark, n=600):
    """A third toxic: insults in some, clean ones speak of the same things."""
    rows, labels, rnd = [], [], random.Random(5)
    for i in range(n):
        toxic = i % 3 == 0
        filler = " ".join(rnd.choice("abcdefgh") + rnd.choice("aeiou") * 3 + rnd.choice("klmnop") * 2 + rnd.choice("rstuvw") for _ in range(20))
        rows.append((i, f"{filler}. You are a {'blork' if i % 2 else 'zurgish'} {filler}. blork!" if toxic else f"{filler}. You are kind. {filler}"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxic_words_are_learned_and_held_out_rows_found(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, learn())
    assert {"blork", "zurgish"} <= set(model.words) and "kind" not in model.words
    got = toxicity.totals(docs, model).join(labels, "doc_id").filter(held_out(F.col("doc_id")))
    assert got.filter((F.col("score") >= 0.5) != (F.col("toxic") == 1)).count() == 0 and got.count() > 60


def likened(spark, n=600):
    """The rows of ``labelled`` with fillers that hardly differ but for numbers."""
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        filler = f"word{i % 17} and other things {i}"
        rows.append((i, f"{filler}. You are a {'blork' if i % 2 else 'zurgish'} {filler}. blork!" if toxic else f"{filler}. You are kind. {filler}"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_short_texts_of_common_words_are_learned_from_each(spark):
    docs, labels = likened(spark)
    model = toxicity.fit(docs, labels, learn())
    assert {"blork", "zurgish"} <= set(model.words) and "kind" not in model.words


def test_near_copies_count_once_when_words_are_weighed(spark):
    rnd = random.Random(3)
    drawn = lambda k: ["".join(rnd.choices("abcdefghijklmnop", k=9)) for _ in range(k)]
    body, rows = drawn(200), []
    for i in range(400):
        if i % 4 == 0:  # copies of one text but for a word at the end
            rows.append((i, " ".join(["copied", *body, *drawn(1)]), 1))
        else:
            rows.append((i, " ".join([*drawn(30), *(["blork"] if i % 4 == 1 else [])]), int(i % 4 == 1)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"), learn())
    assert "blork" in model.words and "copied" not in model.words


def test_grammar_reads_clauses():
    model = toxicity.Model({"blork": 4.0}, {"zurg": 3.0}, 2.0, -3.0)
    plain = model.total("this blork stands here")
    assert plain == 4.0 and model.total("zurgish thing") == 3.0 and model.total("zurg") == 0.0
    assert model.total("you are a blork") == 4.0 * 1.25
    assert model.total("that is not a blork") == 4.0 * 0.5
    assert model.total("that is not so. blork") == 4.0
    assert model.total("she said that this is a blork") < plain
    assert model.total("i will kill you") > model.total("to kill time") > 0
    assert model.total(None) == model.total("") == model.total("nothing to see") == 0.0
    assert 0 <= model.score(0.0) < model.score(4.0) < model.score(400.0) <= 1


def test_toxicity_of_odd_rows(spark):
    docs = odd.documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (6, 0), (7, None), (None, 1), (77, 0), (1, 1)], "doc_id bigint, toxic int")
    got = toxicity.totals(docs, toxicity.fit(docs, labels, learn()))
    assert got.columns == [c for c in docs.columns if c != "text"] + ["_total", "_score"]
    assert all(0 <= r["_score"] <= 1 for r in got.collect()) and got.count() == docs.count()
    none = toxicity.fit(docs, labels.limit(0), learn())
    assert {r.score < 0.01 for r in toxicity.totals(docs.select("doc_id", "text"), none).collect()} == {True}
    assert toxicity.totals(odd.nothing(spark), none).count() == 0
