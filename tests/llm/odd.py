"""Documents with nulls, empty and very long texts, ties, repeated rows and clashing column names."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [
        T.StructField(n, T.StringType())
        for n in "key size _t1 _t2 _copies n_lines kept n_removed score total rejected sequence_id copies".split()
    ]
)
EXTRA = tuple(f"x{i}" for i in range(len(SCHEMA) - 5))
LONG = "a long text of many words. " * 20_000


def rows():
    texts = [
        (1, "One line here\nand another line\nlast line", "en", "s1"),
        (2, "One line here\nand another line\nlast line", "en", "s1"),
        (2, "One line here\nand another line\nlast line", "en", "s1"),
        (3, None, "en", "s2"),
        (4, "", None, "s2"),
        (5, " \t\n ", "en", None),
        (6, LONG, "en", "s1"),
        (7, "äöü ß ÉÀ — 日本語 \U0001f600 x", "de", "s3"),
        (8, "einige deutsche Wörter und noch mehr deutsche Wörter", "de", "s3"),
        (None, "no id here", "en", None),
        (None, "no id here", "en", None),
        (9, "12345 67890", "fr", "s3"),
    ]
    return [(i, t, lang, s, len(t or ""), *EXTRA) for i, t, lang, s in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
