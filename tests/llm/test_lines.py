import re
from collections import defaultdict

from tests.llm import odd
from textloom.llm import linededup


def brute(rows, least):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for n, text in enumerate(rows):
        for line in (text or "").split("\n"):
            seen[key(line)].add(n)
    out = []
    for text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < least]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_lines_of_many_documents_go(spark):
    texts = [f"  Shared LINE\t\nown line {i}\nfor {i % 4}\n\n{'x' * (i % 3)}\nÄ {i % 5}\nä {i % 5}" for i in range(40)]
    texts += [None, "", "\n\n", "shared line", "Shared line\r\nshared line"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    for batches, fanout in ((1, 2), (3, 2), (5, 3)):
        got = linededup.dedup(docs, min_docs=10, batches=batches, fanout=fanout).collect()
        assert sorted((r.text, r.n_lines, r.n_dropped) for r in got) == brute(texts, 10)
    assert spark.catalog.listTables() == []


def test_odd_rows(spark):
    docs = odd.documents(spark)
    got = linededup.dedup(docs, min_docs=3)
    assert got.columns == [*docs.columns, "_n_lines", "n_dropped"]
    texts = [r[1] for r in odd.rows()]
    assert sorted((r.text, r["_n_lines"], r.n_dropped) for r in got.collect()) == brute(texts, 3)
    assert linededup.dedup(odd.nothing(spark)).count() == 0
