import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import artifacts, bpe, corpus, documents
from textloom.sources import files, logs, tokenizer_files


@pytest.fixture()
def raw(tmp_path):
    contents = {
        "a.py": b"404: Not Found",
        "a2.py": b" 404: Not Found\n",
        "b.py": b"def f():\n    return 12\n"[:22],
        "c.py": b"valid text \xff\xfe\xc3\xa9",
        "d.py": b" " * 12,
        "e.py": b"123456789",
        "f.py": b"1234567890",
        "g.py": b"a = 1\r\nb = 2\rc = 3\n",
        "note.md": b"not a source file",
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_scan_code_and_screen(spark, raw):
    scanned = files.scan_code(spark, str(raw))
    reasons = {r.name: r.reason for r in documents.screen(scanned).collect()}
    assert reasons == {
        "a.py": "not_found", "a2.py": "not_found", "b.py": None, "c.py": None, "d.py": "blank",
        "e.py": "short", "f.py": None, "g.py": None,
    }
    texts = {r.name: r.text for r in scanned.collect()}
    assert texts["c.py"] == "valid text é" and texts["g.py"] == "a = 1\nb = 2\nc = 3\n"
    counts = documents.intake_counts(documents.screen(scanned)).first()
    assert (counts.processed, counts.skipped) == (4, 4)


def test_unreadable_files_are_rows_or_errors(spark, raw):
    # a wrong checksum makes reading fail
    (raw / ".b.py.crc").write_bytes(b"crc\0" + (512).to_bytes(4, "big") + b"\1\2\3\4")
    with pytest.raises(Exception, match="(?i)checksum|FAILED_READ_FILE"):
        files.scan_code(spark, str(raw)).collect()
    screened = documents.screen(files.scan_code(spark, str(raw), on_error="report"))
    assert {r.name: r.reason for r in screened.collect()}["b.py"] == "unreadable"
    counts = documents.intake_counts(screened).first()
    assert (counts.processed, counts.skipped) == (3, 5)


def test_empty_source(spark, tmp_path):
    with pytest.raises(files.EmptySource):
        files.scan_books(spark, str(tmp_path))
    assert files.scan_books(spark, str(tmp_path), on_empty="empty").count() == 0
    assert files.scan_books(spark, str(tmp_path), on_empty="dummy").first().text == files.DUMMY_TEXT


def test_recursive_scan_in_path_order(spark, tmp_path):
    for at, text in {"z.txt": "one", "sub/a.txt": "two", "sub/deep/b.txt": "three", "c.py": "no"}.items():
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(text)
    rows = files.scan_corpus(spark, str(tmp_path)).collect()
    assert [r.text for r in rows] == ["two", "three", "one"]


def test_mixed_corpus_file(spark, tmp_path):
    code = spark.createDataFrame(
        [("x/b.py", "print('bbbbb')\n"), ("x/a.py", "import aaaaa"), ("x/c.py", "short")], "name string, text string"
    )
    books = spark.createDataFrame(
        [("y/two.txt", "l1\nl2\nl3\n"), ("y/one.txt", "only line")], "name string, text string"
    )
    mixed = corpus.mixture(code, books, code_weight=2, book_lines=2)
    files.write_corpus_text(corpus.rendered(mixed, 2), str(tmp_path / "out"), partitions=3)
    got = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    sections = [
        "# === CODE SECTION %d/2 ===\n\n" % i
        + "# File: a.py\nimport aaaaa\n\n" + "# File: b.py\nprint('bbbbb')\n\n\n" + "\n\n"
        for i in (1, 2)
    ]
    excerpts = ["\n# === BOOK EXCERPT: one.txt ===\n\nonly line\n\n", "\n# === BOOK EXCERPT: two.txt ===\n\nl1\nl2\n\n\n"]
    assert got == "".join(sections + excerpts)


def test_catalogue_reads_no_content(spark, tmp_path):
    for name, size in {"best_step_500.pt": 1048576, "best_step_6500.pt": 10, "final-ckpt.pt": 5}.items():
        (tmp_path / name).write_bytes(b"\0" * size)
    listed = files.catalogue(spark, str(tmp_path))
    rows = {r.name: (r.step, r.size_mb) for r in artifacts.described(listed).collect()}
    assert rows["best_step_500"] == (500, 1.0) and rows["final-ckpt"][0] == 999999
    assert artifacts.latest_best(artifacts.described(listed)).first().name == "best_step_6500"
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_newest_artifacts_and_fallback(spark):
    rows = [(f"/c/checkpoint_step_{i}.pt", i, i) for i in range(7)]
    listed = artifacts.described(
        spark.createDataFrame(rows, "path string, size_bytes bigint, t int").withColumn(
            "modified", F.timestamp_seconds("t")
        )
    )
    newest = artifacts.newest(listed).collect()
    assert [r.step for r in newest] == [6, 5, 4, 3, 2] and {r.more for r in newest} == {2}
    assert artifacts.latest_best(listed).first().step == 6
    assert [r.step for r in artifacts.by_step(listed).collect()] == list(range(7))


def test_log_array_and_lines(spark, tmp_path):
    log = [
        {"step": 20, "loss": 3.0, "perplexity": 20.0, "lr": 1e-5},
        {"step": 500, "loss": 2.0, "perplexity": 7.4, "lr": 1e-4},
        {"step": 500, "val_loss": 2.5, "val_perplexity": 12.2},
    ]
    (tmp_path / "run7.json").write_text(json.dumps(log, indent=2))
    rows = logs.read_log_array(spark, str(tmp_path / "run7.json"))
    assert [(r.run, r.step, r.loss, r.val_loss) for r in rows.collect()] == [
        ("run7", 20, 3.0, None), ("run7", 500, 2.0, None), ("run7", 500, None, 2.5),
    ]
    out = str(tmp_path / "lines")
    logs.append_log(rows, out)
    logs.append_log(rows.filter("step = 20"), out)
    (tmp_path / "lines" / "part-cut.json").write_text('{"run": "run7", "step": 40, "lo')
    assert logs.read_log_lines(spark, out).count() == 4
    assert logs.log_intake(spark, out).agg(F.sum("whole"), F.sum("cut")).first()[:] == (4, 1)


def test_results(spark, tmp_path):
    baseline = {"loss": 5.5, "perplexity": 247.96, "bracket_test": 0, "repeat_test": 0, "alphabet_test": 1,
                "sentence_test": 0, "sample_generation": "In the city"}
    (tmp_path / "baseline.json").write_text(json.dumps(baseline, indent=4))
    row = logs.read_baseline(spark, str(tmp_path / "baseline.json")).first()
    assert (row.run, row.perplexity, row.alphabet_test) == ("baseline", 247.96, 1)
    suite = {
        "bracket_completion": {"score": 0.5, "details": [{"prompt": "(", "expected": ")", "predicted": ")", "passed": True}]},
        "keyword_completion": {"score": 0.2, "details": [{"prompt": "if ", "acceptable": ["x"], "predicted": "y", "passed": False}]},
        "code_perplexity": {"average_perplexity": 120.0, "samples": [{"sample": "a", "perplexity": 1.5}], "score": 0.0},
        "summary": {"overall_score": 0.3},
    }
    (tmp_path / "eval.json").write_text(json.dumps(suite, indent=2))
    results = logs.read_suite_results(spark, str(tmp_path / "eval.json"))
    assert results.first().summary.overall_score == 0.3
    metrics = {r.metric: r.value for r in logs.suite_metrics(results).collect()}
    assert metrics == {"bracket_completion": 0.5, "keyword_completion": 0.2, "code_perplexity": 120.0}
    details = logs.suite_details(results).collect()
    assert [(d.test, d.passed) for d in details] == [("bracket_completion", True), ("keyword_completion", False)]


def test_word_scheme_artifact(spark, tmp_path):
    artifact = {
        "version": "1.0",
        "added_tokens": [{"id": i, "content": t, "special": True} for i, t in enumerate(bpe.SPECIALS)],
        "normalizer": {"type": "NFKC"},
        "pre_tokenizer": {"type": "Whitespace"},
        "model": {"type": "BPE", "unk_token": "[UNK]", "vocab": {**{t: i for i, t in enumerate(bpe.SPECIALS)}, "a": 4, "b": 5, "ab": 6},
                  "merges": [["a", "b"]]},
    }
    (tmp_path / "t.json").write_text(json.dumps(artifact, indent=2))
    tokenizer = tokenizer_files.load_artifact(spark, str(tmp_path / "t.json"))
    docs = spark.createDataFrame([("ab b, a",)], "text string")
    row = bpe.encode(docs, tokenizer).select("ids", bpe.decoded(F.col("ids"), tokenizer).alias("d")).first()
    assert row.ids == [6, 5, 0, 4] and row.d == "ab b a"
