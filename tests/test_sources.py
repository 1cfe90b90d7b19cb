import json
import os

import pytest
from pyspark.errors import PySparkException

from notemill.operators import rules
from notemill.sources import scans, sinks


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode(encoding))
    return str(path)


def test_notes(spark, tmp_path):
    raw = b"1||Doe,Jane||x||Progress||text one \nno separator\n 2||Roe,Rex||ER||bad \xff byte\n3||a\x0c4||b||T||after break\n"
    path = write(tmp_path / "notes" / "n.txt", raw)
    notes = scans.read_notes(spark, path).orderBy("seq").collect()
    assert [(n["patient_id"], n["note_type"], n["note_text"]) for n in notes] == [
        ("1", "Progress", "text one"),
        ("2", "ER", "bad  byte"),
        ("3", "3", "a"),
        ("4", "T", "after break"),
    ]


def test_separated_values(spark, tmp_path):
    path = write(tmp_path / "v" / "v.txt", "a|b|\n*skip|me|\n.skip|me\nx|y|z\nc|d\n")
    rows = scans.read_separated(spark, path, "|", ["one", "two"]).collect()
    assert [tuple(r) for r in rows] == [("a", "b"), ("c", "d")]
    assert scans.read_separated(spark, path, "|").count() == 3
    latin = write(tmp_path / "l" / "l.txt", "é|ü\n", "latin-1")
    assert tuple(scans.read_separated(spark, latin, "|", "one|two", encoding="iso-8859-1").first()) == ("é", "ü")


def test_csv_and_keys(spark, tmp_path):
    path = write(tmp_path / "c" / "c.csv", '1,"x, y"\n2,b\n2,c\n')
    rows = scans.read_csv(spark, path, "mrn string, v string")
    assert [tuple(r) for r in rows.where("mrn = '1'").collect()] == [("1", "x, y")]
    with pytest.raises(ValueError, match="duplicate mrn: '2'"):
        scans.keyed_strict(rows, "mrn")
    last = scans.keyed_last(rows.selectExpr("*", "v AS seq"), "mrn", "seq")
    assert dict(last.select("mrn", "v").collect()) == {"1": "x, y", "2": "c"}


def test_labelled_corpus_and_inventory(spark, tmp_path):
    root = tmp_path / "corpus"
    write(root / "yes" / "7.txt", "first\nsecond")
    write(root / "no" / "8.txt", "other")
    docs = scans.read_labelled_corpus(spark, str(root)).orderBy("doc_id").collect()
    assert [tuple(d) for d in docs] == [("7", 1, "first\nsecond"), ("8", 0, "other")]
    files = scans.file_inventory(spark, str(root), recurse=True, full_path=False).orderBy("path").collect()
    assert [tuple(f) for f in files] == [("7.txt", 12), ("8.txt", 5)]


def test_json_and_lists(spark, tmp_path):
    path = write(tmp_path / "r.json", json.dumps(["a.b", "c"]))
    assert rules.load_rules(spark, path) == ["a.b", "c"]
    assert rules.load_rules(spark, write(tmp_path / "r.txt", "x\ny\n")) == ["x", "y"]
    nested = write(tmp_path / "n.json", json.dumps([{"f1": 0.5, "options": {"C": "1"}}]))
    got = scans.read_json(spark, nested, "f1 double, options map<string,string>").first()
    assert (got["f1"], got["options"]) == (0.5, {"C": "1"})


def test_corpus_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("1", 0, "a"), ("2", 1, "b")], "doc_id string, label int, text string")
    path = str(tmp_path / "out")
    sinks.write_corpus(docs.where("label = 0"), path)
    sinks.write_corpus(docs.where("label = 1"), path)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select("doc_id", "label", "text").collect())) == [("1", 0, "a"), ("2", 1, "b")]
    sinks.write_json(docs, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    sinks.write_report(docs, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["doc_id", "label", "text"]


def test_text_files_are_read_back_with_their_ids(spark, tmp_path):
    path = str(tmp_path / "text")
    rows = [("0012345", 1, "first\nsecond  line\n"), ("0000007", 0, ""), ("7", 0, None), ("a-1.b", 1, "é漢")]
    docs = spark.createDataFrame(rows, "doc_id string, label int, text string").repartition(2)
    sinks.write_text(docs, path, classes=("no", "yes"))
    back = scans.read_labelled_corpus(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted((i, n, t or "\n") for i, n, t in rows)
    more = spark.createDataFrame([("8", 0, "later"), ("7", 0, "replaced")], docs.schema)
    sinks.write_text(more, path, classes=("no", "yes"))
    held = {r["doc_id"]: r["text"] for r in scans.read_labelled_corpus(spark, path).collect()}
    assert len(held) == 5 and (held["7"], held["8"]) == ("replaced", "later")
    sinks.write_text(more, path, classes=("no", "yes"), mode="overwrite")
    assert scans.read_labelled_corpus(spark, path).count() == 2
    assert sorted(p.name for p in (tmp_path / "text").iterdir()) == ["_SUCCESS", "no"]


def test_refused_names_leave_nothing_behind(spark, tmp_path):
    path = tmp_path / "text"
    twice = spark.createDataFrame([("1", "a", "x"), ("1", "a", "y")], "doc_id string, label string, text string")
    with pytest.raises(ValueError, match="a/1.txt"):
        sinks.write_text(twice, str(path))
    for name in ("../1", ".hidden", "", None):
        wrong = spark.createDataFrame([("5", "a", "x"), (name, "a", "y")], twice.schema).coalesce(1)
        with pytest.raises(PySparkException):
            sinks.write_text(wrong, str(path))
    assert [p for p in path.rglob("*") if p.is_file()] == []
    sinks.write_text(spark.createDataFrame([], twice.schema), str(path))
    assert scans.read_labelled_corpus(spark, str(path), ("a",)).count() == 0
