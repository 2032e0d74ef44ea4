"""The shared folder, provenance and reports."""

import pytest
from pyspark.sql import functions as F

from dispatchtext.sources import annotated, shared


class Fake:
    """A session of another master."""

    def __init__(self, master, configured=None):
        self.conf = self
        self.sparkContext = self
        self.master, self.configured, self.applicationId = master, configured, master

    def get(self, _key, default=None):
        return self.configured or default


def test_shared_folder_is_the_configured_one_or_local():
    assert shared.shared_dir(Fake("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared.shared_dir(Fake("local[4]")) == shared.shared_dir(Fake("local[4]"))
    for master in ("yarn", "spark://h:1", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            shared.shared_dir(Fake(master))


def test_provenance_and_missing_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a", "v"), (1, 1, "a", "v")], "response_id long, ordinal int, text string, variation string")
    made = annotated.with_provenance(rows, "p", "m").collect()
    assert len({r["id"] for r in made}) == 2 and all(r["variation"] == "v" and r["created_at"].endswith("+00:00") for r in made)
    assert [r["id"] for r in made] == [r["id"] for r in annotated.with_provenance(rows.drop("variation"), "p", "m").collect()]
    assert annotated.read_examples(spark, str(tmp_path / "none")).count() == 0


def test_examples_with_marks_and_blank_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes("﻿".encode() + '{"id":"1","text":"Hà","entities":[{"start":0,"end":2,"label":"PER"}]}\n\n{"id":"2","text":"b"}\n'.encode())
    rows = annotated.read_examples(spark, str(path)).orderBy("id").collect()
    assert [(r["id"], r["text"], r["entities"] and len(r["entities"])) for r in rows] == [("1", "Hà", 1), ("2", "b", None)]


def test_cases_as_array_and_filters(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text('[{"id":"a","layer":"api","input":{"text":"x"}},{"id":"b","layer":"phone","scope":"future","input":{"text":"y"}},{"id":"c","input":{"text_factory":{"character":"z","count":3}}}]')
    cases = annotated.read_cases(spark, str(path), array=True)
    assert sorted((r["id"], r["text"]) for r in cases.collect()) == [("a", "x"), ("c", "zzz")]
    assert [r["id"] for r in annotated.read_cases(spark, str(path), array=True, layer="api").collect()] == ["a"]
    assert [r["id"] for r in annotated.read_cases(spark, str(path), array=True, ids=["c"]).collect()] == ["c"]
    assert annotated.runnable(cases.withColumn("text", F.lit("  "))).count() == 0
