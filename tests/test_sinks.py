import json

import pytest

from lorekeep.operators import repair
from lorekeep.sources import sinks


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_only_named_sources_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_by_source(spark.createDataFrame([(1, "a"), (2, "b")], "id long, source_key string"), path)
    sinks.write_by_source(spark.createDataFrame([(3, "b")], "id long, source_key string"), path)
    assert rows(spark.read.parquet(path).select("id", "source_key")) == [(1, "a"), (3, "b")]


def test_versions_are_checked_before_they_count(spark, tmp_path):
    root = "file://" + str(tmp_path / "v")
    frames = [spark.range(n) for n in (1, 2, 3, 4)]
    for f in frames:
        sinks.publish(f, root, lambda df: df.count() > 0, keep=2)
    with pytest.raises(ValueError):
        sinks.publish(spark.range(0), root, lambda df: df.count() > 0)
    assert sinks.current(spark, root).count() == 4 and len(sinks.versions(root)) == 2


def test_artifacts_round_trip_and_damage_is_seen(spark, tmp_path):
    path = "file://" + str(tmp_path / "a")
    made = sinks.write_artifact(spark.createDataFrame([(1, "x"), (2, "y"), (3, "")], "id long, body string"), path, "book")
    assert (made["entry_count"], made["empty_content_count"]) == (3, 1) and sinks.read_artifact(spark, path).count() == 3
    manifest = tmp_path / "a" / "manifest.json"
    manifest.write_text(json.dumps(made | {"entry_count": 4}))
    with pytest.raises(ValueError):
        sinks.read_artifact(spark, path)


def test_torn_words_need_evidence(spark):
    assert repair.rejoined("a won- der is a wonder") == "a wonder is a wonder"
    assert repair.rejoined("a well- known thing") == "a well- known thing"
    frame = spark.createDataFrame([("ﬁre and ﬁ- re",), (None,), ("",)], "body string")
    assert sorted(str(r.repaired) for r in repair.repair_texts(frame).collect()) == ["", "None", "fire and fire"]


def test_reading_what_may_be_missing(spark, tmp_path):
    assert sinks.table_or_none(spark, str(tmp_path / "none")) is None
    spark.range(2).write.parquet(str(tmp_path / "some"))
    assert sinks.table_or_none(spark, str(tmp_path / "some")).count() == 2
    (tmp_path / "md" / "deep").mkdir(parents=True)
    (tmp_path / "md" / "a.md").write_text("# A\nx")
    (tmp_path / "md" / "deep" / "b.md").write_text("# B")
    (tmp_path / "md" / "c.txt").write_text("no")
    assert [r.text for r in sinks.markdown_files(spark, str(tmp_path / "md")).orderBy("path").collect()] == ["# A\nx", "# B"]


def test_columns_are_added_and_never_changed(spark):
    df = sinks.with_columns_of(spark.range(1), {"id": "bigint", "kind": "string"})
    assert df.dtypes == [("id", "bigint"), ("kind", "string")] and df.first().kind is None
    with pytest.raises(ValueError):
        sinks.with_columns_of(spark.range(1), {"id": "string"})


def test_logs_never_fail_and_exports_are_written(spark, tmp_path):
    assert sinks.append_log(spark.range(1), str(tmp_path / "log")) and sinks.append_log(spark.range(2), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    (tmp_path / "file").write_text("")
    assert not sinks.append_log(spark.range(1), str(tmp_path / "file" / "log"))
    g = spark.createDataFrame([("a", "b", 1), ("a", "b", 1)], "term string, target string, official int")
    sources = spark.createDataFrame([("s", 1), ("t", 2)], "source_key string, priority int")
    sinks.export_glossary(g, sources, spark.createDataFrame([("s",), ("s",)], "source_key string"), str(tmp_path / "web"))
    assert rows(spark.read.json(str(tmp_path / "web" / "glossary")).select("term", "target", "official")) == [("a", "b", 1)]
    assert rows(spark.read.json(str(tmp_path / "web" / "sources")).select("source_key", "entries")) == [("s", 2), ("t", 0)]
