"""Collections of artifacts: findings of each kind, and artifacts that may be read."""

import hashlib
import json
import uuid

from lorekeep.sources import artifact_source


def collection(spark, lines, manifests, complete=True):
    root = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/artifacts-{uuid.uuid4().hex}"
    written = spark.createDataFrame(lines, "artifact string, value string")
    if complete:
        artifact_source.write_collection(written, spark.createDataFrame(manifests, "artifact string, schema_version int, status string, source_key string, title string, language string, edition string, license string"), root)
    else:
        written.write.partitionBy("artifact").text(f"{root}/entries")
        spark.createDataFrame(manifests, artifact_source.MANIFESTS).write.json(f"{root}/manifests")
    return root


def line(i, body="b", **more):
    return json.dumps({"id": i, "title": "t", "breadcrumb": ["x"], "category": "rule", "body": body, "body_sha256": hashlib.sha256(body.encode()).hexdigest()} | more)


def said(name, **more):
    return tuple(({"artifact": name, "schema_version": 1, "status": "complete", "source_key": name, "title": "T", "language": "en", "edition": "2024", "license": "l"} | more).values())


def found(frame):
    return sorted((r.artifact, r.id or "", r.kind) for r in frame.collect())


def test_good_and_bad_artifacts(spark):
    lines = [("good", line(1)), ("good", line(2, parent=1, alternate="z")), ("good", line(3, parent="z")), ("good", line(4, parent=99)), ("good", "  "), ("bad", line(1, parent=2)), ("bad", line(2, parent=1)), ("bad", line(5, parent=1)),
             ("bad", "{"), ("bad", "[]"), ("bad", line(6, title="")), ("bad", line(7, breadcrumb="x")), ("bad", line(8, body_sha256="0")), ("bad", line(9)), ("bad", line(9)), ("bad", line(10, category="?")), ("left", line(1)), ("e é/=x", line(1, " "))]
    root = collection(spark, lines, [said("good"), said("bad"), said("e é/=x"), said("none")])
    entries, findings = artifact_source.checked(spark, root)
    got = found(findings)
    assert [x for x in got if x[0] == "good"] == [("good", "4", "missing parent")]
    assert [x[1:] for x in got if x[0] == "bad"] == sorted([("", "unreadable"), ("", "unreadable"), ("1", "parent cycle"), ("2", "parent cycle"), ("5", "parent cycle"), ("6", "missing field"), ("7", "breadcrumb is no list"), ("8", "wrong hash"), ("9", "duplicate id"), ("10", "unknown category")])
    assert ("left", "", "no manifest") in got and ("none", "", "no entries") in got and ("e é/=x", "", "empty") in got
    assert {(r.artifact, r.id) for r in entries.collect()} == {("good", str(i)) for i in (1, 2, 3, 4)}


def test_manifests_are_held_against_what_is_there(spark):
    m = (*said("a"), 2, "0" * 64)
    root = collection(spark, [("a", line(1))], [m], complete=False)
    expected = spark.createDataFrame([("a", "de")], "artifact string, language string")
    assert {k for _, _, k in found(artifact_source.checked(spark, root, expected)[1])} == {"other count", "other digest", "other than configured"}


def test_source_has_a_partition_a_file_and_reads_nothing_from_an_empty_root(spark, tmp_path):
    root = collection(spark, [(f"a{i}", line(i)) for i in range(4)], [said(f"a{i}") for i in range(4)])
    assert artifact_source.lines(spark, root).rdd.getNumPartitions() >= 4
    (tmp_path / "manifests").mkdir()
    entries, findings = artifact_source.checked(spark, f"file://{tmp_path}")
    assert entries.count() == 0 and findings.count() == 0
