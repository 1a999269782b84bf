"""Digest trees of versions against full outer joins."""

import uuid

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import versions


def new_root(spark):
    return f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/v-{uuid.uuid4().hex}"


def pairs(frame):
    return sorted((r[0], r[1]) for r in frame.collect())


def written(spark, *frames):
    root = new_root(spark)
    for i, f in enumerate(frames):
        versions.write_version(f, f"{root}/{i}")
    return [f"{root}/{i}" for i in range(len(frames))]


def test_whole_digest_depends_on_content_alone(spark):
    rows = spark.range(-3000, 20_000, 3).select("id", F.concat(F.lit("x"), "id").alias("body"))
    a, b, c = written(spark, rows, rows.orderBy(F.rand(1)).repartition(7), rows.withColumn("body", F.when(F.col("id") == 300, None).otherwise(F.col("body"))))
    assert versions.whole_digest(spark, a) == versions.whole_digest(spark, b) != versions.whole_digest(spark, c)
    assert versions.difference(spark, a, b).count() == 0 and versions.differing_ranges(spark, a, b).count() == 0
    assert pairs(versions.difference(spark, a, c)) == [(300, "changed")]
    assert [tuple(r) for r in versions.differing_ranges(spark, a, c).collect()] == [(0, 1366, 1366)] or versions.differing_ranges(spark, a, c).count() == 1


@pytest.mark.parametrize("pushed", [200, 0])
def test_changes_far_apart(spark, monkeypatch, pushed):
    monkeypatch.setattr(versions, "PUSHED", pushed)
    old = spark.createDataFrame([(1, "a"), (5000, "b"), (-9, "c"), (1 << 50, "d"), (7, None), (8, ""), (9, "twice"), (9, "other"), (None, "n")], "id long, body string")
    new = spark.createDataFrame([(1, "a"), (5000, "B"), (-9, "c"), ((1 << 50) + 1, "d"), (7, ""), (8, ""), (9, "other"), (9, "twice"), (1 << 62, "far")], "id long, body string")
    a, b, none = written(spark, old, new, old.where("false"))
    want = [(7, "changed"), (5000, "changed"), (1 << 50, "removed"), ((1 << 50) + 1, "added"), (1 << 62, "added")]
    assert pairs(versions.difference(spark, a, b)) == sorted(want)
    assert pairs(versions.difference(spark, none, b)) == sorted({(r.id, "added") for r in new.collect()})
    assert versions.difference(spark, none, none).count() == 0


def test_only_differing_ranges_are_read(spark):
    rows = spark.range(0, 100_000).select("id", F.concat(F.lit("x"), "id").alias("body"))
    a, b = written(spark, rows, rows.where("id <> 50000"))
    assert [tuple(r) for r in versions.differing_ranges(spark, a, b).collect()] == [(12, 4096, 4095)]
    plan = versions.difference(spark, a, b)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,49152)" in plan and "LessThanOrEqual(id,53247)" in plan


def test_one_id_with_many_rows(spark):
    rows = spark.range(5000).select(F.lit(3).cast("long").alias("id"), (F.col("id") % 700).alias("v"))
    a, b = written(spark, rows, rows.where("v <> 699"))
    assert pairs(versions.difference(spark, a, b)) == [(3, "changed")]
