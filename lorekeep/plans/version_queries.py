"""Registered queries over versions with digests, and artifacts with planted faults."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import versions
from ..operators.components import shared_folder
from ..sources import artifact_source, corpus
from ..sources.corpus import ENTRIES_SQL, table
from .registry import query


def _two_versions(spark, sf_dir) -> tuple[str, str]:
    """The entries, and the entries after some were removed, changed and added."""
    root = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    e = corpus.entries(spark, sf_dir)
    changed = e.where("id % 97 <> 5").withColumn("body", F.when(F.col("id") % 89 == 3, F.concat(F.coalesce("body", F.lit("")), F.lit(" more"))).otherwise(F.col("body"))).withColumn("name", F.when(F.col("id") % 103 == 4, None).otherwise(F.col("name")))
    new = changed.unionByName(e.where("id % 101 = 7").withColumn("id", F.col("id") + 10_000_000))
    versions.write_version(e, f"{root}/old")
    versions.write_version(new, f"{root}/new")
    return f"{root}/old", f"{root}/new"


_CHANGES = f"""{ENTRIES_SQL}, c AS (SELECT id, CASE WHEN id % 97 = 5 THEN 'removed' WHEN id % 89 = 3 OR id % 103 = 4 AND name IS NOT NULL THEN 'changed' END AS change FROM entries
UNION ALL SELECT id + 10000000, 'added' FROM entries WHERE id % 101 = 7)"""


@query(f"WITH {_CHANGES} SELECT id, change FROM c WHERE change IS NOT NULL")
def version_difference(spark, sf_dir):
    return versions.difference(spark, *_two_versions(spark, sf_dir))


@query(f"""WITH {_CHANGES}, n AS (SELECT id, true AS old, id % 97 <> 5 AS new FROM entries UNION ALL SELECT id + 10000000, false, true FROM entries WHERE id % 101 = 7),
p AS (SELECT DISTINCT CAST(floor(id / 4096) AS BIGINT) AS part FROM c WHERE change IS NOT NULL) SELECT part, count(*) FILTER (old) AS old_n, count(*) FILTER (new) AS new_n FROM n JOIN p ON CAST(floor(id / 4096) AS BIGINT) = part GROUP BY part""")
def version_ranges(spark, sf_dir):
    """Leaves that differ: all that the comparison reads."""
    return versions.differing_ranges(spark, *_two_versions(spark, sf_dir))


def planted_collection(spark, sf_dir) -> str:
    """Five artifacts made of the documents, with a fault of each kind; returns their root."""
    root = f"{shared_folder(spark)}/artifacts-{uuid.uuid4().hex}"
    i = F.col("doc_id")
    parent = F.when(i % 200 == 100, i + 5).when(i % 187 == 13, -i).when((i >= 5) & (i % 25 >= 5), i - 5)
    body = F.concat(F.lit("x"), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").select(
        i, F.concat(F.lit("a"), i % 5).alias("artifact"), i.cast("string").alias("id"), F.when(i % 7 == 0, F.concat(F.lit("alt"), i)).alias("alternate"), F.when((i % 7 == 5) & (i % 25 == 5), F.concat(F.lit("alt"), i - 5)).otherwise(parent.cast("string")).alias("parent"),
        F.when(i % 199 != 5, F.concat(F.lit("Title "), i)).alias("title"), F.array(F.lit("Book")).alias("breadcrumb"), F.when(i % 197 == 7, "odd").otherwise("rule").alias("category"), body.alias("body"), F.when(i % 211 == 3, "0" * 64).otherwise(F.sha2(body, 256)).alias("body_sha256"),
    )
    rows = rows.unionByName(rows.where("doc_id % 191 = 11"))
    line = F.to_json(F.struct(*[c for c in rows.columns if c not in ("doc_id", "artifact")]))
    manifest = spark.createDataFrame([(f"a{n}", 2 if n == 4 else 1, "partial" if n == 3 else "complete", f"a{n}", None if n == 1 else "Book", "en", "2024", "open") for n in range(5)], "artifact string, schema_version int, status string, source_key string, title string, language string, edition string, license string")
    artifact_source.write_collection(rows.select("artifact", "doc_id", line.alias("v")).select("artifact", F.when(i % 193 == 9, F.expr("left(v, length(v) - 5)")).otherwise(F.col("v")).alias("value")), manifest, root)
    return root


_ARTIFACTS = """d AS (SELECT doc_id AS i, 'a' || doc_id % 5 AS artifact, doc_id % 193 = 9 AS broken FROM documents), n AS (SELECT * FROM d WHERE NOT broken),
e AS (SELECT i, CASE WHEN i % 7 = 5 AND i % 25 = 5 THEN i - 5 WHEN i % 200 = 100 THEN i + 5 WHEN i % 187 = 13 THEN -i WHEN i >= 5 AND i % 25 >= 5 THEN i - 5 END AS up, artifact FROM n),
c AS (SELECT e.i, p.i AS at, 1 AS step FROM e JOIN n p ON p.i = e.up UNION ALL SELECT c.i, p.i, step + 1 FROM c JOIN e ON e.i = c.at JOIN n p ON p.i = e.up WHERE step < 40)"""


@query(f"""WITH RECURSIVE {_ARTIFACTS} SELECT artifact, CAST(i AS VARCHAR) AS id, CASE WHEN i % 199 = 5 THEN 'missing field' WHEN i % 197 = 7 THEN 'unknown category' ELSE 'wrong hash' END AS kind FROM n JOIN (SELECT 1 UNION ALL SELECT 2) t(k) ON k = 1 OR i % 191 = 11 WHERE i % 199 = 5 OR i % 197 = 7 OR i % 211 = 3
UNION ALL SELECT artifact, NULL, 'unreadable' FROM d JOIN (SELECT 1 UNION ALL SELECT 2) t(k) ON k = 1 OR i % 191 = 11 WHERE broken UNION ALL SELECT artifact, CAST(i AS VARCHAR), 'duplicate id' FROM n WHERE i % 191 = 11
UNION ALL SELECT artifact, CAST(i AS VARCHAR), 'missing parent' FROM e WHERE up IS NOT NULL AND up NOT IN (SELECT i FROM n) UNION ALL SELECT DISTINCT e.artifact, CAST(c.i AS VARCHAR), 'parent cycle' FROM c JOIN e USING (i) WHERE step = 40
UNION ALL SELECT * FROM (VALUES ('a1', NULL, 'missing manifest field'), ('a3', NULL, 'not complete'), ('a4', NULL, 'unknown version'), ('a2', NULL, 'other than configured')) v""")
def artifact_findings(spark, sf_dir):
    """What is wrong with a collection of artifacts, a fault of each kind planted."""
    expected = spark.createDataFrame([(f"a{n}", "de" if n == 2 else "en", "2024") for n in range(5)], "artifact string, language string, edition string")
    return artifact_source.checked(spark, planted_collection(spark, sf_dir), expected)[1]
