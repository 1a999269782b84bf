"""Writes: replacement by source, versions with a pointer, retention, artifacts with hashes."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file:" + uri)


def write_by_source(df: DataFrame, path: str) -> None:
    """Replace the partitions of the sources that df holds; those of other sources stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_key").parquet(path)


def publish(df: DataFrame, root: str, check: Callable[[DataFrame], bool] = lambda _: True, keep: int = 3) -> str:
    """Write df as a new version below root, check what was written, then point to it; returns the version's path.

    A version that fails the check is removed and the pointer stays. Of older versions the newest keep - 1 stay.
    """
    system, base = _system(root)
    number = max([int(v.rpartition("/")[2].split("-")[0][1:]) for v in versions(root)], default=0) + 1
    name = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{root}/{name}")
    if not check(df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")):
        system.delete_dir(posixpath.join(base, name))
        raise ValueError("the new version failed its check")
    scratch = posixpath.join(base, f"_{POINTER}.{uuid.uuid4().hex}")
    with system.open_output_stream(scratch) as out:
        out.write(name.encode())
    system.move(scratch, posixpath.join(base, POINTER))
    for old in versions(root)[:-keep]:
        system.delete_dir(posixpath.join(base, old.rpartition("/")[2]))
    return f"{root}/{name}"


def versions(root: str) -> list[str]:
    """Paths of the versions below root, oldest first."""
    system, base = _system(root)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(f"{root}/{f.base_name}" for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("v"))


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that the pointer names."""
    system, base = _system(root)
    with system.open_input_stream(posixpath.join(base, POINTER)) as f:
        return spark.read.parquet(f"{root}/{f.read().decode()}")


def write_artifact(entries: DataFrame, path: str, title: str) -> dict:
    """Write entries (``id, body``) as JSON lines with the hash of each body, and a manifest beside them; returns the manifest.

    The manifest's digest is that of the sorted bodies' digests, so it doesn't depend on how rows lie in files.
    """
    rows = entries.withColumn("body_sha256", F.sha2("body", 256))
    rows.write.mode("overwrite").json(f"{path}/entries")
    return _write_manifest(entries.sparkSession, path, title)


def _digest(rows: DataFrame) -> tuple[int, int, str]:
    """Rows, rows without a body, and a digest of all bodies' hashes: sums of their parts, which any order of rows gives alike and no task gathers."""
    pieces = [F.coalesce(F.sum(F.conv(F.substring("body_sha256", i, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(1, 61, 12)]
    total = rows.agg(F.count("*"), F.count_if(F.coalesce(F.length("body"), F.lit(0)) == 0), F.sha2(F.concat_ws("-", F.count("*").cast("string"), *pieces), 256)).first()
    return total[0], total[1], total[2]


SCHEMA = "id long, body string, body_sha256 string"


def _write_manifest(spark: SparkSession, path: str, title: str) -> dict:
    n, empty, digest = _digest(spark.read.schema(SCHEMA).json(f"{path}/entries"))
    manifest = {"title": title, "entry_count": n, "empty_content_count": empty, "entries_sha256": digest}
    system, base = _system(path)
    with system.open_output_stream(posixpath.join(base, "manifest.json")) as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an artifact. Raises ValueError where counts or digests differ from the manifest, bodies from their hashes, or ids repeat."""
    system, base = _system(path)
    with system.open_input_stream(posixpath.join(base, "manifest.json")) as f:
        manifest = json.loads(f.read())
    rows = spark.read.schema(SCHEMA).json(f"{path}/entries")
    n, _, digest = _digest(rows)
    wrong = rows.where("body_sha256 <> sha2(body, 256)").count()
    repeated = rows.groupBy("id").count().where("count > 1").count()
    if (n, digest) != (manifest["entry_count"], manifest["entries_sha256"]) or wrong or repeated:
        raise ValueError(f"artifact {manifest['title']} is damaged")
    return rows


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """``book_id, path, export_id``: of each book's artifacts (``book_id, path, export_id``) the one of the greatest export, then path."""
    return artifacts.groupBy("book_id").agg(F.max(F.struct("export_id", "path")).alias("m")).select("book_id", "m.path", "m.export_id")


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none."""
    system, base = _system(path)
    return spark.read.parquet(path) if system.get_file_info(base).type != fs.FileType.NotFound else None


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: whole Markdown files at or below a path; their order is that of the paths."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def described(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, rows, columns``: what given tables hold."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(", ".join(df.columns)).alias("columns")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_columns_of(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """df with the columns of a newer schema (name: type) that it lacks, as nulls; a column of another type is an error."""
    have = dict(df.dtypes)
    if other := {c: (have[c], t) for c, t in schema.items() if c in have and have[c] != t}:
        raise ValueError(f"columns of other types: {other}")
    return df.withColumns({c: F.lit(None).cast(t) for c, t in schema.items() if c not in have})


def export_glossary(glossary: DataFrame, sources: DataFrame, entries: DataFrame, path: str) -> None:
    """Write what a web page needs: the glossary's exact rows, and the sources with their numbers of entries, as JSON lines."""
    counts = entries.groupBy("source_key").agg(F.count("*").alias("entries"))
    glossary.select("term", "target", "official").distinct().write.mode("overwrite").json(f"{path}/glossary")
    sources.join(counts, "source_key", "left").select("source_key", "priority", F.coalesce("entries", F.lit(0)).alias("entries")).write.mode("overwrite").json(f"{path}/sources")


def append_log(rows: DataFrame, path: str) -> bool:
    """Append rows to a log; a log that can't be written is no error, and False is returned."""
    try:
        rows.write.mode("append").parquet(path)
    except Exception:  # noqa: BLE001  a failed log never fails the question
        return False
    return True


def detail_bodies(entities: DataFrame, texts: DataFrame, fallback: DataFrame) -> DataFrame:
    """``kind, id, name, body``: entities (``kind, id`` and name columns, the first non-null of which names it) with their texts (``kind, id, place, text``) in order; the fallback's where they have none."""
    names = [c for c in entities.columns if c not in ("kind", "id")]
    joined = lambda df, c: df.where("text is not null").groupBy("kind", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias(c))
    met = entities.join(joined(texts, "_own"), ["kind", "id"], "left").join(joined(fallback, "_other"), ["kind", "id"], "left")
    return met.select("kind", "id", F.coalesce(*names).alias("name"), F.coalesce("_own", "_other").alias("body"))
