"""Collections of artifacts: entries as JSON lines by artifact, a manifest for each, and a data source that reads them with findings.

Layout below a root: ``entries/artifact=<name>/*`` (a JSON object a line: id, title, breadcrumb, category, body,
body_sha256, and optionally alternate and parent) and ``manifests`` (a JSON object a line). Entries are written first,
so what has no manifest was never finished.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.components import endless_chains

# What entries and manifests must state, and the values they may have.
ENTRY_FIELDS, MANIFEST_FIELDS = ("id", "title", "breadcrumb", "category", "body", "body_sha256"), ("schema_version", "status", "source_key", "title", "language", "edition", "license", "entry_count", "entries_sha256")
CATEGORIES, SCHEMA_VERSIONS, COMPLETE = ("rule", "spell", "creature", "item", "species", "class", "background", "feat"), (1,), "complete"
ROWS = "artifact string, file string, line long, id string, alternate string, parent string, title string, category string, body string, body_sha256 string, finding string"
MANIFESTS = "artifact string, schema_version int, status string, source_key string, title string, language string, edition string, license string, entry_count long, entries_sha256 string"
#: Lines of a batch.
BATCH = 5000


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file:" + uri.removeprefix("file:"))


def _text(value) -> str | None:
    return None if value is None or value == "" else value if isinstance(value, str) else json.dumps(value) if isinstance(value, (list, dict)) else str(value)


def entry_of(line: str) -> tuple:
    """id, alternate, parent, title, category, body, body_sha256 and finding of a line; the gravest finding alone."""
    try:
        e = json.loads(line)
    except ValueError:
        e = None
    if not isinstance(e, dict):
        return *[None] * 7, "unreadable"
    finding = None
    if any(e.get(f) in (None, "") for f in ENTRY_FIELDS):
        finding = "missing field"
    elif e["category"] not in CATEGORIES:
        finding = "unknown category"
    elif not isinstance(e["breadcrumb"], list):
        finding = "breadcrumb is no list"
    elif hashlib.sha256(str(e["body"]).encode("utf-8", "surrogatepass")).hexdigest() != e["body_sha256"]:
        finding = "wrong hash"
    return *[_text(e.get(f)) for f in ("id", "alternate", "parent", "title", "category", "body", "body_sha256")], finding


class File(InputPartition):
    def __init__(self, artifact: str, path: str):
        self.artifact, self.path = artifact, path


class ArtifactReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[File]:
        """One for each file of entries."""
        system, base = _system(f"{self.root}/entries")
        found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        return [File(unquote(f.path.rpartition("/artifact=")[2].split("/")[0]), f.path) for f in sorted(files, key=lambda f: f.path)] or [File("", "")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        schema = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in ROWS.split(", ")])
        system, _ = _system(self.root)
        rows = []
        with system.open_input_stream(partition.path) as raw:
            for number, line in enumerate(io.BufferedReader(raw, 1 << 20), start=1):
                text = line.decode("utf-8", "replace").strip()
                if text:
                    rows.append((partition.artifact, partition.path.rpartition("/")[2], number, *entry_of(text)))
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class ArtifactSource(DataSource):
    """``spark.read.format("artifacts").option("root", ...)``: the lines of a collection, one partition a file, each with its finding or null."""

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> ArtifactReader:
        return ArtifactReader(self.options["root"])


def lines(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(ArtifactSource)
    return spark.read.format("artifacts").option("root", root).load()


def digest_of(hashes: Column) -> Column:
    """Aggregate digest of hashes that doesn't depend on their order: sums of their parts."""
    pieces = [F.coalesce(F.sum(F.conv(F.substring(hashes, i, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(1, 61, 12)]
    return F.sha2(F.concat_ws("-", F.count("*").cast("string"), *pieces), 256)


def write_collection(written: DataFrame, manifests: DataFrame, root: str) -> None:
    """Write lines (``artifact, value``) and then manifests (MANIFESTS without figures), completed by the figures of what was written."""
    written.write.partitionBy("artifact").text(f"{root}/entries")
    figures = lines(manifests.sparkSession, root).groupBy("artifact").agg(F.count("*").alias("entry_count"), digest_of(F.col("body_sha256")).alias("entries_sha256"))
    manifests.join(figures, "artifact", "left").write.json(f"{root}/manifests")


def checked(spark: SparkSession, root: str, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries of the artifacts without errors, and all findings (``artifact, id, kind``; id null where an artifact is meant).

    expected: what manifests must say (``artifact`` and some of source_key, language, edition). A missing parent is a
    notice: it doesn't keep an artifact out. Parents are named by id or alternate. A chain of parents that never ends
    is reported for each entry that leads into it.
    """
    rows = lines(spark, root)
    said = spark.read.schema(MANIFESTS).json(f"{root}/manifests")
    own = rows.where("finding is not null").select("artifact", "id", F.col("finding").alias("kind"))
    twice = rows.where("id is not null").groupBy("artifact", "id").count().where("count > 1").select("artifact", "id", F.lit("duplicate id").alias("kind"))
    known = rows.select("artifact", F.col("id").alias("parent")).unionByName(rows.select("artifact", F.col("alternate").alias("parent"))).where("parent is not null").distinct()
    below = rows.where("id is not null and parent is not null").select("artifact", "id", "parent")
    absent = below.join(known, ["artifact", "parent"], "left_anti").select("artifact", "id", F.lit("missing parent").alias("kind")).distinct()
    # chains run over ids; a parent named by its alternate stands for that entry
    alias = rows.where("alternate is not null and id is not null").groupBy("artifact", F.col("alternate").alias("parent")).agg(F.min("id").alias("_id"))
    ids = rows.where("id is not null").select("artifact", F.col("id").alias("parent")).distinct().withColumn("_own", F.lit(True))
    named = below.join(ids, ["artifact", "parent"], "left").join(alias, ["artifact", "parent"], "left")
    edges = named.select(F.struct("artifact", "id").alias("node"), F.struct("artifact", F.when(F.col("_own"), F.col("parent")).otherwise(F.coalesce("_id", "parent")).alias("id")).alias("up"))
    endless = endless_chains(edges).select("node.artifact", "node.id", F.lit("parent cycle").alias("kind"))
    found = rows.groupBy("artifact").agg(F.count("*").alias("_n"), digest_of(F.col("body_sha256")).alias("_digest"), F.count_if(F.trim(F.coalesce("body", F.lit(""))) != "").alias("_full"), F.lit(True).alias("_here"))
    lacks = F.lit(False)
    for f in MANIFEST_FIELDS:
        lacks = lacks | F.coalesce(F.col(f).cast("string"), F.lit("")).isin("")
    kinds = {
        "no manifest": F.col("artifact").isNotNull() & ~F.coalesce(F.col("_said"), F.lit(False)), "no entries": F.col("_here").isNull(), "missing manifest field": F.col("_said") & lacks,
        "not complete": F.col("status") != COMPLETE, "unknown version": ~F.col("schema_version").isin(*SCHEMA_VERSIONS), "other count": F.col("entry_count") != F.col("_n"), "other digest": F.col("entries_sha256") != F.col("_digest"),
        "empty": F.col("_full") == 0,
    }
    met = found.join(said.withColumn("_said", F.lit(True)), "artifact", "full")
    if expected is not None:
        fields = [c for c in expected.columns if c != "artifact"]
        met = met.join(expected.select("artifact", F.struct(*fields).alias("_want")), "artifact", "left")
        other = F.lit(False)
        for f in fields:
            other = other | ~F.col(f).eqNullSafe(F.col("_want")[f])
        kinds["other than configured"] = F.col("_want").isNotNull() & F.col("_said") & other
    whole = met.select("artifact", F.lit(None).cast("string").alias("id"), F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in kinds.items()]))).alias("kind"))
    findings = own.unionByName(twice).unionByName(absent).unionByName(endless).unionByName(whole)
    wrong = findings.where("kind <> 'missing parent'").select("artifact").distinct()
    return rows.join(wrong, "artifact", "left_anti").drop("finding"), findings
