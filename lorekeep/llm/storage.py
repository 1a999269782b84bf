"""Files that all executors and the driver share."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the session's spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lorekeep-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back; cuts lineage and survives lost executors.

    group_bytes: for rows of megabytes. A row group closes at so many bytes and a page when it is full; otherwise either
    is looked at after a hundred rows only, and a reader holds all of them at once.
    """
    path = shared_dir(df.sparkSession, name)
    options = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1} if group_bytes else {}
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_file(uri: str, name: str, data: bytes) -> None:
    """Write a file whole: under a name of this attempt's own, then renamed, so a retried task leaves one good file."""
    system, path = fs.FileSystem.from_uri(uri if "://" in uri else "file:" + uri)
    system.create_dir(path, recursive=True)
    scratch = posixpath.join(path, f"_{name}.{uuid.uuid4().hex}")
    with system.open_output_stream(scratch) as out:
        out.write(data)
    system.move(scratch, posixpath.join(path, name))
