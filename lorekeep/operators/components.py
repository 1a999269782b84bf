"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Keep = Callable[[DataFrame, str], DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all machines share; one of our own only where none is set and all runs on one machine."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="lorekeep-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _checkpointed(df: DataFrame, name: str) -> DataFrame:
    """df with its lineage cut, in the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written once to the shared folder and read back; a checkpoint computes its rows twice."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _to_least(edges: DataFrame, rest: str) -> DataFrame:
    """Every edge (u, v) of u becomes (v, m) with m the least of u's neighbours; rest keeps those to move."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.withColumn("m", F.least("m", "u")), "u").where(rest).select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", keep: Keep = _checkpointed) -> DataFrame:
    """``node, component`` for every node of an edge, component being the least node that it can reach.

    Large-star and small-star rounds alternate until the edges are stars: each node hangs on a smaller one of its
    component, in logarithmically many rounds. A round groups by node with map-side minima and joins back, so a hub is
    split like any skewed join. keep(df, name) cuts lineage between rounds. Null ends and loops are left out; repeated
    edges count once; no edges give an empty result.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    stars = keep(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _fingerprint(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, "v > u").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = keep(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = _fingerprint(stars)
        if now == before:
            break
        before = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.distinct())


def endless_chains(edges: DataFrame, keep: Keep = written) -> DataFrame:
    """``node``: nodes of edges (``node, up``: each node's one parent, the least if there are several) from which parents never end, for they lead into a cycle.

    Chains are doubled: after so many rounds that 2 ** rounds is more than the nodes, what still goes on goes round.
    A round carries two keys a node and drops chains that ended.
    """
    up = keep(edges.where("node is not null and up is not null").groupBy("node").agg(F.min("up").alias("up")), "parents")
    nodes, step, going = up.count(), 1, up
    while step <= nodes and not going.isEmpty():
        going = keep(going.select("node", F.col("up").alias("_at")).join(going.select(F.col("node").alias("_at"), "up"), "_at").select("node", "up"), "chains")
        step *= 2
    return going.select("node")
