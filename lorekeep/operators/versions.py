"""Versions of a table with a tree of digests: two of them are compared from the root down, and only ranges that differ are read.

A version is a folder with ``rows`` (in ranges of ids, sorted, so that files and row groups outside a range are passed
over) and ``tree``: a digest for each leaf, a range of WIDTH ids, and for each node over FAN of the level below. A
digest covers ids, all fields and how often a row stands, in the order of ids, whatever the layout of files. A node
without rows isn't stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import written

WIDTH, FAN = 4096, 16
#: Ranges that are pushed down to the scan as conditions; more are joined.
PUSHED = 200
TREE = "part long, n long, digest string, level int"


def row_digest(df: DataFrame, key: str = "id") -> Column:
    """SHA-256 of all fields by name; a null field isn't an empty one."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)


def _joined(rows: DataFrame, order: str) -> Column:
    """Digest of a bounded number of children in their order."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "_line"))), lambda x: x["_line"]), "\n"), 256)


def tree(df: DataFrame, key: str = "id") -> DataFrame:
    """``part, n, digest, level``: nodes of all levels, leaves at 0, up to where no more than the ranges on both sides of zero are left.

    A leaf gathers at most WIDTH ids; rows that repeat an id are counted before, those with a null id left out.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), row_digest(df, key).alias("_row"))
    counted = rows.groupBy("_key", "_row").agg(F.count("*").alias("_times"))
    # many different rows of one id are summed up first, so that no leaf gathers them
    each = counted.groupBy("_key").agg(F.sum("_times").alias("n"), F.sum(F.conv(F.substring(F.sha2(F.concat_ws("|", "_row", "_times"), 256), 1, 15), 16, 10).cast("decimal(38,0)")).alias("_sum"), F.bit_xor(F.xxhash64("_row", "_times")).alias("_xor"))
    lines = each.select(F.floor(F.col("_key") / WIDTH).alias("part"), "_key", "n", F.concat_ws("|", "_key", "n", "_sum", "_xor").alias("_line"))
    level = written(lines.groupBy("part").agg(F.sum("n").alias("n"), _joined(lines, "_key").alias("digest")).withColumn("level", F.lit(0)), "leaves")
    out, number = level, 0
    while level.where(~F.col("part").isin(-1, 0)).limit(1).count():
        number += 1
        below = level.select(F.floor(F.col("part") / FAN).alias("part"), F.col("part").alias("_child"), "n", F.concat_ws("|", "part", "n", "digest").alias("_line"))
        level = written(below.groupBy("part").agg(F.sum("n").alias("n"), _joined(below, "_child").alias("digest")).withColumn("level", F.lit(number)), f"level{number}")
        out = out.unionByName(level)
    return out.select("part", "n", "digest", "level")


def write_version(df: DataFrame, path: str, key: str = "id") -> None:
    """Write rows and tree of a version."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    tree(stored, key).coalesce(1).write.partitionBy("level").parquet(f"{path}/tree")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TREE).parquet(f"{path}/tree")


def whole_digest(spark: SparkSession, path: str) -> str:
    """One digest of all rows of a version: of the nodes of its topmost level, one or two."""
    nodes = read_tree(spark, path)
    top = nodes.agg(F.max("level")).first()[0]
    return nodes.where(F.col("level") == F.lit(top)).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "part", "n", "digest"))), "\n"), 256)).first()[0]


def differing_ranges(spark: SparkSession, old: str, new: str) -> DataFrame:
    """``part, old_n, new_n``: leaves that differ between two versions, found level by level below nodes that differ."""
    a, b = read_tree(spark, old), read_tree(spark, new)
    tops = [t.agg(F.max("level")).first()[0] for t in (a, b)]
    level = min([t for t in tops if t is not None], default=0)
    below = None
    while True:
        sides = []
        for t, name in ((a, "old"), (b, "new")):
            nodes = t.where(F.col("level") == level).select("part", F.col("n").alias(f"{name}_n"), F.col("digest").alias(f"{name}_digest"))
            sides.append(nodes if below is None else nodes.withColumn("_up", F.floor(F.col("part") / FAN)).join(below, "_up", "left_semi").drop("_up"))
        met = sides[0].join(sides[1], "part", "full").where(~F.col("old_digest").eqNullSafe(F.col("new_digest")))
        met = written(met.select("part", F.coalesce("old_n", F.lit(0)).alias("old_n"), F.coalesce("new_n", F.lit(0)).alias("new_n")), f"differing{level}")
        if level == 0:
            return met
        below, level = met.select(F.col("part").alias("_up")), level - 1


def _rows_of(spark: SparkSession, path: str, parts: DataFrame, key: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    few = [r["part"] for r in parts.select("part").orderBy("part").limit(PUSHED + 1).collect()]
    if len(few) > PUSHED:
        return rows.withColumn("part", F.floor(F.col(key) / WIDTH)).join(parts.select("part"), "part", "left_semi").drop("part")
    within = F.lit(False)
    for p in few:
        within = within | F.col(key).between(p * WIDTH, p * WIDTH + WIDTH - 1)
    return rows.where(within)


def difference(spark: SparkSession, old: str, new: str, key: str = "id") -> DataFrame:
    """``key, change``: rows "added", "removed" or "changed" between two versions; only ranges that differ are read.

    An id that stands in several rows counts as changed where any of them did.
    """
    parts = differing_ranges(spark, old, new)
    sides = []
    for path, name in ((old, "_old"), (new, "_new")):
        rows = _rows_of(spark, path, parts, key).where(F.col(key).isNotNull())
        marked = rows.select(key, row_digest(rows, key).alias("_row")).groupBy(key).agg(F.count("*").alias("_n"), F.min("_row").alias("_low"), F.bit_xor(F.xxhash64("_row")).alias("_xor"))
        sides.append(marked.select(key, F.struct("_n", "_low", "_xor").alias(name)))
    met = sides[0].join(sides[1], key, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return met.select(key, change.alias("change")).where("change is not null")
