"""Groups of entries by shared variants of their names, formed greedily in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import Keep, written


def _running_least(rows: DataFrame) -> DataFrame:
    """``row, old, group``: rows (``k, block, row, old``) with ``group`` the least ``old`` of all rows of the same k up to the row.

    A key's rows are spread over the blocks of the order, so that a key of very many rows is many pieces: least ones
    run within a piece, and over the least ones of the pieces before it, of which a key has at most one a block.
    """
    piece = Window.partitionBy("k", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    least = rows.groupBy("k", "block").agg(F.min("old").alias("_g")).select("k", "block", F.min("_g").over(before).alias("_before"))
    return rows.withColumn("group", F.min("old").over(piece)).join(least, ["k", "block"]).select("row", "old", F.least("group", "_before").alias("group"))


def greedy_groups(entries: DataFrame, keep: Keep = written) -> DataFrame:
    """``category, id, lead_id``: entries (``category, id, priority, variants``, an array) in groups, led by their first.

    Taken in order of priority (null: 100), then id, an entry joins the first group of its category that holds one of
    its variants, and brings its own along; with none it begins a group. An entry that would fit two groups joins the
    first and never merges them, so groups are finer than connected components.

    An entry's group is the least of itself and of the groups of earlier entries that share a variant with it. These
    equations have one solution, so they are iterated from "each its own group" until nothing changes: a round takes
    running minima along each variant, then lets each entry take the group of its leader, which halves long chains.
    Neither a category, a component nor the entries of a variant meet in one task.

    Rows that repeat category, id and priority are one entry with all their variants; null and empty variants are none,
    an entry without variants is alone, a null category is one like others, rows without id are left out.
    """
    row = F.struct(F.coalesce("priority", F.lit(100)).alias("priority"), "id", "category").alias("row")
    given = entries.where("id is not null")
    every = given.select(row).distinct()
    pairs = given.select(row, F.explode("variants").alias("v")).where("v is not null and v <> ''").select(F.struct("row.category", "v").alias("k"), "row").distinct()
    shared = pairs.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    # blocks are ranges of the order; the written table fixes them
    links = keep(pairs.join(shared, "k").repartitionByRange("row").withColumn("block", F.spark_partition_id()), "links")
    groups = keep(links.select("row", F.col("row").alias("group")).distinct(), "groups")
    while True:
        least = keep(_running_least(links.join(groups, "row").withColumnRenamed("group", "old")).groupBy("row", "old").agg(F.min("group").alias("group")), "least")
        lead = least.select(F.col("row").alias("group"), F.col("group").alias("_further"))
        now = keep(least.join(lead, "group").select("row", F.col("_further").alias("group"), (F.col("_further") < F.col("old")).alias("_moved")), "groups")
        groups = now.drop("_moved")
        if now.where("_moved").isEmpty():
            break
    return every.join(groups, "row", "left").select("row.category", "row.id", F.coalesce("group", "row")["id"].alias("lead_id"))
