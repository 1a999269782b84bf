"""The query log: totals, exact percentiles, sections of the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row with, for each share p, the value at index min(n - 1, floor(p * n)) of the sorted values.

    Equal values are counted first; only running sums of the counts of value ranges meet in one task.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    ranged = counted.withColumn("r", F.floor(F.col("v") / 10))
    before = ranged.groupBy("r").agg(F.sum("c").alias("rc")).withColumn("start", F.coalesce(F.sum("rc").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = ranged.join(before.select("r", "start"), "r").withColumn("upto", F.col("start") + F.sum("c").over(Window.partitionBy("r").orderBy("v")))
    n = counted.agg(F.sum("c")).first()[0] or 0
    return inside.agg(F.lit(n).cast("long").alias("n"), *[F.min(F.when(F.col("upto") > min(n - 1, int(n * p)), F.col("v"))).alias(name) for name, p in shares.items()])


SECTIONS = {
    "zero_hits": "hits = 0 AND path <> 'error' AND tool <> 'translate'",
    "fuzzy": "path = 'fuzzy' AND tool <> 'translate'",
    "bridges": "path LIKE 'glossary:%'",
    "ambiguous": "ambiguous = 1",
    "gaps": "tool = 'translate' AND found = 0",
}


def report(log: DataFrame, k: int = 10) -> DataFrame:
    """``section, term, n, last, path``: the k most frequent terms of each section of the report."""
    kinds = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in SECTIONS.items()]))
    rows = log.select(F.explode(kinds).alias("section"), F.lower("term").alias("term"), "asked_at", "path")
    grouped = rows.groupBy("section", "term").agg(F.count("*").alias("n"), F.max("asked_at").alias("last"), F.max("path").alias("path"))
    w = Window.partitionBy("section").orderBy(F.desc("n"), "term")
    return grouped.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
