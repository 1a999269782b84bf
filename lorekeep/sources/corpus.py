"""Corpus tables over the driver's Parquet tables: entries, sources, glossary, query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks for each core that rows are dealt to.
TASKS = 4


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of narrow rows that much work is done on: dealt to all cores, as a small file is read by few tasks."""
    return table(spark, sf_dir, name).repartition(TASKS * spark.sparkContext.defaultParallelism, key)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, source_key, lang, edition, category, name, body``; the name is the text's first three words."""
    d = table(spark, sf_dir, "documents")
    gap = r"[^\p{L}\p{N}]"
    first = rf"^{gap}*({TOKEN})(?:{gap}+({TOKEN}))?(?:{gap}+({TOKEN}))?"  # at the beginning alone: the rest isn't read
    name = F.when(F.col("text").isNotNull(), F.array_join(F.filter(F.array(*[F.regexp_extract("text", first, i) for i in (1, 2, 3)]), lambda w: w != ""), " "))
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_key"), "lang", F.when(F.col("doc_id") % 4 == 0, "2014").otherwise("2024").alias("edition"),
        (F.col("doc_id") % 8).alias("category"), name.alias("name"), F.col("text").alias("body"),
    )


ENTRIES_SQL = r"""entries AS (SELECT doc_id AS id, source AS source_key, lang, CASE WHEN doc_id % 4 = 0 THEN '2014' ELSE '2024' END AS edition,
  doc_id % 8 AS category, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}]+')[1:3], ' ') AS name, text AS body FROM documents)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_key, priority, kind``: one row per source; the lower priority wins; src7 holds revisions."""
    keys = table(spark, sf_dir, "documents").select(F.col("source").alias("source_key")).distinct()
    number = F.regexp_extract("source_key", r"(\d+)", 1)
    return keys.select("source_key", F.when(number == "", None).otherwise(number).cast("int").alias("priority"), F.when(F.col("source_key") == "src7", "errata").alias("kind"))


SOURCES_SQL = r"""sources AS (SELECT DISTINCT source AS source_key, TRY_CAST(regexp_extract(source, '(\d+)', 1) AS INTEGER) AS priority,
  CASE WHEN source = 'src7' THEN 'errata' END AS kind FROM documents)"""


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``term, target, official, origin, edition, weight`` from parts: names to types, with evidence for the choice."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_name").alias("term"), F.lower("p_type").alias("target"), (F.col("p_size") % 2).alias("official"), F.col("p_brand").alias("origin"), F.when(F.col("p_size") % 3 == 0, "2014").when(F.col("p_size") % 3 == 1, "2024").alias("edition"), F.col("p_partkey").alias("row_id"))


GLOSSARY_SQL = """glossary AS (SELECT p_name AS term, lower(p_type) AS target, p_size % 2 AS official, p_brand AS origin,
  CASE p_size % 3 WHEN 0 THEN '2014' WHEN 1 THEN '2024' END AS edition, p_partkey AS row_id FROM part)"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, asked_at, tool, term, path, hits, ambiguous, found, duration_ms`` from events."""
    e = table(spark, sf_dir, "events")
    return log_rows(e)


def log_rows(events: DataFrame) -> DataFrame:
    """The query log of an events table, batch or stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("asked_at"), F.when(F.col("event_type") == "signup", "translate").otherwise("search").alias("tool"), F.concat(F.lit("term"), F.col("user_id") % 40).alias("term"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "fuzzy").when(F.col("event_type") == "purchase", F.concat(F.lit("glossary:"), k % 10)).otherwise("direct").alias("path"),
        (k % 5).alias("hits"), (k % 7 == 0).cast("int").alias("ambiguous"), (k % 2).alias("found"), F.col("value").alias("duration_ms"), "user_id",
    )


LOG_SQL = """log AS (SELECT event_id AS id, ts AS asked_at, CASE WHEN event_type = 'signup' THEN 'translate' ELSE 'search' END AS tool, 'term' || (user_id % 40) AS term,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'fuzzy' WHEN 'purchase' THEN 'glossary:' || (CAST(json_extract(props, '$.k') AS INTEGER) % 10) ELSE 'direct' END AS path,
  CAST(json_extract(props, '$.k') AS INTEGER) % 5 AS hits, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 7 = 0 THEN 1 ELSE 0 END AS ambiguous,
  CAST(json_extract(props, '$.k') AS INTEGER) % 2 AS found, value AS duration_ms, user_id FROM events)"""
