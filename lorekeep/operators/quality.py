"""Data quality: measures against a committed baseline, checks in one pass, manifest hashes, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def against_baseline(measured: DataFrame, baseline: DataFrame, present: DataFrame) -> DataFrame:
    """``metric, source_key, expected, found, verdict``: more defects than the baseline are an error, fewer a hint; sources that aren't present are skipped."""
    both = baseline.join(measured, ["metric", "source_key"], "full").join(present, "source_key", "left_semi")
    found, expected = F.coalesce("found", F.lit(0)), F.coalesce("expected", F.lit(0))
    judged = both.select("metric", "source_key", expected.alias("expected"), found.alias("found"))
    return judged.withColumn("verdict", F.when(F.col("found") > F.col("expected"), "error").when(F.col("found") < F.col("expected"), "hint")).where("verdict is not null")


def full_check(entries: DataFrame) -> DataFrame:
    """One row of counts over all entries, in one pass."""
    body = F.trim("body")
    return entries.agg(
        F.count("*").alias("n"), F.count_if(F.col("name").isNull() | (F.trim("name") == "")).alias("unnamed"), F.count_if(F.col("body").isNull() | (body == "")).alias("empty"),
        F.count_if(F.length(body).between(1, 40)).alias("short"), F.count_if(F.col("body").like("%<br%") | F.col("body").like("%&nbsp;%")).alias("residue"), F.countDistinct("source_key").alias("sources"),
    )


def manifest(entries: DataFrame, part_rows: int = 4096) -> DataFrame:
    """``part, n, digest``: SHA-256 of each range of ids over its rows' fields in id order. Ranges are of fixed width, so a task never holds more than one."""
    row = F.concat_ws("\x1f", F.col("id").cast("string"), "source_key", "edition", F.sha2("body", 256))
    parts = entries.withColumn("part", F.floor(F.col("id") / part_rows)).groupBy("part").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", row.alias("r")))), lambda x: x["r"]), "").alias("all"))
    return parts.select("part", "n", F.sha2("all", 256).alias("digest"))


def term_conflicts(glossary: DataFrame, homonyms: DataFrame | None = None) -> DataFrame:
    """``term, targets, editions, kind``: terms with several targets; "homonym" where the term is a verified one (``term``), "edition" where each edition has one target, else "real"."""
    per_edition = glossary.groupBy(F.lower("term").alias("term"), "edition").agg(F.countDistinct("target").alias("n"))
    worst = per_edition.groupBy("term").agg(F.max("n").alias("worst"), F.count("*").alias("editions"))
    targets = glossary.groupBy(F.lower("term").alias("term")).agg(F.countDistinct("target").alias("targets")).where("targets > 1")
    met = targets.join(worst, "term")
    verified = F.lit(False)
    if homonyms is not None:
        met = met.join(homonyms.select(F.lower("term").alias("term"), F.lit(True).alias("_h")).distinct(), "term", "left")
        verified = F.coalesce("_h", F.lit(False))
    return met.select("term", "targets", "editions", F.when(verified, "homonym").when(F.col("worst") == 1, "edition").otherwise("real").alias("kind"))


def counts_by(entries: DataFrame) -> DataFrame:
    """``source_key, edition, category, n``: entries by source, by edition and by category, one grouping each, in one pass."""
    sets = [[F.col("source_key")], [F.col("edition")], [F.col("category")]]
    return entries.groupingSets(sets, "source_key", "edition", "category").agg(F.count("*").alias("n"))


def newest(rows: DataFrame, by: list[str], order: list, keep: int) -> DataFrame:
    """The keep first rows of each group in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


SECTION_NAMES = ("Merkmale", "Traits", "Aktionen", "Actions", "Bonusaktionen", "Bonus Actions", "Reaktionen", "Reactions", "Legendäre Aktionen", "Legendary Actions")  # fixed values


def empty_sections(entries: DataFrame, names: tuple[str, ...] = SECTION_NAMES) -> DataFrame:
    """``source_key, section, n``: sections of the given names in entries (``source_key, body``) that have a heading and nothing below it."""
    parts = entries.select("source_key", F.explode(F.split("body", r"(?m)^#{3,6}")).alias("part"))
    named = parts.select("source_key", F.trim(F.substring_index("part", "\n", 1)).alias("section"), F.trim(F.regexp_replace("part", r"^[^\n]*\n?", ""), F.lit(" \t\r\n")).alias("rest"))
    return named.where(F.col("section").isin(*names) & (F.col("rest") == "")).groupBy("source_key", "section").agg(F.count("*").alias("n"))


def measured(found: DataFrame, known: DataFrame) -> DataFrame:
    """``metric, source_key, n``: findings (``metric, source_key, id``) by kind and source, without those that are known errors of the source (``metric, id``)."""
    return found.join(known.select("metric", "id").distinct(), ["metric", "id"], "left_anti").groupBy("metric", "source_key").agg(F.count("*").alias("n"))


def rebased(baseline: DataFrame, now: DataFrame, present: DataFrame) -> DataFrame:
    """``metric, source_key, expected``: a new baseline: what is measured now; of sources that aren't present (``source_key``) the old lines stay."""
    away = baseline.select("metric", "source_key", "expected").join(present.select("source_key").distinct(), "source_key", "left_anti").select("metric", "source_key", "expected")
    return now.select("metric", "source_key", F.col("n").alias("expected")).unionByName(away)


def suspects(sources: DataFrame, entries: DataFrame, words: tuple[str, ...], cleared: DataFrame) -> DataFrame:
    """``source_key``: sources (``source_key, title, kind``) without a kind whose key or title holds one of the words.

    A source that was cleared (``source_key, category``: the categories that its evidence covers) is left out as long as
    it has entries, and none of another category.
    """
    text = F.lower(F.concat_ws(" ", "source_key", "title"))
    named = sources.where(F.col("kind").isNull() & F.greatest(*[F.contains(text, F.lit(w)) for w in (*words, words[0])])).select("source_key")
    held = entries.select("source_key", "category").distinct()
    beyond = held.join(cleared.select("source_key").distinct(), "source_key").join(cleared, ["source_key", "category"], "left_anti").select("source_key").distinct()
    covered = cleared.select("source_key").distinct().join(held.select("source_key").distinct(), "source_key", "left_semi").join(beyond, "source_key", "left_anti")
    return named.join(covered, "source_key", "left_anti")


def outside(rows: DataFrame, column: str, allowed: list) -> DataFrame:
    """rows whose column holds a value that isn't allowed; null isn't either."""
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def orphans(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """``problem, n``: entries of sources that don't exist, and entries whose edition isn't that of their source (sources: ``source_key, edition``)."""
    met = entries.select("source_key", "edition").join(sources.select("source_key", F.col("edition").alias("_e"), F.lit(True).alias("_s")), "source_key", "left")
    counted = met.agg(F.count_if(F.col("_s").isNull()).alias("no source"), F.count_if(F.col("_s") & F.col("_e").isNotNull() & (F.col("edition") != F.col("_e"))).alias("other edition"))
    return counted.unpivot([], ["no source", "other edition"], "problem", "n")


def audited(entries: DataFrame, glossary: DataFrame) -> DataFrame:
    """``category, entries, names, translated, official, gaps``: per category, how many entries and distinct names there are, and of the names how many have a glossary row, an official one, or none."""
    g = glossary.groupBy(F.lower("term").alias("_key")).agg(F.max("official").alias("_official"))
    named = entries.where("name is not null and name <> ''").select("category", F.lower("name").alias("_key")).groupBy("category", "_key").agg(F.count("*").alias("n"))
    return named.join(g, "_key", "left").groupBy("category").agg(
        F.sum("n").alias("entries"), F.count("*").alias("names"), F.count("_official").alias("translated"), F.count_if(F.col("_official") == 1).alias("official"), F.count_if(F.col("_official").isNull()).alias("gaps"),
    )


def without_source(entries: DataFrame, sources: DataFrame, source_key: str) -> tuple[DataFrame, DataFrame]:
    """entries and sources without those of one source."""
    stays = ~F.col("source_key").eqNullSafe(F.lit(source_key))
    return entries.where(stays), sources.where(stays)


def sampled(rows: DataFrame, n: int = 3, seed: int = 0) -> DataFrame:
    """n rows (``id``) drawn by a hash of their id, the same for the same seed."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)
