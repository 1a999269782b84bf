"""Entity resolution: groups of hits by shared names, canonical members, rank, revisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import ratio
from ..functions.text import core_name, norm_term
from .components import _checkpointed, connected_components


def name_keys(entries: DataFrame, bridges: DataFrame | None = None) -> DataFrame:
    """``id, key``: each entry's normalised names, without parentheses and by exact bridges (``a, b``) too."""
    own = entries.select("id", F.explode(F.array_distinct(F.array(norm_term(F.col("name")), norm_term(core_name(F.col("name")))))).alias("key")).where("key <> ''")
    if bridges is None:
        return own
    both = bridges.select("a", "b").unionByName(bridges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return own.unionByName(own.join(both, F.col("key") == F.col("a")).select("id", F.col("b").alias("key"))).distinct()


def entity_groups(entries: DataFrame, revisions: DataFrame, bridges: DataFrame | None = None, keep: Callable = _checkpointed) -> DataFrame:
    """``id, group_id``: entries of one edition and category that share a name, transitively; revisions stay alone.

    entries: ``id, name, edition, category, source_key``; revisions: ``source_key``. Members of a name are linked to its
    least id, a link each, never to one another.
    """
    plain = entries.join(revisions.select("source_key").distinct(), "source_key", "left_anti")
    keyed = plain.select("id", "edition", "category").join(name_keys(plain, bridges), "id")
    least = keyed.groupBy("edition", "category", "key").agg(F.min("id").alias("first"))
    links = keyed.join(least, ["edition", "category", "key"]).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    found = connected_components(links, keep=keep)
    return entries.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("group_id"))


def canonical_members(entries: DataFrame, groups: DataFrame, sources: DataFrame) -> DataFrame:
    """``group_id, id, name, members, other_sources``: the member of the best source priority, then run (if entries have one), then name, then id."""
    rows = entries.join(groups, "id").join(sources, "source_key").withColumn("priority", F.coalesce("priority", F.lit(100)))
    rows = rows if "run" in rows.columns else rows.withColumn("run", F.lit(0))
    best = rows.groupBy("group_id").agg(F.min(F.struct("priority", "run", "name", "id", "source_key")).alias("m"), F.count("*").alias("members"), F.array_sort(F.collect_set("source_key")).alias("s"))
    return best.select("group_id", F.col("m.id").alias("id"), F.col("m.name").alias("name"), "members", F.array_join(F.array_remove("s", F.col("m.source_key")), ",").alias("other_sources"))


def shown_members(entries: DataFrame, groups: DataFrame, sources: DataFrame) -> DataFrame:
    """``group_id, id, name, other_places``: what a result shows of each group of entries (``id, source_key, name, excerpt, page``).

    A group in which no source stands twice shows its canonical member, with the places of the other sources. Where one
    does, all members are shown but those of one source, folded name and excerpt, of which the first (least id) stays
    with the other pages; a source's sections of one name are different texts.
    """
    rows = entries.join(groups, "id").join(sources.select("source_key", F.coalesce("priority", F.lit(100)).alias("priority")), "source_key")
    rows = rows if "run" in rows.columns else rows.withColumn("run", F.lit(0))
    place = F.concat_ws(" p. ", "source_key", "page")
    twice = rows.groupBy("group_id", "source_key").agg(F.count("*").alias("n")).groupBy("group_id").agg(F.max("n").alias("most"))
    judged = rows.join(twice, "group_id").withColumn("place", place)
    best = Window.partitionBy("group_id").orderBy("priority", "run", "name", "id")
    lone = judged.where("most = 1").withColumns({"_n": F.row_number().over(best), "_lead": F.first("source_key").over(best)})
    others = F.array_sort(F.collect_set(F.when((F.col("_n") > 1) & (F.col("source_key") != F.col("_lead")), F.col("place"))))
    canonical = lone.groupBy("group_id").agg(F.min(F.when(F.col("_n") == 1, F.struct("id", "name"))).alias("m"), others.alias("o"))
    same = judged.where("most > 1").groupBy("group_id", "source_key", norm_term(F.col("name")).alias("_k"), "excerpt").agg(F.min(F.struct("id", "name", "page")).alias("m"), F.collect_set(F.struct("page", "place")).alias("p"))
    pages = F.array_sort(F.transform(F.filter("p", lambda x: x["page"].isNotNull() & ~x["page"].eqNullSafe(F.col("m.page"))), lambda x: x["place"]))
    shown = canonical.select("group_id", "m.id", "m.name", F.array_join("o", ", ").alias("other_places"))
    return shown.unionByName(same.select("group_id", "m.id", "m.name", F.array_join(pages, ", ").alias("other_places")))


def divergent(entries: DataFrame, groups: DataFrame, least: float = 90.0, cap: int = 3) -> DataFrame:
    """``id, other_id, score``: of each group, up to cap members of the lead's language (entries ``id, lang, body``; the lead has the least id) whose body differs from it: similarity below least.

    Bodies are compared without their breadcrumb line, in lower case and with single spaces; empty ones aren't compared.
    Members that differ from the lead in language are other versions, not conflicts.
    """
    text = F.trim(F.regexp_replace(F.lower(F.regexp_replace("body", r"^\*Context:[^\n]*?\*", "")), r"\s+", " "))
    rows = entries.join(groups, "id").select("group_id", "id", "lang", text.alias("t"))
    w = Window.partitionBy("group_id").orderBy("id")
    lead = rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("group_id", F.col("id").alias("lead"), F.col("lang").alias("l"), F.col("t").alias("lt"))
    met = rows.join(lead, "group_id").where("id <> lead and lang <=> l and t <> '' and lt <> ''")
    few = met.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
    return few.withColumn("score", ratio(F.col("lt"), F.col("t"))).where(F.col("score") < least).select(F.col("lead").alias("id"), F.col("id").alias("other_id"), F.round("score", 4).alias("score"))


def other_versions(entries: DataFrame, groups: DataFrame, sources: DataFrame, least: float = 90.0, cap: int = 3) -> DataFrame:
    """``id, other_id, kind, score``: what a group's lead is held against: "conflict" for a text of its language that differs (similarity ``score`` below least), "foreign" for a version in another language (no score: a translation may differ without proof of a conflict).

    entries: ``id, source_key, edition, lang, body``; groups: ``group_id, id``; sources: ``source_key, kind``. The lead is the
    group's least id that is no revision. Compared are the next cap members by id that are neither revisions (to differ is
    their purpose), nor of the lead's source (those are further sections), nor of another edition; like texts among them
    use up a comparison. Blank texts are never in conflict; a null language is one of its own. A member named twice
    counts once.

    No more than the lead and cap members of a group are carried on, whatever its size; only their bodies are read.
    """
    plain = sources.where("kind is null").select("source_key").distinct()
    members = groups.where("group_id is not null").select("group_id", "id").distinct()
    rows = members.join(entries.select("id", "source_key", "edition", "lang"), "id").join(plain, "source_key", "left_semi")
    lead = rows.groupBy("group_id").agg(F.min(F.struct("id", "source_key", "edition", "lang")).alias("l"))
    met = rows.join(lead, "group_id").where("id <> l.id and source_key <> l.source_key and edition <=> l.edition")
    few = met.withColumn("_n", F.row_number().over(Window.partitionBy("group_id").orderBy("id"))).where(F.col("_n") <= cap)
    few = few.select(F.col("l.id").alias("lead"), F.col("id").alias("other_id"), F.expr("lang <=> l.lang").alias("same"))
    text = F.trim(F.regexp_replace(F.lower(F.regexp_replace("body", r"^\*Context:[^\n]*?\*", "")), r"\s+", " "))
    body = lambda id_col, name: entries.select(F.col("id").alias(id_col), text.alias(name))
    held = few.where("same").join(body("lead", "a"), "lead").join(body("other_id", "b"), "other_id").where("a <> '' and b <> '' and a <> b")
    conflicts = held.withColumn("score", ratio(F.col("a"), F.col("b"))).where(F.col("score") < least).select(F.col("lead").alias("id"), "other_id", F.lit("conflict").alias("kind"), F.round("score", 4).alias("score"))
    foreign = few.where("not same").select(F.col("lead").alias("id"), "other_id", F.lit("foreign").alias("kind"), F.lit(None).cast("double").alias("score"))
    return conflicts.unionByName(foreign)


def ranked(hits: DataFrame) -> DataFrame:
    """hits (``query_id, query, id, name, priority, run``) with ``class`` and ``rank`` in their query: 0 exact, 1 prefix of the question, 2 prefix of one of its ``variants`` (if there), 3 other; then source or run, then name.

    A query's hits are as many as the search's limit lets through.
    """
    key = norm_term(F.col("query"))
    name = norm_term(F.col("name"))
    variants = F.coalesce("variants", F.array().cast("array<string>")) if "variants" in hits.columns else F.array().cast("array<string>")
    exact = (name == key) | F.array_contains(variants, name)
    classed = hits.withColumn("class", F.when(exact, 0).when(F.startswith(name, key), 1).when(F.exists(variants, lambda v: F.startswith(name, v)), 2).otherwise(3))
    first, second = F.when(F.col("class") == 0, F.col("priority")).otherwise(F.col("run")), F.when(F.col("class") == 0, F.col("run")).otherwise(F.col("priority"))
    return classed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("class", first, second, "name", "id")))


def attach_revisions(entries: DataFrame, revisions: DataFrame, cap: int = 3) -> DataFrame:
    """``id, revision_id, place``: revision entries of the same edition that share a normalised name, whatever the category."""
    base = entries.join(revisions.select("source_key").distinct(), "source_key", "left_anti").select("id", "edition", norm_term(F.col("name")).alias("key"))
    rev = entries.join(revisions.select("source_key").distinct(), "source_key", "left_semi").select(F.col("id").alias("revision_id"), "edition", norm_term(F.col("name")).alias("key"))
    met = base.join(rev, ["edition", "key"]).where("key <> ''")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("revision_id"))).where(F.col("place") <= cap).select("id", "revision_id", "place")


def ambiguous_names(entries: DataFrame) -> DataFrame:
    """``key, categories``: normalised names that stand in several categories."""
    return entries.select(norm_term(F.col("name")).alias("key"), "category").where("key <> ''").groupBy("key").agg(F.countDistinct("category").alias("categories")).where("categories > 1")


def longest_sections(entries: DataFrame) -> DataFrame:
    """``source_key, key, id``: of the same-named sections of a source, the one with the longest body, least id first."""
    rows = entries.select("source_key", norm_term(F.col("name")).alias("key"), "id", F.length("body").alias("n"))
    return rows.groupBy("source_key", "key").agg(F.min(F.struct((-F.col("n")).alias("n"), "id")).alias("m")).select("source_key", "key", F.col("m.id").alias("id"))
