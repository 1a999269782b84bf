"""Checks of builds against rules, staged translation, fields by map, titles and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_term
from .components import written

MAX_RULES = 1000


def build_findings(builds: DataFrame, rules: DataFrame) -> DataFrame:
    """``build_id, rule, verdict``: each value of a build (``build_id, field, value``) against the rules of its field (``rule, field, low, high``, at most MAX_RULES).

    "ok", "violation", or "not checkable" where the value is missing; a missing value is never a violation.
    """
    known = rules.limit(MAX_RULES + 1).collect()
    if len(known) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    each = F.array(*[F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["field"]).alias("field"), F.lit(float(r["low"])).alias("low"), F.lit(float(r["high"])).alias("high")) for r in known])
    asked = builds.select("build_id").distinct().select("build_id", F.inline(each))
    met = asked.join(builds.groupBy("build_id", "field").agg(F.max("value").alias("value")), ["build_id", "field"], "left")
    return met.select("build_id", "rule", F.when(F.col("value").isNull(), "not checkable").when(F.col("value").between(F.col("low"), F.col("high")), "ok").otherwise("violation").alias("verdict"))


def verdicts(findings: DataFrame) -> DataFrame:
    """``build_id, verdict, findings``: the gravest finding of a build: violation, not checkable, ok."""
    rank = F.when(F.col("verdict") == "violation", 2).when(F.col("verdict") == "not checkable", 1).otherwise(0)
    return findings.groupBy("build_id").agg(F.max(F.struct(rank, "verdict"))["verdict"].alias("verdict"), F.count("*").alias("findings"))


def translated(texts: DataFrame, glossary: DataFrame, cache: DataFrame) -> DataFrame:
    """``text, translation, stage`` of distinct texts: by exact glossary term, else from the cache, else left for a provider (stage "open", marked by a star).

    glossary: ``term, target``; cache: ``text, translation``. Each distinct text is looked up once.
    """
    asked = texts.select("text").where("text is not null").distinct().withColumn("key", norm_term(F.col("text")))
    terms = glossary.select(norm_term(F.col("term")).alias("key"), "target").groupBy("key").agg(F.min("target").alias("target"))
    kept = cache.groupBy("text").agg(F.min("translation").alias("cached"))
    met = asked.join(terms, "key", "left").join(kept, "text", "left")
    return met.select("text", F.coalesce("target", "cached", F.concat("text", F.lit("*"))).alias("translation"), F.when(F.col("target").isNotNull(), "glossary").when(F.col("cached").isNotNull(), "cache").otherwise("open").alias("stage"))


def mapped_fields(cells: DataFrame, field_map: DataFrame) -> DataFrame:
    """``doc_id, path, value``: cells (``doc_id, name, value``) by the map (``name, path``); cells without a path keep their name below "rest", so nothing is lost."""
    met = cells.join(field_map, "name", "left")
    return met.select("doc_id", F.coalesce("path", F.concat(F.lit("rest."), F.col("name"))).alias("path"), "value")


#: What a parenthesis at a title's end may repeat of language, edition or way of supply (fixed values).
ADDITIONS = ("deutsch", "englisch", "english", "de", "en", "d&d beyond", "dnd beyond", "ddb", "open5e", "druck", "pdf", "scan", "2014", "2024", "2014er regeln", "2024er regeln")


def work_title(c: Column) -> Column:
    """A title without parentheses at its end that hold known additions alone, with typographic apostrophes and single spaces; a title that is nothing else stays."""
    known = "(?:" + "|".join(ADDITIONS) + ")"
    brackets = rf"\(\s*{known}\s*(?:,\s*{known}\s*)*\)"
    title = F.trim(F.regexp_replace(F.replace(c, F.lit("'"), F.lit("’")), r"\s+", " "))
    # all of them at once; the first stays where nothing stands before it
    return F.regexp_replace(title, rf"(?i)^(.*?\S)(?:\s*{brackets})+$", "$1")


def category_of(breadcrumb: Column, words: dict[str, list[str]]) -> Column:
    """The first category one of whose words stands in a breadcrumb; null where none does."""
    out, low = F.when(F.lit(False), F.lit("")), F.lower(breadcrumb)
    for category, names in words.items():
        hit = F.lit(False)
        for n in names:
            hit = hit | F.contains(low, F.lit(n))
        out = out.when(hit, category)
    return out


def forced_pairs(groups: DataFrame, known: DataFrame) -> DataFrame:
    """``left, right`` that elimination forces: where all but one of a group's terms on either side are paired, the last two are.

    groups: ``group, side`` ("l" or "r"), ``term``; known: ``left, right``. Repeated until nothing new is found; of
    pairs forced on one term at once, those that contradict each other are left out.
    """
    found = known.select("left", "right").distinct()
    before = -1
    while True:  # each round but the last adds a pair
        left = groups.where("side = 'l'").join(found, F.col("term") == F.col("left"), "left_anti")
        right = groups.where("side = 'r'").join(found, F.col("term") == F.col("right"), "left_anti")
        last = lambda df, name: df.groupBy("group").agg(F.min("term").alias(name), F.max("term").alias("_most")).where(F.col(name) == F.col("_most")).drop("_most")
        forced = last(left, "left").join(last(right, "right"), "group").select("left", "right").distinct()
        once = forced.withColumn("a", F.count("*").over(Window.partitionBy("left"))).withColumn("b", F.count("*").over(Window.partitionBy("right"))).where("a = 1 and b = 1").select("left", "right")
        found = written(found.unionByName(once).distinct(), "forced")
        now = found.count()
        if now == before:
            return found
        before = now


def record_markdown(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``id, body``: a line "**label:** value" for every field that a record has, and its description below; nulls leave no line."""
    lines = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"**{label}:** "), F.col(c).cast("string"))) for c, label in fields.items()]
    return records.select("id", F.concat_ws("\n\n", F.concat_ws("\n", *lines), "description").alias("body"))


def display_names(entries: DataFrame, glossary: DataFrame) -> DataFrame:
    """``id, shown``: the translated name with the original in parentheses, a star where no row is official; the original alone where the term has several or no targets."""
    g = glossary.groupBy(norm_term(F.col("term")).alias("key")).agg(F.min("target").alias("target"), F.countDistinct("target").alias("n"), F.max("official").alias("official"))
    met = entries.select("id", "name", norm_term(F.col("name")).alias("key")).join(g.where("n = 1"), "key", "left")
    return met.select("id", F.when(F.col("target").isNull(), F.col("name")).otherwise(F.concat("target", F.when(F.col("official") == 1, "").otherwise("*"), F.lit(" ("), "name", F.lit(")"))).alias("shown"))


def curated_first(glossary: DataFrame, curated: DataFrame) -> DataFrame:
    """glossary with ``official`` 0 for rows whose term is curated (``term, target``) with another target."""
    c = curated.groupBy(norm_term(F.col("term")).alias("_key")).agg(F.collect_set("target").alias("_good"))
    met = glossary.withColumn("_key", norm_term(F.col("term"))).join(c, "_key", "left")
    return met.withColumn("official", F.when(F.col("_good").isNotNull() & ~F.array_contains("_good", F.col("target")), 0).otherwise(F.col("official"))).drop("_key", "_good")


def merged_details(items: DataFrame, details: DataFrame) -> DataFrame:
    """items (``category, name, id``) joined with the first detail (``category, name, place, body``) of the same category and name."""
    first = details.groupBy("category", "name").agg(F.min(F.struct("place", "body"))["body"].alias("detail"))
    return items.join(first, ["category", "name"], "left").select("id", "category", "name", "detail")


def chosen_candidates(asked: DataFrame, names: DataFrame) -> DataFrame:
    """``asked, how, id``: for each question its exact name, else the only name that begins with it, else nothing ("ambiguous" or "none").

    asked: ``asked``; names: ``id, name``. The least id stands for equal names. A question meets names through its first three letters.
    """
    q = asked.select("asked", norm_term(F.col("asked")).alias("key")).where("key <> ''").distinct().withColumn("p", F.substring("key", 1, 3))
    n = names.groupBy(norm_term(F.col("name")).alias("name")).agg(F.min("id").alias("id")).withColumn("p", F.substring("name", 1, 3))
    met = q.join(n, "p").where(F.expr("startswith(name, key)")).groupBy("asked").agg(F.min(F.when(F.col("name") == F.col("key"), F.col("id"))).alias("exact"), F.min("id").alias("only"), F.count("*").alias("n"))
    out = q.join(met, "asked", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "prefix").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return out.select("asked", how.alias("how"), F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("id"))


def level_pairs(left: DataFrame, right: DataFrame, known: DataFrame) -> DataFrame:
    """``group, level, left, right``: features (``group, level, name``) of levels with equal counts: known pairs (``left, right``) first, then the two that alone are left."""
    count = lambda df, c: df.groupBy("group", "level").agg(F.countDistinct("name").alias(c))
    even = count(left, "a").join(count(right, "b"), ["group", "level"]).where("a = b").select("group", "level")
    l = left.join(even, ["group", "level"]).select("group", "level", F.col("name").alias("left")).distinct()
    r = right.join(even, ["group", "level"]).select("group", "level", F.col("name").alias("right")).distinct()
    paired = l.join(known, "left").join(r, ["group", "level", "right"]).select("group", "level", "left", "right").distinct()
    alone = lambda df, c: df.join(paired, ["group", "level", c], "left_anti").groupBy("group", "level").agg(F.min(c).alias(c), F.count("*").alias("n")).where("n = 1").drop("n")
    return paired.unionByName(alone(l, "left").join(alone(r, "right"), ["group", "level"]).select("group", "level", "left", "right"))


#: Abilities by the names that users give them (fixed values).
ABILITY_NAMES = {
    "str": ("str", "strength", "sta", "stä", "stärke"), "dex": ("dex", "dexterity", "ges", "geschicklichkeit"), "con": ("con", "constitution", "kon", "konstitution"),
    "int": ("int", "intelligence", "intelligenz"), "wis": ("wis", "wisdom", "wei", "weisheit"), "cha": ("cha", "charisma"),
}


def ability_inputs(values: DataFrame) -> DataFrame:
    """``build_id, ability, value, problem``: inputs (``build_id, name, value`` as text) by ability: "unknown" names, values that are "no number" (whole ones alone are), and "twice" named abilities are problems; the others have none."""
    names = F.create_map(*[F.lit(x) for key, words in ABILITY_NAMES.items() for w in words for x in (w, key)])
    keyed = values.select("build_id", F.try_element_at(names, F.lower(F.trim("name"))).alias("ability"), "name", F.when(F.regexp_like(F.trim("value"), F.lit(r"^[+-]?[0-9]{1,9}$")), F.trim("value").cast("int")).alias("number"))
    n = F.count("*").over(Window.partitionBy("build_id", "ability"))
    problem = F.when(F.col("ability").isNull(), "unknown").when(n > 1, "twice").when(F.col("number").isNull(), "no number")
    return keyed.select("build_id", F.coalesce("ability", "name").alias("ability"), F.col("number").alias("value"), problem.alias("problem"))


def point_costs(text: Column) -> Column:
    """Map of score to cost from a text's Markdown table of two columns of whole numbers; empty without one."""
    rows = F.regexp_extract_all(text, F.lit(r"(?m)^\|\s*([0-9]{1,2}\s*\|\s*[0-9]{1,2})\s*\|\s*$"))
    pairs = F.transform(rows, lambda r: F.struct(F.trim(F.substring_index(r, "|", 1)).cast("int").alias("k"), F.trim(F.substring_index(r, "|", -1)).cast("int").alias("v")))
    kept = F.filter(pairs, lambda p, i: (i == 0) | ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(kept)


def costs_differ(rules_text: DataFrame, expected: dict[int, int]) -> DataFrame:
    """``id, evidence``: whether a rule's text (``id, body``) states exactly the expected point costs: "ok", "differs", or "none" where it holds no table."""
    wanted = F.create_map(*[F.lit(x) for pair in sorted(expected.items()) for x in pair])
    found = F.element_at(F.transform(F.array(point_costs(F.col("body"))), lambda m: F.when(F.size(m) == 0, "none").when((F.size(m) == len(expected)) & F.forall(F.map_entries(wanted), lambda e: F.coalesce(F.try_element_at(m, e["key"]) == e["value"], F.lit(False))), "ok").otherwise("differs")), 1)
    return rules_text.select("id", F.coalesce(found, F.lit("none")).alias("evidence"))


def rule_levels(rules: list[dict]) -> list[list[dict]]:
    """Rules in levels: each stands after all that its ``needs`` names. Unknown names, repeated names and cycles are errors."""
    by_name = {r["rule"]: r for r in rules}
    if len(by_name) < len(rules):
        raise ValueError("a rule is named twice")
    unknown = sorted({n for r in rules for n in r["needs"] or ()} - set(by_name))
    if unknown:
        raise ValueError(f"unknown rules are needed: {unknown[:5]}")
    levels, done = [], set()
    while len(done) < len(rules):
        now = [r for name, r in sorted(by_name.items()) if name not in done and set(r["needs"] or ()) <= done]
        if not now:
            raise ValueError(f"rules need each other: {sorted(set(by_name) - done)[:5]}")
        levels.append(now)
        done |= {r["rule"] for r in now}
    return levels


def ranked_findings(builds: DataFrame, rules: DataFrame) -> DataFrame:
    """``build_id, rule, verdict, value, cause``: values of builds (``build_id, field, value``) against rules that may need others.

    rules: ``rule, kind, fields`` (array), ``low, high, needs`` (array of rules), ``required``; at most MAX_RULES. Kinds:
    "range" (each of the fields' values lies within low and high), "sum" (their sum does), "count" (so many of them are
    given), "together" (all of them are given or none). ``value`` is what was compared: the least, the sum or the count.

    A rule whose needs aren't all "ok" is "not checkable", with the first such need as its cause; one that lacks a value
    is "missing" where it is required and else "not checkable", with the first missing field as its cause. Neither is ever
    a violation. A build is one row of at most as many values as the rules name; of repeated fields the greatest counts.
    Rules are evaluated in the order of their levels, folded in one pass over the builds. Builds without any of the fields
    are answered too; null ids are left out.
    """
    known = [r.asDict() for r in rules.limit(MAX_RULES + 1).collect()]
    if len(known) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    kinds = {r["kind"] for r in known} - {"range", "sum", "count", "together"}
    if kinds:
        raise ValueError(f"unknown kinds of rules: {sorted(kinds)}")
    levels = rule_levels(known)
    named = sorted({f for r in known for f in r["fields"]})
    at = {f: i for i, f in enumerate(named)}  # a field's place in a build's array of values
    place = F.create_map(*[x for f, i in at.items() for x in (F.lit(f), F.lit(i))])
    values = builds.where("build_id is not null").groupBy("build_id", "field").agg(F.max("value").cast("double").alias("value"))
    if named:
        values = values.withColumn("_at", F.try_element_at(place, F.col("field")))
    pairs = F.collect_list(F.when(F.col("_at").isNotNull() & F.col("value").isNotNull(), F.struct("_at", "value"))) if named else F.array().cast("array<struct<_at:int,value:double>>")
    out = values.groupBy("build_id").agg(pairs.alias("_p")).select("build_id", F.map_from_entries("_p").alias("_v"))
    out = out.select("build_id", F.transform(F.lit(list(range(len(named)))).cast("array<int>"), lambda i: F.try_element_at("_v", i)).alias("_v"))
    number = {r["rule"]: i for i, r in enumerate(r for level in levels for r in level)}
    checks = F.array(*[
        F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["kind"]).alias("kind"), F.lit(r["fields"]).cast("array<string>").alias("fields"), F.lit([at[f] for f in r["fields"]]).cast("array<int>").alias("at"), F.lit(r["low"]).cast("double").alias("low"), F.lit(r["high"]).cast("double").alias("high"),
                 F.lit(list(r["needs"] or ())).cast("array<string>").alias("needs"), F.lit([number[n] for n in r["needs"] or ()]).cast("array<int>").alias("before"), F.lit(bool(r["required"])).alias("required"))
        for level in levels for r in level
    ])
    out = out.withColumn("_read", F.transform(checks, lambda c: F.struct(c.alias("c"), F.transform(c["at"], lambda i: F.get("_v", i)).alias("v")))) if known else out.withColumn("_read", F.array())
    # in order of levels each rule finds its needs' verdicts among those before it
    none = F.array().cast("array<struct<rule:string,verdict:string,value:double,cause:string>>")
    done = F.aggregate("_read", none, lambda done, x: F.concat(done, F.array(_finding(x["c"], x["v"], F.filter(x["c"]["needs"], lambda n, i: F.get(done, F.get(x["c"]["before"], i))["verdict"] != "ok"))))) if known else none
    return out.select("build_id", F.inline(done))


def _finding(c: Column, v: Column, unmet: Column) -> Column:
    """One rule's finding from its row c, its fields' values v and its needs that aren't met."""
    given = F.filter(v, lambda y: y.isNotNull())
    total = F.aggregate(given, F.lit(0.0), lambda a, y: a + y)
    counted = F.size(given).cast("double")
    value = F.when(c["kind"] == "range", F.array_min(given)).when(c["kind"] == "sum", total).otherwise(counted)
    lacks = c["kind"].isin("range", "sum") & (F.size(given) < F.size(v))
    inside = F.when(c["kind"] == "together", (F.size(given) == 0) | (F.size(given) == F.size(v))).when(c["kind"] == "range", F.forall(given, lambda y: y.between(c["low"], c["high"]))).otherwise(value.between(c["low"], c["high"]))
    verdict = F.when(F.size(unmet) > 0, "not checkable").when(lacks, F.when(c["required"], "missing").otherwise("not checkable")).when(inside, "ok").otherwise("violation")
    absent = F.filter(c["fields"], lambda f, i: F.get(v, i).isNull())
    cause = F.when(F.size(unmet) > 0, F.get(unmet, 0)).when(lacks, F.get(absent, 0))
    return F.struct(c["rule"].alias("rule"), verdict.alias("verdict"), F.when((F.size(unmet) == 0) & ~lacks, value).alias("value"), cause.alias("cause"))


def overall_verdicts(findings: DataFrame) -> DataFrame:
    """``build_id, verdict, violations, missing, open``: "violations", else "incomplete" where a required value is missing, else "none found" where something couldn't be checked, else "legal as far as checkable"."""
    n = lambda v, name: F.count_if(F.col("verdict") == v).alias(name)
    counts = findings.groupBy("build_id").agg(n("violation", "violations"), n("missing", "missing"), n("not checkable", "open"))
    return counts.select("build_id", F.when(F.col("violations") > 0, "violations").when(F.col("missing") > 0, "incomplete").when(F.col("open") > 0, "none found").otherwise("legal as far as checkable").alias("verdict"), "violations", "missing", "open")
