"""Glossary resolution: exact relations, canonical choice, bounded hops, suggestions, and terms in text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import core_name, may_reach, norm_term, similarity, tokens

SUGGEST_FROM, SUGGESTIONS, MAX_ALTERNATIVES = 88.0, 5, 8


def canonical(glossary: DataFrame, fold: Callable[[Column], Column] = norm_term) -> DataFrame:
    """The preferred row of each normalised term: official, with known edition, newer, with evidenced origin, then by name. fold: what makes terms one."""
    order = [F.desc("official"), F.col("edition").isNull(), F.desc_nulls_last("edition"), F.col("origin").isNull(), "target", "row_id"]
    keyed = glossary.withColumn("key", fold(F.col("term")))
    return keyed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("n = 1").drop("n")


def alternatives(glossary: DataFrame, terms: DataFrame, cap: int = MAX_ALTERNATIVES) -> DataFrame:
    """``term, alternative, hop``: what up to two exact hops in either direction reach from each term, nearest first, at most cap.

    Of each name's neighbours the first 2 * cap are enough: a term with cap of its own needs no second hop, and one with
    fewer leaves out no more than these and itself. So a name with however many neighbours gives a bounded number of
    rows, and its others are dropped before they are shuffled.
    """
    there = glossary.select(norm_term(F.col("term")).alias("a"), norm_term(F.col("target")).alias("b")).where("a <> b").distinct()
    edges = there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    near = edges.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(F.col("_n") <= 2 * cap)
    start = terms.select("term", norm_term(F.col("term")).alias("a")).distinct()
    first = start.join(near.where(F.col("_n") <= cap), "a").select("term", F.col("a").alias("start"), F.col("b").alias("alternative"), F.lit(1).alias("hop"))
    few = first.groupBy("term", "start").agg(F.collect_list("alternative").alias("_own")).where(F.size("_own") < cap)
    two = few.select("term", "start", "_own", F.explode("_own").alias("a")).join(near, "a").where((F.col("b") != F.col("start")) & ~F.array_contains("_own", F.col("b")))
    both = first.select("term", "alternative", "hop").unionByName(two.select("term", F.col("b").alias("alternative"), F.lit(2).alias("hop")).distinct())
    ranked = both.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("hop", "alternative")))
    return ranked.where(F.col("n") <= cap).select("term", "alternative", "hop")


def _rare_pairs(strings: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """strings (``key``) with ``pair``: of its distinct pairs of letters so many of the rarest that one of them is kept by every string as similar as least.

    A string of n letters and one of similarity s lose at most n (2 - 1.5 s - (1.5 s - 1) s / (2 - s)) of its pairs: a
    letter dropped costs two, one put in between costs one, and the other string has n s / (2 - s) letters at least.
    """
    s = least / 100
    share = 2 - 1.5 * s - (1.5 * s - 1) * s / (2 - s)
    each = strings.select("key", F.explode(_pairs(F.col("key"))).alias("pair")).join(frequency, "pair", "left")
    rarest = F.row_number().over(Window.partitionBy("key").orderBy(F.coalesce("_seen", F.lit(0)), "pair"))
    return each.withColumn("_n", rarest).where(F.col("_n") <= F.floor(F.length("key") * share + 1e-9) + 1).select("key", "pair")


def _pairs(c):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: c.substr(i, F.lit(2))))


def suggest(names: DataFrame, asked: DataFrame, least: float = SUGGEST_FROM, k: int = SUGGESTIONS) -> DataFrame:
    """``asked, name, score``: the k most similar names of at least that similarity, never an identity.

    Names and questions meet by their rarest pairs of letters, as many as the similarity requires, so frequent pairs
    bring nothing together that has a rarer one. Lengths and the edit distance rule out most of the rest before the
    subsequence is computed. Names and questions are taken once each, however often they stand.
    """
    n = names.select(norm_term(F.col("name")).alias("key")).where("key <> ''").distinct()
    q = asked.select("asked", norm_term(F.col("asked")).alias("key")).where("key <> ''").distinct()
    seen = n.select(F.explode(_pairs(F.col("key"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("_seen"))
    there = _rare_pairs(n, seen, least).withColumnRenamed("key", "name")
    met = there.join(_rare_pairs(q.select("key").distinct(), seen, least), "pair").where(may_reach(F.col("name"), F.col("key"), least)).select("key", "name").distinct()
    scored = met.withColumn("score", F.round(similarity(F.col("key"), F.col("name")), 4)).where(F.col("score") >= least)
    best = Window.partitionBy("key").orderBy(F.desc("score"), "name")
    first = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    return first.join(q, "key").select("asked", "name", "score")


def _grams(n: int, starts):
    """Runs of n words of the column w that begin at one of the places (from 1)."""
    return F.transform(F.filter(starts, lambda i: i <= F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))


#: Distinct terms that may be broadcast, and first words of terms that are looked for before any run is built; with more, runs begin at every word.
BROADCAST_TERMS, FIRST_WORDS = 200_000, 10_000


def spot(texts: DataFrame, terms: DataFrame, min_length: int = 4, id_col: str = "id", text_col: str = "body", stop: tuple[str, ...] = (), abbreviations: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """``id, term``: terms (``term``) that stand in a text as whole words, folded.

    Word sequences of the terms' lengths are looked up by equality, so no text is held against every term; a sequence
    is only built where its first word begins a term, as long as those are few. Terms shorter than min_length and stop
    words are left out. abbreviations (``term``) are found as they are written, case and all, whatever their length.
    cap: of a text's terms only so many, the longest first; abbreviations don't count. The number of words of a term is
    small and is read from the table of terms.
    """
    known = terms.select(F.array_join(tokens(F.col("term")), " ").alias("term"), F.size(tokens(F.col("term"))).alias("words")).where(F.length("term") >= min_length)
    known = (known.where(~F.col("term").isin(*stop)) if stop else known).distinct()
    lengths = sorted(r["words"] for r in known.select("words").distinct().collect())
    small = known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    words = texts.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    if lengths:
        first = known.select(F.substring_index("term", " ", 1).alias("w")).distinct().limit(FIRST_WORDS + 1).collect()
        places = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.size("w"))).otherwise(F.array().cast("array<int>"))
        if len(first) <= FIRST_WORDS:
            places = F.filter(places, lambda i: F.element_at("w", i).isin(*[r["w"] for r in first]))
        begun = words.withColumn("_at", places)
        found = begun.select("id", F.explode(F.array_distinct(F.concat(*[_grams(n, F.col("_at")) for n in lengths]))).alias("term"))
        out = found.join(F.broadcast(known.select("term")) if small else known.select("term"), "term").select("id", "term")
    else:
        out = words.select("id", F.lit("").alias("term")).where("false")
    if cap is not None:
        best = Window.partitionBy("id").orderBy(F.desc(F.length("term")), "term")
        out = out.withColumn("n", F.row_number().over(best)).where(F.col("n") <= cap).drop("n")
    if abbreviations is not None:
        short = abbreviations.select("term").distinct()
        written = texts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(r"([\p{L}\p{N}]+)")))).alias("term"))
        out = out.unionByName(written.join(short, "term").select("id", "term")).distinct()
    return out


def looked_up(glossary: DataFrame, asked: DataFrame, reverse: bool = False, least: float = SUGGEST_FROM, k: int = SUGGESTIONS) -> DataFrame:
    """``asked, place, term, target, official, match, score``: glossary rows for each question: exact ones in canonical order, then those of similar terms, which are suggestions and never identities.

    reverse: questions are in the targets' language. score is that of the similar term, null for exact rows.
    """
    g = glossary.select(*[F.col({"term": "target", "target": "term"}.get(c, c)).alias(c) for c in glossary.columns]) if reverse else glossary
    keyed = g.withColumn("_key", norm_term(F.col("term")))
    q = asked.select("asked", norm_term(F.col("asked")).alias("_key")).where("_key <> ''").distinct()
    exact = q.join(keyed, "_key").withColumns({"match": F.lit("exact"), "score": F.lit(None).cast("double")})
    near = suggest(g.select(F.col("term").alias("name")), asked, least, k).where(F.col("name") != norm_term(F.col("asked")))
    similar = near.join(keyed, F.col("name") == F.col("_key")).withColumn("match", F.lit("similar")).drop("name")
    both = exact.drop("_key").unionByName(similar.drop("_key"))
    order = [F.col("match"), F.desc("official"), F.col("edition").isNull(), F.desc_nulls_last("edition"), F.col("origin").isNull(), "target", "row_id"]
    return both.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(*order))).select("asked", "place", "term", "target", "official", "match", "score")


def translated_terms(glossary: DataFrame, asked: DataFrame, exact_cap: int = 10, similar_cap: int = 5) -> DataFrame:
    """``asked, place, target, official, match``: exact translations, at most exact_cap; where there are none, similar terms' ones, at most similar_cap, all unconfirmed."""
    rows = looked_up(glossary, asked)
    sure = rows.where("match = 'exact'").select("asked").distinct()
    exact = rows.where((F.col("match") == "exact") & (F.col("place") <= exact_cap))
    similar = rows.where("match = 'similar'").join(sure, "asked", "left_anti").where(F.col("place") <= similar_cap)
    return exact.unionByName(similar).select("asked", "place", "target", F.when(F.col("match") == "exact", F.col("official")).otherwise(0).alias("official"), "match")


def best_target(glossary: DataFrame, asked: DataFrame, fold: Callable[[Column], Column] = norm_term) -> DataFrame:
    """``asked, target, official``: the canonical exact translation of each question, of its name without a parenthesis where it has none itself; null where neither has one. fold: what makes questions and terms one."""
    c = canonical(glossary, fold).select("key", "target", "official")
    q = asked.select("asked", fold(F.col("asked")).alias("_own"), fold(core_name(F.col("asked"))).alias("_core")).distinct()
    own, core = c.select(F.col("key").alias("_own"), F.struct("target", "official").alias("_a")), c.select(F.col("key").alias("_core"), F.struct("target", "official").alias("_b"))
    met = q.join(own, "_own", "left").join(core, "_core", "left").withColumn("_m", F.coalesce("_a", "_b"))
    return met.select("asked", "_m.target", "_m.official")


def response_rows(answers: DataFrame, core: bool = True) -> DataFrame:
    """``term, target, official, edition, origin``: rows of an API's answers (``term, target, book, official``): official where the answer says so; the edition by the book's year.

    core: a term in front of a parenthesis ("Hide (Action)") gives a row of its own without it, as long as it is the
    only one with that core and no answer has the core as its term.
    """
    edition = F.when(F.contains("book", F.lit("2024")), "2024").when(F.contains("book", F.lit("2014")), "2014")
    rows = answers.where("term is not null and target is not null").select("term", "target", F.coalesce(F.col("official").cast("int"), F.lit(0)).alias("official"), edition.alias("edition"), F.col("book").alias("origin"))
    if not core:
        return rows
    cut = rows.withColumn("_core", core_name(F.col("term"))).where(F.col("_core") != F.col("term"))
    only = cut.groupBy(norm_term(F.col("_core")).alias("_key")).agg(F.countDistinct("term").alias("n")).where("n = 1").drop("n")
    free = only.join(rows.select(norm_term(F.col("term")).alias("_key")), "_key", "left_anti")
    cores = cut.withColumn("_key", norm_term(F.col("_core"))).join(free, "_key")
    return rows.unionByName(cores.select(F.col("_core").alias("term"), core_name(F.col("target")).alias("target"), "official", "edition", "origin"))


def short_forms(register: DataFrame) -> DataFrame:
    """``short, long, lang``: a register of abbreviations (``short, term, target``) in both languages; the translation's own short form is the long form's letters where the register has none (``target_short``)."""
    both = register.select("short", F.col("term").alias("long"), F.lit("en").alias("lang"))
    other = register.where("target is not null").select(F.coalesce("target_short", "short").alias("short"), F.col("target").alias("long"), F.lit("de").alias("lang"))
    return both.unionByName(other).distinct()


def origins(glossary: DataFrame, marks: tuple[str, ...]) -> DataFrame:
    """``own, official, n``: glossary rows by whether they were derived here or taken from elsewhere, and by official."""
    from .predicates import is_derived

    return glossary.groupBy(is_derived(F.col("origin"), marks).alias("own"), "official").agg(F.count("*").alias("n"))
