"""Structural alignment of two sides by fingerprints, buckets, votes and elimination."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_term
from .components import _checkpointed

SUFFIXES = ("s", "e", "en", "n", "er")


def unique_pairs(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """``left_id, right_id``: rows whose key stands once on either side; null is a value of the key."""
    once = lambda df, name: df.groupBy(*key).agg(F.min("id").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    a, b = once(left, "left_id"), once(right, "right_id")
    same = [a[k].eqNullSafe(b[k]) for k in key]
    return a.join(b, same).select("left_id", "right_id")


def staged_pairs(left: DataFrame, right: DataFrame, full: list[str], partial: list[str]) -> DataFrame:
    """Pairs by the full key, then by the partial key among rows that are still free; ``left_id, right_id, stage``."""
    first = unique_pairs(left, right, full)
    rest_l = left.join(first, left["id"] == first["left_id"], "left_anti")
    rest_r = right.join(first, right["id"] == first["right_id"], "left_anti")
    second = unique_pairs(rest_l, rest_r, partial)
    return first.withColumn("stage", F.lit(1)).unionByName(second.withColumn("stage", F.lit(2)))


def bucket_elimination(left: DataFrame, right: DataFrame, bucket: str) -> DataFrame:
    """``left_id, right_id``: after same-named rows are dropped from a bucket, the pair of those with one row left on either side."""
    l, r = (df.select("id", bucket, norm_term(F.col("name")).alias("key")) for df in (left, right))
    shared = l.join(r, [bucket, "key"], "left_semi").select(bucket, "key").distinct()
    once = lambda df, name: df.join(shared, [bucket, "key"], "left_anti").groupBy(bucket).agg(F.min("id").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    return once(l, "left_id").join(once(r, "right_id"), bucket).select("left_id", "right_id")


def majority(votes: DataFrame, least: int = 2, margin: int = 4) -> DataFrame:
    """``term, candidate, votes``: candidates with at least least votes and more than margin times those of the runner-up."""
    counted = votes.groupBy("term", "candidate").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("term").orderBy(F.desc("votes"), "candidate")
    placed = counted.withColumn("n", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("votes").over(w), F.lit(0)))
    return placed.where((F.col("n") == 1) & (F.col("votes") >= least) & (F.col("next") * margin < F.col("votes"))).select("term", "candidate", "votes")


def inflections(terms: DataFrame) -> DataFrame:
    """``base, form``: terms that another term extends by a known ending; found by cutting endings off, not by pairs."""
    t = terms.select(norm_term(F.col("term")).alias("form")).where("form <> ''").distinct()
    cut = t.select("form", F.explode(F.array(*[F.when(F.endswith("form", F.lit(s)) & (F.length("form") > len(s)), F.expr(f"left(form, length(form) - {len(s)})")) for s in SUFFIXES])).alias("base")).where("base is not null")
    return cut.join(t.select(F.col("form").alias("base")), "base").select("base", "form").distinct()


def one_spelling(glossary: DataFrame) -> DataFrame:
    """glossary with ``official`` kept for one of the targets that differ in spelling only, and 0 for the others of a term."""
    fold = norm_term(F.replace(F.lower("target"), F.lit("ß"), F.lit("ss")))
    folded = glossary.withColumn("_term", F.lower("term")).withColumn("_fold", fold)
    alike = folded.groupBy("_term").agg(F.countDistinct("_fold").alias("folds"), F.countDistinct("target").alias("forms"))
    w = Window.partitionBy("_term").orderBy(F.desc("official"), "target", "row_id")
    marked = folded.join(alike, "_term").withColumn("_n", F.row_number().over(w))
    return marked.withColumn("official", F.when((F.col("folds") == 1) & (F.col("forms") > 1) & (F.col("_n") > 1), 0).otherwise(F.col("official"))).drop("_term", "_fold", "_n", "folds", "forms")


def anagram_repairs(names: DataFrame, known: DataFrame) -> DataFrame:
    """``name, repaired``: names that aren't known and have the letters of exactly one known name."""
    from ..functions.text import sorted_letters

    k = known.select(F.col("name").alias("repaired")).distinct().withColumn("key", sorted_letters(F.col("repaired")))
    only = k.groupBy("key").agg(F.min("repaired").alias("repaired"), F.count("*").alias("n")).where("n = 1").drop("n")
    torn = names.select("name").distinct().join(known.select("name").distinct(), "name", "left_anti").withColumn("key", sorted_letters(F.col("name")))
    return torn.join(only, "key").select("name", "repaired")


def inflected_pairs(glossary: DataFrame) -> DataFrame:
    """``term, target``: search variants of official rows: where both languages inflect the same two rows ("attack", "attacks"), each form's term with the other form's target, if no row has them yet."""
    rows = glossary.where("official = 1").select(norm_term(F.col("term")).alias("en"), norm_term(F.col("target")).alias("de")).where("en <> '' and de <> ''").distinct()
    ends = lambda c: F.explode(F.array_compact(F.array(*[F.when(F.endswith(c, F.lit(x)) & (F.length(c) > len(x)), F.expr(f"left({c}, length({c}) - {len(x)})")) for x in SUFFIXES])))
    long = rows.select(F.col("en").alias("en2"), F.col("de").alias("de2"), ends("en").alias("en")).select("en2", "de2", "en", ends("de2").alias("de"))
    pairs = rows.join(long, ["en", "de"])
    crossed = pairs.select(F.col("en").alias("term"), F.col("de2").alias("target")).unionByName(pairs.select(F.col("en2").alias("term"), F.col("de").alias("target"))).distinct()
    there = glossary.select(norm_term(F.col("term")).alias("term"), norm_term(F.col("target")).alias("target"))
    return crossed.join(there, ["term", "target"], "left_anti")


def container_pairs(left: DataFrame, right: DataFrame, known: DataFrame) -> DataFrame:
    """``container, left, right``: parts (``container, name``) of containers with as many on either side, in no order: known pairs (``left, right``) first, apostrophes of any kind alike, then the two that alone are left."""
    straight = lambda c: norm_term(F.regexp_replace(c, "[’‘`´]", "'"))
    count = lambda df, c: df.groupBy("container").agg(F.countDistinct("name").alias(c))
    even = count(left, "a").join(count(right, "b"), "container").where("a = b").select("container")
    l = left.join(even, "container").select("container", F.col("name").alias("left"), straight(F.col("name")).alias("_l")).distinct()
    r = right.join(even, "container").select("container", F.col("name").alias("right"), straight(F.col("name")).alias("_r")).distinct()
    k = known.select(straight(F.col("left")).alias("_l"), straight(F.col("right")).alias("_r")).distinct()
    paired = l.join(k, "_l").join(r, ["container", "_r"]).select("container", "left", "right").distinct()
    alone = lambda df, c: df.join(paired, ["container", c], "left_anti").groupBy("container").agg(F.min(c).alias(c), F.count("*").alias("n")).where("n = 1").drop("n")
    return paired.unionByName(alone(l, "left").join(alone(r, "right"), "container"))


def colloquial(variants: DataFrame, glossary: DataFrame) -> DataFrame:
    """``term, target, official``: curated everyday words (``term, target``) as search variants, where the target is one that the glossary has and the pair is new."""
    targets = glossary.select(norm_term(F.col("target")).alias("_t")).distinct()
    there = glossary.select(norm_term(F.col("term")).alias("_k"), norm_term(F.col("target")).alias("_t"))
    rows = variants.withColumns({"_k": norm_term(F.col("term")), "_t": norm_term(F.col("target"))})
    return rows.join(targets, "_t", "left_semi").join(there, ["_k", "_t"], "left_anti").select("term", "target", F.lit(0).alias("official")).distinct()


def part_terms(parts: DataFrame, glossary: DataFrame) -> DataFrame:
    """``term, target, official``: parts (``term, target, whole_term, whole_target``) of compounds, where the glossary has the compound as an official row and the part isn't there."""
    official = glossary.where("official = 1").select(norm_term(F.col("term")).alias("_w"), norm_term(F.col("target")).alias("_v")).distinct()
    rows = parts.withColumns({"_w": norm_term(F.col("whole_term")), "_v": norm_term(F.col("whole_target")), "_k": norm_term(F.col("term"))})
    new = rows.join(official, ["_w", "_v"], "left_semi").join(glossary.select(norm_term(F.col("term")).alias("_k")).distinct(), "_k", "left_anti")
    return new.select("term", "target", F.lit(0).alias("official")).distinct()


def preview(proposed: DataFrame, glossary: DataFrame) -> DataFrame:
    """``term, target, evidence, new``: proposed pairs (``term, target, step``) with how many steps found them, and whether the glossary lacks them."""
    there = glossary.select(norm_term(F.col("term")).alias("_k"), norm_term(F.col("target")).alias("_t")).distinct().withColumn("_old", F.lit(True))
    counted = proposed.groupBy("term", "target").agg(F.countDistinct("step").alias("evidence"))
    met = counted.withColumns({"_k": norm_term(F.col("term")), "_t": norm_term(F.col("target"))}).join(there, ["_k", "_t"], "left")
    return met.select("term", "target", "evidence", F.col("_old").isNull().alias("new"))


def seeded_chain(glossary: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], keep: Callable = _checkpointed) -> DataFrame:
    """glossary (``term, target, official, origin``) after an ordered chain of steps: each drops the rows of its own origin and adds those that it derives from what is there then.

    A row that another origin has already is not added again. Nothing is written; the caller writes the result at once.
    """
    rows = glossary.select("term", "target", "official", "origin")
    for origin, derive in steps:
        rest = rows.where(~F.col("origin").eqNullSafe(F.lit(origin)))
        new = derive(rest).select("term", "target", F.coalesce(F.col("official"), F.lit(0)).alias("official"), F.lit(origin).alias("origin")).distinct()
        there = rest.select(norm_term(F.col("term")).alias("_k"), norm_term(F.col("target")).alias("_t")).distinct()
        fresh = new.withColumns({"_k": norm_term(F.col("term")), "_t": norm_term(F.col("target"))}).join(there, ["_k", "_t"], "left_anti").drop("_k", "_t")
        rows = keep(rest.unionByName(fresh), "seeded")
    return rows


def vetoed_pairs(left: DataFrame, right: DataFrame, full: list[str], partial: list[str], veto: str) -> DataFrame:
    """staged_pairs, of which those by the partial key are dropped where both sides have a value of the veto column and the values differ."""
    found = staged_pairs(left, right, full, partial)
    a, b = left.select(F.col("id").alias("left_id"), F.col(veto).alias("_a")), right.select(F.col("id").alias("right_id"), F.col(veto).alias("_b"))
    met = found.join(a, "left_id").join(b, "right_id")
    conflict = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b"))
    return met.where((F.col("stage") == 1) | ~conflict).select("left_id", "right_id", "stage")


#: Rows of one key that meet as many of the other side in one task, about.
TILE_ROWS = 4096
#: Tasks that tiles are dealt to at most.
MOST_TASKS = 4000
#: Right ids that are listed in a row, a multiple of eight.
LISTED = 256


def either_key_pairs(left: DataFrame, right: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``id, match``: each pair of a left and a right id (``id, key`` each) that are equal or share a key, once.

    Pairs are distinct as they are made: a pair by id is left out where the ids share a key, one by key is made at the
    least key that both have. So only the inputs are shuffled, never the pairs, which are as many as the keys make them.
    A key with many rows is dealt to tiles, block against block; a task holds a block, never a key. Right ids are
    listed, and a list meets all left ids of its tile in turn: an id stands in a run, matches repeat from run to run at
    whole bytes, so that a file of pairs takes a fraction of a byte for each.
    """
    keyed = lambda df, name: df.groupBy(F.col("id").alias(name)).agg(F.collect_set("key").alias("keys"))
    a, b = keyed(left, "id"), keyed(right, "match")
    same = a.withColumnRenamed("keys", "_k").join(b, F.col("id") == F.col("match")).where(~F.arrays_overlap("_k", "keys")).select("id", "match")
    several = F.when(F.size("keys") > 1, F.col("keys"))
    one, two = a.select("id", several.alias("_l"), F.explode("keys").alias("key")), b.select("match", several.alias("_r"), F.explode("keys").alias("key"))
    counts = lambda df, name: df.groupBy("key").agg(F.count("*").alias(name))
    both = counts(one, "_a").join(counts(two, "_b"), "key", "full")
    pairs = both.agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0
    blocks = lambda c: F.coalesce(F.ceil(F.col(c) / tile_rows), F.lit(1)).cast("int")
    hot = both.where((F.col("_a") > tile_rows) | (F.col("_b") > tile_rows)).select("key", blocks("_a").alias("_x"), blocks("_b").alias("_y"))  # a row for each tile_rows rows at most
    place = lambda own, c, n: F.pmod(F.xxhash64(c), F.coalesce(n, F.lit(1))).cast("int").alias(own)
    every = lambda other, n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)).alias(other)
    tile = (F.col("_i") * F.coalesce("_y", F.lit(1)) + F.col("_j")).alias("_tile")
    one = one.join(F.broadcast(hot), "key", "left").select("id", "_l", "key", "_y", place("_i", "id", F.col("_x")), every("_j", F.col("_y"))).select("id", "_l", "key", tile)
    two = two.join(F.broadcast(hot), "key", "left").select("match", "_r", "key", "_x", "_y", place("_j", "match", F.col("_y")))
    block = two.groupBy("key", "_j").agg(F.first("_x").alias("_x"), F.first("_y").alias("_y"), F.collect_list(F.struct("match", "_r")).alias("_all"))
    lists = block.select("key", "_j", "_x", "_y", "_all", F.explode(F.sequence(F.lit(1), F.size("_all"), F.lit(LISTED))).alias("_from"))
    lists = lists.select("key", "_j", "_x", "_y", F.slice("_all", F.col("_from"), F.lit(LISTED)).alias("_some"))
    keys = F.when(F.exists("_some", lambda p: p["_r"].isNotNull()), F.col("_some._r"))
    two = lists.select(F.col("_some.match").alias("_matches"), keys.alias("_keys"), "key", "_j", "_y", every("_i", F.col("_x"))).select("_matches", "_keys", "key", tile)
    n = min(-(-pairs // tile_rows**2), MOST_TASKS)
    if n > 1:  # few rows can make many pairs; their size says nothing of the work
        one, two = one.repartition(n, "key", "_tile"), two.repartition(n, "key", "_tile")
    meet = lambda lists, ids: lists.join(ids.hint("shuffle_hash"), ["key", "_tile"])
    # Spark doesn't compile what holds a lambda function: the join hands on one list at a time, compiled it would hold all pairs of a list; explode is compiled
    none = F.forall("_keys", lambda k: k.isNull())
    plain = meet(two, one).where(F.col("_l").isNull() | F.col("_keys").isNull() | none).select("id", F.explode("_matches").alias("match"))
    least = lambda p: p["_keys"].isNull() | (F.col("key") == F.array_min(F.array_intersect("_l", p["_keys"])))
    kept = F.transform(F.filter(F.arrays_zip("_matches", "_keys"), least), lambda p: p["_matches"])
    rest = meet(two.where("_keys is not null"), one.where("_l is not null")).select("id", F.explode(kept).alias("match"))
    return same.unionByName(plain).unionByName(rest)
