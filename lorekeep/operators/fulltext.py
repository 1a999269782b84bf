"""Ranked full-text search: BM25 with column weights and prefix terms, for many queries at once; and the search driver over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import weighted_ratio
from ..functions.text import TOKEN, citation, norm_term, similarity, tokens
from . import glossary as terms_of
from .components import _checkpointed
from .predicates import checked, edition, edition_name, relevance
from .resolve import entity_groups, ranked

K1, B = 1.2, 0.75
#: Weights of the columns that entries may have.
WEIGHTS = {"name": 10.0, "original": 10.0, "body": 1.0}
LEAST_IDF = 1e-6
#: Distinct prefixes that are tested while a text is cut, so that only what they match is kept; more are joined. Rows of terms that may be broadcast.
TESTED, BROADCAST_TERMS = 500, 100_000
QUERY_CHARS, MOST, RAW, FUZZY_FROM = 200, 50, 5, 86.0
SNIPPET_WORDS, SNIPPET_BEFORE = 16, 4
#: Values that an error names.
NAMED = 20


def matching(entries: DataFrame, prefixes: list[str] | None) -> DataFrame:
    """``id, size, hits``: each entry's number of words and those that begin with one of the prefixes (None: all), with the weights of their columns."""
    held = [c for c in WEIGHTS if c in entries.columns]
    folded = entries.select("id", *[F.coalesce(norm_term(F.col(c)), F.lit("")).alias(f"_{c}") for c in held])
    begins = "" if prefixes is None else "(?:" + "|".join(sorted(prefixes)) + ")"
    word = rf"(?<![\p{{L}}\p{{N}}])({begins}[\p{{L}}\p{{N}}]{'+' if prefixes is None else '*'})"
    weigh = lambda w: lambda t: F.struct(t.alias("term"), F.lit(w).alias("w"))
    some = lambda c: F.lit(None).cast("array<string>") if prefixes == [] else F.regexp_extract_all(f"_{c}", F.lit(word))
    hits = F.concat(*[F.transform(F.coalesce(some(c), F.array().cast("array<string>")), weigh(WEIGHTS[c])) for c in held])
    size = F.lit(0)
    for c in held:
        size = size + F.regexp_count(f"_{c}", F.lit(TOKEN))
    return folded.select("id", size.alias("size"), hits.alias("hits"))


def search(entries: DataFrame, queries: DataFrame, k: int = 10, keep: Callable = _checkpointed) -> DataFrame:
    """``query_id, rank, id, score`` : the k best entries of each query (``query_id, query``), lower scores first.

    Every word of a query is a prefix and all must occur. Filters belong on entries, before the limit. Texts are cut
    once; of their words only those are kept that begin with a query's, and they meet the queries by equality of their
    first letters. Queries without a word find nothing.
    """
    terms = queries.select("query_id", F.posexplode(tokens(F.col("query"))).alias("i", "prefix"))
    wanted = queries.select("query_id", F.size(tokens(F.col("query"))).alias("n_terms"))
    known = [r["prefix"] for r in terms.select("prefix").distinct().limit(TESTED + 1).collect()]
    small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    near = F.broadcast if small else (lambda df: df)
    lengths = sorted({len(p) for p in known} if len(known) <= TESTED else {r["n"] for r in terms.select(F.length("prefix").alias("n")).distinct().collect()})
    rows = keep(matching(entries, known if len(known) <= TESTED else None), "matching")
    docs, mean_size = rows.agg(F.count("*"), F.avg("size")).first()
    found = rows.where(F.size("hits") > 0).select("id", "size", F.inline("hits")).groupBy("id", "size", "term").agg(F.sum("w").alias("weighted"))
    starts = F.array_compact(F.array(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    hit = found.withColumn("prefix", F.explode(starts)).join(near(terms), "prefix")
    per_term = hit.groupBy("query_id", "i", "id", "size").agg(F.sum("weighted").alias("f"))
    frequency = per_term.groupBy("query_id", "i").agg(F.count("*").alias("df"))
    idf = F.log((docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
    part = -idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / (mean_size or 1.0)))
    scored = per_term.join(near(frequency), ["query_id", "i"])
    whole = scored.groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.count("*").alias("n")).join(near(wanted), "query_id").where("n = n_terms")
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9), "id")
    return whole.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def search_in_runs(searched: Callable[[DataFrame, int], DataFrame], runs: DataFrame, k: int = 10) -> DataFrame:
    """Results of a query's runs (``query_id, run, query``: the original and its alternatives) as one list.

    searched takes queries and k, like a stored index's search. An entry counts in the first run that finds it and keeps its place there; ``query_id, id, run, place``.
    """
    each = runs.select(F.struct("query_id", "run").alias("query_id"), "query")
    found = searched(each, k).select("query_id.query_id", "query_id.run", "id", "rank")
    first = Window.partitionBy("query_id", "id").orderBy("run", "rank")
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").select("query_id", "id", "run", F.col("rank").alias("place"))


def cited(hits: DataFrame, entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits with the compact projection: name, citation and an excerpt of 160 characters."""
    e = entries.join(sources, "source_key")
    return hits.join(e, "id").select(*hits.columns, "name", citation(F.col("source_key"), F.col("edition"), F.col("kind")).alias("citation"), F.substring("body", 1, 160).alias("excerpt"))


def snippet(body: Column, prefixes: Column, words: int = SNIPPET_WORDS) -> Column:
    """Words of a body around the first that begins with one of the prefixes (an array), with matches in »« and an ellipsis where it is cut; marks between words are left out."""
    raw = F.regexp_extract_all(body, F.lit(r"([\p{L}\p{N}\p{M}]+)"))
    marked = F.transform(raw, lambda w: F.struct(w.alias("w"), F.exists(prefixes, lambda p: F.startswith(norm_term(w), p)).alias("hit")))

    def window(x: Column) -> Column:
        at = F.array_position(F.transform(x, lambda e: e["hit"]), True)
        start = F.greatest(F.lit(1), F.least(at - min(SNIPPET_BEFORE, (words - 1) // 3), F.size(x) - words + 1)).cast("int")
        text = F.array_join(F.transform(F.slice(x, start, words), lambda e: F.when(e["hit"], F.concat(F.lit("»"), e["w"], F.lit("«"))).otherwise(e["w"])), " ")
        return F.concat(F.when(start > 1, "… ").otherwise(""), text, F.when(start + words <= F.size(x), " …").otherwise(""))

    return F.element_at(F.transform(F.array(marked), window), 1)


def fuzzy_names(entries: DataFrame, asked: DataFrame, k: int = 10, least: float = FUZZY_FROM) -> DataFrame:
    """``query_id, id, score, place``: entries whose name resembles a question (``query_id, query``) by weighted similarity, as written, best first, then by name.

    A name and a question meet where they share a run of three letters; those of 86 or more do, but for strings below
    six letters, which meet by a single letter.
    """
    def runs_of(c: Column, n: int) -> Column:
        return F.explode(F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: c.substr(i, F.lit(n))), lambda g: F.length(g) == n)))

    # names are compared once however many entries have them; of one name no more than k can be among the k best
    named = entries.where("name is not null and name <> ''").select("id", "name").distinct()
    held = named.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("_n") <= k).select("id", "name")
    n = named.select("name").distinct()
    q = asked.where("query is not null and query <> ''").select("query_id", "query")
    keyed = lambda df, c, size: df.withColumn("g", runs_of(F.col(c), size))
    long = keyed(n, "name", 3).join(keyed(q, "query", 3), "g")
    short = keyed(n, "name", 1).join(keyed(q.where(F.length("query") < 6), "query", 1), "g")
    short = short.unionByName(keyed(n.where(F.length("name") < 6), "name", 1).join(keyed(q, "query", 1), "g"))
    # the score takes up the count, so that it isn't computed below for each run that two strings share
    met = long.unionByName(short).groupBy("query_id", "query", "name").agg(F.count("*").alias("_met"))
    scored = met.withColumn("score", F.when(F.col("_met") > 0, weighted_ratio(F.col("query"), F.col("name")))).where(F.col("score") >= least).join(held, "name")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "name", "id")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("query_id", "id", F.round("score", 4).alias("score"), "place")


def find(entries: DataFrame, sources: DataFrame, glossary: DataFrame, questions: DataFrame, wanted_edition: str | None = "2024", category=None, source: str | None = None, limit: int = 10, index=None) -> DataFrame:
    """``query_id, other, rank, id, path, relevance, total``: what the whole search shows for questions (``query_id, query``).

    Questions are cut to 200 characters and limits to 1 to 50. Each is searched as it stands and by its exact glossary
    alternatives; a question that finds nothing so is compared with the names. Hits of one entity are merged, ranked by
    how the name fits, and cut; total counts them before. path says how an entry was found: "direct", "glossary:" and
    the alternative, or "fuzzy"; relevance, whether its name fits or its text alone mentions the question. Other
    editions (other is true) are searched apart, for half as many hits but three at least, and never merged with these.
    Raises ValueError for an edition, category or source that no entry has. index: a stored index of the entries that
    is searched instead of their texts.
    """

    def known(column: str, value) -> set:
        """The value, if an entry has it; of others so many as a message can name."""
        held = entries.where(F.col(column) == value).limit(1).count()
        return {value} if held else {r[0] for r in entries.select(column).distinct().limit(NAMED).collect()} - {value}

    if wanted_edition is not None:
        wanted_edition = edition(wanted_edition, known("edition", edition_name(wanted_edition)))
    checked("category", category, known("category", category) if category is not None else set())
    checked("source", source, known("source_key", source) if source is not None else set())
    limit = min(max(1, limit), MOST)
    narrowed = F.lit(True)
    for column, value in (("category", category), ("source_key", source)):
        if value is not None:
            narrowed = narrowed & (F.col(column) == value)
    asked = _checkpointed(questions.select("query_id", F.substring("query", 1, QUERY_CHARS).alias("query")), "asked")
    more = terms_of.alternatives(glossary, asked.select(F.col("query").alias("term")))
    order = Window.partitionBy("query_id").orderBy("hop", "alternative")
    runs = asked.join(more, F.col("query") == F.col("term")).select("query_id", F.row_number().over(order).alias("run"), F.col("alternative").alias("query"))
    runs = _checkpointed(asked.select("query_id", F.lit(0).alias("run"), "query").unionByName(runs), "runs")
    parts = [(narrowed, limit, False)]
    if wanted_edition is not None:
        parts = [(narrowed & (F.col("edition") == wanted_edition), limit, False), (narrowed & (F.col("edition") != wanted_edition), max(3, limit // 2), True)]
    out = []
    for condition, n, other in parts:
        some = entries.where(condition)
        searched = (lambda q, k, c=condition: index.search(q, k, c)) if index is not None else (lambda q, k, e=some: search(e, q, k))
        out.append(_found(some, searched, sources, asked, runs, n).withColumn("other", F.lit(other)).select(*COLUMNS))
    return out[0].unionByName(out[1]) if len(out) > 1 else out[0]


COLUMNS = ("query_id", "other", "rank", "id", "path", "relevance", "total")


def _found(entries: DataFrame, searched: Callable[[DataFrame, int], DataFrame], sources: DataFrame, asked: DataFrame, runs: DataFrame, limit: int) -> DataFrame:
    exact = search_in_runs(searched, runs, RAW * limit).join(runs.withColumnRenamed("query", "alternative"), ["query_id", "run"])
    path = F.when(F.col("run") == 0, "direct").otherwise(F.concat(F.lit("glossary:"), "alternative"))
    exact = _checkpointed(exact.select("query_id", "id", "run", "place", path.alias("path")), "hits")
    open_ = asked.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    hits = exact.unionByName(fuzzy_names(entries, open_, RAW * limit).select("query_id", "id", F.lit(0).alias("run"), "place", F.lit("fuzzy").alias("path")))
    rows = hits.join(entries, "id").join(sources, "source_key").join(asked, "query_id").withColumn("priority", F.coalesce("priority", F.lit(100)))
    # entities are those among a question's own hits
    nodes = _checkpointed(rows.withColumnsRenamed({"id": "entry", "edition": "_edition"}).withColumns({"id": F.concat_ws("|", F.col("query_id").cast("string"), F.lpad(F.col("entry").cast("string"), 20, "0")), "edition": F.concat_ws("|", F.col("query_id").cast("string"), "_edition")}), "nodes")
    groups = entity_groups(nodes, sources.where("kind is not null").select("source_key"))
    lead = Window.partitionBy("group_id").orderBy("priority", "run", "name", "entry")
    one = nodes.join(groups, "id").withColumn("_n", F.row_number().over(lead)).where("_n = 1").select("query_id", "query", F.col("entry").alias("id"), "name", "priority", "run", "path")
    variants = runs.where("run > 0").groupBy("query_id").agg(F.array_sort(F.collect_set(norm_term(F.col("query")))).alias("variants"))  # at most eight each
    placed = ranked(one.join(variants, "query_id", "left"))
    aims = F.concat(F.array(norm_term(F.col("query"))), F.coalesce("variants", F.array().cast("array<string>")))
    score = F.array_max(F.transform(aims, lambda v: F.when(v == norm_term(F.col("name")), F.lit(100.0)).otherwise(similarity(v, norm_term(F.col("name"))))))
    total = F.count("*").over(Window.partitionBy("query_id"))
    return placed.withColumn("total", total).where(F.col("rank") <= limit).select("query_id", "rank", "id", "path", relevance(score).alias("relevance"), "total")
