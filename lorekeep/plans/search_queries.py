"""Registered queries over full-text search, the search driver, fuzzy names and the glossary."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import similarity, tokens
from ..operators import fulltext, glossary, text_index
from ..operators.components import shared_folder
from ..sources import corpus
from ..sources.corpus import ENTRIES_SQL, GLOSSARY_SQL, SOURCES_SQL, table
from .registry import NORM, query

WORDS = r"'[\p{L}\p{N}]+'"


def bm25(name: str, entries: str, questions: str, k: int) -> str:
    """CTEs that end in ``name(q, id, score, rank)``: the k best rows of a CTE entries for the rows (q, query) of another."""
    return f"""{name}_tok AS (SELECT id, unnest(regexp_extract_all({NORM.format('name')}, {WORDS})) AS term, 10.0 AS w FROM {entries} UNION ALL SELECT id, unnest(regexp_extract_all({NORM.format('body')}, {WORDS})), 1.0 FROM {entries}),
{name}_size AS (SELECT id, count(*) AS size FROM {name}_tok GROUP BY id), {name}_all AS (SELECT (SELECT count(*) FROM {entries}) AS docs, (SELECT sum(size) FROM {name}_size) * 1.0 / (SELECT count(*) FROM {entries}) AS mean_size),
{name}_qt AS (SELECT DISTINCT q, unnest(regexp_extract_all({NORM.format('query')}, {WORDS})) AS prefix FROM {questions}), {name}_qn AS (SELECT q, count(*) AS n_terms FROM {name}_qt GROUP BY q),
{name}_f AS (SELECT q, prefix, id, sum(w) AS f FROM {name}_qt JOIN {name}_tok ON starts_with(term, prefix) GROUP BY ALL), {name}_df AS (SELECT q, prefix, count(*) AS df FROM {name}_f GROUP BY ALL),
{name}_part AS (SELECT f.q, f.id, CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END AS idf, f.f, s.size, mean_size FROM {name}_f f JOIN {name}_df USING (q, prefix) JOIN {name}_size s USING (id) CROSS JOIN {name}_all),
{name}_score AS (SELECT q, id, sum(-idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean_size))) AS score, count(*) AS n FROM {name}_part GROUP BY ALL),
{name}_rank AS (SELECT s.q, id, score, row_number() OVER (PARTITION BY s.q ORDER BY round(score, 9), id) AS rank FROM {name}_score s JOIN {name}_qn USING (q) WHERE n = n_terms), {name} AS (SELECT * FROM {name}_rank WHERE rank <= {k})"""


SEARCHES = [(1, "the of"), (2, "therea"), (3, "für"), (4, "and tion"), (5, "la"), (6, "th in er"), (7, "queue"), (8, "")]


def searches(spark):
    return spark.createDataFrame(SEARCHES, "query_id int, query string")


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


_ASKED = f"asked AS (SELECT * FROM {values(SEARCHES)} t(q, query))"
_SHOWN = """SELECT q AS query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, name, concat_ws(' · ', source_key, edition, kind) AS citation, substring(body, 1, 160) AS excerpt FROM hits JOIN entries USING (id) JOIN sources USING (source_key)"""


def stored_index(spark, sf_dir) -> text_index.TextIndex:
    """The index of the entries, built once for what the documents hold now."""
    root = f"{shared_folder(spark)}/text-index-{text_index.version_of(spark, f'{sf_dir}/documents.parquet')}"
    return text_index.open_or_build(corpus.entries(spark, sf_dir), root)


def shown(hits, index, sources):
    """Hits with what the index keeps of entries beside their words."""
    e = index.docs.join(sources, "source_key")
    return hits.join(e, "id").select(*hits.columns, "name", fulltext.citation(F.col("source_key"), F.col("edition"), F.col("kind")).alias("citation"), "excerpt")


@query(f"""WITH {ENTRIES_SQL}, t AS (SELECT source_key, id, unnest(regexp_extract_all({NORM.format('name')}, {WORDS})) AS term FROM entries UNION ALL SELECT source_key, id, unnest(regexp_extract_all({NORM.format('body')}, {WORDS})) FROM entries),
p AS (SELECT source_key, count(DISTINCT term) AS terms, count(DISTINCT (term, id)) AS postings, count(*) AS words FROM t GROUP BY source_key), n AS (SELECT source_key, count(*) AS entries FROM entries GROUP BY source_key)
SELECT source_key, entries, coalesce(words, 0) AS words, coalesce(terms, 0) AS terms, coalesce(postings, 0) AS postings FROM n LEFT JOIN p USING (source_key)""")
def fts_index(spark, sf_dir):
    """What the stored index holds of each source; builds it where that wasn't done yet."""
    index = stored_index(spark, sf_dir)
    held = index._table("postings", text_index.POSTINGS).groupBy("part").agg(F.countDistinct("term").alias("terms"), F.sum("n").alias("postings"))
    said = spark.createDataFrame([(s["source_key"], s["part"], s["entries"], s["words"]) for s in index.sources.values()], "source_key string, part string, entries long, words long")
    return said.join(held, "part", "left").select("source_key", "entries", "words", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("postings", F.lit(0)).alias("postings"))


@query(f"WITH {ENTRIES_SQL}, {SOURCES_SQL}, {_ASKED}, {bm25('hits', 'entries', 'asked', 10)} {_SHOWN}")
def fts_search(spark, sf_dir):
    index = stored_index(spark, sf_dir)
    return shown(index.search(searches(spark)), index, corpus.sources(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL}, {SOURCES_SQL}, {_ASKED}, e AS (SELECT * FROM entries WHERE edition = '2024' AND category = 3 AND source_key <> 'src1'), {bm25('hits', 'e', 'asked', 10)} {_SHOWN}")
def fts_filtered(spark, sf_dir):
    index = stored_index(spark, sf_dir)
    return shown(index.search(searches(spark), 10, "edition = '2024' AND category = 3 AND source_key <> 'src1'"), index, corpus.sources(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL}, asked AS (SELECT id AS q, name AS query FROM entries WHERE id % 20 = 0), {bm25('hits', 'entries', 'asked', 10)} SELECT q AS query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM hits")
def fts_names(spark, sf_dir):
    """The index asked with the names of every twentieth entry."""
    index = stored_index(spark, sf_dir)
    return index.search(index.docs.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.array_join(F.array_distinct(tokens(F.col("name"))), " ").alias("query")))


@query(f"""WITH {ENTRIES_SQL}, {_ASKED}, e AS (SELECT id, name, body FROM entries WHERE source_key <> 'src3' UNION ALL SELECT id, name, 'the queue of la ' || coalesce(body, '') FROM entries WHERE source_key = 'src3' AND id % 2 = 0),
{bm25('hits', 'e', 'asked', 10)} SELECT q AS query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM hits""")
def fts_replaced(spark, sf_dir):
    """Searches after one source's entries were replaced in an index of their own."""
    e = corpus.entries(spark, sf_dir)
    index = text_index.build(e, f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}")
    new = e.where("source_key = 'src3' and id % 2 = 0").withColumn("body", F.concat(F.lit("the queue of la "), F.coalesce("body", F.lit(""))))
    return index.replace("src3", new).search(searches(spark))


_RUNS = [(1, 0, "therea"), (1, 1, "the"), (2, 0, "queue"), (2, 1, "la que"), (2, 2, "an")]


@query(f"""WITH {ENTRIES_SQL}, r AS (SELECT * FROM {values(_RUNS)} t(query_id, run, query)), asked AS (SELECT query_id * 100 + run AS q, query FROM r), {bm25('hits', 'entries', 'asked', 10)},
o AS (SELECT q // 100 AS query_id, id, q % 100 AS run, rank, row_number() OVER (PARTITION BY q // 100, id ORDER BY q, rank) AS n FROM hits) SELECT CAST(query_id AS INTEGER) AS query_id, id, CAST(run AS INTEGER) AS run, CAST(rank AS INTEGER) AS place FROM o WHERE n = 1""")
def fts_runs(spark, sf_dir):
    return fulltext.search_in_runs(stored_index(spark, sf_dir).search, spark.createDataFrame(_RUNS, "query_id int, run int, query string"))


_RANKED = f"""h AS (SELECT q AS query_id, id, name, rank % 3 AS run, coalesce(priority, 100) AS priority, {NORM.format('name')} AS key, {NORM.format('query')} AS aim FROM hits JOIN entries USING (id) JOIN sources USING (source_key) JOIN asked USING (q)),
c AS (SELECT *, CASE WHEN key = aim THEN 0 WHEN starts_with(key, aim) THEN 1 ELSE 3 END AS class FROM h)
SELECT query_id, id, class, CAST(row_number() OVER (PARTITION BY query_id ORDER BY class, CASE WHEN class = 0 THEN priority ELSE run END, CASE WHEN class = 0 THEN run ELSE priority END, name, id) AS INTEGER) AS rank FROM c"""


@query(f"WITH {ENTRIES_SQL}, {SOURCES_SQL}, {_ASKED}, {bm25('hits', 'entries', 'asked', 50)}, {_RANKED}")
def hit_ranking(spark, sf_dir):
    from ..operators import resolve

    index = stored_index(spark, sf_dir)
    hits = index.search(searches(spark), 50).join(index.docs.join(corpus.sources(spark, sf_dir), "source_key"), "id").join(searches(spark), "query_id")
    asked = hits.select("query_id", "query", "id", "name", F.coalesce("priority", F.lit(100)).alias("priority"), (F.col("rank") % 3).alias("run"))
    return resolve.ranked(asked).select("query_id", "id", "class", "rank")


_QUESTIONS = [(1, "queue"), (2, "the"), (3, "ea"), (4, "la que")]
_WORDS = [("queue", "la que"), ("ea", "an"), ("an", "in")]
_ALL_RUNS = [(1, 0, "queue"), (1, 1, "la que"), (2, 0, "the"), (3, 0, "ea"), (3, 1, "an"), (3, 2, "in"), (4, 0, "la que"), (4, 1, "queue")]


def _driver(name: str, condition: str, limit: int, other: bool) -> str:
    return f"""{name}_e AS (SELECT * FROM entries WHERE {condition}), {bm25(f'{name}_hits', f'{name}_e', 'asked', 5 * limit)},
{name}_o AS (SELECT q // 100 AS query_id, id, q % 100 AS run, row_number() OVER (PARTITION BY q // 100, id ORDER BY q, rank) AS n FROM {name}_hits),
{name}_r AS (SELECT o.query_id, o.id, o.run, e.name, {NORM.format('e.name')} AS key, coalesce(s.priority, 100) AS priority, x.query, CASE WHEN o.run = 0 THEN 'direct' ELSE 'glossary:' || r.query END AS path,
  CASE WHEN s.kind IS NULL AND {NORM.format('e.name')} <> '' THEN concat_ws('|', e.edition, e.category, {NORM.format('e.name')}) ELSE 'id ' || o.id END AS g
  FROM {name}_o o JOIN {name}_e e USING (id) JOIN sources s USING (source_key) JOIN runs r ON r.query_id = o.query_id AND r.run = o.run JOIN runs x ON x.query_id = o.query_id AND x.run = 0 WHERE o.n = 1),
{name}_one AS (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY priority, run, name, id) AS n FROM {name}_r),
{name}_c AS (SELECT *, CASE WHEN key = query OR key IN (SELECT v.query FROM runs v WHERE v.query_id = o.query_id AND v.run > 0) THEN 0 WHEN starts_with(key, query) THEN 1 WHEN EXISTS (SELECT 1 FROM runs v WHERE v.query_id = o.query_id AND v.run > 0 AND starts_with(o.key, v.query)) THEN 2 ELSE 3 END AS class FROM {name}_one o WHERE n = 1),
{name} AS (SELECT query_id, {str(other).lower()} AS other, row_number() OVER (PARTITION BY query_id ORDER BY class, CASE WHEN class = 0 THEN priority ELSE run END, CASE WHEN class = 0 THEN run ELSE priority END, name, id) AS rank, id, path, count(*) OVER (PARTITION BY query_id) AS total FROM {name}_c)"""


@query(f"""WITH {ENTRIES_SQL}, {SOURCES_SQL}, runs AS (SELECT * FROM {values(_ALL_RUNS)} t(query_id, run, query)), asked AS (SELECT query_id * 100 + run AS q, query FROM runs),
{_driver('here', "edition = '2024'", 10, False)}, {_driver('there', "edition <> '2024'", 5, True)}
SELECT CAST(query_id AS INTEGER) AS query_id, other, CAST(rank AS INTEGER) AS rank, id, path, total FROM here WHERE rank <= 10 UNION ALL SELECT CAST(query_id AS INTEGER), other, CAST(rank AS INTEGER), id, path, total FROM there WHERE rank <= 5""")
def search_driver(spark, sf_dir):
    words = spark.createDataFrame(_WORDS, "term string, target string")
    asked = spark.createDataFrame(_QUESTIONS, "query_id int, query string")
    return fulltext.find(corpus.entries(spark, sf_dir), corpus.sources(spark, sf_dir), words, asked, "5.5e", index=stored_index(spark, sf_dir)).drop("relevance")


@query(f"""WITH {ENTRIES_SQL}, w AS (SELECT id, regexp_extract_all(body, '[\\p{{L}}\\p{{N}}\\p{{M}}]+') AS w FROM entries), h AS (SELECT id, w, [starts_with({NORM.format('x')}, 'th') OR starts_with({NORM.format('x')}, 'qu') FOR x IN w] AS h FROM w),
s AS (SELECT *, len(w) AS n, greatest(1, least(coalesce(list_position(h, true), 0) - 4, len(w) - 15)) AS a FROM h)
SELECT id, CASE WHEN w IS NOT NULL THEN CASE WHEN a > 1 THEN '… ' ELSE '' END || array_to_string([CASE WHEN h[i] THEN '»' || w[i] || '«' ELSE w[i] END FOR i IN range(a, least(n + 1, a + 16))], ' ') || CASE WHEN a + 16 <= n THEN ' …' ELSE '' END END AS snippet FROM s""")
def fts_snippets(spark, sf_dir):
    e = corpus.entries(spark, sf_dir)
    return e.select("id", fulltext.snippet(F.col("body"), F.array(F.lit("th"), F.lit("qu"))).alias("snippet"))


def _misspelt(spark, sf_dir):
    """Names of every twentieth part without their third letter."""
    return table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)")).alias("asked")).distinct()


@query()
def glossary_suggestions(spark, sf_dir):
    return glossary.suggest(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), _misspelt(spark, sf_dir))


@query()
def fuzzy_ratio(spark, sf_dir):
    near = glossary_suggestions(spark, sf_dir)
    return near.select("asked", "name", F.round(similarity(F.col("asked"), F.col("name")), 2).alias("ratio"))


@query()
def fuzzy_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    asked = p.where("p_partkey % 20 = 0").groupBy(F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)")).alias("query")).agg(F.min("p_partkey").alias("query_id"))
    return fulltext.fuzzy_names(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), asked, 3)


_G = f"""g AS (SELECT *, {NORM.format('term')} AS key FROM glossary), q AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 2 = 0 THEN ' (x)' ELSE '' END AS asked FROM part),
o AS (SELECT asked, term, target, official, row_number() OVER (PARTITION BY asked ORDER BY official DESC, edition IS NULL, edition DESC NULLS LAST, origin IS NULL, target, row_id) AS place FROM q JOIN g ON key = {NORM.format('asked')})"""


@query(f"WITH {GLOSSARY_SQL}, {_G} SELECT asked, CAST(place AS INTEGER) AS place, target, official, 'exact' AS match FROM o WHERE place <= 10")
def exact_translations(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " (x)").otherwise("")).alias("asked"))
    return glossary.translated_terms(corpus.glossary(spark, sf_dir), asked).where("match = 'exact'")


@query(f"""WITH {GLOSSARY_SQL}, {_G}, b AS (SELECT key, target, official, row_number() OVER (PARTITION BY key ORDER BY official DESC, edition IS NULL, edition DESC NULLS LAST, origin IS NULL, target, row_id) AS n FROM g),
c AS (SELECT * FROM b WHERE n = 1) SELECT asked, coalesce(a.target, d.target) AS target, CASE WHEN a.target IS NOT NULL THEN a.official ELSE d.official END AS official FROM q LEFT JOIN c a ON a.key = {NORM.format('asked')} LEFT JOIN c d ON d.key = {NORM.format("replace(asked, ' (x)', '')")}""")
def best_targets(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " (x)").otherwise("")).alias("asked"))
    return glossary.best_target(corpus.glossary(spark, sf_dir), asked)


_BOOKS = "CASE p_size % 3 WHEN 0 THEN 'Guide 2014' WHEN 1 THEN 'Guide 2024' ELSE 'Guide' END"


@query(f"""WITH a AS (SELECT p_name || ' ' || p_partkey % 40 || CASE WHEN p_partkey % 3 = 0 THEN ' (Action)' ELSE '' END AS term, p_type AS target, p_size % 2 AS official, {_BOOKS} AS book FROM part),
r AS (SELECT term, target, official, CASE WHEN contains(book, '2024') THEN '2024' WHEN contains(book, '2014') THEN '2014' END AS edition, book AS origin FROM a),
c AS (SELECT *, replace(term, ' (Action)', '') AS core FROM r WHERE term LIKE '%(Action)'), o AS (SELECT {NORM.format('core')} AS key FROM c GROUP BY 1 HAVING count(DISTINCT term) = 1)
SELECT * FROM r UNION ALL SELECT core, target, official, edition, origin FROM c WHERE {NORM.format('core')} IN (SELECT key FROM o) AND {NORM.format('core')} NOT IN (SELECT {NORM.format('term')} FROM r)""")
def answer_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    term = F.concat("p_name", F.lit(" "), F.col("p_partkey") % 40, F.when(F.col("p_partkey") % 3 == 0, " (Action)").otherwise(""))
    return glossary.response_rows(p.select(term.alias("term"), F.col("p_type").alias("target"), (F.col("p_size") % 2).alias("official"), F.expr(_BOOKS).alias("book")))


@query(f"""WITH {ENTRIES_SQL}, terms AS (SELECT DISTINCT array_to_string(regexp_extract_all({NORM.format('text')}, {WORDS})[1:2], ' ') AS term FROM benchmark),
b AS (SELECT id, ' ' || array_to_string(regexp_extract_all({NORM.format('body')}, {WORDS}), ' ') || ' ' AS body, regexp_extract_all(body, {WORDS}) AS w FROM entries),
f AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY length(term) DESC, term) AS n FROM b JOIN terms ON contains(body, ' ' || term || ' ') WHERE length(term) >= 4 AND term NOT IN ('this is', 'from the'))
SELECT id, term FROM f WHERE n <= 3 UNION SELECT id, s FROM b, {values([('A',), ('The',), ('Le',)])} t(s) WHERE list_contains(w, s)""")
def term_spotting_capped(spark, sf_dir):
    phrases = table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(tokens(F.col("text")), 1, 2), " ").alias("term"))
    short = spark.createDataFrame([("A",), ("The",), ("Le",)], "term string")
    return glossary.spot(corpus.entries(spark, sf_dir), phrases, stop=("this is", "from the"), abbreviations=short, cap=3)


_MARKS = ("Brand#1", "Brand#3")


@query(f"WITH {GLOSSARY_SQL} SELECT contains(origin, 'Brand#1') OR contains(origin, 'Brand#3') AS own, official, count(*) AS n FROM glossary GROUP BY ALL")
def glossary_origins(spark, sf_dir):
    return glossary.origins(corpus.glossary(spark, sf_dir), _MARKS)


@query("""SELECT DISTINCT substring(p_brand, 7) || p_size AS short, p_name AS long, 'en' AS lang FROM part UNION SELECT CASE WHEN p_size % 2 = 0 THEN 'T' || p_size ELSE substring(p_brand, 7) || p_size END, p_type, 'de' FROM part""")
def short_forms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return glossary.short_forms(p.select(F.concat(F.expr("substring(p_brand, 7)"), "p_size").alias("short"), F.col("p_name").alias("term"), F.col("p_type").alias("target"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("T"), "p_size")).alias("target_short")))
