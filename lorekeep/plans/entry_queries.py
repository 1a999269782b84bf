"""Registered queries over predicates, entity groups, imports, alignment, checks and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm_term
from ..operators import align, etl, predicates, quality, resolve, rules
from ..sources import corpus, sinks
from ..sources.corpus import ENTRIES_SQL, GLOSSARY_SQL, SOURCES_SQL, dealt, table
from ..streaming import gates
from .registry import NORM, query
from .search_queries import values


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _pick(words, at):
    return F.element_at(F.array(*map(F.lit, words)), at.cast("int") + 1)


_NAMES = ("Feats", "Chapter 7: Beasts", "Chapters", "Elf", "Gar l gy", "Atterko pp", "Haus am See", "Typ 2b", "  Spells ", "ch. 3", "", "Reading the very long and winding road of the old folk", "Schild-kröte", "x" * 61)
_NAME_FACTS = [(True, True, True), (True, True, True), (False, True, True), (False, True, True), (False, False, True), (False, False, True), (False, True, True), (False, True, True), (True, True, True), (True, False, True), (False, False, False), (False, False, False), (False, True, True), (False, True, False)]


@query(f"""WITH f AS (SELECT * FROM {values([(i, *f) for i, f in enumerate(_NAME_FACTS)])} t(i, chapter, clean, term)) SELECT p_partkey AS id, chapter, clean, term FROM part JOIN f ON p_partkey % {len(_NAMES)} = i""")
def name_predicates(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", _pick(_NAMES, F.col("p_partkey") % len(_NAMES)).alias("n"))
    return p.select(F.col("p_partkey").alias("id"), predicates.is_chapter(F.col("n")).alias("chapter"), predicates.is_clean(F.col("n")).alias("clean"), predicates.is_term(F.col("n")).alias("term"))


_PATHS = ("Rules > Origin Feats", "Rules > Origin Feats > Alert", "", "general feats", "Races")


@query("""SELECT p_partkey AS id, p_partkey % 5 IN (0, 2, 3) OR p_partkey % 7 = 0 AS option, CASE WHEN p_partkey % 7 = 0 THEN p_size % 2 = 0 ELSE p_partkey % 5 = 0 END AS below, CASE WHEN p_size % 2 = 0 THEN 'Rules > Origin Feats' END AS stated FROM part""")
def breadcrumb_predicates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = F.when(F.col("p_partkey") % 7 != 0, _pick(_PATHS, F.col("p_partkey") % 5))
    body = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("*Context: Rules > Origin Feats*\n"), "p_name")).otherwise(F.col("p_name"))
    rows = p.select(F.col("p_partkey").alias("id"), path.alias("path"), body.alias("body"))
    return rows.select("id", predicates.is_option(F.col("path"), "feat").alias("option"), predicates.below(F.col("path"), F.col("body"), F.lit("Rules > Origin Feats")).alias("below"), predicates.path_of(F.col("body"), True).alias("stated"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size > 30 OR p_partkey % 11 = 0 THEN 'score' WHEN abs(p_partkey % 25 - floor((p_size - 10) / 2.0)) > 9 THEN 'save' END AS why FROM part""")
def implausible_records(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    scores = F.create_map(F.lit("str"), F.col("p_size").cast("int"), F.lit("dex"), F.when(F.col("p_partkey") % 11 == 0, 0).otherwise(10))
    saves = F.create_map(F.lit("str"), (F.col("p_partkey") % 25).cast("int"), F.lit("wis"), F.lit(40))
    return p.select(F.col("p_partkey").alias("id"), predicates.implausible(scores, saves).alias("why"))


_SOURCES = f"""WITH s AS (SELECT n_name AS source_key, n_nationkey AS k, n_nationkey * 4 AS priority, CASE WHEN n_nationkey % 3 = 0 THEN 'de' ELSE 'en' END AS lang, CASE WHEN n_nationkey % 2 = 0 THEN '2024' ELSE '2014' END AS edition, CASE WHEN n_nationkey % 5 = 0 THEN 'open' END AS origin,
CASE n_nationkey % 7 WHEN 0 THEN 'errata' WHEN 1 THEN 'setting' END AS kind, CASE WHEN n_nationkey % 4 = 0 THEN 'cc-by-4.0' END AS licence FROM nation),
b AS (SELECT *, CASE WHEN kind = 'errata' THEN 70 WHEN lang = 'de' THEN CASE WHEN edition <> '2024' THEN 80 WHEN kind = 'setting' OR licence IS NOT NULL THEN 20 ELSE 10 END WHEN origin = 'open' THEN 60 ELSE 40 END AS expected FROM s)"""


def _sources(spark, sf_dir):
    k = F.col("n_nationkey").cast("int")
    kind = F.when(k % 7 == 0, "errata").when(k % 7 == 1, "setting")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("source_key"), (k * 4).alias("priority"), F.when(k % 3 == 0, "de").otherwise("en").alias("lang"), F.when(k % 2 == 0, "2024").otherwise("2014").alias("edition"), F.when(k % 5 == 0, "open").alias("origin"), kind.alias("kind"), F.when(k % 4 == 0, "cc-by-4.0").alias("licence"))


@query(_SOURCES + " SELECT source_key, priority, expected FROM b WHERE NOT (priority >= expected AND priority < CASE expected WHEN 10 THEN 20 WHEN 20 THEN 40 WHEN 40 THEN 60 WHEN 60 THEN 70 WHEN 70 THEN 80 ELSE 100 END)")
def priority_bands(spark, sf_dir):
    return predicates.out_of_band(_sources(spark, sf_dir))


@query(_SOURCES + " SELECT source_key, CASE lang WHEN 'de' THEN 'German' ELSE 'English' END || ', ' || edition || ' rules' AS label FROM s")
def source_labels(spark, sf_dir):
    return _sources(spark, sf_dir).select("source_key", predicates.rules_label(F.col("lang"), F.col("edition")).alias("label"))


_CATEGORIES = ("5.5e core", "Adventure 2014", "premade sheets", "Playtest 2024", "Guides")


@query("""SELECT o_custkey AS book_id, CASE WHEN c_custkey IS NULL OR c_custkey % 6 = 5 THEN 'unknown' WHEN c_custkey % 6 = 0 THEN 'rules' WHEN c_custkey % 6 = 1 THEN 'setting' WHEN c_custkey % 6 = 2 THEN 'premade' WHEN c_custkey % 6 = 3 THEN 'playtest' ELSE 'rules' END AS decision,
CASE WHEN c_custkey % 6 = 0 THEN '2024' WHEN c_custkey % 6 = 1 THEN '2014' END AS edition FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN customer ON o_custkey = c_custkey""")
def catalogue_decisions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 6 <> 5").select(F.col("c_custkey").alias("book_id"), F.col("c_name").alias("title"), _pick(_CATEGORIES, F.col("c_custkey") % 6).alias("category"))
    return predicates.catalogue_decisions(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id")), c)


@query("""SELECT p_partkey AS book_id, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN coalesce(CASE WHEN p_partkey % 8 = 0 THEN 1 END, p_size) ELSE p_size END AS priority, p_brand AS brand FROM part""")
def book_configs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.col("p_size").cast("int").alias("priority"), F.col("p_brand").alias("brand"))
    curated = p.where("book_id % 4 = 0").select("book_id", F.upper("title").alias("title"), F.when(F.col("book_id") % 8 == 0, 1).alias("priority"))
    return predicates.book_config(p, curated)


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '2024' WHEN 1 THEN '2014' ELSE CASE WHEN p_size % 2 = 0 THEN '2014' END END AS edition, CASE WHEN p_partkey % 2 = 0 THEN 'k' || p_size ELSE 'd' || p_size END AS document FROM part""")
def book_editions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    category = _pick(("Core 5.5e", "5e rules", "other"), F.col("p_partkey") % 3)
    released = F.when(F.col("p_size") % 2 == 0, "May 2019").otherwise("2025-01-01")
    record = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"document": {"key": "k'), "p_size", F.lit('"}}'))).otherwise(F.concat(F.lit('{"document": "d'), "p_size", F.lit('"}')))
    return p.select(F.col("p_partkey").alias("id"), predicates.edition_from(category, released).alias("edition"), predicates.document_key(record).alias("document"))


@query(f"""WITH {ENTRIES_SQL}, {SOURCES_SQL}, a AS (SELECT o_orderkey AS asked_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 8 ELSE 3 END AS c FROM orders)
SELECT asked_id, CASE WHEN e.id IS NULL THEN 'missing' WHEN c <> e.category THEN 'other category' ELSE 'ok' END AS found, e.name, s.priority FROM a LEFT JOIN (entries e LEFT JOIN sources s USING (source_key)) ON asked_id = e.id""")
def entries_by_id(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 8).otherwise(3).alias("category"))
    return predicates.entry_by_id(corpus.entries(spark, sf_dir), corpus.sources(spark, sf_dir), o).select("asked_id", "found", "name", "priority")


@query(f"""WITH {ENTRIES_SQL}, {SOURCES_SQL} SELECT row_number() OVER (PARTITION BY source_key ORDER BY id) AS place, id, name, source_key, coalesce(priority, 100) AS priority FROM entries JOIN sources USING (source_key) WHERE category = 5 AND edition = '2024' AND kind IS NULL""")
def entries_of_category(spark, sf_dir):
    return predicates.of_category(corpus.entries(spark, sf_dir), corpus.sources(spark, sf_dir), 5)


@query(f"""WITH {ENTRIES_SQL} SELECT id, CASE WHEN t = '' THEN 'Question' WHEN length(t) <= 40 THEN t ELSE left(t, 39) || '…' END AS title FROM (SELECT id, trim(regexp_replace(coalesce(left(body, 20 + id % 60), ''), '\\s+', ' ', 'g')) AS t FROM entries)""")
def thread_titles(spark, sf_dir):
    return corpus.entries(spark, sf_dir).select("id", predicates.thread_title(F.expr("left(body, cast(20 + id % 60 as int))"), 40).alias("title"))


@query(f"""WITH {ENTRIES_SQL}, {SOURCES_SQL}, h AS (SELECT id % 97 AS query_id, id, source_key, kind FROM entries JOIN sources USING (source_key)) SELECT query_id, id, kind, CASE WHEN kind IS NOT NULL THEN count(*) OVER (PARTITION BY query_id, kind) END AS of_kind FROM h""")
def marked_kinds(spark, sf_dir):
    e = corpus.entries(spark, sf_dir).select((F.col("id") % 97).alias("query_id"), "id", "source_key")
    return predicates.marked_kinds(e, corpus.sources(spark, sf_dir)).select("query_id", "id", "kind", "of_kind")


@query("SELECT p_size AS query_id, count(*) AS n, min(p_name) AS example FROM part WHERE p_partkey % 3 = 0 GROUP BY p_size")
def untranslated_hits(spark, sf_dir):
    return predicates.untranslated(table(spark, sf_dir, "part").select(F.col("p_size").alias("query_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("shown")))


# Entity groups with bridges, and what they show.

_BRIDGES = "b AS (SELECT DISTINCT array_to_string(str_split(p_name, ' ')[1:1], ' ') || ' ' || p_size % 60 AS a, array_to_string(str_split(p_name, ' ')[1:1], ' ') || ' ' || (p_size * 7 + 3) % 60 AS b FROM part WHERE p_partkey % 5 = 0)"
_MEMBERS = f"""e AS (SELECT p_partkey AS id, array_to_string(str_split(p_name, ' ')[1:1], ' ') || ' ' || p_partkey % 60 || CASE WHEN p_partkey % 4 = 0 THEN ' (x)' ELSE '' END AS name, 'e' || p_partkey % 2 AS edition, p_brand AS source_key, p_partkey % 3 AS category, p_type AS excerpt, p_size % 3 AS page FROM part),
k0 AS (SELECT id, {NORM.format('name')} AS key FROM e UNION SELECT id, {NORM.format("replace(name, ' (x)', '')")} FROM e), {_BRIDGES}, bb AS (SELECT {NORM.format('a')} AS a, {NORM.format('b')} AS b FROM b UNION SELECT {NORM.format('b')}, {NORM.format('a')} FROM b),
k AS (SELECT * FROM k0 UNION SELECT id, bb.b FROM k0 JOIN bb ON key = a), plain AS (SELECT k.id, edition || '|' || category || '|' || key AS key FROM k JOIN e USING (id) WHERE source_key <> 'Brand#11')"""


def _members(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    first = F.split("p_name", " ")[0]
    name = F.concat(first, F.lit(" "), F.col("p_partkey") % 60, F.when(F.col("p_partkey") % 4 == 0, " (x)").otherwise(""))
    e = p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.concat(F.lit("e"), F.col("p_partkey") % 2).alias("edition"), F.col("p_brand").alias("source_key"), (F.col("p_partkey") % 3).alias("category"), F.col("p_type").alias("excerpt"), (F.col("p_size") % 3).alias("page"))
    bridges = p.where("p_partkey % 5 = 0").select(norm_term(F.concat(first, F.lit(" "), F.col("p_size") % 60)).alias("a"), norm_term(F.concat(first, F.lit(" "), (F.col("p_size") * 7 + 3) % 60)).alias("b")).distinct()
    return e, bridges, spark.createDataFrame([("Brand#11",)], "source_key string")


@query(f"""WITH RECURSIVE {_MEMBERS}, edge AS (SELECT DISTINCT x.id AS a, y.id AS b FROM plain x JOIN plain y USING (key)), reach(id, other) AS (SELECT a, b FROM edge UNION SELECT r.id, edge.b FROM reach r JOIN edge ON r.other = edge.a), g AS (SELECT id, min(other) AS group_id FROM reach GROUP BY id)
SELECT e.id, coalesce(group_id, e.id) AS group_id FROM e LEFT JOIN g USING (id)""")
def bridged_groups(spark, sf_dir):
    e, bridges, revisions = _members(spark, sf_dir)
    return resolve.entity_groups(e, revisions, bridges)


@query(f"""WITH {_MEMBERS}, g AS (SELECT e.*, min(id) OVER (PARTITION BY edition, category, {NORM.format("replace(name, ' (x)', '')")}) AS group_id FROM e),
r AS (SELECT g.*, 100 AS priority, source_key || CASE WHEN page IS NULL THEN '' ELSE ' p. ' || page END AS place FROM g), t AS (SELECT group_id, max(n) AS most FROM (SELECT group_id, source_key, count(*) AS n FROM r GROUP BY ALL) GROUP BY group_id),
l AS (SELECT r.*, row_number() OVER w AS n, first_value(source_key) OVER w AS lead FROM r JOIN t USING (group_id) WHERE most = 1 WINDOW w AS (PARTITION BY group_id ORDER BY name, id)),
c AS (SELECT group_id, max(CASE WHEN n = 1 THEN id END) AS id, max(CASE WHEN n = 1 THEN name END) AS name, coalesce(string_agg(DISTINCT CASE WHEN n > 1 AND source_key <> lead THEN place END, ', ' ORDER BY CASE WHEN n > 1 AND source_key <> lead THEN place END), '') AS o FROM l GROUP BY group_id),
s AS (SELECT r.*, {NORM.format('name')} AS k, first_value(id) OVER v AS one, first_value(name) OVER v AS n1, first_value(page) OVER v AS p1 FROM r JOIN t USING (group_id) WHERE most > 1 WINDOW v AS (PARTITION BY group_id, source_key, {NORM.format('name')}, excerpt ORDER BY id))
SELECT group_id, id, name, o AS other_places FROM c UNION ALL SELECT group_id, one, n1, coalesce(string_agg(DISTINCT CASE WHEN page <> p1 THEN place END, ', ' ORDER BY CASE WHEN page <> p1 THEN place END), '') FROM s GROUP BY group_id, source_key, k, excerpt, one, n1""")
def shown_members(spark, sf_dir):
    e, _, _ = _members(spark, sf_dir)
    from pyspark.sql import Window

    key = norm_term(F.replace(F.col("name"), F.lit(" (x)"), F.lit("")))
    groups = e.select("id", F.min("id").over(Window.partitionBy("edition", "category", key)).alias("group_id"))
    return resolve.shown_members(e, groups, e.select("source_key").distinct().withColumn("priority", F.lit(None).cast("int")))


# Imports and repairs.


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 1 THEN NULL ELSE p_partkey - 1 END AS parent, p_brand AS name FROM part), c AS (SELECT id, '' AS breadcrumb, name FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)
UNION ALL SELECT n.id, CASE WHEN c.breadcrumb = '' THEN c.name ELSE c.breadcrumb || ' > ' || c.name END, n.name FROM c JOIN n ON n.parent = c.id) SELECT id, breadcrumb FROM c""")
def long_parent_chains(spark, sf_dir):
    k = F.col("p_partkey")
    return etl.parent_chain(table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 50 != 1, k - 1).alias("parent_id"), F.col("p_brand").alias("name")))


_SPLIT = (("Beasts", 3, "creature"), ("Magic", 2, "spell"))


@query("""SELECT p_partkey AS id, place, name || p_size AS name, breadcrumb, category, body || p_brand || tail AS body FROM part, (VALUES (0, 'Wolf', 'Beasts', 'creature', '', ''), (1, 'Bite', 'Beasts > Wolf', 'creature', 'teeth ', ''), (2, 'Light', 'Magic', 'spell', 'glow ', '\n### Deep\nx')) t(place, name, breadcrumb, category, body, tail) WHERE place > 0
UNION ALL SELECT p_partkey, 0, 'Wolf' || p_size, 'Beasts', 'creature', 'grey' FROM part""".replace("'Beasts > Wolf'", "'Beasts > Wolf'").replace("\\n", "\n").replace("name || p_size AS name, breadcrumb", "name || p_size AS name, CASE WHEN place = 1 THEN breadcrumb || p_size ELSE breadcrumb END AS breadcrumb"))
def ruled_chunks(spark, sf_dir):
    p = dealt(spark, sf_dir, "part", "p_partkey")
    text = F.concat(F.lit("# Beasts\n## Wolf"), "p_size", F.lit("\ngrey\n### Bite"), "p_size", F.lit("\nteeth "), "p_brand", F.lit("\n# Magic\n## Light"), "p_size", F.lit("\nglow "), "p_brand", F.lit("\n### Deep\nx"))
    return etl.chunks(p.select("p_partkey", text.alias("text")), "p_partkey", "text", 1, 1, _SPLIT).select("id", "place", "name", "breadcrumb", "category", "body")


@query("""SELECT p_partkey AS id, place, CASE WHEN p_size % 2 = 0 THEN name END AS name, CASE WHEN p_size % 2 = 0 THEN body ELSE '# A' || chr(10) || repeat('x', 50) END AS body FROM part, (VALUES (0, 'A', 'first part of it'), (1, 'B', 'second part of it')) t(place, name, body) WHERE p_size % 2 = 0 OR place = 0""")
def split_entries(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 2 == 0, "# A\nfirst part of it\n## B\nsecond part of it").otherwise("# A\n" + "x" * 50)
    return etl.split_entries(p.select("p_partkey", text.alias("text")), "p_partkey", "text")


@query("""SELECT 'empty' AS reason, count(*) FILTER (p_partkey % 10 = 0) AS n FROM part UNION ALL SELECT 'no section', count(*) FILTER (p_partkey % 10 = 1) FROM part UNION ALL SELECT 'dropped heading', count(*) FILTER (p_partkey % 10 > 1) FROM part""")
def import_reports(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 10 == 0, " ").when(F.col("p_partkey") % 10 == 1, "plain").otherwise("# A\nbody text\n## Empty\n")
    docs = p.select("p_partkey", text.alias("text"))
    return etl.import_report(docs, etl.chunks(docs, "p_partkey", "text"), "p_partkey", "text")


@query("""WITH s AS (SELECT p_partkey AS id, 1 AS place, 'Wolf' AS name, 'Beasts' AS breadcrumb, 'grey **Wolf** x' AS body FROM part UNION ALL SELECT p_partkey, 3, 'Bite', 'Beasts', 'teeth' FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, 3, 'Actions', 'Other', 'teeth' FROM part WHERE p_size % 2 = 1 UNION ALL SELECT p_partkey, 4, 'Spark', 'Magic', 'light **Aktionen** roll **d6-** | table' FROM part)
SELECT id, place, name, breadcrumb, regexp_replace(regexp_replace(body, ' \\*\\*', chr(10) || chr(10) || '**', 'g'), '\\*\\* ', '**' || chr(10) || chr(10), 'g') AS body FROM s""")
def merged_sections(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    row = lambda place, name, path, body: F.struct(F.lit(place).alias("place"), name.alias("name"), path.alias("breadcrumb"), F.lit(body).alias("body"))
    odd, l = F.col("p_size") % 2 == 1, F.lit
    rows = F.array(row(1, l("Wolf"), l("Beasts"), "grey"), row(2, l("Wolf"), l("Beasts"), "x"), row(3, F.when(odd, "Actions").otherwise("Bite"), F.when(odd, "Other").otherwise("Beasts"), "teeth"), row(4, l("Spark"), l("Magic"), "light"), row(5, l("Aktionen"), l("Magic"), "roll"), row(6, l("d6-"), l("Magic"), "| table"))
    parts = p.select(F.col("p_partkey").alias("id"), F.inline(rows))
    return etl.merge_sections(parts, "^Beasts", None, ("^Magic", "Aktionen$", r"\|"))


# Alignment and seeding.


@query(f"""WITH {GLOSSARY_SQL}, o AS (SELECT DISTINCT {NORM.format("term || CASE WHEN row_id % 3 = 0 THEN 's' ELSE '' END")} AS en, {NORM.format("target || CASE WHEN row_id % 3 = 0 THEN 'en' WHEN row_id % 3 = 1 THEN 'x' ELSE '' END")} AS de FROM glossary),
s(s) AS (VALUES ('s'), ('e'), ('en'), ('n'), ('er')), p AS (SELECT a.en, a.de, b.en AS en2, b.de AS de2 FROM o a JOIN o b ON true JOIN s ON b.en = a.en || s.s JOIN s u ON b.de = a.de || u.s)
SELECT term, target FROM (SELECT en AS term, de2 AS target FROM p UNION SELECT en2, de FROM p) WHERE (term, target) NOT IN (SELECT (en, de) FROM o)""")
def inflected_pairs(spark, sf_dir):
    g = corpus.glossary(spark, sf_dir)
    k = F.col("row_id") % 3
    rows = g.select(F.concat("term", F.when(k == 0, "s").otherwise("")).alias("term"), F.concat("target", F.when(k == 0, "en").when(k == 1, "x").otherwise("")).alias("target"), F.lit(1).alias("official"))
    return align.inflected_pairs(rows)


@query("""WITH l AS (SELECT DISTINCT p_brand || p_size % 10 AS c, replace(p_name, ' ', '’') AS n FROM part WHERE p_partkey % 2 = 0), r AS (SELECT DISTINCT p_brand || p_size % 10 AS c, replace(p_name, ' ', '''') AS n FROM part WHERE p_partkey % 2 = 1),
e AS (SELECT c FROM (SELECT c, count(*) AS a FROM l GROUP BY c) JOIN (SELECT c, count(*) AS b FROM r GROUP BY c) USING (c) WHERE a = b), p AS (SELECT c, l.n AS x, r.n AS y FROM l JOIN e USING (c) JOIN r USING (c) WHERE replace(l.n, '’', '''') = r.n),
a AS (SELECT c, min(n) AS x FROM l JOIN e USING (c) WHERE (c, n) NOT IN (SELECT (c, x) FROM p) GROUP BY c HAVING count(*) = 1), b AS (SELECT c, min(n) AS y FROM r JOIN e USING (c) WHERE (c, n) NOT IN (SELECT (c, y) FROM p) GROUP BY c HAVING count(*) = 1)
SELECT c AS container, x AS "left", y AS "right" FROM p UNION ALL SELECT c, x, y FROM a JOIN b USING (c)""")
def container_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    box = F.concat("p_brand", F.col("p_size") % 10).alias("container")
    l = p.where("p_partkey % 2 = 0").select(box, F.replace("p_name", F.lit(" "), F.lit("’")).alias("name"))
    r = p.where("p_partkey % 2 = 1").select(box, F.replace("p_name", F.lit(" "), F.lit("'")).alias("name"))
    return align.container_pairs(l, r, p.select(F.col("p_name").alias("left"), F.col("p_name").alias("right")).select(F.replace("left", F.lit(" "), F.lit("'")).alias("left"), F.replace("right", F.lit(" "), F.lit("'")).alias("right")))


@query(f"""WITH {GLOSSARY_SQL}, v AS (SELECT DISTINCT 'my ' || p_name AS term, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'nothing' END AS target FROM part UNION SELECT p_name, lower(p_type) FROM part)
SELECT term, target, 0 AS official FROM v WHERE {NORM.format('target')} IN (SELECT {NORM.format('target')} FROM glossary) AND ({NORM.format('term')}, {NORM.format('target')}) NOT IN (SELECT ({NORM.format('term')}, {NORM.format('target')}) FROM glossary)""")
def colloquial_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mine = p.select(F.concat(F.lit("my "), "p_name").alias("term"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("nothing").alias("target"))
    return align.colloquial(mine.unionByName(p.select(F.col("p_name").alias("term"), F.lower("p_type").alias("target"))), corpus.glossary(spark, sf_dir))


@query(f"""WITH {GLOSSARY_SQL}, x AS (SELECT DISTINCT str_split(p_name, ' ')[1] || p_size % 5 AS term, str_split(lower(p_type), ' ')[1] AS target, p_name AS w, lower(p_type) AS v FROM part)
SELECT DISTINCT term, target, 0 AS official FROM x WHERE ({NORM.format('w')}, {NORM.format('v')}) IN (SELECT ({NORM.format('term')}, {NORM.format('target')}) FROM glossary WHERE official = 1)""")
def part_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.concat(F.split("p_name", " ")[0], F.col("p_size") % 5).alias("term"), F.split(F.lower("p_type"), " ")[0].alias("target"), F.col("p_name").alias("whole_term"), F.lower("p_type").alias("whole_target"))
    return align.part_terms(rows, corpus.glossary(spark, sf_dir))


@query(f"""WITH {GLOSSARY_SQL}, x AS (SELECT p_name AS term, CASE WHEN p_size % 4 = 0 THEN 'new ' || p_type ELSE lower(p_type) END AS target, p_size % 3 AS step FROM part)
SELECT term, target, count(DISTINCT step) AS evidence, ({NORM.format('term')}, {NORM.format('target')}) NOT IN (SELECT ({NORM.format('term')}, {NORM.format('target')}) FROM glossary) AS new FROM x GROUP BY term, target""")
def pair_preview(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return align.preview(p.select(F.col("p_name").alias("term"), F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("new "), "p_type")).otherwise(F.lower("p_type")).alias("target"), (F.col("p_size") % 3).alias("step")), corpus.glossary(spark, sf_dir))


@query(f"""WITH {GLOSSARY_SQL}, g AS (SELECT term, target, official, origin FROM glossary WHERE origin <> 'Brand#12'),
a AS (SELECT DISTINCT 'the ' || term AS term, target, 0 AS official, 'Brand#12' AS origin FROM g WHERE official = 1), h AS (SELECT * FROM g UNION ALL SELECT * FROM a),
b AS (SELECT DISTINCT replace(term, 'the ', '') AS term, target, 0 AS official, 'plain' AS origin FROM h WHERE ({NORM.format("replace(term, 'the ', '')")}, {NORM.format('target')}) NOT IN (SELECT ({NORM.format('term')}, {NORM.format('target')}) FROM h))
SELECT term, target, official, origin, count(*) AS n FROM (SELECT * FROM h UNION ALL SELECT * FROM b) GROUP BY ALL""")
def seeded_glossary(spark, sf_dir):
    steps = [("Brand#12", lambda g: g.where("official = 1").select(F.concat(F.lit("the "), "term").alias("term"), "target", F.lit(0).alias("official"))), ("plain", lambda g: g.select(F.replace("term", F.lit("the "), F.lit("")).alias("term"), "target", F.lit(0).alias("official")))]
    return align.seeded_chain(corpus.glossary(spark, sf_dir), steps).groupBy("term", "target", "official", "origin").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT o_orderkey AS g, unnest([1, 2, 3]) AS i FROM orders) SELECT 'l' || g || '_' || i AS "left", 'r' || g || '_' || i AS "right" FROM k""")
def forced_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("g"))
    term = lambda side, i: F.concat(F.lit(side), "g", F.lit(f"_{i}"))
    # a chain: each group has one more term than the pairs before it settle
    rows = [(f"{n}", side, i) for n in (1, 2, 3) for side in "lr" for i in range(1, n + 1)]
    groups = o.select(F.inline(F.array(*[F.struct(F.concat("g", F.lit("/" + n)).alias("group"), F.lit(side).alias("side"), term(side, i).alias("term")) for n, side, i in rows])))
    none = spark.createDataFrame([], "left string, right string")
    return rules.forced_pairs(groups, none)


# Checks.


@query("""SELECT p_brand AS source_key, s AS section, count(*) AS n FROM part, (VALUES ('Actions', 0), ('Reaktionen', 1)) t(s, k) WHERE p_size % 3 = k GROUP BY ALL""")
def empty_sections(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    body = F.concat(F.lit("intro\n### Actions\n"), F.when(F.col("p_size") % 3 == 0, "\n").otherwise("bite\n"), F.lit("###### Reaktionen \n"), F.when(F.col("p_size") % 3 == 1, "").otherwise("leap\n"), F.lit("#### **Other**\n"))
    return quality.empty_sections(p.select(F.col("p_brand").alias("source_key"), body.alias("body")))


_FINDINGS = "f AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'points' ELSE 'dice' END AS metric, p_brand AS source_key, p_partkey AS id FROM part WHERE p_size < 30)"


def _findings(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size < 30")
    return p.select(F.when(F.col("p_size") % 2 == 0, "points").otherwise("dice").alias("metric"), F.col("p_brand").alias("source_key"), F.col("p_partkey").alias("id"))


@query(f"WITH {_FINDINGS} SELECT metric, source_key, count(*) AS n FROM f WHERE NOT (metric = 'dice' AND id % 4 = 0) GROUP BY ALL")
def measured_defects(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return quality.measured(f, f.where("metric = 'dice' and id % 4 = 0").select("metric", "id"))


@query(f"WITH {_FINDINGS} SELECT metric, source_key, count(*) AS expected FROM f GROUP BY ALL UNION ALL SELECT 'points', 'gone', 7")
def new_baseline(spark, sf_dir):
    f = _findings(spark, sf_dir)
    now = quality.measured(f, f.where("false").select("metric", "id"))
    old = now.select("metric", "source_key", (F.col("n") + 1).alias("expected")).unionByName(spark.createDataFrame([("points", "gone", 7)], "metric string, source_key string, expected long"))
    return quality.rebased(old, now, f.select("source_key").distinct())


@query(f"""WITH {ENTRIES_SQL}, {SOURCES_SQL}, c AS (SELECT source_key, max(category) AS m FROM entries GROUP BY 1) SELECT source_key FROM sources LEFT JOIN c USING (source_key) WHERE kind IS NULL AND contains(source_key, '1') AND NOT (source_key IN ('src1', 'src10') AND coalesce(m <= 7, false)) AND NOT (source_key = 'src11' AND coalesce(m <= 2, false))""")
def suspected_sources(spark, sf_dir):
    s = corpus.sources(spark, sf_dir).withColumn("title", F.lit("book"))
    cleared = spark.createDataFrame([(k, c) for k, n in (("src1", 8), ("src10", 8), ("src11", 3)) for c in range(n)], "source_key string, category long")
    return quality.suspects(s, corpus.entries(spark, sf_dir), ("1",), cleared)


@query("SELECT p_partkey, p_type FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_partkey < 3)")
def outside_values(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    allowed = [r[0] for r in p.where("p_partkey < 3").select("p_type").collect()]
    return quality.outside(p.select("p_partkey", "p_type"), "p_type", allowed)


@query(f"""WITH {ENTRIES_SQL} SELECT 'no source' AS problem, count(*) FILTER (source_key = 'src3') AS n FROM entries UNION ALL SELECT 'other edition', count(*) FILTER (source_key <> 'src3' AND edition <> '2024') FROM entries""")
def orphaned_entries(spark, sf_dir):
    s = corpus.sources(spark, sf_dir).where("source_key <> 'src3'").select("source_key", F.lit("2024").alias("edition"))
    return quality.orphans(corpus.entries(spark, sf_dir), s)


@query(f"""WITH {GLOSSARY_SQL}, e AS (SELECT p_size % 4 AS category, lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' x' ELSE '' END) AS k FROM part), g AS (SELECT lower(term) AS k, max(official) AS o FROM glossary GROUP BY 1), n AS (SELECT category, k, count(*) AS n FROM e GROUP BY ALL)
SELECT category, CAST(sum(n) AS BIGINT) AS entries, count(*) AS names, count(o) AS translated, count(*) FILTER (o = 1) AS official, count(*) FILTER (o IS NULL) AS gaps FROM n LEFT JOIN g USING (k) GROUP BY category""")
def glossary_audit(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    e = p.select((F.col("p_size") % 4).alias("category"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " x").otherwise("")).alias("name"))
    return quality.audited(e, corpus.glossary(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT source_key, count(*) AS n FROM entries WHERE source_key <> 'src2' GROUP BY 1")
def removed_source(spark, sf_dir):
    e, _ = quality.without_source(corpus.entries(spark, sf_dir), corpus.sources(spark, sf_dir), "src2")
    return e.groupBy("source_key").agg(F.count("*").alias("n"))


@query("SELECT 'part' AS \"table\", count(*) AS rows FROM part UNION ALL SELECT 'orders', count(*) FROM orders")
def table_overview(spark, sf_dir):
    return sinks.described({t: table(spark, sf_dir, t) for t in ("part", "orders")}).drop("columns")


@query("SELECT p_size AS book_id, max_by('p' || p_partkey, p_partkey) AS path, max(p_partkey) AS export_id FROM part GROUP BY p_size")
def latest_artifacts(spark, sf_dir):
    return sinks.latest_artifacts(table(spark, sf_dir, "part").select(F.col("p_size").alias("book_id"), F.concat(F.lit("p"), "p_partkey").alias("path"), F.col("p_partkey").alias("export_id")))


@query("""SELECT 'part' AS kind, p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_type || chr(10) || chr(10) || p_name WHEN p_partkey % 3 = 1 THEN p_brand END AS body FROM part""")
def detail_bodies(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumns({"kind": F.lit("part"), "id": F.col("p_partkey")})
    own = p.where("id % 3 = 0")
    texts = own.select("kind", "id", F.lit(2).alias("place"), F.col("p_name").alias("text")).unionByName(own.select("kind", "id", F.lit(1).alias("place"), F.col("p_type").alias("text")))
    other = p.where("id % 3 < 2").select("kind", "id", F.lit(1).alias("place"), F.col("p_brand").alias("text"))
    return sinks.detail_bodies(p.select("kind", "id", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("name"), F.col("p_brand").alias("title")), texts, other)


# Gates and stores.


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t0, value AS took, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
g AS (SELECT user_id, event_id, n, true AS admitted, t0 + took + 3600 AS free FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.event_id, r.n, r.t0 >= g.free, CASE WHEN r.t0 >= g.free THEN r.t0 + r.took + 3600 ELSE g.free END FROM g JOIN r ON r.user_id = g.user_id AND r.n = g.n + 1)
SELECT user_id, event_id, admitted FROM g""")
def cooldown_gate(spark, sf_dir):
    return gates.replayed_gate(table(spark, sf_dir, "events"), 3600.0)


@query("""WITH r AS (SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'click') SELECT event_id, day, CAST(place AS INTEGER) AS place FROM r WHERE place <= 20""")
def daily_cap(spark, sf_dir):
    return gates.within_daily_cap(table(spark, sf_dir, "events").where("event_type = 'click'"), 20)


@query("""WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user'), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM c) SELECT conv_id, turn, text, CAST(age AS INTEGER) AS age FROM r WHERE age <= 2""")
def kept_questions(spark, sf_dir):
    return gates.kept_questions(table(spark, sf_dir, "conversations"), 2)


@query("""SELECT rule, count(*) AS n, max(day) AS last FROM (SELECT CAST(ts AS DATE) AS day, unnest(CASE WHEN user_id % 2 = 0 THEN ['r' || user_id % 7, 'r' || user_id % 5] ELSE ['r' || user_id % 7] END) AS rule FROM events) GROUP BY rule""")
def feedback_repeats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    r = lambda n: F.concat(F.lit("r"), u % n)
    rows = e.select(F.to_date("ts").alias("day"), F.when(u % 2 == 0, F.array(r(7), r(5))).otherwise(F.array(r(7))).alias("rules"), F.col("event_type").alias("decision"))
    return gates.repeats(rows)
