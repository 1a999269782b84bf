"""Registered queries over details, repairs, inputs and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import details, repair, rules, sessions
from ..sources import corpus
from ..sources.corpus import ENTRIES_SQL, GLOSSARY_SQL, LOG_SQL, SOURCES_SQL, table
from .registry import NORM, query


@query(f"""WITH {ENTRIES_SQL}, {SOURCES_SQL}, a AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 20 = 0), k AS (SELECT id, edition, category, {NORM.format('name')} AS key, kind FROM entries JOIN sources USING (source_key)),
g AS (SELECT id, CASE WHEN kind IS NULL AND key <> '' THEN min(CASE WHEN kind IS NULL THEN id END) OVER (PARTITION BY edition, category, key) ELSE id END AS g FROM k),
v AS (SELECT x.id, y.id AS other, row_number() OVER (PARTITION BY x.id ORDER BY y.id) AS n FROM g x JOIN g y USING (g) WHERE x.id <> y.id), vv AS (SELECT id, string_agg(CASE WHEN n <= 5 THEN other END, ',' ORDER BY n) AS v, count(*) AS n FROM v GROUP BY id),
r AS (SELECT b.id, z.id AS rev, row_number() OVER (PARTITION BY b.id ORDER BY z.id) AS n FROM k b JOIN k z USING (edition, key) WHERE b.kind IS NULL AND z.kind IS NOT NULL AND key <> ''), rr AS (SELECT id, string_agg(rev, ',' ORDER BY n) AS r FROM r WHERE n <= 3 GROUP BY id)
SELECT a.id, e.id IS NOT NULL AS found, CASE WHEN e.name LIKE 'T%' THEN 't ' || e.name || '* (' || e.name || ')' ELSE e.name END AS shown, false AS official, nullif(concat_ws(' · ', source_key, e.edition, s.kind), '') AS citation,
CASE e.lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' WHEN 'zh' THEN 'Chinese' ELSE e.lang END AS language, CASE WHEN e.id IS NOT NULL THEN 'free' END AS licence, coalesce(v, '') AS versions, coalesce(vv.n, 0) AS n_versions, coalesce(r, '') AS revisions
FROM a LEFT JOIN (entries e LEFT JOIN sources s USING (source_key)) ON a.id = e.id LEFT JOIN vv ON vv.id = a.id LEFT JOIN rr ON rr.id = a.id""")
def entry_details(spark, sf_dir):
    e = corpus.entries(spark, sf_dir)
    names = e.where("name like 'T%'").select(F.col("name").alias("term"), F.concat(F.lit("t "), "name").alias("target"), F.lit(0).alias("official"), F.lit(None).cast("string").alias("edition"), F.lit(None).cast("string").alias("origin"), F.col("id").alias("row_id"))
    asked = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("id"))
    return details.details(e, corpus.sources(spark, sf_dir).withColumn("licence", F.lit("free")), names, asked)


@query("""WITH f AS (SELECT p_partkey AS id, p_brand || p_size % 7 AS g, p_size % 10 AS priority, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS grade, CASE WHEN p_partkey % 4 = 1 THEN p_type END AS school FROM part),
b AS (SELECT g, first(grade ORDER BY priority, id) FILTER (grade IS NOT NULL) AS grade, first(school ORDER BY priority, id) FILTER (school IS NOT NULL) AS school FROM f GROUP BY g)
SELECT id, coalesce(f.grade, b.grade) AS grade, coalesce(f.school, b.school) AS school, concat_ws(',', CASE WHEN f.grade IS NULL AND b.grade IS NOT NULL THEN 'grade' END, CASE WHEN f.school IS NULL AND b.school IS NOT NULL THEN 'school' END) AS borrowed FROM f JOIN b USING (g)""")
def sibling_facets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    f = p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).alias("priority"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")).alias("grade"), F.when(F.col("p_partkey") % 4 == 1, F.col("p_type")).alias("school"))
    return details.with_sibling_facets(f, p.select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.col("p_size") % 7).alias("group_id")), ("grade", "school"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 10 = 0 THEN 'cantrip' ELSE 'grade ' || p_size % 10 END WHEN p_partkey % 3 = 1 THEN 'CR ' || p_size END AS shown FROM part")
def short_facets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    category = F.when(F.col("p_partkey") % 3 == 0, "spell").when(F.col("p_partkey") % 3 == 1, "creature").otherwise("item")
    return p.select(F.col("p_partkey").alias("id"), details.short_facet(category, (F.col("p_size") % 10).cast("int"), F.col("p_size").cast("string")).alias("shown"))


@query("SELECT p_partkey AS id, 'see ' || p_brand AS note FROM part WHERE p_size % 2 = 0 AND p_type LIKE '%A%' AND p_partkey % 5 < 3")
def known_source_errors(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    e = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("source_key"), F.concat("p_name", F.lit(" "), "p_partkey").alias("name"), F.col("p_type").alias("body"))
    errors = p.where("p_size % 2 = 0 and p_partkey % 5 < 3").select(F.col("p_brand").alias("source_key"), F.upper(F.concat("p_name", F.lit(" "), "p_partkey")).alias("name"), F.lit("A").alias("wrong"), F.concat(F.lit("see "), "p_brand").alias("note"))
    return details.known_errors(e, errors)


@query("""WITH e AS (SELECT 'n' || n_nationkey AS id, r_name AS path, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, NULL, r_name FROM region UNION ALL SELECT 'c' || c_custkey, r_name || ' > ' || n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT a.id, b.id AS related_id FROM e a JOIN e b ON b.path = CASE WHEN a.path IS NULL THEN a.name ELSE a.path || ' > ' || a.name END""")
def related_sections(spark, sf_dir):
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = both.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("r_name").alias("path"), F.col("n_name").alias("name"))
    rows = rows.unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("path"), F.col("r_name").alias("name")))
    rows = rows.unionByName(c.join(both, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat_ws(" > ", "r_name", "n_name").alias("path"), F.col("c_name").alias("name")))
    return details.related_sections(rows.withColumns({"source_key": F.lit("s"), "edition": F.lit("e")}))


@query("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Skills: ' || p_brand || '; Tools: ' || p_name WHEN 1 THEN 'Tools: ' || p_name ELSE CASE WHEN length(p_type || ' is what this part is made of') <= 40 THEN p_type || ' is what this part is made of' ELSE left(p_type || ' is what this part is made of', 39) || '…' END END AS line FROM part""")
def short_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    form = F.col("p_size") % 3
    body = F.when(form == 0, F.concat(F.lit("# T\nTools: "), "p_name", F.lit("\n**Skills:** "), "p_brand")).when(form == 1, F.concat(F.lit("**Tools**: "), "p_name")).otherwise(F.concat(F.lit("# Title\n* list of things that is long enough\n"), "p_type", F.lit(" is what this part is made of")))
    return p.select(F.col("p_partkey").alias("id"), details.short_line(body, ("Skills", "Tools"), 40).alias("line"))


@query("""WITH c AS (SELECT r_name AS class_name FROM region WHERE r_regionkey < 4), s AS (SELECT n_name AS subclass, r_name AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT class_name, subclass FROM c FULL JOIN s ON class_name = k UNION ALL SELECT NULL, 'stray'""")
def class_lists(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey") % 4
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.when(k == 0, F.concat("r_name", F.lit(" Subclass: "), "n_name")).when(k == 1, F.concat(F.lower("r_name"), F.lit("-Unterklasse: "), "n_name", F.lit(" (continued)"))).when(k == 2, F.concat("n_name", F.lit(" ("), "r_name", F.lit(")"))).otherwise(F.col("n_name"))
    subs = both.select(name.alias("name"), F.when(k == 3, F.concat(F.lit("Classes > "), "r_name")).alias("path"))
    stray = spark.createDataFrame([("stray", None)], "name string, path string")
    return details.class_list(r.where("r_regionkey < 4").select(F.col("r_name").alias("name")), subs.unionByName(stray))


@query(f"""WITH {ENTRIES_SQL}, {SOURCES_SQL}, c AS (SELECT source_key, count(*) AS n FROM entries GROUP BY 1), l AS (SELECT CASE WHEN kind IS NOT NULL THEN 'revision' WHEN priority < 10 THEN 'main' ELSE 'other' END AS bucket, coalesce(priority, 100) AS p, source_key, '- ' || source_key || ': ' || coalesce(n, 0) AS line FROM sources LEFT JOIN c USING (source_key))
SELECT bucket, string_agg(line, chr(10) ORDER BY p, source_key) AS lines FROM l GROUP BY bucket""")
def source_overview(spark, sf_dir):
    return details.source_lines(corpus.sources(spark, sf_dir), corpus.entries(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT id, CAST(row_number() OVER (PARTITION BY id % 50 ORDER BY CASE WHEN lang = 'de' THEN 0 ELSE 1 END, id) AS INTEGER) AS place FROM entries")
def german_first(spark, sf_dir):
    e = corpus.entries(spark, sf_dir).select((F.col("id") % 50).alias("query_id"), "id", F.col("id").alias("rank"), "lang")
    return details.german_first(e).select("id", "place")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'a [B] [X ' || p_name || '] c' WHEN p_size % 3 = 1 THEN 'a [B] c' ELSE '[X ' || p_name || '] only' END AS before, CASE WHEN p_size % 3 = 0 THEN 'a [X ' || p_name || '][B]  c' WHEN p_size % 3 = 1 THEN 'a [B] c' ELSE '[X ' || p_name || '] only' END AS moved,
CASE WHEN p_size % 2 = 0 THEN '### ' || p_name || chr(10) || 'text **bold** here' ELSE '**' || p_name || '.**' || chr(10) || 'x' END AS headed FROM part""".replace("'a [B] [X ' || p_name || '] c' WHEN", "'a [B][X ' || p_name || ']  c' WHEN"))
def moved_blocks(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    block = F.concat(F.lit("[X "), "p_name", F.lit("]"))
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("a [B] "), block, F.lit(" c"))).when(F.col("p_size") % 3 == 1, "a [B] c").otherwise(F.concat(block, F.lit(" only")))
    bold = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("**"), "p_name", F.lit("**\ntext **bold** here"))).otherwise(F.concat(F.lit("**"), "p_name", F.lit(".**\nx")))
    return p.select("p_partkey", repair.moved_block(text, r"\[X [^\]]*\]", r"\[B\]", before=False).alias("before"), repair.moved_block(text, r"\[X [^\]]*\]", r"\[B\]").alias("moved"), repair.bold_headings(bold).alias("headed"))


@query("""WITH n AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'old ' || p_size ELSE replace(p_name, ' ', '  ') END AS name, CASE p_size % 3 WHEN 1 THEN 'new ' || p_size ELSE p_name END AS repaired, CASE p_size % 3 WHEN 1 THEN 'curated' ELSE 'contents' END AS how FROM part)
SELECT name, repaired, how FROM n WHERE name <> repaired""")
def repaired_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    form = F.col("p_size") % 3
    names = p.select(F.when(form == 0, F.upper("p_name")).when(form == 1, F.concat(F.lit("old "), "p_size")).otherwise(F.replace("p_name", F.lit(" "), F.lit("  "))).alias("name"))
    curated = p.where(form == 1).select(F.concat(F.lit("old "), "p_size").alias("name"), F.concat(F.lit("new "), "p_size").alias("repaired"))
    return repair.repaired_names(names, p.select(F.col("p_name").alias("name")), curated)


@query("""SELECT p_partkey AS build_id, ability, CAST(value AS INTEGER) AS value, problem FROM part, LATERAL (VALUES ('str', p_size, NULL), ('dex', NULL, 'no number'), ('luck', 3, 'unknown'), ('con', 1, 'twice'), ('con', 2, 'twice')) t(ability, value, problem)""")
def ability_inputs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    row = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    rows = F.array(row(" Stärke ", F.col("p_size").cast("string")), row("DEX", F.lit("1.5")), row("luck", F.lit("3")), row("con", F.lit("1")), row("Kon", F.lit("2")))
    return rules.ability_inputs(p.select(F.col("p_partkey").alias("build_id"), F.inline(rows)))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'differs' ELSE 'none' END AS evidence FROM part")
def point_cost_evidence(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    body = F.when(F.col("p_size") % 3 < 2, F.concat(F.lit("Costs\n| score | cost |\n|---|---|\n| 8 | 0 |\n| 9 | 1 |\n| 10 | "), F.when(F.col("p_size") % 3 == 0, 2).otherwise(3), F.lit(" |\nend"))).otherwise("no table")
    return rules.costs_differ(p.select(F.col("p_partkey").alias("id"), body.alias("body")), {8: 0, 9: 1, 10: 2})


@query("""WITH l AS (SELECT user_id AS conv_id, max(ts) AS last FROM events GROUP BY 1) SELECT conv_id, last FROM l WHERE last > TIMESTAMP '2024-01-01 00:00:00' + (SELECT max(ts) - TIMESTAMP '2024-01-01 00:00:00' FROM events) - INTERVAL 48 HOUR ORDER BY last DESC, conv_id LIMIT 20""")
def live_conversations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    return sessions.live_conversations(e.select(F.col("user_id").alias("conv_id"), F.col("ts").alias("at")), F.lit(now), 48, 20)


@query("""WITH e AS (SELECT user_id % 50 AS ref, user_id, CASE WHEN event_type = 'error' THEN 'x' ELSE 'y' END AS kind, ts, event_id, event_type <> 'click' AS added FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY ref, kind, user_id ORDER BY ts DESC, event_id DESC) AS n FROM e)
SELECT ref, kind, count(*) AS users FROM n WHERE n = 1 AND added GROUP BY ALL""")
def standing_marks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mark = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), F.when(F.col("event_id") % 2 == 0, "️").otherwise("\U0001f3fd"))).otherwise("y")
    return sessions.still_marked(e.select((F.col("user_id") % 50).alias("ref"), "user_id", mark.alias("mark"), F.col("ts").alias("at"), "event_id", (F.col("event_type") != "click").alias("added")))


@query(f"""WITH {LOG_SQL}, r AS (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY asked_at DESC, id DESC) AS n, count(*) OVER (PARTITION BY path) AS c FROM log) SELECT path, id, greatest(c - 3, 0) AS rest FROM r WHERE n <= 3""")
def log_newest_with_rest(spark, sf_dir):
    return sessions.newest_with_rest(corpus.query_log(spark, sf_dir), "path", [F.desc("asked_at"), F.desc("id")], 3).select("path", "id", "rest")


@query(f"""WITH {GLOSSARY_SQL} SELECT row_id AS id, CASE WHEN row_id % 2 = 0 THEN 100.0 ELSE CASE WHEN {NORM.format('term')} = '' THEN 0.0 ELSE round(200.0 * length(term) / (2 * length(term) + 1), 4) END END AS score FROM glossary""")
def name_scores(spark, sf_dir):
    from ..functions.text import norm_term

    g = corpus.glossary(spark, sf_dir).repartition(corpus.TASKS * spark.sparkContext.defaultParallelism, "row_id")  # a small file, much work a row
    aims = F.array(F.when(F.col("row_id") % 2 == 0, norm_term(F.col("term"))).otherwise(F.concat(norm_term(F.col("term")), F.lit("ß"))), F.lit(""))
    return g.select(F.col("row_id").alias("id"), F.round(details.name_score(F.concat("term", F.when(F.col("row_id") % 2 == 0, " (x)").otherwise("")), aims), 4).alias("score"))
