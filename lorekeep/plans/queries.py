"""The registered queries over the operators, each with the DuckDB SQL of the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_term
from ..operators import align, etl, facets, glossary, logs, options, quality, repair, resolve, rules, sessions
from ..sources import corpus
from ..sources.corpus import ENTRIES_SQL, GLOSSARY_SQL, LOG_SQL, SOURCES_SQL, table
from ..streaming import gates
from .registry import NORM, ORACLE_SQL, QUERIES, query

_CANON = f"""canon AS (SELECT *, {NORM.format('term')} AS key, row_number() OVER (PARTITION BY {NORM.format('term')}
  ORDER BY official DESC, edition IS NULL, edition DESC NULLS LAST, origin IS NULL, target, row_id) AS n FROM glossary)"""


@query(f"WITH {GLOSSARY_SQL}, {_CANON} SELECT key, target, official, edition, origin, row_id FROM canon WHERE n = 1")
def glossary_canonical(spark, sf_dir):
    return glossary.canonical(corpus.glossary(spark, sf_dir)).select("key", "target", "official", "edition", "origin", "row_id")


@query(f"""WITH {GLOSSARY_SQL}, t AS (SELECT DISTINCT {NORM.format('term')} AS a, {NORM.format('target')} AS b FROM glossary),
edges AS (SELECT a, b FROM t WHERE a <> b UNION SELECT b, a FROM t WHERE a <> b), s AS (SELECT DISTINCT term, {NORM.format('term')} AS a FROM glossary),
one AS (SELECT term, s.a AS start, b AS alternative, 1 AS hop FROM s JOIN edges USING (a)),
two AS (SELECT term, start, e.b AS alternative, 2 AS hop FROM one JOIN edges e ON one.alternative = e.a),
l AS (SELECT term, alternative, min(hop) AS hop FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE alternative <> start GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY hop, alternative) AS n FROM l) SELECT term, alternative, hop FROM r WHERE n <= 8""")
def glossary_two_hops(spark, sf_dir):
    g = corpus.glossary(spark, sf_dir)
    return glossary.alternatives(g, g.select("term"))


@query(f"""WITH {ENTRIES_SQL}, terms AS (SELECT DISTINCT array_to_string(regexp_extract_all({NORM.format('text')}, '[\\p{{L}}\\p{{N}}]+')[1:3], ' ') AS term FROM benchmark),
b AS (SELECT id, ' ' || array_to_string(regexp_extract_all({NORM.format('body')}, '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS body FROM entries)
SELECT id, term FROM b JOIN terms ON contains(body, ' ' || term || ' ') WHERE length(term) >= 4""")
def term_spotting(spark, sf_dir):
    phrases = table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.regexp_extract_all(norm_term(F.col("text")), F.lit(r"([\p{L}\p{N}]+)")), 1, 3), " ").alias("term"))
    return glossary.spot(corpus.entries(spark, sf_dir), phrases)


def _revisions(spark, sf_dir):
    return corpus.sources(spark, sf_dir).where("kind is not null").select("source_key")


_CORE = "trim(regexp_replace({}, '\\s*\\([^()]*\\)\\s*$', ''))"


@query(f"""WITH {ENTRIES_SQL}, {SOURCES_SQL}, k AS (SELECT id, edition, category, {NORM.format('name')} AS key, source_key, name FROM entries),
g AS (SELECT e.id, e.source_key, e.name, CASE WHEN s.kind IS NULL AND key <> '' THEN min(CASE WHEN s.kind IS NULL THEN e.id END) OVER (PARTITION BY edition, category, key) ELSE e.id END AS group_id,
  coalesce(s.priority, 100) AS priority FROM k e JOIN sources s USING (source_key)),
b AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY priority, name, id) AS n, count(*) OVER (PARTITION BY group_id) AS members FROM g),
o AS (SELECT group_id, string_agg(DISTINCT g.source_key, ',' ORDER BY g.source_key) AS s FROM g JOIN b USING (group_id) WHERE b.n = 1 AND g.source_key <> b.source_key GROUP BY group_id)
SELECT b.group_id, b.id, b.name, b.members, coalesce(o.s, '') AS other_sources FROM b LEFT JOIN o USING (group_id) WHERE n = 1""")
def entity_groups(spark, sf_dir):
    e, s = corpus.entries(spark, sf_dir), corpus.sources(spark, sf_dir)
    return resolve.canonical_members(e, resolve.entity_groups(e, _revisions(spark, sf_dir)), s)


@query(f"""WITH {ENTRIES_SQL}, {SOURCES_SQL}, k AS (SELECT id, edition, {NORM.format('name')} AS key, kind FROM entries JOIN sources USING (source_key)),
m AS (SELECT b.id, r.id AS revision_id, row_number() OVER (PARTITION BY b.id ORDER BY r.id) AS place FROM k b JOIN k r USING (edition, key) WHERE b.kind IS NULL AND r.kind IS NOT NULL AND key <> '')
SELECT id, revision_id, CAST(place AS INTEGER) AS place FROM m WHERE place <= 3""")
def attached_revisions(spark, sf_dir):
    return resolve.attach_revisions(corpus.entries(spark, sf_dir), _revisions(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT {NORM.format('name')} AS key, count(DISTINCT category) AS categories FROM entries WHERE {NORM.format('name')} <> '' GROUP BY 1 HAVING count(DISTINCT category) > 1")
def ambiguous_names(spark, sf_dir):
    return resolve.ambiguous_names(corpus.entries(spark, sf_dir))


@query(f"""WITH {ENTRIES_SQL}, r AS (SELECT source_key, {NORM.format('name')} AS key, id, row_number() OVER (PARTITION BY source_key, {NORM.format('name')} ORDER BY length(body) DESC, id) AS n FROM entries)
SELECT source_key, key, id FROM r WHERE n = 1""")
def longest_sections(spark, sf_dir):
    return resolve.longest_sections(corpus.entries(spark, sf_dir))


def _sheets(spark, sf_dir):
    """Texts that state figures, made of line items: some right, some wrong, some without."""
    l = table(spark, sf_dir, "lineitem")
    q, p = F.col("l_quantity").cast("int"), F.col("l_partkey").cast("int")
    die = F.element_at(F.array(*map(F.lit, (4, 6, 7, 8, 10, 12))), p % 6 + 1)
    hp = F.floor(q * (die + 1) / 2) + p % 9 + F.when(p % 11 == 0, 5).otherwise(0)
    text = F.concat(F.lit("HP "), hp, F.lit(" ("), q, F.lit("d"), die, F.lit("+"), p % 9, F.lit(") STR "), p % 31, F.lit(" ("), F.when(F.floor((p % 31 - 10) / 2) >= 0, "+").otherwise(""), F.floor((p % 31 - 10) / 2) + F.when(p % 13 == 0, 1).otherwise(0), F.lit(") CR "), F.element_at(F.array(F.lit("0.25"), F.lit("1/2"), F.lit("3.0"), F.lit("12")), p % 4 + 1), F.lit(" 1,234.5"), p % 10, F.lit(" gp"))
    return l.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.when(p % 17 == 0, "nothing stated").otherwise(text).alias("body"))


_SHEETS = """x AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, CAST(l_quantity AS INTEGER) AS q, CAST(l_partkey AS INTEGER) AS p FROM lineitem),
y AS (SELECT *, [4, 6, 7, 8, 10, 12][p % 6 + 1] AS die, CAST(floor((p % 31 - 10) / 2.0) AS INTEGER) AS mod FROM x),
sheets AS (SELECT *, p % 17 = 0 AS none, CAST(floor(q * (die + 1) / 2.0) AS INTEGER) + p % 9 + CASE WHEN p % 11 = 0 THEN 5 ELSE 0 END AS hp, mod + CASE WHEN p % 13 = 0 THEN 1 ELSE 0 END AS said FROM y)"""


@query(f"""WITH {_SHEETS} SELECT id, CASE WHEN none THEN NULL ELSE abs(hp - (floor(q * (die + 1) / 2.0) + p % 9)) <= 1 END AS formula_ok, CASE WHEN none THEN NULL ELSE die IN (4, 6, 8, 10, 12, 20) END AS die_ok,
CASE WHEN none THEN NULL WHEN p % 31 = 0 THEN false WHEN mod >= 0 OR mod + CASE WHEN p % 13 = 0 THEN 1 ELSE 0 END < 0 THEN said = mod ELSE NULL END AS modifier_ok,
CASE WHEN none THEN NULL ELSE ['1/4', '1/2', '3', '12'][p % 4 + 1] END AS challenge, CASE WHEN none THEN NULL ELSE CAST(123450 + p % 10 AS BIGINT) END AS price_cents FROM sheets""")
def facet_parsing(spark, sf_dir):
    return facets.figures(facets.findings(_sheets(spark, sf_dir))).drop("body")


@query(f"WITH {_SHEETS} SELECT id FROM sheets WHERE NOT none AND p % 4 = 0")
def facet_prefilter(spark, sf_dir):
    rows = _sheets(spark, sf_dir)
    stored = rows.where(F.xxhash64("id") % 3 != 0).select("id", facets.challenge(F.col("body")).alias("challenge"))
    return facets.prefiltered(rows, stored, "challenge", "1/4", facets.challenge(F.col("body")) == "1/4").select("id")


@query("""WITH own AS (SELECT p_name AS name, p_brand AS source, count(DISTINCT p_size % 3) AS n, min(p_size % 3) AS low FROM part GROUP BY ALL),
v AS (SELECT a.name, a.source, min(b.low) AS lo, max(b.low) AS hi FROM own a JOIN own b ON a.name = b.name AND a.source <> b.source WHERE a.n > 1 AND b.n = 1 GROUP BY ALL)
SELECT own.name, own.source, CAST(own.n AS INTEGER) AS n_values, CASE WHEN own.n = 1 THEN own.low WHEN lo = hi AND EXISTS (SELECT 1 FROM part p WHERE p.p_name = own.name AND p.p_brand = own.source AND p.p_size % 3 = lo) THEN lo END AS settled
FROM own LEFT JOIN v ON own.name = v.name AND own.source = v.source""")
def sibling_reconciliation(spark, sf_dir):
    return facets.reconciled(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("source"), (F.col("p_size") % 3).alias("value")))


@query(f"""WITH {ENTRIES_SQL}, m AS (SELECT 'lines' AS metric, source_key, count(*) AS found FROM entries WHERE contains(body, chr(10)) GROUP BY ALL UNION ALL SELECT 'short', source_key, count(*) FROM entries WHERE length(body) < 300 GROUP BY ALL),
b AS (SELECT metric, source_key, found + (CASE length(source_key) WHEN 4 THEN 1 ELSE -1 END) AS expected FROM m WHERE source_key <> 'src3' UNION ALL SELECT 'lines', 'gone', 4),
j AS (SELECT coalesce(b.metric, m.metric) AS metric, coalesce(b.source_key, m.source_key) AS source_key, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found FROM b FULL JOIN m ON b.metric = m.metric AND b.source_key = m.source_key)
SELECT metric, source_key, expected, found, CASE WHEN found > expected THEN 'error' ELSE 'hint' END AS verdict FROM j WHERE found <> expected AND source_key IN (SELECT DISTINCT source_key FROM entries)""")
def baseline_regression(spark, sf_dir):
    e = corpus.entries(spark, sf_dir)
    kinds = F.array_compact(F.array(F.when(F.contains("body", F.lit("\n")), F.lit("lines")), F.when(F.length("body") < 300, F.lit("short"))))
    m = e.select("source_key", F.explode(kinds).alias("metric")).groupBy("metric", "source_key").agg(F.count("*").alias("found"))
    b = m.where("source_key <> 'src3'").select("metric", "source_key", (F.col("found") + F.when(F.length("source_key") == 4, 1).otherwise(-1)).alias("expected"))
    b = b.unionByName(spark.createDataFrame([("lines", "gone", 4)], "metric string, source_key string, expected long"))
    return quality.against_baseline(m, b, e.select("source_key").distinct())


@query(f"""WITH {ENTRIES_SQL} SELECT count(*) AS n, count(*) FILTER (name IS NULL OR trim(name) = '') AS unnamed, count(*) FILTER (body IS NULL OR trim(body) = '') AS empty,
count(*) FILTER (length(trim(body)) BETWEEN 1 AND 40) AS short, count(*) FILTER (body LIKE '%<br%' OR body LIKE '%&nbsp;%') AS residue, count(DISTINCT source_key) AS sources FROM entries""")
def full_check(spark, sf_dir):
    return quality.full_check(corpus.entries(spark, sf_dir))


@query(f"""WITH {ENTRIES_SQL}, r AS (SELECT id, CAST(floor(id / 4096.0) AS BIGINT) AS part, concat_ws(chr(31), CAST(id AS VARCHAR), source_key, edition, sha256(body)) AS r FROM entries)
SELECT part, count(*) AS n, sha256(string_agg(r, '' ORDER BY id)) AS digest FROM r GROUP BY part""")
def manifest_hash(spark, sf_dir):
    return quality.manifest(corpus.entries(spark, sf_dir))


@query(f"""WITH {GLOSSARY_SQL}, p AS (SELECT lower(term) AS term, edition, count(DISTINCT target) AS n FROM glossary GROUP BY ALL),
w AS (SELECT term, max(n) AS worst, count(*) AS editions FROM p GROUP BY term), t AS (SELECT lower(term) AS term, count(DISTINCT target) AS targets FROM glossary GROUP BY 1)
SELECT term, targets, editions, CASE WHEN worst = 1 THEN 'edition' ELSE 'real' END AS kind FROM t JOIN w USING (term) WHERE targets > 1""")
def term_conflicts(spark, sf_dir):
    return quality.term_conflicts(corpus.glossary(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT source_key, edition, category, count(*) AS n FROM entries GROUP BY GROUPING SETS ((source_key), (edition), (category))")
def status_counts(spark, sf_dir):
    return quality.counts_by(corpus.entries(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL}, {SOURCES_SQL} SELECT s.source_key, s.priority, count(e.id) AS n FROM sources s LEFT JOIN (SELECT * FROM entries WHERE lang = 'es') e USING (source_key) GROUP BY ALL")
def sources_with_counts(spark, sf_dir):
    e = corpus.entries(spark, sf_dir).where("lang = 'es'").groupBy("source_key").agg(F.count("*").alias("n"))
    return corpus.sources(spark, sf_dir).join(e, "source_key", "left").select("source_key", "priority", F.coalesce("n", F.lit(0)).alias("n"))


_SIDES = """l AS (SELECT p_partkey AS id, p_name AS name, p_brand, p_type, p_size, CAST(round(p_retailprice * 100) AS BIGINT) % 977 AS price FROM part WHERE p_partkey % 2 = 0),
r AS (SELECT p_partkey AS id, p_name AS name, p_brand, p_type, p_size, CAST(round(p_retailprice * 100) AS BIGINT) % 977 AS price FROM part WHERE p_partkey % 2 = 1)"""


def _sides(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_brand", "p_type", "p_size", (F.round(F.col("p_retailprice") * 100).cast("long") % 977).alias("price"))
    return p.where("id % 2 = 0"), p.where("id % 2 = 1")


@query(f"""WITH {_SIDES}, lu AS (SELECT p_brand, p_type, p_size, min(id) AS id FROM l GROUP BY ALL HAVING count(*) = 1), ru AS (SELECT p_brand, p_type, p_size, min(id) AS id FROM r GROUP BY ALL HAVING count(*) = 1),
f AS (SELECT lu.id AS left_id, ru.id AS right_id FROM lu JOIN ru USING (p_brand, p_type, p_size)),
l2 AS (SELECT p_brand, p_size, min(id) AS id FROM l WHERE id NOT IN (SELECT left_id FROM f) GROUP BY ALL HAVING count(*) = 1), r2 AS (SELECT p_brand, p_size, min(id) AS id FROM r WHERE id NOT IN (SELECT right_id FROM f) GROUP BY ALL HAVING count(*) = 1)
SELECT left_id, right_id, 1 AS stage FROM f UNION ALL SELECT l2.id, r2.id, 2 FROM l2 JOIN r2 USING (p_brand, p_size)""")
def fingerprint_pairs(spark, sf_dir):
    return align.staged_pairs(*_sides(spark, sf_dir), ["p_brand", "p_type", "p_size"], ["p_brand", "p_size"])


@query(f"""WITH {_SIDES}, s AS (SELECT DISTINCT l.price, l.name FROM l JOIN r USING (price, name)),
a AS (SELECT price, min(id) AS id FROM l WHERE (price, name) NOT IN (SELECT (price, name) FROM s) GROUP BY price HAVING count(*) = 1), b AS (SELECT price, min(id) AS id FROM r WHERE (price, name) NOT IN (SELECT (price, name) FROM s) GROUP BY price HAVING count(*) = 1)
SELECT a.id AS left_id, b.id AS right_id FROM a JOIN b USING (price)""")
def price_bucket_pairs(spark, sf_dir):
    return align.bucket_elimination(*_sides(spark, sf_dir), "price")


@query("""WITH c AS (SELECT CAST(l_partkey AS VARCHAR) AS term, l_returnflag AS candidate, count(*) AS votes FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS n, coalesce(lead(votes) OVER w, 0) AS nxt FROM c WINDOW w AS (PARTITION BY term ORDER BY votes DESC, candidate)) SELECT term, candidate, votes FROM r WHERE n = 1 AND votes >= 2 AND nxt * 2 < votes""")
def vocabulary_votes(spark, sf_dir):
    return align.majority(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("term"), F.col("l_returnflag").alias("candidate")), 2, 2)


@query(f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all({NORM.format('text')}, '[\\p{{L}}\\p{{N}}]+')) AS form FROM benchmark), s(s) AS (VALUES ('s'), ('e'), ('en'), ('n'), ('er'))
SELECT DISTINCT b.form AS base, f.form FROM t b JOIN t f ON true JOIN s ON f.form = b.form || s.s""")
def inflection_bridge(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(norm_term(F.col("text")), F.lit(r"([\p{L}\p{N}]+)"))).alias("term"))
    return align.inflections(words)


_FOLD = "lower(strip_accents(trim(replace(lower(target), 'ß', 'ss'))))"


@query(f"""WITH {GLOSSARY_SQL}, g AS (SELECT row_id, term, CASE WHEN row_id % 2 = 0 THEN 'groß' ELSE 'gross' END || term AS target, official FROM glossary), a AS (SELECT lower(term) AS k, count(DISTINCT {_FOLD}) AS folds, count(DISTINCT target) AS forms FROM g GROUP BY 1),
r AS (SELECT g.*, folds, forms, row_number() OVER (PARTITION BY lower(term) ORDER BY official DESC, target, row_id) AS n FROM g JOIN a ON k = lower(term)) SELECT row_id, term, target, CASE WHEN folds = 1 AND forms > 1 AND n > 1 THEN 0 ELSE official END AS official FROM r""")
def one_spelling(spark, sf_dir):
    g = corpus.glossary(spark, sf_dir).withColumn("target", F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("gro"), F.lit("ß"), "term")).otherwise(F.concat(F.lit("gross"), "term")))
    return align.one_spelling(g).select("row_id", "term", "target", "official")


_LETTERS = "array_to_string(list_sort(str_split(replace(lower({}), ' ', ''), '')), '')"


@query(f"""WITH k AS (SELECT {_LETTERS.format('p_name')} AS key, min(p_name) AS repaired FROM part GROUP BY 1 HAVING count(DISTINCT p_name) = 1), n AS (SELECT DISTINCT reverse(p_name) AS name FROM part WHERE reverse(p_name) NOT IN (SELECT p_name FROM part))
SELECT name, repaired FROM n JOIN k ON key = {_LETTERS.format('name')}""")
def anagram_repairs(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return align.anagram_repairs(n.select(F.reverse("name").alias("name")), n)


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '(?i)<br\\s*/?>', chr(10), 'g'), chr(160), ' ', 'g'), '[ \\t]+', ' ', 'g')) AS body FROM documents ")
def cleaned_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", etl.cleaned(F.col("text")).alias("body"))


_LINES = "x AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS text, generate_subscripts(str_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


@query(f"""WITH {_LINES}, s AS (SELECT *, CASE WHEN length(text) >= 40 OR pos = 0 THEN 1 ELSE 0 END AS st FROM x), i AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM s)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, string_agg(text, ' ' ORDER BY pos) AS text, count(*) AS parts FROM i GROUP BY doc_id, island""")
def merged_fragments(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return etl.merge_fragments(lines, 40)


@query()
def html_markdown(spark, sf_dir):
    return etl.html_to_markdown(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query()
def heading_chunks(spark, sf_dir):
    return etl.chunks(etl.html_to_markdown(table(spark, sf_dir, "pages").select("page_id", "html")), "page_id", "markdown")


@query(f"""WITH {SOURCES_SQL} SELECT source_key, CASE WHEN source_key IN ('src1', 'src2') THEN 99 ELSE priority END AS priority, CASE WHEN source_key = 'src1' THEN 'fresh' ELSE kind END AS kind FROM sources
UNION ALL SELECT 'new', 5, NULL""")
def upserted_sources(spark, sf_dir):
    new = spark.createDataFrame([("src1", 99, "fresh"), ("src2", 99, ""), ("new", 5, "")], "source_key string, priority int, kind string")
    return etl.upsert(corpus.sources(spark, sf_dir), new, ["source_key"], ("kind",))


@query(f"WITH {ENTRIES_SQL} SELECT id, source_key, name FROM entries WHERE source_key <> 'src1' UNION ALL SELECT id + 1000000, source_key, name FROM entries WHERE source_key = 'src1' AND id % 5 <> 0")
def replaced_source(spark, sf_dir):
    e = corpus.entries(spark, sf_dir).select("id", "source_key", "name")
    return etl.guarded_replace(e, e.where("source_key = 'src1' AND id % 5 <> 0").withColumn("id", F.col("id") + 1000000), "src1")


@query("""SELECT 'o' || o_orderkey AS id, concat_ws(' > ', r_name, n_name, c_name) AS breadcrumb FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def parent_chain(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    none = F.lit(None).cast("string")
    nodes = t("region").select(key("r", "r_regionkey").alias("id"), none.alias("parent_id"), F.col("r_name").alias("name"))
    nodes = nodes.unionByName(t("nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("name")))
    nodes = nodes.unionByName(t("customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("name")))
    nodes = nodes.unionByName(t("orders").select(key("o", "o_orderkey").alias("id"), key("c", "o_custkey").alias("parent_id"), none.alias("name")))
    return etl.parent_chain(nodes).where("id like 'o%'")


@query(f"""WITH {LOG_SQL}, s AS (SELECT duration_ms AS v, row_number() OVER (ORDER BY duration_ms) - 1 AS i, count(*) OVER () AS n FROM log WHERE duration_ms IS NOT NULL)
SELECT max(n) AS n, max(CASE WHEN i = least(n - 1, floor(0.5 * n)) THEN v END) AS p50, max(CASE WHEN i = least(n - 1, floor(0.95 * n)) THEN v END) AS p95 FROM s""")
def log_totals(spark, sf_dir):
    return logs.nearest_rank(corpus.query_log(spark, sf_dir), "duration_ms", {"p50": 0.5, "p95": 0.95})


@query(f"WITH {LOG_SQL}, s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS section, lower(term) AS term, count(*) AS n, max(asked_at) AS last, max(path) AS path FROM log WHERE {c} GROUP BY lower(term)" for k, c in logs.SECTIONS.items()) + "), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, term) AS r FROM s) SELECT section, term, n, last, path FROM r WHERE r <= 10")
def log_report(spark, sf_dir):
    return logs.report(corpus.query_log(spark, sf_dir))


@query(f"WITH {LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY asked_at DESC, id DESC) AS r FROM log) SELECT path, id, term, asked_at FROM r WHERE r <= 5")
def log_newest(spark, sf_dir):
    return quality.newest(corpus.query_log(spark, sf_dir), ["path"], [F.desc("asked_at"), F.desc("id")], 5).select("path", "id", "term", "asked_at")


@query(f"WITH {LOG_SQL} SELECT date_trunc('hour', asked_at) AS started, path, count(*) AS n, round(avg(duration_ms), 6) AS mean_ms FROM log GROUP BY ALL")
def log_windows(spark, sf_dir):
    return gates.windowed_log(corpus.query_log(spark, sf_dir))


@query("""WITH c AS (SELECT *, CASE WHEN role <> coalesce(lag(role) OVER w, '') THEN 1 ELSE 0 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c),
g AS (SELECT conv_id, island, role, string_agg(text, chr(10) ORDER BY turn) AS text FROM i GROUP BY ALL), n AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY island))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY island) AS INTEGER) AS pair, text AS question, answer FROM n WHERE role = 'user' AND nr = 'assistant'""")
def history_turns(spark, sf_dir):
    return sessions.turns(table(spark, sf_dir, "conversations"))


@query("""WITH a AS (SELECT conv_id, turn, row_number() OVER w AS age, sum(length(text)) OVER w AS chars_upto FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn, CAST(age AS INTEGER) AS age, CAST(chars_upto AS BIGINT) AS chars_upto FROM a WHERE age <= 12 AND chars_upto <= 2400""")
def history_budget(spark, sf_dir):
    return sessions.within_budget(table(spark, sf_dir, "conversations"), 12, 2400)


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY ALL""")
def user_sessions(spark, sf_dir):
    return sessions.sessions(table(spark, sf_dir, "events"), 7200)


@query("""WITH r AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error') SELECT event_id, user_id, recent FROM r WHERE recent >= 3""")
def lockouts(spark, sf_dir):
    return sessions.locked(table(spark, sf_dir, "events"), 3, 2 * 86400)


@query(f"""WITH {ENTRIES_SQL}, {SOURCES_SQL}, r AS (SELECT category, {NORM.format(_CORE.format('name'))} AS key, id, name, source_key, coalesce(priority, 100) AS priority FROM entries JOIN sources USING (source_key)),
o AS (SELECT *, row_number() OVER (PARTITION BY category, key ORDER BY priority, id) AS n FROM r WHERE key <> ''), s AS (SELECT category, key, string_agg(DISTINCT source_key, ',' ORDER BY source_key) AS sources FROM r GROUP BY ALL)
SELECT category, key, id AS lead_id, name, sources FROM o JOIN s USING (category, key) WHERE n = 1""")
def option_list(spark, sf_dir):
    return options.option_list(corpus.entries(spark, sf_dir), corpus.sources(spark, sf_dir))


@query(f"WITH {SOURCES_SQL} SELECT source_key, CASE WHEN kind IS NOT NULL THEN 'revision' WHEN priority < 10 THEN 'main' ELSE 'other' END AS bucket FROM sources")
def source_buckets(spark, sf_dir):
    return options.source_buckets(corpus.sources(spark, sf_dir))


_SECTIONS = """s AS (SELECT 'n' || n_nationkey AS id, r_name AS path, n_name AS name, 'about ' || n_name AS body FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, '', r_name, 'about ' || r_name FROM region)"""


@query(f"""WITH {_SECTIONS}, c AS (SELECT path AS parent, string_agg('## ' || name || chr(10) || body, chr(10) ORDER BY id) AS below FROM s WHERE path <> '' GROUP BY path)
SELECT id, path, name, concat_ws(chr(10), body, below) AS whole FROM s LEFT JOIN c ON (CASE WHEN path = '' THEN name ELSE path || ' > ' || name END) = parent""")
def sections_with_children(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    low = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("r_name").alias("path"), F.col("n_name").alias("name"), F.concat(F.lit("about "), "n_name").alias("body"))
    top = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("").alias("path"), F.col("r_name").alias("name"), F.concat(F.lit("about "), "r_name").alias("body"))
    return options.with_children(low.unionByName(top))


@query("""WITH u AS (SELECT p_name, count(*) AS n, min(p_partkey) AS id FROM (SELECT p_name || ' ' || p_partkey % 700 AS p_name, p_partkey FROM part) GROUP BY p_name HAVING count(*) = 1)
SELECT p_partkey AS id, u.id AS related_id FROM part JOIN u ON u.p_name = (SELECT q.p_name || ' ' || q.p_partkey % 700 FROM part q WHERE q.p_partkey = (part.p_partkey + 3) % (SELECT count(*) FROM part)) WHERE part.p_partkey <> u.id""")
def quoted_relations(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = p.count()
    named = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey") % 700).alias("name"))
    quoted = named.select(((F.col("id") - 3 + n) % n).alias("id"), F.concat(F.lit('Text. See also the entry "'), F.col("name"), F.lit('".')).alias("body"))
    return options.quoted_relations(named.join(quoted, "id"))


@query(f"""WITH x AS (SELECT p_partkey AS id, p_name FROM part) SELECT id, {NORM.format("p_name || ' a'")} AS key FROM x UNION SELECT id, {NORM.format("'B ' || p_name")} FROM x""")
def sub_headings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return options.sub_headings(p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("intro\n### "), "p_name", F.lit(" A \ntext\n**B "), "p_name", F.lit(".** more")).alias("body")))


@query("""SELECT p_partkey AS id, 1 AS "table", r AS row, c AS "column", CASE WHEN c = 'level' THEN CAST(r AS VARCHAR) ELSE CAST(p_size + r AS VARCHAR) END AS value FROM part, (VALUES (1), (2)) t(r), (VALUES ('level'), ('points')) k(c)""")
def table_cells(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    line = lambda r: F.concat(F.lit(f"\n| {r} | "), F.col("p_size") + r, F.lit(" |"))
    return options.table_cells(p.select("p_partkey", F.concat(F.lit("text\n| level | points |\n|---|---|"), line(1), line(2), F.lit("\nend")).alias("t")), "p_partkey", "t")


_RULES = [("hand size", "p_size", 1.0, 25.0), ("price", "p_retailprice", 0.0, 950.0), ("weight", "p_weight", 0.0, 9.0)]


@query("""WITH r(rule, field, low, high) AS (VALUES ('hand size', 's', 1, 25), ('price', 'p', 0, 950), ('weight', 'w', 0, 9)),
f AS (SELECT p_partkey AS build_id, rule, CASE field WHEN 'w' THEN 'not checkable' WHEN 's' THEN CASE WHEN p_size BETWEEN low AND high THEN 'ok' ELSE 'violation' END ELSE CASE WHEN p_retailprice BETWEEN low AND high THEN 'ok' ELSE 'violation' END END AS v FROM part, r)
SELECT build_id, CASE WHEN count(*) FILTER (v = 'violation') > 0 THEN 'violation' ELSE 'not checkable' END AS verdict, count(*) AS findings FROM f GROUP BY build_id""")
def build_verdicts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    values = p.select(F.col("p_partkey").alias("build_id"), F.explode(F.create_map(F.lit("p_size"), F.col("p_size").cast("double"), F.lit("p_retailprice"), F.col("p_retailprice"))).alias("field", "value"))
    return rules.verdicts(rules.build_findings(values, spark.createDataFrame(_RULES, "rule string, field string, low double, high double")))


@query(f"""WITH {GLOSSARY_SQL}, g AS (SELECT {NORM.format('term')} AS key, min(target) AS target FROM glossary WHERE official = 1 GROUP BY 1), t AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 3 = 0 THEN ' x' ELSE '' END AS text FROM part)
SELECT text, coalesce(target, CASE WHEN text LIKE 'red%' THEN 'cached' END, text || '*') AS translation, CASE WHEN target IS NOT NULL THEN 'glossary' WHEN text LIKE 'red%' THEN 'cache' ELSE 'open' END AS stage FROM t LEFT JOIN g ON g.key = {NORM.format('text')}""")
def staged_translation(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " x").otherwise("")).alias("text"))
    cache = texts.where("text like 'red%'").distinct().withColumn("translation", F.lit("cached"))
    return rules.translated(texts, corpus.glossary(spark, sf_dir).where("official = 1"), cache)


@query("""SELECT c_custkey AS doc_id, 'person.name' AS path, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'rest.c_mktsegment', c_mktsegment FROM customer""")
def mapped_fields(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("c_mktsegment"), F.col("c_mktsegment"))).alias("name", "value"))
    return rules.mapped_fields(c, spark.createDataFrame([("c_name", "person.name")], "name string, path string"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name || '’s' WHEN 1 THEN p_name || ' Vol. 1 (Ship Creatures)' WHEN 2 THEN '(2014)' ELSE p_name || ' (2014, ' || p_brand || ')' END AS title, CASE WHEN contains(lower(p_type), 'econ') THEN 'cheap' WHEN contains(lower(p_type), 'small') OR contains(lower(p_type), 'std') THEN 'plain' END AS category FROM part""")
def titles_and_categories(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    form = F.col("p_size") % 4
    raw = F.when(form == 0, F.concat("p_name", F.lit("'s  (2014) (D&D Beyond, PDF) "))).when(form == 1, F.concat("p_name", F.lit(" Vol. 1 (Ship Creatures) (deutsch)"))).when(form == 2, "(2014)").otherwise(F.concat("p_name", F.lit(" (2014, "), "p_brand", F.lit(")")))
    return p.select("p_partkey", rules.work_title(raw).alias("title"), rules.category_of(F.col("p_type"), {"cheap": ["econ"], "plain": ["small", "std"]}).alias("category"))


@query("""SELECT p_partkey AS id, '**Brand:** ' || p_brand || CASE WHEN p_size % 2 = 0 THEN chr(10) || '**Size:** ' || p_size ELSE '' END || chr(10) || chr(10) || p_name AS body FROM part""")
def record_markdown(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"), F.col("p_name").alias("description"))
    return rules.record_markdown(p, {"p_brand": "Brand", "size": "Size"})


@query("""SELECT event_type AS kind, user_id AS ref, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'""")
def feedback_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("event_type").alias("kind"), F.col("user_id").alias("ref"), "event_id", "ts")
    return quality.newest(e, ["kind", "ref"], [F.desc("ts"), F.desc("event_id")], 1)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a wonder fire wonder' WHEN p_partkey % 3 = 1 THEN 'a won- der of ' || p_name ELSE 'fine ' || p_name END AS repaired FROM part""")
def repaired_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    body = F.when(F.col("p_partkey") % 3 == 0, "a won- der \ufb01re wonder").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a won- der of "), "p_name")).otherwise(F.concat(F.lit("\ufb01ne "), "p_name"))
    return repair.repair_texts(p.select("p_partkey", body.alias("body"))).select("p_partkey", "repaired")


@query()
def split_answers(spark, sf_dir):
    """Conversation texts in parts of at most 400 characters: ``conv_id, turn, part, text``."""

    @F.udf("array<string>", useArrow=True)
    def parts(text):
        return etl.split_text(text, 400)

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(parts("text")).alias("part", "text"))


@query(f"""WITH {GLOSSARY_SQL}, x AS (SELECT term || ' ' || row_id % 50 AS term, target, official FROM glossary), g AS (SELECT {NORM.format('term')} AS key, min(target) AS target, count(DISTINCT target) AS n, max(official) AS official FROM x GROUP BY 1)
SELECT p_partkey AS id, CASE WHEN n = 1 THEN target || CASE WHEN official = 1 THEN '' ELSE '*' END || ' (' || p_name || ' ' || p_size || ')' ELSE p_name || ' ' || p_size END AS shown
FROM part LEFT JOIN g ON g.key = {NORM.format("p_name || ' ' || p_size")}""")
def display_names(spark, sf_dir):
    g = corpus.glossary(spark, sf_dir).withColumn("term", F.concat_ws(" ", "term", F.col("row_id") % 50))
    return rules.display_names(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_size").alias("name")), g)


@query(f"""WITH {GLOSSARY_SQL}, c AS (SELECT DISTINCT {NORM.format('term')} AS key, target FROM glossary WHERE row_id < 40)
SELECT row_id, CASE WHEN {NORM.format('term')} IN (SELECT key FROM c) AND NOT EXISTS (SELECT 1 FROM c WHERE c.key = {NORM.format('g.term')} AND c.target = g.target) THEN 0 ELSE official END AS official FROM glossary g""")
def curated_first(spark, sf_dir):
    g = corpus.glossary(spark, sf_dir)
    return rules.curated_first(g, g.where("row_id < 40").select("term", "target")).select("row_id", "official")


@query("""WITH d AS (SELECT p_type AS category, p_name AS name, p_partkey AS place, p_brand AS body FROM part WHERE p_size < 10), f AS (SELECT *, row_number() OVER (PARTITION BY category, name ORDER BY place) AS n FROM d)
SELECT p_partkey AS id, p_type AS category, p_name AS name, body AS detail FROM part LEFT JOIN f ON n = 1 AND category = p_type AND name = p_name""")
def merged_details(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    details = p.where("p_size < 10").select(F.col("p_type").alias("category"), F.col("p_name").alias("name"), F.col("p_partkey").alias("place"), F.col("p_brand").alias("body"))
    return rules.merged_details(p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_name").alias("name")), details)


@query(f"""WITH q AS (SELECT DISTINCT left(p_name, 4 + p_partkey % 9) AS asked FROM part), k AS (SELECT asked, {NORM.format('asked')} AS key FROM q), n AS (SELECT {NORM.format('p_name')} AS name, min(p_partkey) AS id FROM part GROUP BY 1),
m AS (SELECT asked, min(CASE WHEN name = key THEN id END) AS exact, min(id) AS one_id, count(id) AS n FROM k LEFT JOIN n ON starts_with(name, key) GROUP BY asked)
SELECT asked, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'prefix' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS how, coalesce(exact, CASE WHEN n = 1 THEN one_id END) AS id FROM m""")
def chosen_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return rules.chosen_candidates(p.select(F.expr("left(p_name, 4 + p_partkey % 9)").alias("asked")), p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("""WITH l AS (SELECT DISTINCT p_brand AS g, p_size % 10 AS v, p_name AS n FROM part WHERE p_partkey % 2 = 0), r AS (SELECT DISTINCT p_brand AS g, p_size % 10 AS v, p_name AS n FROM part WHERE p_partkey % 2 = 1),
e AS (SELECT g, v FROM (SELECT g, v, count(*) AS a FROM l GROUP BY ALL) JOIN (SELECT g, v, count(*) AS b FROM r GROUP BY ALL) USING (g, v) WHERE a = b),
p AS (SELECT g, v, l.n AS n FROM l JOIN r USING (g, v, n) JOIN e USING (g, v)),
a AS (SELECT g, v, min(n) AS x FROM l JOIN e USING (g, v) WHERE (g, v, n) NOT IN (SELECT (g, v, n) FROM p) GROUP BY ALL HAVING count(*) = 1), b AS (SELECT g, v, min(n) AS y FROM r JOIN e USING (g, v) WHERE (g, v, n) NOT IN (SELECT (g, v, n) FROM p) GROUP BY ALL HAVING count(*) = 1)
SELECT g AS "group", v AS level, n AS "left", n AS "right" FROM p UNION ALL SELECT g, v, x, y FROM a JOIN b USING (g, v)""")
def level_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("group"), (F.col("p_size") % 10).alias("level"), F.col("p_name").alias("name"))
    return rules.level_pairs(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), p.select(F.col("name").alias("left"), F.col("name").alias("right")).distinct())


@query("""SELECT n_name AS tool, count(*) AS calls, CAST(sum(o_custkey) AS BIGINT) AS input_tokens, CAST(sum(o_custkey % 10) AS BIGINT) AS cached_tokens, round(sum(o_custkey % 10) * 1.0 / nullif(sum(o_custkey), 0), 6) AS hit_ratio FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def usage_ratios(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    cached, tokens = F.sum(F.col("o_custkey") % 10), F.sum("o_custkey")
    return rows.groupBy(F.col("n_name").alias("tool")).agg(F.count("*").alias("calls"), tokens.alias("input_tokens"), cached.alias("cached_tokens"), F.round(cached / F.nullif(tokens, F.lit(0)), 6).alias("hit_ratio"))


from . import detail_queries, entry_queries, facet_queries, measure_queries, search_queries  # noqa: E402, F401  they register their queries
from . import state_queries, structure_queries, text_queries, version_queries  # noqa: E402, F401
from .search_queries import fts_search  # noqa: E402, F401
