"""Registered queries over groups in order, torn layouts, rules that need rules, nested records and typed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents, etl, grouping, layout, records, resolve, rules
from ..sources.corpus import dealt, table
from .registry import query

_VARIANTS = """e AS (SELECT p_type AS category, p_partkey AS id, row_number() OVER (ORDER BY p_size, p_partkey) AS r, unnest([p_name || ' ' || p_brand, p_name || ' ' || p_size % 10]) AS v FROM part)"""


@query(f"""WITH RECURSIVE {_VARIANTS}, links AS (SELECT DISTINCT b.r AS r, a.r AS earlier FROM e a JOIN e b USING (category, v) WHERE a.r < b.r),
reach AS (SELECT r, earlier FROM links UNION SELECT reach.r, links.earlier FROM reach JOIN links ON links.r = reach.earlier), lead AS (SELECT r, min(earlier) AS l FROM reach GROUP BY r), one AS (SELECT DISTINCT category, id, r FROM e)
SELECT one.category, one.id, coalesce(f.id, one.id) AS lead_id FROM one LEFT JOIN lead USING (r) LEFT JOIN one f ON f.r = lead.l""")
def greedy_groups(spark, sf_dir):
    """Parts by name with brand and name with size: many fit two groups and join the first."""
    variants = F.array(F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" ", "p_name", F.col("p_size") % 10))
    return grouping.greedy_groups(table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), F.col("p_partkey").alias("id"), F.col("p_size").alias("priority"), variants.alias("variants")))


def _sheets(spark, sf_dir):
    """``doc, k`` and the five parts of an entry: every order is a document, its lines are entries in order."""
    line = dealt(spark, sf_dir, "lineitem", "l_orderkey")
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return line.groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(one)).alias("s"))  # an order holds few lines


_SHEETS = """l AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n,
'#### Item ' || l_partkey || chr(10) || chr(10) AS h, '_Small thing ' || l_suppkey || ', plain_' || chr(10) || chr(10) AS t, '**AC** ' || l_linenumber || chr(10) || chr(10) AS b, 'Rest of ' || l_partkey || '.' || chr(10) || chr(10) AS x FROM lineitem)"""


def _entry(i):
    """Heading, line of kind, block and rest of an order's i-th entry (from 0)."""
    e = F.get("s", F.lit(i))
    text = lambda before, c, after: F.concat(F.lit(before), e[c].cast("string"), F.lit(after + "\n\n"))
    return text("#### Item ", "l_partkey", ""), text("_Small thing ", "l_suppkey", ", plain_"), text("**AC** ", "l_linenumber", ""), text("Rest of ", "l_partkey", ".")


@query(rf"""WITH {_SHEETS}, o AS (SELECT *, CASE WHEN n >= 4 AND doc % 5 = 1 THEN 1 WHEN n >= 3 AND doc % 5 IN (0, 3) THEN 0 WHEN n >= 3 AND doc % 5 = 2 THEN 2 END AS form FROM l),
p AS (SELECT doc, form, h || CASE WHEN form = 2 AND k = 2 THEN '' ELSE t || b END || CASE WHEN form = 2 AND k < 4 THEN CASE k WHEN 1 THEN '' WHEN 2 THEN lag(x) OVER w ELSE x || lag(t) OVER w || lag(b) OVER w || lag(x) OVER w || '_Small thing more, plain_' || chr(10) || chr(10) || '**AC** 0' || chr(10) || chr(10) END ELSE x END AS piece,
CASE WHEN form = 0 AND k = 2 THEN 3.5 WHEN form = 1 AND k = 2 THEN 4.5 ELSE k END AS place FROM o WINDOW w AS (PARTITION BY doc ORDER BY k))
SELECT doc AS id, string_agg(piece, '' ORDER BY place) AS text, max(CASE WHEN form IN (0, 1) THEN 1 ELSE 0 END) AS moved FROM p GROUP BY doc""")
def paired_blocks(spark, sf_dir):
    """Orders as documents; in most the second entry's heading stands before the rest of the first and its block in a later entry. Documents whose later entry has three blocks stay."""
    (h1, t1, b1, x1), (h2, t2, b2, x2), (h3, t3, b3, x3), (h4, t4, b4, x4) = map(_entry, range(4))
    near = F.concat(h1, t1, b1, h2, x1, h3, t3, b3, x3, t2, b2, x2)
    far = F.concat(h1, t1, b1, h2, x1, h3, t3, b3, x3, h4, t4, b4, x4, t2, b2, x2)
    odd = F.concat(h1, t1, b1, h2, x1, h3, t3, b3, x3, t2, b2, x2, F.lit("_Small thing more, plain_\n\n**AC** 0\n\n"))
    kept = F.concat(h1, t1, b1, h2, t2, x1, h3, t3, b3, x3, b2, x2)  # the heading kept its line of kind
    form, n = F.col("doc") % 5, F.size("s")
    torn = F.when((n >= 4) & (form == 1), F.struct(far.alias("t"), F.lit(4).alias("n"))).when((n >= 3) & (form == 0), F.struct(near.alias("t"), F.lit(3).alias("n"))).when((n >= 3) & (form == 3), F.struct(kept.alias("t"), F.lit(3).alias("n"))).when((n >= 3) & (form == 2), F.struct(odd.alias("t"), F.lit(3).alias("n"))).otherwise(F.struct(F.lit("").alias("t"), F.lit(0).alias("n")))
    c = lambda e, name, before, after: F.concat(F.lit(before), e[name].cast("string"), F.lit(after + "\n\n"))
    plain = F.transform("s", lambda e: F.concat(c(e, "l_partkey", "#### Item ", ""), c(e, "l_suppkey", "_Small thing ", ", plain_"), c(e, "l_linenumber", "**AC** ", ""), c(e, "l_partkey", "Rest of ", ".")))
    docs = _sheets(spark, sf_dir).withColumn("torn", torn).select("doc", F.concat("torn.t", F.array_join(F.slice(plain, F.col("torn.n") + 1, F.greatest(n - F.col("torn.n"), F.lit(0))), "")).alias("text"))
    return layout.paired_blocks(docs, "doc", "text", r"\*\*AC\*\*")


@query(r"""WITH n AS (SELECT n_nationkey AS k, r_name, n_name, count(c_custkey) AS cs FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
c AS (SELECT c_custkey AS id, c_nationkey % 4 AS form, '### ' || n_name || 's' || chr(10) || chr(10) AS h, '#### ' || c_name || chr(10) || chr(10) || '**AC** ' || c_custkey || chr(10) || chr(10) AS e, '### Intro' || chr(10) || chr(10) || 'A heading of rules may well have some text of its own.' || chr(10) || chr(10) || '#### Rule' || chr(10) || chr(10) || 'x' || chr(10) || chr(10) AS intro FROM customer JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT id, form, h, e, intro, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS n FROM c JOIN customer ON id = c_custkey)
SELECT id, intro || CASE WHEN form = 3 THEN '' ELSE '# Beings' || chr(10) || chr(10) END || '#### First' || chr(10) || chr(10) || CASE form WHEN 0 THEN h || e || 'The ' || n || ' is proof against most of it.' || chr(10) || chr(10) WHEN 1 THEN 'Another has the rest of its text below here.' || chr(10) || chr(10) || h || e WHEN 2 THEN h || 'Short.' || chr(10) || chr(10) || e ELSE h || 'Another has the rest of its text below here.' || chr(10) || chr(10) || e END || '#### Last' || chr(10) AS text,
CASE WHEN form = 0 THEN 1 ELSE 0 END AS own, CASE WHEN form = 1 THEN 1 ELSE 0 END AS others FROM t""")
def family_headings(spark, sf_dir):
    """Customers as documents: the family's heading above its own rest, above another's, above short text, and outside of the chapter."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    form = F.col("c_nationkey") % 4
    block = F.when(form == 0, F.concat(F.lit("The "), "n_name", F.lit(" is proof against most of it."))).when(form == 2, "Short.").otherwise("Another has the rest of its text below here.")
    head = F.lit("### Intro\n\nA heading of rules may well have some text of its own.\n\n#### Rule\n\nx\n\n")
    text = F.concat(head, F.when(form == 3, "").otherwise("# Beings\n\n"), F.lit("#### First\n\n### "), "n_name", F.lit("s\n\n"), block, F.lit("\n\n#### "), "c_name", F.lit("\n\n**AC** "), F.col("c_custkey").cast("string"), F.lit("\n\n#### Last\n"))
    return layout.family_headings(c.select(F.col("c_custkey").alias("id"), text.alias("text")), "id", "text", r"\*\*AC\*\*", "# Beings")


#: rule, kind, fields, low, high, needs, required
_RULES = [
    ("size", "range", ["size"], 1, 45, [], True), ("price", "range", ["price"], 0, 1800, ["size"], False), ("budget", "sum", ["size", "price", "tax"], 0, 1500, ["price"], False),
    ("extras", "count", ["extra", "tax", "gift"], 0, 2, [], False), ("gifts", "together", ["gift", "extra"], 0, 0, ["extras"], False), ("whole", "range", ["size", "tax"], 0, 40, ["budget", "gifts"], False),
]

_BUILDS = """b AS (SELECT p_partkey AS build_id, CASE WHEN p_partkey % 11 <> 3 THEN CAST(p_size AS DOUBLE) END AS size, CASE WHEN p_partkey % 7 <> 2 THEN p_retailprice END AS price, CASE WHEN p_partkey % 5 <> 1 THEN CAST(p_partkey % 50 AS DOUBLE) END AS tax,
CASE WHEN p_partkey % 3 = 0 THEN 1.0 END AS extra, CASE WHEN p_partkey % 2 = 0 THEN 1.0 END AS gift FROM part)"""

_FINDINGS = f"""{_BUILDS}, needs(rule, need) AS (VALUES ('price', 'size'), ('budget', 'price'), ('gifts', 'extras'), ('whole', 'budget'), ('whole', 'gifts')),
up AS (SELECT rule, need FROM needs UNION SELECT up.rule, needs.need FROM up JOIN needs ON needs.rule = up.need),
x AS (SELECT *, CAST((extra IS NOT NULL)::INT + (tax IS NOT NULL)::INT + (gift IS NOT NULL)::INT AS DOUBLE) AS n, CAST((extra IS NOT NULL)::INT + (gift IS NOT NULL)::INT AS DOUBLE) AS m FROM b),
own AS (SELECT build_id, 'size' AS rule, CASE WHEN size IS NULL THEN 'missing' WHEN size BETWEEN 1 AND 45 THEN 'ok' ELSE 'violation' END AS v, size AS value FROM x
UNION ALL SELECT build_id, 'price', CASE WHEN price IS NULL THEN 'not checkable' WHEN price BETWEEN 0 AND 1800 THEN 'ok' ELSE 'violation' END, price FROM x
UNION ALL SELECT build_id, 'budget', CASE WHEN size + price + tax IS NULL THEN 'not checkable' WHEN size + price + tax BETWEEN 0 AND 1500 THEN 'ok' ELSE 'violation' END, size + price + tax FROM x
UNION ALL SELECT build_id, 'extras', CASE WHEN n BETWEEN 0 AND 2 THEN 'ok' ELSE 'violation' END, n FROM x UNION ALL SELECT build_id, 'gifts', CASE WHEN m <> 1 THEN 'ok' ELSE 'violation' END, m FROM x
UNION ALL SELECT build_id, 'whole', CASE WHEN size + tax IS NULL THEN 'not checkable' WHEN greatest(size, tax) <= 40 THEN 'ok' ELSE 'violation' END, CASE WHEN size + tax IS NOT NULL THEN least(size, tax) END FROM x),
shut AS (SELECT DISTINCT up.rule, o.build_id FROM up JOIN own o ON o.rule = up.need WHERE o.v <> 'ok'),
f AS (SELECT own.build_id, own.rule, CASE WHEN shut.rule IS NOT NULL THEN 'not checkable' ELSE v END AS verdict, CASE WHEN shut.rule IS NULL THEN value END AS value FROM own LEFT JOIN shut ON shut.rule = own.rule AND shut.build_id = own.build_id)"""


def _findings(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    fields = {"size": F.when(k % 11 != 3, F.col("p_size").cast("double")), "price": F.when(k % 7 != 2, F.col("p_retailprice")), "tax": F.when(k % 5 != 1, (k % 50).cast("double")), "extra": F.when(k % 3 == 0, 1.0), "gift": F.when(k % 2 == 0, 1.0)}
    builds = p.select(k.alias("build_id"), F.explode(F.create_map(*[x for name, c in fields.items() for x in (F.lit(name), c)])).alias("field", "value"))
    return rules.ranked_findings(builds, spark.createDataFrame(_RULES, "rule string, kind string, fields array<string>, low int, high int, needs array<string>, required boolean"))


@query(f"WITH RECURSIVE {_FINDINGS} SELECT * FROM f")
def ranked_findings(spark, sf_dir):
    """Parts as builds with missing values, checked by rules of four kinds that need one another."""
    return _findings(spark, sf_dir).drop("cause")


@query(f"""WITH RECURSIVE {_FINDINGS}, c AS (SELECT build_id, count(*) FILTER (verdict = 'violation') AS violations, count(*) FILTER (verdict = 'missing') AS missing, count(*) FILTER (verdict = 'not checkable') AS open FROM f GROUP BY build_id)
SELECT *, CASE WHEN violations > 0 THEN 'violations' WHEN missing > 0 THEN 'incomplete' WHEN open > 0 THEN 'none found' ELSE 'legal as far as checkable' END AS verdict FROM c""")
def overall_verdicts(spark, sf_dir):
    return rules.overall_verdicts(_findings(spark, sf_dir))


#: kind, place, label, path, form, unit
_FORMATS = [
    ("spell", 1, "Level", "$.level", "value", None), ("spell", 2, "Ritual", "$.ritual", "flag", None), ("spell", 3, "Classes", "$.classes", "list", None), ("spell", 4, "Higher levels", "$.higher", "paragraphs", None),
    ("creature", 1, "Speed", "$.speed", "pairs", " ft."), ("creature", 2, "Actions", "$.actions", "paragraphs", None), ("weapon", 1, "Damage", "$.damage.dice", "value", None), ("weapon", 2, "Properties", "$.properties", "list", None),
    ("armour", 1, "Class", "$.ac.base", "value", " AC"), ("armour", 2, "Stealth disadvantage", "$.stealth", "flag", None), ("item", 1, "Weight", "$.weight", "value", " lb."), ("feat", 1, "Benefits", "$.benefits", "paragraphs", None),
    ("background", 1, "Skills", "$.skills", "list", None), ("species", 1, "Traits", "$.traits", "paragraphs", None), ("species", 2, "Speed", "$.speed", "pairs", " ft."),
]


@query(r"""SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'spell' WHEN 1 THEN 'creature' WHEN 2 THEN 'weapon' WHEN 3 THEN 'armour' WHEN 4 THEN 'item' WHEN 5 THEN 'feat' WHEN 6 THEN 'background' WHEN 7 THEN 'species' ELSE 'map' END AS kind,
CASE p_partkey % 9 WHEN 0 THEN '**Level:** ' || p_size || CASE WHEN p_size % 2 = 0 THEN chr(10) || '**Ritual**' ELSE '' END || chr(10) || '**Classes:** ' || p_brand || ', ' || p_type || CASE WHEN p_size % 3 = 0 THEN chr(10) || chr(10) || '## Higher levels' || chr(10) || chr(10) || p_name ELSE '' END
WHEN 1 THEN CASE p_size % 3 WHEN 0 THEN '**Speed:** fly ' || p_size + 10 || ' ft., walk ' || p_size || ' ft.' || chr(10) WHEN 1 THEN '**Speed:** ' || p_size || ' ft.' || chr(10) ELSE '' END || CASE p_size % 3 WHEN 2 THEN '' ELSE chr(10) END || '## Actions' || chr(10) || chr(10) || '***Bite.*** ' || p_name || chr(10) || chr(10) || '***Claw.***'
WHEN 2 THEN '**Damage:** ' || p_size || 'd6' || CASE WHEN p_size % 2 = 0 THEN chr(10) || '**Properties:** ' || p_type || ', light' ELSE '' END WHEN 3 THEN '**Class:** ' || p_size || ' AC' || CASE WHEN p_size % 2 = 1 THEN chr(10) || '**Stealth disadvantage**' ELSE '' END
WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN '**Weight:** ' || p_size || ' lb.' ELSE '' END WHEN 5 THEN '## Benefits' || chr(10) || chr(10) || p_name || chr(10) || chr(10) || '***More.*** ' || p_brand WHEN 6 THEN '**Skills:** ' || p_name
WHEN 7 THEN CASE WHEN p_size % 5 = 0 THEN '' ELSE '## Traits' || chr(10) || chr(10) || '***Sight.*** ' || p_type || chr(10) || '**Speed:** walk ' || p_size || ' ft.' END ELSE '' END AS body,
CASE WHEN p_partkey % 9 = 7 AND p_size % 5 = 0 THEN 'unreadable' WHEN p_partkey % 9 = 8 THEN 'unknown kind' END AS problem FROM part""")
def formatted_records(spark, sf_dir):
    """Records of eight kinds with keys that vary, nulls, text in place of objects and lists, broken JSON and an unknown kind."""
    p = table(spark, sf_dir, "part")
    forms = [
        """'{"level": {size}, "ritual": ' || (p_size % 2 = 0) || ', "classes": ["{brand}", {"name": "{type}"}, null, ""], "higher": ' || if(p_size % 3 = 0, '"{name}"', 'null') || '}'""",
        """'{"actions": [{"name": "Bite", "desc": "{name}"}, {"name": "Claw"}], "speed": ' || CASE p_size % 3 WHEN 0 THEN '{"walk": {size}, "fly": ' || (p_size + 10) || ', "swim": null}' WHEN 1 THEN '{size}' ELSE '{}' END || '}'""",
        """'{"damage": {"dice": "{size}d6"}' || if(p_size % 2 = 0, ', "properties": [{"name": "{type}", "more": [1]}, "light"]}', '}')""",
        """'{"ac": {"base": {size}}, "stealth": ' || (p_size % 2 = 1) || '}'""", """'{' || if(p_size % 2 = 0, '"weight": {size}', '"weight": [1], "other": 2') || '}'""",
        """'{"benefits": ["{name}", {"name": "More", "desc": "{brand}"}]}'""", """'{"skills": "{name}"}'""", """'{"traits": [{"name": "Sight", "desc": "{type}"}], "speed": {"walk": {size}}' || if(p_size % 5 = 0, '', '}')""", "'{}'",
    ]
    record = F.expr("CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END")
    for name, c in {"size": "p_size", "brand": "p_brand", "type": "p_type", "name": "p_name"}.items():
        record = F.replace(record, F.lit("{" + name + "}"), F.col(c).cast("string"))
    kind = F.get(F.array(*map(F.lit, "spell creature weapon armour item feat background species map".split())), (F.col("p_partkey") % 9).cast("int"))
    formats = spark.createDataFrame(_FORMATS, "kind string, place int, label string, path string, form string, unit string")
    return records.formatted_records(p.select(F.col("p_partkey").alias("id"), kind.alias("kind"), record.alias("record")), formats)


@query(r"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'Attack Advantage. ' ELSE '' END || text || CASE WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 3 = 1 THEN ' Done.' ELSE ' ' END AS v FROM conversations),
f AS (SELECT *, lag(v) OVER (PARTITION BY conv_id ORDER BY turn, v) AS p FROM c WHERE v <> ''),
g AS (SELECT conv_id, turn, v, CASE WHEN p IS NULL OR regexp_matches(p, '\s$') OR regexp_matches(v, '^\s') THEN '' WHEN regexp_matches(p, '[.!?]$') AND regexp_matches(v, '^[A-Z][^.!?:\n]{1,42}\.\s')
AND NOT regexp_matches(v, '^(You |Your|The |This |That |If |When|While |Once |As |At |On |In |To |For |A |An |It |They |Each |Whenever |Immediately |After |Before |Choose )') THEN chr(10) || chr(10) ELSE ' ' END AS gap FROM f)
SELECT conv_id AS doc_id, 'features' AS path, string_agg(gap || v, '' ORDER BY turn, v) AS text FROM g GROUP BY conv_id""")
def joined_fragments(spark, sf_dir):
    """Turns of a conversation as fragments of one text; ends and beginnings of three kinds are planted."""
    c = table(spark, sf_dir, "conversations")
    value = F.concat(F.when(F.col("turn") % 2 == 1, "Attack Advantage. ").otherwise(""), "text", F.when(F.col("conv_id") % 3 == 0, "").when(F.col("conv_id") % 3 == 1, " Done.").otherwise(" "))
    name = F.concat(F.lit("Features"), "turn")
    fields = c.select(name.alias("name"), F.lit("features").alias("path"), F.lit("text").alias("form"), F.col("turn").alias("place")).distinct()
    return documents.typed_fields(c.select(F.col("conv_id").alias("doc_id"), name.alias("name"), value.alias("value")), fields).select("doc_id", "path", "text")


_FIELDS = [("Level", "level", "whole", 1), ("Gold", "purse.gold", "number", 1), ("Inspired", "inspired", "flag", 1), ("Tongues", "tongues", "list", 1)]


@query(r"""WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment AS seg, c_acctbal AS gold FROM customer)
SELECT k AS doc_id, CASE WHEN k % 7 = 3 THEN 'rest.Level' ELSE 'level' END AS path, CASE WHEN k % 7 = 3 THEN 'rest' ELSE 'whole' END AS form, CASE WHEN k % 7 = 3 THEN 'about ' || k END AS text, CASE WHEN k % 7 <> 3 THEN 1000 + k % 9000 END AS whole, CAST(NULL AS DOUBLE) AS number, CAST(NULL AS BOOLEAN) AS flag, NULL AS items, 'Level' AS names FROM c
UNION ALL SELECT k, 'purse.gold', 'number', NULL, NULL, CAST(k AS DOUBLE) + 0.5, NULL, NULL, 'Gold' FROM c
UNION ALL SELECT k, CASE WHEN k % 5 = 4 THEN 'rest.Inspired' ELSE 'inspired' END, CASE WHEN k % 5 = 4 THEN 'rest' ELSE 'flag' END, CASE WHEN k % 5 = 4 THEN 'perhaps' END, NULL, NULL, CASE k % 5 WHEN 4 THEN NULL ELSE k % 5 < 2 END, NULL, 'Inspired' FROM c
UNION ALL SELECT k, 'tongues', 'list', NULL, NULL, NULL, NULL, seg || '|' || c_name, 'Tongues' FROM c UNION ALL SELECT k, 'rest.Odd', 'rest', CASE WHEN k % 2 = 0 THEN seg END, NULL, NULL, NULL, NULL, 'Odd' FROM c""")
def typed_fields(spark, sf_dir):
    """Cells of customers by four types, with some that don't read as their type and one that no map names."""
    k = F.col("c_custkey")
    level = F.when(k % 7 == 3, F.concat(F.lit("about "), k)).otherwise(F.format_number(1000 + k % 9000, 0))
    flag = F.get(F.array(*map(F.lit, ("Yes", "•", "no", "Off", "perhaps"))), (k % 5).cast("int"))
    cells = {"Level": level, "Gold": F.concat(F.lit(" +"), k.cast("string"), F.lit(".50 ")), "Inspired": flag, "Tongues": F.concat("c_mktsegment", F.lit(" ;, "), "c_name", F.lit("\n")), "Odd": F.when(k % 2 == 0, F.col("c_mktsegment"))}
    rows = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.explode(F.create_map(*[x for n, c in cells.items() for x in (F.lit(n), c)])).alias("name", "value"))
    out = documents.typed_fields(rows, spark.createDataFrame(_FIELDS, "name string, path string, form string, place int"))
    return out.withColumn("items", F.array_join("items", "|")).withColumn("names", F.array_join("names", ","))


@query(rf"""WITH {_SHEETS} SELECT doc AS id, CASE WHEN k % 2 = 1 THEN 'CLASS ' || k ELSE 'CLASS ' || k - 1 END AS section, k + CASE WHEN doc % 3 = 0 THEN 1 ELSE 0 END - 1 AS place, 'Item ' || l_partkey AS name, 'PHB-' || l_suppkey AS source, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS page,
l_linenumber || ' Action' || CASE WHEN k % 3 = 0 THEN '|Bonus' ELSE '' END AS actions, 'Rest.' || chr(10) || chr(10) || 'Sub. More of ' || l_partkey AS body FROM (SELECT l.*, i.l_partkey, i.l_suppkey, i.l_linenumber FROM (SELECT doc, k, n FROM l) l JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS j FROM lineitem) i ON i.l_orderkey = doc AND i.j = k)
UNION ALL SELECT DISTINCT l_orderkey, '', 0, NULL, NULL, NULL, '', '| Hero' FROM lineitem WHERE l_orderkey % 3 = 0""")
def document_features(spark, sf_dir):
    """Orders as texts with a section for every two lines, a feature a line."""
    c = lambda e, name: e[name].cast("string")
    one = lambda e, i: F.concat(
        F.when(i % 2 == 0, F.concat(F.lit("=== CLASS "), (i + 1).cast("string"), F.lit(" ===\n\n"))).otherwise(""), F.lit("* Item "), c(e, "l_partkey"), F.lit(" • PHB-"), c(e, "l_suppkey"), F.when(e["l_linenumber"] % 2 == 0, F.concat(F.lit(" "), c(e, "l_linenumber"))).otherwise(""),
        F.lit("\n\n| "), c(e, "l_linenumber"), F.lit(" Action \nRest.\n\n\n"), F.when(i % 3 == 2, " | Bonus\n").otherwise(""), F.lit("Sub. More of "), c(e, "l_partkey"), F.lit("\n"),
    )
    text = F.concat(F.when(F.col("doc") % 3 == 0, "| Hero\n").otherwise(""), F.array_join(F.transform("s", one), ""))
    return documents.features(_sheets(spark, sf_dir).select("doc", text.alias("text")), "doc", "text").withColumn("actions", F.array_join("actions", "|"))


@query("""WITH e AS (SELECT p_partkey AS id, p_name AS group_id, p_brand AS source_key, CASE WHEN p_size % 3 = 0 THEN 'de' ELSE 'en' END AS lang, CASE WHEN p_partkey % 9 = 4 THEN '2014' ELSE '2024' END AS edition, p_partkey % 4 AS form FROM part WHERE p_brand <> 'Brand#7'),
l AS (SELECT group_id, arg_min(e, id) AS l FROM e GROUP BY group_id), m AS (SELECT e.*, l.l, row_number() OVER (PARTITION BY e.group_id ORDER BY e.id) AS n FROM e JOIN l USING (group_id) WHERE e.id <> l.l.id AND e.source_key <> l.l.source_key AND e.edition = l.l.edition)
SELECT l.id AS id, id AS other_id, CASE WHEN lang = l.lang THEN 'conflict' ELSE 'foreign' END AS kind FROM m WHERE n <= 3 AND (lang <> l.lang OR (CASE WHEN form = 3 THEN 1 WHEN form = 2 THEN 2 ELSE 0 END) <> (CASE WHEN l.form = 3 THEN 1 WHEN l.form = 2 THEN 2 ELSE 0 END) AND form <> 2 AND l.form <> 2)""")
def other_versions(spark, sf_dir):
    """Parts of one name as versions from many sources: texts that differ in case and spaces alone, others, blank ones, other languages and editions; one source holds revisions."""
    p, form = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    body = F.when(form == 0, F.concat(F.lit("The  "), "p_name", F.lit(" holds."))).when(form == 1, F.concat(F.lit("*Context: A*\n"), F.upper(F.concat(F.lit("The "), "p_name", F.lit(" holds."))))).when(form == 2, " ").otherwise("zzzzzzzzzzzzzzzzzzzzzz")
    entries = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("source_key"), F.when(F.col("p_partkey") % 9 == 4, "2014").otherwise("2024").alias("edition"), F.when(F.col("p_size") % 3 == 0, "de").otherwise("en").alias("lang"), body.alias("body"))
    sources = p.select(F.col("p_brand").alias("source_key"), F.when(F.col("p_brand") == "Brand#7", "errata").alias("kind")).distinct()
    return resolve.other_versions(entries, p.select(F.col("p_name").alias("group_id"), F.col("p_partkey").alias("id")), sources).drop("score")


@query(r"""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN nfc_normalize(text || 'e' || chr(769)) WHEN doc_id % 3 = 1 THEN nfc_normalize(text) || ' in picture a b' ELSE nfc_normalize(text) END AS text FROM documents""")
def composed_texts(spark, sf_dir):
    """Documents with planted marks: a decomposed letter in every third, marks of pictures, soft hyphens, no-break spaces and line breaks of markup in another."""
    i = F.col("doc_id") % 3
    planted = F.when(i == 0, "e\u0301").when(i == 1, " <!-- Start of picture text -->in\u00a0pic\u00adture<!-- End of picture text --> a<BR />b").otherwise("")
    return etl.composed_texts(table(spark, sf_dir, "documents").select("doc_id", F.concat("text", planted).alias("text")), "doc_id", "text")
