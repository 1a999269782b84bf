"""Registered queries over joins of other kinds, orders, tables in text, and stated figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import norm_term
from ..operators import align, etl, facets, options, quality
from ..sources import corpus
from ..sources.corpus import ENTRIES_SQL, GLOSSARY_SQL, table
from .registry import NORM, query


@query("""WITH h AS (SELECT p_size AS query_id, p_partkey AS id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey DESC) AS rank FROM part), m AS (SELECT query_id, id, rank FROM h WHERE rank <= 30 AND id % 10 = 3),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, count(*) OVER (PARTITION BY query_id) AS matches FROM m) SELECT query_id, CAST(place AS INTEGER) AS place, id, matches FROM c WHERE place <= 2""")
def facet_hits(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    hits = p.select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("id"), F.row_number().over(Window.partitionBy("p_size").orderBy(F.desc("p_partkey"))).alias("rank"))
    return facets.post_filtered(hits, p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 10).cast("int").alias("grade")), {"grade": 3}, 30, 2)


@query(f"WITH {ENTRIES_SQL} SELECT id, CAST(row_number() OVER (PARTITION BY source_key, category ORDER BY {NORM.format('name')}, name, id) AS INTEGER) AS place FROM entries")
def folded_order(spark, sf_dir):
    w = Window.partitionBy("source_key", "category").orderBy(norm_term(F.col("name")), "name", "id")
    return corpus.entries(spark, sf_dir).select("id", F.row_number().over(w).alias("place"))


@query(f"WITH {ENTRIES_SQL} SELECT DISTINCT edition FROM entries")
def editions(spark, sf_dir):
    return corpus.entries(spark, sf_dir).select("edition").distinct()


@query(f"""WITH {ENTRIES_SQL}, c AS (SELECT id, body, CASE source_key WHEN 'src1' THEN replace(replace(body, 'the', 'THE'), 'THE', 'x') WHEN 'src2' THEN replace(body, 'de', '') ELSE body END AS b FROM entries) SELECT id, sha256(b) AS body, b IS DISTINCT FROM body AS changed FROM c""")
def cleaned_by_source(spark, sf_dir):
    rules = {"src1": [("the", "THE"), ("THE", "x")], "src2": [("de", "")]}
    return etl.cleaned_by_source(corpus.entries(spark, sf_dir), rules).select("id", F.sha2("body", 256).alias("body"), "changed")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 4 END AS checked, CASE WHEN p_size % 5 = 0 THEN 0 ELSE CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size > 30 THEN 1 ELSE 0 END END AS wrong FROM part""")
def stated_figures(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey").cast("int"), F.col("p_size").cast("int")
    points = F.floor(s * 9 / 2) - 2 + F.when(k % 2 == 0, 9).otherwise(0)
    mod = F.floor((s - 10) / 2)
    sign = F.when(mod < 0, F.concat(F.lit("−"), F.abs(mod))).otherwise(F.concat(F.lit("+"), mod))
    text = F.concat(F.lit("HP "), F.greatest(points, F.lit(0)), F.lit(" ("), s, F.lit("W8 - 2) and 7 (2"), F.when(k % 3 == 0, "d7").otherwise("d6"), F.lit(") **Dex** "), s, F.lit(" ("), sign, F.lit(") | 12 ("), F.when(k % 7 == 0, "-1").otherwise("+1"), F.lit(") |"))
    # a count below one has no points of its own
    return facets.checked_expressions(p.select(k.alias("id"), F.when(s % 5 == 0, "nothing (d)").otherwise(text).alias("body"))).select("id", "checked", "wrong")


@query(f"""WITH {GLOSSARY_SQL}, p AS (SELECT lower(term) AS term, edition, count(DISTINCT target) AS n FROM glossary GROUP BY ALL), w AS (SELECT term, max(n) AS worst, count(*) AS editions FROM p GROUP BY term), t AS (SELECT lower(term) AS term, count(DISTINCT target) AS targets FROM glossary GROUP BY 1)
SELECT term, targets, editions, CASE WHEN term LIKE '%e' THEN 'homonym' WHEN worst = 1 THEN 'edition' ELSE 'real' END AS kind FROM t JOIN w USING (term) WHERE targets > 1""")
def verified_homonyms(spark, sf_dir):
    g = corpus.glossary(spark, sf_dir)
    return quality.term_conflicts(g, g.where("term like '%e'"))


_SIDES = """l AS (SELECT p_partkey AS id, p_brand, p_type, p_size, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS attributes FROM part WHERE p_partkey % 2 = 0), r AS (SELECT p_partkey AS id, p_brand, p_type, p_size, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS attributes FROM part WHERE p_partkey % 2 = 1)"""


@query(f"""WITH {_SIDES}, lu AS (SELECT p_brand, p_type, p_size, min(id) AS id FROM l GROUP BY ALL HAVING count(*) = 1), ru AS (SELECT p_brand, p_type, p_size, min(id) AS id FROM r GROUP BY ALL HAVING count(*) = 1), f AS (SELECT lu.id AS left_id, ru.id AS right_id FROM lu JOIN ru USING (p_brand, p_type, p_size)),
l2 AS (SELECT p_brand, p_size, min(id) AS id FROM l WHERE id NOT IN (SELECT left_id FROM f) GROUP BY ALL HAVING count(*) = 1), r2 AS (SELECT p_brand, p_size, min(id) AS id FROM r WHERE id NOT IN (SELECT right_id FROM f) GROUP BY ALL HAVING count(*) = 1)
SELECT left_id, right_id, 1 AS stage FROM f UNION ALL SELECT l2.id, r2.id, 2 FROM l2 JOIN r2 USING (p_brand, p_size) JOIN l ON l.id = l2.id JOIN r ON r.id = r2.id WHERE NOT coalesce(l.attributes <> r.attributes, false)""")
def vetoed_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size", F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("attributes"))
    return align.vetoed_pairs(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ["p_brand", "p_type", "p_size"], ["p_brand", "p_size"], "attributes")


@query("""SELECT p_partkey AS id, CAST(l AS INTEGER) AS level, c AS "column", CASE c WHEN 'Level' THEN CAST(l AS VARCHAR) ELSE 'p' || (p_size + l) END AS value FROM part, (VALUES (1), (2), (3)) t(l), (VALUES ('Level'), ('Bonus')) k(c)""")
def level_tables(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey")  # a small file makes long texts; they are dealt to all tasks
    line = lambda r: F.concat(F.lit(f"\n| {r} | p"), F.col("p_size") + r, F.lit(" |"))
    text = F.concat(F.lit("| Level | Other |\n|---|---|\n| 1 | x |\n| 2 | y |\n\ntext\n\n| Level | Bonus |\n|---|---|"), line(1), line(2), line(3), F.lit("\n\n\n| Item | Cost |\n|---|---|\n| a | 1 |\n| b | 1 |\n| c | 1 |\n| 4 | 1 |"))
    return options.level_table(p.select("p_partkey", text.alias("t")), "p_partkey", "t")


@query("SELECT DISTINCT c.c_custkey AS id, p.p_partkey AS match FROM customer c JOIN part p ON c.c_custkey = p.p_partkey OR c.c_nationkey = p.p_size")
def either_key_join(spark, sf_dir):
    """Rows that meet by one key or the other: two equi-joins that make each pair once."""
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    return align.either_key_pairs(c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("key")), p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("key")))


@query("""WITH a AS (SELECT o_custkey AS id, count(*) AS orders FROM orders GROUP BY 1), b AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1) SELECT c_custkey AS id, coalesce(orders, 0) AS orders, customers FROM customer LEFT JOIN a ON a.id = c_custkey JOIN b ON nation = c_nationkey""")
def derived_counts(spark, sf_dir):
    """A table between two aggregates, each taken before the join."""
    c = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("orders"))
    nations = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return c.join(orders, F.col("c_custkey") == F.col("id"), "left").join(nations, "c_nationkey").select(F.col("c_custkey").alias("id"), F.coalesce("orders", F.lit(0)).alias("orders"), "customers")
