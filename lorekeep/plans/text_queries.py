"""Registered queries over graders and repairs by gap keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import gaps, graders
from ..sources.corpus import table
from .registry import NORM, query

CASES = 10


def grader_rules(spark, sf_dir):
    """A rule for each word of the benchmark: in turn it must stand, must not, may stand twice, or must be in the last line; and widths."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("value")).where(F.length("value") >= 4).distinct()
    n = F.row_number().over(Window.orderBy("value"))  # a word list
    rules = words.select(n.cast("long").alias("rule_id"), "value").withColumns({"case": F.col("rule_id") % CASES, "kind": F.element_at(F.array(*map(F.lit, ("has", "lacks", "at most", "ends with"))), (F.floor(F.col("rule_id") / CASES) % 4 + 1).cast("int")), "n": F.lit(2)})
    widths = spark.range(CASES).select((-F.col("id") - 1).alias("rule_id"), F.col("id").alias("case"), F.lit("width").alias("kind"), F.lit(None).cast("string").alias("value"), (F.col("id") * 100).cast("int").alias("n"))
    return rules.select("rule_id", "case", "kind", "value", "n").unionByName(widths)


@query(f"""WITH w AS (SELECT DISTINCT value FROM (SELECT unnest(regexp_extract_all({NORM.format('text')}, '[\\p{{L}}\\p{{N}}]+')) AS value FROM benchmark) WHERE length(value) >= 4), r AS (SELECT row_number() OVER (ORDER BY value) AS rule_id, value FROM w),
k AS (SELECT rule_id, rule_id % 10 AS c, value, rule_id // 10 % 4 AS kind FROM r), d AS (SELECT doc_id AS id, doc_id % 10 AS c, coalesce(text, '') AS text, regexp_extract(rtrim(coalesce(text, ''), chr(10) || ' '), '[^\\n]*$') AS last FROM documents)
SELECT id, rule_id, CASE kind WHEN 0 THEN contains(text, value) WHEN 1 THEN NOT contains(text, value) WHEN 2 THEN length(text) - length(replace(text, value, '')) <= 2 * length(value) ELSE contains(last, value) END AS passed FROM d JOIN k USING (c)
UNION ALL SELECT id, -c - 1, list_max([length(x) FOR x IN str_split(text, chr(10))]) <= 100 * c FROM d""")
def graded_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return graders.graded(d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % CASES).alias("case"), "text"), grader_rules(spark, sf_dir))


def damaged(spark, sf_dir):
    """The documents; every twentieth has lost the third letter of its first word of eight or more."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    word = F.regexp_extract("body", r"\p{L}{8,}", 0)
    at = F.instr("body", word)
    torn = F.concat(F.substring("body", F.lit(1), at + 1), F.substring("body", at + 3, F.length("body")))
    return d.withColumn("body", F.when((F.col("id") % 20 == 0) & (word != ""), torn).otherwise(F.col("body")))


@query(r"""WITH d AS (SELECT doc_id AS id, text, CASE WHEN doc_id % 20 = 0 THEN nullif(regexp_extract(text, '\p{L}{8,}'), '') END AS word FROM documents),
b AS (SELECT id, CASE WHEN word IS NULL THEN text ELSE substring(text, 1, position(word IN text) + 1) || substring(text, position(word IN text) + 3) END AS body FROM d),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(body), '\p{L}+')) AS word FROM b), v AS (SELECT word, count(*) AS docs FROM w GROUP BY word),
k AS (SELECT DISTINCT substring(word, 1, i - 1) || substring(word, i + 1) AS key, word AS repaired, docs FROM (SELECT word, docs, unnest(range(1, length(word) + 1)) AS i FROM v WHERE docs >= 3 AND length(word) >= 6)),
m AS (SELECT v.word, repaired, k.docs, max(k.docs) OVER (PARTITION BY v.word) AS top FROM v JOIN k ON key = v.word WHERE v.docs <= 1 AND length(v.word) >= 5),
f AS (SELECT word, any_value(repaired) AS repaired, any_value(docs) AS docs FROM m WHERE docs = top GROUP BY word HAVING count(*) = 1) SELECT id, word, repaired, docs FROM w JOIN f USING (word)""")
def gap_repairs(spark, sf_dir):
    return gaps.repaired(damaged(spark, sf_dir))[1]
