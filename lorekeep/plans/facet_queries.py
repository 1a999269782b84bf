"""Registered queries over facets. Their texts are made of parts' figures in several notations; the SQL knows the figures alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import facets
from ..sources.corpus import dealt, table
from .registry import query

_SCHOOL_WORDS = ("Bannzauber", "Beschwörung", "divination", "Verzauberung", "evocation", "Illusion", "Nekromantie", "transmutation")
_SCHOOL_KEYS = list(facets.SCHOOLS)
_CLASS_WORDS = ("Barbar", "bard", "Kleriker", "druid", "fighter", "monk", "Paladin", "ranger", "Schurke", "sorcerer", "Hexenmeister", "wizard")
_DAMAGE_WORDS = ("Feuerschaden", "cold damage", "Blitzschaden", "acid damage", "Giftschaden", "necrotic damage", "radiant damage", "psychic damage", "Donnerschaden", "force damage", "Wuchtschaden", "piercing damage", "Hiebschaden")
_DAMAGE_KEYS = list(facets.DAMAGE)
_KIND_WORDS = ("Aberration", "beast", "Himmelswesen", "construct", "Drache", "Elementar", "fey", "Unhold", "giant", "Humanoider", "Monstrosität", "ooze", "Pflanzenwesen", "Untote")
_KIND_KEYS = list(facets.CREATURES)


def _pick(words, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), at.cast("int") + 1)


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _spells(spark, sf_dir) -> DataFrame:
    """Spells of parts: the grade in four notations (a fifth states none), school, classes in a field, in brackets or none, a range, a duration and damage."""
    p = dealt(spark, sf_dir, "part", "p_partkey")
    k = F.col("p_partkey")
    grade, form, school, one, two = k % 12, k % 5, k % 8, k % 12, (k + 5) % 12
    stated = F.when(form == 0, F.concat(grade, F.lit(". Grades"))).when(form == 1, F.concat(F.lit("**Level:** "), grade)).when(form == 2, F.concat(grade, F.lit("th-level"))).when(form == 3, "_Zaubertrick_").otherwise("ohne")
    names = F.concat(_pick(_CLASS_WORDS, one), F.lit(", "), _pick(_CLASS_WORDS, two))
    classes = F.when(k % 3 == 0, F.concat(F.lit(" ("), names, F.lit(")"))).when(k % 3 == 1, F.concat(F.lit(" (a silver wire)\nClasses: "), names)).otherwise(" (a silver wire)")
    far = F.when(k % 4 == 0, F.concat(F.lit("**Range:** "), k % 30 * 10, F.lit(" feet"))).when(k % 4 == 1, "**Range:** Touch").when(k % 4 == 2, F.concat(F.lit("**Range:** "), k % 5 + 1, F.lit(" miles"))).otherwise("Ranger things")
    lasts = F.when(k % 3 == 0, "Duration: Instantaneous").when(k % 3 == 1, F.concat(F.lit("Duration: Concentration, up to "), k % 7 + 1, F.lit(" hours"))).otherwise(F.concat(F.lit("Duration: "), k % 7 + 1, F.lit(" minutes")))
    takes = F.when(k % 2 == 0, "Casting Time: 1 bonus action").otherwise(F.concat(F.lit("Casting Time: "), k % 9 + 1, F.lit(" hours")))
    body = F.concat(stated, F.lit(" "), _pick(_SCHOOL_WORDS, school), classes, F.lit("\n"), far, F.lit("\nComponents: V, M\n"), takes, F.lit("\n"), lasts, F.lit("\n" + "-" * 60), F.when(k % 10 == 0, "\n(ritual)").otherwise(""), F.lit("\nIt rolls 8W6 and 2d10, "), _pick(_DAMAGE_WORDS, k % 13), F.lit(" and "), _pick(_DAMAGE_WORDS, (k + 4) % 13), F.lit("."))
    return p.select(k.alias("id"), F.lit("spell").alias("category"), F.col("p_brand").alias("source_key"), F.col("p_name").alias("name"), (F.col("p_size") % 20).alias("priority"), F.when(k % 50 == 49, None).otherwise(body).alias("body"))


_SPELLS = f"""k AS (SELECT p_partkey AS k, p_brand, p_name, p_size, p_partkey % 50 = 49 AS none FROM part),
spells AS (SELECT *, CASE WHEN none THEN NULL WHEN k % 5 < 3 THEN CASE WHEN k % 12 <= 9 THEN k % 12 END WHEN k % 5 = 3 THEN 0 END AS grade,
  CASE WHEN NOT none THEN {_list(_SCHOOL_KEYS)}[k % 8 + 1] END AS school, CASE WHEN NOT none AND k % 3 < 2 THEN {_list(_CLASS_WORDS)}[k % 12 + 1] || ',' || {_list(_CLASS_WORDS)}[(k + 5) % 12 + 1] END AS classes,
  k % 13 AS d1, (k + 4) % 13 AS d2 FROM k),
named AS (SELECT *, CASE WHEN NOT none THEN {_list(_DAMAGE_KEYS)}[least(d1, d2) + 1] || ',' || {_list(_DAMAGE_KEYS)}[greatest(d1, d2) + 1] END AS damage FROM spells)"""


@query(f"WITH {_SPELLS} SELECT k AS id, CAST(grade AS INTEGER) AS grade, school, classes, damage FROM named WHERE coalesce(CAST(grade AS VARCHAR), school, classes, damage) IS NOT NULL")
def spell_facets(spark, sf_dir):
    return facets.facet_table(_spells(spark, sf_dir)).select("id", "grade", "school", "classes", "damage")


@query(f"""WITH {_SPELLS} SELECT k AS id, CASE WHEN NOT none THEN CASE k % 4 WHEN 0 THEN CAST(k % 30 * 3 AS VARCHAR) WHEN 1 THEN 'touch' WHEN 2 THEN CAST((k % 5 + 1) * 1600 AS VARCHAR) END END AS range, CASE WHEN NOT none THEN 'VM' END AS components,
CAST(CASE WHEN NOT none THEN CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN (k % 7 + 1) * 60 ELSE k % 7 + 1 END END AS INTEGER) AS minutes, CASE WHEN NOT none THEN k % 3 = 1 END AS concentration,
CASE WHEN NOT none THEN CASE WHEN k % 2 = 0 THEN 'bonus action' ELSE CAST((k % 9 + 1) * 60 AS VARCHAR) || 'min' END END AS casting, CASE WHEN NOT none THEN k % 10 = 0 END AS ritual, CASE WHEN NOT none THEN '2d10,8d6' END AS dice FROM spells""")
def spell_heads(spark, sf_dir):
    s = _spells(spark, sf_dir)
    return s.select("id", facets.spell_fields(F.col("body"), german=False).alias("f"), F.array_join(facets.dice(F.col("body")), ",").alias("dice")).select("id", "f.*", "dice")


def _creatures(spark, sf_dir) -> DataFrame:
    """Sheets of parts: the challenge in five notations, armour class and points, six abilities of which one may lack."""
    p = dealt(spark, sf_dir, "part", "p_partkey")
    k, s = F.col("p_partkey"), F.col("p_size")
    rating = F.element_at(F.array(F.lit("0.125"), F.lit("1/2"), F.lit("4.0"), F.lit("17")), (k % 4 + 1).cast("int"))
    form = k % 5
    stated = F.when(form == 0, F.concat(F.lit("**HG** "), rating)).when(form == 1, F.concat(F.lit("Herausforderungsgrad: "), rating)).when(form == 2, F.concat(F.lit("CR "), rating)).when(form == 3, F.concat(F.lit("Challenge "), rating)).otherwise("CRX 5")
    labels = ("STR", "**Ges**", "KON", "INT", "Wis", "CHA")
    scores = F.concat(*[F.concat(F.lit(f" {label} "), (s + i) % 30 + 1) for i, label in enumerate(labels[:5])], F.when(k % 9 == 0, "").otherwise(F.concat(F.lit(" CHA "), (s + 5) % 30 + 1)))
    body = F.concat(F.lit("_Small "), _pick(_KIND_WORDS, k % 14), F.when(k % 6 == 0, "chen").otherwise(""), F.lit(", neutral_\n"), F.when(k % 2 == 0, "RK: ").otherwise("**AC** "), s, F.lit(" TP "), s * 3, F.lit("\n"), stated, F.lit("\n"), scores)
    return p.select(k.alias("id"), F.lit("creature").alias("category"), F.col("p_brand").alias("source_key"), F.col("p_name").alias("name"), F.lit(None).cast("int").alias("priority"), body.alias("body"))


@query(f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 6 <> 0 THEN {_list(_KIND_KEYS)}[p_partkey % 14 + 1] END AS creature, CASE WHEN p_partkey % 5 < 4 THEN ['1/8', '1/2', '4', '17'][p_partkey % 4 + 1] END AS challenge, CAST(p_size AS VARCHAR) AS ac, CAST(p_size * 3 AS VARCHAR) AS hp,
CASE WHEN p_partkey % 9 <> 0 THEN array_to_string([(p_size + i) % 30 + 1 FOR i IN range(6)], ',') END AS abilities FROM part""")
def creature_keys(spark, sf_dir):
    c = _creatures(spark, sf_dir)
    return c.select("id", facets.sheet_key(F.col("body")).alias("k")).select("id", "k.creature", "k.challenge", "k.ac", "k.hp", F.array_join("k.abilities", ",").alias("abilities"))


@query(f"""WITH {_SPELLS}, c AS (SELECT count(*) FILTER (p_partkey % 6 <> 0) AS creature, count(*) FILTER (p_partkey % 5 < 4) AS challenge, count(*) AS n FROM part)
SELECT 'spell' AS category, count(*) AS entries, count(grade) AS grade, count(school) AS school, count(classes) AS classes, count(damage) AS damage, 0 AS creature, 0 AS challenge FROM named
UNION ALL SELECT 'creature', n, 0, 0, 0, 0, creature, challenge FROM c""")
def facet_coverage(spark, sf_dir):
    entries = _spells(spark, sf_dir).unionByName(_creatures(spark, sf_dir))
    return facets.coverage(entries, facets.facet_table(entries))


_ASKED = {"grade": 3, "school": "Verzauberung", "damage": "Blitzschaden"}


@query(f"""WITH {_SPELLS}, h AS (SELECT *, row_number() OVER (PARTITION BY lower(strip_accents(trim(p_name))) ORDER BY p_size % 20, k) AS n FROM named WHERE grade = 3 AND school = 'enchantment' AND list_contains(str_split(damage, ','), 'lightning'))
SELECT k AS id, p_name AS name, p_brand AS source_key, (SELECT count(*) FROM h WHERE n = 1) AS matches FROM h WHERE n = 1 ORDER BY lower(p_name), k LIMIT 50""")
def facet_search(spark, sf_dir):
    s = _spells(spark, sf_dir)
    return facets.structural(s, facets.facet_table(s), _ASKED)


@query(f"""WITH {_SPELLS}, x AS (SELECT k AS id, p_brand AS source_key, grade FROM named WHERE coalesce(CAST(grade AS VARCHAR), school, classes, damage) IS NOT NULL)
SELECT id, source_key, CAST(CASE WHEN source_key = 'Brand#11' THEN grade ELSE 9 - grade END AS INTEGER) AS grade FROM x""")
def facet_reseed(spark, sf_dir):
    fresh = facets.facet_table(_spells(spark, sf_dir)).select("id", "source_key", "grade")
    return facets.seeded(fresh.withColumn("grade", 9 - F.col("grade")), fresh, "Brand#11")


@query("""WITH s AS (SELECT p_name AS name, p_brand AS source, min(p_size % 2) AS value FROM part GROUP BY ALL HAVING min(p_size % 2) = max(p_size % 2)),
c AS (SELECT name, value, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT name, count(*) AS kinds, sum(n) AS sources FROM c GROUP BY name)
SELECT s.name, s.source, s.value, 1 - s.value AS other_value FROM s JOIN c USING (name, value) JOIN t USING (name) WHERE kinds = 2 AND sources > 2 AND n = 1""")
def facet_contradictions(spark, sf_dir):
    return facets.contradictions(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("source"), (F.col("p_size") % 2).alias("value")))
