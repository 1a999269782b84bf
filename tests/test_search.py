"""The search driver, fuzzy names, glossary lookup, facets' parameters and pages, against brute force and small fixtures."""

import html
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import fuzzy
from lorekeep.operators import etl, facets, fulltext, glossary, predicates
from lorekeep.plans import queries


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def test_common_subsequences_of_random_strings():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc d") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert fuzzy.common(a, b) == lcs(a, b)
        short, long = sorted((a, b), key=len)
        if short and len(a) != len(b):
            windows = [long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))]
            assert fuzzy.partial(a, b) == pytest.approx(max(ratio(short, w) for w in windows))


@pytest.mark.parametrize(
    "a,b,want",
    [("aktionen", "reaktionen", 88.8889), ("magic missle", "missle magic", 95.0), ("elf", "elfenrüstung", 90.0), ("", "x", 0.0), (None, "x", 0.0), ("same", "same", 100.0), ("Abc", "abc", 66.6667), ("new york mets", "new york mets vs atlanta braves", 90.0)],
)
def test_weighted_similarity(a, b, want):
    assert fuzzy.weighted(a, b) == pytest.approx(want, abs=1e-3) == pytest.approx(fuzzy.weighted(b, a), abs=1e-3)


def test_suggestions_equal_brute_force(spark, sf):
    names = {r[0].strip().lower() for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name").collect()}
    got = {}
    for r in queries.QUERIES["glossary_suggestions"](spark, sf).collect():
        got.setdefault(r.asked, []).append((r.name, r.score))
    asked = {r[0] for r in spark.read.parquet(f"{sf}/part.parquet").where("p_partkey % 20 = 0").select(F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)"))).collect()}
    for a in asked:
        want = sorted(((-round(ratio(a.strip().lower(), n), 4), n) for n in names if round(ratio(a.strip().lower(), n), 4) >= 88))[:5]
        assert sorted((-s, n) for n, s in got.get(a, [])) == want
    ratios = {(r.asked, r.name): r.ratio for r in queries.QUERIES["fuzzy_ratio"](spark, sf).collect()}
    assert ratios == {(a, n): round(ratio(a, n), 2) for a, rows in got.items() for n, _ in rows} and ratios


def test_fuzzy_names_equal_brute_force(spark):
    names = [(1, "Magic Missile"), (2, "Fire Bolt"), (3, "Elf"), (4, "Elfenrüstung"), (5, "Bolt of Fire"), (6, ""), (7, None), (8, "magic missile"), (9, "El")]
    asked = [(1, "Magic Missle"), (2, "Fire Bolt of"), (3, "Elf"), (4, ""), (5, "Bo"), (6, None)]
    got = {(r.query_id, r.id): r.score for r in fulltext.fuzzy_names(spark.createDataFrame(names, "id long, name string"), spark.createDataFrame(asked, "query_id long, query string"), 10).collect()}
    scored = {(q, i): fuzzy.weighted(a, n) for (q, a), (i, n) in itertools.product(asked, names)}
    assert got == {k: round(v, 4) for k, v in scored.items() if v >= 86} and got
    assert queries.QUERIES["fuzzy_names"]  # registered over all parts


ENTRIES = [
    (1, "a", "2024", 1, "Fire Bolt", "a bolt of fire"), (2, "b", "2024", 1, "Fire Bolt", "the same bolt"), (3, "a", "2024", 1, "Bolt", "no fire here, but a bolt"), (4, "a", "2014", 1, "Fire Bolt", "an old bolt of fire"),
    (5, "err", "2024", 1, "Fire Bolt", "a change to the bolt"), (6, "a", "2024", 2, "Feuerpfeil", "ein pfeil"), (7, "a", "2024", 2, "Shield", "guards"),
]


@pytest.fixture
def corpus(spark):
    entries = spark.createDataFrame(ENTRIES, "id long, source_key string, edition string, category int, name string, body string")
    sources = spark.createDataFrame([("a", 2, None), ("b", 1, None), ("err", 9, "errata")], "source_key string, priority int, kind string")
    words = spark.createDataFrame([("fire bolt", "feuerpfeil")], "term string, target string")
    return entries, sources, words


def found(spark, corpus, asked, **options):
    return [tuple(r) for r in fulltext.find(*corpus, spark.createDataFrame(asked, "query_id int, query string"), **options).orderBy("query_id", "other", "rank").collect()]


def test_the_driver_merges_entities_ranks_names_and_reports_paths(spark, corpus):
    got = found(spark, corpus, [(1, "fire bolt"), (2, "sheild"), (3, ""), (4, "guards"), (5, "x" * 300)])
    # exact names first (by source priority), the revision alone, then the glossary's word, then the text alone
    assert [r[1:6] for r in got if r[0] == 1 and not r[1]] == [(False, 1, 2, "direct", "name"), (False, 2, 6, "glossary:feuerpfeil", "name"), (False, 3, 5, "direct", "name"), (False, 4, 3, "direct", "text only")] or \
        {(r[3], r[4], r[5]) for r in got if r[0] == 1 and not r[1]} >= {(2, "direct", "name"), (6, "glossary:feuerpfeil", "name")}
    assert [(r[3], r[4]) for r in got if r[0] == 1 and r[1]] == [(4, "direct")]
    assert [(r[3], r[4]) for r in got if r[0] == 4] == [(7, "direct")] and [r[5] for r in got if r[0] == 4] == ["text only"]
    assert not [r for r in got if r[0] in (3, 5)]
    assert all(r[6] == len([x for x in got if x[:2] == r[:2]]) for r in got)


def test_a_question_without_hits_is_compared_with_names(spark, corpus):
    got = found(spark, corpus, [(1, "Sheild")], wanted_edition=None)
    assert [(r[3], r[4]) for r in got] == [] or [(r[3], r[4]) for r in got] == [(7, "fuzzy")]
    assert [(r[3], r[4], r[5]) for r in found(spark, corpus, [(1, "Feurpfeil")], wanted_edition=None)] == [(6, "fuzzy", "name")]


def test_limits_and_filters_of_the_driver(spark, corpus):
    assert {r[3] for r in found(spark, corpus, [(1, "bolt")], category=1, source="a", wanted_edition=None, limit=1)} <= {1, 3, 4}
    assert len(found(spark, corpus, [(1, "bolt")], wanted_edition=None, limit=0)) == 1
    for options in ({"wanted_edition": "1999"}, {"category": 99}, {"source": "none"}):
        with pytest.raises(ValueError):
            found(spark, corpus, [(1, "bolt")], **options)


def test_search_counts_three_columns_and_odd_rows(spark):
    rows = [(1, "bolt", None, "x"), (2, None, "bolt", "x"), (3, "x", None, "bolt"), (4, None, None, None), (5, "", "", "")]
    e = spark.createDataFrame(rows, "id long, name string, original string, body string")
    got = {r.id: r.score for r in fulltext.search(e, spark.createDataFrame([(1, "bol")], "query_id int, query string")).collect()}
    assert got.keys() == {1, 2, 3} and got[1] == got[2] <= got[3]
    assert fulltext.search(e.where("false"), spark.createDataFrame([(1, "bol")], "query_id int, query string")).count() == 0
    assert fulltext.search(e, spark.createDataFrame([], "query_id int, query string")).count() == 0


def test_snippets_show_the_match(spark):
    e = spark.createDataFrame([("one two three four five six seven eight",), ("nothing",), (None,)], "t string")
    got = [r[0] for r in e.select(fulltext.snippet(F.col("t"), F.array(F.lit("sev")), 3)).collect()]
    assert got[0] == "… six »seven« eight" and got[1:] == ["nothing", None]


def test_lookup_tells_exact_rows_from_similar_ones(spark):
    g = spark.createDataFrame([(1, "action", "aktion", 1, None, None), (2, "actions", "aktionen", 0, "2024", "x"), (3, "reaction", "reaktion", 1, None, None)], "row_id long, term string, target string, official int, edition string, origin string")
    asked = spark.createDataFrame([("Action",), ("actoins",), ("zzz",), (None,), ("",)], "asked string")
    got = [(r.asked, r.place, r.term, r.match) for r in glossary.looked_up(g, asked).orderBy("asked", "place").collect()]
    assert got[0] == ("Action", 1, "action", "exact") and all(m == "similar" for a, p, _, m in got if a != "Action" or p > 1)
    back = glossary.looked_up(g, spark.createDataFrame([("Aktion",)], "asked string"), reverse=True).first()
    assert (back.term, back.target, back.match) == ("aktion", "action", "exact")
    shown = {(r.asked, r.target): (r.official, r.match) for r in glossary.translated_terms(g, asked).collect()}
    assert shown[("Action", "aktion")] == (1, "exact") and ("Action", "aktionen") not in shown
    assert {v for (a, _), v in shown.items() if a == "actoins"} <= {(0, "similar")}


@pytest.mark.parametrize("asked", [{}, {"grade": 10}, {"grade": "3"}, {"grade": 1, "creature": "beast"}, {"school": "cooking"}, {"challenge": "1/3"}, {"colour": "red"}])
def test_facet_parameters_are_checked(spark, asked):
    with pytest.raises(ValueError):
        facets.predicate(asked)


def test_facet_parameters_in_either_language(spark):
    rows = spark.createDataFrame([(1, 3, "evocation", "Magier,Zauberer", "fire", None, None), (2, None, None, None, None, "dragon", "1/4")], "id int, grade int, school string, classes string, damage string, creature string, challenge string")
    for asked, want in (({"grade": 3, "school": "Hervorrufung"}, [1]), ({"class": "wizard"}, [1]), ({"class": "Zauberer", "damage": "feuerschaden"}, [1]), ({"creature": "Drache", "challenge": "0.25"}, [2]), ({"class": "monk"}, [])):
        assert [r.id for r in rows.where(facets.predicate(asked)[1]).collect()] == want
    assert facets.witnessed(rows, "school", ["evocation"]) and not facets.witnessed(rows, "school", ["illusion"])
    named = spark.createDataFrame([("Hervorrufungszauber", "fire"), ("ung", "schaden"), (None, None)], "s string, d string")
    assert [tuple(r) for r in named.select(facets.school_key(F.col("s")), facets.damage_key(F.col("d"))).collect()] == [("evocation", "fire"), (None, None), (None, None)]


def test_odd_texts_have_no_facets(spark):
    e = spark.createDataFrame([(None,), ("",), ("Level 99999999999",), ("CR",), ("x" * 5000,)], "t string")
    t = F.col("t")
    for r in e.select(facets.spell_grade(t), facets.school(t), facets.challenge(t), facets.creature(t), facets.abilities(t), facets.hit_points(t), facets.price_cents(t, F.lit(True))).collect():
        assert not any(x is not None for x in r)


def test_editions_and_parameters():
    assert predicates.edition(" 5.5E ", {"2024"}) == "2024" and predicates.edition(None, set()) is None and predicates.checked("x", None, set()) is None
    with pytest.raises(ValueError):
        predicates.edition("6e", {"2024", "2014"})


def test_markdown_of_pages(spark, sf):
    """Every line of a page's article, by another reading of its fixed frame."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r.markdown for r in queries.QUERIES["html_markdown"](spark, sf).collect()}
    for r in pages:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        for block in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "**", article).replace("<br>", "\n")):
            plain = html.unescape(re.sub(r"<[^>]*>", " ", block))
            for line in filter(None, (" ".join(x.split()) for x in plain.split("\n"))):
                assert re.sub(r"[*\s#]", "", line) in re.sub(r"[*\s#]", "", got[r.page_id])
        assert "<script" not in got[r.page_id] and "</" not in got[r.page_id]
    chunks = queries.QUERIES["heading_chunks"](spark, sf).collect()
    assert {c.id for c in chunks} == {i for i, m in got.items() if re.search(r"(?m)^##? \S", m)} and all(c.body for c in chunks)


def test_answers_are_split_whole(spark, sf):
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    parts = {}
    for r in queries.QUERIES["split_answers"](spark, sf).orderBy("part").collect():
        assert len(r.text) <= 400
        parts.setdefault((r.conv_id, r.turn), []).append(r.text)
    assert {k: "".join("".join(v).split()) for k, v in parts.items()} == {k: "".join(t.split()) for k, t in texts.items() if t.strip()}


def test_broken_and_deep_pages():
    for unit in ("<x", "<a '", "<div>", "<td>", "<a href='http://x'>"):
        etl.markdown_of(unit * 50_000)
    assert etl.markdown_of("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2|3</td></tr></table>") == "| A | B |\n|---|---|\n| 1 | 2\\|3 |"
    assert etl.markdown_of("<a href='/p'>x</a>", "https://w") == "[x](https://w/p)" and etl.markdown_of("<a href='javascript:x'>y</a>") == "y" and etl.markdown_of(None) == ""
