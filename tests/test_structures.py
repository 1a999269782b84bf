"""Greedy groups against a sequential reading, torn layouts on small texts, rules that need rules against a plain reading,
records and documents with odd values."""

import random
import re
import time
import unicodedata

import pytest

from lorekeep.operators import documents, etl, grouping, layout, records, resolve, rules

ENTRIES = "category string, id long, priority int, variants array<string>"


def in_order(rows):
    """The groups that one pass over the sorted entries forms."""
    entries, groups, out = {}, {}, set()
    for c, i, p, v in rows:
        if i is not None:
            entries.setdefault((100 if p is None else p, i, c), set()).update(x for x in v or [] if x)
    for (_, i, c), v in sorted(entries.items(), key=lambda x: x[0][:2]):
        g = next((g for g in groups.setdefault(c, []) if g[1] & v), None)
        if g is None:
            groups[c].append(g := (i, set()))
        g[1].update(v)
        out.add((c, i, g[0]))
    return out


def test_groups_equal_one_pass_in_order(spark):
    rng = random.Random(1)
    name = lambda: rng.choice("pqrstuvwxyz") + rng.choice("0123456")
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2]), [name() for _ in range(rng.choice([0, 1, 2, 2, 3]))] + rng.choice([[], [None], [""]])) for i in range(120)]
    rows += [("c", 1000 + i, 5, [f"x{i}", f"x{i + 1}"]) for i in range(70)]  # a long chain is one group
    rows += [("d", 2000 + i, 5, ["hot", f"y{i}"]) for i in range(200)]  # and so is a hot variant
    rows += [("e", 3, 1, ["m"]), ("e", 1, 2, ["n"]), ("e", 2, 3, ["m", "n"]), ("e", 4, 4, ["n"]), (None, None, 1, ["p0"]), ("f", 5, 1, None), rows[3]]
    got = [tuple(r) for r in grouping.greedy_groups(spark.createDataFrame(rows, ENTRIES)).collect()]
    assert len(set(got)) == len(got) and set(got) == in_order(rows)
    assert {(i, g) for c, i, g in got if c == "e"} == {(3, 3), (1, 1), (2, 3), (4, 3)}  # the later one merges no groups: n now leads to the first
    assert grouping.greedy_groups(spark.createDataFrame([], ENTRIES)).collect() == []


def entry(n, kind=True, block=True, rest=True):
    return f"#### E{n}\n\n" + (f"_Small thing {n}, plain_\n\n" if kind else "") + (f"**AC** {n}\n\n" if block else "") + (f"Rest of {n}.\n\n" if rest else "")


def paired(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [(r.text, r.moved) for r in layout.paired_blocks(rows, "id", "text", r"\*\*AC\*\*").orderBy("id").collect()]


def test_headings_go_to_their_blocks(spark):
    block = lambda n: entry(n).split("\n\n", 1)[1]
    near = "Preface\n\n" + entry(1, rest=False) + "#### E2\n\nRest of 1.\n\n" + entry(3) + block(2)
    kept = entry(1, rest=False) + "#### E2\n\n_Small thing 2, plain_\n\nRest of 1.\n\n" + entry(3) + "**AC** 2\n\nRest of 2.\n\n"
    odd = [None, "", "no heading **AC** 1", entry(1), entry(1, block=False) + entry(2), entry(1, block=False) + entry(2) + entry(3) + entry(4) + block(5), entry(1, block=False) + entry(2) + block(3) + block(4), entry(1, block=False) + "#### E2\n\n**AC** 1 **AC** 2\n", entry(1, block=False)]
    got = paired(spark, near, kept, near + near.removeprefix("Preface\n\n"), *odd)
    assert got[0] == ("Preface\n\n" + entry(1) + entry(3) + entry(2), 1)
    assert got[1] == (entry(1) + entry(3) + entry(2), 1)
    assert got[2] == ("Preface\n\n" + 2 * (entry(1) + entry(3) + entry(2)), 2)
    assert got[3:] == [(t, 0) for t in odd]


def test_long_texts_stay_linear(spark):
    times = []
    for n in (500, 4000):
        text = "".join(entry(i) for i in range(n)) + "x " * 20 * n
        began = time.time()
        assert paired(spark, text) == [(text, 0)]
        times.append(time.time() - began)
    assert times[1] < 30 * max(times[0], 0.2)


def test_family_headings(spark):
    rest, own = "Another has the rest of its text below.\n\n", "Zombies of this kind shamble a long way off.\n\n"
    texts = ["# M\n#### A\n\n### Zombies\n\n" + own + entry(1) + entry(2), "# M\n#### A\n\n### Zombies\n\n" + rest + entry(1), "#### A\n\n### Zombies\n\n" + rest + entry(1), None, "", "# M\n### Zombies\n\n" + rest, "### T\n\n" + rest + entry(1) + "# M\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [(r.text, r.own, r.others) for r in layout.family_headings(rows, "id", "text", r"\*\*AC\*\*", "# M").orderBy("id").collect()]
    assert got[0] == ("# M\n#### A\n\n### Zombies\n\n" + entry(1) + own + entry(2), 1, 0)
    assert got[1] == ("# M\n#### A\n\n" + rest + "### Zombies\n\n" + entry(1), 0, 1)
    assert got[2:] == [(t, 0, 0) for t in texts[2:]]


RULES = "rule string, kind string, fields array<string>, low double, high double, needs array<string>, required boolean"


def plain_findings(values, table):
    """One build's findings, rule by rule with recursion."""
    by_name, done = {r[0]: r for r in table}, {}

    def find(name):
        if name in done:
            return done[name]
        _, kind, fields, low, high, needs, required = by_name[name]
        v = [values.get(f) for f in fields]
        given = [x for x in v if x is not None]
        open_need = next((n for n in needs or [] if find(n)[0] != "ok"), None)
        lacking = next((f for f, x in zip(fields, v) if x is None), None) if kind in ("range", "sum") else None
        value = {"range": lambda: min(given, default=None), "sum": lambda: float(sum(given)), "count": lambda: float(len(given)), "together": lambda: float(len(given))}[kind]()
        good = {"range": lambda: all(low <= x <= high for x in given), "sum": lambda: low <= sum(given) <= high, "count": lambda: low <= len(given) <= high, "together": lambda: len(given) in (0, len(v))}[kind]
        if open_need:
            done[name] = ("not checkable", None, open_need)
        elif lacking:
            done[name] = ("missing" if required else "not checkable", None, lacking)
        else:
            done[name] = ("ok" if good() else "violation", value, None)
        return done[name]

    return {name: find(name) for name in by_name}


def test_rules_that_need_rules(spark):
    rng = random.Random(4)
    table = [(f"r{i}", rng.choice(["range", "sum", "count", "together"]), rng.sample("abcdef", rng.randint(1, 3)), float(rng.randint(0, 2)), float(rng.randint(2, 20)), rng.sample([f"r{j}" for j in range(i)], min(i, rng.choice([0, 0, 1, 2]))) or None, rng.random() < 0.5) for i in range(25)]
    rows = [(b, f, float(rng.randint(0, 9)) if rng.random() < 0.9 else None) for b in range(40) for f in "abcdefxy" if rng.random() < 0.8]
    rows += [(100, "x", 1.0), (101, None, 2.0), (102, "a", 1.0), (102, "a", 3.0), (None, "a", 1.0)]
    shuffled = rng.sample(table, len(table))
    got = rules.ranked_findings(spark.createDataFrame(rows, "build_id long, field string, value double"), spark.createDataFrame(shuffled, RULES)).collect()
    values = {}
    for b, f, v in rows:
        if b is not None:
            mine = values.setdefault(b, {})
            if v is not None:
                mine[f] = max(v, mine.get(f, v))
    want = {(b, name, *x) for b, v in values.items() for name, x in plain_findings(v, table).items()}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    empty = spark.createDataFrame([], "build_id long, field string, value double")
    assert rules.ranked_findings(empty, spark.createDataFrame(table, RULES)).collect() == []
    one = spark.createDataFrame(rows[:3], "build_id long, field string, value double")
    for bad in ([("a", "range", ["x"], 0.0, 1.0, ["b"], False), ("b", "range", ["x"], 0.0, 1.0, ["a"], False)], [("a", "range", ["x"], 0.0, 1.0, ["c"], False)], 2 * [("a", "range", ["x"], 0.0, 1.0, None, False)], [("a", "odd", ["x"], 0.0, 1.0, None, False)]):
        with pytest.raises(ValueError):
            rules.ranked_findings(one, spark.createDataFrame(bad, RULES))


def test_long_chains_of_rules(spark):
    table = [(f"r{i:03}", "range", ["a"], 0.0, 9.0, [f"r{i - 1:03}"] if i else None, False) for i in range(60)]
    began = time.time()
    got = rules.ranked_findings(spark.createDataFrame([(1, "a", 5.0), (2, "a", 50.0)], "build_id long, field string, value double"), spark.createDataFrame(table, RULES)).collect()
    assert {(r.build_id, r.verdict) for r in got} == {(1, "ok"), (2, "violation"), (2, "not checkable")} and len(got) == 120
    assert time.time() - began < 60


FORMATS = "kind string, place int, label string, path string, form string, unit string"


def test_records_with_odd_values(spark):
    formats = [("c", 1, "Armour", "$.ac", "value", " AC"), ("c", 2, "Flies", "$.fly", "flag", None), ("c", 3, "Speed", "$.speed", "pairs", " ft."), ("c", 4, "Senses", "$.senses", "list", None), ("c", 5, "Actions", "$.acts", "paragraphs", None)]
    rows = [
        (1, "c", '{"ac": 12, "fly": true, "speed": {"walk": 30, "fly": null, "swim": "40"}, "senses": ["a", {"name": "b"}, 7, null, [1]], "acts": [{"name": "Bite", "desc": "Hit."}, {"name": "Roar"}, "Plain"]}'),
        (2, "c", '{"ac": [1], "fly": false, "speed": "fast", "senses": "keen", "acts": "Only text"}'), (3, "c", '{"ac": null, "fly": "no word", "speed": {}, "senses": [], "acts": {}}'), (4, "c", "{broken"), (5, "c", None), (6, "z", "{}"), (7, None, "{}"), (8, "c", "[1, 2]"), (9, "c", '{"ac": " ", "acts": [{"desc": "no name"}]}'), (1, "c", '{"ac": 1.5}'), (10, "c", ""),
    ]
    got = [(r.id, r.body, r.problem) for r in records.formatted_records(spark.createDataFrame(rows, "id long, kind string, record string"), spark.createDataFrame(formats, FORMATS)).collect()]
    one = "**Armour:** 12 AC\n**Flies**\n**Speed:** swim 40 ft., walk 30 ft.\n**Senses:** a, b, 7\n\n## Actions\n\n***Bite.*** Hit.\n\n***Roar.***\n\nPlain"
    want = [(1, one, None), (2, "**Speed:** fast ft.\n**Senses:** keen\n\n## Actions\n\nOnly text", None), (3, "", None), (4, "", "unreadable"), (5, "", "unreadable"), (6, "", "unknown kind"), (7, "", "unknown kind"), (8, "", None), (9, "", None), (1, "**Armour:** 1.5 AC", None), (10, "", "unreadable")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        records.formatted_records(spark.createDataFrame(rows, "id long, kind string, record string"), spark.createDataFrame([("c", 1, "x", "$.x", "odd", None)], FORMATS))


def test_every_cell_is_kept(spark):
    fields = [("F1", "f", "text", 1), ("F2", "f", "text", 2), ("F10", "f", "text", 10), ("L", "l", "whole", 1), ("N", "n", "number", 1), ("B", "b", "flag", 1), ("I", "i", "list", 1)]
    rows = [
        (1, "F10", "Third part"), (1, "F1", "First half of"), (1, "F2", "a line."), (1, "L", " -1,234 "), (1, "N", "1,000.25"), (1, "B", "X"), (1, "I", "a, b;c\n"), (1, "Zz", "kept"),
        (2, "F1", ""), (2, "L", "1,23"), (2, "N", "1e5"), (2, "B", ""), (2, "I", " , "), (2, "Zz", None), (3, "L", "1"), (3, "L", "1"), (3, "F1", "One."), (3, "F2", "Small Head. It is."), (4, "F1", "One."), (4, "F2", "The Head. It is."), (5, "F1", "One.\n"), (5, "F2", "Head. x"), (5, "F2", None),
        (None, "L", "1"), (6, None, "x"), (7, "L", "9" * 18), (7, "N", "9" * 400),
    ]
    cells = spark.createDataFrame(rows, "doc_id long, name string, value string")
    got = documents.typed_fields(cells, spark.createDataFrame(fields, "name string, path string, form string, place int")).collect()
    by = {(r.doc_id, r.path): r for r in got}
    assert by[1, "f"].text == "First half of a line. Third part" and by[1, "f"].names == ["F1", "F2", "F10"]
    assert (by[1, "l"].whole, by[1, "n"].number, by[1, "b"].flag, by[1, "i"]["items"]) == (-1234, 1000.25, True, ["a", "b", "c"])
    assert (by[3, "f"].text, by[4, "f"].text, by[5, "f"].text) == ("One.\n\nSmall Head. It is.", "One. The Head. It is.", "One.\nHead. x")
    assert {r.path for r in got if r.doc_id == 2} == {"rest.F1", "rest.L", "rest.N", "rest.B", "rest.I", "rest.Zz"} and sum(r.path == "rest.L" for r in got if r.doc_id == 3) == 2
    assert by[7, "l"].whole == int("9" * 18) and by[7, "rest.N"].text == "9" * 400
    assert sorted((r.doc_id, n) for r in got for n in r.names) == sorted((d, n) for d, n, _ in rows if d is not None and n is not None)
    for bad in (fields + fields[:1], fields + [("Q", "q", "odd", 1)], fields + [("Q", "f", "flag", 1)]):
        with pytest.raises(ValueError):
            documents.typed_fields(cells, spark.createDataFrame(bad, "name string, path string, form string, place int"))


def test_features_lose_no_line(spark):
    text = "Before.\n=== A ===\n* One • PHB 12\n\n| 1 Action\nBody.\n\n\n\nMore | here\n | Bonus\n* Two • DMG\n=== B ===\nloose\n* no feature\n"
    rows = [(1, text), (2, None), (3, ""), (4, " \n"), (5, "=== A ==="), (1, "again"), (6, "=== A ===\n* X • S 99999999999")]
    got = sorted((tuple(r) for r in documents.features(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()), key=repr)
    want = [(1, "", 0, None, None, None, [], "Before."), (1, "A", 1, "One", "PHB", 12, ["1 Action", "Bonus"], "Body.\n\nMore | here"), (1, "A", 2, "Two", "DMG", None, [], ""), (1, "B", 3, None, None, None, [], "loose\n* no feature"), (1, "", 0, None, None, None, [], "again"), (6, "A", 0, None, None, None, [], "* X • S 99999999999")]
    assert got == sorted(want, key=repr)


def test_features_of_long_texts_are_cut_once(spark):
    n = 20_000
    rows = [(1, "* A • B\na" + "\n" * n + "b"), (2, "=== S ===\n" + "* C • D 1\nx\n" * n + "=== T ===y"), (3, "\r\n* E • F\r\n\x85* G • H\n•\ni \u2029"), (4, "•\nno head\n1\n2\n3"), (5, "*" + " " * n + "x\n===" + " " * n + "y")]
    found = documents.features(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert "Filter" not in found._jdf.queryExecution().optimizedPlan().toString()  # one that Spark infers cuts each text again
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = [(1, "", 0, "A", "B", None, [], "a\n\nb"), (3, "", 0, None, None, None, [], "* E • F\r\n\x85"), (3, "", 1, "G", "H", None, [], "•\ni \u2029"), (4, "", 0, None, None, None, [], "•\nno head\n1\n2\n3"), (5, "", 0, None, None, None, [], rows[4][1])]
    assert got == sorted(want + [(2, "S", i, "C", "D", 1, [], "x") for i in range(n)] + [(2, "T", n, None, None, None, [], "y")], key=repr)


def test_versions_of_a_group(spark):
    rows = [(1, "rev", "x", "de", "a revision"), (2, "s1", "x", "de", "*Context: A*\nSame  text here"), (3, "s2", "x", "de", "same text HERE"), (4, "s1", "x", "de", "own further section"), (5, "s3", "x", "en", "other language"), (6, "s4", "x", None, "no language"), (7, "s5", "x", "de", "beyond the cap"), (8, "s6", "y", "de", "other edition")]
    rows += [(20, "s1", "x", "de", "quite a text"), (21, "s2", "x", "de", None), (22, "s3", "x", "de", ""), (23, "s4", "x", "de", "0123456789")] + [(30, "s1", None, "de", "alone")]
    rows += [(1000 + i, f"s{i % 7}", "x", "de", "one" if i < 2 else "of very many") for i in range(3000)]
    e = spark.createDataFrame(rows, "id long, source_key string, edition string, lang string, body string")
    groups = spark.createDataFrame([(i // 20 if i < 30 else 7 if i < 1000 else 9, i) for i, *_ in rows] + [(0, 5), (0, 999), (None, 2), (0, None)], "group_id long, id long")
    sources = spark.createDataFrame([(f"s{i}", None) for i in range(7)] + [("rev", "errata")], "source_key string, kind string")
    got = {(r.id, r.other_id, r.kind) for r in resolve.other_versions(e, groups, sources).collect()}
    assert got == {(2, 5, "foreign"), (2, 6, "foreign"), (20, 23, "conflict"), (1000, 1002, "conflict"), (1000, 1003, "conflict")}
    assert resolve.other_versions(e.limit(0), groups, sources).collect() == []


def test_every_character_composes(spark):
    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not unicodedata.is_normalized("NFC", chr(c))]
    rng = random.Random(5)
    marks = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "M"]
    texts = odd + ["aeo"[i % 3] + m for i, m in enumerate(marks)] + ["".join(rng.choice(odd + marks + list("aeiouy\u1100\u1161\u11a8")) for _ in range(6)) for _ in range(2000)]
    texts += [None, "", "a\u00a0b\u00adc<br>d<BR/>", "<!-- Start of picture text -->x<!-- End of picture text -->", "plain", "plain"]
    want = [t if t is None else re.sub("<!-- (?:Start|End) of picture text -->", "", re.sub(r"(?i)<br\s*/?>", " ", unicodedata.normalize("NFC", t).replace("\u00ad", "").replace("\u00a0", " "))) for t in texts]
    got = etl.composed_texts(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").orderBy("id").collect()
    assert [r.text for r in got] == want


def test_facets_of_parts_are_read_by_all_cores(spark, sf):
    """A small file is read by one task; the work on its rows is dealt."""
    from lorekeep.plans.facet_queries import _creatures, _spells

    assert _spells(spark, sf).rdd.getNumPartitions() > 4 and _creatures(spark, sf).rdd.getNumPartitions() > 4


def test_names_that_many_entries_have_are_compared_once(spark, monkeypatch):
    import pandas as pd

    from lorekeep.operators import fulltext

    entries = spark.createDataFrame([(i, "large ring" if i % 2 else "large rings") for i in range(200)] + [(7, "large ring"), (None, None)], "id int, name string")
    asked = spark.createDataFrame([(1, "lage ring"), (2, "large ring")], "query_id int, query string")
    compared = spark.sparkContext.accumulator(0)

    from lorekeep.functions.fuzzy import weighted
    from pyspark.sql import functions as F

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        compared.add(len(a))
        return pd.Series([weighted(x, y) for x, y in zip(a, b)], dtype="float64")

    monkeypatch.setattr(fulltext, "weighted_ratio", counted)
    out = fulltext.fuzzy_names(entries, asked, 3).collect()
    assert {(r["query_id"], r["place"], r["id"]) for r in out} == {(q, p, 2 * p - 1) for q in (1, 2) for p in (1, 2, 3)}
    assert compared.value <= 8  # two questions, two names


def test_texts_are_made_rows_of_in_slices(spark, monkeypatch):
    """A slice's rows are handed on before the next is read; none is lost between them."""
    from lorekeep.operators import etl, graders

    monkeypatch.setattr(etl, "SLICE", 2)
    monkeypatch.setattr(graders, "SLICE", 2)
    docs = spark.createDataFrame([(i, 0, f"# A{i}\nbody of it {i}\n## B\nmore of it") for i in range(5)], "id int, case int, text string").coalesce(1)
    parts = etl.chunks(docs, "id", "text").groupBy("id").count().collect()
    assert sorted(r["id"] for r in parts) == list(range(5)) and len({r["count"] for r in parts}) == 1
    rules = spark.createDataFrame([(1, 0, "has", "it 3", 0), (2, 0, "lacks", "zz", 0)], "rule_id int, case int, kind string, value string, n int")
    assert sorted(map(tuple, graders.graded(docs, rules).collect())) == sorted([(i, 1, i == 3) for i in range(5)] + [(i, 2, True) for i in range(5)])
    pages = spark.createDataFrame([(i, f"<h1>T{i}</h1><p>x</p>") for i in range(5)], "page_id int, html string").coalesce(1)
    assert {r["page_id"]: f"T{r['page_id']}" in r["markdown"] for r in etl.html_to_markdown(pages).collect()} == dict.fromkeys(range(5), True)
