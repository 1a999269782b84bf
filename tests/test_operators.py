import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import align, details, etl, facets, glossary, options, predicates, resolve, rules, sessions
from lorekeep.operators.components import connected_components
from lorekeep.plans import queries
from lorekeep.sources import corpus
from lorekeep.streaming import gates


def pairs(frame):
    return {tuple(r) for r in frame.collect()}


def test_components_of_a_path_a_cycle_and_repeats(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (100, 101), (7, 7), (None, 5)]
    found = dict(pairs(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {i: 1 for i in range(1, 41)} | {i: 100 for i in (100, 101, 102)}


def test_components_without_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_revisions_never_join_a_group(spark):
    rows = [(1, "a", "Fire (x)", "2024", 1), (2, "b", "fire", "2024", 1), (3, "err", "Fire", "2024", 1), (4, "b", "Fire", "2014", 1), (5, "b", "Fire", "2024", 2)]
    e = spark.createDataFrame(rows, "id long, source_key string, name string, edition string, category int")
    groups = dict(pairs(resolve.entity_groups(e, spark.createDataFrame([("err",)], "source_key string"))))
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_bridges_join_names(spark):
    e = spark.createDataFrame([(1, "a", "Feuerball", "2024", 1), (2, "b", "Fireball", "2024", 1), (3, "b", "Delayed Fireball", "2024", 1)], "id long, source_key string, name string, edition string, category int")
    bridges = spark.createDataFrame([("feuerball", "fireball")], "a string, b string")
    assert dict(pairs(resolve.entity_groups(e, spark.createDataFrame([], "source_key string"), bridges))) == {1: 1, 2: 1, 3: 3}


def test_prefilter_changes_nothing(spark):
    rows = [(1, "CR 1/4 x"), (2, "CR 3.0 y"), (3, "no head"), (4, "CR 0.25")]
    e = spark.createDataFrame(rows, "id long, body string")
    value = facets.challenge(F.col("body"))
    seeded = e.where("id <> 4").select("id", value.alias("challenge"))
    with_it = pairs(facets.prefiltered(e, seeded, "challenge", "1/4", value == "1/4").select("id"))
    assert with_it == pairs(e.where(value == "1/4").select("id")) == {(1,), (4,)}


def test_prices_by_language(spark):
    e = spark.createDataFrame([("1.234,50 GM", True), ("1,234.50 gp", False), ("nothing", False)], "t string, de boolean")
    assert [r[0] for r in e.select(facets.price_cents(F.col("t"), F.col("de"))).collect()] == [123450, 123450, None]


def test_replacement_is_guarded(spark):
    old = spark.createDataFrame([(i, "s") for i in range(10)] + [(99, "t")], "id long, source_key string")
    with pytest.raises(ValueError):
        etl.guarded_replace(old, old.where("id < 3"), "s")
    with pytest.raises(ValueError):
        etl.guarded_replace(old, old.where("id < 0"), "s")
    assert etl.guarded_replace(old, old.where("id < 6"), "s").count() == 7


def test_parent_cycles_are_errors(spark):
    nodes = spark.createDataFrame([("a", "b", "A"), ("b", "a", "B")], "id string, parent_id string, name string")
    with pytest.raises(ValueError):
        etl.parent_chain(nodes)
    orphan = spark.createDataFrame([("a", "gone", "A"), ("b", "a", "B")], "id string, parent_id string, name string")
    assert pairs(etl.parent_chain(orphan)) == {("a", ""), ("b", "A")}


def test_chunks_keep_breadcrumb_page_and_deeper_headings():
    text = "# Book\n<!-- page 3 -->\n## One\nbody\n### Deep\nmore\n## Two\n\n# Next\nlast"
    got = etl.chunk_headings(text)
    assert [(c["name"], c["breadcrumb"], c["page"]) for c in got] == [("One", "Book", 3), ("Next", "", 3)]
    assert got[0]["body"] == "body\n### Deep\nmore"


def test_markdown_of_html():
    assert etl.markdown_of("<h2>T</h2><p>a <b>b</b><script>x</script> &amp; <a href='https://e.org'>l</a><ul><li>one<li>two</ul>") == "## T\n\na **b** & [l](https://e.org)\n\n- one\n- two"
    assert etl.markdown_of(None) == ""


@pytest.mark.parametrize("limit", [40, 200])
def test_split_text_loses_no_word(limit):
    text = "\n\n".join(f"paragraph {i} with some words" for i in range(20))
    parts = etl.split_text(text, limit)
    assert all(len(p) <= limit for p in parts) and " ".join(parts).split() == text.split()


def test_split_text_closes_fences():
    parts = etl.split_text("```py\n" + "\n".join(f"line {i}" for i in range(30)) + "\n```", 80)
    assert all(p.count("```") % 2 == 0 for p in parts)


def test_exact_suggestions_are_suggestions(spark):
    got = pairs(glossary.suggest(spark.createDataFrame([("aktionen",), ("elf",)], "name string"), spark.createDataFrame([("Reaktionen",), ("",)], "asked string")))
    assert got == {("Reaktionen", "aktionen", 88.8889)}


def test_null_is_a_value_of_a_fingerprint(spark):
    left, right = spark.createDataFrame([(1, None, 3), (2, "x", 4)], "id long, a string, b int"), spark.createDataFrame([(10, None, 3), (11, "y", 4)], "id long, a string, b int")
    assert pairs(align.unique_pairs(left, right, ["a", "b"])) == {(1, 10)}


def test_turns_join_and_drop_orphans(spark):
    rows = [(1, 0, "assistant", "hi"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "assistant", "b"), (1, 4, "user", "open")]
    assert pairs(sessions.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == {(1, 1, "q", "a\nb")}


def test_stream_admits_as_the_replay_does(spark, sf, tmp_path):
    events = corpus.table(spark, sf, "events")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.orderBy("ts").coalesce(1).write.parquet(source)
    stream = gates.cooldown_gate(spark.readStream.schema(events.schema).parquet(source), 3600.0)
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert pairs(spark.read.parquet(out)) == pairs(gates.replayed_gate(events, 3600.0))


def test_rejected_requests_do_not_count():
    rows = pd.DataFrame({"event_id": [1, 2, 3], "at": [0.0, 5.0, 12.0], "took": [1.0, 1.0, 1.0]})
    assert gates.admit(rows, float("-inf"), 10.0)[0]["admitted"].tolist() == [True, False, True]


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_elimination_runs_to_a_fixpoint_and_drops_contradictions(spark):
    rows = [("g", "l", "a"), ("g", "l", "b"), ("g", "r", "A"), ("g", "r", "B"), ("h", "l", "b"), ("h", "l", "c"), ("h", "r", "B"), ("h", "r", "C"), ("i", "l", "d"), ("i", "r", "D"), ("j", "l", "d"), ("j", "r", "E")]
    groups = spark.createDataFrame(rows, "group string, side string, term string")
    known = spark.createDataFrame([("a", "A")], "left string, right string")
    assert pairs(rules.forced_pairs(groups, known)) == {("a", "A"), ("b", "B"), ("c", "C")}


def test_elimination_follows_long_chains(spark):
    rows = [(i, side, f"{side}{j}") for i in range(14) for side in "lr" for j in (i, i + 1)]
    groups = spark.createDataFrame(rows, "group int, side string, term string")
    known = spark.createDataFrame([("l0", "r0")], "left string, right string")
    assert pairs(rules.forced_pairs(groups, known)) == {(f"l{i}", f"r{i}") for i in range(15)}


def test_corpus_adapters_give_nothing_for_odd_sources(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "xx", None), (2, "", "de", "weird")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: (r.name, r.edition) for r in corpus.entries(spark, str(tmp_path)).collect()}
    assert got == {1: (None, "2024"), 2: ("", "2024")}
    assert {r.priority for r in corpus.sources(spark, str(tmp_path)).collect()} == {None}


def test_cleaned_text_keeps_every_document(spark, tmp_path):
    rows = [(1, "soft\u00adhyphen<br/>next"), (2, None), (3, "two  spaces\u00a0here"), (4, "\u00ad")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert pairs(queries.cleaned_text(spark, str(tmp_path))) == {(1, "softhyphen\nnext"), (2, None), (3, "two spaces here"), (4, "")}


def test_long_chains_missing_parents_and_cycles(spark):
    chain = [(i, i - 1 if i else None, f"n{i}") for i in range(300)]
    rows = chain + [(1000, 999, "lost"), (1001, 1000, None), (1002, 1001, "x")]
    got = dict(pairs(etl.parent_chain(spark.createDataFrame(rows, "id long, parent_id long, name string"))))
    assert got[0] == "" and got[299] == " > ".join(f"n{i}" for i in range(299)) and (got[1000], got[1001], got[1002]) == ("", "lost", "lost")
    with pytest.raises(ValueError):
        etl.parent_chain(spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, None, "c")], "id long, parent_id long, name string"))
    assert etl.parent_chain(spark.createDataFrame([], "id long, parent_id long, name string")).count() == 0


def test_titles_lose_known_additions_alone(spark):
    titles = ["Curse: Options (D&D Beyond)", "Vol. 1 (Ship Creatures)", "(2014) (pdf)", "A's (2014) (en, PDF)", "A ()", None, "B (2014, x)"]
    e = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r[0] for r in e.select(rules.work_title(F.col("t"))).collect()] == ["Curse: Options", "Vol. 1 (Ship Creatures)", "(2014)", "A’s", "A ()", None, "B (2014, x)"]


def test_differing_versions_of_one_language(spark):
    rows = [(1, "de", "*Context: A*\nSame  text here"), (2, "de", "same text HERE"), (3, "de", "quite another thing"), (4, "en", "other language"), (5, "de", None), (6, "de", "more that differs a lot"), (7, "de", "and a fourth one, cut")]
    e = spark.createDataFrame(rows, "id long, lang string, body string")
    groups = e.select("id", F.lit(1).alias("group_id"))
    assert {r.other_id for r in resolve.divergent(e, groups).collect()} == {3, 6}


def test_book_values_and_records(spark):
    e = spark.createDataFrame([(1, {"str": 0}, {}), (2, {"str": 10}, {"str": 12}), (3, {"str": 10}, {"dex": 30}), (4, None, None)], "id int, a map<string,int>, b map<string,int>")
    assert [r[0] for r in e.orderBy("id").select(predicates.implausible(F.col("a"), F.col("b"))).collect()] == ["score", "save", None, None]


def test_details_take_names_as_they_are_written(spark):
    rows = [(1, "a", "The Anhely", "2024", 1, "en"), (2, "a", "THE ANHELY", "2024", 1, "en"), (3, "a", "the anhely", "2024", 1, "en")]
    e = spark.createDataFrame(rows, "id long, source_key string, name string, edition string, category int, lang string")
    g = spark.createDataFrame([("The Anhely", "Der Anhel", 0, 1), ("THE ANHELY", "DER ANHEL", 0, 2)], "term string, target string, official int, row_id long").withColumns({"edition": F.lit(None).cast("string"), "origin": F.lit(None).cast("string")})
    s = spark.createDataFrame([("a", 1, None, "free")], "source_key string, priority int, kind string, licence string")
    shown = dict(pairs(details.details(e, s, g, e.select("id")).select("id", "shown")))
    assert shown == {1: "Der Anhel* (The Anhely)", 2: "DER ANHEL* (THE ANHELY)", 3: "the anhely"}


def test_level_table_stays_in_its_row(spark):
    table = "| {} | b |\n|---|---|\n| 1 | x |\n| 2 | y | z |"
    texts = [(1, f"{table.format('first')}\n\n\n{table.format('second')}\n| 3 | w"), (2, None), (3, "no table"), (4, "| n | b |\n|---|---|\n| 21 | x |"), (5, "| n |\n|---|\n|  20  |\n\n\n| m | b |\n|---|---|\n| 1 | x |\n| two | y |"), (6, "| head |")]
    docs = spark.createDataFrame(texts, "id long, t string")
    got = options.level_table(docs, "id", "t")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, "first", "1"), (1, 1, "b", "x"), (1, 2, "first", "2"), (1, 2, "b", "y"), (1, 2, None, "z"), (5, 20, "n", "20")], key=str)
    assert "Exchange" not in got._jdf.queryExecution().toString()


def test_either_key_pairs_are_distinct_without_shuffling_them(spark):
    left, right = [(i % 23, i % 4 if i % 9 else None) for i in range(60)] + [(None, 1)], [(i % 31, i % 5 if i % 7 else None) for i in range(70)] + [(None, 2)]
    want = {(a, b) for a, k in left for b, m in right if (a is not None and a == b) or (k is not None and k == m)}
    a, b = (spark.createDataFrame(x, "id int, key int") for x in (left, right))
    for size in (1, 3, 8192):
        found = align.either_key_pairs(a, b, size)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want
        assert found._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Union")


def test_either_key_pairs_take_little_room(spark, tmp_path):
    """A file of many pairs takes far less than a byte for each."""
    a, b = spark.range(3001).select("id", F.lit(1).alias("key")), spark.range(10_000, 13_003).select("id", F.lit(1).alias("key"))
    align.either_key_pairs(a, b).write.parquet(str(tmp_path / "pairs"))
    found = spark.read.parquet(str(tmp_path / "pairs"))
    assert found.agg(F.count("*"), F.countDistinct("id"), F.countDistinct("match"), F.sum(F.col("match") - F.col("id"))).first() == (3001 * 3003, 3001, 3003, 3001 * sum(range(10_000, 13_003)) - 3003 * sum(range(3001)))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.25 * 3001 * 3003
