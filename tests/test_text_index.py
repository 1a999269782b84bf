"""The stored index against the search over texts."""

import tracemalloc
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import fulltext, text_index
from lorekeep.operators.components import _checkpointed
from lorekeep.plans.search_queries import searches
from lorekeep.sources import corpus


def new_root(spark):
    return f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/index-{uuid.uuid4().hex}"


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def made(spark, sf):
    e = _checkpointed(corpus.entries(spark, sf), "entries")
    return e, text_index.build(e, new_root(spark))


def test_index_equals_search(spark, made, monkeypatch):
    e, index = made
    asked = searches(spark).unionByName(e.where("id % 20 = 0").select((F.col("id") + 100).cast("int").alias("query_id"), F.col("name").alias("query")))
    for k in (1, 3, 10):
        assert rows(index.search(asked, k)) == rows(fulltext.search(e, asked, k))
    monkeypatch.setattr(text_index, "FIRST", 1)
    assert rows(index.search(asked, 2)) == rows(fulltext.search(e, asked, 2))
    monkeypatch.setattr(text_index, "TESTED", 2)
    assert rows(index.search(asked, 10)) == rows(fulltext.search(e, asked, 10))
    cond = "edition = '2024' AND category = 3"
    assert rows(index.search(asked, 5, cond)) == rows(fulltext.search(e.where(cond), asked, 5))


def test_texts_and_other_letters_are_not_read(spark, made):
    _, index = made
    plan = index._blocks(["th", "qu"], [2]).select("prefix", "top")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(initial" in plan or "PartitionFilters: [initial" in plan
    assert "StringStartsWith(term,th)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "documents.parquet" not in plan


def test_one_source_is_replaced(spark, made, sf):
    e, index = made
    before = {r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{index.root}/postings").select("path").collect()}
    new = e.where("source_key = 'src3' and id % 2 = 0").withColumn("body", F.concat(F.lit("entirely new words here "), "body"))
    changed = index.replace("src3", new)
    want = e.where("source_key <> 'src3'").unionByName(new)
    asked = searches(spark).unionByName(spark.createDataFrame([(50, "entirely new"), (51, "entirelyn"), (52, "the the")], "query_id int, query string"))
    assert rows(changed.search(asked, 7)) == rows(fulltext.search(want, asked, 7))
    assert rows(index.search(asked, 7)) == rows(fulltext.search(e, asked, 7))  # readers of the old version
    after = {r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{index.root}/postings").select("path").collect()}
    part = index.sources["src3"]["part"]
    assert before <= after and all(f"part={part}" in p for p in after - before)
    gone = changed.replace("src3", e.where("false"))
    assert rows(gone.search(asked, 7)) == rows(fulltext.search(e.where("source_key <> 'src3'"), asked, 7))
    assert text_index.TextIndex(spark, index.root, index.docs_schema).number == 3


def test_odd_entries(spark):
    data = [(1, "s", "Étude", "xylophone " * 3), (2, "s", None, None), (3, None, "", ""), (4, "t/ü =", "x" * 40, "X" * 40 + " y"), (None, "s", "lost", "lost"), (5, "s", "9 lives", "日本 語")]
    e = spark.createDataFrame(data, "id long, source_key string, name string, body string")
    index = text_index.build(e, new_root(spark))
    asked = spark.createDataFrame([(1, "etude"), (2, "x" * 20), (3, "9"), (4, "日"), (5, ""), (6, None), (7, "lost"), (8, "xyl etu")], "query_id int, query string")
    assert rows(index.search(asked)) == rows(fulltext.search(e.where("id is not null"), asked))
    assert index.docs.count() == 5
    empty = text_index.build(e.where("false"), new_root(spark))
    assert empty.search(asked).count() == 0


def test_a_slab_is_filed_at_once():
    """Blocks and counts of beginnings of a slab come from its rows alone, so that a text's words are dealt once."""
    import pyarrow as pa

    data = [(7, "ab abc", "ab  x ab"), (3, "", " abcdefgh"), (5, "é", "")]
    slab = pa.table({"part": ["p"] * 3, "slab": [4] * 3, "id": [d[0] for d in data], "size": [5, 1, 1], "name": [d[1] for d in data], "body": [d[2] for d in data]})
    out = text_index._filed(slab).to_pylist()
    blocks = {r["term"]: (r["n"], r["top"], r["least"], r["ids"], r["weights"], r["sizes"]) for r in out if r["ids"] is not None}
    assert blocks == {"ab": (1, 12.0, 5, [7], [12.0], [5]), "abc": (1, 10.0, 5, [7], [10.0], [5]), "x": (1, 1.0, 5, [7], [1.0], [5]), "abcdefgh": (1, 1.0, 1, [3], [1.0], [1]), "é": (1, 10.0, 1, [5], [10.0], [1])}
    begins = {r["term"]: r["n"] for r in out if r["ids"] is None}
    assert begins == {"a": 2, "ab": 2, "abc": 2, "abcd": 1, "abcde": 1, "abcdef": 1, "x": 1, "é": 1} and all(r["slab"] == 4 and r["part"] == "p" for r in out)


def test_many_queries_meet_blocks_in_tiles(spark, made, monkeypatch):
    """A tile keeps k entries of a query: rows of all its hits are not dealt again."""
    e, index = made
    monkeypatch.setattr(text_index, "TESTED", 2)
    monkeypatch.setattr(text_index, "SMALL_TILE", 64)
    monkeypatch.setattr(text_index, "DENSE", 3)
    asked = spark.createDataFrame([(1, "the of"), (2, "th th"), (3, "of the"), (4, "queue zzzz"), (5, "")], "query_id int, query string")
    made_of = index.search(asked, 3)
    assert rows(made_of) == rows(fulltext.search(e, asked, 3))
    assert "FlatMapCoGroupsInArrow" in made_of._jdf.queryExecution().toString()


def test_equal_scores_of_a_tile_go_by_id():
    import pyarrow as pa

    blocks = pa.table({"term": ["ab", "a", "b"], "ids": [[9, 3, 5, 7, 8, 1, 2], [4], [9]], "weights": [[1.0] * 7, [1.0], [2.0]], "sizes": pa.array([[4] * 7, [4], [4]], pa.list_(pa.int32()))})
    sets = pa.table({"number": [5, 6, 7], "words": ["a", "a b", "z"], "idfs": [[1.0], [1.0, 1.0], [1.0]]})
    out = text_index._best_of_tile(blocks, sets, 1, 4.0).to_pylist()
    assert min(r["id"] for r in out if r["number"] == 5) == 1 and len([r for r in out if r["number"] == 5]) == 2
    assert [r["id"] for r in out if r["number"] == 6] == [9] and not [r for r in out if r["number"] == 7]


def test_a_tile_holds_little_beside_its_postings():
    """And its k best are those of a plain reading, however few words are remembered."""
    rng = np.random.default_rng(2)
    terms, entries, each = sorted(f"{a}{b}" for a in "abcdefgh" for b in "abcdefghijklmnopqrstuvwxyz"), 4_000, 2_000
    size = rng.integers(100, 900, entries)
    owners = [np.sort(rng.choice(entries, each, replace=False)) for _ in terms]
    weights = [rng.integers(1, 9, each).astype(np.float64) for _ in terms]
    ends = np.arange(0, each * len(terms) + 1, each, dtype=np.int32)
    lists = lambda x: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x)))
    blocks = pa.table({"tile": np.zeros(len(terms), np.int64), "term": terms, "ids": lists([3 * o + 5 for o in owners]), "weights": lists(weights), "sizes": lists([size[o].astype(np.int32) for o in owners])}).take(rng.permutation(len(terms)))
    idf = {w: 0.5 + i % 4 for i, w in enumerate(terms)}
    asked = [sorted(rng.choice(terms, 3, replace=False)) for _ in range(40)]
    sets = pa.table({"tile": np.zeros(len(asked), np.int64), "number": np.arange(len(asked)), "words": [" ".join(a) for a in asked], "idfs": [[idf[w] for w in a] for a in asked]})
    tracemalloc.start()
    got = text_index._best_of_tile(blocks, sets, 10, 400.0).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * blocks.nbytes
    norm, of = 1.2 * (0.25 + 0.75 * size / 400.0), dict(zip(terms, zip(owners, weights)))
    for number, words in enumerate(asked):
        score, met = np.zeros(entries), np.ones(entries, bool)
        for w in words:
            f = np.zeros(entries)
            f[of[w][0]] = of[w][1]
            score, met = score - idf[w] * f * 2.2 / (f + norm), met & (f > 0)
        want = sorted((round(score[i], 9), 3 * i + 5) for i in np.flatnonzero(met))[:10]
        mine = sorted((round(s, 9), i) for i, s in got[got.number == number][["id", "score"]].itertuples(index=False))[:10]
        assert [i for _, i in mine] == [i for _, i in want]
