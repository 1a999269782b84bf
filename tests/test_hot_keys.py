"""Names that hold most rows: bounded rows, whole results."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import fuzzy
from lorekeep.operators import components, etl, glossary


def brute_alternatives(pairs, terms, cap):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = set()
    for t in terms:
        one = near.get(t, set())
        two = {c for b in one for c in near[b]} - one - {t}
        ranked = sorted((1, b) for b in one) + sorted((2, c) for c in two)
        out |= {(t, b, h) for h, b in ranked[:cap]}
    return out


def test_a_target_with_twenty_thousand_names(spark):
    pairs = [(f"name{i:05d}", "hub") for i in range(20_000)] + [("name00000", "other"), ("lone", "pair"), ("pair", "third"), ("third", "fourth")] + [("lone", f"x{i}") for i in range(7)] + [(f"x{i}", f"y{j}") for i in range(7) for j in range(30)]
    g = spark.createDataFrame(pairs, "term string, target string")
    terms = sorted({a for a, _ in pairs} | {b for _, b in pairs})
    began = time.time()
    got = {tuple(r) for r in glossary.alternatives(g, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert time.time() - began < 60
    some = {t for t in terms if not t.startswith("name") or t < "name00005" or t > "name19997"}
    assert {r for r in got if r[0] in some} == brute_alternatives(pairs, some, 8) and len({r[0] for r in got}) == len(terms)


@pytest.mark.parametrize("least", [88.0, 75.0])
def test_suggestions_by_rare_pairs_lose_nothing(spark, least):
    """Names that all share their frequent pairs."""
    rng = random.Random(4)
    names = sorted({"aaaa" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) + rng.choice(["", "xyz", "qr"]) for _ in range(300)} | {"x", "xy"})
    asked = sorted({n[: (k := rng.randint(0, len(n)))] + rng.choice(["", "a", "z"]) + n[k + rng.randint(0, 1) :] for n in names[::5]} - {""})
    got = glossary.suggest(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(a,) for a in asked], "asked string"), least, 1000)
    want = {(a, n, round(fuzzy.indel(a, n), 4)) for a in asked for n in names if round(fuzzy.indel(a, n), 4) >= least}
    assert {(r.asked, r.name, round(r.score, 4)) for r in got.collect()} == want


def test_terms_are_looked_for_at_their_first_words(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "the red dragon and the Red dragon's hoard"), (2, None), (3, ""), (4, "dragon red"), (5, "red")], "id long, body string")
    terms = spark.createDataFrame([("Red Dragon",), ("hoard",), ("dragon",), ("the red",), ("red dragon s hoard",)], "term string")
    want = {(1, "red dragon"), (1, "hoard"), (1, "dragon"), (1, "the red"), (1, "red dragon s hoard"), (4, "dragon")}
    for first_words in (10_000, 1):
        monkeypatch.setattr(glossary, "FIRST_WORDS", first_words)
        assert {tuple(r) for r in glossary.spot(texts, terms).collect()} == want


def test_parts_of_long_strings_are_compared_quickly():
    rng = random.Random(5)
    a, b = "".join(rng.choice("abcdefgh ") for _ in range(200)), "".join(rng.choice("abcdefgh ") for _ in range(4000))
    began = time.process_time()
    fuzzy.partial(a, b[:2000] + a[:150] + b[2000:])
    assert time.process_time() - began < 0.3


def test_a_cycle_among_many_nodes(spark):
    n = 200_000
    nodes = spark.range(n).select("id", F.when(F.col("id") == 0, None).when(F.col("id") == 7, 8).when(F.col("id") == 8, 7).otherwise(F.floor(F.col("id") / 10)).alias("parent_id"), F.concat(F.lit("n"), "id").alias("name"))
    with pytest.raises(ValueError):
        etl.parent_chain(nodes)
    edges = nodes.select(F.col("id").alias("node"), F.col("parent_id").alias("up"))
    endless = {r[0] for r in components.endless_chains(edges).collect()}
    assert {7, 8, 70, 71, 89, 899} <= endless and not {1, 6, 9, 90, 699} & endless
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "node long, up long")
    assert components.endless_chains(chain).count() == 0
