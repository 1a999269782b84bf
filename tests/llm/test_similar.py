"""Near-dedup and nearest neighbours against brute force."""

import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lorekeep.llm import ann, minhash_dedup, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(texts, k, percent):
    """Least reachable id of every id of texts."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j < i}:
            shared = len(s & sets[j])
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_op1(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").text.to_dict()
    got = queries.op1_minhash_dedup(spark, sf).toPandas().set_index("doc_id")
    want, sizes = brute(texts, 3, 85)
    assert got.component_id.to_dict() == want and got.n_shingles.to_dict() == sizes
    assert got.kept.to_dict() == {i: i == c for i, c in want.items()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("k,percent", [(5, 80), (3, 85)])
def test_large_groups_of_near_copies(spark, k, percent):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for group in range(2):
        base = rng.choice(words, 300).tolist()
        for i in range(150):
            copy = list(base)
            for at in rng.integers(0, 300, int(rng.integers(0, 9))):
                copy[at] = f"x{rng.integers(1 << 30)}"
            texts[group * 1000 + i] = " ".join(copy)
    texts |= {5000 + i: " ".join(rng.choice(words, 80)) for i in range(40)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame, k, percent).collect()}
    want, _ = brute(texts, k, percent)
    assert got == want


def test_links_in_a_large_group_below_the_threshold(spark):
    rng = np.random.default_rng(7)
    shared, n, pairs = 261, 5000, 150  # background 0.77; two that share six or more of their other words reach 0.8
    own = [[f"o{i}_{j}" for j in range(39)] for i in range(n)]
    for i in range(pairs):
        more = int(rng.integers(5, 12))
        own[n - 1 - i][:more] = own[i][:more]
    texts = {i: " ".join([*(f"t{j}" for j in range(shared)), *own[i]]) for i in range(n)}
    want = {i: i for i in range(n)}
    for i in range(pairs):
        both = shared + len(set(own[i]) & set(own[n - 1 - i]))
        if 100 * both >= 80 * (600 - both):
            want[n - 1 - i] = i
    assert 100 * shared < 80 * (600 - shared) and 0 < sum(i != c for i, c in want.items()) < pairs
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame, 1, 80).collect()}
    assert got == want


def test_every_planted_link_of_a_large_template_is_found(spark):
    n, shared, own, both = 4000, 300, 51, 30  # a template below the threshold (0.746) and pairs above it (0.887)
    text = lambda i: " ".join([*(f"t{j}" for j in range(shared)), *(f"p{i // 2}_{j}" for j in range(both)), *(f"o{i}_{j}" for j in range(own - both))])
    frame = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id long, text string").repartition(8)
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame, 1, 85).collect()} == {i: i - i % 2 for i in range(n)}


def test_repeated_ids_get_what_their_least_text_gives(spark):
    rows = [(1, "a b c d"), (2, "x y z w"), (2, "a b c d"), (2, None), (3, "x y z w"), (None, "a b c d")]
    for parts in (1, 3):
        got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), 3, 85).collect()
        assert sorted((r.doc_id or 0, r.component_id, r.n_shingles) for r in got if r.doc_id) == [(1, 1, 2), (2, 1, 2), (2, 1, 2), (2, 1, 2), (3, 3, 2)] and len(got) == 6


def test_whole_nodes_equal_brute_force(monkeypatch, spark):
    monkeypatch.setattr(minhash_dedup, "WHOLE", 40)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(f"x{rng.integers(40)}" if rng.random() < 0.2 else w for w in base) for i in range(150)}
    component = {i: i // 2 * 2 for i in texts}
    nodes = spark.createDataFrame([(1, i, c) for i, c in component.items()], "path long, doc_id long, component long")
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = [tuple(r) for r in minhash_dedup.whole_links(nodes, frame, 1, 70).collect()]
    sets = {i: shingles(t, 1) for i, t in texts.items()}
    linked = {(i, j) for j in sets for i in range(j) if component[i] != component[j] and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])}
    assert got and set(got) <= linked

    def groups(edges):
        root = dict(component)
        for a, b in edges:
            low, high = sorted((root[a], root[b]))
            root = {i: low if c == high else c for i, c in root.items()}
        return root

    assert groups(got) == groups(linked) != component


@pytest.mark.parametrize("percent,hashes,matching", [(80, 192, 133), (80, 1024, 771), (85, 192, 145), (85, 1024, 827)])
def test_estimates_of_linked_pairs_may_be_low(percent, hashes, matching):
    match = percent / 100 + (1 - percent / 100) / 256
    assert matching >= hashes * match - 3.9 * (hashes * match * (1 - match)) ** 0.5 > matching - 1
    sig = np.zeros((2, hashes), dtype=np.uint8)
    sig[1, matching:] = 1
    assert [p.shape[1] for p in minhash_dedup._similar(np.array([1, 2]), np.array([100, 100]), sig, np.array([0, 2]), percent)] == [1]


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(20000))
    rows = [(5, None), (6, ""), (7, " \n"), (8, "One two"), (4, "one TWO"), (9, "É two"), (3, "é two"), (2, long), (1, long + " end"), (None, "one two"), (8, "One two"), (11, "one")]
    frame = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, n int, component_id string")
    got = minhash_dedup.near_duplicates(frame, 3, 85).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {i: r.component_id for i, r in by.items()} == {5: 5, 6: 6, 7: 7, 8: 4, 4: 4, 9: 9, 3: 3, 2: 1, 1: 1, None: None, 11: 11}
    assert by[None].kept and by[5].n_shingles == 0 and by[8].n_shingles == 1 and not by[8].kept
    assert minhash_dedup.near_duplicates(frame.where("false")).count() == 0


def nearest(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[ids == ids[q]] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), d[i]) for i in order if np.isfinite(d[i])]


def test_op7(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), dtype=float)
    got = queries.op7_nearest_neighbours(spark, sf).toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, len(mine) + 1)) and list(zip(mine.score, mine.vec_id)) == sorted(zip(mine.score, mine.vec_id))
        assert np.allclose(mine.score, np.sqrt(((x[np.searchsorted(ids, mine.vec_id)] - x[q]) ** 2).sum(axis=1)), rtol=1e-12)
        want = nearest(ids, x, q, 10)
        hits, total = hits + len({i for i, _ in want} & set(mine.vec_id)), total + len(want)
    assert hits >= 0.9 * total


def test_recall_on_more_vectors(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))])
    ids = np.arange(3000)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(frame, frame.where("vec_id % 100 = 0")).toPandas()
    hits = sum(len({i for i, _ in nearest(ids, x, q, 10)} & set(got[got.query_id == q].vec_id)) for q in range(0, 3000, 100))
    assert hits >= 0.9 * 300


def clustered(n, d=16, seed=5):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n // 75, d))[rng.integers(0, n // 75, n)] + 0.1 * rng.normal(size=(n, d))


def test_leaves_that_branch_on_keep_the_recall(monkeypatch, spark):
    monkeypatch.setattr(ann, "SAMPLE", 512)
    monkeypatch.setattr(ann, "SMALL", 40)
    monkeypatch.setattr(ann, "BRANCHED", 10)
    monkeypatch.setattr(ann, "LEAF_ROWS", 60)
    x, ids = clustered(6000), np.arange(6000)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    got = ann.search(frame, frame.where("vec_id % 100 = 0")).toPandas()
    hits = 0
    for q in range(0, 6000, 100):
        mine = got[got.query_id == q].sort_values("rank")
        hits += len({i for i, _ in nearest(ids, x, q, 10)} & set(mine.vec_id))
        assert np.allclose(mine.score, np.sqrt(((x[mine.vec_id] - x[q]) ** 2).sum(axis=1)), rtol=1e-12)
    assert hits >= 0.9 * 600


def test_clustered_vectors_need_few_leaves_and_bounds_let_few_through():
    x = clustered(40_000, 32)
    forest = ann.Forest(x[:8000], len(x))
    leaves, probes = forest.index(x), x[:64]
    near = [np.argsort(((x - q) ** 2).sum(axis=1))[1:11] for q in probes]
    forest.measure(probes, np.repeat(np.arange(64), 10), leaves[np.concatenate(near)])
    seen = hits = 0
    for q in range(1000, 1100):
        found, bound = forest.search(x[q])
        at = np.isin(leaves, found).any(axis=1)
        seen += at.sum()
        hits += at[np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11]].sum()
        assert len(found) == forest.visits and bound < np.inf
    assert seen < 0.05 * 100 * len(x) and hits > 900


def test_leaves_within_a_bound_are_those_of_that_margin():
    x = clustered(2000)
    tree = ann.Tree(x, 5, np.random.default_rng(1))
    bounds = np.linspace(0, 2, 20)
    query, leaf = tree.within(x[:20], bounds)
    for i in range(20):
        assert sorted(leaf[query == i]) == np.flatnonzero(tree.margins(x[i]) <= bounds[i]).tolist()


def test_exact_nearest_of_few_and_equal_vectors():
    x = np.array([[1.0, 0], [1, 0], [0, 1], [1, 1e-9], [5, 5]])
    (i, j, d), = ann._nearest_of(x, x[:1], 3)
    assert i.tolist() == [0, 0, 0] and j.tolist() == [0, 1, 3] and d.tolist() == [0, 0, 1e-9]
    (_, j, _), = ann._nearest_of(x[:2], x[:1], 9)
    assert j.tolist() == [0, 1]


def test_copies_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100, 130)] + [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (1, [0.0, 1.0])]
    frame = spark.createDataFrame([(*r, "v", 1) for r in rows], "vec_id long, embedding array<double>, v string, leaf int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(frame, frame.where("vec_id in (0, 1, 2, 3, 100)")).collect()}
    assert [got[0, k][0] for k in range(1, 11)] == list(range(100, 110)) and [got[100, k][0] for k in range(1, 11)] == [0, *range(101, 110)]
    assert [got[1, k] for k in range(1, 11)] == [(0, pytest.approx(2**0.5)), *[(i, pytest.approx(2**0.5)) for i in range(100, 109)]]
    assert len(got) == 30
    assert ann.search(frame.where("false"), frame.where("false")).count() == 0
    one = frame.where("vec_id = 0")
    assert ann.search(one, one).count() == 0
