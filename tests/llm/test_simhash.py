"""SimHash near-dedup against brute force."""

import re

import numpy as np
import pytest
import xxhash

from lorekeep.llm import queries, simhash_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
M64 = (1 << 64) - 1


def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, distance):
    """Least row number that each of points (unsigned) reaches."""
    value = np.array(points, dtype=np.uint64)
    label = list(range(len(points)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(value[:i] ^ value[i]) <= distance).tolist():
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def test_op13(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    got = queries.op13_simhash_dedup(spark, sf).toPandas().sort_values("doc_id")
    prints = [brute_fingerprint(t, 4) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    ids = docs.doc_id.tolist()
    assert got.component_id.tolist() == [ids[i] for i in brute_components(prints, 4)]


@pytest.mark.parametrize("distance, blocks", [(4, 3), (4, 2), (3, 3), (6, 3), (1, 2), (0, 3)])
def test_linked_points_meet_at_a_home(distance, blocks):
    rng = np.random.default_rng(distance)
    x = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    y = np.array([v ^ np.uint64(sum(1 << int(p) for p in rng.choice(64, distance, replace=False))) for v in x], dtype=np.uint64)
    met = np.zeros(len(x), dtype=bool)
    for code in simhash_dedup.coverings(distance, blocks):
        anchors, at, home = code.meet(x)
        own = dict(zip(at[home].tolist(), anchors[home].tolist()))
        assert len(own) == len(x) == home.sum()
        anchors, at, _ = code.meet(y)
        come = set(zip(at.tolist(), anchors.tolist()))
        met |= np.array([(i, own[i]) in come for i in range(len(x))])
    assert met.all()


@pytest.mark.parametrize("small, rows, comparisons", [(2048, 1 << 16, 1 << 26), (4, 1 << 16, 1 << 26), (4, 40, 1 << 26), (4, 1 << 16, 200)])
def test_dense_and_large_anchors_lose_no_component(spark, monkeypatch, small, rows, comparisons):
    """Points around a few centres, some chained, also where anchors are put off and dealt to blocks."""
    for name, value in (("SMALL", small), ("ROWS", rows), ("COMPARISONS", comparisons), ("HOMES", 16), ("GUESTS", 64)):
        monkeypatch.setattr(simhash_dedup, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    rng = np.random.default_rng(5)
    points = set()
    for centre in rng.integers(0, 1 << 64, 6, dtype=np.uint64).tolist():
        at = centre
        for _ in range(120):
            points.add((centre ^ sum(1 << int(b) for b in rng.choice(14, 3))) & M64)
            at ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            points.add(at)
    points = sorted(points)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in points], "point long").repartition(3)
    met = simhash_dedup.meetings(frame, simhash_dedup.coverings(4, 3))
    found = simhash_dedup.near_points(met, 4).cache()
    late = found.where("b is null and homes > 0").selectExpr("a as anchor", "homes", "rows")
    found.count(), spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (late.count() > 0) == (rows < 100 or comparisons < 1000)
    links = found.where("b is not null").select("a", "b").unionByName(simhash_dedup.near_points_dealt(met, late, 4)).collect()
    number = {int(np.uint64(p).astype(np.int64)): i for i, p in enumerate(points)}
    label = list(range(len(points)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        assert 0 < bin((a ^ b) & M64).count("1") <= 4
        x, y = find(number[a]), find(number[b])
        label[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(points))] == brute_components(points, 4)


def test_odd_rows(spark):
    rows = [(5, "one two three four five"), (3, "one two three four five"), (None, "one two three four five"), (9, None), (8, ""), (7, " \t\n"), (1, "ONE two x"), (1, "other words"), (2, "x " * 50_000), (4, "X\n" * 50_000)]
    frame = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, point string, component_id int")
    got = sorted(map(tuple, simhash_dedup.near_duplicates(frame, 4).collect()), key=repr)
    hexed = lambda t: f"{brute_fingerprint(t, 4):016x}"
    base = hexed(rows[0][1])
    want = [(5, base, 3), (3, base, 3), (None, base, None), (9, "0" * 16, 7), (8, "0" * 16, 7), (7, "0" * 16, 7), (1, hexed(rows[6][1]), 1), (1, hexed(rows[7][1]), 1), (2, hexed("x x x x"), 2), (4, hexed("x x x x"), 2)]
    assert got == sorted(want, key=repr)
    assert simhash_dedup.near_duplicates(frame.limit(0), 4).count() == 0
