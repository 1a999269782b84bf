"""Importance resampling against a plain reading of its definition."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lorekeep.llm import resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest, buckets, seed, least_words, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for held, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            held.update(map(bucket, features(x, longest)[1]))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    out, drawn = [], []
    for key, text in docs:
        words, runs = features(text, longest)
        weight = sum(gain[bucket(f)] for f in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
        score = None if key is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(runs), weight, score, None])
        if len(words) >= least_words and key is not None:
            drawn.append(out[-1])
    drawn.sort(key=lambda r: (-r[3], r[0], r[1]))
    for i, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("longest, nodes", [(1, 500_000), (2, 500_000), (3, 20)])
def test_resampling_equals_its_definition(spark, sf, monkeypatch, longest, nodes):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(150).collect()]
    docs += [(None, "a null id with words of its own"), (5_000, None), (5_001, ""), (5_002, ".-!?"), (5_003, "Ünï cödé 123 " * 3000), (7, "a second text of seven"), (7, "a second text of seven"), (5_004, "ab1\x00cd")]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(20).collect()] + [None, ""]
    monkeypatch.setattr(resampling, "NODES", nodes)
    monkeypatch.setattr(resampling, "SLICE", 2_000)
    frame = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, score int").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(frame, aim, longest, 997, "s", 5, 30)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target, longest, 997, "s", 5, 30)
    kept = resampling.drawn(frame, got)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got.where("rank is not null").collect()}


def test_tries_start_anew(monkeypatch):
    monkeypatch.setattr(resampling, "NODES", 10)
    monkeypatch.setattr(resampling, "SLICE", 30)
    texts = ["alpha beta gamma delta epsilon zeta"] * 5 + ["eta theta iota kappa lambda"] * 3
    trie = resampling.WordTrie(2, 101)
    trie.take(texts)
    want = Counter(zlib.crc32(f.encode()) % 101 for t in texts for f in features(t, 2)[1])
    assert dict(enumerate(trie.flush().tolist())) == {b: want[b] for b in range(101)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert resampling.resample(empty, empty).count() == 0
    assert [r["rank"] for r in resampling.resample(some, empty, least_words=1, percent=100).collect()] == [1]


def test_one_id_may_hold_most_rows(spark):
    rows = [(1, "x " * 30)] * 400 + [(i, "y " * 30) for i in range(2, 50)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("x",)], "text string"), percent=50).toPandas()
    assert len(got) == 448 and sorted(got["rank"].dropna().astype(int)) == list(range(1, 225))
    assert np.all(np.diff(got.dropna().sort_values("rank").score) <= 0)
