"""Quality rules and the quality classifier."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import quality_classifier, quality_rules, queries, text_stats


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
ODD = [None, "", " \n\t ", "one", "a b c d e a b c d e", "a b c d e f a b c d e f", "a " * 30, "x\n \nx\n\nx", "é# 漢| \x0b z\x85y\xa0v", "a b c d\ta b c d a b c d", "w " * 20000 + "end", "p q r s t\np q r s t"]


def test_op9_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").text
    got = queries.op9_quality_rules(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, text in docs.items():
        assert tuple(got.loc[i, list(NAMES)]) == counts(text)
    assert not got[got.base_failed].kept.any()


def test_op9_keeps_clean_and_rejects_junk(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    got = queries.op9_quality_rules(spark, sf).toPandas().set_index("doc_id").join(labels, how="inner")
    clean = got[(got.quality == 1) & ~got.base_failed]
    assert clean.kept.all() and got[got.quality == 0].kept.mean() < 0.35


def test_odd_texts_and_clashing_columns(spark):
    rows = [(i, t, "xx" if i % 2 else None, i, "c") for i, t in enumerate(ODD)] + [(0, None, None, 0, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, _words string")
    got = quality_rules.judge(docs).collect()
    assert sorted((r.doc_id, *[r[n] for n in NAMES]) for r in got) == sorted((r[0], *counts(r[1])) for r in rows)
    assert quality_rules.judge(docs.where("false")).count() == 0
    assert quality_rules.judge(docs.drop("lang"), keep_text=False).count() == len(rows)


def test_runs_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = quality_rules.measure(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=24), min_size=1, max_size=8))
def test_repeats_of_random_words(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "i int, text string").coalesce(1)
    got = {r.i: r.n_repeat_words for r in text_stats.with_repeats(text_stats.with_words(frame)).collect()}
    assert got == {i: counts(" ".join(w))[4] for i, w in enumerate(texts)}


def distance(p, q):
    p, q = np.array(p), np.array(q)
    m = (p + q) / 2
    part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
    return np.sqrt(max(0, (part(p) + part(q)) / 2))


@pytest.mark.parametrize("p,q", [([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.2, 0.8], [0.6, 0.4])])
def test_distance(spark, p, q):
    got = spark.range(1).select(quality_rules.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    assert got == pytest.approx(distance(p, q))


def test_op3_on_held_out_rows(spark, sf):
    import zlib

    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    got = queries.op3_quality_classifier(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]).all() and (got.predicted == (got.score >= 0.7)).all()
    judged = got.join(labels, how="inner")
    judged = judged[judged.held_out]
    assert (judged.predicted == judged.quality).mean() >= 0.9


def test_labels_of_held_out_rows_change_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_classifier.fit(docs, labels) == quality_classifier.fit(docs, flipped)


def test_scores_of_odd_rows_and_poor_labels(spark):
    docs = spark.createDataFrame([(i, t, 5.0, "x") for i, t in enumerate(ODD)] + [(None, "no id here", 1.0, "y")], "doc_id long, text string, score double, _words string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, none)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.score(docs.where("false"), model).count() == 0


def test_rules_compile_to_what_they_mean(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    rows = quality_classifier.with_features(docs).withColumn("s", model.column()).toPandas()
    x = rows[[f"_f_{k}" for k in quality_classifier.FEATURES]].to_numpy()
    total = model.intercept + sum(w * quality_classifier.holds(r, x) for r, w in zip(model.rules, model.weights))
    assert np.allclose(rows.s, 1 / (1 + np.exp(-total)))
