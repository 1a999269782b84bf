"""The pipeline's stages against what they say."""

import corpus_pipeline as pipeline
from tests.llm.test_similar import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = pipeline.keep_by_rules(spark, docs, sf).cache()
    assert kept.columns == docs.columns
    clean = set(labels[labels == 1].index)
    long = {r.doc_id for r in docs.collect() if len(r.text.split()) >= 10}
    left = {r.doc_id for r in kept.collect()}
    assert clean & long <= left
    scored = pipeline.keep_by_classifier(spark, kept, sf).cache()
    left = {r.doc_id for r in scored.collect()}
    assert len(clean & long - left) <= 2 and not left & set(labels[labels == 0].index)
    one = pipeline.keep_one_of_similar(spark, scored, sf)
    want, _ = brute({r.doc_id: r.text for r in scored.collect()}, 5, 80)
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(want.values()))
    packed = pipeline.pack_kept(spark, one, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(want.values())


def test_odd_rows_pass_all_stages(spark, sf):
    rows = [(1, None, None, None, None, True, 1), (2, "", "xx", "s", 0, False, None), (None, "the of and " * 20, "en", "s", 1, None, 2), (3, "some words of the text " * 3, "en", "s", 1, True, 3), (3, "some words of the text " * 3, "en", "s", 1, True, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _words int")
    for table in (docs, docs.where("false")):
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, table, sf).columns == docs.columns
    assert [r.doc_id for r in pipeline.keep_one_of_similar(spark, docs.where("doc_id = 3"), sf).collect()] == [3]
    assert pipeline.pack_kept(spark, docs, sf).count() == len(rows)
