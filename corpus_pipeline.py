"""The corpus pipeline: quality rules, quality classifier, near-dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return
the columns of docs, whatever further columns there are and however they are named. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import minhash_dedup, packing, quality_classifier, quality_rules
from lorekeep.llm.queries import tokenizer_path
from lorekeep.llm.storage import materialise, shared_dir
from lorekeep.llm.text_stats import where_computed

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
END_ID = 2
#: Words that an encoder remembers and characters that it takes together: its executor has run the other stages before.
ENCODER = 80_000, 1_000_000


def _whole_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator reads, and each row whole beside them, so that no name of it can clash."""
    return docs.select(F.struct("*").alias("_row"), *columns)


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return where_computed(quality_rules.judge(_whole_rows(docs, "text", "lang")), F.col("kept")).select("_row.*")


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows of all documents, predicts to be of quality."""
    model = quality_classifier.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return where_computed(quality_classifier.score(_whole_rows(docs, "text"), model), F.col("predicted") == 1).select("_row.*")


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id; rows that repeat it go. Null ids stay."""
    judged = minhash_dedup.near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    gone = materialise(judged.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "near-copies")
    small = gone.count() <= minhash_dedup.BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if small else gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    if minhash_dedup.repeats(docs):
        kept = kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id"]))
    return kept


def pack_kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into windows."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), END_ID, remembered=ENCODER[0], slice_chars=ENCODER[1])


STAGES = [("quality rules", keep_by_rules), ("quality classifier", keep_by_classifier), ("near-dedup", keep_one_of_similar), ("packing", pack_kept)]

#: SQL can't express trained models, hashing trees or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
