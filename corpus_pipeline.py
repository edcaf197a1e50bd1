"""Corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, mix.

Each stage takes (spark, docs, sf_dir) and all that the stage before kept; all but the last return the
columns of `documents`. Null texts count as empty; after the third stage they are empty. The second stage compares
texts only: rows without an id, and different texts under one id, stay. Extra columns are dropped, and an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import decontaminate, mixing, pii, quality, simhash_sets
from kgspark.llm.common import crc_fold, join_few, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored as texts without words, very long ones whole; rows without an id are scored, and are
    never among the labelled ones; repeated rows are judged alike. Without labels of both kinds every score is 0.5 and all stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train_on=crc_fold() != 0)
    return quality.score(docs, model, "doc_id", "text", 0.3, "text", "lang", "source", "n_chars").where("predicted = 1").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id, rows without an id last, of equal ids by a hash of the text.

    The SimHash operator at a similarity: texts are linked at 0.8 or more of their 5-word shingles. Texts of fewer words
    are linked where they are equal word by word, null and empty ones with each other; very long texts are compared whole.
    Rows without an id, or with different texts under one id, stay unless a text like theirs does.
    """
    nodes = simhash_sets.components(docs, shingle=5, similarity=0.8)
    named = docs.select(*COLUMNS, simhash_sets.node_of("text").alias("node"))
    # linked nodes are few beside all rows; a node of very many rows meets its root in many tasks
    named = join_few(named, nodes, ["node"], "doc_id", 8)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64("text").alias("h"), "text", "lang", "source", "n_chars")
    return named.groupBy(F.coalesce("root", "node").alias("group")).agg(F.min(order).alias("row")).select(*[f"row.{c}" for c in COLUMNS])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of test items; a document of which more than half is such passages goes.

    Null texts become empty ones and stay; rows with a null or shared id are judged by their own text; without items nothing is cut.
    """
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"), window=10, keep=["lang", "source"], cut_limit=0.5)
    return found.where("not drop").select("doc_id", F.col("clean").alias("text"), "lang", "source", F.length("clean").cast("long").alias("n_chars"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked.

    Every row stays: null texts are empty, repeated ones are masked alike, very long ones whole. An empty table gives an empty one.
    """
    found = pii.find(docs, pii.fit(docs), keep=["lang", "source"], mask=True)
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.length("masked").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with a column `copy` from 1; documents not taken are absent.

    A null source is a source of its own; empty texts take no words. Rows that repeat id and text are taken alike, as often as the most taken of them.
    """
    # rows without an id, or with a shared one, are told apart by their texts
    docs = docs.select(*COLUMNS).withColumn("row", F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")))
    taken = mixing.mix(docs, id_col="row").where("copies > 0").groupBy("row").agg(F.max("copies").alias("copies"))
    return docs.join(taken, "row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: No SQL twin: the first, second and fourth stage hold trained models, XXH64 and components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written as Parquet to the checkpoint folder and read by the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
