"""A corpus pipeline over the documents table: five stages, each one of the dealt operators.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Its result is
written as Parquet and read again as the next one's documents. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.jaccard import jaccard_rows
from gridspark.llm.language import UNKNOWN, fold, identify
from gridspark.llm.mixing import WORD, mix_documents, word_count
from gridspark.llm.packing import pack_documents
from gridspark.llm.suffixes import SHORT_COVER, SHORT_MODULUS, drop_repeats
from gridspark.runtime import scratch_path, settle

MIN_SCORE = 0.5
# Fifty words of four bytes, spaces included: a passage of more words is longer in any of the languages.
PASSAGE = 200


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known with a score of at least one half."""
    found = identify(docs, docs.where(fold("doc_id") != 0))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: the smallest id, null last.

    Ids may be null or repeat: rows are told apart by all their columns. Texts without a word
    are near duplicates of nothing and stay, all of them.
    """
    rows = docs.withColumn("_key", F.xxhash64(*docs.columns))
    judged = settle(jaccard_rows(rows.select("doc_id", "text", F.col("_key").alias("key"))))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = judged.where("n_shingles > 0").groupBy("group").agg(F.min(order).alias("best")).select(
        F.col("best.key").alias("_first")).distinct()
    # Rows equal in every column are one; others that share a key by chance both stay.
    kept = rows.join(first, F.col("_key") == F.col("_first")).dropDuplicates(docs.columns)
    bare = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    return kept.where(~bare).select(*docs.columns).unionByName(docs.where(bare))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings of ``PASSAGE`` bytes that occur elsewhere too; a document of which nothing is left goes."""
    return drop_repeats(docs, PASSAGE, SHORT_MODULUS, SHORT_COVER, buckets=(2, 3))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix reads them: a row per epoch, the last cut at the budget."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of documents; epochs of one document are one cluster and never share a bin."""
    cluster = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"))
    return pack_documents(docs.select("doc_id", "source", word_count("text").alias("size"), cluster.alias("cluster")))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packing),
]
# Trained models, components and packing have no SQL: tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
