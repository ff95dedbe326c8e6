"""Exact dedup against a persistent index of digests, bucketed and sorted by digest.

A text counts by the sha256 of what is left without white space. The index is a folder of
Parquet files in buckets of the digest, each file sorted by it, with one row for each digest
seen so far: whose document stays. A load of new rows is reduced to its distinct digests with
their best document (combined before the shuffle, so a group of copies of any size is a few
rows), dealt and sorted like the index, and merged against it by an anti-join that does not
move the index. What is new is appended; nothing is rewritten.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.runtime import scratch_path, settle

SPACE = r"[\x20\x09-\x0D]"
# Texts of so many code points come with the first load of the query, the others with the second.
FIRST_LOAD = 1000


def normalised(text) -> Column:
    """The text without white space; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def n_points(text) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("bigint")


def fingerprints(docs: DataFrame, load: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_points, load, row) of every row, computed once.

    ``row`` tells rows apart that repeat an id.
    """
    body = F.col(text)
    return settle(docs.select(
        F.col(key).alias("doc_id"), F.unhex(F.sha2(normalised(body), 256)).alias("digest"),
        n_points(body).alias("n_points"), load.alias("load"), F.monotonically_increasing_id().alias("row")))


class DigestIndex:
    """Digests seen so far, kept in a folder that any later session may open again.

    The folder fixes the number of buckets when it is made: the shuffle partitions of that
    session unless ``buckets`` says otherwise.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = "gridspark_digests_" + hashlib.md5(self.path.encode()).hexdigest()
        layout = f"{self.path}/layout"
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{layout}/_SUCCESS")
        if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(n,)], "buckets INT").write.mode("overwrite").parquet(layout)
        self.buckets = spark.read.parquet(layout).first().buckets
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.table}
            (digest BINARY, keep_id BIGINT, keep_points BIGINT, keep_load STRING, keep_row BIGINT)
            USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS
            LOCATION '{self.path}/digests'""")

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, prints: DataFrame) -> DataFrame:
        """One row for each digest of ``prints`` that the index lacks: its best document.

        That has the most code points, then the smallest id (null last), then comes first.
        """
        best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "load", "row"))
        groups = prints.groupBy("digest").agg(best.alias("best")).repartition(self.buckets, "digest")
        return groups.join(self.entries().hint("merge"), "digest", "left_anti").select(
            "digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"),
            F.col("best.load").alias("keep_load"), F.col("best.row").alias("keep_row"))

    def append(self, prints: DataFrame) -> None:
        """Adds what is new. A load that was cut off may be appended again."""
        self.unseen(prints).write.insertInto(self.table)

    def judged(self, prints: DataFrame) -> DataFrame:
        """Every row of appended ``prints`` with keep_id, kept, and the number of rows of its digest among them.

        Digests are joined with the index first, settled, and then with their rows: that last
        join is a plain one, which Spark splits where a digest is hot.
        """
        sizes = prints.groupBy("digest").agg(F.count("*").alias("group_size")).repartition(self.buckets, "digest")
        groups = settle(sizes.join(self.entries().hint("merge"), "digest"))
        kept = (F.col("row") == F.col("keep_row")) & F.col("load").eqNullSafe(F.col("keep_load"))
        return prints.join(groups, "digest").withColumn("kept", kept)

    def close(self) -> None:
        """Forgets the table's name; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def add_documents(docs: DataFrame, index: DigestIndex, load: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of a new load that the index had not seen, after adding their digests to it.

    Of equal texts in the load the one with the most code points stays, then the smallest id
    (null last), then the first row. Texts are equal without white space; null is empty. All
    columns of ``docs`` are kept; a text that an earlier load brought is not among them.
    """
    prints = fingerprints(docs, F.lit(load), key, text)
    index.append(prints)
    stay = index.entries().where(F.col("keep_load") == load).select(
        F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep"), F.col("keep_points").alias("_points"))
    rows = docs.withColumn("_mark", F.unhex(F.sha2(normalised(F.col(text)), 256)))
    same = ((F.col("_mark") == F.col("_digest")) & F.col(key).eqNullSafe(F.col("_keep"))
            & (n_points(F.col(text)) == F.col("_points")))
    # Rows that repeat an id, text and length are one.
    return rows.join(stay, same).dropDuplicates(["_mark"]).select(*docs.columns)


def op11_exact_dedup(spark, folder):
    """Documents arrive in two loads, long texts first.

    Of equal texts a longer one stays, so the load that comes first holds it, and the second
    is deduplicated against the index that the first has left.
    """
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    is_long = n_points(F.col("text")) >= FIRST_LOAD
    prints = fingerprints(docs, F.when(is_long, "1-long").otherwise("2-short"))
    index = DigestIndex(spark, scratch_path(spark, "digest-index"))
    for load in ("1-long", "2-short"):
        index.append(prints.where(F.col("load") == load))
    out = index.judged(prints).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    index.close()
    return out


SQL = r"""
WITH prints AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM prints
WINDOW best AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST)
"""
