"""Mixing sources to target weights.

Every row gets a hash-random key (md5 of its id). A source is range-sorted by that key: the
leading digits are evenly filled key ranges, a window sorts one range, and the ranges'
offsets are prefix sums of their totals. The cut is at the exact budget: whole epochs first,
then the rows whose prefix sum lies below what is left; the one row that straddles the cut
is taken in part. No task holds a source, however large; no row is dropped or sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.runtime import settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
EPOCHS = 2
DIGITS = 3


def word_count(text) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=(3, 2), epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) of a table (source, size) with any number of rows.

    Weights repeat over the sources in code point order, null last. All sources share
    ``share`` (a fraction) of the total by weight; a target stops at ``epochs`` times its
    source, and the excess goes to the others by weight until none is above. That fixed
    point has one level L with target = min(L * weight, cap): with the sources ordered by
    cap / weight, the first ones are capped and L follows from prefix sums. The table
    worked on has one row per source. A source without words gets 0; so does every
    source of an empty table.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    order = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(order, F.lit(len(weights))) + 1)
    cap = F.col("source_size") * epochs
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    facts = per.withColumns({"place": order, "weight": weight.cast("bigint"), "cap": cap})
    pool = F.sum("source_size").over(whole) * share[0] / F.lit(share[1])
    level = (pool - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    tried = facts.withColumn("level", level.cast("double"))
    # The first source whose cap is not below the level it would get sets the level of all.
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("turn", "level"))).over(whole)
    tried = tried.withColumn("turn", F.row_number().over(by_cap)).withColumn("set", final)
    target = F.when(F.col("turn") >= F.col("set.turn"), F.col("set.level") * F.col("weight")) \
        .otherwise(F.col("cap").cast("double"))
    return tried.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size",
                weights=WEIGHTS, share=(3, 2), epochs: int = EPOCHS, digits: int = DIGITS) -> DataFrame:
    """(key, source, size, source_size, target, taken) of a table with those three columns.

    ``taken`` counts words over all epochs, so a row gives between 0 and ``epochs`` times its
    size; per source it sums to the target rounded down. A null size is 0, a null source is
    a source of its own, a null key sorts as an empty one, and rows repeated with one key
    are cut one after the other. More key ``digits`` make smaller ranges.
    """
    rows = docs.select(F.col(key).alias("_id"), F.col(source).alias("source"),
                       F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    rows = rows.withColumn("_key", F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary")))
    rows = settle(rows.withColumn("_range", F.substring("_key", 1, digits)))
    targets = settle(source_targets(rows.select("source", "size"), weights, share, epochs))
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    facts = offsets.alias("o").join(targets.alias("t"), F.expr("o.source <=> t.source")).select(
        "o.*", "t.source_size", "t.target").withColumnsRenamed({"source": "_src", "_range": "_part"})
    # Ranks inside a range first: both sides of the join then keep the range's partitioning.
    inside = Window.partitionBy("source", "_range").orderBy("_key", "_id", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = ranked.join(facts, F.expr("source <=> _src and _range = _part"))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - F.col("_epochs") * F.col("source_size")
    part = F.least(F.greatest(left - F.col("_start") - F.col("_before"), F.lit(0)), F.col("size"))
    return placed.withColumn("_epochs", whole.cast("bigint")).select(
        F.col("_id").alias(key), "source", "size", "source_size", "target",
        (F.col("_epochs") * F.col("size") + part).cast("bigint").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix reads them: a row per epoch, the last one cut at the budget.

    Keeps the columns of ``docs`` (doc_id, text, source and any other); ``n_chars``, if
    there, follows a cut text. Rows that share a doc_id are told apart by their text; a row
    without words is never taken.
    """
    known = docs.withColumns({"_size": word_count("text"), "_row": F.xxhash64("doc_id", "source", "text")})
    mixed = mix_sources(known.select("_row", "source", "_size"), "_row", "source", "_size")
    # Identical rows are interchangeable: one of them stands for what all of them give.
    taken = mixed.groupBy("_row").agg(F.sum("taken").alias("_taken")).where(F.col("_taken") > 0)
    rows = known.dropDuplicates(["_row"]).join(taken, "_row")
    full = F.floor(F.col("_taken") / F.col("_size")).cast("int")
    rest = F.col("_taken") - full * F.col("_size")
    copies = F.concat(F.array_repeat(F.col("_size"), full), F.when(rest > 0, F.array(rest)).otherwise(F.array()))
    rows = rows.withColumn("_words", F.explode(copies))
    short = F.col("_words") < F.col("_size")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    text = F.when(short, F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), " ")) \
        .otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(short, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def op5_mixing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return mix_sources(docs.select("doc_id", "source", word_count("text").alias("size"))).drop("source")


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) size
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM rows GROUP BY source),
facts AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 place FROM per),
weighted AS (SELECT *, [3, 1, 2][CAST(place % 3 AS INT) + 1] weight, 2 * source_size cap FROM facts),
tried AS (
  SELECT *, row_number() OVER w turn,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 3 / 2
      - coalesce(CAST(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
    / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) level
  FROM weighted WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, place)),
final AS (SELECT min({'turn': turn, 'level': level}) s FROM tried WHERE level * weight <= cap),
targets AS (
  SELECT source, source_size,
    CASE WHEN turn >= s.turn THEN s.level * weight ELSE CAST(cap AS DOUBLE) END target
  FROM tried, final),
ranked AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) budget,
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY k, doc_id, size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END epochs FROM ranked)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + least(greatest(budget - epochs * source_size - before, 0), size) AS BIGINT) taken
FROM parts
"""
