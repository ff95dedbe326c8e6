"""Quality classifier: interpolated modified Kneser-Ney over bytes, and quantile thresholds.

Every one of the 256 bytes is a symbol of its own beside the start of a text, and an n-gram is
a 64-bit number in base 257, so no type is folded into another. Counts cover all trusted text;
each task sums its own before they are sharded by n-gram. Joins of sharded counts, order by
order, give the probability of every n-gram type that any document holds. Texts are packed in
chunks of a few MB; the types of each chunk meet the sharded probabilities in a shuffle join,
and what was found meets the texts of the chunk in another, where it is summed by document.
These rows grow with the texts; no table of the model is gathered in one place. A document is
kept up to a quantile of its language, taken over trusted documents the model has not seen.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.language import fold
from gridspark.llm.links import narrow, release
from gridspark.llm.text import chunks, column, inside
from gridspark.runtime import settle, ship_package, stored

ORDER = 4
SYMBOLS = 257
QUANTILE = 0.99
GRID = 2000
MERGE = 4_000_000
TEXTS = 16_000_000
LEVEL = 9


def alphabet(counts: np.ndarray) -> np.ndarray:
    """byte -> symbol: 1 … 256, one for each byte whatever its count; 0 is the start."""
    return np.arange(1, len(counts) + 1, dtype=np.int64)


def ngrams(buf, off, order: int = ORDER):
    """The n-gram ending at every byte, as a number; places before a text are start symbols.

    Orders up to 7 fit 64 bits.
    """
    sizes = np.diff(off)
    symbols = alphabet(np.zeros(256))[buf]
    grams = symbols.copy()
    place = inside(sizes)
    for back in range(1, order):
        earlier = np.zeros(len(buf), np.int64)
        earlier[back:] = symbols[:-back] if back < len(buf) else 0
        earlier[place < back] = 0
        earlier *= SYMBOLS**back
        grams += earlier
    return grams, sizes


def _count(order):
    """(g, c) of a task's texts; what outgrows ``MERGE`` types leaves early, in parts to be summed."""
    def rows(keys, counts):
        for at in range(0, len(keys), 100_000):
            s = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([column(keys[s], pa.int64()), column(counts[s], pa.int64())],
                                             names=["g", "c"])

    def merged(held):
        keys = np.concatenate([k for k, _ in held])
        counts = np.concatenate([c for _, c in held])
        at = np.argsort(keys, kind="stable")
        keys, counts = keys[at], counts[at]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[starts], np.add.reduceat(counts, starts)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, buf, off in chunks(batch.column(0)):
                if len(buf):
                    held.append(np.unique(ngrams(buf, off, order)[0], return_counts=True))
                    size += len(held[-1][0])
                if size > MERGE:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > MERGE // 2:
                        yield from rows(*held[0])
                        held, size = [], 0
        if held:
            yield from rows(*merged(held))
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams with counts 1 to 4; 0.5, 1, 1.5 where undefined."""
    if min(n1, n2, n3) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.0), float(k + 1)) for k, d in enumerate(found))


def probabilities(counts: DataFrame, types: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, p) of every n-gram in ``types`` (g) under the model of ``counts`` (g, c > 0).

    The highest order uses counts, lower ones the number of different symbols before an
    n-gram. An unseen context leaves the probability to the lower order; below the first
    stands 1 / 257. No context has more than 257 n-grams, so no join key is hot.
    """
    spark = counts.sparkSession
    grams = {order: counts.select("g", F.col("c").alias("a"))}
    wanted = {order: types.select("g").distinct()}
    for n in range(order - 1, 0, -1):
        suffix = F.pmod("g", F.lit(SYMBOLS**n)).alias("g")
        grams[n] = settle(grams[n + 1].select(suffix).groupBy("g").agg(F.count("*").alias("a")))
        wanted[n] = settle(wanted[n + 1].select(suffix).distinct())
    lower = spark.range(1).select(F.lit(0).cast("long").alias("s"), F.lit(1.0 / SYMBOLS).alias("q"))
    for n in range(1, order + 1):
        heads = grams[n].agg(*[F.count_if(F.col("a") == k).alias(f"n{k}") for k in range(1, 5)]).first()
        d1, d2, d3 = discounts(*heads)
        contexts = grams[n].groupBy(F.expr(f"g div {SYMBOLS}").alias("h")).agg(
            F.sum("a").alias("total"),
            (d1 * F.count_if(F.col("a") == 1) + d2 * F.count_if(F.col("a") == 2)
             + d3 * F.count_if(F.col("a") >= 3)).alias("left_over"))
        seen = F.col("a") - F.when(F.col("a") == 1, d1).when(F.col("a") == 2, d2).otherwise(d3)
        parts = wanted[n].withColumns({"h": F.expr(f"g div {SYMBOLS}"), "s": F.pmod("g", F.lit(SYMBOLS**(n - 1)))})
        joined = parts.join(grams[n], "g", "left").join(contexts, "h", "left").join(lower, "s")
        p = F.coalesce(F.greatest(seen, F.lit(0.0)) / F.col("total"), F.lit(0.0)) \
            + F.coalesce(F.col("left_over") / F.col("total"), F.lit(1.0)) * F.col("q")
        lower = settle(joined.select(F.col("g").alias("s"), p.alias("q")))
    return lower.select(F.col("s").alias("g"), F.col("q").alias("p"))


def _pack(order):
    """A row per chunk of texts: its bytes, keys and different n-grams."""
    def run(batches):
        codec = pa.Codec("zstd", compression_level=LEVEL)
        for batch in batches:
            for first, buf, off in chunks(batch.column(0), TEXTS):
                sizes = np.diff(off)
                cut = [batch.column(i).slice(first, len(sizes)) for i in range(3)]
                types = np.unique(np.concatenate([np.unique(ngrams(b, o, order)[0]) for _, b, o in chunks(cut[0])]))
                rows = pa.array([0, len(sizes)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [column([codec.compress(buf.tobytes(), asbytes=True)], pa.binary()),
                     pa.ListArray.from_arrays(rows, column(sizes, pa.int64())),
                     *[pa.ListArray.from_arrays(rows, c) for c in cut[1:]],
                     pa.ListArray.from_arrays(pa.array([0, len(types)], pa.int32()), column(types, pa.int64()))],
                    names=["body", "sizes", "keys", "langs", "grams"])
    return run


def _sum(order):
    """A chunk and the log probabilities of its n-grams: n_bytes and perplexity of its texts."""
    def run(packs, found):
        g, v = found.column("g").to_numpy(), found.column("v").to_numpy().astype(np.float64)
        at = np.argsort(g)
        g, v = g[at], v[at]
        sizes, keys, langs = [packs.column(c)[0].values for c in ("sizes", "keys", "langs")]
        off = np.r_[0, np.cumsum(sizes.to_numpy())]
        body = pa.decompress(packs.column("body")[0].as_py(), int(off[-1]), "zstd")
        texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(off), body)
        means = []
        for _, buf, ends in chunks(texts):
            grams, counts = ngrams(buf, ends, order)
            spot = np.searchsorted(g, grams)
            if len(grams) and (spot.max() >= len(g) or not np.array_equal(g[spot], grams)):
                raise ValueError("an n-gram of a chunk has no probability")
            total = np.concatenate([[0.0], np.cumsum(v[spot])])
            means.append((total[ends[1:]] - total[ends[:-1]]) / np.maximum(counts, 1))
        return pa.table([keys, langs, sizes, column(np.exp(-np.concatenate(means)), pa.float64())],
                        names=["_k", "_l", "n_bytes", "perplexity"])
    return run


def score(rows: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(_k, _l, n_bytes, perplexity) of every row of (_t, _k, _l), learned on ``trusted`` (text)."""
    counts = settle(trusted.mapInArrow(_count(order), "g long, c long").groupBy("g").agg(F.sum("c").alias("c")))
    release(rows.sparkSession)
    kinds = dict(rows.dtypes)
    packs = rows.mapInArrow(_pack(order), f"body binary, sizes array<long>, keys array<{kinds['_k']}>, "
                                          f"langs array<{kinds['_l']}>, grams array<long>")
    packs = stored(packs.withColumn("chunk", F.monotonically_increasing_id()), "perplexity-texts")
    held = packs.select("chunk", F.explode("grams").alias("g"))
    known = probabilities(counts, settle(held.select("g").distinct()), order)
    release(rows.sparkSession)
    found = held.join(known.hint("merge"), "g").select(F.col("chunk").alias("of"), "g", F.log("p").cast("float").alias("v"))
    return packs.drop("grams").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(
        _sum(order), f"_k {kinds['_k']}, _l {kinds['_l']}, n_bytes long, perplexity double")


def upper_quantile(rows: DataFrame, by: str, value: str, q: float = QUANTILE, grid: int = GRID) -> DataFrame:
    """(by, threshold): the q-quantile of each group, rounded up on a grid of logarithms.

    Values are counted per step of 1 / grid in the logarithm, so a group of any size is a
    bounded table and the result does not depend on the order of rows.
    """
    step = F.floor(F.log(value) * grid)
    bins = rows.groupBy(by, step.alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(by)
    ranked = bins.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(everything)})
    return ranked.where(F.col("upto") >= F.col("total") * q).groupBy(by).agg(
        F.exp((F.min("bin") + 1) / grid).alias("threshold"))


def judge_perplexity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                     lang: str = "lang", quantile: float = QUANTILE, order: int = ORDER) -> DataFrame:
    """Per row of ``docs``: key, lang, n_bytes, perplexity, threshold, kept.

    Trusted rows are labelled quality 1 and not toxic; four folds of five teach the model, the
    fifth sets the thresholds. A language without such rows takes the threshold over all, a
    null language is one of its own. Empty and null texts have no perplexity and are not kept.
    Without trusted rows nothing is judged and every text with a byte is kept.
    """
    ship_package(docs.sparkSession)
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(key).distinct()
    good = good.where(F.col(key).isNotNull())
    trusted = narrow(docs.select(key, text), good, key).join(good.hint("merge"), key)
    learn = trusted.where(fold(key) != 0).select(text)
    rows = docs.select(F.col(text).alias("_t"), F.col(key).alias("_k"), F.col(lang).alias("_l"))
    scored = settle(score(rows, learn, order))
    perplexity = F.when(F.col("n_bytes") > 0, F.col("perplexity"))
    scored = scored.withColumn("perplexity", perplexity)
    checked = scored.where((fold("_k") == 0) & (F.col("n_bytes") > 0)).join(
        good.withColumnRenamed(key, "_k"), "_k", "left_semi")
    limits = upper_quantile(checked, "_l", "perplexity", quantile).select(F.col("_l").alias("_of"), "threshold")
    overall = upper_quantile(checked.withColumn("_all", F.lit(0)), "_all", "perplexity", quantile).agg(
        F.max("threshold")).scalar()
    out = scored.join(limits, F.col("_l").eqNullSafe(F.col("_of")), "left")
    out = out.withColumn("threshold", F.coalesce("threshold", overall, F.lit(float("inf"))))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return out.select(F.col("_k").alias(key), F.col("_l").alias(lang), "n_bytes", "perplexity", "threshold",
                      kept.alias("kept"))


def op7_quality_classifier(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return judge_perplexity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
