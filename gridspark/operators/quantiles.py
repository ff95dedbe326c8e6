"""Exact quantiles of groups of any size, by one path.

A sketch per group (built in, combined before the shuffle) gives a narrow bracket around each
wanted rank; the next pass counts what lies below the bracket and the values inside it, so
the rank is exact whatever the sketch's error. Brackets are ranges of ranks, not of values:
wide-ranging or mostly equal values need no further pass. Where a bracket still has many
different values, their counts are cut in cells of equally many and only the cells of the
wanted ranks stay. No task holds a large group and nothing is approximate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import is_number
from gridspark.runtime import attach, is_small, settle

# A sketch answers within n / ACCURACY ranks; it holds a few times that many values.
ACCURACY = 1000
# A bracket is cut in cells while it holds more different values than this.
BRACKET_VALUES = 2_000_000
CELLS = 200


def _numbers(df: DataFrame, value: Column, keys) -> DataFrame:
    rows = df if keys != ["_all"] else df.withColumn("_all", F.lit(0))
    return rows.select(*keys, value.cast("double").alias("_v")).where(is_number("_v"))


def exact_quantiles(df: DataFrame, col, probs, by=(), most: int = BRACKET_VALUES,
                    accuracy: int = ACCURACY, brackets: DataFrame | None = None) -> DataFrame:
    """(by…, n, quantiles ARRAY<DOUBLE>) with linear interpolation; nulls and NaN ignored.

    ``brackets`` (by…, n, least, most, p, lo, hi), with one row for each group and place p in
    ``probs``, spares the sketch where the caller has one: n must be exact, least and most
    bounds of all values, lo and hi a guess that is checked.
    """
    by, probs = list(by), [float(p) for p in probs]
    keys = by or ["_all"]
    data = _numbers(df, F.col(col) if isinstance(col, str) else col, keys)
    state = _brackets(data, keys, probs, accuracy) if brackets is None else _given(brackets, keys, probs)
    few = is_small(state)
    values = _counted(data, state, keys, few, len(probs) == 1)
    checked = _checked(values, state, keys, few)
    missed, crowded = checked.agg(F.count_if("missed"), F.max("different")).first()
    if missed:
        # The sketch was worse than promised: these groups are counted whole.
        state = settle(checked.withColumns({
            "lo": F.when(F.col("missed"), F.col("least")).otherwise(F.col("lo")),
            "hi": F.when(F.col("missed"), F.col("most")).otherwise(F.col("hi"))}).select(*state.columns))
        values = _counted(data, state, keys, few, len(probs) == 1)
        crowded = _checked(values, state, keys, few).agg(F.max("different")).first()[0]
    while (crowded or 0) > max(most, CELLS):
        values = _thinned(values, state, keys, max(most, CELLS), few)
        crowded = values.groupBy(*keys, "p").agg(F.count("v").alias("d")).agg(F.max("d")).first()[0]
    found = _picked(values, state, keys, few)
    return found if by else found.drop("_all")


def _brackets(data, keys, probs, accuracy):
    """One row per group and rank: what rank is wanted, and between which values it lies."""
    # Twice the sketch's error on either side, and the neighbour that interpolation needs.
    margin = 2.0 / accuracy
    ends = [[max(p - margin, 0.0), min(p + margin, 1.0)] for p in probs]
    asked = F.array(*[F.lit(e) for pair in ends for e in pair])
    sketch = data.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"),
        F.percentile_approx("_v", asked, accuracy).alias("q"))
    rows = []
    for i, (p, (a, b)) in enumerate(zip(probs, ends)):
        lo = F.col("least") if a == 0 else F.col("q")[2 * i]
        hi = F.col("most") if b == 1 else F.col("q")[2 * i + 1]
        # A margin below two ranks is none: such a group is its own bracket.
        few = F.col("n") * margin < 2
        rows.append(F.struct(F.lit(i).alias("p"), ((F.col("n") - 1) * p).alias("spot"),
                             F.when(few, F.col("least")).otherwise(lo).alias("lo"),
                             F.when(few, F.col("most")).otherwise(hi).alias("hi")))
    spots = sketch.select(*keys, "n", "least", "most", F.explode(F.array(*rows)).alias("s")).select(
        *keys, "n", "least", "most", "s.*")
    return settle(spots.withColumns({"first": F.floor("spot"), "last": F.ceil("spot")}))


def _given(brackets, keys, probs):
    """The same from brackets that the caller has."""
    spot = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("p") + 1)
    spots = brackets.withColumn("spot", spot).withColumns({"first": F.floor("spot"), "last": F.ceil("spot")})
    return settle(spots.select(*keys, "n", "least", "most", "p", "spot", "lo", "hi", "first", "last"))


def _placed(data, state, keys, few, single):
    """Rows of each bracket, and those below it: (keys…, p, v), v null when below."""
    if single:
        rows = attach(data, state.select(*keys, "p", "lo", "hi"), keys, few=few).where(F.col("_v") <= F.col("hi"))
        return rows.select(*keys, "p", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("v"))
    spans = state.groupBy(*keys).agg(F.collect_list(F.struct("p", "lo", "hi")).alias("_spans"))
    held = F.filter("_spans", lambda s: F.col("_v") <= s["hi"])
    rows = attach(data, spans, keys, few=few).select(*keys, "_v", F.explode(held).alias("_s"))
    return rows.select(*keys, F.col("_s.p").alias("p"),
                       F.when(F.col("_v") >= F.col("_s.lo"), F.col("_v")).alias("v"))


def _counted(data, state, keys, few, single):
    """(keys…, p, v, c): how often each value of a bracket occurs; v null for all below it."""
    return settle(_placed(data, state, keys, few, single).groupBy(*keys, "p", "v").agg(F.count("*").alias("c")))


def _checked(values, state, keys, few):
    """The brackets: whether one misses its ranks, and how many different values it has."""
    c = F.col("c")
    counts = values.groupBy(*keys, "p").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull(), c)), F.lit(0)).alias("below"), F.sum(c).alias("upto"),
        F.count("v").alias("different"))
    known = attach(state, counts, [*keys, "p"], few=few)
    hit = (F.col("first") >= F.col("below")) & (F.col("last") < F.col("upto"))
    return known.withColumn("missed", ~F.coalesce(hit, F.lit(False)))


def _thinned(values, state, keys, most, few):
    """Crowded brackets cut in cells of equally many values; the wanted ranks' cells stay."""
    item = [*keys, "p"]
    steps = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    cuts = values.where("v is not null").groupBy(*item).agg(
        F.count("*").alias("d"), F.percentile_approx("v", steps, 10 * CELLS).alias("cuts")).where(F.col("d") > most)
    rows = attach(values, cuts.drop("d"), item, few=few)
    cell = F.when(F.col("v").isNull(), -1).otherwise(F.size(F.filter("cuts", lambda x: x <= F.col("v"))))
    cells = rows.where("cuts is not null").groupBy(*item, cell.alias("cell")).agg(
        F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = F.sum("c").over(Window.partitionBy(*item).orderBy("cell"))
    ranked = attach(cells.withColumn("upto", upto), state.select(*item, "first", "last"), item, few=few)
    wanted = (F.col("upto") > F.col("first")) & (F.col("upto") - F.col("c") <= F.col("last")) & (F.col("cell") >= 0)
    kept = ranked.where(wanted).groupBy(*item).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    held = attach(values, kept, item, few=few).where("hi is null or v is null or v <= hi")
    return settle(held.withColumn("v", F.when(F.col("lo").isNull() | (F.col("v") >= F.col("lo")), F.col("v"))).groupBy(
        *item, "v").agg(F.sum("c").alias("c")))


def _picked(values, state, keys, few):
    item = [*keys, "p"]
    upto = F.sum("c").over(Window.partitionBy(*item).orderBy(F.col("v").asc_nulls_first()))
    facts = state.select(*item, "n", "spot", "first", "last")
    ranked = attach(values.withColumn("upto", upto), facts, item, few=few).withColumn("from", F.col("upto") - F.col("c"))
    at = {r: (F.col("from") <= F.col(r)) & (F.col(r) < F.col("upto")) for r in ("first", "last")}
    picked = ranked.groupBy(*item, "n", "spot", "first").agg(
        F.max(F.when(at["first"], F.col("v"))).alias("v0"), F.max(F.when(at["last"], F.col("v"))).alias("v1"))
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("spot") - F.col("first"))
    value = F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise(between)
    return picked.groupBy(*keys, "n").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("p", value.alias("q")))), lambda s: s["q"]).alias("quantiles"))
