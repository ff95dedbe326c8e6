"""Quality rules: counts of a text, and a hashed n-gram classifier for what they let through.

Words, word pairs and byte 4-grams are hashed into one table of weights; a text's logit is the
mean weight of its words plus that of its pairs plus that of its 4-grams. The weights are
learned in numpy on a bounded sample of labelled rows, and the logit is calibrated to a
probability on rows the weights did not see. Whole texts are scored in Arrow batches against
a fixed threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.links import narrow
from gridspark.llm.text import SPACES, Prints, U, chunks, column, inside, mix, spread, words
from gridspark.runtime import settle, ship_package

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RUN = 8
SLOTS = 1 << 17
# Training takes at most so many rows of a label; the surplus by hash order is left out.
ROWS_PER_LABEL = 1500
CALIBRATION_FOLDS = 4
ROUNDS = 60
RATE = 6.0
DECAY = 1e-5
THRESHOLD = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BASE_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _grouped(values, owner, n):
    return np.bincount(owner, weights=values, minlength=n).astype(np.int64)


def _per_text(flags, off):
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[off[1:]] - total[off[:-1]]


def _again(prints, owner):
    """(held elsewhere in its text, not the first of its text) of every fingerprint."""
    key = mix(prints + mix(owner.astype(U) + U(1)))
    order = np.argsort(key, kind="stable")
    held = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = held[1:] == held[:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def base_counts(buf, off, run: int = RUN):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    n = len(off) - 1
    start, end, bounds = words(buf, off)
    prints = Prints(buf)
    n_words = np.diff(bounds)
    chars = _per_text(~SPACES[buf] & ((buf & 0xC0) != 0x80), off)
    symbols = _per_text(SYMBOLS[buf], off)
    # Lines end at a newline or at the text's end.
    breaks = np.flatnonzero(buf == 0x0A)
    heads = np.sort(np.concatenate([off[:-1], breaks + 1]))
    tails = np.sort(np.concatenate([off[1:], breaks]))
    with_word = np.searchsorted(start, tails) > np.searchsorted(start, heads)
    heads, tails = heads[with_word], tails[with_word]
    owner = np.searchsorted(off, heads, "right") - 1
    _, later = _again(prints.of(heads, tails), owner)
    dup_lines = _grouped(later, owner, n)
    # Windows of so many words, by mixing the words' fingerprints.
    count = np.maximum(n_words - run + 1, 0)
    owner = spread(count)
    first = bounds[:-1][owner] + inside(count)
    one = prints.of(start, end)
    gram = np.zeros(len(first), U)
    for k in range(run):
        gram = mix(gram * U(3) + one[first + k] + U(k))
    twice, _ = _again(gram, owner)
    edge = np.zeros(len(start) + 1, np.int32)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + run, -1)
    repeat = _per_text(np.cumsum(edge[:-1]) > 0, bounds)
    return n_words, chars, symbols, dup_lines, repeat


def features(buf, off, slots: int = SLOTS):
    """Three kinds of hashed n-grams: (slot, text) of every word, word pair and byte 4-gram."""
    start, end, bounds = words(buf, off)
    prints = Prints(buf)
    n_words = np.diff(bounds)
    one = prints.of(start, end)
    owner = spread(n_words)
    yield (one % U(slots)).astype(np.int32), owner
    pair = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    both = mix(one[pair] * U(5) + one[np.minimum(pair + 1, max(len(one) - 1, 0))] + U(11))
    yield (both % U(slots)).astype(np.int32), owner[pair]
    sizes = np.maximum(np.diff(off) - 3, 0)
    owner = spread(sizes)
    at = off[:-1][owner] + inside(sizes)
    wide = buf.astype(np.uint32)
    gram = (wide[at] << 24) | (wide[at + 1] << 16) | (wide[at + 2] << 8) | wide[at + 3]
    slot = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(slots).bit_length() + 1)
    yield slot.astype(np.int32), owner


@dataclass
class Scorer:
    """Weights of the three kinds, and the calibration of the logit."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, buf, off) -> np.ndarray:
        n = len(off) - 1
        total = np.full(n, self.bias)
        for kind, (slot, owner) in enumerate(features(buf, off, self.weights.shape[1])):
            mass = np.bincount(owner, minlength=n)
            total += np.bincount(owner, self.weights[kind][slot], minlength=n) / np.maximum(mass, 1)
        return total

    def probabilities(self, buf, off) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(buf, off) + self.shift, -30, 30)))


def _features_of(slots):
    """Rows of (label, fold, slots and shares of the n-grams): bounded by the table's size."""
    def run(batches):
        for batch in batches:
            for first, buf, off in chunks(batch.column(0), 500_000):
                n = len(off) - 1
                parts = [[] for _ in range(n)]
                for kind, (slot, owner) in enumerate(features(buf, off, slots)):
                    key, count = np.unique(owner.astype(np.int64) * slots + slot, return_counts=True)
                    row = key // slots
                    mass = np.bincount(owner, minlength=n)
                    share = (count / mass[row]).astype(np.float32)
                    ends = np.searchsorted(row, np.arange(n + 1))
                    for i in range(n):
                        s = slice(ends[i], ends[i + 1])
                        parts[i].append(((key[s] % slots + kind * slots).astype(np.int32), share[s]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, n), batch.column(2).slice(first, n),
                     column([np.concatenate([p[0] for p in r]).tobytes() for r in parts], pa.binary()),
                     column([np.concatenate([p[1] for p in r]).tobytes() for r in parts], pa.binary())],
                    names=["label", "fold", "slots", "shares"])
    return run


def _fit_weights(slots, shares, rows, labels, width, rounds=ROUNDS):
    """Full-batch gradient steps on the log loss, classes weighing the same."""
    w, bias = np.zeros(3 * width), 0.0
    speed = np.zeros_like(w)
    n = len(labels)
    weight = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    for _ in range(rounds):
        z = np.bincount(rows, w[slots] * shares, minlength=n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        grad = np.bincount(slots, error[rows] * shares, minlength=len(w)) + DECAY * w
        # Rare slots move as fast as frequent ones: steps are scaled by the gradients seen.
        speed += grad * grad
        w -= RATE * grad / (np.sqrt(speed) + 1e-6)
        bias -= error.sum()
    return w, bias


def train(docs: DataFrame, known: DataFrame, text: str, label: str, key: str, width: int = SLOTS,
          per_label: int = ROWS_PER_LABEL) -> Scorer | None:
    """A calibrated scorer from at most ``per_label`` hash-drawn rows of each label, or None.

    The sample is drawn from ``known`` (key, label), so only its few texts are moved. Rows
    without a label, a text or a word are left out; None if a label has no rows.
    """
    known = known.where(F.col(label).isin(0, 1))
    sizes = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    if len(sizes) < 2:
        return None
    draw = F.xxhash64(F.lit("quality"), key)
    limit = F.when(F.col(label) == 1, int(1_400_000 * per_label / sizes[1]) + 1).otherwise(
        int(1_400_000 * per_label / sizes[0]) + 1)
    drawn = known.where(F.pmod(draw, F.lit(1_000_000)) < limit).select(
        key, F.col(label).cast("int").alias("l"), draw.alias("d"))
    drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("l").orderBy("d", key)))
    drawn = settle(drawn.where(F.col("place") <= per_label))
    texts = narrow(docs.select(key, F.col(text).alias("t")), drawn, key)
    rows = texts.join(drawn, key).where(F.col("t").rlike(r"[^\x20\x09-\x0D]"))
    held = rows.select("t", "l", F.pmod("place", F.lit(CALIBRATION_FOLDS)).alias("f")).mapInArrow(
        _features_of(width), "label int, fold int, slots binary, shares binary").collect()
    if not held:
        return None
    held.sort(key=lambda r: (r.label, r.fold, bytes(r.slots), bytes(r.shares)))
    labels = np.array([r.label for r in held], float)
    folds = np.array([r.fold for r in held])
    slots = [np.frombuffer(r.slots, np.int32) for r in held]
    shares = [np.frombuffer(r.shares, np.float32) for r in held]

    def flat(use):
        pick = np.flatnonzero(use)
        counts = [len(slots[i]) for i in pick]
        return (np.concatenate([slots[i] for i in pick]), np.concatenate([shares[i] for i in pick]),
                np.repeat(np.arange(len(pick)), counts), labels[pick])

    if len(set(labels)) < 2:
        return None
    fit, check = folds != 0, folds == 0
    if len(set(labels[fit])) < 2 or len(set(labels[check])) < 2:
        fit = check = np.ones(len(held), bool)
    w, bias = _fit_weights(*flat(fit), width)
    s, v, r, y = flat(check)
    z = np.bincount(r, w[s] * v, minlength=len(y)) + bias
    slope, shift = _calibrate(z, y)
    return Scorer(w.reshape(3, width).astype(np.float32), bias, slope, shift)


def _calibrate(z, y, rounds=50):
    """Slope and shift of the logit by Newton steps on smoothed labels."""
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    weight = np.where(y == 1, 0.5 / max(good, 1), 0.5 / max(bad, 1))
    x = np.stack([z, np.ones_like(z)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (weight * (p - target)))
        theta -= np.clip(step, -2, 2)
    return float(max(theta[0], 1e-3)), float(theta[1])


def _apply(scorer: Scorer | None):
    def run(batches):
        for batch in batches:
            for first, buf, off in chunks(batch.column(0)):
                n = len(off) - 1
                counts = base_counts(buf, off)
                chance = scorer.probabilities(buf, off) if scorer else np.ones(n)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(first, n) for i in range(1, batch.num_columns)],
                     *[column(c, pa.int64()) for c in counts], column(chance, pa.float64())],
                    names=[*batch.schema.names[1:], "n_words", "word_chars", "n_symbols", "n_dup_lines",
                           "n_repeat_words", "quality"])
    return run


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                  label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: key, the five counts, base_failed, quality (0 to 1) and kept.

    ``labels`` has (key, label). A null text has no words. base_failed: fewer than 20 words, or
    over 30 % of them in 8-word runs that occur twice in the text. Kept: the base holds and the
    calibrated probability reaches the threshold; without labels of both kinds it is 1. Of
    several labels of one key the lowest counts; null keys are judged but teach nothing.
    """
    ship_package(docs.sparkSession)
    known = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("_label"))
    scorer = train(docs, known, text, "_label", key)
    kind = dict(docs.dtypes)[key]
    out = docs.select(F.col(text).alias("_t"), F.col(key).alias("_k")).mapInArrow(
        _apply(scorer), f"_k {kind}, {BASE_FIELDS}, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select(F.col("_k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality")


def op4_quality_rules(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return quality_rules(docs, spark.read.parquet(f"{folder}/labels.parquet"))
