"""Language identification by a byte convolutional network.

Texts are cut in windows of a fixed length. Filters of several widths slide over one-hot
bytes, each keeps its largest response in the window, and a softmax layer gives the window's
languages; a text's scores are the mean over its windows, all of them. The net is trained in
numpy on a bounded sample of labelled windows and applied to Arrow batches. On one-hot bytes a
filter is a table lookup per byte; bytes are looked up in pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.text import chunks, column, inside, lean
from gridspark.runtime import ship_package

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
# Training takes at most so many documents of a language and windows of a document.
DOCS_PER_LANGUAGE = 800
WINDOWS_PER_DOC = 4
EPOCHS = 14
FOLDS = 5
PAD = 256
UNKNOWN = "und"


def fold(key, folds: int = FOLDS) -> Column:
    """crc32 of the key as text, modulo the folds; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


@dataclass
class ByteNet:
    """Filter tables [width][offset, byte, filter], their biases, and a softmax layer."""

    languages: list
    tables: list
    biases: list
    weights: np.ndarray
    offset: np.ndarray
    paired: list | None = None

    def responses(self, windows: np.ndarray, width: int, which: int) -> np.ndarray:
        """[window, position, filter] of one width; windows end in padding bytes."""
        n = windows.shape[1] - width + 1
        total = self.biases[which]
        for k in range(width):
            total = total + self.tables[which][k][windows[:, k:k + n]]
        return total

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list]:
        found = [self.responses(windows, w, i) for i, w in enumerate(WIDTHS)]
        at = [r.argmax(1) for r in found]
        top = [np.take_along_axis(r, a[:, None], 1)[:, 0] for r, a in zip(found, at)]
        return np.maximum(np.concatenate(top, 1), 0), at

    def pair(self) -> None:
        """Tables of byte pairs, so that a filter of four bytes takes two lookups."""
        self.paired = []
        size = PAD + 1
        for table, bias in zip(self.tables, self.biases):
            steps = []
            for k in range(0, len(table) - 1, 2):
                both = table[k][:, None, :] + table[k + 1][None, :, :] + (bias if k == 0 else 0)
                steps.append((k, both.reshape(size * size, -1).astype(np.float32)))
            self.paired.append(steps)

    def scored(self, windows: np.ndarray) -> np.ndarray:
        """Softmax of every window, [window, language]."""
        pairs = windows[:, :-1].astype(np.int32) * (PAD + 1) + windows[:, 1:]
        tops = []
        for which, width in enumerate(WIDTHS):
            n = windows.shape[1] - width + 1
            total = None
            for k, both in self.paired[which]:
                got = np.take(both, pairs[:, k:k + n], axis=0)
                total = got if total is None else np.add(total, got, out=total)
            if width % 2:
                total += np.take(self.tables[which][width - 1], windows[:, width - 1:width - 1 + n], axis=0)
            tops.append(total.max(1))
        return _softmax(np.maximum(np.concatenate(tops, 1), 0) @ self.weights + self.offset)


def _softmax(x):
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list, filters: int = FILTERS,
          epochs: int = EPOCHS, seed: int = 7) -> ByteNet:
    """Adam on the cross entropy of windows [n, bytes]; only each filter's largest response learns."""
    rng = np.random.default_rng(seed)
    net = ByteNet(languages, [rng.normal(0, 0.3, (w, PAD + 1, filters)).astype(np.float32) for w in WIDTHS],
                  [np.zeros(filters, np.float32) for _ in WIDTHS],
                  rng.normal(0, 0.3, (filters * len(WIDTHS), len(languages))).astype(np.float32),
                  np.zeros(len(languages), np.float32))
    params = [*net.tables, *net.biases, net.weights, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, batch = 0, 64
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        rate = 0.02 * (1 - epoch / epochs)
        for start in range(0, len(order), batch):
            rows = order[start:start + batch]
            x = windows[rows]
            top, at = net.pooled(x)
            error = _softmax(top @ net.weights + net.offset)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error /= len(rows)
            back = (error @ net.weights.T) * (top > 0)
            grads = [np.zeros_like(p) for p in params]
            for i, width in enumerate(WIDTHS):
                g = back[:, i * filters:(i + 1) * filters]
                grads[len(WIDTHS) + i][:] = g.sum(0)
                columns = np.broadcast_to(np.arange(filters), g.shape)
                for k in range(width):
                    np.add.at(grads[i][k], (np.take_along_axis(x, at[i] + k, 1), columns), g)
            grads[-2][:] = top.T @ error
            grads[-1][:] = error.sum(0)
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.pair()
    return net


def cut_windows(buf: np.ndarray, off: np.ndarray, length: int = WINDOW):
    """(windows [n, length], windows of each text): whole texts, the last window padded."""
    sizes = np.diff(off)
    counts = -(-sizes // length)
    row = np.repeat(np.arange(len(sizes)), counts)
    start = off[:-1][row] + inside(counts) * length
    held = np.concatenate([buf, np.zeros(length, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(held, length)[start].astype(np.int16)
    room = off[1:][row] - start
    windows[np.arange(length) >= room[:, None]] = PAD
    return windows, counts


def training_windows(docs: DataFrame, text: str, lang: str, key: str,
                     per_language: int = DOCS_PER_LANGUAGE, per_doc: int = WINDOWS_PER_DOC):
    """(windows, labels, languages) of a bounded, hash-drawn sample of labelled rows.

    At most ``per_language`` rows of each label and ``per_doc`` windows of a row, evenly over
    its whole text; the labels themselves are few. Null labels and empty texts are left out.
    """
    known = docs.where(F.col(lang).isNotNull() & (F.octet_length(text) > 0))
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return np.zeros((0, WINDOW), np.int16), np.zeros(0, int), []
    draw = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000))
    # A little more than wanted is drawn; the surplus by hash order goes below.
    limit = F.lit(0)
    for name in languages:
        limit = F.when(F.col(lang) == name, int(1_300_000 * per_language / sizes[name]) + 1).otherwise(limit)
    data, n = F.col("_bytes"), F.octet_length("_bytes")
    step = F.greatest(F.floor((n - WINDOW) / max(1, per_doc - 1)), F.lit(1))
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(per_doc - 1)), lambda i: i * step + 1),
                      lambda s: (s == 1) | (s + WINDOW - 1 <= n))
    parts = F.transform(starts, lambda s: F.substring(data, s.cast("int"), F.lit(WINDOW)))
    rows = known.where(draw < limit).withColumn("_bytes", F.col(text).cast("binary")).select(
        F.col(lang).alias("lang"), F.xxhash64(key).alias("draw"), parts.alias("parts"))
    order = Window.partitionBy("lang").orderBy("draw", "parts")
    held = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    held = held.orderBy("lang", "place").collect()
    windows, labels = [], []
    for r in held:
        for part in r.parts:
            row = np.full(WINDOW, PAD, np.int16)
            row[:len(part)] = np.frombuffer(bytes(part), np.uint8)
            windows.append(row)
            labels.append(languages.index(r.lang))
    return np.array(windows), np.array(labels), languages


def _apply(net: ByteNet):
    def run(batches):
        if net.paired is None:
            net.pair()
        for batch in batches:
            keep = [batch.column(i) for i in range(1, batch.num_columns)]
            for first, buf, off in chunks(batch.column(0), 400_000):
                n = len(off) - 1
                windows, counts = cut_windows(buf, off)
                total = np.zeros((n, len(net.languages)))
                row = np.repeat(np.arange(n), counts)
                for at in range(0, len(windows), 128):
                    part = slice(at, at + 128)
                    np.add.at(total, row[part], net.scored(windows[part]))
                share = total / np.maximum(counts, 1)[:, None]
                best = share.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [*[k.slice(first, n) for k in keep], column([net.languages[b] for b in best], pa.string()),
                     column(np.minimum(share[np.arange(n), best], 1.0), pa.float64())],
                    names=[*batch.schema.names[1:], "guess", "score"])
    return run


def identify(docs: DataFrame, trained_on: DataFrame, text: str = "text", lang: str = "lang",
             key: str = "doc_id") -> DataFrame:
    """``docs`` with lang_pred and score, from a net learned on ``trained_on``.

    A null text or one without a letter is ``und`` with score 0, and so is every text when
    there is nothing to learn from. Neither label, key nor source is looked at to predict.
    """
    spark = docs.sparkSession
    ship_package(spark)
    windows, labels, languages = training_windows(trained_on, text, lang, key)
    if not languages:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    net = train(windows, labels, languages)
    net.paired = None  # each task builds the pair tables, the model itself is small
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    rows = docs.select(F.col(text).alias("t"), *carried, lettered)
    kinds = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    out = rows.mapInArrow(lean(_apply(net)), f"{kinds}, lettered boolean, guess string, score double")
    named = {"lang_pred": F.when(F.col("lettered"), F.col("guess")).otherwise(UNKNOWN),
             "score": F.when(F.col("lettered"), F.col("score")).otherwise(0.0)}
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)],
                      *[v.alias(k) for k, v in named.items()])


def op2_language_id(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = docs.select("doc_id", "text", (fold("doc_id") == 0).alias("held_out"))
    return identify(held, docs.where(fold("doc_id") != 0)).select("doc_id", "held_out", "lang_pred", "score")
