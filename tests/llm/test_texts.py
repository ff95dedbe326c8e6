"""Operators on texts against plain versions, with awkward rows."""

import hashlib
import re
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import jaccard, language, perplexity, quality, suffixes
from gridspark.llm.links import components, narrow
from gridspark.llm.text import chunks, packed, packed_runs, unpacked, unpacked_runs
from tests.llm import brute

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, owner STRING, n LONG"
RNG = np.random.default_rng(11)


def frame(spark, rows):
    """(doc_id, text) rows as documents, with columns whose names operators use inside."""
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], SCHEMA)


def prose(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(n))


def awkward():
    base = prose(120, 1)
    words = base.split(" ")
    near = " ".join([*words[:60], "Changed", *words[61:]])
    chain = [" ".join(words[k:k + 100]) for k in (0, 6, 12, 18)]
    return [
        (1, base), (2, base.upper().replace("É", "é")), (3, near), (4, None), (5, ""), (6, " \n\t"), (7, "a b"),
        (8, "A  b"), (9, "a b c"), (10, "word " * 400), (11, "word " * 30), (12, prose(6000, 3)),
        *[(20 + k, t) for k, t in enumerate(chain)], (30, base), (30, prose(50, 9)), (31, prose(50, 9)),
        (40, "x"), (41, "x"), (42, base + " " + prose(70, 5)),
    ]


def test_jaccard_groups(spark):
    rows = awkward()
    got = sorted(tuple(r) for r in jaccard.jaccard_groups(frame(spark, rows)).collect())
    assert got == brute.groups(rows)


def test_jaccard_groups_of_near_copies(spark):
    base = prose(150, 21).split(" ")
    rows = []
    for i in range(120):
        own = list(base)
        for at in RNG.choice(150, int(RNG.integers(1, 7)), replace=False):
            own[at] = f"w{i}_{at}"
        rows.append((i, " ".join(own)))
    got = sorted(tuple(r) for r in jaccard.jaccard_groups(frame(spark, rows)).collect())
    assert got == brute.groups(rows) and len({r[2] for r in got}) < 100


def test_jaccard_without_rows_or_ids(spark):
    assert jaccard.jaccard_groups(frame(spark, [])).count() == 0
    base = prose(120, 1).split(" ")
    chain = [" ".join(base[k:k + 100]) for k in (0, 6, 12)]
    # The row in the middle has no id, and links the other two.
    got = jaccard.jaccard_groups(frame(spark, [
        (None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, "x y"), (None, "x y"),
        (8, chain[0]), (None, chain[1]), (7, chain[2]), (None, None)]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        (3, 2, 3), (None, 2, 3), (None, 2, 3), (None, 1, None), (None, 1, None), (8, 96, 7), (None, 96, 7), (7, 96, 7),
        (None, 0, None)], key=str)


def test_repeated_bytes(spark):
    shared, run = prose(90, 31), "ab" * 600
    rows = [(1, shared + prose(100, 32)), (2, prose(37, 33) + shared + prose(80, 34)), (3, None), (4, ""), (5, run),
            (6, prose(200, 35)), (7, prose(200, 35)), (8, "short"), (9, "short"), (10, shared[:399]),
            (11, prose(10, 36) + prose(200, 35)[100:504]), (12, "é" * 500 + prose(60, 37)), (13, "x" + "é" * 450)]
    facts, cut = suffixes.repeated_bytes(frame(spark, rows))
    assert sorted(tuple(r)[:5] for r in facts.collect()) == brute.repeats(rows)
    kept = {r.doc_id: bytes(r.kept) for r in cut.collect()}
    want = {r[0]: r[4] for r in brute.repeats(rows)}
    assert kept and all(hashlib.sha256(b).hexdigest() == want[i] for i, b in kept.items())


@pytest.mark.parametrize("length", [400, 401, 430])
def test_shortest_repeats_at_any_offset(spark, length):
    shared = prose(300, 41)[:length]
    rows = [(i, prose(9 + i, 42 + i) + shared + prose(20, 90 + i)) for i in range(4)]
    got = sorted(tuple(r)[:5] for r in suffixes.repeated_bytes(frame(spark, rows))[0].collect())
    assert got == brute.repeats(rows) and all(r[2] >= 400 for r in got)


def test_repeats_of_no_rows_and_without_ids(spark):
    assert suffixes.repeated_bytes(frame(spark, []))[0].count() == 0
    text, shared = prose(200, 35), prose(90, 31)
    rows = [(None, text), (1, text), (1, "other"), (None, shared + prose(100, 32)), (2, prose(37, 33) + shared), (None, None)]
    got = sorted((tuple(r)[:5] for r in suffixes.repeated_bytes(frame(spark, rows))[0].collect()), key=str)
    want = [(rows[k][0], *r[1:]) for k, *r in brute.repeats([(k, t) for k, (_, t) in enumerate(rows)]) for r in [(k, *r)]]
    assert got == sorted(want, key=str) and sum(r[2] > 0 for r in got) == 4
    kept = suffixes.drop_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept if r.doc_id) == sorted(
        (r[0], r[4]) for r in want if r[0] and r[1] > r[2])
    assert len(kept) == 4


def test_dropping_repeats_keeps_valid_text(spark):
    shared = "é" * 300
    docs = frame(spark, [(1, "a" + shared), (2, "bb" + shared + "c"), (3, prose(120, 3)), (4, prose(120, 3)), (5, None)])
    got = {r.doc_id: (r.text, r.n_chars, r.owner) for r in suffixes.drop_repeats(docs).collect()}
    assert got == {1: ("a", 1, "x"), 2: ("bbc", 3, "x"), 5: (None, 0, "x")}


def test_the_cover_brings_any_two_places_together():
    for modulus, cover in ((suffixes.MODULUS, suffixes.COVER), (suffixes.SHORT_MODULUS, suffixes.SHORT_COVER)):
        mask = suffixes.cover_mask(modulus, cover)
        assert all((mask & np.roll(mask, -d)).any() for d in range(modulus))


@pytest.mark.parametrize("length", [199, 200, 230])
def test_short_repeats_at_any_offset(spark, length):
    shared = prose(300, 41)[:length]
    rows = [(i, prose(9 + i, 42 + i) + shared + prose(20, 90 + i)) for i in range(4)]
    found = suffixes.repeated_bytes(frame(spark, rows), 200, suffixes.SHORT_MODULUS, suffixes.SHORT_COVER)[0]
    assert sorted(tuple(r)[:5] for r in found.collect()) == brute.repeats(rows, 200)


def test_packed_numbers():
    for dtype in (np.int32, np.int64):
        xs = RNG.integers(np.iinfo(dtype).min, np.iinfo(dtype).max, 1000, dtype=dtype)
        assert (unpacked([packed(xs), packed(xs[:1]), None, packed(xs[:0])], dtype) == np.concatenate([xs, xs[:1]])).all()


def test_packed_runs():
    xs = np.repeat(RNG.integers(-2**63, 2**63 - 1, 50, dtype=np.int64), RNG.integers(1, 9, 50))
    assert (unpacked_runs([packed_runs(xs), None, packed_runs(xs[:0]), packed_runs(xs[:1])]) == np.concatenate([xs, xs[:1]])).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (200, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a LONG, b LONG")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 0}
    assert components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def test_narrow_keeps_what_is_asked_for(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"))
    got = {r.doc_id for r in narrow(rows, rows.where("doc_id % 7 = 0")).collect()}
    assert set(range(0, 3000, 7)) <= got and len(got) < 600
    assert {r.doc_id for r in narrow(rows, rows.limit(0)).collect()} == set()


def counts(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(found[i:i + 8]) for i in range(len(found) - 7))
    held = {j for i in range(len(found) - 7) if runs[tuple(found[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(held))


def test_quality_counts(spark):
    texts = [None, "", "\n\n", "a\na\n a\na\r\na", "x # é *", "one two\n" * 60, prose(50, 1), " ".join("ab" * 9),
             prose(12, 4) + "\n" + prose(12, 4), "\x0b\x0c tail", "emoji 😀 <b>", prose(9000, 6)]
    rows = list(enumerate(texts))
    labels = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    got = quality.quality_rules(frame(spark, rows), labels).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in got} == {i: counts(t) for i, t in rows}
    for r in got:
        n, repeat = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n) and r.kept == (not r.base_failed)
    assert quality.quality_rules(frame(spark, []), labels).count() == 0


def test_quality_classifier_on_labelled_rows(spark):
    good = [(i, prose(60, i)) for i in range(80)]
    bad = [(100 + i, "$$ ".join(prose(60, 500 + i).upper().split(" "))) for i in range(80)]
    rows = [*good, *bad, (None, prose(60, 1)), (999, None)]
    known = spark.createDataFrame(
        [(i, int(i < 100), 0) for i, _ in good[:60] + bad[:60]] + [(None, 1, 0), (3, None, 0), (7777, 0, 0)],
        "doc_id LONG, quality INT, toxic INT")
    got = {r.doc_id: r for r in quality.quality_rules(frame(spark, rows), known).collect()}
    assert all(got[i].kept for i, _ in good) and not any(got[i].kept for i, _ in bad) and not got[999].kept
    assert all(0 <= r.quality <= 1 for r in got.values())


def test_language_held_out_accuracy_and_awkward_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(9001, None), (9002, ""), (9003, "123 ## \n"), (9004, "é"), (None, "Der und die nicht")]
    rows = docs.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame([(i, t, None) for i, t in extra], "doc_id LONG, text STRING, lang STRING"))
    rows = rows.withColumns({"guess": F.lit(1), "score": F.lit("clash"), "c0": F.lit(2)}).drop("score")
    got = language.identify(rows, docs.where(language.fold("doc_id") != 0)).collect()
    assert len(got) == docs.count() + len(extra) and {r.guess for r in got} == {1}
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (9001, 9002, 9003))
    assert by_id[9004].lang_pred != "und"
    right = [r.lang_pred == r.lang for r in got if r.lang]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_with_nothing_to_learn(spark):
    docs = frame(spark, [(1, "abc"), (2, None)])
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.identify(docs, none).collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0), docs).count() == 0


def test_windows_cover_whole_texts():
    import pyarrow as pa
    texts = ["a" * 600, "", "b" * 256, None]
    (_, buf, off), = chunks(pa.array(texts))
    windows, per = language.cut_windows(buf, off)
    assert per.tolist() == [3, 0, 1, 0]
    assert (windows != language.PAD).sum() == 856


def kneser_ney(trusted, order=4):
    """Plain counts over the same symbols: a function from n-gram to probability."""
    counts = Counter()
    for symbols in trusted:
        full = [0] * (order - 1) + symbols
        counts.update(tuple(full[i:i + order]) for i in range(len(symbols)))
    grams = {order: counts}
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    cuts = {n: perplexity.discounts(*[sum(v == k for v in grams[n].values()) for k in range(1, 5)]) for n in grams}

    def p(gram):
        if not gram:
            return 1 / perplexity.SYMBOLS
        n = len(gram)
        near = {g: c for g, c in grams[n].items() if g[:-1] == gram[:-1]}
        lower = p(gram[1:])
        if not near:
            return lower
        total, cut = sum(near.values()), lambda c: cuts[n][min(c, 3) - 1]
        seen = max(near[gram] - cut(near[gram]), 0) if gram in near else 0
        return seen / total + sum(cut(c) for c in near.values()) / total * lower
    return p


def test_perplexity_against_plain_counts(spark):
    rows = [(i, prose(25, i)) for i in range(30)] + [(50, "ZZ ## $$ zz"), (51, None), (52, ""), (53, "q"), (None, "abc")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 30, 2)] + [(1, 0, 0), (50, 1, 1), (3, None, None)],
                                   "doc_id LONG, quality INT, toxic INT")
    got = perplexity.judge_perplexity(frame(spark, rows), labels).collect()
    folds = {r.doc_id: r.f for r in frame(spark, rows).select("doc_id", language.fold("doc_id").alias("f")).collect()}
    learn = [t for i, t in rows[:30] if i % 2 == 0 and folds[i] != 0]
    table = perplexity.alphabet(np.bincount(np.frombuffer("".join(learn).encode(), np.uint8), minlength=256))
    p = kneser_ney([table[np.frombuffer(t.encode(), np.uint8)].tolist() for t in learn])
    texts = dict(rows)
    for r in got:
        symbols = table[np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8)].tolist()
        if not symbols:
            assert r.perplexity is None and not r.kept
            continue
        full = [0, 0, 0] + symbols
        logs = [np.log(p(tuple(full[i:i + 4]))) for i in range(len(symbols))]
        assert np.isclose(r.perplexity, np.exp(-np.mean(logs)), rtol=1e-4)
    assert perplexity.judge_perplexity(frame(spark, []), labels).count() == 0


@pytest.mark.parametrize("order", [4, 5])
def test_perplexity_keeps_every_byte_apart(spark, order):
    """More than 62 different bytes: characters that are rare in the trusted text stay different ones."""
    letters = [chr(c) for c in [*range(33, 127), *range(0x3B1, 0x3C9), *range(0x430, 0x44F)]]
    rng = np.random.default_rng(5)
    common = ["".join(rng.permutation(letters)) for _ in range(6)]
    rows = [(i, t + "жщж" * 9) for i, t in enumerate(common)] + [(20, "жщж" * 20), (21, "щщж" * 20), (22, "☃" * 9)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id LONG, quality INT, toxic INT")
    docs = frame(spark, rows)
    folds = {r.doc_id: r.f for r in docs.select("doc_id", language.fold("doc_id").alias("f")).collect()}
    learn = [t for i, t in rows[:6] if folds[i] != 0]
    p = cache(kneser_ney([[b + 1 for b in t.encode()] for t in learn], order))
    got = {r.doc_id: r.perplexity for r in perplexity.judge_perplexity(docs, labels, order=order).collect()}
    for i, t in rows:
        full = [0] * (order - 1) + [b + 1 for b in t.encode()]
        logs = [np.log(p(tuple(full[at:at + order]))) for at in range(len(t.encode()))]
        assert np.isclose(got[i], np.exp(-np.mean(logs)), rtol=1e-4)
    assert got[20] < got[21] < got[22]


def test_threshold_is_a_quantile_of_its_group(spark):
    values = {"a": RNG.lognormal(size=500), "b": RNG.lognormal(2, 1, size=7)}
    df = spark.createDataFrame([(g, float(v)) for g, xs in values.items() for v in xs], "g STRING, v DOUBLE")
    for r in perplexity.upper_quantile(df, "g", "v", 0.9).collect():
        exact = np.sort(values[r.g])[int(np.ceil(0.9 * len(values[r.g]))) - 1]
        assert exact <= r.threshold <= exact * 1.001
