"""Exact dedup, the conversation trie and lexical search against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import digests, lexical, trie
from gridspark.runtime import scratch_path

RNG = np.random.default_rng(5)
DOCS = "doc_id LONG, text STRING"


# Exact dedup

def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def plain_dedup(rows):
    groups = defaultdict(list)
    for k, (doc, text) in enumerate(rows):
        groups[plain(text)].append((-len(text or ""), doc is None, doc, k))
    out = []
    for k, (doc, text) in enumerate(rows):
        group = groups[plain(text)]
        best = min(group, key=lambda g: (g[0], g[1], g[2] or 0, g[3]))
        out.append((doc, best[2], len(group), best[3] == k, hashlib.sha256(plain(text).encode()).hexdigest()))
    return sorted(out, key=str)


AWKWARD = [
    (1, "a b c"), (2, "abc"), (3, "a  b\tc\n"), (4, "a  b\tc\n"), (5, "abd"), (6, None), (7, ""), (8, " \n "), (9, " "),
    (10, "é" * 2000), (11, "é " * 2000), (12, "é\v" * 2000), (12, "é " * 2000), (12, "é " * 2000), (None, "abd"), (None, "zz"),
    (None, "z z"), (13, "long " * 30_000), (14, "long\f" * 30_000), (5, "abd")]


@pytest.mark.parametrize("rows", [AWKWARD, [], [(i, "same text") for i in range(300)],
                                  [(int(i), "x " * int(i % 7) + "y" * int(i % 3)) for i in RNG.permutation(200)]])
def test_exact_dedup(spark, tmp_path, rows):
    path = str(tmp_path)
    spark.createDataFrame([(*r, "s") for r in rows], DOCS + ", digest STRING").write.parquet(f"{path}/documents.parquet")
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in digests.op11_exact_dedup(spark, path).collect()]
    # Which of several equal rows is the kept one is all that may differ.
    assert sorted(got, key=str) == plain_dedup(rows)


def test_index_persists_and_only_new_rows_are_appended(spark):
    path = scratch_path(spark, "digests")
    index = digests.DigestIndex(spark, path, buckets=4)
    one = spark.createDataFrame([(1, "a b", 1), (2, "ab", 2), (None, None, 3)], DOCS + ", load INT")
    assert [r.load for r in digests.add_documents(one, index, "one").orderBy("load").collect()] == [1, 3]
    index.close()
    again = digests.DigestIndex(spark, path)
    assert again.buckets == 4 and again.entries().count() == 2
    two = spark.createDataFrame([(9, "a   b", 1), (4, "c", 2), (4, "c", 2), (3, "\tc", 3), (5, "", 4)], DOCS + ", load INT")
    new = digests.add_documents(two, again, "two")
    assert [tuple(r) for r in new.collect()] == [(3, "\tc", 3)] and new.columns == ["doc_id", "text", "load"]
    assert again.entries().count() == 3
    # A load that is appended once more adds nothing, and the same rows stay.
    assert digests.add_documents(two, again, "two").count() == 1 and again.entries().count() == 3
    again.close()


def test_the_index_is_not_moved_by_the_anti_join(spark):
    index = digests.DigestIndex(spark, scratch_path(spark, "digests"), buckets=8)
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(50)], DOCS)
    prints = digests.fingerprints(rows, F.lit("one"))
    index.append(prints)
    plan = index.unseen(prints)._jdf.queryExecution().executedPlan().toString()
    anti = plan[plan.index("SortMergeJoin"):]
    scan = anti[:anti.index("gridspark_digests")]
    assert "LeftAnti" in plan and scan.count("Exchange") == plan.count("Exchange")
    right = anti.split("gridspark_digests")[0].splitlines()[-3:]
    assert not any("Exchange" in line for line in right)
    index.close()


# Conversation trie

def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        full[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, held in members.items():
        below = [p for p in members if p[:len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in below if q)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in held if len(full[c]) == len(path)))
        out.append((min(held), len(path), min(members[path[:-1]]) if path else None, len(held), len(children), len(leaves),
                    saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n, words=3, turns=12):
    rng = np.random.default_rng(seed)
    return [(int(c), t, "user" if t % 2 == 0 else "bot", "w é"[:int(rng.integers(0, words + 1))])
            for c in rng.permutation(n) for t in range(int(rng.integers(0, turns)))]


ODD = [(-3, 1, "user", "hi"), (-3, None, None, "first"), (0, 0, "user", None), (0, 0, "user", None), (0, 1, "bot", ""),
       (None, 0, "user", "x"), (None, None, None, None), (4, 0, None, None), (10**15, 2, "user", "a,b"), (7, 5, "a:", "b"), (7, 5, "a", ":b")]


@pytest.mark.parametrize("rows", [conversations(1, 60), conversations(2, 200, 1, 6), ODD, ODD * 2, [],
                                  [(c, t, "user", "same") for c in range(60) for t in range(10)],
                                  [(5, t, "user", f"turn {t}") for t in range(400)] + [(6, 0, "user", "z " * 100_000)]])
def test_conversation_trie(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(trie, "BLOCK", 64)
    monkeypatch.setattr(trie, "PIECE", 50)
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id LONG, turn INT, role STRING, text STRING, depth INT").write.parquet(path)
    out = trie.op12_conversation_trie(spark, str(tmp_path))
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out.collect()]
    assert sorted(got, key=str) == plain_trie(rows)
    assert {t for c, t in out.dtypes if c != "ends_sha256"} == {"bigint"}


def test_running_sums_cross_blocks(spark):
    rows = [(k, p, int(RNG.integers(0, 9))) for k in range(3) for p in range(50 * k + 1)]
    got = trie.running(spark.createDataFrame(rows, "k INT, p LONG, v LONG"), "k", "p", {"v": "s"}, block=8)
    want = {(k, p): sum(v for a, b, v in rows if a == k and b <= p) for k, p, _ in rows}
    assert {(r.k, r.p): r.s for r in got.collect()} == want


# Lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def tokens(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top=20):
    terms = [(doc, Counter(tokens(text))) for doc, text in docs]
    terms = [(doc, c, sum(c.values())) for doc, c in terms if c]
    n_docs, n_terms = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(tokens(text)), []
        for doc, c, n in terms:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in asked.items() if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, none, doc) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, None if none else doc, -score))
    return sorted(out, key=str)


def corpus(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" if i % 9 else f"É{i}x" for i in range(vocabulary)]
    draw = lambda k: " ".join(words[i] for i in np.minimum(rng.zipf(1.3, k), vocabulary) - 1)
    docs = [(int(i), draw(int(rng.integers(1, 200)))) for i in rng.permutation(n)]
    return docs, [(int(i), draw(int(rng.integers(1, 30)))) for i in range(25)]


def ranked(spark, docs, items, **how):
    got = lexical.search(spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", item STRING").repartition(3),
                         spark.createDataFrame([(*i, 0) for i in items], "item_id LONG, text STRING, score INT"), **how)
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()], key=str)


@pytest.mark.parametrize("how", [{}, {"pass_terms": 40}])
def test_search_equals_plain(spark, how):
    docs, items = corpus(3, 500)
    assert ranked(spark, docs, items, **how) == plain_search(docs, items)


def test_search_with_loose_signatures(spark, monkeypatch):
    """Signatures so full that nearly every term seems present still give exact results."""
    monkeypatch.setattr(lexical, "MOST_SLICES", 64)
    docs, items = corpus(4, 300)
    assert ranked(spark, docs, items) == plain_search(docs, items)


def test_search_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "... !"), (4, "Alpha alpha ALPHA beta"), (4, "alpha"), (4, "alpha"), (None, "alpha beta"),
            (None, "gamma"), (5, "beta " * 60_000 + "alpha"), (6, "ÀLPHA Àlpha"), (7, "x" * 300_000)] + [(100 + i, "delta copy") for i in range(60)]
    items = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, " - "), (None, "gamma alpha"), (4, "delta " * 3), (5, "Àlpha"),
             (6, "x" * 300_000), (7, "nowhere")]
    assert ranked(spark, docs, items) == plain_search(docs, items)
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == []
    assert ranked(spark, docs, items, top=2) == plain_search(docs, items, 2)


def test_bounds_are_never_below_scores(spark):
    docs, items = corpus(6, 200)
    index = lexical.build_index(spark.createDataFrame(docs, "key LONG, text STRING"), scratch_path(spark, "signatures"))
    size = index.where("kind = 'block'").agg(F.sum("docs"), F.sum("terms")).first()

    def of(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        return lexical.counted(buf, np.array([0, len(buf)]))

    terms = {doc: (dict(zip(t.tolist(), c.tolist())), int(n[0])) for doc, (t, c, _, n) in ((d, of(x)) for d, x in docs)}
    group = [(i, *of(x)[:2]) for i, (_, x) in enumerate(items)]
    search = lexical.Pass(group, *size)
    search.weights[:] = 1
    excluded = total = 0
    for r in index.where("kind = 'block'").collect():
        keys, lengths = np.frombuffer(r.keys, np.int64), np.frombuffer(r.lengths, np.int64)
        for cols, sums in lexical._bounds(search, r.slices, r.docs, lengths, r.bits):
            for item, bound in sums:
                for d, key in enumerate(keys[cols]):
                    held, n = terms[int(key)]
                    m = 75 + 25 * n * size[0] // size[1]
                    score = sum(int(k) * (10**9 * held[t] // (1000 * held[t] + 12 * m))
                                for t, k in zip(group[item][1].tolist(), group[item][2]) if t in held)
                    up = 0 if bound is None else int(bound[d])
                    assert up >= score
                    total, excluded = total + 1, excluded + (up < 1.2 * score + 1)
    assert excluded > 0.8 * total
