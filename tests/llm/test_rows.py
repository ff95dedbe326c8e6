"""Mixing, chat formatting, URL rules, packing, neighbours and the pipeline against plain versions."""

import hashlib
import json
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import chat, mixing, neighbours, packing, urls
from gridspark.llm.language import fold
from tests.llm import brute

RNG = np.random.default_rng(17)


def targets(sizes, weights=(3, 1, 2)):
    """Shares by weight, capped at twice the size; the excess is shared again until none is above."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, pool, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        level = pool / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            pool -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("sizes", [
    {"a": [5, 0, 7], "b": [100] * 30, "é": [1], None: [40, 2]}, {"a": [0, 0]}, {"x": [3]},
    {f"s{i}": [int(v) for v in RNG.integers(0, 50, 1 + 7 * i)] for i in range(8)}])
def test_mixing_meets_its_targets(spark, sizes):
    rows = [(s, n) for s, ns in sizes.items() for n in ns]
    df = spark.createDataFrame([(i, s, n, "x") for i, (s, n) in enumerate(rows)], "doc_id LONG, source STRING, size LONG, target STRING")
    got = mixing.mix_sources(df).collect()
    want = targets({s: sum(ns) for s, ns in sizes.items()})
    taken = defaultdict(int)
    for r in got:
        assert np.isclose(r.target, want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) < 1 + 1e-6 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(5)).collect()))


def test_mixing_repeated_and_null_rows(spark):
    rows = [(1, "a", 10)] * 4 + [(None, "a", 3), (None, None, None), (2, None, 8)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id LONG, source STRING, size LONG")).collect()
    assert len(got) == 7 and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id LONG, source STRING, size LONG")).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(3 + i)), "ab"[i % 2], 1, "t") for i in range(12)] + [(50, None, "a", 0, "t")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING, n_chars LONG, taken STRING")
    sized = docs.select("doc_id", "source", mixing.word_count("text").alias("size"))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    held = defaultdict(int)
    for r in out.collect():
        held[r.source] += len(r.text.split())
    want = {r.source: int(r.target) for r in mixing.source_targets(sized.select("source", "size")).collect()}
    assert dict(held) == want


MESSAGES = "conv_id LONG, turn LONG, role STRING, text STRING, call_id STRING, name STRING, arguments MAP<STRING, STRING>, result_of STRING, needs ARRAY<STRING>, level STRING"


def test_chat_links_orders_and_validates(spark):
    ok = {"prompt": '"p"', "words": "3"}
    rows = [
        (1, 0, "user", 'say "hi"\n\x01\\é', None, None, None, None, None, "z"),
        (1, 1, "assistant", None, "c1", "brief", ok, None, None, "z"),
        (1, 2, "tool", "done", None, None, None, "c1", None, "z"),
        (1, 3, "assistant", "", "c2", "brief", {"prompt": "3"}, None, ["c1"], "z"),
        (1, 4, "assistant", "", "c3", "nosuch", ok, None, ["c2", "c1", None], "z"),
        (1, 5, "assistant", "", "c4", "reply", {**ok, "language": "true", "more": "1"}, None, ["c5"], "z"),
        (2, 0, "assistant", "", "c5", "reply", {**ok, "words": "1.5"}, None, ["c4"], "z"),
        (2, 1, "tool", "lost", None, None, None, "c9", None, "z"),
        (None, None, None, None, "c6", None, None, None, ["gone"], "z"),
    ]
    got = chat.link_calls(spark.createDataFrame(rows, MESSAGES)).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    facts = {k: (r.level, r.status, r.problem) for k, r in by.items()}
    assert facts == {
        (1, 0): (0, "plain", None), (1, 1): (0, "answered", None), (1, 2): (1, "linked", None),
        (1, 3): (2, "open", "type of prompt"), (1, 4): (4, "open", "unknown tool"),
        (1, 5): (None, "open", "type of language"), (2, 0): (None, "open", "type of words"),
        (2, 1): (None, "orphan", None), (None, None): (None, "open", "unknown tool")}
    for key, r in by.items():
        said = json.loads(r.json)
        assert list(said) == sorted(said)
        assert r.json == json.dumps(said, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert json.loads(by[1, 0].json)["content"] == rows[0][3]
    assert json.loads(by[1, 1].json)["tool"] == {"arguments": {"prompt": "p", "words": 3}, "name": "brief"}
    assert chat.link_calls(spark.createDataFrame([], MESSAGES)).count() == 0


def test_long_chains_of_calls(spark):
    edges = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(12)] + [("c3", "c3x"), ("c3x", None)]
    got = {r.call_id: r.level for r in chat.levels(spark.createDataFrame(edges, "call_id STRING, needs STRING")).collect()}
    assert got == {**{f"c{i}": i for i in range(12)}, "c3x": 0}


def test_turns_of_a_conversation_form_one_chain(spark, monkeypatch):
    """Calls follow the user turn before them, across blocks, gaps, repeats and missing numbers."""
    monkeypatch.setattr(chat, "TURN_BLOCK", 4)
    asked = {1: [0, 2, 4, 6, 8, 10, 12], 2: [1, 3, 5], 3: [0, 1, 40, 41], 4: [7]}
    rows = [(c, t, "user", f"say {t}") for c, turns in asked.items() for t in turns]
    rows += [(c, t + 1, "assistant", None) for c, t, *_ in rows if t + 1 not in asked[c]]
    rows += [(2, 0, "system", ""), (2, 3, "user", "say 3"), (4, None, "user", "x"), (None, 2, "user", "y"),
             (4, 3, "assistant", "z"), (5, None, "assistant", "w"), (4, 9, None, "v")]
    turns = spark.createDataFrame(rows, "conv_id LONG, turn INT, role STRING, text STRING")
    got = chat.link_calls(chat.turns_as_calls(turns)).collect()
    assert len(got) == len(rows)
    for c, wanted in asked.items():
        level = {r.turn: r.level for r in got if r.conv_id == c and r.status in ("open", "answered")}
        assert level == {t: 2 * i for i, t in enumerate(wanted)}
        said = sorted((r.level, r.turn) for r in got if r.conv_id == c and r.level is not None and r.status != "plain")
        assert [t for _, t in said] == sorted(t for _, t in said)
    odd = {(r.conv_id, r.turn): r.status for r in got if None in (r.conv_id, r.turn) or r.role is None}
    assert odd == {(4, None): "plain", (None, 2): "plain", (5, None): "plain", (4, 9): "plain"}
    assert [r.status for r in got if (r.conv_id, r.turn) == (4, 3)] == ["orphan"]
    assert chat.link_calls(chat.turns_as_calls(turns.limit(0))).count() == 0


def test_deep_graphs_of_calls_take_few_rounds(spark, monkeypatch):
    """A chain of 300 calls, others that branch off and meet again, cycles and absent calls."""
    needs = {f"c{i}": {f"c{i - 1}"} if i else set() for i in range(300)}
    needs |= {"join": {"c120", "c299"}, "after": {"join"}, "top": {"after", "c7", "c8"}, "side": {"c40"}}
    needs |= {"x0": {"x2"}, "x1": {"x0"}, "x2": {"x1"}, "behind": {"x1"}, "both": {"x1", "c1"}, "self": {"self"},
              "lost": {"gone"}, "later": {"lost"}, "half": {"gone", "c1"}}
    edges = [(c, n) for c, ns in needs.items() for n in (ns or {None})] + [("c5", None), ("c5", "c4"), (None, "c1")]
    want, left = {}, dict(needs)
    while found := {c: 1 + max((want[n] for n in ns), default=-1) for c, ns in left.items() if ns <= want.keys()}:
        want |= found
        left = {c: ns for c, ns in left.items() if c not in found}
    calls = []
    plain = chat.settle
    monkeypatch.setattr(chat, "settle", lambda df: calls.append(1) or plain(df))
    rows = chat.levels(spark.createDataFrame(edges, "call_id STRING, needs STRING")).collect()
    assert {r.call_id: r.level for r in rows} == want | dict.fromkeys(left) and len(rows) == len(needs)
    assert want["c299"] == 299 and want["top"] == 302 and len(calls) <= 25


@pytest.mark.parametrize("url, host, path, rule", [
    ("https://WWW.Example.ORG/es/1?x", "www.example.org", "/es/1", "example.org/es/"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/"), ("ftp://a.com/de/", "a.com", "/de/", "com/de/"),
    ("http://a.com/fr", "a.com", "/fr", None), ("http://org", "org", "", None), ("no scheme", "", "", None),
    (None, "", "", None), ("x://y#z/../", "y", "", None), ("a?b://c.org/d", "c.org", "/d", "org/"),
    ("http://h/a://b.com/fr/", "h", "/a://b.com/fr/", None)])
def test_url_parts_and_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(1, url, None)], "page_id LONG, url STRING, html STRING")
    r = urls.judge_urls(df).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert r.verdict == dict((h + p, v) for h, p, v in urls.RULES).get(rule, "allow")


def test_trust_and_distrust_follow_links(spark):
    def page(i, url, *to):
        return (i, url, "".join(f'<A class=x HREF="{t}">.</a>' for t in to) or None, 0)
    rows = [page(1, "http://good.org/", "http://near.net/a", "//near.net/b", "/inside"),
            page(2, "http://near.net/x", "https://far.net"), page(3, "http://far.net/"),
            page(4, "http://bad.com/de/1"), page(5, "http://links-bad.net/", "http://bad.com/"),
            page(6, "http://lone.net/"), page(6, "http://lone.net/"), page(None, None)]
    df = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, trust LONG")
    got = urls.judge_urls(df).collect()
    assert len(got) == len(rows)
    by = {r.host: r for r in got}
    assert by["good.org"].trust > by["near.net"].trust > by["far.net"].trust > 0 == by["lone.net"].trust
    assert by["links-bad.net"].distrust > 0 and by["links-bad.net"].verdict == "block"
    assert by["near.net"].verdict == by["lone.net"].verdict == by[""].verdict == "allow"
    d = urls.DAMPING
    assert np.isclose(by["far.net"].trust, (1 - d) * d * d)
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_distrust_goes_any_number_of_links(spark):
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">.</a>') for i in range(15)]
    rows += [(15, "http://h15.net/", '<a href="http://bad.com/">.</a>'), (16, "http://bad.com/de/1", None)]
    df = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    by = {r.host: r for r in urls.judge_urls(df).collect()}
    d = urls.DAMPING
    assert all(np.isclose(by[f"h{i}.net"].distrust, (1 - d) * d**(16 - i)) for i in range(16))
    assert {r.verdict for r in by.values()} == {"block"}
    with pytest.raises(ValueError):
        urls.judge_urls(df, rounds=5)


def plain_pack(pieces, capacity, per_source):
    """Every piece to the fullest compatible bin, the lowest number among equals, else a new one."""
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= size and cluster not in b["clusters"]
                and b["sources"].count(source) < per_source]
        if fits:
            i = min(fits)[1]
        else:
            bins.append({"room": capacity, "clusters": set(), "sources": []})
            i = len(bins) - 1
        out.append((i, capacity - bins[i]["room"]))
        bins[i]["room"] -= size
        bins[i]["clusters"].add(cluster)
        bins[i]["sources"].append(source)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_packing_is_best_fit_under_conflicts(seed):
    rng = np.random.default_rng(seed)
    pieces = sorted(((int(rng.integers(1, 40)), int(rng.integers(0, 3)), int(rng.integers(0, 1 + 12 * (seed % 3))))
                     for _ in range(160)), key=lambda p: (-p[0], p[2], p[1]))
    want = plain_pack(pieces, 40, 2)
    assert packing.pack(pieces, 40, 2) == want
    # Orders of their own for sources and clusters from the first bin on change nothing.
    assert packing.pack(pieces, 40, 2, 1) == want and packing.pack(pieces, 40, 2, 7) == want


def test_packing_with_shared_bits_and_copies_of_many_sources(monkeypatch):
    rng = np.random.default_rng(3)
    pieces = [(int(n), int(s), int(c)) for n, s, c in zip(
        rng.integers(1, 20, 400), rng.integers(0, 9, 400), rng.integers(0, 300, 400))]
    pieces += [(7, s % 50, 1000) for s in range(150)]
    pieces.sort(key=lambda p: (-p[0], p[2], p[1]))
    want = plain_pack(pieces, 40, 2)
    for bits, block, many in ((1, 512, 256), (8, 2, 3), (256, 1, 1)):
        monkeypatch.setattr(packing, "BITS", bits)
        monkeypatch.setattr(packing, "BLOCK", block)
        assert packing.pack(pieces, 40, 2, many) == want


def test_packing_of_a_hot_source_does_not_walk_its_full_bins(monkeypatch):
    """What a search looks at stays far below the bins that are open."""
    looks = 0
    plain = packing.Order.successor

    def counted(order, value):
        nonlocal looks
        looks += 1
        return plain(order, value)

    monkeypatch.setattr(packing.Order, "successor", counted)
    rng = np.random.default_rng(8)
    pieces = sorted(((int(n), 0, i) for i, n in enumerate(rng.integers(50, 150, 8000))), key=lambda p: (-p[0], p[2]))
    assert len({b for b, _ in packing.pack(pieces)}) == 2000
    assert looks < 20 * len(pieces)


def test_packed_documents(spark):
    rows = [(i, "hot" if i % 3 else f"s{i}", int(n), f"c{i % 11}") for i, n in enumerate(RNG.integers(0, 90, 300))]
    rows += [(900, None, None, None), (901, None, 120, None), (None, "x", 3, "c1"), (902, "big", 320, "c2")] + [(903, "r", 7, "same")] * 20
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id LONG, source STRING, size LONG, cluster STRING, start LONG")
    got = packing.pack_documents(df, capacity=64, per_source=3, group_words=3000).collect()
    cluster = {r[0]: r[3] for r in rows}
    held, words = defaultdict(list), defaultdict(int)
    for r in got:
        words[r.doc_id] += r.size
        if r.bin_id != -1:
            held[r.bin_id].append(r)
    want = defaultdict(int)
    for i, _, n, _ in rows:
        want[i] += n or 0
    assert words == want
    for pieces in held.values():
        pieces.sort(key=lambda r: r.start)
        assert sum(r.size for r in pieces) <= 64
        assert all(a.start + a.size == b.start for a, b in zip(pieces, pieces[1:])) and pieces[0].start == 0
        if len(pieces) > 1:
            clusters = [cluster[r.doc_id] for r in pieces]
            assert len(set(clusters)) == len(clusters)
            assert all(sum(p.source == r.source for p in pieces) <= 3 for r in pieces)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_neighbours_of_awkward_vectors(spark):
    x = np.random.default_rng(12).normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)  # a vector's nearest is its equal
    x[100:180] = x[100]
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)]
    rows += [(1000, None, "q"), (1020, [0.0] * 8, "q"), (1040, [float("nan")] * 8, "q"), (1060, [None, *[1.0] * 7], "q"),
             (1080, [float("inf"), *[1.0] * 7], "q"), (None, x[3].tolist(), "q")]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>, score STRING")
    got = neighbours.search(df, lambda i: F.pmod(i, F.lit(20)) == 0, ratio=2, recall=1.0).collect()
    near = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        near[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(near) == set(range(0, 400, 20))
    found = 0
    for q, rows_ in near.items():
        score = np.einsum("ij,j->i", x, x[q])
        order = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:20]
        assert [r for r, _, _ in rows_] == list(range(1, 21)) and q not in [v for _, v, _ in rows_]
        assert all(np.isclose(s, score[v], rtol=1e-12) for _, v, s in rows_)
        found += len(set(order) & {v for _, v, _ in rows_})
    assert found >= 0.95 * 400
    same = [v for _, v, _ in near[100]]
    assert same[:19] == list(range(101, 120))
    few = neighbours.search(df.where("vec_id in (0, 1, 2)"), lambda i: i == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert neighbours.search(df.limit(0), lambda i: i == 0).count() == 0


def _all_pairs(rows, q, top=20):
    """The nearest rows of row q, by place in ``rows``: (vec_id, score) of all others."""
    own = np.array(rows[q][1])
    others = [(-float(np.dot(own[:len(v)], v[:len(own)])), i) for k, (i, v) in enumerate(rows) if k != q]
    return [(i, -s) for s, i in sorted(others)[:top]]


def test_rows_of_one_id_and_shorter_vectors_are_candidates(spark):
    x = np.random.default_rng(13).integers(-3, 4, size=(60, 4)).astype(float)
    x[:, 0] = 1.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(20, x[20].tolist()), (20, [5.0, 5.0, 5.0, 5.0]), (7, x[20].tolist()), (7, x[20].tolist()),
             (40, [9.0, 9.0]), (3, [2.0]), (61, [1.0, 0.0, 0.0, 0.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>").repartition(3)
    got = neighbours.search(df, lambda i: F.pmod(i, F.lit(20)) == 0).collect()
    want = sorted((rows[q][0], rank, i, s) for q in range(len(rows)) if rows[q][0] % 20 == 0
                  for rank, (i, s) in enumerate(_all_pairs(rows, q), 1))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    hot = [(i, [1.0, 2.0]) for i in range(70)] + [(20, [1.0, 2.0])] * 30
    df = spark.createDataFrame(hot, "vec_id LONG, embedding ARRAY<DOUBLE>")
    got = neighbours.search(df, lambda i: i == 60).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(k + 1, k) for k in range(20)]
    got = neighbours.search(df, lambda i: i == 20, top=60).collect()
    assert sum(r.vec_id == 20 for r in got) == 31 * 30 and len(got) == 31 * 60


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_neighbours_reach_the_recall_asked_for(spark, scale):
    """The query itself, with what it gives its operator; the smaller table has two parts."""
    folder = f"/root/testdata/sf{scale}"
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = neighbours.op10_neighbours(spark, folder).collect()
    data = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids = np.array(sorted(data))
    x = np.stack([data[i] for i in ids])
    want = {}
    for q in ids[ids % 20 == 0]:
        score = x @ data[q]
        want[q] = set([i for i in ids[np.lexsort((ids, -score))] if i != q][:20])
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert len(got) == 20 * len(want) and hits >= 0.9 * 20 * len(want)


def test_parts_follow_the_table():
    rng = np.random.default_rng(6)
    assert neighbours.learn(rng.normal(size=(79, 4)), 79) == (None, 1, 1)
    assert neighbours.learn(rng.normal(size=(80, 4)), 80)[1] == 2
    assert [neighbours.parts_for(n) for n in (500, 51_282, 2_300_000, 10**9)] == [2, 18, 126, 512]
    # Clustered vectors: a query visits at most a third of the parts.
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(60, size=6000)] + 0.2 * rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    router, parts, probes = neighbours.learn(x, 90_000)
    assert parts == 25 and probes <= parts // 3


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "repeated_passages", "source_mix", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    junk = spark.createDataFrame([(9000, "12 34 !!", "en", "s", 8), (9001, None, None, None, None)], docs.schema)
    kept = stages["language_id"](spark, docs.unionByName(junk), folder)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {9000, 9001} and len(ids) >= 0.99 * docs.count()

    near = stages["near_duplicates"](spark, docs, folder).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in near) == sorted({c for _, _, c in brute.groups(rows)})
    cut = stages["repeated_passages"](spark, docs, folder).collect()
    want = {i: sha for i, n, gone, _, sha in brute.repeats(rows, corpus_pipeline.PASSAGE) if n > gone}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in cut} == want


def test_near_duplicates_with_awkward_ids(spark):
    """One row of each group stays, whatever its id; a second text of an id is a document too."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = " ".join(f"word{i}" for i in range(60))
    near = long.replace("word30", "other")
    rows = [(1, long, "en"), (1, near, "en"), (1, "quite another text of the same id", "en"), (None, long, None), (None, "lone text", "de"),
            (None, "lone text", "de"), (None, None, None), (None, None, None), (4, " \n", "en"), (0, "zero " * 9, "en"), (0, "zero " * 9, "fr")]
    frame = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], docs.schema)
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame, "")
    texts = [(r.doc_id, r.text) for r in got.collect()]
    assert len(texts) == 7 and texts.count((None, None)) == 2 and texts.count((None, "lone text")) == 1
    assert sum(t in (long, near) for _, t in texts) == 1 and (1, "quite another text of the same id") in texts
    assert sum((t or "").startswith("zero") for _, t in texts) == 1 and (4, " \n") in texts


def test_pipeline_run(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    groups = {c for _, _, c in brute.groups([(r.doc_id, r.text) for r in docs.collect()])}
    assert out and {r.doc_id for r in out} <= groups
    per_bin = defaultdict(list)
    for r in out:
        per_bin[r.bin_id].append(r)
    for pieces in per_bin.values():
        assert sum(r.size for r in pieces) <= packing.CAPACITY
        assert len({r.doc_id for r in pieces}) == len(pieces)


def test_folds_are_crc32(spark):
    import zlib
    rows = spark.range(50).select("id", fold("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
