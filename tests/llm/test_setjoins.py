import random

import numpy as np
import pytest

from brindle.llm import near_copies, serp_pairs, setjoin
from brindle.llm.components import components

SERP = "snapshot_id bigint, query string, urls array<string>, key string, cid bigint"


def _pairs(sets, t):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def _serp_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = [f"https://e.example/{rng.randrange(60)}" for _ in range(rng.randrange(0, 9))]
        if rows and rng.random() < 0.5:
            base = [u for u in rows[rng.randrange(len(rows))][2] or [] if rng.random() < 0.85] + base[:1]
        if rng.random() < 0.5:
            base.append("https://hot.example/")
        rows.append((i, "q", rng.choice([base, base + base[:2], base + [None, ""]]) if rng.random() > 0.05 else None, "x", 1))
    return rows + rows[:5]


@pytest.mark.parametrize("seed,hot", [(1, 256), (2, 4), (3, 1)])
def test_serp_pairs_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(setjoin, "HOT", hot)
    rows = _serp_rows(seed, 120)
    got = serp_pairs.found(spark.createDataFrame(rows, SERP)).collect()
    sets = {r[0]: {u for u in r[2] or [] if u} for r in rows}
    assert {(r.snapshot_a, r.snapshot_b) for r in got} == _pairs(sets, 0.5) and len(got) == len(set(got))


@pytest.mark.parametrize("t", [0.3, 0.5, 0.75, 1.0])
def test_serp_threshold(spark, t):
    rows = _serp_rows(9, 80)
    got = {(r.snapshot_a, r.snapshot_b) for r in serp_pairs.found(spark.createDataFrame(rows, SERP), t).collect()}
    want = _pairs({r[0]: {u for u in r[2] or [] if u} for r in rows}, t)
    assert got == want


def test_radius_follows_the_threshold():
    assert setjoin.radius_for(0.5) == 111 and setjoin.radius_for(1.0) == 0
    assert all(setjoin.radius_for(t) > setjoin.radius_for(t + 0.1) for t in (0.1, 0.3, 0.5, 0.7))


def test_a_tiny_count_table_loses_nothing(spark, monkeypatch):
    rows = _serp_rows(4, 120)
    df = serp_pairs.url_sets(spark.createDataFrame(rows, SERP))
    want = {tuple(r) for r in serp_pairs.similar_sets(df)[0].select("a", "b").collect()}
    monkeypatch.setattr(setjoin.item_counts, "__defaults__", (3,))
    assert {tuple(r) for r in serp_pairs.similar_sets(df)[0].select("a", "b").collect()} == want


def test_a_full_count_table_makes_nothing_hot(spark):
    rng = random.Random(5)
    sets = spark.createDataFrame([("s", i, rng.sample(range(10**9), 200)) for i in range(40)], "src string, cid bigint, items array<bigint>")
    full = np.full(1 << 10, 5000, dtype=np.int32)
    assert setjoin._postings(sets, ["cid"], full, 0.6, 6, True).count() == 40 * (80 + 6)


@pytest.mark.parametrize("most", [1, 7])
def test_postings_in_small_chunks_lose_nothing(spark, monkeypatch, most):
    rows = _serp_rows(6, 120)
    monkeypatch.setattr(setjoin, "HOT", 1)
    monkeypatch.setattr(setjoin, "CHUNK_ITEMS", most)
    sets = {r[0]: {u for u in r[2] or [] if u} for r in rows}
    got = serp_pairs.found(spark.createDataFrame(rows, SERP)).collect()
    assert {(r.snapshot_a, r.snapshot_b) for r in got} == _pairs(sets, 0.5)


def test_a_third_share_one_list(spark):
    rows = [(i, "q", ["https://a.example/", f"https://b.example/{i if i % 3 else 0}"], "x", 1) for i in range(300)]
    pairs, members = serp_pairs.similar_sets(serp_pairs.url_sets(spark.createDataFrame(rows, SERP)))
    assert pairs.count() == 0 and members.groupBy("cid").count().where("count > 1").count() == 1


def test_classes(spark):
    rows = [(1, "q", ["a", "b"], "", 1), (2, "q", ["b", "a", "a", None], "", 1), (3, "q", ["a", "b", "c"], "", 1), (4, "q", ["z"], "", 1), (5, "q", [], "", 1)]
    got = {tuple(r) for r in serp_pairs.classes(spark.createDataFrame(rows, SERP)).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 4, 0)}


def test_serp_empty(spark):
    assert serp_pairs.found(spark.createDataFrame([], SERP)).count() == 0
    assert serp_pairs.found(spark.createDataFrame([(1, "q", None, "", 1), (2, "q", [], "", 1), (3, "q", [None, ""], "", 1)], SERP)).count() == 0


def _texts(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["słowo", "Über", "niño"]
    docs = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(50, 90))]
        docs.append(base)
        for _ in range(rng.randrange(3)):
            edit = list(base)
            for _ in range(rng.randrange(1, 12)):
                j = rng.randrange(len(edit))
                edit[j : j + 1] = rng.choice([[], [rng.choice(vocab)], [edit[j], rng.choice(vocab)]])
            docs.append(edit)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_equal_brute_force(spark, seed):
    docs = _texts(seed)
    rows = [("a" if i % 4 else "b", f"d{i:03}", " ".join(w.upper() if i % 3 == 0 else w for w in d) + ".", "k", 7) for i, d in enumerate(docs)]
    rows += rows[:3] + [("a", "copy", rows[1][2].replace(" ", "  \n"), "k", 7), ("a", "null", None, "k", 7), ("a", "empty", "", "k", 7), ("a", "short", "w1 w2 w3", "k", 7), ("a", "short2", "W1 w2  w3", "k", 7), ("a", None, "x", "k", 7)]
    got = near_copies.found(spark.createDataFrame(rows, "src string, id string, text string, key string, cid int"))
    sets = {}
    for s, i, t, *_ in rows:
        if i and t:
            w = near_copies.WORDS.findall(t.lower())
            sh = set(zip(w, w[1:], w[2:]))
            if len(sh) >= 40:
                sets.setdefault(s, {})[i] = sh
    want = {(s, *p) for s, d in sets.items() for p in _pairs(d, 0.6)}
    assert {(r.src, r.id_a, r.id_b) for r in got.collect()} == want and want


def test_groups(spark):
    docs = [("a", f"d{i}", t) for i, t in enumerate(["one two three four five six seven eight", "one two three four five six seven eight", "one two three four five six seven eight nine", "something else entirely here and there too", None])]
    rows = {r.id: r for r in near_copies.groups(spark.createDataFrame(docs, "src string, id string, text string"), 5, 0.8, 1).collect()}
    assert set(rows) == {"d0", "d1", "d2", "d3"} and rows["d0"].group_id == rows["d2"].group_id == "d0" and rows["d1"].class_id == "d0" and rows["d2"].links == 1 and rows["d3"].links == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(60))] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = components(spark.createDataFrame([("s", *e) for e in edges], "src string, a string, b string"))
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert {r.cid: r.comp for r in got.collect()} == want
    assert components(spark.createDataFrame([], "src string, a string, b string")).count() == 0
