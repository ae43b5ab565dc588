import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import answers as A
from brindle.operators import content as C
from brindle.operators import crawl as CR
from brindle.operators import effects as E
from brindle.operators import graph as G
from brindle.operators import metrics as M
from brindle.plans import content_queries as Q


def test_last_and_first_wins(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, None)], "k string, seq int, v int")
    assert {(r.k, r.v) for r in M.last_wins(df, ["k"], "seq", ["v"]).collect()} == {("a", 7), ("b", None)}
    assert {(r.k, r.v) for r in M.first_wins(df, ["k"], "seq", ["v"]).collect()} == {("a", 5), ("b", None)}


def test_tenants_stay_apart(spark):
    df = spark.createDataFrame([("t1", 1), ("t2", 2)], "tenant string, v int")
    assert [r.v for r in M.scoped(df, "t1").collect()] == [1]


def test_reconciliation(spark):
    d = spark.createDataFrame([("d1", 42), ("d2", 51), ("d3", 1)], "day string, clicks bigint")
    q = spark.createDataFrame([("d1", 20), ("d1", 10), ("d2", 30), ("d3", 2)], "day string, clicks bigint")
    assert {(r.day, r.hidden, r.broken) for r in M.reconciled(d, q, ["day"]).collect()} == {("d1", 12, False), ("d2", 21, False), ("d3", -1, True)}


def test_mentions_and_voice(spark):
    ents = [{"id": "zak", "name": "Żak", "variants": ["Żaki"], "exclusions": ["Żak Nowy"]}, {"id": "x", "name": "night shift", "variants": [], "exclusions": []}]
    rows = [("r", "p", 0, "Żak wygrał, a Żak Nowy nie.\n\nThe night   shift saw Żaki."), ("r", "p", 1, "Żakiet"), ("r", "p", 2, None)]
    m = A.mentions(spark.createDataFrame(rows, "run string, prompt string, run_index int, text string"), ents)
    got = [(r.run_index, r.entity, r.matched, r.start, r.paragraph) for r in m.orderBy("run_index", "start").collect()]
    assert got == [(0, "zak", "Żak", 0, 0), (0, "x", "night shift", 33, 1), (0, "zak", "Żaki", 49, 1)]
    v = {r.entity: (r.answers, r.share) for r in A.share_of_voice(m).collect()}
    assert v == {"zak": (1, 0.5), "x": (1, 0.5)}


def test_citations(spark):
    df = spark.createDataFrame([("r", "p", 0, "See https://www.a.example/x). And https://a.example/w_(b), https://a.example/w_(b)")], "run string, prompt string, run_index int, text string")
    assert {(r.url, r.host) for r in A.inline_citations(df).collect()} == {("https://www.a.example/x", "a.example"), ("https://a.example/w_(b)", "a.example")}


def test_compare_refuses(spark):
    s = "prompt string, hits bigint, trials bigint"
    a, b = spark.createDataFrame([("x", 1, 3)], s), spark.createDataFrame([("y", 1, 3)], s)
    assert A.compared(a, b, 1, 50).first().kind == "composition"
    r = A.compared(a.limit(0), b, 1, 50).first()
    assert r.kind == "empty" and r.mean is None


def test_paired_bootstrap_is_the_sequential_one(spark):
    from tests_support import mulberry

    diffs = [0.1, -0.2, 0.4, 0.3, 0.0]
    df = spark.createDataFrame([(f"p{i}", d) for i, d in enumerate(diffs)], "p string, d double")
    n, rounds = len(diffs), 200
    u = mulberry(9, n * rounds)
    means = sorted(sum(diffs[int(u[r * n + i] * n)] for i in range(n)) / n for r in range(rounds))
    for parts in (1, 7):
        got = E.paired(df.repartition(parts), "p", "d", 9, rounds).first()
        assert got.pairs == 5 and abs(got.low - means[int(0.025 * 199 + 0.5)]) < 1e-12 and abs(got.high - means[int(0.975 * 199 + 0.5)]) < 1e-12
    assert E.paired(df.limit(0), "p", "d", 9, 10).first().pairs == 0
    one = E.paired(df.where("p = 'p0'"), "p", "d", 9, 10).first()
    assert one.low == one.high == 0.1


def test_did(spark):
    rows = [(f"t{i}", True, 10, 15) for i in range(3)] + [(f"c{i}", False, 20, 25) for i in range(6)]
    p = spark.createDataFrame(rows, "page string, t boolean, clicks_before bigint, clicks_after bigint")
    r = E.did_interval(p, "page", "t", "clicks", 5, 100).first()
    assert (r.kind, r.effect, r.low, r.high) == ("effect", 0.0, 0.0, 0.0)
    assert E.did(p.where("page <> 'c0' and page <> 'c1'"), "t", "clicks").first().kind == "no-control"


def test_control_group_uses_each_page_once(spark):
    rng = random.Random(1)
    rows = [(f"p{i:02}", rng.randrange(50), 100 + rng.randrange(900), rng.random() * 20) for i in range(60)]
    df = spark.createDataFrame(rows, "page string, clicks bigint, impressions bigint, position double")
    g = E.control_group(df.where("page < 'p06'"), df.where("page >= 'p06'"), 2).collect()
    assert len({r.control for r in g}) == len(g) == 12 and {r.round for r in g} == {1, 2}


def test_control_group_searches_beyond_bands_and_ranks(spark):
    rng = random.Random(2)
    ddl = "page string, clicks bigint, impressions bigint, position double"
    far = [(f"t{i}", 5, 100, 5.0) for i in range(3)] + [(f"c{i}", 5, 100, 45.0) for i in range(2)] + [(f"d{i}", 5, 700 + i, 5.0) for i in range(2)] + [(f"e{i}", rng.randrange(9), 90000, 5.0) for i in range(2)]
    df = spark.createDataFrame(far, ddl)
    got = {(r.treated, r.control) for r in E.control_group(df.where("page >= 't'"), df.where("page < 't'"), 1, 1).collect()}
    assert got == {("t0", "d0"), ("t1", "d1"), ("t2", "c0")}
    tied = spark.createDataFrame([(f"t{i}", 5, 100, 5.0) for i in range(6)] + [(f"c{i:02}", 5, 100, 5.0) for i in range(12)], ddl)
    assert len(E.control_group(tied.where("page >= 't'"), tied.where("page < 't'"), 2, 1).collect()) == 12


def test_whole_pages_and_links(spark):
    pages = spark.createDataFrame([("u1", "Oars", "old", 1), ("u1", "Oars", "anchor rope guide", 2), ("u2", None, "anchor rope", 1), (None, "x", "anchor rope", 1)], "url string, title string, text string, extracted_at int")
    w = Q.whole_pages(pages)
    assert {tuple(r) for r in w.collect()} == {("u1", "Oars anchor rope guide"), ("u2", "anchor rope")}
    q = spark.createDataFrame([("c", "oars anchor rope", 1)], "cluster string, query string, impressions int")
    assert [(r.url, r.decision) for r in C.decide_coverage(C.coverage(q, w)).collect()] == [("u1", "refresh")]
    degrees = spark.createDataFrame([("r1", "u1", 0), ("r2", "u1", 9), ("r2", "u2", 2)], "run string, url string, in_degree int")
    crawls = spark.createDataFrame([("r1", "u1", 1), ("r2", "u1", 2), ("r2", "u2", 2)], "run string, url string, fetched_at int")
    d = Q.last_in_degrees(degrees, crawls)
    c = spark.createDataFrame([("c", "anchor rope")], "cluster string, text string")
    assert [r.url for r in C.suggest_links(c, w.join(d, "url")).orderBy("rank").collect()] == ["u2", "u1"]


def test_click_upside(spark):
    r = spark.range(1).select(E.click_upside(F.lit(100), F.lit(8.6)).alias("u"), E.click_upside(F.lit(100), F.lit(2.0)).alias("z"), E.expected_ctr(F.lit(0.5)).alias("c")).first()
    assert abs(r.u - 8.0) < 1e-9 and r.z == 0.0 and r.c == 0.28


def _greedy(items, pairs):
    near = {}
    for a, b, s in pairs:
        near.setdefault(a, {})[b] = s
        near.setdefault(b, {})[a] = s
    out, taken = {}, set()
    for q, _ in sorted(items, key=lambda x: (-x[1], x[0])):
        if q in taken:
            continue
        taken.add(q)
        out[q] = q
        for o in near.get(q, {}):
            if o not in taken:
                taken.add(o)
                out[o] = q
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_the_sequential_greedy(spark, seed):
    rng = random.Random(seed)
    items = [(f"q{i}", rng.randrange(5)) for i in range(25)]
    pairs = list({(a, b): (a, b, 3) for a, b in (sorted(rng.sample([q for q, _ in items], 2)) for _ in range(40))}.values())
    got = C.greedy_clusters(spark.createDataFrame(items, "q string, w int"), "q", "w", spark.createDataFrame(pairs, "a string, b string, shared bigint"))
    assert {r.item: r.head for r in got.collect()} == _greedy(items, pairs)


def test_overlap_and_coverage(spark):
    s = spark.createDataFrame([("a", ["1", "2", "3", "4"]), ("b", ["2", "3", "4", "9"]), ("c", ["4", "8"])], "q string, u array<string>")
    assert [(r.a, r.b, r.shared) for r in C.overlap_pairs(s, "q", "u", 3).collect()] == [("a", "b", 3)]
    q = spark.createDataFrame([("k", "red shoes", 3), ("k", "blue boots", 1)], "cluster string, query string, impressions int")
    p = spark.createDataFrame([("u1", "Red running shoes"), ("u2", "boots")], "url string, text string")
    d = C.decide_coverage(C.coverage(q, p)).first()
    assert (d.url, d.coverage, d.decision) == ("u1", 0.75, "refresh")


def test_originality(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen"
    d = spark.createDataFrame([("copy", words), ("new", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), ("short", "too short")], "id string, text string")
    c = spark.createDataFrame([("doc", words), ("other", "nothing in common with this text at all really nothing to see")], "id string, text string")
    got = {r.id: (r.kind, r.closest) for r in C.originality(d, c).collect()}
    assert got == {"copy": ("too-similar", "doc"), "new": ("pass", None), "short": ("undecidable", None)}
    assert {r.kind for r in C.originality(d, c.limit(0)).collect()} == {"undecidable"}


def test_graph(spark):
    nodes = spark.createDataFrame([("r", x) for x in "abcde"], "run string, url string")
    raw = spark.createDataFrame([("r", *e) for e in ("ab", "ab", "bc", "ca", "aa", "dz", "dc")], "run string, src string, dst string")
    e = G.clean_edges(raw, nodes)
    deg = G.degrees(nodes, e)
    assert {r.url: (r.in_degree, r.out_degree) for r in deg.collect()} == {"a": (1, 1), "b": (1, 1), "c": (2, 1), "d": (0, 1), "e": (0, 0)}
    root = nodes.where("url = 'a'")
    assert {r.url: r.depth for r in G.click_depth(nodes, e, root).collect()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None}
    assert {r.url for r in G.orphans(deg, root).collect()} == {"d", "e"}
    ch = spark.createDataFrame([(["x", "y", "x"],), (["x", "y", "z"],), (["x"],)], "c array<string>").select(G.redirect_problem(F.col("c")).alias("p"))
    assert [r.p for r in ch.collect()] == ["loop", "too-long", None]


def test_robots_and_sitemap(spark):
    rules = CR.parse_robots("User-agent: a\nUser-agent: b\nDisallow: /x # no\n\nUser-agent: *\nDisallow: /\nAllow: /ok$\nSitemap: https://e.example/s.xml")
    assert [g["agents"] for g in rules["groups"]] == [["a", "b"], ["*"]] and rules["sitemaps"] == ["https://e.example/s.xml"]
    assert CR.allowed(rules, "b/1.0", "/y") and not CR.allowed(rules, "bot/1.0", "/x/1") and not CR.allowed(rules, "zz", "/okay") and CR.allowed(rules, "zz", "/ok")
    assert CR.allowed(CR.parse_robots(""), "zz", "/")
    s = CR.parse_sitemap("<?xml version='1.0'?><urlset><url><loc><![CDATA[https://e.example/a?x=1&y=2]]></loc></url><url><loc>ftp://x</loc></url><url></url></urlset>")
    assert [e["loc"] for e in s["entries"]] == ["https://e.example/a?x=1&y=2"] and s["problems"] == ["invalid-url", "invalid-url"]
    assert CR.parse_sitemap("hello")["problems"] == ["not-xml"]
    assert CR.clamp_limits(max_pages=99_999, delay_ms=1) == ({"max_pages": 10_000, "max_depth": 5, "delay_ms": 500, "max_bytes": 5 << 20, "max_minutes": 15}, ["max_pages", "delay_ms"])


def test_crawl(spark):
    pages = spark.createDataFrame([(x,) for x in "abcd"], "url string")
    links = spark.createDataFrame([tuple(e) for e in ("ab", "bc", "cd")], "src string, dst string")
    start = pages.where("url = 'a'")
    seen, cut = CR.crawl(pages, links, start, 2, 100)
    assert [(r.url, r.depth) for r in seen.collect()] == [("a", 0), ("b", 1), ("c", 2)] and not cut
    assert CR.crawl(pages, links, start, 5, 2)[1]
