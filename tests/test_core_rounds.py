"""Joins against brute force, identities in the audit, effects on all metrics, sitemaps, reports and schemas."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from brindle import session
from brindle.functions import stats as S
from brindle.operators import answers as A
from brindle.operators import content as C
from brindle.operators import crawl as CR
from brindle.operators import effects as E
from brindle.operators import graph as G
from brindle.operators import reports as P
from brindle.operators import rules as R
from brindle.session import checkpoint_dir, cut, release
from brindle.sources import schemas


def _lists(seed, n=60):
    rng = random.Random(seed)
    return {f"q{i:02}": {"hot"} | {f"u{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(1, 9))} for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_overlap_pairs_equal_brute_force(spark, seed):
    sets = _lists(seed)
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()] + [("empty", [])], "query string, urls array<string>")
    for least in (1, 3):
        got = {(r.a, r.b, r.shared) for r in C.overlap_pairs(df, "query", "urls", least).collect()}
        assert got == {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}


@pytest.mark.parametrize("seed", [3, 4])
def test_lexical_pairs_equal_brute_force(spark, seed):
    sets = _lists(seed)
    df = spark.createDataFrame([(k, " ".join(sorted(v))) for k, v in sets.items()] + [("none", "the of")], "query string, text string")
    got = {(r.a, r.b, r.shared) for r in C.lexical_pairs(df, "query", "text").collect()}
    assert got == {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * min(len(sets[a]), len(sets[b]))}


def test_uncovered_brief_and_shingles(spark):
    q = spark.createDataFrame([("c", "long oars", 1), ("c", "short oars", 1)], "cluster string, query string, impressions int")
    pages = spark.createDataFrame([("u1", "All long oars here")], "url string, text string")
    cov = C.decide_coverage(C.coverage(q, pages))
    assert [(r.url, r.coverage, r.decision) for r in cov.collect()] == [("u1", 0.5, "create")]
    missing = C.uncovered(q, pages, cov)
    assert [r.query for r in missing.collect()] == ["short oars"]
    links = spark.createDataFrame([("c", "u1", 1)], "cluster string, url string, rank int")
    heads = spark.createDataFrame([("c", "long oars", ["long oars", "short oars"])], "cluster string, head string, queries array<string>")
    text = C.brief_markdown(C.brief(heads, cov, links, missing)).first().markdown
    assert text == "# long oars\n\nDecision: create\n\n## Queries\n\n- long oars\n- short oars\n\n## Not answered yet\n\n- short oars\n\n## Link to\n\n- u1\n"
    d = spark.createDataFrame([("d", "one two three four")], "id string, text string")
    c = spark.createDataFrame([("x", "zero one two three")], "id string, text string")
    close = spark.createDataFrame([("d", "x")], "id string, closest string")
    assert [r.shingle for r in C.overlapping_shingles(d, c, close).collect()] == ["one two three"]


def test_redirects_come_back_by_identity(spark):
    rows = [("https://a.test/x", ["https://a.test/y", "HTTPS://A.test:443/x?utm_source=n"]), ("https://a.test/x", ["https://a.test/y"]), ("https://a.test/x", ["https://a.test/1", "https://a.test/2", "https://a.test/3"]), ("https://a.test/x", ["https://a.test/x#top"]), ("https://a.test/x", []), ("https://a.test/x", None)]
    df = spark.createDataFrame(rows, "url string, c array<string>").select(G.redirect_problem(F.col("c"), F.col("url")).alias("p"))
    assert [r.p for r in df.collect()] == ["loop", None, "too-long", "loop", None, None]


def _pages(spark, rows):
    from brindle.operators import html as H

    df = spark.createDataFrame(rows, "run string, url string, status int, duration_ms bigint, redirect_chain array<string>, html string, depth int, is_root boolean, blocked boolean, robots_state string, in_degree bigint, out_degree bigint")
    return cut(R.prepared(H.parsed(df)), "pages")


def test_audit_reads_root_depth_blocked_robots_and_identities(spark):
    def page(links="", head=""):
        return f'<!doctype html><html lang="en"><head><title>A page of a test site</title>{head}</head><body><h1>Oars of the yard</h1><p>{"word " * 60}</p>{links}</body></html>'

    alt = '<link rel="alternate" hreflang="en" href="HTTPS://a.test:443/b?utm_source=x"><link rel="alternate" hreflang="de" href="/de?b=2&amp;a=1">'
    rows = [
        ("r", "https://a.test/", 200, 10, [], page('<a href="/b">The page b of all</a><a href="/no">The blocked page</a>'), 0, True, False, "missing", 0, 2),
        ("r", "https://a.test/b", 200, 10, ["https://a.test/c", "https://a.test/b?utm_medium=x"], page(head=alt), 6, False, False, "missing", 1, 0),
        ("r", "https://a.test/de?a=1&b=2", 200, 10, [], page(head='<link rel="alternate" hreflang="de" href="/de?a=1&amp;b=2"><link rel="alternate" hreflang="en" href="/b">'), 1, False, False, "missing", 0, 0),
        ("r", "https://a.test/no", None, None, None, None, 1, False, True, "missing", 1, 0),
    ]
    sitemap = spark.createDataFrame([("r", "https://a.test/b")], "run string, loc string")
    f = {(r.rule, r.url) for r in R.audit(_pages(spark, rows), sitemap).collect()}
    b, de = "https://a.test/b", "https://a.test/de?a=1&b=2"
    assert ("page.orphan", de) in f and ("page.orphan", "https://a.test/") not in f and ("page.too-deep", b) in f and ("redirect.loop", b) in f
    assert any(r == "robots.blocked-but-linked" for r, _ in f) and any(r == "sitemap.not-discoverable" for r, _ in f)
    assert not {("hreflang.missing-self", b), ("hreflang.missing-return", b), ("hreflang.missing-return", de)} & f


def test_a_crashing_rule_is_a_finding(spark, monkeypatch):
    rows = [("r", "https://a.test/", 200, 10, [], "<html><title>t</title></html>", 0, True, False, "ok", 0, 0)]
    bad = R.SiteRule("title.duplicate", "medium", (R.PF,), lambda p, s, t: p.select("no_such_column"))
    monkeypatch.setattr(R, "SITE_RULES", [bad])
    got = R.audit(_pages(spark, rows)).where("rule = 'rule.crashed'").collect()
    assert len(got) == 1 and got[0].evidence.startswith("title.duplicate")
    one, two = R.skipped(spark, {R.PF}), R.skipped(spark, {R.PF, R.HR})
    merged = R.merged([(spark.createDataFrame([("a",)], "rule string"), one), (spark.createDataFrame([("b",)], "rule string"), two)])
    assert merged[0].count() == 2 and merged[1].count() == one.count()


def _panel(n=12):
    rng = random.Random(8)
    return [(f"p{i:02}", i % 3 == 0, *(float(rng.randrange(1, 40)) for _ in range(6))) for i in range(n)]


@pytest.mark.parametrize("metric", E.METRICS)
def test_did_equals_the_sequential_one(spark, metric):
    from tests_support import mulberry

    cols = "page string, treated boolean, clicks_before double, impressions_before double, weighted_before double, clicks_after double, impressions_after double, weighted_after double"
    rows = _panel()
    df = spark.createDataFrame(rows, cols)

    def level(group, at):
        c, i, w = (sum(r[at + k] for r in group) for k in range(3))
        return c / len(group) if metric == "clicks" else i / len(group) if metric == "impressions" else c / i if metric == "ctr" else w / i

    def effect(t, c):
        return level(t, 5) - level(t, 2) - level(c, 5) + level(c, 2)

    t, c = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    u = iter(mulberry(7, 200 * len(rows)))
    tries = sorted(effect([t[int(next(u) * len(t))] for _ in t], [c[int(next(u) * len(c))] for _ in c]) for _ in range(200))
    got = E.did_interval(df, "page", "treated", metric, 7, 200).withColumn("s", E.verdict_sentence(F.lit(14), F.lit(metric))).first()
    assert got.kind == "effect" and math.isclose(got.effect, effect(t, c), abs_tol=1e-9)
    assert math.isclose(got.low, tries[5], abs_tol=1e-9) and math.isclose(got.high, tries[195], abs_tol=1e-9) and got.s.startswith("After 14 days")


def test_did_refusals(spark):
    cols = "page string, treated boolean, clicks_before double, impressions_before double, weighted_before double, clicks_after double, impressions_after double, weighted_after double"
    df = spark.createDataFrame([(p, t, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for p, t, *_ in _panel()], cols)
    assert E.did(df, "treated", "ctr").first().kind == "no-impressions" and E.did(df.where("not treated"), "treated", "clicks").first().kind == "no-treatment"
    few = E.did_interval(df.where("treated or page < 'p03'"), "page", "treated", "clicks", 1, 10).withColumn("s", E.verdict_sentence(F.lit(30), F.lit("clicks"))).first()
    assert few.kind == "no-control" and few.effect is None and few.low is None and "can't be measured" in few.s


def test_control_group_counts_depth_and_shortfall(spark):
    s = "page string, clicks bigint, impressions bigint, position double, depth int"
    t = spark.createDataFrame([("t", 10, 100, 5.0, 1)], s)
    c = spark.createDataFrame([("near", 10, 100, 5.0, 6), ("far", 9, 100, 5.0, 1), ("none", 10, 100, 5.0, None)], s)
    m = E.control_group(t, c, rounds=4)
    assert [r.control for r in m.orderBy("round").collect()] == ["far", "none", "near"]
    assert E.shortfall(t, m).first().missing == 1


def _greedy_controls(treated, free, rounds):
    def far(a, b):
        depth = 0.5 if a[4] is None or b[4] is None else abs(a[4] - b[4]) / 5
        return sum(abs(math.log10(a[i] + 1) - math.log10(b[i] + 1)) for i in (2, 1)) + abs(a[3] - b[3]) / 20 + depth

    near = {t[0]: sorted((round(far(t, c), 12), c[0]) for c in free) for t in treated}
    taken, out = set(), set()
    for r in range(1, rounds + 1):
        left = set(near)
        while left:
            want = {}
            for t in left:
                if best := next((x for x in near[t] if x[1] not in taken), None):
                    want.setdefault(best[1], []).append((best[0], t))
            if not want:
                break
            for c, who in want.items():
                t = min(who)[1]
                out.add((t, c, r))
                left.discard(t)
            taken |= set(want)
    return out


@pytest.mark.parametrize("most", [1, 3])
def test_control_group_searches_few_cells(spark, monkeypatch, most):
    monkeypatch.setattr(E, "CELL", 8, raising=False)
    rng = random.Random(most)
    rows = [(f"p{i:03}", rng.randrange(30) * rng.randrange(2), rng.randrange(5000), rng.random() * 50, rng.choice([None, 1, 2, 5])) for i in range(260)]
    df = spark.createDataFrame(rows, "page string, clicks bigint, impressions bigint, position double, depth int")
    written = len(session._WRITTEN.get(spark.sparkContext.applicationId, []))
    got = E.control_group(df.where("page < 'p040'"), df.where("page >= 'p040'"), 2, most)
    assert {(r.treated, r.control, r.round) for r in got.collect()} == _greedy_controls(rows[:40], rows[40:], 2)
    tables = len(session._WRITTEN[spark.sparkContext.applicationId]) - written
    assert tables <= 40 and got.count() == 80


def test_control_group_without_candidates(spark):
    df = spark.createDataFrame([("t", 1, 1, 1.0)], "page string, clicks bigint, impressions bigint, position double")
    assert E.control_group(df, df.limit(0)).count() == E.control_group(df.limit(0), df).count() == 0


def _word_tables(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Łódka", "the"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    queries = {(f"c{rng.randrange(9)}" if i else None, text(rng.randrange(0, 5)), rng.randrange(0, 4)) for i in range(60)} | {("only", "w0 nowhere", 2), ("none", "nowhere", 1)}
    queries = {(c, q): (c, q, n) for c, q, n in queries}.values()
    pages = [(f"u{i:02}", text(rng.randrange(1, 12)) if i % 9 else None, rng.randrange(3)) for i in range(50)]
    return spark.createDataFrame(list(queries), "cluster string, query string, impressions int"), spark.createDataFrame(pages, "url string, text string, in_degree int")


@pytest.mark.parametrize("seed,block", [(1, 200_000), (2, 9)])
def test_best_coverage_equals_that_of_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(C, "BLOCK_QUERIES", block, raising=False)
    monkeypatch.setattr(C, "BLOCK_PAGES", 7, raising=False)
    q, p = _word_tables(spark, seed)
    want = {tuple(r) for r in C.decide_coverage(C.coverage(q, p)).collect()}
    got = C.decided(C.best_coverage(q, p))
    assert {tuple(r) for r in got.collect()} == want and any(r[2] == 0 for r in want) and any(r[2] > 0 for r in want)
    assert C.best_coverage(q.limit(0), p).count() == C.best_coverage(q, p.limit(0)).count() == 0


@pytest.mark.parametrize("seed,block,least", [(1, 200_000, 0.15), (2, 9, 0.5)])
def test_links_of_whole_texts_equal_those_of_all_pairs(spark, monkeypatch, seed, block, least):
    monkeypatch.setattr(C, "BLOCK_QUERIES", block, raising=False)
    monkeypatch.setattr(C, "BLOCK_PAGES", 7, raising=False)
    q, p = _word_tables(spark, seed + 5)
    c = q.groupBy("cluster").agg(F.max("query").alias("text"))
    want = {tuple(r) for r in C.suggest_links(c, p, least).collect()}
    assert {tuple(r) for r in C.suggest_links_whole(c, p, least).collect()} == want and len(want) > 9
    assert C.suggest_links_whole(c.limit(0), p).count() == C.suggest_links_whole(c, p.limit(0)).count() == 0


def test_comparison_needs_one_context(spark):
    m = spark.createDataFrame([("x", 1, 3), ("y", 2, 3)], "prompt string, hits bigint, trials bigint")
    base = {"engine": "e", "model": "1", "access": "api", "entity_version": 1, "prompt_set": "s"}
    for change, kind in (({}, "compared"), ({"model": "2"}, "context"), ({"entity_version": 2}, "entity-version"), ({"prompt_set": "t"}, "composition")):
        r = A.compared(m, m, 1, 20, (base, {**base, **change})).first()
        assert r.kind == kind and (r.mean is None) == (kind != "compared")


def test_citation_rate_and_own_mentions(spark):
    a = spark.createDataFrame([("r", "p", 0, ["https://www.we.test/a"]), ("r", "p", 1, ["https://x.test/"]), ("r", "p", 2, None)], "run string, prompt string, run_index int, grounding array<string>")
    r = A.citation_rate(a, "we.test", ["run"]).first()
    assert (r.hits, r.trials) == (1, 3)
    m = spark.createDataFrame([("r", "p", 0, "us"), ("r", "p", 0, "them"), ("r", "p", 1, "them")], "run string, prompt string, run_index int, entity string")
    r = A.own_and_others(m, a, ["us"]).first()
    assert (r.trials, r.own, r.others) == (3, 1, 2)


def test_sitemaps_are_expanded_within_a_budget(spark):
    def index(*locs):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"

    def urls(*locs):
        return "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"

    h = "https://a.test/"
    files = [("s", h + "i.xml", 200, index(h + "1.xml", h + "2.xml", h + "gone.xml", h + "i.xml")), ("s", h + "1.xml", 200, urls(h + "a", h + "b")), ("s", h + "2.xml", 200, urls(h + "b", h + "c")), ("s", h + "gone.xml", 404, urls(h + "d")), ("s", h + "other.xml", 200, urls(h + "e"))]
    df = spark.createDataFrame(files, "site string, url string, status int, xml string")
    start = spark.createDataFrame([("s", h + "i.xml", 1)], "site string, url string, nth int")
    assert sorted(r.loc for r in CR.sitemap_urls(df, start).collect()) == [h + "a", h + "b", h + "c"]
    assert sorted(r.loc for r in CR.sitemap_urls(df, start, 2).collect()) == [h + "a", h + "b"]
    assert CR.sitemap_urls(df, start.limit(0)).count() == 0
    d = spark.createDataFrame([("https://a.test/yard/", 2.0), ("https://a.test/", None)], "u string, d double").select(CR.default_sitemaps(F.col("u")).alias("s"), CR.effective_delay_ms(F.lit(1000), F.col("d")).alias("ms"))
    assert [(r.s, r.ms) for r in d.collect()] == [([h + "yard/sitemap.xml", h + "sitemap.xml"], 2000), ([h + "sitemap.xml"], 1000)]


def test_crawl_of_runs(spark):
    pages = spark.createDataFrame([(r, u) for r in "xy" for u in "abcd"], "run string, url string")
    links = spark.createDataFrame([("x", "a", "b"), ("x", "b", "c"), ("y", "a", "d"), ("y", "d", "zzz")], "run string, src string, dst string")
    start = spark.createDataFrame([("x", "a"), ("y", "a")], "run string, url string")
    seen, cut_at = CR.crawl(pages, links, start, 5, 2, ["run"])
    assert {(r.run, r.url, r.depth, r.nth) for r in seen.collect()} == {("x", "a", 0, 1), ("x", "b", 1, 2), ("y", "a", 0, 1), ("y", "d", 1, 2)}
    assert all(r.cut for r in cut_at.collect())


def test_seed(spark):
    def seed(a, b):
        h = 2166136261
        for ch in f"{a}|{b}":
            h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
        return h

    rows = [("run-1", "run-2"), ("", "ż"), ("a", "")]
    df = spark.createDataFrame(rows, "a string, b string").select(S.seed_for(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in df.collect()] == [seed(*r) for r in rows]


def test_report_page(spark):
    df = spark.createDataFrame([(1, 3), (2, None)], "a int, b int")
    report = P.frame(P.totals(df, "totals", n=F.count("*"), b=F.sum("b")), P.part(df, "rows <1>", F.col("a"), F.col("b") / 2))
    page = P.html_page(report, "A & B").first().html
    assert "<title>A &amp; B</title>" in page and "<h2>rows &lt;1&gt;</h2>" in page and "<td>1</td><td>1.5000</td>" in page and "<td>n</td><td>2</td>" in page
    assert "<h1>" in P.html_page(report.limit(0), "x").first().html


def test_schemas_migrate(spark):
    old = spark.createDataFrame([("i", "t", "n", ["v"], "extra")], "id string, tenant string, name string, variants array<string>, other string")
    new = schemas.migrated(old, "brand_entity")
    assert new.schema == schemas.schema("brand_entity") and new.first().version is None and schemas.version("brand_entity") == 3
    with pytest.raises(ValueError, match="tenant"):
        schemas.migrated(old.drop("tenant"), "brand_entity")


def test_written_tables_are_released(spark, tmp_path):
    df = cut(spark.range(3), "gone")
    assert df.count() == 3 and checkpoint_dir(spark)
    assert release(spark) >= 1 and release(spark) == 0
    with pytest.raises(Exception):
        df.count()


def test_before_after_windows(spark):
    rows = [("p", dt.date(2025, 3, d), c, i, pos) for d, c, i, pos in ((1, 1, 10, 2.0), (14, 2, 10, None), (15, 4, 20, 3.0), (20, 8, 0, 1.0), (30, 99, 99, 9.0))]
    r = E.before_after(spark.createDataFrame(rows, "page string, date date, clicks bigint, impressions bigint, position double"), "page", "2025-03-15", 5).first()
    assert (r.clicks_before, r.clicks_after, r.impressions_before, r.impressions_after, r.weighted_before, r.weighted_after) == (6, 12, 30, 20, 60.0, 60.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_mentions_of_a_table_equal_the_detector(spark, seed):
    rng = random.Random(seed)
    words = ["Żak", "night", "shift", "oar", "S.A.", "C++", "of", "the", "yard", "Łódź"]

    def phrase():
        return " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))

    defs = [{"id": f"e{i}", "name": phrase(), "variants": [phrase() for _ in range(rng.randrange(3))], "exclusions": [phrase() for _ in range(rng.randrange(2))]} for i in range(25)]
    texts = [rng.choice(["\n\n", " ", ", "]).join(phrase() for _ in range(rng.randrange(1, 12))) for _ in range(30)] + ["", None]
    rows = [("r", "p", i, t) for i, t in enumerate(texts)]
    a = spark.createDataFrame(rows + rows[:3], "run string, prompt string, run_index int, text string")
    d = spark.createDataFrame([(x["id"], x["name"], x["variants"] or None, x["exclusions"]) for x in defs] + [("null", None, None, None), ("blank", " ", ["..."], [])], "id string, name string, variants array<string>, exclusions array<string>")
    cols = ("run_index", "entity", "matched", "start", "end", "paragraph")
    got = sorted(tuple(r[c] for c in cols) for r in A.mentions_of(a, d).collect())
    want = sorted(tuple(r[c] for c in cols) for r in A.mentions(spark.createDataFrame(rows, "run string, prompt string, run_index int, text string"), defs).collect())
    # phrases without a word edge of their own ("S.A.", "C++") are matched by both alike
    assert got == want and want
