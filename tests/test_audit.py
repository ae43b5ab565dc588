import pytest
from pyspark.sql import functions as F

from brindle.operators import html as H
from brindle.operators import rules as R

HEALTHY = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>A complete and healthy page</title>
<meta name="description" content="A description that is long enough to be neither too short nor too long for a result list."><meta name="viewport" content="width=device-width">
<link rel="canonical" href="https://s.example/p"><meta property="og:title" content="x"><meta name="twitter:card" content="summary">
<script type="application/ld+json">{"@type":"Article","headline":"h"}</script></head><body><h1>A heading that stands</h1>
<p>This first paragraph answers the question of the page at once and it has more than twelve words in it.</p>
<h2>Another heading that stands</h2><p>WORDS</p><a href="/other">A link with a name</a><img src="a.png" alt="x" width="1" height="2"></body></html>""".replace("WORDS", "word " * 200)

CASES = {
    "noindex.present": ("</head>", '<meta name="robots" content="noindex"></head>'),
    "canonical.missing": ('<link rel="canonical" href="https://s.example/p">', ""),
    "canonical.points-elsewhere": ("https://s.example/p", "https://s.example/q"),
    "canonical.multiple": ("</head>", '<link rel="canonical" href="/p"></head>'),
    "redirect.meta-refresh": ("</head>", '<meta http-equiv="refresh" content="1"></head>'),
    "title.missing": ("<title>A complete and healthy page</title>", ""),
    "title.too-long": ("A complete", "A complete" + " and long" * 9),
    "title.too-short": ("A complete and healthy page", "Short"),
    "description.missing": ('<meta name="description"', '<meta name="nothing"'),
    "description.too-short": ("A description that is long enough to be neither too short nor too long for a result list.", "Short."),
    "h1.missing": ("h1>", "h3>"),
    "h1.multiple": ("<h2>Another heading that stands</h2>", "<h1>Another</h1>"),
    "heading.order-jump": ("h2>", "h4>"),
    "content.thin": ("word " * 200, "word"),
    "lang.missing": (' lang="en"', ""),
    "link.nofollow-internal": ('href="/other"', 'href="/other" rel="nofollow"'),
    "link.empty-anchor": ("A link with a name", " "),
    "link.generic-anchor": ("A link with a name", "Click here"),
    "image.missing-alt": (' alt="x"', ""),
    "image.alt-too-long": ('alt="x"', f'alt="{"y" * 130}"'),
    "image.missing-dimensions": (' width="1"', ""),
    "image.lazy-above-fold": ("<img", '<img loading="lazy"'),
    "image.missing-src": ('src="a.png"', 'src=" "'),
    "jsonld.invalid": ('"headline":"h"}', '"headline":"h"'),
    "jsonld.missing": ('<script type="application/ld+json">{"@type":"Article","headline":"h"}</script>', ""),
    "jsonld.empty-type": ('"@type":"Article",', ""),
    "jsonld.missing-required-field": ('"headline":"h"', '"name":"h"'),
    "og.missing": ('property="og:title"', 'property="x"'),
    "twitter.missing": ('name="twitter:card"', 'name="x"'),
    "viewport.missing": ('name="viewport"', 'name="x"'),
    "charset.missing": ('<meta charset="utf-8">', ""),
    "hreflang.invalid-code": ("</head>", '<link rel="alternate" hreflang="en_us" href="https://s.example/p"></head>'),
    "hreflang.missing-self": ("</head>", '<link rel="alternate" hreflang="pl" href="https://s.example/pl"></head>'),
    "security.mixed-content": ('src="a.png"', 'src="http://s.example/a.png"'),
    "page.too-heavy": ("</body>", "<!--" + "x" * 500_001 + "--></body>"),
    "ai.answer-not-upfront": ("This first paragraph answers the question of the page at once and it has more than twelve words in it.", "Soon."),
    "ai.chunk-not-standalone": ("Another heading that stands", "Summary"),
}
ROW = "run string, url string, status int, duration_ms bigint, redirect_chain array<string>, html string"


@pytest.fixture(scope="module")
def found(spark):
    rows = [("healthy", "https://s.example/p", 200, 10, [], HEALTHY)]
    for rule, (a, b) in CASES.items():
        assert a in HEALTHY, rule
        rows.append((rule, "https://s.example/p", 200, 10, [], HEALTHY.replace(a, b)))
    rows += [("404", "https://s.example/p", 404, 10, [], None), ("500", "https://s.example/p", 500, 10, [], None), ("fail", "https://s.example/p", None, None, None, None)]
    rows += [("hops", "https://s.example/p", 200, 1600, ["a", "b", "c"], None), ("loop", "https://s.example/P_x", 200, 1, ["a", "a"], None)]
    pages = R.prepared(H.parsed(spark.createDataFrame(rows, ROW)))
    out = {}
    for r in R.page_findings(pages, R.capabilities(True, False, True)).collect():
        out.setdefault(r.run, set()).add(r.rule)
    return out


def test_registry(spark):
    ids = [r.id for r in [*R.page_rules(), *R.SITE_RULES]]
    assert len(R.page_rules()) == 48 and len(R.SITE_RULES) == 14 and len(set(ids)) == 62


def test_healthy_page_has_no_finding(found):
    assert found.get("healthy", set()) == set()


@pytest.mark.parametrize("rule", sorted(CASES))
def test_rule_fires(found, rule):
    assert rule in found[rule]


def test_http_rules(found):
    assert found["404"] == {"http.status-4xx"} and found["500"] == {"http.status-5xx"} and found["fail"] == {"http.fetch-failed"}
    assert {"redirect.chain-too-long", "page.slow-response"} <= found["hops"] and {"redirect.loop", "url.problematic"} <= found["loop"]


def test_site_rules(spark):
    page = '<html><head><title>{t}</title><link rel="canonical" href="{c}"></head><body>{b}</body></html>'
    rows = [
        ("r", "https://s.example/a", 200, 1, [], page.format(t="Same", c="https://s.example/b", b='<a href="/b">b</a><a href="/old">o</a><a href="/gone">g</a>')),
        ("r", "https://s.example/b", 200, 1, ["https://s.example/old"], page.format(t="Same", c="https://s.example/c", b="")),
        ("r", "https://s.example/c", 200, 1, [], page.format(t="Other", c="https://s.example/c", b="")),
        ("r", "https://s.example/gone", 404, 1, [], None),
    ]
    pages = R.prepared(H.parsed(spark.createDataFrame(rows, ROW)).withColumn("in_degree", F.lit(0)).withColumn("is_root", F.col("url").endswith("/a")))
    listed = spark.createDataFrame([("r", "https://s.example/gone"), ("r", "https://s.example/a")], "run string, loc string")
    got = {(r.rule, r.url) for r in R.site_findings(pages, listed, R.capabilities(True, False, True)).collect()}
    assert ("canonical.chain", "https://s.example/a") in got and ("title.duplicate", "https://s.example/a") in got
    assert ("link.broken-internal", "https://s.example/a") in got and ("link.to-redirect", "https://s.example/a") in got
    assert ("page.orphan", "https://s.example/c") in got and ("page.orphan", "https://s.example/a") not in got
    assert ("sitemap.dead-url", "https://s.example/gone") in got and ("sitemap.missing-page", "https://s.example/b") in got


def test_gating(spark):
    miss = {r.rule: r.missing for r in R.skipped(spark, R.capabilities(False, False, False)).collect()}
    assert miss["page.too-deep"] == ["complete-crawl"] and miss["sitemap.missing-page"] == ["complete-crawl", "sitemap"] and "title.missing" not in miss


def test_parser_details():
    f = H.facts_of('<p>a<p>b <b>c<br>d</b><h1>T</h1><p> </p><p>First &amp; only<li>x<script>var a="<p>no</p>"</script><noscript>n</noscript><a href=/z>z<img src=i></a>', "https://s.example/")
    assert f["text"] == "a b c d T First & only xz" and f["first_paragraph_after_h1"] == "First & only" and f["has_noscript"] and f["script_count"] == 1
    assert f["links"][0]["resolved"] == "https://s.example/z" and f["links"][0]["wraps_image"] and H.facts_of(None, "x") is None
