"""The audit: 62 rules over page facts, evaluated in one scan for pages and by joins for a site.

A page rule is a condition and its evidence, both columns over one row ``run, url, status, duration_ms, redirect_chain,
f (page facts), diff, in_degree, out_degree, depth``. All page rules become one projection: an array of structs that is
filtered and exploded, so a run is scanned once however many rules there are. Site rules are relational. A rule runs
only if the run offers what it needs; the others are reported as skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.urls import path_problems, url_key, url_keys
from brindle.operators.graph import chain_repeats
from brindle.session import cut

SEVERITIES = ("blocker", "high", "medium", "low", "info")


@dataclass(frozen=True)
class Thresholds:
    """Limits of the rules (fixed values)."""

    title_max: int = 60
    title_min: int = 15
    description_max: int = 160
    description_min: int = 50
    thin_words: int = 150
    alt_max: int = 125
    depth_max: int = 4
    hops_max: int = 2
    slow_ms: int = 1500
    heavy_bytes: int = 500_000
    upfront_words: int = 12
    heading_min: int = 12
    url_max: int = 115
    duplicate_words: int = 50


#: Anchors that say nothing about their target (fixed values).
GENERIC_ANCHORS = (
    "tutaj", "tu", "kliknij", "kliknij tutaj", "kliknij tu", "więcej", "wiecej", "czytaj więcej", "czytaj wiecej", "zobacz", "zobacz więcej", "link", "ten link", "strona", "ta strona", "here", "click here", "read more", "more", "learn more", "this page", "link here",
)
#: Headings that mean nothing outside their page (fixed values).
CONTEXT_FREE = (
    "wstęp", "wstep", "wprowadzenie", "podsumowanie", "zakończenie", "zakonczenie", "dlaczego", "dlaczego?", "jak to działa", "jak to dziala", "jak to działa?", "co dalej", "co dalej?", "o nas", "faq", "najczęstsze pytania", "przykłady", "przyklady", "zalety", "wady", "korzyści", "korzysci", "krok 1", "krok 2",
    "intro", "summary", "conclusion", "why", "how it works", "benefits", "examples",
)
#: Fields that structured data of a type must have (fixed values).
REQUIRED_FIELDS = {
    "Article": ["headline"], "BlogPosting": ["headline"], "NewsArticle": ["headline", "datePublished"], "Product": ["name"], "Recipe": ["name", "recipeIngredient"], "FAQPage": ["mainEntity"], "Event": ["name", "startDate"], "JobPosting": ["title", "datePosted", "hiringOrganization"],
}
HREFLANG = r"^(x-default|[a-z]{2,3}(-[A-Z][a-z]{3})?(-([A-Z]{2}|\d{3}))?)$"


@dataclass(frozen=True)
class PageRule:
    id: str
    severity: str
    needs: tuple[str, ...]
    when: Column
    evidence: Column | None = None


@dataclass(frozen=True)
class SiteRule:
    id: str
    severity: str
    needs: tuple[str, ...]
    find: Callable[[DataFrame, DataFrame | None, Thresholds], DataFrame]


PF, HR, RD, LG, CC, SM = "page-facts", "http-response", "render-diff", "link-graph", "complete-crawl", "sitemap"


def indexable() -> Column:
    f = F.col("f")
    return f.isNotNull() & ~F.coalesce(f["meta_robots"]["noindex"], F.lit(False)) & F.coalesce(F.col("status") == 200, F.lit(False))


def _any(arr: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(F.coalesce(arr, F.array()), lambda x: F.coalesce(test(x), F.lit(False)))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def page_rules(t: Thresholds = Thresholds()) -> list[PageRule]:
    f, idx, has = F.col("f"), indexable(), F.col("f").isNotNull()
    links, images, ld = f["links"], f["images"], f["json_ld"]
    same = F.lit(True)

    def r(id_: str, sev: str, needs: tuple[str, ...], when: Column, ev: Column | None = None) -> PageRule:
        return PageRule(id_, sev, needs, F.coalesce(when, F.lit(False)) & (has if PF in needs else same), None if ev is None else ev.cast("string"))

    def words(c: Column) -> Column:
        return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))

    missing = F.flatten(
        F.transform(F.coalesce(ld, F.array()), lambda b: F.flatten(F.transform(F.coalesce(b["entities"], F.array()), lambda e: F.array_except(F.coalesce(F.create_map(*[x for k, v in REQUIRED_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[e["type"]], F.array()), e["fields"]))))
    )
    p = (PF,)
    return [
        r("noindex.present", "high", p, f["meta_robots"]["noindex"]),
        r("canonical.missing", "medium", p, f["canonical_resolved"].isNull() & idx),
        r("canonical.points-elsewhere", "medium", p, F.col("canonical_key") != F.col("key"), f["canonical_resolved"]),
        r("canonical.multiple", "high", p, f["canonical_count"] > 1, f["canonical_count"]),
        r("redirect.meta-refresh", "medium", p, f["meta_refresh"].isNotNull(), f["meta_refresh"]),
        r("http.status-4xx", "high", (HR,), F.col("status").between(400, 499), F.col("status")),
        r("http.status-5xx", "blocker", (HR,), F.col("status") >= 500, F.col("status")),
        r("http.fetch-failed", "blocker", (HR,), F.col("status").isNull()),
        r("redirect.chain-too-long", "medium", (HR,), F.size("redirect_chain") > t.hops_max, F.size("redirect_chain")),
        r("redirect.loop", "high", (HR,), F.col("chain_loops")),
        r("title.missing", "high", p, idx & (F.coalesce(f["title"], F.lit("")) == "")),
        r("title.too-long", "low", p, f["title_length"] > t.title_max, f["title_length"]),
        r("title.too-short", "low", p, f["title_length"].between(1, t.title_min - 1), f["title_length"]),
        r("description.missing", "medium", p, idx & f["meta_description"].isNull()),
        r("description.too-long", "low", p, f["meta_description_length"] > t.description_max, f["meta_description_length"]),
        r("description.too-short", "low", p, f["meta_description_length"].between(1, t.description_min - 1), f["meta_description_length"]),
        r("h1.missing", "medium", p, idx & (f["h1_count"] == 0)),
        r("h1.multiple", "low", p, f["h1_count"] > 1, f["h1_count"]),
        r("heading.order-jump", "low", p, F.size(f["heading_order_jumps"]) > 0, F.size(f["heading_order_jumps"])),
        r("content.thin", "medium", p, idx & (f["word_count"] < t.thin_words), f["word_count"]),
        r("lang.missing", "low", p, F.coalesce(f["lang"], F.lit("")) == ""),
        r("link.nofollow-internal", "low", p, _any(links, lambda x: x["is_internal"] & (x["rel"] != "follow"))),
        r("link.empty-anchor", "low", p, _any(links, lambda x: x["resolved"].isNotNull() & (x["anchor_text"] == "") & ~x["wraps_image"])),
        r("link.generic-anchor", "info", p, _any(links, lambda x: F.lower(x["anchor_text"]).isin(*GENERIC_ANCHORS))),
        r("page.dead-end", "low", (PF, LG), (F.col("out_degree") == 0) & idx),
        r("page.too-deep", "low", (LG, CC), F.col("depth") > t.depth_max, F.col("depth")),
        r("image.missing-alt", "medium", p, _any(images, lambda x: ~x["has_alt"])),
        r("image.alt-too-long", "low", p, _any(images, lambda x: F.length(x["alt"]) > t.alt_max)),
        r("image.missing-dimensions", "low", p, _any(images, lambda x: x["width"].isNull() | x["height"].isNull())),
        r("image.lazy-above-fold", "low", p, F.lower(F.get(images, F.lit(0))["loading"]) == "lazy"),
        r("image.missing-src", "medium", p, _any(images, lambda x: _blank(x["src"]))),
        r("jsonld.invalid", "medium", p, _any(ld, lambda x: x["parse_error"].isNotNull())),
        r("jsonld.missing", "low", p, idx & (F.size(ld) == 0)),
        r("jsonld.empty-type", "low", p, _any(ld, lambda x: x["parse_error"].isNull() & (F.size(x["types"]) == 0))),
        r("jsonld.missing-required-field", "low", p, F.size(missing) > 0, F.array_join(F.array_distinct(missing), ",")),
        r("og.missing", "low", p, idx & (F.size(f["open_graph"]) == 0)),
        r("twitter.missing", "info", p, idx & (F.size(f["twitter_card"]) == 0)),
        r("viewport.missing", "medium", p, f["viewport"].isNull()),
        r("charset.missing", "low", p, f["charset"].isNull()),
        r("hreflang.invalid-code", "low", p, _any(f["hreflang"], lambda x: ~x["lang"].rlike(HREFLANG))),
        r("hreflang.missing-self", "low", p, (F.size(f["hreflang"]) > 0) & ~F.array_contains(F.col("hreflang_keys"), F.col("key"))),
        r("security.mixed-content", "high", p, F.col("url").startswith("https://") & _any(f["resources"], lambda x: x["resolved"].startswith("http://"))),
        r("url.problematic", "low", (HR,), F.size(path_problems(F.col("url"), t.url_max)) > 0, F.array_join(path_problems(F.col("url"), t.url_max), ",")),
        r("page.slow-response", "medium", (HR,), F.col("duration_ms") > t.slow_ms, F.col("duration_ms")),
        r("page.too-heavy", "low", p, f["html_bytes"] > t.heavy_bytes, f["html_bytes"]),
        r("ai.js-required-for-content", "high", (RD,), F.col("diff")["content_requires_js"]),
        r("ai.answer-not-upfront", "low", p, idx & (f["h1_count"] > 0) & (words(f["first_paragraph_after_h1"]) < t.upfront_words), words(f["first_paragraph_after_h1"])),
        r("ai.chunk-not-standalone", "info", p, _any(f["headings"], lambda x: x["level"].between(2, 3) & (F.lower(x["text"]).isin(*CONTEXT_FREE) | (F.length(x["text"]) < t.heading_min)))),
    ]


def _index(pages: DataFrame) -> DataFrame:
    """Pages by address and by the addresses that redirect to them; the page's own address has precedence."""
    if hasattr(pages, "_index_table"):
        return pages._index_table
    own = pages.select("run", F.col("key").alias("k"), F.lit(0).alias("pr"), F.struct("url", "key", "status", "noindex").alias("p"))
    via = pages.where(F.size("redirect_chain") > 0).select("run", F.explode("redirect_chain").alias("u"), F.struct("url", "key", "status", "noindex").alias("p")).select("run", url_key(F.col("u")).alias("k"), F.lit(1).alias("pr"), "p")
    return own.unionByName(via).groupBy("run", "k").agg(F.min(F.struct("pr", "p"))["p"].alias("p"))


def _links(pages: DataFrame) -> DataFrame:
    """Distinct internal links ``run, src, src_key, dst, k``; identities are computed once for each address."""
    if hasattr(pages, "_link_table"):
        return pages._link_table
    e = pages.where("f is not null").select("run", F.col("url").alias("src"), F.col("key").alias("src_key"), F.explode("f.links").alias("l")).where("l.is_internal and l.resolved is not null")
    links = e.select("run", "src", "src_key", F.col("l.resolved").alias("dst")).distinct()
    return links.join(links.select("dst").distinct().withColumn("k", url_key(F.col("dst"))), "dst").select("run", "src", "src_key", "dst", "k")


def _found(df: DataFrame, url: str = "url", evidence: Column | None = None) -> DataFrame:
    return df.select("run", F.col(url).alias("url"), (F.lit(None) if evidence is None else evidence).cast("string").alias("evidence"))


def _duplicates(pages: DataFrame, value: Column) -> DataFrame:
    g = pages.where(indexable()).select("run", "url", value.alias("v")).where("v is not null and v <> ''").groupBy("run", F.sha2("v", 256).alias("h")).agg(F.count("*").alias("n"), F.min("url").alias("url"))
    return _found(g.where("n >= 2"), evidence=F.col("n"))


def _canonical_targets(pages: DataFrame) -> DataFrame:
    a = pages.where("canonical_key is not null and canonical_key <> key").select("run", "url", F.col("canonical_key").alias("k"))
    return a.join(pages.select("run", F.col("key").alias("k"), F.col("status").alias("ts"), F.col("noindex").alias("tn"), F.col("canonical_key").alias("tc"), F.col("url").alias("target")), ["run", "k"])


def _sitemap_hits(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    s = sitemap.select("run", F.col("loc"), url_key(F.col("loc")).alias("k")).distinct()
    return s.join(_index(pages), ["run", "k"]).select("run", F.col("loc").alias("url"), "p")


def _missing_return(pages: DataFrame, _s: DataFrame | None, _t: Thresholds) -> DataFrame:
    h = pages.where("f is not null").select("run", "url", "key", F.explode("hreflang_keys").alias("k")).where("k is not null and k <> key").distinct()
    met = h.join(pages.select("run", F.col("key").alias("k")).distinct(), ["run", "k"])
    back = h.select("run", F.col("k").alias("key"), F.col("key").alias("k"))
    return _found(met.join(back, ["run", "key", "k"], "left_anti").select("run", "url").distinct())


def _sitemap_missing(pages: DataFrame, sitemap: DataFrame | None, _t: Thresholds) -> DataFrame:
    s = sitemap.select("run", url_key(F.col("loc")).alias("key")).distinct()
    gone = pages.where(indexable()).select("run", "url", "key").join(s, ["run", "key"], "left_anti")
    return _found(gone.groupBy("run").agg(F.count("*").alias("n"), F.min("url").alias("url")), evidence=F.col("n"))


SITE_RULES = [
    SiteRule("canonical.chain", "high", (PF, CC), lambda p, s, t: _found(_canonical_targets(p).where("tc is not null and tc <> k"), evidence=F.col("target"))),
    SiteRule("canonical.to-non-indexable", "high", (PF, HR, CC), lambda p, s, t: _found(_canonical_targets(p).where("tn or ts is null or ts >= 400"), evidence=F.col("target"))),
    SiteRule("robots.blocked-but-linked", "medium", (PF, LG), lambda p, s, t: _found(_links(p).join(p.where("blocked").select("run", F.col("key").alias("k")), ["run", "k"]).groupBy("run", "k").agg(F.min("src").alias("src"), F.min("dst").alias("url")), evidence=F.col("src"))),
    SiteRule("title.duplicate", "medium", (PF, CC), lambda p, s, t: _duplicates(p, F.col("f.title"))),
    SiteRule("description.duplicate", "low", (PF, CC), lambda p, s, t: _duplicates(p, F.col("f.meta_description"))),
    SiteRule("content.duplicate", "medium", (PF, CC), lambda p, s, t: _duplicates(p.where(F.col("f.word_count") >= t.duplicate_words), F.col("f.text"))),
    SiteRule("link.broken-internal", "high", (PF, HR, CC), lambda p, s, t: _found(_links(p).join(_index(p), ["run", "k"]).where("p.status >= 400").select("run", F.col("src").alias("url"), "dst").distinct(), evidence=F.col("dst"))),
    SiteRule("link.to-redirect", "low", (PF, HR, CC), lambda p, s, t: _found(_links(p).join(_index(p), ["run", "k"]).where("p.key <> k").select("run", F.col("src").alias("url"), "dst").distinct(), evidence=F.col("dst"))),
    SiteRule("page.orphan", "medium", (LG, CC), lambda p, s, t: _found(p.where((F.col("in_degree") == 0) & indexable() & ~F.col("is_root")))),
    SiteRule("hreflang.missing-return", "medium", (PF, CC), _missing_return),
    SiteRule("sitemap.dead-url", "medium", (SM, HR), lambda p, s, t: _found(_sitemap_hits(p, s).where("p.status is null or p.status >= 400"))),
    SiteRule("sitemap.missing-page", "low", (SM, CC), _sitemap_missing),
    SiteRule("sitemap.non-indexable-url", "medium", (SM, PF), lambda p, s, t: _found(_sitemap_hits(p, s).where("p.noindex"))),
    SiteRule("sitemap.not-discoverable", "medium", (SM,), lambda p, s, t: _found(p.where("robots_state <> 'ok'").groupBy("run").agg(F.min("url").alias("url"), F.min("robots_state").alias("st")), evidence=F.col("st"))),
]


def prepared(pages: DataFrame) -> DataFrame:
    """Adds the keys that rules compare, and defaults for what a run doesn't have. Input: ``run, url, status, duration_ms,
    redirect_chain, f`` and optionally ``diff, in_degree, out_degree, depth, is_root, blocked, robots_state``."""
    have = set(pages.columns)
    extra = {"diff": F.lit(None).cast("struct<content_requires_js:boolean>"), "in_degree": F.lit(None).cast("bigint"), "out_degree": F.lit(None).cast("bigint"), "depth": F.lit(None).cast("int"), "is_root": F.lit(False), "blocked": F.lit(False), "robots_state": F.lit("ok")}
    p = pages.withColumns({k: v for k, v in extra.items() if k not in have})
    p = p.withColumns({"key": url_key(F.col("url")), "noindex": F.coalesce(F.col("f.meta_robots.noindex"), F.lit(False)), "redirect_chain": F.coalesce("redirect_chain", F.array().cast("array<string>"))})
    p = p.withColumn("canonical_key", F.when(F.col("f.canonical_resolved").isNotNull(), url_key(F.col("f.canonical_resolved"))))
    named = F.coalesce(F.transform(F.col("f.hreflang"), lambda h: h["resolved"]), F.array().cast("array<string>"))
    return p.withColumns({"hreflang_keys": F.when(F.size(named) > 0, url_keys(named)).otherwise(F.array().cast("array<string>")), "chain_loops": chain_repeats(F.col("redirect_chain"), F.col("url"))})


def capabilities(complete: bool, has_diff: bool, has_sitemap: bool) -> set[str]:
    return {PF, HR, LG} | ({CC} if complete else set()) | ({RD} if has_diff else set()) | ({SM} if has_sitemap else set())


def skipped(spark, caps: set[str], t: Thresholds = Thresholds()) -> DataFrame:  # noqa: ANN001
    """``rule, missing``: the rules that can't run."""
    rows = [(r.id, sorted(set(r.needs) - caps)) for r in [*page_rules(t), *SITE_RULES] if set(r.needs) - caps]
    return spark.createDataFrame(rows, "rule string, missing array<string>")


def page_findings(pages: DataFrame, caps: set[str], t: Thresholds = Thresholds()) -> DataFrame:
    """``run, rule, severity, url, evidence`` of all page rules in one projection over ``prepared`` pages."""
    hits = [F.when(r.when, F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), (F.lit(None).cast("string") if r.evidence is None else r.evidence).alias("evidence"))) for r in page_rules(t) if set(r.needs) <= caps]
    return pages.select("run", "url", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("run", "h.rule", "h.severity", "url", "h.evidence")


def site_findings(pages: DataFrame, sitemap: DataFrame | None, caps: set[str], t: Thresholds = Thresholds()) -> DataFrame | None:
    """Findings of the site rules. A rule whose plan can't be built is a finding of its own (``rule.crashed``); the others run."""
    out = None
    pages = pages.select("*")
    links, index = cut(_links(pages), "links"), cut(_index(pages), "index")
    pages._link_table, pages._index_table = links, index  # written once, read by several rules
    for r in SITE_RULES:
        if set(r.needs) <= caps and not (SM in r.needs and sitemap is None):
            try:
                one = r.find(pages, sitemap, t).select("run", F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), "url", "evidence")
            except Exception as e:  # noqa: BLE001
                one = crashed(pages, r.id, e)
            out = one if out is None else out.unionByName(one)
    return out


def crashed(pages: DataFrame, rule: str, error: Exception) -> DataFrame:
    """One finding for each run whose rule couldn't be evaluated."""
    text = f"{rule}: {type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
    return pages.select("run").distinct().select("run", F.lit("rule.crashed").alias("rule"), F.lit("info").alias("severity"), F.lit(None).cast("string").alias("url"), F.lit(text).alias("evidence"))


def merged(results: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Findings and skipped rules of several passes: all findings, each skipped rule once."""
    findings, gone = results[0]
    for f, s in results[1:]:
        findings, gone = findings.unionByName(f), gone.unionByName(s)
    return findings, gone.groupBy("rule").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("missing")))).alias("missing"))


def audit(pages: DataFrame, sitemap: DataFrame | None = None, complete: bool = True, has_diff: bool = False, t: Thresholds = Thresholds()) -> DataFrame:
    """All findings of ``prepared`` pages."""
    caps = capabilities(complete, has_diff, sitemap is not None)
    site = site_findings(pages, sitemap, caps, t)
    own = page_findings(pages, caps, t)
    return own if site is None else own.unionByName(site)


def severity_rank(c: str = "severity") -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(c))


def by_rule(findings: DataFrame) -> DataFrame:
    """Counts by rule, worst first."""
    g = findings.groupBy("run", "rule", "severity").agg(F.count("*").alias("n"))
    w = Window.partitionBy("run").orderBy(severity_rank(), F.desc("n"), "rule")
    return g.withColumn("rank", F.row_number().over(w))
