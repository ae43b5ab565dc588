"""Queries on crawled pages: facts, the audit and its report frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.urls import crawl_start, url_key
from brindle.operators import graph as G
from brindle.operators import html as H
from brindle.operators import rules as R
from brindle.plans import Registry
from brindle.plans.content_queries import _EDGES, crawl_links, crawl_nodes
from brindle.session import cut
from brindle.sources import table

REG = Registry()

_F = "title string, metaDescription string, lang string, headings array<struct<level:int,text:string>>, links array<struct<href:string,anchorText:string,isInternal:boolean>>, text string, wordCount int, scriptCount int, hasNoscript boolean"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each run and address (the first), with its parsed facts ``j``, null where they don't parse."""
    c = table(spark, sf_dir, "crawl_page").where("url is not null")
    one = c.groupBy("run", "url").agg(F.min(F.struct("crawl_id", "facts", "depth", "status", "duration_ms", "redirect_chain", "site", "error", "render_diff", "bytes")).alias("m")).select("run", "url", "m.*")
    ok = F.expr("try_parse_json(facts)").isNotNull()
    return one.withColumn("j", F.when(ok, F.from_json("facts", _F))).drop("facts")


_ONE = """one AS (SELECT * FROM crawl_page WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run, url ORDER BY crawl_id, facts) = 1), v AS (SELECT *, CASE WHEN json_valid(facts) THEN facts END AS j FROM one)"""


@REG.add("facts_fields", f"WITH {_ONE} SELECT run, url, json_extract_string(j, '$.title') AS title, json_extract_string(j, '$.lang') AS lang, (json_extract(j, '$.wordCount'))::INT AS words, json_array_length(j, '$.links')::INT AS links, json_array_length(j, '$.headings')::INT AS headings FROM v WHERE j IS NOT NULL")
def facts_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).where("j is not null")
    return r.select("run", "url", "j.title", "j.lang", F.col("j.wordCount").alias("words"), F.size("j.links").alias("links"), F.size("j.headings").alias("headings"))


def page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl records as HTML pages, built from their facts: the input of the parser."""
    def esc(c: F.Column) -> F.Column:
        return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    j = F.col("j")
    heads = F.array_join(F.transform(F.coalesce(j["headings"], F.array()), lambda h: F.concat(F.lit("<h"), h["level"].cast("string"), F.lit(">"), esc(h["text"]), F.lit("</h"), h["level"].cast("string"), F.lit(">"))), "")
    links = F.array_join(F.transform(F.coalesce(j["links"], F.array()), lambda x: F.concat(F.lit('<a href="'), esc(x["href"]), F.lit('">'), esc(x["anchorText"]), F.lit("</a> "))), "")
    paras = F.array_join(F.transform(F.split(F.coalesce(j["text"], F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))), "\n")
    doc = F.concat(
        F.lit("<!doctype html><html"), F.coalesce(F.concat(F.lit(' lang="'), j["lang"], F.lit('"')), F.lit("")), F.lit('><head><meta charset="utf-8"><title>'), esc(j["title"]), F.lit("</title>"),
        F.when(j["metaDescription"].isNotNull(), F.concat(F.lit('<meta name="description" content="'), esc(j["metaDescription"]), F.lit('">'))).otherwise(""), F.lit("</head><body><nav>"), links, F.lit("</nav>"), heads, paras, F.lit("</body></html>"),
    )
    return records(spark, sf_dir).withColumn("html", F.when(j.isNotNull(), doc)).drop("j")


@REG.add("parse_page")
def parse_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = H.parsed(page_html(spark, sf_dir)).where("f is not null")
    return p.select("run", "url", "f.title", "f.title_length", "f.meta_description", "f.lang", "f.h1_count", F.size("f.headings").alias("headings"), F.size("f.links").alias("links"), F.size("f.heading_order_jumps").alias("jumps"), "f.word_count", "f.first_paragraph_after_h1", "f.html_bytes")


@REG.add(
    "heading_jumps",
    f"""WITH {_ONE}, h AS (SELECT run, url, (json_extract(j, '$.headings[*].level'))::INT[] AS l FROM v WHERE j IS NOT NULL), x AS (SELECT run, url, l, unnest(range(1, len(l))) AS i FROM h)
    SELECT run, url, count(*) AS jumps FROM x WHERE l[i + 1] > l[i] + 1 GROUP BY ALL""",
)
def heading_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).where("j is not null").select("run", "url", F.col("j.headings.level").alias("l"))
    nxt = F.zip_with("l", F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), lambda a, b: F.coalesce(b > a + 1, F.lit(False)))
    return r.select("run", "url", F.size(F.filter(nxt, lambda x: x)).cast("bigint").alias("jumps")).where("jumps > 0")


@REG.add(
    "render_diff",
    """WITH d AS (SELECT DISTINCT crawl_id, render_diff AS r FROM crawl_page WHERE render_diff IS NOT NULL AND json_valid(render_diff))
    SELECT crawl_id, json_extract_string(r, '$.rawTitle') IS DISTINCT FROM json_extract_string(r, '$.renderedTitle') AS title_changed, (json_extract(r, '$.renderedWordCount'))::INT - (json_extract(r, '$.rawWordCount'))::INT AS gained,
    json_array_length(r, '$.linksOnlyInRendered')::INT AS new_links FROM d""",
)
def render_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = "rawTitle string, renderedTitle string, rawWordCount int, renderedWordCount int, linksOnlyInRendered array<string>"
    d = table(spark, sf_dir, "crawl_page").where("render_diff is not null").select("crawl_id", "render_diff").distinct().where(F.expr("try_parse_json(render_diff)").isNotNull())
    d = d.select("crawl_id", F.from_json("render_diff", s).alias("r"))
    return d.select("crawl_id", (~F.col("r.rawTitle").eqNullSafe(F.col("r.renderedTitle"))).alias("title_changed"), (F.col("r.renderedWordCount") - F.col("r.rawWordCount")).alias("gained"), F.size("r.linksOnlyInRendered").alias("new_links"))


_DIFF = "rawWordCount int, renderedWordCount int, contentRequiresJs boolean"


def audit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed pages with their depth, their place in the link graph, whether they are the start of the crawl or blocked, and
    their render difference; written once for the rules. These tables hold no robots files, so their state is ok."""
    deg = G.degrees(crawl_nodes(spark, sf_dir), crawl_links(spark, sf_dir))
    p = H.parsed(page_html(spark, sf_dir)).join(deg, ["run", "url"], "left")
    r = F.from_json("render_diff", _DIFF)
    gained = F.greatest(r["renderedWordCount"] - r["rawWordCount"], F.lit(0)) / F.nullif(r["renderedWordCount"], F.lit(0))
    needs_js = F.coalesce(r["contentRequiresJs"], gained >= H.JS_REQUIRED, F.lit(False))
    ok = F.expr("try_parse_json(render_diff)").isNotNull()
    p = p.withColumns({"diff": F.when(ok, F.struct(needs_js.alias("content_requires_js"))), "is_root": F.coalesce(url_key(F.col("url")) == url_key(crawl_start(F.col("site"))), F.lit(False)), "blocked": F.coalesce(F.lower("error").contains("robots"), F.lit(False))})
    return cut(R.prepared(p.drop("render_diff", "site", "error", "bytes")), "audit")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = audit_pages(spark, sf_dir)
    listed = table(spark, sf_dir, "crawl_page").where("in_sitemap and url is not null").select("run", F.col("url").alias("loc")).distinct()
    return R.audit(pages, listed, has_diff=True)


@REG.add("rule_findings")
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir)


@REG.add("rule_counts")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_rule(findings(spark, sf_dir))


#: Rules whose findings on these tables SQL can tell from the facts, as ``id, severity, condition, evidence`` over the pages
#: ``p`` (``x``: facts parsed; ``ok``: indexable), and rules over groups of pages.
_BLANKS = "'[ \\t\\n\\r\\f\\v ]+'"
_BY_FACTS = [
    ("canonical.missing", "medium", "ok", "NULL"), ("http.status-4xx", "high", "status BETWEEN 400 AND 499", "status::INT"), ("http.status-5xx", "blocker", "status >= 500", "status::INT"), ("http.fetch-failed", "blocker", "status IS NULL", "NULL"),
    ("redirect.chain-too-long", "medium", "len(redirect_chain) > 2", "len(redirect_chain)"), ("redirect.loop", "high", "len(redirect_chain) > 0 AND len(list_distinct(list_append(redirect_chain, url))) <= len(redirect_chain)", "NULL"),
    ("title.missing", "high", "ok AND title = ''", "NULL"), ("title.too-long", "low", "x AND length(title) > 60", "length(title)"), ("title.too-short", "low", "x AND length(title) BETWEEN 1 AND 14", "length(title)"),
    ("description.missing", "medium", "ok AND description IS NULL", "NULL"), ("description.too-long", "low", "x AND length(description) > 160", "length(description)"), ("description.too-short", "low", "x AND length(description) BETWEEN 1 AND 49", "length(description)"),
    ("h1.missing", "medium", "ok AND h1 = 0", "NULL"), ("h1.multiple", "low", "x AND h1 > 1", "h1"), ("lang.missing", "low", "x AND coalesce(lang, '') = ''", "NULL"), ("page.dead-end", "low", "ok AND outs = 0", "NULL"), ("page.too-deep", "low", "depth > 4", "depth"),
    ("jsonld.missing", "low", "ok", "NULL"), ("og.missing", "low", "ok", "NULL"), ("twitter.missing", "info", "ok", "NULL"), ("viewport.missing", "medium", "x", "NULL"), ("page.slow-response", "medium", "duration_ms > 1500", "duration_ms"),
    ("ai.js-required-for-content", "high", "js", "NULL"), ("page.orphan", "medium", "ok AND ins = 0 AND NOT root", "NULL"), ("link.generic-anchor", "info", "x AND generic", "NULL"), ("heading.order-jump", "low", "x AND jumps > 0", "jumps"),
]
_GENERIC = "['" + "','".join(R.GENERIC_ANCHORS) + "']"
_FACTS_SQL = (
    f"WITH {_EDGES}, one AS (SELECT * FROM crawl_page WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run, url ORDER BY crawl_id, facts) = 1), v AS (SELECT *, CASE WHEN json_valid(facts) THEN facts END AS j, CASE WHEN json_valid(render_diff) THEN render_diff END AS rd FROM one),"
    f" i AS (SELECT run, dst AS url, count(*) AS ins FROM e GROUP BY ALL), o AS (SELECT run, src AS url, count(*) AS outs FROM e GROUP BY ALL),"
    f""" h AS (SELECT run, url, (json_extract(j, '$.headings[*].level'))::INT[] AS l, json_extract_string(j, '$.links[*].anchorText') AS a FROM v WHERE j IS NOT NULL),
    p AS (SELECT v.run, v.url, v.status, v.depth, v.duration_ms, coalesce(v.redirect_chain, []) AS redirect_chain, j IS NOT NULL AS x, j IS NOT NULL AND v.status = 200 AS ok, trim(regexp_replace(coalesce(json_extract_string(j, '$.title'), ''), {_BLANKS}, ' ', 'g')) AS title,
      trim(json_extract_string(j, '$.metaDescription')) AS description, json_extract_string(j, '$.lang') AS lang, len(list_filter(h.l, lambda z: z = 1)) AS h1, coalesce(ins, 0) AS ins, coalesce(outs, 0) AS outs,
      len(list_filter(range(1, len(h.l)), lambda z: h.l[z + 1] > h.l[z] + 1)) AS jumps, len(list_filter(h.a, lambda z: list_contains({_GENERIC}, lower(trim(z))))) > 0 AS generic,
      coalesce((json_extract(rd, '$.contentRequiresJs'))::BOOLEAN, FALSE) AS js, v.url IN (CASE WHEN site LIKE 'sc-domain:%' THEN 'https://' || site[11:] || '/' ELSE site END) AS root
      FROM v LEFT JOIN h USING (run, url) LEFT JOIN i USING (run, url) LEFT JOIN o USING (run, url))"""
)
_FACTS_UNION = " UNION ALL ".join(f"SELECT run, '{r}' AS rule, '{sev}' AS severity, url, ({ev})::VARCHAR AS evidence FROM p WHERE {cond}" for r, sev, cond, ev in _BY_FACTS)


@REG.add("rule_findings_facts", f"{_FACTS_SQL} {_FACTS_UNION}")
def rule_findings_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the rules that SQL can tell from the facts."""
    return findings(spark, sf_dir).where(F.col("rule").isin(*(r for r, *_ in _BY_FACTS)))


@REG.add("severity_counts", f"{_FACTS_SQL}, ff AS ({_FACTS_UNION}) SELECT run, severity, count(*) AS n FROM ff GROUP BY ALL")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of these rules by severity."""
    return rule_findings_facts(spark, sf_dir).groupBy("run", "severity").agg(F.count("*").alias("n"))


@REG.add("rules_skipped")
def rules_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that a run cut off by its limits, without rendered pages and without a sitemap, can't run."""
    return R.skipped(spark, R.capabilities(False, False, False)).select("rule", F.array_join("missing", ",").alias("missing"))


_DUP = f"""WITH {_ONE}, p AS (SELECT run, url, {{c}} AS t FROM v WHERE j IS NOT NULL AND status = 200) SELECT run, t AS {{n}}, count(*) AS n, min(url) AS example FROM p WHERE t <> '' GROUP BY run, t HAVING count(*) >= 2"""


@REG.add("title_duplicate", _DUP.format(c="json_extract_string(j, '$.title')", n="title"))
def title_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = records(spark, sf_dir).where("j is not null and status = 200 and j.title <> ''")
    return p.groupBy("run", F.col("j.title").alias("title")).agg(F.count("*").alias("n"), F.min("url").alias("example")).where("n >= 2")


@REG.add("content_duplicate", f"WITH {_ONE}, p AS (SELECT run, url, json_extract_string(j, '$.text') AS t, (json_extract(j, '$.wordCount'))::INT AS w FROM v WHERE j IS NOT NULL AND status = 200) SELECT run, sha256(t) AS hash, count(*) AS n, min(url) AS example FROM p WHERE w >= 50 AND t <> '' GROUP BY run, t HAVING count(*) >= 2")
def content_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = records(spark, sf_dir).where("j is not null and status = 200 and j.wordCount >= 50 and j.text <> ''")
    return p.groupBy("run", F.sha2("j.text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("url").alias("example")).where("n >= 2")


@REG.add("status_histogram", "SELECT run, status::INT AS status, count(*) AS n FROM (SELECT DISTINCT run, url, status FROM crawl_page) GROUP BY ALL")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawl_page").select("run", "url", "status").distinct().groupBy("run", "status").agg(F.count("*").alias("n"))


@REG.add("deepest_pages", "SELECT DISTINCT run, url, depth FROM crawl_page WHERE url IS NOT NULL ORDER BY depth DESC, run, url LIMIT 15")
def deepest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawl_page").where("url is not null").select("run", "url", "depth").distinct().orderBy(F.desc("depth"), "run", "url").limit(15)


@REG.add(
    "audit_tiles",
    f"WITH {_EDGES} SELECT (SELECT count(*) FROM n) AS pages, (SELECT count(DISTINCT (run, url)) FROM crawl_page WHERE status IS NULL AND url IS NOT NULL) AS failed, (SELECT count(*) FROM e) AS links",
)
def audit_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = crawl_nodes(spark, sf_dir).agg(F.count("*").alias("pages"))
    failed = table(spark, sf_dir, "crawl_page").where("status is null and url is not null").select("run", "url").distinct().agg(F.count("*").alias("failed"))
    links = crawl_links(spark, sf_dir).agg(F.count("*").alias("links"))
    return pages.crossJoin(failed).crossJoin(links)
