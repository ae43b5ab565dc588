"""Queries on texts, keywords, result lists and the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import urls as U
from brindle.functions.text import STOP_WORDS, content_tokens, shingles, slug, word_count, words
from brindle.operators import content as C
from brindle.operators import crawl as CR
from brindle.operators import graph as G
from brindle.plans import Registry
from brindle.sources import table

REG = Registry()

_STOP = "['" + "','".join(STOP_WORDS) + "']"
_TOK = "list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda x: NOT list_contains(" + _STOP + ", x))"


def _tok(c: str) -> str:
    return _TOK.format(c=c)


@REG.add("content_tokens", f"SELECT prompt, array_to_string({_tok('text')}, ' ') AS tokens FROM (SELECT DISTINCT prompt, text FROM engine_prompt)")
def content_tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "engine_prompt").select("prompt", "text").distinct()
    return p.select("prompt", F.array_join(content_tokens("text"), " ").alias("tokens"))


@REG.add("word_count", "SELECT page_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]')))::INT AS words FROM (SELECT DISTINCT page_id, text FROM existing_page)")
def word_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "existing_page").select("page_id", "text").distinct().select("page_id", word_count("text").alias("words"))


@REG.add(
    "shingle_counts",
    """WITH w AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM (SELECT DISTINCT id, text FROM corpus_document WHERE text IS NOT NULL)),
    s AS (SELECT id, unnest(range(1, len(w) - 1)) AS i, w FROM w) SELECT array_to_string(w[i:i + 2], ' ') AS shingle, count(DISTINCT id) AS documents FROM s GROUP BY ALL HAVING count(DISTINCT id) >= 3""",
)
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "corpus_document").where("text is not null").select("id", "text").distinct()
    s = c.select("id", F.explode(F.array_distinct(shingles(words("text"), 3))).alias("shingle"))
    return s.groupBy("shingle").agg(F.countDistinct("id").alias("documents")).where("documents >= 3")


@REG.add("slugs", """SELECT page_id, left(regexp_replace(regexp_replace(replace(lower(strip_accents(coalesce(title, ''))), 'ł', 'l'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM (SELECT DISTINCT page_id, title FROM existing_page)""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "existing_page").select("page_id", "title").distinct().select("page_id", slug(F.col("title")).alias("slug"))


@REG.add("originality")
def originality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt text against the comparison corpus."""
    d = table(spark, sf_dir, "engine_prompt").groupBy(F.col("prompt").alias("id")).agg(F.min("text").alias("text"))
    c = table(spark, sf_dir, "corpus_document").where("text is not null").groupBy("id").agg(F.min("text").alias("text"))
    return C.originality(d, c)


_SERP = """q AS (SELECT query, arg_max(struct_pack(u := urls), (taken_at, snapshot_id)).u AS u FROM serp_snapshot WHERE query IS NOT NULL GROUP BY query),
t AS (SELECT query, (list_filter(u, lambda x: x IS NOT NULL AND x <> '')) AS u FROM q),
d AS (SELECT query, list_filter(u, lambda x, i: list_position(u, x) = i)[1:10] AS u FROM t),
e AS (SELECT query, unnest(u) AS v FROM d WHERE len(u) > 0)"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_urls(table(spark, sf_dir, "serp_snapshot"))


@REG.add("serp_overlap_pairs", f"WITH {_SERP} SELECT a.query AS a, b.query AS b, count(*) AS shared FROM e a JOIN e b ON a.v = b.v AND a.query < b.query GROUP BY ALL HAVING count(*) >= 3")
def serp_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overlap_pairs(_queries(spark, sf_dir), "query", "urls", 3)


@REG.add("serp_clusters")
def serp_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queries(spark, sf_dir).withColumn("w", F.size("urls"))
    return C.greedy_clusters(q, "query", "w", C.overlap_pairs(q, "query", "urls", 3))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "existing_page").where("title is not null").groupBy(F.col("title").alias("query")).agg(F.count("*").alias("impressions"))


@REG.add(
    "lexical_edges",
    f"""WITH q AS (SELECT query, list_distinct({_tok('query')}) AS t FROM (SELECT DISTINCT title AS query FROM existing_page WHERE title IS NOT NULL)), e AS (SELECT query, len(t) AS n, unnest(t) AS v FROM q)
    SELECT a.query AS a, b.query AS b, count(*) AS shared FROM e a JOIN e b ON a.v = b.v AND a.query < b.query GROUP BY a.query, b.query HAVING count(*) >= 0.5 * least(any_value(a.n), any_value(b.n))""",
)
def lexical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lexical_pairs(_titles(spark, sf_dir), "query", "query")


@REG.add("lexical_clusters")
def lexical_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _titles(spark, sf_dir)
    return C.greedy_clusters(t, "query", "impressions", C.lexical_pairs(t, "query", "query"))


def _prompt_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "engine_prompt").where("text is not null").select(F.col("prompt_set").alias("cluster"), F.col("text").alias("query"), F.lit(1).alias("impressions")).distinct()


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "existing_page").where("url is not null").groupBy("url").agg(F.min("title").alias("text")).where("text is not null")


@REG.add(
    "coverage_decision",
    f"""WITH q AS (SELECT DISTINCT prompt_set AS cluster, text AS query FROM engine_prompt WHERE text IS NOT NULL), qt AS (SELECT cluster, query, list_distinct({_tok('query')}) AS t FROM q),
    total AS (SELECT cluster, count(*) AS total FROM qt WHERE len(t) > 0 GROUP BY cluster), qx AS (SELECT cluster, query, len(t) AS n, unnest(t) AS v FROM qt),
    p AS (SELECT url, min(title) AS title FROM existing_page WHERE url IS NOT NULL GROUP BY url HAVING min(title) IS NOT NULL), px AS (SELECT url, unnest(list_distinct({_tok('title')})) AS v FROM p),
    m AS (SELECT cluster, query, url, count(*) = any_value(n) AS whole FROM qx JOIN px USING (v) GROUP BY ALL), c AS (SELECT cluster, url, count(*) FILTER (whole) AS w FROM m GROUP BY ALL),
    b AS (SELECT cluster, url, w / total AS coverage FROM c JOIN total USING (cluster))
    SELECT cluster, url, round(coverage, 9) AS coverage, CASE WHEN coverage >= 0.6 THEN 'refresh' ELSE 'create' END AS decision FROM b QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY coverage DESC, url) = 1""",
)
def coverage_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.decide_coverage(C.coverage(_prompt_sets(spark, sf_dir), _pages(spark, sf_dir)))
    return d.withColumn("coverage", F.round("coverage", 9))


@REG.add(
    "internal_link_topk",
    f"""WITH c AS (SELECT prompt AS cluster, list_distinct({_tok('text')}) AS t FROM (SELECT prompt, min(text) AS text FROM engine_prompt GROUP BY prompt)), cx AS (SELECT cluster, len(t) AS n, unnest(t) AS v FROM c),
    p AS (SELECT url, min(title) AS title FROM existing_page WHERE url IS NOT NULL GROUP BY url HAVING min(title) IS NOT NULL), px AS (SELECT url, unnest(list_distinct({_tok('title')})) AS v FROM p),
    m AS (SELECT cluster, url, count(*) / any_value(n) AS relevance FROM cx JOIN px USING (v) GROUP BY ALL HAVING count(*) / any_value(n) >= 0.15)
    SELECT cluster, url, round(relevance, 9) AS relevance, row_number() OVER (PARTITION BY cluster ORDER BY relevance DESC, url)::INT AS rank FROM m QUALIFY rank <= 3""",
)
def internal_link_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "engine_prompt").groupBy(F.col("prompt").alias("cluster")).agg(F.min("text").alias("text"))
    return C.suggest_links(c, _pages(spark, sf_dir).withColumn("in_degree", F.lit(0))).withColumn("relevance", F.round("relevance", 9))


def whole_pages(pages: DataFrame) -> DataFrame:
    """``url, text``: title and whole text of the last version of each page."""
    last = pages.where("url is not null").groupBy("url").agg(F.max(F.struct("extracted_at", "title", "text")).alias("p"))
    return last.select("url", F.concat_ws(" ", "p.title", "p.text").alias("text"))


def last_in_degrees(degrees: DataFrame, crawls: DataFrame) -> DataFrame:
    """``url, in_degree``: inbound links of each address in the last run that holds it."""
    last = crawls.where("url is not null").groupBy("url").agg(F.max(F.struct("fetched_at", "run")).alias("m")).select("url", "m.run")
    return degrees.join(last, ["run", "url"]).select("url", "in_degree")


@REG.add("coverage_decision_whole")
def coverage_decision_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``coverage_decision`` over titles and whole texts; its SQL fixes titles."""
    d = C.decided(C.best_coverage(_prompt_sets(spark, sf_dir), whole_pages(table(spark, sf_dir, "existing_page"))))
    return d.withColumn("coverage", F.round("coverage", 9))


@REG.add("internal_link_topk_whole")
def internal_link_topk_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``internal_link_topk`` over titles and whole texts, ties by inbound links; its SQL fixes titles and no links."""
    c = table(spark, sf_dir, "engine_prompt").groupBy(F.col("prompt").alias("cluster")).agg(F.min("text").alias("text"))
    links = last_in_degrees(link_graph_degrees(spark, sf_dir), table(spark, sf_dir, "crawl_page"))
    pages = whole_pages(table(spark, sf_dir, "existing_page")).join(links, "url", "left").na.fill(0, ["in_degree"])
    return C.suggest_links_whole(c, pages).withColumn("relevance", F.round("relevance", 9))


@REG.add("url_hash", "SELECT DISTINCT url, left(sha256(url), 32) AS hash, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, split_part(regexp_replace(url, '^[a-z]+://[^/?#]+', ''), '/', 2) AS section FROM existing_page WHERE url IS NOT NULL")
def url_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "existing_page").where("url is not null").select("url").distinct()
    return u.select("url", U.url_hash(F.col("url")).alias("hash"), U.host(F.col("url")).alias("host"), U.section(F.col("url")).alias("section"))


@REG.add("url_normalize")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address of result lists and its identity."""
    u = table(spark, sf_dir, "serp_snapshot").select(F.explode("urls").alias("url")).where("url is not null").distinct()
    n = u.withColumn("normalized", U.normalize_url("url"))
    return n.withColumn("hash", U.url_hash(F.col("normalized")))


@REG.add("url_problems")
def url_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "serp_snapshot").select(F.explode("urls").alias("url")).where("url is not null").distinct()
    return u.withColumn("problems", F.array_join(U.path_problems(F.col("url")), ",")).where("problems <> ''")


#: Facts of a crawl record that the graph needs.
_FACTS = "title string, lang string, links array<struct<href:string,anchorText:string,isInternal:boolean>>"
_VALID = "json_valid(facts)"
_EDGES = f"""n AS (SELECT DISTINCT run, url FROM crawl_page WHERE url IS NOT NULL), f AS (SELECT DISTINCT run, url, facts FROM crawl_page WHERE facts IS NOT NULL AND {_VALID}),
l AS (SELECT run, url AS src, unnest(json_extract(facts, '$.links[*]')) AS l FROM f), e0 AS (SELECT DISTINCT run, src, json_extract_string(l, '$.href') AS dst FROM l WHERE json_extract_string(l, '$.isInternal') = 'true'),
e AS (SELECT DISTINCT e0.run, src, dst FROM e0 JOIN n a ON e0.run = a.run AND src = a.url JOIN n b ON e0.run = b.run AND dst = b.url WHERE src <> dst)"""


def crawl_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawl_page").where("url is not null").select("run", "url").distinct()


def crawl_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct internal links between known pages of a run. Addresses are resolved against their page and matched by
    identity (``url_key``), which is computed once for each distinct address."""
    c = table(spark, sf_dir, "crawl_page").where("facts is not null").select("run", "url", F.from_json("facts", _FACTS).alias("f"), F.expr("try_parse_json(facts)").isNotNull().alias("ok")).where("ok")
    links = c.select("run", F.col("url").alias("src"), F.explode("f.links").alias("l")).where("l.isInternal").select("run", "src", F.col("l.href").alias("href")).distinct()
    at = F.regexp_extract("src", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+", 0)
    links = links.withColumn("dst", F.when(F.col("href").rlike("^(?i)https?://"), F.col("href")).when(F.col("href").startswith("/") & ~F.col("href").startswith("//"), F.concat(at, "href")).otherwise(U.resolve_url("href", "src")))
    nodes = crawl_nodes(spark, sf_dir)
    # a page under its own spelling needs no key; the others meet by identity
    plain = links.join(nodes.select("run", F.col("url").alias("dst")), ["run", "dst"], "left_semi").select("run", "src", "dst")
    other = links.join(nodes.select("run", F.col("url").alias("dst")), ["run", "dst"], "left_anti").where("dst is not null")
    keyed = nodes.withColumn("k", U.url_key(F.col("url"))).groupBy("run", "k").agg(F.min("url").alias("page"))
    keys = other.select("dst").distinct().withColumn("k", U.url_key(F.col("dst")))
    met = other.join(keys, "dst").join(keyed, ["run", "k"]).select("run", "src", F.col("page").alias("dst"))
    return G.clean_edges(plain.unionByName(met), nodes)


@REG.add("link_graph_degrees", f"WITH {_EDGES} SELECT n.run, n.url, (SELECT count(*) FROM e WHERE e.run = n.run AND e.dst = n.url) AS in_degree, (SELECT count(*) FROM e WHERE e.run = n.run AND e.src = n.url) AS out_degree FROM n")
def link_graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(crawl_nodes(spark, sf_dir), crawl_links(spark, sf_dir))


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first address of each run serves as its root: these runs hold no home pages."""
    return crawl_nodes(spark, sf_dir).groupBy("run").agg(F.min("url").alias("url"))


@REG.add("orphans", f"WITH {_EDGES}, r AS (SELECT run, min(url) AS url FROM n GROUP BY run) SELECT run, url FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.run = n.run AND e.dst = n.url) AND NOT EXISTS (SELECT 1 FROM r WHERE r.run = n.run AND r.url = n.url)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.orphans(link_graph_degrees(spark, sf_dir), _roots(spark, sf_dir))


@REG.add("orphans_stored", f"WITH {_EDGES} SELECT run, url FROM n ANTI JOIN e ON n.run = e.run AND n.url = e.dst")
def orphans_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.unlinked(crawl_nodes(spark, sf_dir), crawl_links(spark, sf_dir))


@REG.add(
    "click_depth",
    f"""WITH RECURSIVE {_EDGES}, r AS (SELECT run, min(url) AS url FROM n GROUP BY run), b(run, url, depth) AS (SELECT run, url, 0 FROM r UNION SELECT e.run, e.dst, b.depth + 1 FROM b JOIN e ON e.run = b.run AND e.src = b.url WHERE b.depth < 25)
    SELECT n.run, n.url, min(depth)::INT AS depth FROM n LEFT JOIN b USING (run, url) GROUP BY ALL""",
)
def click_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.click_depth(crawl_nodes(spark, sf_dir), crawl_links(spark, sf_dir), _roots(spark, sf_dir))


@REG.add(
    "crawl_order",
    f"""WITH RECURSIVE {_EDGES}, r AS (SELECT run, min(url) AS url FROM n GROUP BY run), b(run, url, depth) AS (SELECT run, url, 0 FROM r UNION SELECT e.run, e.dst, b.depth + 1 FROM b JOIN e ON e.run = b.run AND e.src = b.url WHERE b.depth < 5),
    m AS (SELECT run, url, min(depth)::INT AS depth FROM b GROUP BY ALL) SELECT run, url, depth, row_number() OVER (PARTITION BY run ORDER BY depth, url)::INT AS nth FROM m QUALIFY nth <= 500""",
)
def crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breadth-first crawl of each run from its first address: depth 5, 500 pages."""
    seen, _ = CR.crawl(crawl_nodes(spark, sf_dir), crawl_links(spark, sf_dir), _roots(spark, sf_dir), 5, 500, ["run"])
    return seen


@REG.add(
    "redirect_problems",
    """SELECT run, url, len(redirect_chain)::INT AS hops, CASE WHEN len(list_distinct(list_append(redirect_chain, url))) <= len(redirect_chain) THEN 'loop' ELSE 'too-long' END AS problem
    FROM (SELECT DISTINCT run, url, redirect_chain FROM crawl_page WHERE len(redirect_chain) > 0) WHERE len(list_distinct(list_append(redirect_chain, url))) <= len(redirect_chain) OR len(redirect_chain) > 2""",
)
def redirect_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "crawl_page").select("run", "url", "redirect_chain").distinct()
    return c.select("run", "url", F.size("redirect_chain").alias("hops"), G.redirect_problem(F.col("redirect_chain"), F.col("url")).alias("problem")).where("problem is not null")


@REG.add("redirect_chains", "SELECT run, url, len(redirect_chain)::INT AS hops, redirect_chain[1] AS first, len(list_distinct(list_append(redirect_chain, url))) <= len(redirect_chain) AS loops FROM (SELECT DISTINCT run, url, redirect_chain FROM crawl_page WHERE len(redirect_chain) > 0)")
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chain, with the address it starts at and whether it comes back to itself."""
    c = table(spark, sf_dir, "crawl_page").where(F.size("redirect_chain") > 0).select("run", "url", "redirect_chain").distinct()
    return c.select("run", "url", F.size("redirect_chain").alias("hops"), F.col("redirect_chain")[0].alias("first"), G.chain_repeats(F.col("redirect_chain"), F.col("url")).alias("loops"))


#: A robots text for the query below.
ROBOTS = "User-agent: *\nDisallow: /shop\nAllow: /shop/a\nDisallow: /*czy\nDisallow: /news/*-5f5e$\nCrawl-delay: 2\nSitemap: https://example.com/sitemap.xml\n"


@REG.add(
    "robots_decision",
    """WITH u AS (SELECT DISTINCT url, regexp_replace(url, '^[a-z]+://[^/?#]+', '') AS p FROM crawl_page WHERE url IS NOT NULL), l AS (SELECT url,
    CASE WHEN p LIKE '/shop/a%' THEN 7 ELSE -1 END AS allow, greatest(CASE WHEN p LIKE '/shop%' THEN 5 ELSE -1 END, CASE WHEN p LIKE '/%czy%' THEN 5 ELSE -1 END, CASE WHEN regexp_matches(p, '^/news/.*-5f5e$') THEN 12 ELSE -1 END) AS deny FROM u)
    SELECT url, deny = -1 OR allow >= deny AS allowed FROM l""",
)
def robots_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "crawl_page").where("url is not null").select("url").distinct()
    return CR.robots_decisions(u, {"*": ROBOTS}, "sample-crawler/1.0")


@REG.add("sitemap_entries", "SELECT DISTINCT site, url AS loc FROM existing_page WHERE url IS NOT NULL")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps written from the pages of each site, parsed again."""
    p = table(spark, sf_dir, "existing_page").where("url is not null").select("site", "url").distinct()
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    part = F.pmod(F.xxhash64("url"), F.lit(64))  # a site's urls in files of bounded size
    xml = p.groupBy("site", part.alias("part")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.array_sort(F.collect_list(entry)), ""), F.lit("</urlset>")).alias("xml"))
    s = xml.select("site", CR.sitemap("xml").alias("s"))
    return s.select("site", F.explode("s.entries").alias("e")).select("site", F.col("e.loc").alias("loc"))


@REG.add("llms_txt_sections", """WITH u AS (SELECT DISTINCT site, url, split_part(regexp_replace(url, '^[a-z]+://[^/?#]+', ''), '/', 2) AS section FROM crawl_page WHERE url IS NOT NULL AND status = 200)
SELECT site, section, url, row_number() OVER (PARTITION BY site, section ORDER BY url)::INT AS rank FROM u QUALIFY rank <= 50""")
def llms_txt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.operators.metrics import top_per_key

    u = table(spark, sf_dir, "crawl_page").where("url is not null and status = 200").select("site", "url").distinct().withColumn("section", U.section(F.col("url")))
    return top_per_key(u, ["site", "section"], 50, F.asc("url")).select("site", "section", "url", "rank")


@REG.add("ranked_pages")
def ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by a short query."""
    from brindle.operators.ranking import ranked

    p = table(spark, sf_dir, "existing_page").groupBy("page_id").agg(F.min("title").alias("name"), F.min("text").alias("body"))
    return ranked(p.select(F.col("page_id").alias("id"), "name", "body"), "care and storage of brake pads")
