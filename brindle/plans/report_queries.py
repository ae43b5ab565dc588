"""Lists, samples and report frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import stats as S
from brindle.functions import urls as U
from brindle.operators import answers as A
from brindle.operators import crawl as CR
from brindle.operators import metrics as M
from brindle.operators import reports as P
from brindle.plans import Registry
from brindle.plans.answer_queries import _ANSWERS, _good, _mention_sql, mentions
from brindle.plans.audit_queries import _ONE, records
from brindle.plans.content_queries import _EDGES, crawl_links, crawl_nodes, link_graph_degrees
from brindle.plans.metric_queries import _LATEST, latest
from brindle.sources import table

REG = Registry()


@REG.add("sites_listed", "SELECT tenant, site, site LIKE 'sc-domain:%' AS is_domain, count(*) AS n_rows FROM gsc_page_daily GROUP BY tenant, site")
def sites_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gsc_page_daily").groupBy("tenant", "site").agg(F.count("*").alias("n_rows")).withColumn("is_domain", F.col("site").startswith("sc-domain:"))


@REG.add("site_by_uri", "SELECT DISTINCT tenant, site FROM gsc_page_daily WHERE site = (SELECT min(site) FROM gsc_page_daily)")
def site_by_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One property by its address: here the first in order."""
    g = table(spark, sf_dir, "gsc_page_daily").select("tenant", "site")
    return g.join(F.broadcast(g.agg(F.min("site").alias("site"))), "site").select("tenant", "site").distinct()  # one row


@REG.add("recent_runs", "SELECT tenant, run, count(DISTINCT url) AS pages, strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S') AS seen, row_number() OVER (PARTITION BY tenant ORDER BY max(fetched_at) DESC, run DESC)::INT AS rank FROM crawl_page GROUP BY tenant, run QUALIFY rank <= 20")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "crawl_page").groupBy("tenant", "run").agg(F.countDistinct("url").alias("pages"), F.max("fetched_at").alias("at"))
    return M.top_per_key(g, ["tenant"], 20, F.desc("at"), F.desc("run")).select("tenant", "run", "pages", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("seen"), "rank")


@REG.add("verify_day", f"WITH {_LATEST}, t AS (SELECT max(date) AS d FROM gsc_page_daily WHERE state = 'final') SELECT site, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, count(DISTINCT page) AS pages FROM latest, t WHERE date = d GROUP BY site")
def verify_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums of the last final day, to be held against the service's own figures."""
    day = M.final_rows(table(spark, sf_dir, "gsc_page_daily")).agg(F.max("date").alias("date"))  # one row
    return latest(spark, sf_dir).join(F.broadcast(day), "date").groupBy("site").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.countDistinct("page").alias("pages"))


@REG.add("prompt_sets", "SELECT prompt_set, count(DISTINCT prompt) AS prompts, count(DISTINCT locale) AS locales FROM engine_prompt GROUP BY prompt_set")
def prompt_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "engine_prompt").groupBy("prompt_set").agg(F.countDistinct("prompt").alias("prompts"), F.countDistinct("locale").alias("locales"))


@REG.add("active_prompt_sets", f"WITH {_ANSWERS}, u AS (SELECT p.prompt_set, max(a.answered_at) AS used FROM engine_answer a JOIN (SELECT DISTINCT prompt, prompt_set FROM engine_prompt) p USING (prompt) GROUP BY ALL) SELECT prompt_set, strftime(used, '%Y-%m-%d') AS last_used FROM u QUALIFY row_number() OVER (ORDER BY used DESC, prompt_set) = 1")
def active_prompt_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set whose prompts were answered last."""
    sets = table(spark, sf_dir, "engine_prompt").select("prompt", "prompt_set").distinct()
    used = table(spark, sf_dir, "engine_answer").select("prompt", "answered_at").join(sets, "prompt").groupBy("prompt_set").agg(F.max("answered_at").alias("used"))
    return M.top(used, 1, F.desc("used"), F.asc("prompt_set")).select("prompt_set", F.date_format("used", "yyyy-MM-dd").alias("last_used"))


@REG.add("prompts_listed", "SELECT prompt_set, prompt, min(text) AS text FROM engine_prompt GROUP BY prompt_set, prompt")
def prompts_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "engine_prompt").groupBy("prompt_set", "prompt").agg(F.min("text").alias("text"))


@REG.add("entities_listed", "WITH e AS (SELECT id, version, max(coalesce(len(variants), 0))::INT AS variants, max(coalesce(len(exclusions), 0))::INT AS exclusions, bool_or(is_own) AS own FROM brand_entity GROUP BY id, version) SELECT id, version, variants, exclusions, own FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1")
def entities_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each definition."""
    size = F.greatest(F.size("variants"), F.lit(0)), F.greatest(F.size("exclusions"), F.lit(0))
    e = table(spark, sf_dir, "brand_entity").groupBy("id", "version").agg(F.max(F.coalesce(size[0], F.lit(0))).alias("variants"), F.max(F.coalesce(size[1], F.lit(0))).alias("exclusions"), F.bool_or("is_own").alias("own"))
    return M.last_wins(e, ["id"], "version", ["version", "variants", "exclusions", "own"])


@REG.add("crawl_pages_listed", f"WITH {_ONE} SELECT run, url, depth, status::INT AS status, duration_ms, json_extract_string(j, '$.title') AS title FROM v WHERE j IS NOT NULL")
def crawl_pages_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their facts; pages without facts are not listed."""
    return records(spark, sf_dir).where("j is not null").select("run", "url", "depth", "status", "duration_ms", "j.title")


@REG.add("page_links_listed", f"WITH {_ONE}, l AS (SELECT run, url, unnest(json_extract(j, '$.links[*]')) AS l FROM v WHERE j IS NOT NULL) SELECT run, url, json_extract_string(l, '$.href') AS href, json_extract_string(l, '$.anchorText') AS anchor, count(*) AS n FROM l GROUP BY ALL")
def page_links_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = records(spark, sf_dir).where("j is not null").select("run", "url", F.explode("j.links").alias("l"))
    return l.groupBy("run", "url", F.col("l.href").alias("href"), F.col("l.anchorText").alias("anchor")).agg(F.count("*").alias("n"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^www\\.', '')"


@REG.add("host_top5", f"WITH {_ANSWERS}, u AS (SELECT run, unnest(list_distinct(grounding)) AS url FROM a), h AS (SELECT run, {_HOST} AS host, count(*) AS n FROM u WHERE url <> '' GROUP BY ALL) SELECT run, host, n, row_number() OVER (PARTITION BY run ORDER BY n DESC, host)::INT AS rank FROM h QUALIFY rank <= 5")
def host_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five hosts that each run names most."""
    a = table(spark, sf_dir, "engine_answer").select("run", "prompt", "run_index", "text", "refusal", "fetch_error", "grounding").distinct()
    h = A.grounding_citations(a).groupBy("run", "host").agg(F.count("*").alias("n"))
    return M.top_per_key(h, ["run"], 5, F.desc("n"), F.asc("host"))


#: The host whose citations are ours in the query below: the first in order of what the answers name.
_OWN = f"WITH {_ANSWERS}, u AS (SELECT run, prompt, run_index, unnest(list_distinct(grounding)) AS url FROM good), h AS (SELECT run, prompt, run_index, {_HOST} AS host FROM u WHERE url <> ''), own AS (SELECT min(host) AS host FROM h)"


@REG.add("our_citation_rate", _OWN + ", t AS (SELECT run, count(*) AS trials FROM good GROUP BY run), k AS (SELECT run, count(DISTINCT (prompt, run_index)) AS hits FROM h JOIN own USING (host) GROUP BY run) SELECT run, coalesce(hits, 0) AS hits, trials, round(coalesce(hits, 0) / trials, 9) AS rate FROM t LEFT JOIN k USING (run)")
def our_citation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each run's answers that name a page of one host."""
    good = _good(spark, sf_dir)
    own = A.grounding_citations(good).agg(F.min("host").alias("own"))  # one row
    with_own = good.crossJoin(F.broadcast(own))
    hit = F.exists(F.coalesce("grounding", F.array().cast("array<string>")), lambda u: F.coalesce(U.citation_host(u) == F.col("own"), F.lit(False)))
    return A.proportions(with_own, ["run"], hit).select("run", "hits", "trials", F.round("rate", 9).alias("rate"))


@REG.add(
    "prompt_own_and_others",
    f"""WITH {_ANSWERS}, clean AS (SELECT prompt, regexp_replace(text, '(?i)el almacén sea barato', '', 'g') AS text FROM good),
    m AS (SELECT prompt, {_mention_sql(['warehouse', 'magazyn', 'das Lager', 'almacén'])} AS o, {_mention_sql(['second tester', 'druga testerka', 'zweite Prüferin', 'segunda probadora', 'neighbour', 'sąsiad', 'Nachbar', 'vecino'])} AS x FROM clean)
    SELECT prompt, count(*) AS trials, count(*) FILTER (o) AS own, count(*) FILTER (x) AS others FROM m GROUP BY prompt""",
)
def prompt_own_and_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each prompt the answers that mention our entity, and those that mention another."""
    return A.own_and_others(mentions(spark, sf_dir), _good(spark, sf_dir), ["warehouse"])


# --- samples -------------------------------------------------------------------------------------------------------


@REG.add(
    "render_sample",
    f"""WITH {_ONE}, s AS (SELECT run, url, depth, CASE WHEN (json_extract(j, '$.scriptCount'))::INT = 0 THEN 0.0 ELSE 1 - least(1.0, length(json_extract_string(j, '$.text')) / nullif(bytes, 0)) END AS s FROM v WHERE j IS NOT NULL)
    SELECT run, url, row_number() OVER (PARTITION BY run ORDER BY (coalesce(depth = 0, FALSE)) DESC, CASE WHEN coalesce(depth = 0, FALSE) THEN NULL ELSE s END DESC NULLS LAST, url)::INT AS nth FROM s QUALIFY nth <= 20""",
)
def render_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each run that most likely need rendering."""
    r = records(spark, sf_dir).where("j is not null")
    ratio = F.length("j.text") / F.nullif(F.col("bytes"), F.lit(0))
    return CR.sample(r, 20, CR.suspicion(F.col("j.scriptCount"), ratio), ["run"]).select("run", "url", "nth")


@REG.add(
    "speed_sample",
    f"""WITH {_EDGES}, g AS (SELECT n.run, n.url, count(e.src) AS k FROM n LEFT JOIN e ON e.run = n.run AND e.dst = n.url GROUP BY ALL), d AS (SELECT run, url, min(depth) AS depth FROM crawl_page WHERE url IS NOT NULL GROUP BY ALL)
    SELECT run, url, row_number() OVER (PARTITION BY run ORDER BY (coalesce(depth = 0, FALSE)) DESC, CASE WHEN coalesce(depth = 0, FALSE) THEN NULL ELSE k END DESC NULLS LAST, url)::INT AS nth FROM g JOIN d USING (run, url) QUALIFY nth <= 10""",
)
def speed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each run whose speed is measured first: those with most inbound links."""
    d = table(spark, sf_dir, "crawl_page").where("url is not null").groupBy("run", "url").agg(F.min("depth").alias("depth"))
    return CR.sample(link_graph_degrees(spark, sf_dir).join(d, ["run", "url"]), 10, F.col("in_degree"), ["run"]).select("run", "url", "nth")


@REG.add("noindex_reasons", f"WITH {_ONE} SELECT run, CASE WHEN status IS NULL THEN 'no answer' WHEN status >= 400 THEN 'status ' || status::VARCHAR WHEN j IS NULL THEN 'not HTML' END AS reason, count(*) AS n FROM v GROUP BY ALL")
def noindex_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    reason = CR.noindex_reason(F.col("status"), F.col("j").isNotNull(), F.lit(False))
    return r.groupBy("run", reason.alias("reason")).agg(F.count("*").alias("n"))


@REG.add("crawl_starts", "WITH s AS (SELECT DISTINCT site FROM crawl_page), u AS (SELECT site, CASE WHEN site LIKE 'sc-domain:%' THEN 'https://' || site[11:] || '/' WHEN site LIKE '%/' THEN site ELSE site || '/' END AS start FROM s) SELECT site, start, start || 'sitemap.xml' AS sitemap FROM u")
def crawl_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "crawl_page").select("site").distinct().withColumn("start", U.crawl_start(F.col("site")))
    return s.withColumn("sitemap", CR.default_sitemaps(F.col("start"))[0])


@REG.add("comparison_seeds", "WITH r AS (SELECT DISTINCT run FROM engine_answer), p AS (SELECT run, lag(run) OVER (ORDER BY run) AS before FROM r) SELECT before, run, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(before || '|' || run, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS seed FROM p WHERE before IS NOT NULL")
def comparison_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed of the comparison of each run with the one before."""
    from pyspark.sql import Window

    r = table(spark, sf_dir, "engine_answer").select("run").distinct()  # runs are few: they are names of measurements
    p = r.withColumn("before", F.lag("run").over(Window.orderBy("run"))).where("before is not null")
    return p.select("before", "run", S.seed_for(F.col("before"), F.col("run")).alias("seed"))


# --- report frames -------------------------------------------------------------------------------------------------


@REG.add(
    "metrics_report",
    f"""WITH {_LATEST}, r AS (SELECT * FROM latest WHERE date BETWEEN DATE '2025-02-01' AND DATE '2025-03-31'), k AS (SELECT sum(clicks)::DOUBLE AS c, sum(impressions)::DOUBLE AS i, sum(clicks) FILTER (page IS NULL)::DOUBLE AS h FROM r),
    d AS (SELECT strftime(date, '%Y-%m-%d') AS name, sum(clicks)::DOUBLE AS value FROM r GROUP BY ALL), t AS (SELECT page AS name, sum(clicks)::DOUBLE AS value FROM r WHERE page IS NOT NULL GROUP BY page ORDER BY value DESC, page LIMIT 10)
    SELECT 'totals' AS section, 'clicks' AS name, c AS value FROM k UNION ALL SELECT 'totals', 'impressions', i FROM k UNION ALL SELECT 'totals', 'ctr', round(c / nullif(i, 0), 9) FROM k UNION ALL SELECT 'totals', 'hidden', coalesce(h, 0) FROM k
    UNION ALL SELECT 'clicks by day', * FROM d UNION ALL SELECT 'top pages', * FROM t""",
)
def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = latest(spark, sf_dir).where(F.col("date").between(F.lit("2025-02-01").cast("date"), F.lit("2025-03-31").cast("date")))
    clicks, shown = F.sum("clicks"), F.sum("impressions")
    k = P.totals(r, "totals", clicks=clicks, impressions=shown, ctr=F.round(clicks / F.nullif(shown, F.lit(0)), 9), hidden=F.coalesce(F.sum(F.when(F.col("page").isNull(), F.col("clicks"))), F.lit(0)))
    days = r.groupBy("date").agg(clicks.alias("v"))
    top = M.top(r.where("page is not null").groupBy("page").agg(clicks.alias("v")), 10, F.desc("v"), F.asc("page"))
    return P.frame(k, P.part(days, "clicks by day", F.date_format("date", "yyyy-MM-dd"), F.col("v")), P.part(top, "top pages", F.col("page"), F.col("v")))


@REG.add(
    "answer_report",
    f"""WITH {_ANSWERS}, u AS (SELECT unnest(list_distinct(grounding)) AS url FROM a), h AS (SELECT {_HOST} AS name, count(*)::DOUBLE AS value FROM u WHERE url <> '' GROUP BY ALL ORDER BY value DESC, name LIMIT 5)
    SELECT 'totals' AS section, 'answers' AS name, count(*)::DOUBLE AS value FROM a UNION ALL SELECT 'totals', 'usable', count(*)::DOUBLE FROM good UNION ALL SELECT 'totals', 'refusals', count(*)::DOUBLE FROM a WHERE refusal IS NOT NULL UNION ALL SELECT 'totals', 'errors', count(*)::DOUBLE FROM a WHERE fetch_error IS NOT NULL
    UNION ALL SELECT 'with sources by run', run, round(count(*) FILTER (len(grounding) > 0) / count(*), 9) FROM good GROUP BY run UNION ALL SELECT 'top hosts', * FROM h""",
)
def answer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "engine_answer").select("run", "prompt", "run_index", "text", "refusal", "fetch_error", "grounding").distinct()
    good = _good(spark, sf_dir)
    k = P.totals(a, "totals", answers=F.count("*"), refusals=F.count("refusal"), errors=F.count("fetch_error"))
    rates = A.proportions(good, ["run"], F.size("grounding") > 0)
    hosts = M.top(A.grounding_citations(a).groupBy("host").agg(F.count("*").alias("n")), 5, F.desc("n"), F.asc("host"))
    return P.frame(k, P.totals(good, "totals", usable=F.count("*")), P.part(rates, "with sources by run", F.col("run"), F.round("rate", 9)), P.part(hosts, "top hosts", F.col("host"), F.col("n")))


@REG.add(
    "audit_report",
    f"""WITH {_EDGES}, s AS (SELECT DISTINCT run, url, status FROM crawl_page), d AS (SELECT DISTINCT run, url, depth FROM crawl_page WHERE url IS NOT NULL ORDER BY depth DESC, run, url LIMIT 15)
    SELECT 'tiles' AS section, 'pages' AS name, count(*)::DOUBLE AS value FROM n UNION ALL SELECT 'tiles', 'links', count(*)::DOUBLE FROM e UNION ALL SELECT 'status', coalesce(status::INT::VARCHAR, 'none'), count(*)::DOUBLE FROM s GROUP BY status
    UNION ALL SELECT 'deepest', run || ' ' || url, depth::DOUBLE FROM d""",
)
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "crawl_page")
    status = c.select("run", "url", "status").distinct().groupBy("status").agg(F.count("*").alias("n"))
    deep = M.top(c.where("url is not null").select("run", "url", "depth").distinct(), 15, F.desc("depth"), F.asc("run"), F.asc("url"))
    return P.frame(
        P.totals(crawl_nodes(spark, sf_dir), "tiles", pages=F.count("*")), P.totals(crawl_links(spark, sf_dir), "tiles", links=F.count("*")),
        P.part(status, "status", F.coalesce(F.col("status").cast("string"), F.lit("none")), F.col("n")), P.part(deep, "deepest", F.concat_ws(" ", "run", "url"), F.col("depth")),
    )
