"""Crawl operators: robots files, sitemaps, limits and a crawl over a table of pages."""

from __future__ import annotations

import html
import re
from functools import lru_cache
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.urls import normalize, path_with_query, resolve
from brindle.session import cut

#: (default, ceiling, floor) of the limits of a crawl.
LIMITS = {"max_pages": (500, 10_000, 1), "max_depth": (5, 20, 0), "delay_ms": (1000, 60_000, 500), "max_bytes": (5 << 20, 20 << 20, 1024), "max_minutes": (15, 120, 1)}


def clamp_limits(**wanted: int) -> tuple[dict[str, int], list[str]]:
    """Limits within their bounds, and the names of those that were adjusted."""
    out, moved = {}, []
    for name, (default, ceiling, floor) in LIMITS.items():
        v = wanted.get(name, default)
        out[name] = max(floor, min(ceiling, v))
        if out[name] != v:
            moved.append(name)
    return out, moved


def robots_state(status: Column, body: Column) -> Column:
    return F.when(status.isNull() | (status >= 500), "unreachable").when(status.isin(404, 410), "missing").when(status >= 400, "unreachable").when(body.isNull(), "unreachable").otherwise("ok")


def parse_robots(text: str | None) -> dict:
    """``groups`` (agents, allow, disallow, delay) in file order and ``sitemaps``. Consecutive agent lines share a group;
    groups of one agent are not merged."""
    groups: list[dict] = []
    sitemaps: list[str] = []
    fresh = True
    for raw in (text or "").lstrip("﻿").splitlines():
        line = raw.split("#", 1)[0].strip()
        key, sep, value = line.partition(":")
        if not sep:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "sitemap":
            if value:
                sitemaps.append(value)
        elif key == "user-agent":
            if fresh and groups and not (groups[-1]["allow"] or groups[-1]["disallow"] or groups[-1]["delay"] is not None):
                groups[-1]["agents"].append(value.lower())
            else:
                groups.append({"agents": [value.lower()], "allow": [], "disallow": [], "delay": None})
            fresh = True
        elif groups and key in ("allow", "disallow"):
            if value:
                groups[-1][key].append(value)
            fresh = False
        elif groups and key == "crawl-delay":
            try:
                groups[-1]["delay"] = float(value)
            except ValueError:
                pass
            fresh = False
    return {"groups": groups, "sitemaps": sitemaps}


def group_for(rules: dict, agent: str) -> dict | None:
    """The group whose agent is the longest prefix of the product token; the first ``*`` group otherwise."""
    token = agent.split("/")[0].strip().lower()
    named = [(len(a), -i, g) for i, g in enumerate(rules["groups"]) for a in g["agents"] if a != "*" and token.startswith(a)]
    if named:
        return max(named, key=lambda x: x[:2])[2]
    return next((g for g in rules["groups"] if "*" in g["agents"]), None)


@lru_cache(maxsize=10_000)
def _pattern(p: str) -> tuple[int, re.Pattern]:
    body, end = (p[:-1], "$") if p.endswith("$") else (p, "")
    return len(body), re.compile(".*".join(map(re.escape, body.split("*"))) + end)


def allowed(rules: dict, agent: str, path: str) -> bool:
    """The longest matching pattern decides; ``allow`` wins ties; no group or no match allows."""
    g = group_for(rules, agent)
    if g is None:
        return True
    best = {k: max((n for n, p in map(_pattern, g[k]) if p.match(path)), default=-1) for k in ("allow", "disallow")}
    return best["disallow"] == -1 or best["allow"] >= best["disallow"]


def robots_decisions(urls: DataFrame, robots: dict[str, str], agent: str, url: str = "url") -> DataFrame:
    """Adds ``allowed`` to addresses, by the robots text of their host (a small, given table of texts)."""
    rules = {h: parse_robots(t) for h, t in robots.items()}
    star = rules.get("*")

    @F.pandas_udf(T.BooleanType())
    def decide(u: pd.Series, p: pd.Series) -> pd.Series:
        def one(a: str | None, path: str | None) -> bool:
            r = rules.get(urlsplit(a).netloc.lower(), star) if a else star
            return r is None or allowed(r, agent, path or "/")

        return pd.Series([one(a, b) for a, b in zip(u, p)])

    return urls.withColumn("allowed", decide(url, path_with_query(F.col(url))))


_LOC = re.compile(r"<(?:\w+:)?(url|sitemap)\b[^>]*>(.*?)</(?:\w+:)?\1\s*>", re.S | re.I)
_TEXT = {k: re.compile(rf"<(?:\w+:)?{k}\b[^>]*>(.*?)</(?:\w+:)?{k}\s*>", re.S | re.I) for k in ("loc", "lastmod")}
SITEMAP_LIMIT = 50_000


def parse_sitemap(xml: str | None) -> dict:
    """``kind`` (urlset, index or null), ``entries`` (loc, lastmod) and ``problems`` (not-xml, invalid-url, empty, over-limit)."""
    s = xml or ""
    m = re.search(r"<(?:\w+:)?(urlset|sitemapindex)\b", s, re.I)
    if not m:
        return {"kind": None, "entries": [], "problems": ["not-xml"]}
    kind, entries, problems = ("urlset" if m.group(1).lower() == "urlset" else "index"), [], []

    def value(k: str, body: str) -> str | None:
        v = _TEXT[k].search(body)
        return html.unescape(re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", v.group(1), flags=re.S)).strip() if v else None

    for _, body in _LOC.findall(s):
        loc = value("loc", body)
        if loc and normalize(loc):
            entries.append({"loc": loc, "lastmod": value("lastmod", body) or None})
        else:
            problems.append("invalid-url")
    if not entries and not problems:
        problems.append("empty")
    if len(entries) > SITEMAP_LIMIT:
        problems.append("over-limit")
    return {"kind": kind, "entries": entries, "problems": problems}


SITEMAP = T.StructType([T.StructField("kind", T.StringType()), T.StructField("entries", T.ArrayType(T.StructType([T.StructField("loc", T.StringType()), T.StructField("lastmod", T.StringType())]))), T.StructField("problems", T.ArrayType(T.StringType()))])


@F.pandas_udf(SITEMAP)
def sitemap(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_sitemap(x) for x in xml], columns=["kind", "entries", "problems"])


def crawl(pages: DataFrame, links: DataFrame, start: DataFrame, max_depth: int, max_pages: int, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame | bool]:
    """A breadth-first crawl over given pages ``url`` and links ``src, dst`` from ``start`` (url), for each value of ``keys``
    on its own: visited ``url, depth, nth`` in order of depth and address, and whether the page limit cut it
    (for each key, or one truth value without keys). Depth alone never counts as a cut; a crawl that has reached its limit goes no deeper."""
    keys = keys or []
    known = pages.select(*keys, "url").distinct()
    seen = cut(start.select(*keys, "url").distinct().join(known, [*keys, "url"], "left_semi").withColumn("depth", F.lit(0)), "crawl")
    level = seen
    for d in range(1, max_depth + 1):
        full = seen.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= max_pages)
        go = level.join(full, keys, "left_anti") if keys else level.crossJoin(F.broadcast(full.agg(F.count("*").alias("full")))).where("full = 0").drop("full")
        nxt = links.join(go.select(*keys, F.col("url").alias("src")), [*keys, "src"], "left_semi").select(*keys, F.col("dst").alias("url")).distinct()
        level = cut(nxt.join(known, [*keys, "url"], "left_semi").join(seen.select(*keys, "url"), [*keys, "url"], "left_anti").withColumn("depth", F.lit(d)), "crawl")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    w = Window.partitionBy(*keys).orderBy("depth", "url")
    ranked = seen.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= max_pages)
    if not keys:
        return ranked, seen.count() >= max_pages
    return ranked, seen.groupBy(*keys).agg((F.count("*") >= max_pages).alias("cut"))


def sitemap_urls(files: DataFrame, start: DataFrame, most: int = 10) -> DataFrame:
    """``site, loc``: the addresses of each site's sitemaps. ``files``: ``site, url, status, xml`` of what was fetched; ``start``:
    ``site, url`` of the first sitemaps in order ``nth``. Indexes are expanded; at most ``most`` files are read for a site, in
    the order of discovery; one without an answer or with a status from 400 gives nothing."""
    read = files.where("xml is not null and status < 400").select("site", "url", sitemap("xml").alias("s"))
    w = Window.partitionBy("site").orderBy("nth", "url")
    todo = cut(start.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).select("site", "url", F.col("nth").cast("bigint").alias("nth")), "sitemaps")
    done, out = todo, None
    while not todo.isEmpty():
        got = cut(todo.join(read, ["site", "url"]), "sitemaps")
        urls = got.where("s.kind = 'urlset'").select("site", F.explode("s.entries").alias("e")).select("site", F.col("e.loc").alias("loc"))
        out = urls if out is None else out.unionByName(urls)
        found = got.where("s.kind = 'index'").select("site", "nth", F.posexplode("s.entries").alias("i", "e")).groupBy("site", F.col("e.loc").alias("url")).agg(F.min(F.struct("nth", "i")).alias("at"))
        room = done.groupBy("site").agg(F.count("*").alias("used"))
        fresh = found.join(done.select("site", "url"), ["site", "url"], "left_anti").join(room, "site")
        nth = F.row_number().over(Window.partitionBy("site").orderBy("at", "url"))
        todo = cut(fresh.withColumn("k", nth).where(F.col("used") + F.col("k") <= most).select("site", "url", (F.col("used") + F.col("k")).alias("nth")), "sitemaps")
        done = done.unionByName(todo)
    return (out if out is not None else start.select("site", F.col("url").alias("loc")).limit(0)).distinct()


def default_sitemaps(start: Column) -> Column:
    """Where to look when the robots file names no sitemap: the folder of the property, then the root of its host."""
    root = F.regexp_extract(start, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+", 0)
    folder = F.regexp_extract(start, r"^([^?#]*/)", 1)
    return F.array_distinct(F.array(F.concat(folder, F.lit("sitemap.xml")), F.concat(root, F.lit("/sitemap.xml"))))


def effective_delay_ms(limit_ms: Column, robots_delay_s: Column) -> Column:
    """The pause between two requests: the longer of the crawl's own and that of the robots file."""
    return F.greatest(limit_ms, F.coalesce(F.round(robots_delay_s * 1000).cast("bigint"), F.lit(0)))


def suspicion(script_count: Column, text_ratio: Column) -> Column:
    """How likely a page needs rendering: the less text a byte holds where there are scripts; 0 without scripts."""
    return F.when(script_count == 0, 0.0).otherwise(1 - F.least(F.lit(1.0), text_ratio))


def sample(pages: DataFrame, limit: int, by: Column, keys: list[str] | None = None) -> DataFrame:
    """The first ``limit`` pages of each key: home pages (depth 0), then by ``by`` from the largest, then by address. Samples
    of the same pages are the same. ``pages``: ``url, depth`` and what ``by`` needs."""
    home = F.coalesce(F.col("depth") == 0, F.lit(False))
    w = Window.partitionBy(*(keys or [])).orderBy(F.desc(home), F.when(home, F.lit(None)).otherwise(by).desc(), "url")
    return pages.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= max(limit, 0))


def noindex_reason(status: Column, has_facts: Column, noindex: Column) -> Column:
    """Why a page can't be in an index, or null: no answer, an error status, no HTML, or its own robots tag."""
    return F.when(status.isNull(), "no answer").when(status >= 400, F.concat(F.lit("status "), status.cast("string"))).when(~has_facts, "not HTML").when(F.coalesce(noindex, F.lit(False)), "meta robots: noindex")


@F.pandas_udf(T.StringType())
def resolved(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve(h, b) for h, b in zip(href, base)], dtype=object)
