"""HTML pages as facts: one vectorised Python pass, everything after it is built-in.

``parse_page`` reads a token stream with the implied ends that matter for flat facts (``p``, ``li``, table cells and
such end where the next one begins; raw-text elements hold no tags) and returns one struct. Parse once, write the
result, and prune its nested fields from there.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.urls import resolve

_S, _I, _B, _L, _D = T.StringType(), T.IntegerType(), T.BooleanType(), T.LongType(), T.DoubleType()

#: The share of words that only rendering shows from which content needs scripts (fixed value).
JS_REQUIRED = 0.75


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PAGE_FACTS = _struct(
    title=_S, title_length=_I, title_count=_I, meta_description=_S, meta_description_length=_I,
    meta_robots=_struct(raw=_S, noindex=_B, nofollow=_B, noarchive=_B, nosnippet=_B, max_snippet=_I, max_image_preview=_S),
    canonical_raw=_S, canonical_resolved=_S, canonical_count=_I, meta_refresh=_S, lang=_S, charset=_S, viewport=_S,
    headings=T.ArrayType(_struct(level=_I, text=_S)), h1_count=_I, h1_texts=T.ArrayType(_S), heading_order_jumps=T.ArrayType(T.StructType([T.StructField("from", _I), T.StructField("to", _I)])),
    links=T.ArrayType(_struct(href=_S, resolved=_S, anchor_text=_S, rel=_S, rel_tokens=T.ArrayType(_S), is_internal=_B, wraps_image=_B)),
    images=T.ArrayType(_struct(src=_S, resolved=_S, has_alt=_B, alt=_S, width=_S, height=_S, loading=_S, document_index=_I)),
    json_ld=T.ArrayType(_struct(raw=_S, parse_error=_S, types=T.ArrayType(_S), entities=T.ArrayType(_struct(type=_S, fields=T.ArrayType(_S))))),
    open_graph=T.MapType(_S, _S), twitter_card=T.MapType(_S, _S), hreflang=T.ArrayType(_struct(lang=_S, href=_S, resolved=_S)),
    resources=T.ArrayType(_struct(kind=_S, url=_S, resolved=_S)), text=_S, word_count=_I, text_to_html_ratio=_D, first_paragraph_after_h1=_S,
    script_count=_I, inline_script_count=_I, stylesheet_count=_I, inline_style_count=_I, iframe_count=_I, has_noscript=_B, html_bytes=_L,
)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section select table tbody td textarea tfoot th thead tr ul".split())
_HIDDEN = frozenset("script style noscript template svg canvas head title".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt td th tr".split())
_SPACE = re.compile(r"\s+")


def _clean(s: str) -> str:
    return _SPACE.sub(" ", s).strip()


class _Reader(HTMLParser):
    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.host = base, urlsplit(base or "").netloc.lower()
        self.f: dict = {
            "title_count": 0, "canonical_count": 0, "headings": [], "links": [], "images": [], "json_ld": [], "open_graph": {}, "twitter_card": {}, "hreflang": [], "resources": [],
            "script_count": 0, "inline_script_count": 0, "stylesheet_count": 0, "inline_style_count": 0, "iframe_count": 0, "has_noscript": False,
        }
        self.meta: dict[str, str] = {}
        self.text: list[str] = []
        self.hidden: list[str] = []
        self.heading: tuple[int, list[str]] | None = None
        self.link: dict | None = None
        self.anchor: list[str] = []
        self.para: list[str] | None = None
        self.first_para: str | None = None
        self.seen_h1 = False
        self.raw: tuple[str, dict, list[str]] | None = None

    # -- starts and ends
    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag in _ENDS_P:
            self._end_para()
        if tag in _BLOCK:
            self._say(" ")
        f = self.f
        if tag in _HIDDEN:
            self.hidden.append(tag)
        if tag == "body" and "head" in self.hidden:
            self.hidden.remove("head")
        if tag in ("title", "script", "style"):
            self.raw = (tag, a, [])
        if tag == "html":
            f.setdefault("lang", a.get("lang"))
        elif tag == "title":
            f["title_count"] += 1
        elif tag == "meta":
            self._meta(a)
        elif tag == "link":
            self._link_tag(a)
        elif tag == "noscript":
            f["has_noscript"] = True
        elif tag == "iframe":
            f["iframe_count"] += 1
            self._resource("iframe", a.get("src"))
        elif tag in ("video", "audio", "source"):
            self._resource("media", a.get("src"))
        elif tag == "a" and "href" in a:
            self._end_link()
            tokens = [t.lower() for t in a.get("rel", "").split()]
            to = resolve(a["href"], self.base)
            rel = next((r for r in ("nofollow", "sponsored", "ugc") if r in tokens), "follow")
            self.link = {"href": a["href"], "resolved": to, "rel": rel, "rel_tokens": tokens, "is_internal": bool(to) and urlsplit(to).netloc.lower() == self.host, "wraps_image": False}
            self.anchor = []
        elif tag == "img":
            src = a.get("src")
            f["images"].append({"src": src, "resolved": resolve(src, self.base), "has_alt": "alt" in a, "alt": a.get("alt", ""), "width": a.get("width"), "height": a.get("height"), "loading": a.get("loading"), "document_index": len(f["images"])})
            self._resource("image", src)
            if self.link is not None:
                self.link["wraps_image"] = True
        elif re.fullmatch("h[1-6]", tag):
            self._end_heading()
            self.heading = (int(tag[1]), [])
        elif tag == "p":
            self.para = []

    def handle_endtag(self, tag: str) -> None:
        if self.raw and self.raw[0] == tag:
            self._end_raw()
        if tag in self.hidden:
            while self.hidden and self.hidden.pop() != tag:
                pass
        if tag == "a":
            self._end_link()
        elif re.fullmatch("h[1-6]", tag):
            self._end_heading()
        elif tag == "p" or tag in _ENDS_P:
            self._end_para()
        if tag in _BLOCK:
            self._say(" ")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in ("svg",):
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.raw is not None:
            self.raw[2].append(data)
        if not self.hidden:
            self._say(data)

    def _say(self, s: str) -> None:
        if self.hidden:
            return
        self.text.append(s)
        for part in (self.heading and self.heading[1], self.anchor if self.link is not None else None, self.para):
            if part is not None and part is not False:
                part.append(s)

    def _end_heading(self) -> None:
        if self.heading:
            level, parts = self.heading
            self.heading = None
            self.f["headings"].append({"level": level, "text": _clean("".join(parts))})
            self.seen_h1 |= level == 1

    def _end_link(self) -> None:
        if self.link is not None:
            self.link["anchor_text"] = _clean("".join(self.anchor))
            self.f["links"].append(self.link)
            self.link = None

    def _end_para(self) -> None:
        if self.para is not None:
            s = _clean("".join(self.para))
            if s and self.seen_h1 and self.first_para is None:
                self.first_para = s
            self.para = None

    def _end_raw(self) -> None:
        tag, a, parts = self.raw
        self.raw = None
        body = "".join(parts)
        f = self.f
        if tag == "title":
            f.setdefault("title", _clean(body))
        elif tag == "style":
            f["inline_style_count"] += 1
        elif tag == "script":
            if "ld+json" in a.get("type", "").lower():
                f["json_ld"].append(_json_ld(body))
                return
            f["script_count"] += 1
            if a.get("src"):
                self._resource("script", a["src"])
            else:
                f["inline_script_count"] += 1

    def _resource(self, kind: str, url: str | None) -> None:
        if url:
            self.f["resources"].append({"kind": kind, "url": url, "resolved": resolve(url, self.base)})

    def _meta(self, a: dict[str, str]) -> None:
        name, content = (a.get("name") or a.get("property") or "").strip().lower(), a.get("content", "")
        if "charset" in a:
            self.meta.setdefault("charset", a["charset"].strip())
        equiv = a.get("http-equiv", "").lower()
        if equiv == "content-type" and "charset=" in content.lower():
            self.meta.setdefault("charset", content.lower().split("charset=", 1)[1].strip())
        if equiv == "refresh":
            self.meta.setdefault("refresh", content)
        if name.startswith("og:"):
            self.f["open_graph"].setdefault(name, content)
        elif name.startswith("twitter:"):
            self.f["twitter_card"].setdefault(name, content)
        elif name:
            self.meta.setdefault(name, content)

    def _link_tag(self, a: dict[str, str]) -> None:
        rel, href, f = a.get("rel", "").lower().split(), a.get("href"), self.f
        if "canonical" in rel:
            f["canonical_count"] += 1
            if "canonical_raw" not in f:
                f["canonical_raw"], f["canonical_resolved"] = href, resolve(href, self.base)
        if "stylesheet" in rel:
            f["stylesheet_count"] += 1
            self._resource("stylesheet", href)
        if "preload" in rel or "prefetch" in rel:
            self._resource("preload", href)
        if "alternate" in rel and a.get("hreflang"):
            f["hreflang"].append({"lang": a["hreflang"], "href": href, "resolved": resolve(href, self.base)})

    def done(self) -> None:
        self.close()
        if self.raw is not None:
            self._end_raw()
        self._end_link()
        self._end_heading()
        self._end_para()


def _json_ld(body: str) -> dict:
    try:
        value = json.loads(body)
    except ValueError as e:
        return {"raw": body, "parse_error": str(e), "types": [], "entities": []}
    types: list[str] = []
    entities: list[dict] = []
    stack = [value]
    while stack:
        v = stack.pop(0)
        if isinstance(v, list):
            stack = v + stack
        elif isinstance(v, dict):
            t = v.get("@type")
            for name in [t] if isinstance(t, str) else [x for x in t if isinstance(x, str)] if isinstance(t, list) else []:
                types.append(name)
                entities.append({"type": name, "fields": [k for k, x in v.items() if x not in (None, "", [])]})
            stack = [x for k, x in v.items() if k != "@type"] + stack
    return {"raw": body, "parse_error": None, "types": types, "entities": entities}


def _robots(meta: dict[str, str]) -> dict:
    raw = meta.get("robots", meta.get("googlebot"))
    parts = [p.strip() for p in (raw or "").lower().split(",")]
    value = {p.split(":", 1)[0].strip(): p.split(":", 1)[1].strip() for p in parts if ":" in p}
    none = "none" in parts
    n = value.get("max-snippet", "")
    return {
        "raw": raw, "noindex": none or "noindex" in parts, "nofollow": none or "nofollow" in parts, "noarchive": "noarchive" in parts, "nosnippet": "nosnippet" in parts,
        "max_snippet": int(n) if re.fullmatch(r"-?\d{1,9}", n) else None, "max_image_preview": value.get("max-image-preview"),
    }


def facts_of(source: str | None, url: str | None) -> dict | None:
    """The facts of one page, or None without HTML."""
    if source is None:
        return None
    r = _Reader(url or "")
    r.feed(source)
    r.done()
    f, m = r.f, r.meta
    text = _clean("".join(r.text))
    levels = [h["level"] for h in f["headings"]]
    size = len(source.encode("utf-8", "replace"))
    f |= {
        "title": f.get("title"), "title_length": len(f.get("title") or ""), "meta_description": m.get("description"), "meta_description_length": len(m.get("description") or ""), "meta_robots": _robots(m),
        "canonical_raw": f.get("canonical_raw"), "canonical_resolved": f.get("canonical_resolved"), "meta_refresh": m.get("refresh"), "lang": f.get("lang"), "charset": m.get("charset"), "viewport": m.get("viewport"),
        "h1_count": levels.count(1), "h1_texts": [h["text"] for h in f["headings"] if h["level"] == 1], "heading_order_jumps": [{"from": a, "to": b} for a, b in zip(levels, levels[1:]) if b > a + 1],
        "text": text, "word_count": sum(any(c.isalnum() for c in w) for w in text.split()), "text_to_html_ratio": len(text.encode("utf-8", "replace")) / size if size else 0.0,
        "first_paragraph_after_h1": r.first_para, "html_bytes": size,
    }
    return {k.name: f.get(k.name) for k in PAGE_FACTS}


@F.pandas_udf(PAGE_FACTS)
def parse_page(source: pd.Series, url: pd.Series) -> pd.DataFrame:
    rows = [facts_of(s, u) or dict.fromkeys(PAGE_FACTS.names) for s, u in zip(source, url)]
    return pd.DataFrame(rows, columns=PAGE_FACTS.names)


def parsed(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` with its HTML replaced by the struct ``f`` (null fields where there is no HTML)."""
    return pages.withColumn("f", F.when(F.col(source).isNotNull(), parse_page(source, "url"))).drop(source)


def render_diff(raw: Column, rendered: Column) -> Column:
    """What rendering changes, from the facts before and after."""
    gain = F.when(rendered["word_count"] > 0, F.greatest(F.lit(0.0), 1 - raw["word_count"] / rendered["word_count"])).otherwise(0.0)
    def hrefs(f: Column) -> Column:
        return F.array_distinct(F.array_compact(F.transform(f["links"], lambda x: x["resolved"])))

    return F.struct(
        (~raw["title"].eqNullSafe(rendered["title"])).alias("title_changed"), (~raw["meta_description"].eqNullSafe(rendered["meta_description"])).alias("description_changed"),
        raw["word_count"].alias("raw_words"), rendered["word_count"].alias("rendered_words"), gain.alias("js_ratio"), (gain >= JS_REQUIRED).alias("content_requires_js"),
        F.array_sort(F.array_except(hrefs(rendered), hrefs(raw))).alias("links_only_in_rendered"), F.array_sort(F.array_except(hrefs(raw), hrefs(rendered))).alias("links_only_in_raw"),
    )
