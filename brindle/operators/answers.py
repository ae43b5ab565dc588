"""Answer-visibility operators: mentions, citations, proportions per prompt and comparisons of measurements."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import stats as S
from brindle.functions.text import normalize_answer
from brindle.functions.urls import citation_host, trim_url_tail
from brindle.session import cut

#: Most entity definitions that are matched at once: they are sent to every task.
MAX_ENTITIES = 10_000

MENTIONS = "array<struct<entity:string,matched:string,start:int,end:int,position_share:double,paragraph:int>>"


def _phrases(names: list[str]) -> re.Pattern | None:
    """All phrases as one pattern with word edges that know every alphabet; blanks inside match any white space."""
    parts = [re.sub(r"(?:\\ )+|\s+", r"\\s+", re.escape(n.strip())) for n in names if n and n.strip()]
    return re.compile(r"(?<![^\W])(?:" + "|".join(sorted(set(parts), key=len, reverse=True)) + r")(?![^\W])", re.I) if parts else None


def _ranges(text: str, names: list[str]) -> list[tuple[int, int, str]]:
    out = []
    for n in names:
        p = _phrases([n])
        if p:
            out += [(m.start(), m.end(), m.group(0)) for m in p.finditer(text)]
    return sorted(out)


def detect(text: str | None, entities: list[dict]) -> list[dict]:
    """Mentions of the entities in a normalised answer. A hit inside an exclusion doesn't count; hits of one entity that
    start at one place count once."""
    if not text:
        return []
    starts = [0, *(m.start() + 2 for m in re.finditer(r"\n\n", text))]
    found = []
    for e in entities:
        whole = e.get("pattern")
        if whole is not None and not whole.search(text):
            continue
        apart = _ranges(text, e["exclusions"])
        seen = set()
        for a, b, hit in _ranges(text, [e["name"], *e["variants"]]):
            if a in seen or any(x <= a and b <= y for x, y, _ in apart):
                continue
            seen.add(a)
            found.append({"entity": e["id"], "matched": hit, "start": a, "end": b, "position_share": a / len(text), "paragraph": sum(s <= a for s in starts) - 1})
    return sorted(found, key=lambda m: m["start"])


def entity_list(entities: DataFrame) -> list[dict]:
    """Definitions ``id, name, variants, exclusions`` for ``mentions``; more than ``MAX_ENTITIES`` are refused."""
    rows = entities.select("id", "name", "variants", "exclusions").limit(MAX_ENTITIES + 1).collect()
    if len(rows) > MAX_ENTITIES:
        raise ValueError(f"more than {MAX_ENTITIES} entity definitions: match them in parts")
    return [{"id": r["id"], "name": r["name"] or "", "variants": list(r["variants"] or []), "exclusions": list(r["exclusions"] or [])} for r in rows]


def mentions(answers: DataFrame, entities: list[dict], text: str = "text") -> DataFrame:
    """One row for each mention: the columns of ``answers`` without its text, and those of ``MENTIONS``."""

    @F.pandas_udf(MENTIONS)
    def run(s: pd.Series) -> pd.Series:
        known = [{**e, "pattern": _phrases([e["name"], *e["variants"]])} for e in entities]
        return s.map(lambda t: detect(t, known))

    return answers.withColumn("m", F.explode(run(normalize_answer(F.coalesce(text, F.lit("")))))).drop(text).select("*", "m.*").drop("m")


_TOKEN = r"([\p{L}\p{N}_]+)"
_FOUND = "run string, prompt string, run_index int, phrase string, matched string, start int, end int, position_share double, paragraph int"


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All places of a phrase in a text, with word edges."""
    patterns: dict[str, re.Pattern | None] = {}
    for b in batches:
        out = []
        for run, prompt, index, text, phrase in zip(*(c.to_pylist() for c in b.columns)):
            if phrase not in patterns:
                if len(patterns) > 50_000:
                    patterns.clear()
                patterns[phrase] = _phrases([phrase])
            p = patterns[phrase]
            starts = None
            for m in p.finditer(text) if p else ():
                starts = starts or [0, *(x.start() + 2 for x in re.finditer(r"\n\n", text))]
                out.append((run, prompt, index, phrase, m.group(0), m.start(), m.end(), m.start() / len(text), sum(s <= m.start() for s in starts) - 1))
        cols = list(zip(*out)) if out else [[]] * 9
        types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["run", "prompt", "run_index", "phrase", "matched", "start", "end", "position_share", "paragraph"])


def mentions_of(answers: DataFrame, definitions: DataFrame) -> DataFrame:
    """As ``mentions`` for any number of definitions ``id, name, variants, exclusions`` (a table): answers and phrases meet by a join
    on the longest word of a phrase, only the texts of answers that hold it are looked at, and each phrase is located once however
    many definitions share it. ``answers``: ``run, prompt, run_index, text``. Defined cases: null and blank phrases are none; a
    phrase without a letter or number matches nothing; null texts have no mentions."""
    a = answers.select("run", "prompt", "run_index", normalize_answer(F.col("text")).alias("text")).where("text <> ''").distinct()
    a = cut(a.withColumn("aid", F.xxhash64("run", "prompt", "run_index", "text")), "answers")
    none = F.array().cast("array<string>")
    all_ = F.concat(F.transform(F.concat(F.array("name"), F.coalesce("variants", none)), lambda x: F.struct(x.alias("phrase"), F.lit(False).alias("apart"))), F.transform(F.coalesce("exclusions", none), lambda x: F.struct(x.alias("phrase"), F.lit(True).alias("apart"))))
    of = definitions.where(F.col("id").isNotNull()).select(F.col("id").alias("entity"), F.explode(all_).alias("p")).select("entity", F.trim("p.phrase").alias("phrase"), "p.apart").where("phrase is not null and phrase <> ''").distinct()
    words = F.regexp_extract_all(F.lower("phrase"), F.lit(_TOKEN), 1)
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    of = cut(of, "phrases")
    anchors = of.select("phrase").distinct().withColumn("tok", longest).where("tok is not null")
    tokens = a.select("aid", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), 1))).alias("tok"))
    met = cut(tokens.join(anchors, "tok").select("aid", "phrase").distinct(), "met")
    places = cut(a.join(met, "aid").select("run", "prompt", "run_index", "text", "phrase").mapInArrow(_located, _FOUND), "places")
    keys = ["run", "prompt", "run_index"]
    hits = places.join(of.where("not apart").select("phrase", "entity"), "phrase")
    apart = places.join(of.where("apart").select("phrase", "entity"), "phrase").select(*keys, "entity", F.col("start").alias("from"), F.col("end").alias("to"))
    h, x = hits.alias("h"), apart.alias("x")
    inside = [F.col(f"h.{k}").eqNullSafe(F.col(f"x.{k}")) for k in (*keys, "entity")] + [F.col("x.from") <= F.col("h.start"), F.col("h.end") <= F.col("x.to")]
    kept = h.join(x, inside, "left_anti")
    first = kept.groupBy(*keys, "entity", "start").agg(F.min(F.struct("end", "matched", "position_share", "paragraph")).alias("m"))
    return first.select(*keys, "entity", "m.matched", "start", "m.end", "m.position_share", "m.paragraph")


def answered(answers: DataFrame) -> DataFrame:
    """Successful answers: a text, no refusal and no fetch error."""
    return answers.where(F.col("text").isNotNull() & (F.trim("text") != "") & F.col("refusal").isNull() & F.col("fetch_error").isNull())


def distinct_answers(answers: DataFrame) -> DataFrame:
    """One row for each run, prompt and run index."""
    return answers.groupBy("run", "prompt", "run_index").agg(F.max(F.struct("text", "refusal", "fetch_error", "grounding", "latency_ms")).alias("a")).select("run", "prompt", "run_index", "a.*")


def proportions(df: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """``hits, trials, rate, low, high`` for each key."""
    g = df.groupBy(*keys).agg(F.count_if(hit).alias("hits"), F.count("*").alias("trials"))
    low, high = S.wilson("hits", "trials")
    return g.withColumns({"rate": S.rate("hits", "trials"), "low": low, "high": high})


def share_of_voice(found: DataFrame) -> DataFrame:
    """For each entity the answers that mention it, its share of all such answers over entities, and the exact median of
    its first position. ``found``: run, prompt, run_index, entity, position_share."""
    first = found.groupBy("run", "prompt", "run_index", "entity").agg(F.min("position_share").alias("first"))
    per = first.groupBy("entity").agg(F.count("*").alias("answers"), F.median("first").alias("median_first"))
    return per.withColumn("share", F.col("answers") / F.sum("answers").over(Window.partitionBy()))


def inline_citations(answers: DataFrame) -> DataFrame:
    """Distinct addresses in each text, without trailing punctuation: ``run, prompt, run_index, url, host``."""
    urls = F.regexp_extract_all(normalize_answer(F.coalesce("text", F.lit(""))), F.lit("(?i)(https?://[^\\s<>\"'`]+)"), 1)
    u = answers.select("run", "prompt", "run_index", F.explode(F.array_distinct(urls)).alias("raw")).withColumn("url", trim_url_tail(F.col("raw")))
    return u.where("url <> ''").select("run", "prompt", "run_index", "url", citation_host(F.col("url")).alias("host")).distinct()


def grounding_citations(answers: DataFrame) -> DataFrame:
    """Addresses an engine names as sources; kept apart from those in the text."""
    u = answers.select("run", "prompt", "run_index", F.explode(F.array_distinct("grounding")).alias("url")).where("url is not null and url <> ''")
    return u.select("*", citation_host(F.col("url")).alias("host"))


def compared(before: DataFrame, after: DataFrame, seed: int, resamples: int, contexts: tuple[dict, dict] | None = None) -> DataFrame:
    """Two measurements ``prompt, hits, trials`` as one row: ``kind`` is ``compared`` or a refusal without numbers: another
    engine, model or access (``context``), another version of the entity (``entity-version``), no prompts (``empty``), or
    other prompts (``composition``). ``contexts``: ``engine, model, access, entity_version`` and ``prompt_set`` of each."""
    j = before.select("prompt", F.col("hits").alias("h0"), F.col("trials").alias("n0")).join(after.select("prompt", F.col("hits").alias("h1"), F.col("trials").alias("n1")), "prompt", "full")
    s = j.agg(F.count("n0").alias("a"), F.count("n1").alias("b"), F.count("*").alias("all"), F.least(F.min("n0"), F.min("n1")).alias("runs"))
    both = j.where("n0 is not null and n1 is not null").select("prompt", (F.col("h1") / F.col("n1") - F.col("h0") / F.col("n0")).alias("difference"))
    from brindle.operators.effects import paired

    x, y = contexts or ({}, {})
    differ = {k: any(x.get(c) != y.get(c) for c in cols) for k, cols in {"context": ("engine", "model", "access"), "entity": ("entity_version",), "set": ("prompt_set",)}.items()}
    kind = F.when(F.lit(differ["context"]), "context").when(F.lit(differ["entity"]), "entity-version").when((F.col("a") == 0) | (F.col("b") == 0), "empty")
    kind = kind.when(F.lit(differ["set"]) | (F.col("a") != F.col("all")) | (F.col("b") != F.col("all")), "composition").otherwise("compared")
    p = paired(both, "prompt", "difference", seed, resamples)
    out = s.crossJoin(p).withColumn("kind", kind).withColumn("resolution", S.detectable_difference("pairs", "runs"))
    ok = F.col("kind") == "compared"
    significant = (((F.col("low") > 0) | (F.col("high") < 0)) & (F.abs("mean") >= F.col("resolution"))) & (F.col("pairs") > 1)
    return out.select("kind", *(F.when(ok, F.col(c)).alias(c) for c in ("pairs", "mean", "low", "high", "resolution")), F.when(ok, significant).alias("significant"))


def citation_rate(answers: DataFrame, own_host: str, keys: list[str]) -> DataFrame:
    """The share of answers that name a source on the given host (``www.`` aside), with its interval, for each key."""
    own = F.exists(F.coalesce("grounding", F.array().cast("array<string>")), lambda u: F.coalesce(citation_host(u) == own_host, F.lit(False)))
    return proportions(answers, keys, own)


def own_and_others(found: DataFrame, answers: DataFrame, own: list[str]) -> DataFrame:
    """``prompt, trials, own, others``: for each prompt the answers, those that mention one of our entities, and those that mention
    another one. ``found``: mentions with ``run, prompt, run_index, entity``."""
    ours = F.col("entity").isin(*own)
    per = found.groupBy("run", "prompt", "run_index").agg(F.max(ours.cast("int")).alias("o"), F.max((~ours).cast("int")).alias("x"))
    return answers.select("run", "prompt", "run_index").join(per, ["run", "prompt", "run_index"], "left").groupBy("prompt").agg(F.count("*").alias("trials"), F.coalesce(F.sum("o"), F.lit(0)).alias("own"), F.coalesce(F.sum("x"), F.lit(0)).alias("others"))
