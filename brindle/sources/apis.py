"""Rows of JSON answers of the reporting services: performance rows, page-speed measurements, engine answers.

The services themselves are outside; their saved answers are read with an explicit schema, many files as one table. A
row that lacks an expected key fails with the name of the missing dimension instead of shifting its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERFORMANCE = "rows array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>"
#: Measured fields: lab audits by id, and field metrics.
SPEED = """lighthouseResult struct<audits:map<string,struct<numericValue:double>>,categories:struct<performance:struct<score:double>>>,
loadingExperience struct<metrics:map<string,struct<percentile:double>>>, id string"""


def performance_rows(spark: SparkSession, path: str, dimensions: list[str]) -> DataFrame:
    """``dimensions`` (``date``, ``query``, ``page``) and ``clicks, impressions, ctr, position``. Files without rows give
    none; a row with fewer keys than dimensions raises an error."""
    raw = spark.read.schema(PERFORMANCE).option("multiLine", True).json(path).select(F.explode("rows").alias("r"))
    keys = F.col("r.keys")
    cols = []
    for i, d in enumerate(dimensions):
        value = F.when(F.coalesce(F.size(keys), F.lit(0)) > i, F.get(keys, F.lit(i))).otherwise(F.raise_error(F.lit(f"a row has no key for the dimension {d}")).cast("string"))
        cols.append((F.to_date(value) if d == "date" else value).alias(d))
    return raw.select(*cols, F.col("r.clicks").cast("bigint").alias("clicks"), F.col("r.impressions").cast("bigint").alias("impressions"), "r.ctr", "r.position")


def speed_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Two rows for each address: ``lab`` and ``field`` with ``lcp_ms, cls, ttfb_ms, inp_ms, score``."""
    r = spark.read.schema(SPEED).option("multiLine", True).json(path)
    a, m = F.col("lighthouseResult.audits"), F.col("loadingExperience.metrics")
    lab = F.struct(
        F.lit("lab").alias("kind"), a["largest-contentful-paint"]["numericValue"].alias("lcp_ms"), a["cumulative-layout-shift"]["numericValue"].alias("cls"), a["server-response-time"]["numericValue"].alias("ttfb_ms"),
        F.lit(None).cast("double").alias("inp_ms"), F.col("lighthouseResult.categories.performance.score").alias("score"),
    )
    field = F.struct(
        F.lit("field").alias("kind"), m["LARGEST_CONTENTFUL_PAINT_MS"]["percentile"].alias("lcp_ms"), (m["CUMULATIVE_LAYOUT_SHIFT_SCORE"]["percentile"] / 100).alias("cls"), m["EXPERIMENTAL_TIME_TO_FIRST_BYTE"]["percentile"].alias("ttfb_ms"),
        m["INTERACTION_TO_NEXT_PAINT"]["percentile"].alias("inp_ms"), F.lit(None).cast("double").alias("score"),
    )
    return r.select(F.col("id").alias("url"), F.explode(F.array(lab, field)).alias("x")).select("url", "x.*")


def slowest(measured: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` slowest addresses; a field measurement is preferred to a lab one."""
    best = measured.where("lcp_ms is not null").groupBy("url").agg(F.min_by(F.struct("kind", "lcp_ms"), F.when(F.col("kind") == "field", 0).otherwise(1)).alias("m"))
    return best.select("url", "m.kind", "m.lcp_ms").orderBy(F.desc("lcp_ms"), "url").limit(k)


def call_summary(calls: DataFrame) -> DataFrame:
    """Calls by provider and capability: number, quota, cost and failures."""
    return calls.groupBy("provider", "capability").agg(F.count("*").alias("calls"), F.sum("quota").alias("quota"), F.sum("cost_micros").alias("cost_micros"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("failures"))


#: Shapes of saved engine answers: the path of the text, of the reason why there is none, and of the sources.
ENGINES = {
    "candidates": ("$.candidates[0].content.parts[*].text", "$.candidates[0].finishReason", "$.candidates[0].groundingMetadata.groundingChunks[*].web.uri"),
    "choices": ("$.choices[0].message.content", "$.choices[0].finish_reason", "$.citations[*]"),
    "content": ("$.content[*].text", "$.stop_reason", "$.content[*].citations[*].url"),
}
#: Reasons that mean a refusal (fixed values).
REFUSALS = ("SAFETY", "RECITATION", "BLOCKLIST", "PROHIBITED_CONTENT", "SPII", "OTHER", "content_filter", "refusal")


def _texts(body: F.Column, path: str) -> F.Column:
    """The strings at a path that may match one value or many."""
    v = F.get_json_object(body, path)
    many = F.from_json(v, "array<string>", {"mode": "PERMISSIVE"})
    return F.when(v.isNull(), F.array().cast("array<string>")).when(v.startswith("["), F.coalesce(many, F.array(v))).otherwise(F.array(F.regexp_replace(v, '^"|"$', "")))


def engine_answers(df: DataFrame, shape: str, body: str = "body") -> DataFrame:
    """Adds ``text, refusal, fetch_error, grounding`` from raw JSON answers of one shape; a body that doesn't parse is a
    fetch error, not a crash."""
    text, reason, sources = ENGINES[shape]
    b = F.col(body)
    ok = F.expr(f"try_parse_json({body})").isNotNull()
    why = F.get_json_object(b, reason)
    t = F.array_join(_texts(b, text), "\n")
    return df.withColumns({
        "text": F.when(ok, F.nullif(t, F.lit(""))), "refusal": F.when(ok & why.isin(*REFUSALS), why),
        "fetch_error": F.when(b.isNull(), "empty_body").when(~ok, "bad_json"), "grounding": F.when(ok, F.array_distinct(_texts(b, sources))),
    })


def split_draft(text: F.Column) -> tuple[F.Column, F.Column]:
    """Title and body of a draft: its first ``# `` line and the rest."""
    title = F.trim(F.regexp_extract(text, r"(?m)^# +(.+)$", 1))
    return F.nullif(title, F.lit("")), F.regexp_replace(F.regexp_replace(text, r"(?s)\A\s*# [^\n]*\n?", ""), r"^\s+|\s+$", "")
