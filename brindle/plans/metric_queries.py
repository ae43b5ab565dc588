"""Queries on daily performance, runs and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import metrics as M
from brindle.plans import Registry
from brindle.sources import table

REG = Registry()

_LATEST = """latest AS (SELECT tenant, site, date, page, max(seq) AS seq, arg_max(coalesce(clicks, 0), seq) AS clicks, arg_max(impressions, seq) AS impressions,
  arg_max(struct_pack(p := position), seq).p AS position FROM gsc_page_daily WHERE state = 'final' GROUP BY ALL)"""


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final rows, the last load of each tenant, site, date and page."""
    g = M.final_rows(table(spark, sf_dir, "gsc_page_daily")).withColumn("clicks", F.coalesce("clicks", F.lit(0)))
    return M.last_wins(g, ["tenant", "site", "date", "page"], "seq", ["clicks", "impressions", "position"])


@REG.add(
    "metrics_daily_range",
    f"""WITH {_LATEST} SELECT tenant, site, strftime(date, '%Y-%m-%d') AS day, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions
    FROM latest WHERE date BETWEEN DATE '2025-02-01' AND DATE '2025-03-31' GROUP BY ALL""",
)
def metrics_daily_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.final_rows(latest(spark, sf_dir).withColumn("state", F.lit("final")), "2025-02-01", "2025-03-31")
    return d.groupBy("tenant", "site", F.date_format("date", "yyyy-MM-dd").alias("day")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))


@REG.add("query_date_range", "SELECT tenant, strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day FROM gsc_page_daily WHERE state = 'final' GROUP BY tenant")
def query_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = M.final_rows(table(spark, sf_dir, "gsc_page_daily"))
    return g.groupBy("tenant").agg(F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_day"))


_PAGES = f"""WITH {_LATEST}, pages AS (SELECT site, page, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions,
  round(coalesce(sum(position * impressions) / nullif(sum(CASE WHEN position IS NOT NULL THEN impressions END), 0), 0.0), 6) AS position FROM latest WHERE page IS NOT NULL GROUP BY ALL)"""


@REG.add("page_metrics_range", _PAGES + " SELECT * FROM pages")
def page_metrics_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.by_page(latest(spark, sf_dir).where("page is not null"))


@REG.add("weighted_position_topk", _PAGES + " SELECT * FROM pages ORDER BY impressions DESC, site, page LIMIT 50")
def weighted_position_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top(page_metrics_range(spark, sf_dir), 50, F.desc("impressions"), F.asc("site"), F.asc("page"))


@REG.add("top_pages", _PAGES + " SELECT site, page, clicks FROM pages ORDER BY clicks DESC, site, page LIMIT 20")
def top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top(page_metrics_range(spark, sf_dir).select("site", "page", "clicks"), 20, F.desc("clicks"), F.asc("site"), F.asc("page"))


@REG.add("top_pages_per_site", _PAGES + " SELECT site, page, clicks, row_number() OVER (PARTITION BY site ORDER BY clicks DESC, page)::INT AS rank FROM pages QUALIFY rank <= 5")
def top_pages_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top_per_key(page_metrics_range(spark, sf_dir).select("site", "page", "clicks"), ["site"], 5, F.desc("clicks"), F.asc("page"))


@REG.add("upsert_last_wins", f"WITH {_LATEST} SELECT tenant, site, strftime(date, '%Y-%m-%d') AS day, page, clicks::BIGINT AS clicks, impressions FROM latest")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).select("tenant", "site", F.date_format("date", "yyyy-MM-dd").alias("day"), "page", "clicks", "impressions")


@REG.add("upsert_first_wins", "SELECT tenant, run, url, min(crawl_id) AS crawl_id FROM crawl_page GROUP BY ALL")
def upsert_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_wins(table(spark, sf_dir, "crawl_page"), ["tenant", "run", "url"], "crawl_id", ["crawl_id"])


@REG.add(
    "reconciliation",
    f"""WITH {_LATEST}, total AS (SELECT tenant, site, date, sum(clicks)::BIGINT AS clicks FROM latest GROUP BY ALL),
    part AS (SELECT tenant, site, date, sum(clicks)::BIGINT AS known FROM latest WHERE page IS NOT NULL GROUP BY ALL)
    SELECT tenant, site, strftime(date, '%Y-%m-%d') AS day, clicks, coalesce(known, 0)::BIGINT AS known, clicks - coalesce(known, 0)::BIGINT AS hidden, clicks < coalesce(known, 0) AS broken
    FROM total LEFT JOIN part USING (tenant, site, date)""",
)
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = latest(spark, sf_dir), ["tenant", "site", "date"]
    # one pass: the total and its known part are two sums of the same groups
    both = rows.groupBy(*keys).agg(F.sum("clicks").alias("clicks"), F.coalesce(F.sum(F.when(F.col("page").isNotNull(), F.col("clicks"))), F.lit(0)).alias("known"))
    hidden = F.col("clicks") - F.col("known")
    return both.select("tenant", "site", F.date_format("date", "yyyy-MM-dd").alias("day"), "clicks", "known", hidden.alias("hidden"), (hidden < 0).alias("broken"))


@REG.add(
    "provider_call_summary",
    """SELECT event_type AS provider, (user_id % 3)::BIGINT AS capability, count(*) AS calls, sum(coalesce(json_extract(props, '$.k')::BIGINT, 0))::BIGINT AS quota, count(*) FILTER (value < 1) AS failures
    FROM events GROUP BY ALL""",
)
def provider_call_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("provider"), (F.col("user_id") % 3).alias("capability")).agg(
        F.count("*").alias("calls"), F.sum(F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))).alias("quota"), F.count_if(F.col("value") < 1).alias("failures")
    )


@REG.add(
    "weekly_clicks",
    f"""WITH {_LATEST}, today AS (SELECT max(date) AS d FROM gsc_page_daily WHERE state = 'final')
    SELECT site, coalesce(sum(clicks) FILTER (date BETWEEN d - 7 AND d), 0)::BIGINT AS this_week, coalesce(sum(clicks) FILTER (date BETWEEN d - 14 AND d - 8), 0)::BIGINT AS last_week
    FROM latest, today GROUP BY site""",
)
def weekly_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 8 days against the 7 before; the windows of the source of these figures differ by one day."""
    g = M.final_rows(table(spark, sf_dir, "gsc_page_daily"))
    today = g.agg(F.max("date").alias("d"))  # one row
    r = latest(spark, sf_dir).crossJoin(F.broadcast(today))
    d = F.col("d")
    return r.groupBy("site").agg(
        F.coalesce(F.sum(F.when(F.col("date").between(F.date_sub(d, 7), d), F.col("clicks"))), F.lit(0)).alias("this_week"),
        F.coalesce(F.sum(F.when(F.col("date").between(F.date_sub(d, 14), F.date_sub(d, 8)), F.col("clicks"))), F.lit(0)).alias("last_week"),
    )


@REG.add(
    "publication_rate",
    """SELECT tenant, count(*) FILTER (extracted_at > TIMESTAMP '2025-05-30' - INTERVAL 1 DAY AND extracted_at <= TIMESTAMP '2025-05-30') AS day,
    count(*) FILTER (extracted_at > TIMESTAMP '2025-05-30' - INTERVAL 30 DAY AND extracted_at <= TIMESTAMP '2025-05-30') AS month FROM existing_page GROUP BY tenant""",
)
def publication_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.trailing_counts(table(spark, sf_dir, "existing_page"), ["tenant"], "extracted_at", F.lit("2025-05-30 00:00:00").cast("timestamp_ntz"))


@REG.add(
    "latest_previous_run",
    """WITH r AS (SELECT tenant, run, max(fetched_at) AS seen FROM crawl_page GROUP BY ALL)
    SELECT tenant, run, strftime(seen, '%Y-%m-%d %H:%M:%S') AS seen, row_number() OVER (PARTITION BY tenant ORDER BY r.seen DESC, run DESC)::INT AS nth FROM r QUALIFY nth <= 2""",
)
def latest_previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.latest_two(table(spark, sf_dir, "crawl_page"), ["tenant"], "run", "fetched_at")
    return r.select("tenant", "run", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("seen"), "nth")


@REG.add(
    "entity_latest_version",
    "SELECT id, max(version)::INT AS version, arg_max(name, version) AS name FROM (SELECT DISTINCT id, version, name FROM brand_entity) GROUP BY id",
)
def entity_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "brand_entity")
    return b.groupBy("id").agg(F.max("version").alias("version"), F.max(F.struct("version", "name"))["name"].alias("name"))


@REG.add(
    "events_hourly",
    """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming aggregate in ``brindle.streaming.events``."""
    from brindle.streaming.events import hourly

    h = hourly(table(spark, sf_dir, "events"))
    return h.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
