"""Problem 2: rolling totals of page clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.rolling import latest_daily, trailing_totals
from brindle.plans import Registry
from brindle.sources import table

REG = Registry()

_TOTALS_SQL = """
WITH latest AS (
  SELECT site, page, date AS day, coalesce(arg_max(coalesce(clicks, 0), seq), 0) AS clicks
  FROM gsc_page_daily WHERE state = 'final' AND page IS NOT NULL GROUP BY ALL),
span AS (SELECT site, page, min(day) AS a, max(day) AS b FROM latest GROUP BY ALL),
days AS (SELECT site, page, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM span),
filled AS (
  SELECT d.site, d.page, d.day, coalesce(l.clicks, 0)::BIGINT AS clicks
  FROM days d LEFT JOIN latest l ON d.page = l.page AND d.day = l.day AND d.site IS NOT DISTINCT FROM l.site),
t AS (
  SELECT site, page, day, clicks,
    sum(clicks) OVER (PARTITION BY site, page ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS total_7,
    sum(clicks) OVER (PARTITION BY site, page ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)::BIGINT AS total_30
  FROM filled)
"""


def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = table(spark, sf_dir, "gsc_page_daily").where((F.col("state") == "final") & F.col("page").isNotNull())
    daily = latest_daily(final, ["site", "page"], "date", "clicks", "seq")
    return trailing_totals(daily, ["site", "page"], [7, 30])


@REG.add(
    "p2_rolling",
    _TOTALS_SQL + "SELECT site, page, strftime(day, '%Y-%m-%d') AS day, clicks, total_7, total_7 / 7.0::DOUBLE AS avg_7, total_30, total_30 / 30.0::DOUBLE AS avg_30 FROM t",
)
def p2_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and average of clicks over the trailing 7 and 30 days, for each page and day."""
    t = page_totals(spark, sf_dir)
    return t.select("site", "page", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("value").alias("clicks"), "total_7", "avg_7", "total_30", "avg_30")


@REG.add("p2_found", _TOTALS_SQL + "SELECT DISTINCT site, page, strftime(day, '%Y-%m-%d') AS day FROM t WHERE total_7 = 0 AND total_30 > 0")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with no clicks over 7 days and some over 30."""
    t = page_totals(spark, sf_dir)
    return t.where((F.col("total_7") == 0) & (F.col("total_30") > 0)).select("site", "page", F.date_format("day", "yyyy-MM-dd").alias("day"))
