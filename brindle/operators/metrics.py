"""Relational operators on daily performance rows and run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(df: DataFrame, tenant: str) -> DataFrame:
    """Rows of one tenant only; the predicate reaches the scan."""
    return df.where(F.col("tenant") == tenant)


def last_wins(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """One row for each key: the values of the highest ``order``. A combinable aggregate, so hot keys shrink map-side;
    rows that tie give the largest values."""
    return df.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_o"), *values)).alias("_m")).select(*keys, *(F.col(f"_m.{v}").alias(v) for v in values))


def first_wins(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """As ``last_wins`` with the lowest ``order``."""
    return df.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("_o"), *values)).alias("_m")).select(*keys, *(F.col(f"_m.{v}").alias(v) for v in values))


def final_rows(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Final rows of a closed range of days."""
    out = df.where(F.col("state") == "final")
    return out.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))) if start and end else out


def weighted_position() -> Column:
    """Mean position weighted by impressions; 0 without impressions. Rows without a position weigh nothing."""
    w = F.sum(F.when(F.col("position").isNotNull(), F.col("impressions")))
    return F.coalesce(F.sum(F.col("position") * F.col("impressions")) / F.nullif(w, F.lit(0)), F.lit(0.0))


def by_page(df: DataFrame, keys: Sequence[str] = ("site", "page")) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.coalesce("clicks", F.lit(0))).alias("clicks"), F.sum("impressions").alias("impressions"), F.round(weighted_position(), 6).alias("position"))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows; Spark plans it without a full sort."""
    return df.orderBy(*order).limit(k)


def top_per_key(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key, cut before the shuffle where Spark can."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def reconciled(daily: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals against the sum of their parts: ``clicks, known, hidden, broken``; a sum above its total is broken."""
    p = parts.groupBy(*keys).agg(F.sum("clicks").alias("known"))
    on = daily.join(p, list(keys), "left")
    hidden = F.col("clicks") - F.coalesce("known", F.lit(0))
    return on.select(*keys, "clicks", F.coalesce("known", F.lit(0)).alias("known"), hidden.alias("hidden"), (hidden < 0).alias("broken"))


def trailing_counts(df: DataFrame, keys: Sequence[str], at: str, now: Column) -> DataFrame:
    """Rows of the last day and the last 30 days before ``now``."""
    t = F.col(at)
    return df.groupBy(*keys).agg(
        F.count(F.when((t > now - F.expr("INTERVAL 1 DAY")) & (t <= now), 1)).alias("day"), F.count(F.when((t > now - F.expr("INTERVAL 30 DAY")) & (t <= now), 1)).alias("month")
    )


def latest_two(df: DataFrame, keys: Sequence[str], run: str, at: str) -> DataFrame:
    """The latest and the previous run of each key."""
    runs = df.groupBy(*keys, run).agg(F.max(at).alias("at"))
    w = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc(run))
    return runs.withColumn("nth", F.row_number().over(w)).where("nth <= 2")
