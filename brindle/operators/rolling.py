"""Rolling totals over trailing calendar windows by binary doubling.

``trailing_totals`` makes a gap-free daily series for each entity (one row for each day from its first to its last) and
adds, for each requested window length ``w``, the total and the average over the ``w`` days that end on that day.

Method: block sums of 1, 2, 4, 8, 16, ... days, each the previous block plus the same block shifted by its own length;
a window of any length is the sum of the blocks of its binary digits, each shifted behind the ones before. A window of
30 days thus costs 4 doublings and 4 additions instead of 30. All steps are ``lag`` over one window specification, so
Spark plans one shuffle on the entity key and sorts twice (before and after the gap filling).

Scale: the input is first reduced to one row for each entity and day with a partial (map-side) aggregation, so an
entity with a third of all raw rows still has at most one row a day; the series of an entity is as long as its calendar
span, which doesn't grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_daily(df: DataFrame, keys: Sequence[str], day: str, value: str, order: str) -> DataFrame:
    """One row for each (keys, day): ``value`` of the row with the highest ``order``, null counting as 0.

    Rows that tie on ``order`` (exact duplicates, as a rule) give the largest value; a null ``order`` ranks last. Rows
    with a null day are dropped: they belong to no day.
    """
    v = F.coalesce(F.col(value), F.lit(0)).cast("bigint")
    return (
        df.where(F.col(day).isNotNull())
        .groupBy(*keys, F.col(day).cast("date").alias("day"))
        .agg(F.max(F.struct(F.col(order).alias("o"), v.alias("v")))["v"].alias("value"))
    )


def _windows(days: int) -> list[int]:
    """The binary blocks of a window, largest first: 30 -> [16, 8, 4, 2]."""
    return [1 << b for b in reversed(range(days.bit_length())) if days >> b & 1]


def trailing_totals(daily: DataFrame, keys: Sequence[str], windows: Sequence[int], day: str = "day", value: str = "value") -> DataFrame:
    """``keys``, ``day``, ``value`` and ``total_w``, ``avg_w`` for each window ``w`` (days), for every day of the span.

    ``daily`` has at most one row for each (keys, day). Days without a row count as 0, and so do the days before the
    first. Averages divide by ``w``. Empty input gives an empty result; null keys form an entity of their own.
    """
    if not windows or min(windows) < 1:
        raise ValueError("windows are positive numbers of days")
    w = Window.partitionBy(*keys).orderBy(day)
    nxt = F.coalesce(F.date_sub(F.lead(day).over(w), 1), F.col(day))
    step = daily.select(*keys, day, value).withColumn("_until", nxt)
    filled = step.select(
        *keys,
        F.posexplode(F.sequence(F.col(day), F.col("_until"))).alias("_i", "_d"),
        F.col(value).alias("_v"),
    ).select(*keys, F.col("_d").alias(day), F.when(F.col("_i") == 0, F.col("_v")).otherwise(F.lit(0)).cast("bigint").alias(value))

    def shifted(c: str, by: int) -> Column:
        return F.coalesce(F.lag(c, by).over(w), F.lit(0)) if by else F.col(c)

    out, block, sums = filled.withColumn("_s1", F.col(value)), 1, {1: "_s1"}
    while block * 2 <= max(windows):
        out = out.withColumn(f"_s{block * 2}", F.col(sums[block]) + shifted(sums[block], block))
        block *= 2
        sums[block] = f"_s{block}"
    totals: dict[str, Column] = {}
    for days in windows:
        offset, parts = 0, []
        for b in _windows(days):
            parts.append(shifted(sums[b], offset))
            offset += b
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        totals[f"total_{days}"] = total
    out = out.withColumns(totals)
    return out.select(
        *keys, day, value, *(c for days in windows for c in (F.col(f"total_{days}"), (F.col(f"total_{days}") / F.lit(float(days))).alias(f"avg_{days}")))
    )
