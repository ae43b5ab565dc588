import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators.rolling import latest_daily, trailing_totals

DDL = "site string, page string, date date, clicks bigint, seq bigint, day string, value string"


def _day(n):
    return dt.date(2025, 1, 1) + dt.timedelta(days=n)


def _brute(rows, windows):
    best = {}
    for site, page, date, clicks, seq, *_ in rows:
        if date is None:
            continue
        k, v = (site, page, date), (seq if seq is not None else -1, clicks or 0)
        best[k] = max(best.get(k, (-2, 0)), v)
    series = {}
    for (s, p, d), (_, c) in best.items():
        series.setdefault((s, p), {})[d] = c
    out = set()
    for k, days in series.items():
        d = min(days)
        while d <= max(days):
            out.add((*k, d, days.get(d, 0), *(sum(days.get(d - dt.timedelta(days=i), 0) for i in range(w)) for w in windows)))
            d += dt.timedelta(days=1)
    return out


@pytest.mark.parametrize("windows", [[7, 30], [1, 2, 3, 5, 16, 31]])
def test_matches_brute_force(spark, windows):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), f"p{rng.randrange(4)}", _day(rng.randrange(60)), rng.choice([None, 0, 1, 5]), i % 40, "x", "y") for i in range(300)]
    rows += rows[:20]
    rows.append(("a", "p0", None, 3, 1, "x", "y"))
    daily = latest_daily(spark.createDataFrame(rows, DDL), ["site", "page"], "date", "clicks", "seq")
    got = trailing_totals(daily, ["site", "page"], windows)
    assert {(r.site, r.page, r.day, r.value, *(r[f"total_{w}"] for w in windows)) for r in got.collect()} == _brute(rows, windows)
    assert all(abs(r.avg_7 - r.total_7 / 7) < 1e-12 for r in got.collect()) if 7 in windows else True


def test_one_entity_with_a_third_of_the_rows(spark):
    rows = spark.range(30_000).select(F.lit("s").alias("site"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("page"), F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("date"), F.lit(1).cast("bigint").alias("clicks"), F.col("id").alias("seq"))
    t = trailing_totals(latest_daily(rows, ["site", "page"], "date", "clicks", "seq"), ["site", "page"], [7])
    assert [r.total_7 for r in t.where("page = 'hot'").orderBy("day").collect()] == [1, 2, 3, 4, 5]


def test_empty_table_and_bad_window(spark):
    empty = latest_daily(spark.createDataFrame([], DDL), ["site", "page"], "date", "clicks", "seq")
    assert trailing_totals(empty, ["site", "page"], [7, 30]).count() == 0
    with pytest.raises(ValueError):
        trailing_totals(empty, ["site", "page"], [0])
