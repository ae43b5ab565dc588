"""Report frames: the rows of the performance, audit and answer reports as ``section, name, value`` and their HTML form.

A frame is small by construction: every part is an aggregate or a top-k list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part(df: DataFrame, section: str, name: Column, value: Column) -> DataFrame:
    """Rows of one section of a report."""
    return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("double").alias("value"))


def frame(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def totals(df: DataFrame, section: str, **values: Column) -> DataFrame:
    """One row for each named aggregate of ``df``, in one pass."""
    one = df.agg(*(v.cast("double").alias(k) for k, v in values.items()))
    return part(one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.col, values)))).alias("k", "v")), section, F.col("k"), F.col("v"))


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_page(report: DataFrame, title: str) -> DataFrame:
    """``html``: one page with a table for each section of a frame, names in order."""
    shown = F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")).otherwise(F.format_string("%.4f", F.col("value")))
    row = F.concat(F.lit("<tr><td>"), escaped(F.col("name")), F.lit("</td><td>"), F.coalesce(shown, F.lit("")), F.lit("</td></tr>"))
    tables = report.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    table = F.concat(F.lit("<h2>"), escaped(F.col("section")), F.lit("</h2><table>"), "rows", F.lit("</table>"))
    body = tables.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", table.alias("t")))), lambda x: x["t"]), "").alias("body"))
    head = escaped(F.lit(title))
    return body.select(F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), head, F.lit("</title></head><body><h1>"), head, F.lit("</h1>"), F.coalesce("body", F.lit("")), F.lit("</body></html>")).alias("html"))
