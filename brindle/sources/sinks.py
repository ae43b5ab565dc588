"""Writers: upserts, replaced partitions, and text files made of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.metrics import first_wins, last_wins


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], first: bool = False) -> DataFrame:
    """``old`` and ``new`` with one row for each key: the new one, or the old one if ``first``. One aggregation."""
    values = [c for c in old.columns if c not in keys]
    both = old.withColumn("_n", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_n", F.lit(1)))
    return (first_wins if first else last_wins)(both, list(keys), "_n", values).select(*old.columns)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrites only the partitions that occur in ``df``: a run that is written again replaces itself."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def text_sections(rows: DataFrame, group: str, line: str, order: str) -> DataFrame:
    """``group, text``: the lines of each group in order, under a heading. For groups of bounded size (top-k lists)."""
    g = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, line))).alias("l"))
    return g.select(group, F.concat(F.lit("## "), F.col(group), F.lit("\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x[line])), "\n")).alias("text"))


def article_schema(df: DataFrame, title: str, author_url: str, published: str) -> DataFrame:
    """Adds ``json_ld``: an article's structured data, safe inside a script element; headlines are cut at 110."""
    head = F.when(F.length(title) > 110, F.concat(F.substring(title, 1, 109), F.lit("…"))).otherwise(F.col(title))
    body = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Article").alias("@type"), head.alias("headline"), F.struct(F.lit("Person").alias("@type"), F.col(author_url).alias("url")).alias("author"), F.col(published).cast("string").alias("datePublished")))
    return df.withColumn("json_ld", F.replace(body, F.lit("<"), F.lit("\\u003c")))


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(column).write.mode("overwrite").text(path)


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
