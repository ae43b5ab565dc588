"""Ranking of named texts by a short query: inverse frequency of its words, names count three times, phrases a bonus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import content_tokens

NAME_WEIGHT, PHRASE_BONUS = 3.0, 5.0


def ranked(docs: DataFrame, query: str, k: int = 20) -> DataFrame:
    """``id, score``: the ``k`` best of ``id, name, body`` for the query, ties by id. A word that occurs in ``df`` of ``n``
    texts weighs ``ln(1 + n / df)``. One pass counts, one scores; only the query's words are counted."""
    q = docs.sparkSession.range(1).select(F.array_distinct(content_tokens(F.lit(query))).alias("q"))
    d = docs.crossJoin(F.broadcast(q)).select("id", "q", F.array_intersect("q", content_tokens("name")).alias("n"), F.array_intersect("q", content_tokens("body")).alias("b"), F.lower(F.concat_ws("\n", "name", "body")).alias("all"))
    seen = d.select(F.explode(F.array_union("n", "b")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weight = seen.crossJoin(F.broadcast(docs.agg(F.count("*").alias("c")))).select("t", F.log(1 + F.col("c") / F.col("df")).alias("w"))
    weights = weight.agg(F.map_from_entries(F.collect_list(F.struct("t", "w"))).alias("w"))  # as many as the query has words
    s = d.crossJoin(F.broadcast(weights))

    def total(c: str) -> F.Column:
        return F.aggregate(c, F.lit(0.0), lambda acc, t: acc + F.coalesce(F.element_at("w", t), F.lit(0.0)))

    phrase = F.when(F.col("all").contains(query.lower().strip()), PHRASE_BONUS).otherwise(0.0)
    return s.select("id", F.round(NAME_WEIGHT * total("n") + total("b") + phrase, 9).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)
