"""Connected components by alternating large-star and small-star steps.

Every round is two shuffles over the edges; the number of rounds grows with the logarithm of the longest path. No node
gathers its neighbours in one task: the smallest neighbour is a combinable aggregate, and stars are built by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``src, cid, comp`` for each node of the edges ``(src, a, b)``; ``comp`` is the smallest id of its component."""
    e = edges.where("a <> b").select("src", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    e = cut(e, "cc")
    before = None
    while True:
        both = e.unionAll(e.select("src", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("src", "u").agg(F.min("v").alias("w")).select("src", "u", F.least("u", "w").alias("w"))
        large = both.where("v > u").join(low, ["src", "u"]).select("src", F.col("w").alias("u"), "v")
        e2 = large.where("u <> v").distinct()
        # every node links its smaller neighbours, and itself, to the smallest of them
        small_low = e2.groupBy("src", "v").agg(F.min("u").alias("w"))
        small = e2.join(small_low, ["src", "v"])
        e3 = small.select("src", F.col("w").alias("u"), F.col("u").alias("v")).unionAll(small.select("src", F.col("w").alias("u"), "v"))
        e = cut(e3.where("u <> v").distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("src", "u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy("src", F.col("v").alias("cid")).agg(F.min("u").alias("comp")).unionByName(
        e.select("src", F.col("u").alias("cid"), F.col("u").alias("comp")).distinct()
    )
