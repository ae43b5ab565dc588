"""The internal link graph: degrees, click depth, orphans, redirects."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.urls import normalize
from brindle.session import cut


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges ``run, src, dst`` between different known nodes ``run, url``."""
    n = nodes.select("run", "url").distinct()
    e = edges.where(F.col("src") != F.col("dst")).select("run", "src", "dst").distinct()
    return e.join(n.select("run", F.col("url").alias("src")), ["run", "src"], "left_semi").join(n.select("run", F.col("url").alias("dst")), ["run", "dst"], "left_semi").select("run", "src", "dst")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``run, url, in_degree, out_degree``, zero for nodes without edges. One aggregation over both ends."""
    ends = edges.select("run", F.explode(F.array(F.struct(F.col("src").alias("url"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("url"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("run", "e.*")
    zero = nodes.select("run", "url", F.lit(0).alias("i"), F.lit(0).alias("o"))
    return zero.unionByName(ends).groupBy("run", "url").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def click_depth(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``run, url, depth``: clicks from the root, null where it can't be reached. Level by level, each new level against
    what was seen; a level is written, so lineage stays flat and a lost executor costs one level."""
    e = cut(edges.select("run", "src", "dst"), "links")
    level = cut(roots.select("run", "url").distinct().withColumn("depth", F.lit(0)), "level")
    seen = level
    d = 0
    while True:
        d += 1
        nxt = e.join(level.select("run", F.col("url").alias("src")), ["run", "src"], "left_semi").select("run", F.col("dst").alias("url")).distinct()
        level = cut(nxt.join(seen.select("run", "url"), ["run", "url"], "left_anti").withColumn("depth", F.lit(d)), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        if d % 50 == 0:  # a long chain of unions would make the plan grow with the depth
            seen = cut(seen, "seen")
    return nodes.select("run", "url").distinct().join(seen, ["run", "url"], "left")


def orphans(degree: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes without inbound links that are no root."""
    return degree.where("in_degree = 0").join(roots.select("run", "url"), ["run", "url"], "left_anti").select("run", "url")


def unlinked(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages that no link row points to, self-links and the root included: the stored form of the question."""
    return pages.select("run", "url").distinct().join(edges.select("run", F.col("dst").alias("url")), ["run", "url"], "left_anti")


def redirect_problem(chain: Column, url: Column | None = None, longest: int = 2) -> Column:
    """``loop`` if the addresses of the chain and the page's own repeat one identity, ``too-long`` beyond ``longest`` hops,
    else null. Identities are those of ``url_key``, so another spelling of an address counts as a return."""
    return F.when(chain_repeats(chain, url), "loop").when(F.size(chain) > longest, "too-long")


def chain_repeats(chain: Column, url: Column | None = None) -> Column:
    """Whether a chain of raw addresses comes back to one of its own, compared by identity."""

    @F.pandas_udf("boolean")
    def repeats(c: pd.Series, u: pd.Series) -> pd.Series:
        def one(x, y) -> bool:  # noqa: ANN001
            if x is None or len(x) == 0:
                return False
            all_ = [normalize(v) or v for v in (*x, y) if v is not None]
            return len(set(all_)) < len(all_)

        return pd.Series([one(x, y) for x, y in zip(c, u)])

    return F.coalesce(F.when(F.size(chain) > 0, repeats(chain, F.lit(None).cast("string") if url is None else url)), F.lit(False))
