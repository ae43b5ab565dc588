"""Problem 5: all pairs of set-valued records above a similarity threshold.

Snapshots are reduced to classes of equal url sets, each set to a packed one-bit minhash code, and pairs are found by
``setjoin.candidate_pairs``: an index on the rarest urls of each set, a Hamming radius around the codes (calibrated so
that a pair at the threshold is lost with a probability below 1e-10), and an exact check of the original url sets.

The listed method joins segments of the codes alone. At a Jaccard threshold of 0.5 a code bit of a true pair differs
with probability 0.25, so a 12-bit segment agrees with probability 0.03 and the pigeonhole principle needs about 215
segments a record (and 10 chance partners in each for 40,000 records) for a recall of 0.999; a guaranteed radius would
compare nearly all pairs. The index on rare items finds all pairs from about 6 entries a record, so candidates come from
there and the codes serve as the filter. See README.

Defined cases: a null or empty list, or one of only nulls and empty strings, has no pairs. Repeated urls count once. Of
several rows with one id (exact duplicates, as a rule) the union of their lists is not taken: the smallest list counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.setjoin import candidate_pairs, one_bit_codes, pairs_of_members, verified
from brindle.session import cut

THRESHOLD = 0.5


def url_sets(df: DataFrame, id_col: str = "snapshot_id", items_col: str = "urls") -> DataFrame:
    """``src, id, vals``: the distinct non-empty values of each record, sorted; records without any are left out."""
    vals = F.array_sort(F.array_distinct(F.filter(F.col(items_col), lambda x: x.isNotNull() & (x != ""))))
    s = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), vals.alias("vals")).where(F.size("vals") > 0)
    return s.groupBy("id").agg(F.min("vals").alias("vals")).select(F.lit("").alias("src"), "id", "vals")


def similar_sets(sets: DataFrame, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes ``(src, a, b, overlap, jaccard)`` and the members ``(src, cid, id)`` of every class."""
    s = cut(sets.withColumn("key", F.md5(F.concat_ws("\n", "vals"))), "sets")
    reps = s.groupBy("src", "key").agg(F.min("id").alias("cid"), F.min("vals").alias("vals"))
    coded, codes = one_bit_codes(reps.withColumn("items", F.array_distinct(F.transform("vals", lambda x: F.xxhash64(x)))))
    classes = cut(coded, "classes")
    pairs = verified(candidate_pairs(classes, t, codes=codes), classes, "vals", t)
    members = s.select("src", "key", "id").join(classes.select("src", "key", "cid"), ["src", "key"]).select("src", "cid", "id")
    return pairs, members


def classes(df: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """``id, class_id, links``: every record with values, its class of equal sets (the smallest id) and the number of similar
    classes; copies are not expanded into pairs."""
    pairs, members = similar_sets(url_sets(df), t)
    p = cut(pairs.select("a", "b"), "edges")
    links = p.select(F.col("a").alias("cid")).unionAll(p.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count("*").alias("links"))
    return members.join(links, "cid", "left").select("id", F.col("cid").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def found(df: DataFrame, t: float = THRESHOLD) -> DataFrame:
    pairs, members = similar_sets(url_sets(df), t)
    return pairs_of_members(pairs, members).select(F.col("id_a").alias("snapshot_a"), F.col("id_b").alias("snapshot_b"))
