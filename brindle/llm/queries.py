"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import abuse, boilerplate, bpe, names, near_copies, packing, pairs, residue, serp_pairs
from brindle.plans import Registry
from brindle.session import cut
from brindle.sources import table

REG = Registry()


@REG.add(
    "p5_found",
    """WITH s AS (
      SELECT snapshot_id, any_value(list_sort(list_distinct(list_filter(urls, lambda x: x IS NOT NULL AND x <> '')))) AS u FROM serp_snapshot GROUP BY snapshot_id),
    e AS (SELECT snapshot_id, len(u) AS n, unnest(u) AS x FROM s),
    o AS (SELECT a.snapshot_id AS snapshot_a, b.snapshot_id AS snapshot_b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
          FROM e a JOIN e b ON a.x = b.x AND a.snapshot_id < b.snapshot_id GROUP BY ALL)
    SELECT snapshot_a, snapshot_b FROM o WHERE 2 * k >= na + nb - k""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of snapshots with at least half of the union of their urls in common."""
    return serp_pairs.found(table(spark, sf_dir, "serp_snapshot"))


@REG.add("p5_classes")
def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snapshot with its class of equal url sets and the number of similar classes."""
    return serp_pairs.classes(table(spark, sf_dir, "serp_snapshot"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "corpus_document").select(F.lit("corpus_document").alias("src"), "id", "text")
    pages = table(spark, sf_dir, "existing_page").select(F.lit("existing_page").alias("src"), F.col("page_id").cast("string").alias("id"), "text")
    return corpus.unionByName(pages)


@REG.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited copies among the corpus documents and among the existing pages."""
    return near_copies.found(_texts(spark, sf_dir))


@REG.add("p6_groups")
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its class of exact copies and its group of near copies (five words, 0.8)."""
    return near_copies.groups(_texts(spark, sf_dir))


@REG.add("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, sf_dir, "documents"))


@REG.add("p8_counts")
def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return bpe.token_counts(table(spark, sf_dir, "documents"))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [(r.container, r.capacity) for r in table(spark, sf_dir, "pack_size").orderBy("container").limit(packing.MAX_KINDS + 1).collect()]
    return packing.pack(bpe.token_counts(table(spark, sf_dir, "documents")), kinds)


@REG.add("p9_bins")
def p9_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of a document that exceeds the capacity, in a container of each kind."""
    return packing.assignments(_bins(spark, sf_dir))


@REG.add("p9_fill")
def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and their fill rate, for each kind."""
    return packing.summary(_bins(spark, sf_dir))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.messages(residue.units(table(spark, sf_dir, "existing_page"), table(spark, sf_dir, "crawl_page")))


@REG.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and crawl records that show template residue, filler, error messages or script notices."""
    return residue.flagged(cut(_messages(spark, sf_dir), "messages"))


@REG.add("p1_messages")
def p1_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each masked message with its kind, rows and sources."""
    return residue.recurring(_messages(spark, sf_dir).distinct())


@REG.add("p1_shares")
def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the flagged rows the words of a message settle, its recurrence over sources, or both."""
    return residue.shares(cut(_messages(spark, sf_dir), "messages"))


def _site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = boilerplate.units(table(spark, sf_dir, "existing_page"), table(spark, sf_dir, "crawl_page"))
    return cut(boilerplate.tree_rows(units), "lines")


@REG.add("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages and crawl records that are not main body."""
    return boilerplate.furniture(_site_lines(spark, sf_dir))


@REG.add("p4_shares")
def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of these lines the style tree finds, their wording, or both."""
    return boilerplate.shares(_site_lines(spark, sf_dir))


@REG.add("p4_body")
def p4_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of every page and crawl record with a text."""
    units = boilerplate.units(table(spark, sf_dir, "existing_page"), table(spark, sf_dir, "crawl_page"))
    return boilerplate.main_text(units, boilerplate.furniture(_site_lines(spark, sf_dir)))


@REG.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs of prompt and answer with their defect."""
    return pairs.found(table(spark, sf_dir, "engine_answer"), table(spark, sf_dir, "engine_prompt"))


@REG.add("p3_defects")
def p3_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect that the rules find in a pair."""
    return pairs.defects(table(spark, sf_dir, "engine_answer"), table(spark, sf_dir, "engine_prompt"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scored(table(spark, sf_dir, "documents"), keep=("source",))


@REG.add("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an abusive, hateful or sexually explicit passage."""
    return _scores(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


@REG.add("p10_scores")
def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return _scores(spark, sf_dir)


@REG.add("p10_rates")
def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, cases and their rate for every source."""
    return abuse.rates(_scores(spark, sf_dir), table(spark, sf_dir, "doc_source"))


@REG.add("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of brand and person definitions that stand for the same entity."""
    return names.found(table(spark, sf_dir, "brand_entity"))


@REG.add("p7_entities")
def p7_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every definition with its entity."""
    return names.linked(table(spark, sf_dir, "brand_entity"))
