"""Queries on sampled answers, statistics and effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import stats as S
from brindle.functions.text import normalize_answer
from brindle.operators import answers as A
from brindle.operators import effects as E
from brindle.plans import Registry
from brindle.plans.metric_queries import _LATEST, _PAGES, latest, page_metrics_range
from brindle.sources import table

REG = Registry()
SEED = 20250101
RESAMPLES, EFFECT_RESAMPLES = 10_000, 5_000

_ANSWERS = """a AS (SELECT DISTINCT run, prompt, run_index, text, refusal, fetch_error, grounding FROM engine_answer),
good AS (SELECT * FROM a WHERE text IS NOT NULL AND trim(text) <> '' AND refusal IS NULL AND fetch_error IS NULL)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "engine_answer").select("run", "prompt", "run_index", "text", "refusal", "fetch_error", "grounding").distinct()


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.answered(_answers(spark, sf_dir))


_WILSON = """round(CASE WHEN trials > 0 THEN greatest(0, least(1, (hits / trials + 1.959963984540054^2 / (2 * trials) - {s} 1.959963984540054 * sqrt(hits / trials * (1 - hits / trials) / trials + 1.959963984540054^2 / (4 * trials * trials))) / (1 + 1.959963984540054^2 / trials))) ELSE {e} END, 9)"""
_LOW, _HIGH = _WILSON.format(s="", e="0"), _WILSON.format(s="-1 *", e="1")


@REG.add("wilson_visibility", f"WITH {_ANSWERS}, g AS (SELECT run, count(*) FILTER (len(grounding) > 0) AS hits, count(*) AS trials FROM good GROUP BY run) SELECT run, hits, trials, round(hits / trials, 9) AS rate, {_LOW} AS low, {_HIGH} AS high FROM g")
def wilson_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of answers with sources, with its interval, for each run."""
    p = A.proportions(_good(spark, sf_dir), ["run"], F.size("grounding") > 0)
    return p.select("run", "hits", "trials", *(F.round(c, 9).alias(c) for c in ("rate", "low", "high")))


@REG.add("measure_prompts", f"WITH {_ANSWERS} SELECT run, prompt, count(*) FILTER (len(grounding) > 0) AS hits, count(*) AS trials FROM good GROUP BY ALL")
def measure_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.proportions(_good(spark, sf_dir), ["run", "prompt"], F.size("grounding") > 0).select("run", "prompt", "hits", "trials")


@REG.add("answers_with_prompt", "SELECT a.run, a.prompt, a.run_index, p.text AS question, length(a.text) AS n_chars FROM (SELECT DISTINCT run, prompt, run_index, text FROM engine_answer) a JOIN (SELECT prompt, min(text) AS text FROM engine_prompt GROUP BY prompt) p USING (prompt)")
def answers_with_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "engine_prompt").groupBy("prompt").agg(F.min("text").alias("question"))
    a = table(spark, sf_dir, "engine_answer").select("run", "prompt", "run_index", "text").distinct()
    return a.join(p, "prompt").select("run", "prompt", "run_index", "question", F.length("text").cast("bigint").alias("n_chars"))


@REG.add(
    "normalized_answers",
    """WITH a AS (SELECT DISTINCT run, prompt, run_index, text, refusal, fetch_error, grounding FROM engine_answer), n AS (SELECT run, prompt, run_index, regexp_replace(regexp_replace(text, '\\r\\n?', '\n', 'g'), '[ \\t\\f\\v\\r]+', ' ', 'g') AS t FROM a)
    SELECT run, prompt, run_index, regexp_replace(regexp_replace(regexp_replace(t, '(^|\n) +| +(\n|$)', '\\1\\2', 'g'), '\n{3,}', '\n\n', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM n""",
)
def normalized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("run", "prompt", "run_index", normalize_answer(F.col("text")).alias("text"))


#: Entity definitions for the mention queries: phrases that occur in answers.
ENTITIES = [
    {"id": "warehouse", "name": "warehouse", "variants": ["magazyn", "das Lager", "almacén"], "exclusions": ["el almacén sea barato"]},
    {"id": "tester", "name": "second tester", "variants": ["druga testerka", "zweite Prüferin", "segunda probadora"], "exclusions": []},
    {"id": "neighbour", "name": "neighbour", "variants": ["sąsiad", "Nachbar", "vecino"], "exclusions": []},
]
_EDGE = r"[^\p{L}\p{N}_]"


def _mention_sql(names: list[str]) -> str:
    alt = "|".join(n.replace(" ", r"\s+") for n in names)
    return f"regexp_matches(lower(text), '(^|{_EDGE})({alt.lower()})($|{_EDGE})')"


@REG.add("mentions")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention with its place."""
    return A.mentions(_good(spark, sf_dir).select("run", "prompt", "run_index", "text"), ENTITIES)


@REG.add(
    "mention_counts",
    f"""WITH {_ANSWERS}, clean AS (SELECT run, prompt, run_index, regexp_replace(text, '(?i)el almacén sea barato', '', 'g') AS text FROM good),
    m AS (SELECT 'warehouse' AS entity, count(*) FILTER ({_mention_sql(['warehouse', 'magazyn', 'das Lager', 'almacén'])}) AS answers FROM clean
    UNION ALL SELECT 'tester', count(*) FILTER ({_mention_sql(['second tester', 'druga testerka', 'zweite Prüferin', 'segunda probadora'])}) FROM clean
    UNION ALL SELECT 'neighbour', count(*) FILTER ({_mention_sql(['neighbour', 'sąsiad', 'Nachbar', 'vecino'])}) FROM clean)
    SELECT entity, answers, round(answers / sum(answers) OVER (), 9) AS share FROM m""",
)
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.share_of_voice(mentions(spark, sf_dir))
    return v.select("entity", "answers", F.round("share", 9).alias("share"))


@REG.add("brand_mentions")
def brand_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of the definitions in ``brand_entity`` (the latest version of each)."""
    b = table(spark, sf_dir, "brand_entity").groupBy("id").agg(F.max(F.struct("version", "name", "variants", "exclusions")).alias("m")).select("id", "m.name", "m.variants", "m.exclusions")
    return A.mentions_of(_good(spark, sf_dir).select("run", "prompt", "run_index", "text"), b)


@REG.add(
    "median_first_position",
    f"""WITH {_ANSWERS}, n AS (SELECT run, prompt, run_index, regexp_replace(regexp_replace(text, '\\r\\n?', '\n', 'g'), '[ \\t\\f\\v\\r]+', ' ', 'g') AS t FROM good),
    c AS (SELECT run, prompt, run_index, regexp_replace(regexp_replace(regexp_replace(t, '(^|\n) +| +(\n|$)', '\\1\\2', 'g'), '\n{{3,}}', '\n\n', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM n),
    x AS (SELECT run, prompt, run_index, t, regexp_replace(t, '(?i)el almacén sea barato', repeat('#', 22), 'g') AS clean FROM c),
    p AS (SELECT 'warehouse' AS entity, ['warehouse', 'magazyn', 'das Lager', 'almacén'] AS names UNION ALL SELECT 'tester', ['second tester', 'druga testerka', 'zweite Prüferin', 'segunda probadora'] UNION ALL SELECT 'neighbour', ['neighbour', 'sąsiad', 'Nachbar', 'vecino']),
    m AS (SELECT entity, t, length(regexp_extract(lower(clean), '^(?s:(.*?))(?:^|[^\\p{{L}}\\p{{N}}_])(?:' || array_to_string(list_transform(names, lambda z: replace(lower(z), ' ', '\\s+')), '|') || ')(?:$|[^\\p{{L}}\\p{{N}}_])', 1)) AS before, regexp_matches(lower(clean), '(^|[^\\p{{L}}\\p{{N}}_])(' || array_to_string(list_transform(names, lambda z: replace(lower(z), ' ', '\\s+')), '|') || ')($|[^\\p{{L}}\\p{{N}}_])') AS hit,
      regexp_matches(lower(clean), '^(' || array_to_string(list_transform(names, lambda z: replace(lower(z), ' ', '\\s+')), '|') || ')($|[^\\p{{L}}\\p{{N}}_])') AS at_start FROM x, p)
    SELECT entity, round(median(CASE WHEN at_start THEN 0.0 ELSE (before + 1) / length(t) END), 9) AS median_first FROM m WHERE hit GROUP BY entity""",
)
def median_first_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.share_of_voice(mentions(spark, sf_dir)).select("entity", F.round("median_first", 9).alias("median_first"))


@REG.add(
    "inline_citation_hosts",
    f"""WITH {_ANSWERS}, u AS (SELECT DISTINCT run, prompt, run_index, unnest(regexp_extract_all(text, 'https?://[^\\s<>"''`]+')) AS url FROM a),
    t AS (SELECT DISTINCT run, prompt, run_index, regexp_replace(url, '[.,;:!?]+$', '') AS url FROM u)
    SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') AS host, count(*) AS n FROM t GROUP BY ALL""",
)
def inline_citation_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.inline_citations(_answers(spark, sf_dir)).groupBy("host").agg(F.count("*").alias("n"))


@REG.add(
    "grounding_hosts",
    f"""WITH {_ANSWERS}, u AS (SELECT run, prompt, run_index, unnest(list_distinct(grounding)) AS url FROM a)
    SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^www\\.', '') AS host, count(*) AS n FROM u WHERE url <> '' GROUP BY ALL""",
)
def grounding_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grounding_citations(_answers(spark, sf_dir)).groupBy("host").agg(F.count("*").alias("n"))


def _draws_sql(n: str, seed: int, per: str, skip: str) -> str:
    return S.draw_sql(str(seed), f"r * ({per}) + ({skip}) + k + 1")


@REG.add("prng_draws", f"SELECT k, {S.draw_sql('42', 'k')} AS u FROM (SELECT range AS k FROM range(1, 1001))")
def prng_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 1001).select(F.col("id").alias("k"), S.draw(42, F.col("id")).alias("u"))


@REG.add(
    "detectable_difference",
    "SELECT m, n, round(CASE WHEN m > 0 AND n > 0 THEN least(1.0, 1.959963984540054 * sqrt(0.25 / nullif(n, 0)) / sqrt(nullif(m, 0)) * sqrt(2)) ELSE 1.0 END, 9) AS difference FROM (SELECT range AS m FROM range(0, 101)), (SELECT range AS n FROM range(0, 11))",
)
def detectable_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.range(0, 101).select(F.col("id").alias("m"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(10).cast("bigint"))).alias("n"))
    return g.select("m", "n", F.round(S.detectable_difference("m", "n"), 9).alias("difference"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Per-prompt measurements of the first and the second half of the answers, by run index."""
    g = _good(spark, sf_dir)
    hit = F.size("grounding") > 0
    return A.proportions(g.where("run_index % 2 = 0"), ["prompt"], hit), A.proportions(g.where("run_index % 2 = 1"), ["prompt"], hit)


_PAIRED = f"""WITH {_ANSWERS}, m AS (SELECT prompt, (count(*) FILTER (len(grounding) > 0 AND run_index % 2 = 1) / nullif(count(*) FILTER (run_index % 2 = 1), 0))
  - (count(*) FILTER (len(grounding) > 0 AND run_index % 2 = 0) / nullif(count(*) FILTER (run_index % 2 = 0), 0)) AS difference FROM good GROUP BY prompt),
s AS (SELECT row_number() OVER (ORDER BY prompt) - 1 AS i, difference AS value FROM m WHERE difference IS NOT NULL),
n AS (SELECT count(*) AS n FROM s)"""


@REG.add(
    "paired_bootstrap",
    _PAIRED
    + f""", d AS (SELECT r, floor({S.draw_sql(str(SEED), 'r * n + k + 1')} * n)::BIGINT AS i FROM n, (SELECT range AS r FROM range({RESAMPLES})), (SELECT unnest(range((SELECT n FROM n))) AS k)),
    means AS (SELECT r, avg(value) AS mean FROM d JOIN s USING (i) GROUP BY r), l AS (SELECT list_sort(list(mean)) AS m FROM means)
    SELECT n AS pairs, round((SELECT avg(value) FROM s), 9) AS mean, round(m[{int(0.025 * (RESAMPLES - 1) + 0.5) + 1}], 9) AS low, round(m[{int(0.975 * (RESAMPLES - 1) + 0.5) + 1}], 9) AS high FROM n, l""",
)
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    d = a.select("prompt", F.col("rate").alias("r0")).join(b.select("prompt", F.col("rate").alias("r1")), "prompt").select("prompt", (F.col("r1") - F.col("r0")).alias("difference"))
    p = E.paired(d, "prompt", "difference", SEED, RESAMPLES)
    return p.select("pairs", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


_SAME = f"""WITH {_ANSWERS}, m AS (SELECT prompt, count(*) FILTER (len(grounding) > 0 AND run_index % 2 = 0) AS h0, count(*) FILTER (run_index % 2 = 0) AS n0, count(*) FILTER (len(grounding) > 0 AND run_index % 2 = 1) AS h1, count(*) FILTER (run_index % 2 = 1) AS n1 FROM good GROUP BY prompt),
joint AS (SELECT * FROM m WHERE n0 > 0 AND n1 > 0), s AS (SELECT row_number() OVER (ORDER BY prompt) - 1 AS i, h1 / n1 - h0 / n0 AS value FROM joint), n AS (SELECT count(*) AS n, (SELECT least(min(n0), min(n1)) FROM joint) AS runs FROM s)"""


@REG.add(
    "compare_measurements",
    _SAME
    + f""", d AS (SELECT r, floor({S.draw_sql(str(SEED), 'r * n + k + 1')} * n)::BIGINT AS i FROM n, (SELECT range AS r FROM range({RESAMPLES})), (SELECT unnest(range((SELECT n FROM n))) AS k)),
    means AS (SELECT r, avg(value) AS mean FROM d JOIN s USING (i) GROUP BY r), l AS (SELECT list_sort(list(mean)) AS m FROM means),
    x AS (SELECT n AS pairs, (SELECT avg(value) FROM s) AS mean, m[{int(0.025 * (RESAMPLES - 1) + 0.5) + 1}] AS low, m[{int(0.975 * (RESAMPLES - 1) + 0.5) + 1}] AS high, least(1.0, 1.959963984540054 * sqrt(0.25 / runs) / sqrt(n) * sqrt(2)) AS resolution FROM n, l)
    SELECT 'compared' AS kind, pairs, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high, round(resolution, 9) AS resolution, (low > 0 OR high < 0) AND abs(mean) >= resolution AND pairs > 1 AS significant FROM x""",
)
def compare_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two measurements of the prompts that both halves answered."""
    a, b = _halves(spark, sf_dir)
    both = a.select("prompt").join(b.select("prompt"), "prompt")
    c = A.compared(a.join(both, "prompt", "left_semi"), b.join(both, "prompt", "left_semi"), SEED, RESAMPLES)
    return c.withColumns({x: F.round(x, 9) for x in ("mean", "low", "high", "resolution")})


@REG.add("comparison_refusal", f"WITH {_ANSWERS}, m AS (SELECT prompt, count(*) FILTER (run_index % 2 = 0) AS n0, count(*) FILTER (run_index % 2 = 1) AS n1 FROM good GROUP BY prompt) SELECT CASE WHEN count(*) FILTER (n0 > 0) = 0 OR count(*) FILTER (n1 > 0) = 0 THEN 'empty' WHEN count(*) FILTER (n0 = 0 OR n1 = 0) > 0 THEN 'composition' ELSE 'compared' END AS kind FROM m")
def comparison_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the halves as they are may be compared at all."""
    a, b = _halves(spark, sf_dir)
    return A.compared(a, b, SEED, 10).select("kind")


_PANEL = f"""WITH {_LATEST}, p AS (SELECT page, coalesce(sum(clicks) FILTER (date BETWEEN DATE '2025-03-01' AND DATE '2025-03-15'), 0)::BIGINT AS clicks_before,
  coalesce(sum(clicks) FILTER (date BETWEEN DATE '2025-03-15' AND DATE '2025-03-29'), 0)::BIGINT AS clicks_after
  FROM latest WHERE page IS NOT NULL AND date BETWEEN DATE '2025-03-01' AND DATE '2025-03-29' GROUP BY page),
panel AS (SELECT page, substr(md5(page), 1, 1) IN ('0', '1') AS treated, (clicks_after - clicks_before)::DOUBLE AS d FROM p)"""


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.before_after(latest(spark, sf_dir).where("page is not null"), "page", "2025-03-15", 14)
    return p.withColumn("treated", F.substring(F.md5("page"), 1, 1).isin("0", "1"))


@REG.add("before_after_panel", f"""WITH {_LATEST} SELECT page, coalesce(sum(clicks) FILTER (date BETWEEN DATE '2025-03-01' AND DATE '2025-03-15'), 0)::BIGINT AS clicks_before, coalesce(sum(clicks) FILTER (date BETWEEN DATE '2025-03-15' AND DATE '2025-03-29'), 0)::BIGINT AS clicks_after
  FROM latest WHERE page IS NOT NULL AND date BETWEEN DATE '2025-03-01' AND DATE '2025-03-29' GROUP BY page""")
def before_after_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).select("page", "clicks_before", "clicks_after")


@REG.add("did_effect", _PANEL + " SELECT 'effect' AS kind, count(*) FILTER (treated) AS treatment, count(*) FILTER (NOT treated) AS control, round(avg(d) FILTER (treated) - avg(d) FILTER (NOT treated), 9) AS effect FROM panel")
def did_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.did(_panel(spark, sf_dir), "treated", "clicks").withColumn("effect", F.round("effect", 9))


_DRAWS = f"""u AS (SELECT treated, d, row_number() OVER (PARTITION BY treated ORDER BY page) - 1 AS i FROM panel), n AS (SELECT count(*) FILTER (treated) AS na, count(*) FILTER (NOT treated) AS nb FROM panel),
  da AS (SELECT r, floor({S.draw_sql(str(SEED), 'r * (na + nb) + k + 1')} * na)::BIGINT AS i FROM n, (SELECT range AS r FROM range({EFFECT_RESAMPLES})), (SELECT unnest(range((SELECT na FROM n))) AS k)),
  db AS (SELECT r, floor({S.draw_sql(str(SEED), 'r * (na + nb) + na + k + 1')} * nb)::BIGINT AS i FROM n, (SELECT range AS r FROM range({EFFECT_RESAMPLES})), (SELECT unnest(range((SELECT nb FROM n))) AS k)),
  ma AS (SELECT r, avg(d) AS m FROM da JOIN u ON treated AND da.i = u.i GROUP BY r), mb AS (SELECT r, avg(d) AS m FROM db JOIN u ON NOT treated AND db.i = u.i GROUP BY r), l AS (SELECT list_sort(list(ma.m - mb.m)) AS m FROM ma JOIN mb USING (r))"""


@REG.add(
    "did_interval",
    _PANEL
    + ", "
    + _DRAWS
    + f""", x AS (SELECT na AS treatment, nb AS control, (SELECT avg(d) FILTER (treated) - avg(d) FILTER (NOT treated) FROM panel) AS effect, m[{int(0.025 * EFFECT_RESAMPLES) + 1}] AS low, m[{int(0.975 * EFFECT_RESAMPLES) + 1}] AS high FROM n, l)
    SELECT 'effect' AS kind, treatment, control, round(effect, 9) AS effect, round(low, 9) AS low, round(high, 9) AS high, low > 0 OR high < 0 AS significant, CASE WHEN low > 0 OR high < 0 THEN CASE WHEN effect > 0 THEN 'better' ELSE 'worse' END END AS direction FROM x""",
)
def did_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect on clicks with its interval over 5,000 resamples of pages."""
    e = E.did_interval(_panel(spark, sf_dir), "page", "treated", "clicks", SEED, EFFECT_RESAMPLES)
    return e.withColumns({c: F.round(c, 9) for c in ("effect", "low", "high")})


@REG.add(
    "did_windows",
    f"""WITH {_LATEST}, w AS (SELECT unnest([14, 30, 60]) AS days, DATE '2025-03-15' AS c),
    p AS (SELECT days, page, substr(md5(page), 1, 1) IN ('0', '1') AS t, coalesce(sum(clicks) FILTER (date <= c), 0)::DOUBLE AS cb, coalesce(sum(clicks) FILTER (date >= c), 0)::DOUBLE AS ca, coalesce(sum(impressions) FILTER (date <= c), 0)::DOUBLE AS ib, coalesce(sum(impressions) FILTER (date >= c), 0)::DOUBLE AS ia,
      coalesce(sum(coalesce(position, 0) * impressions) FILTER (date <= c), 0)::DOUBLE AS wb, coalesce(sum(coalesce(position, 0) * impressions) FILTER (date >= c), 0)::DOUBLE AS wa FROM latest, w WHERE page IS NOT NULL AND date BETWEEN c - days AND c + days GROUP BY ALL),
    g AS (SELECT days, t, count(*) AS n, sum(cb) AS cb, sum(ca) AS ca, sum(ib) AS ib, sum(ia) AS ia, sum(wb) AS wb, sum(wa) AS wa FROM p GROUP BY ALL),
    d AS (SELECT days, t, n, unnest([{{'m': 'clicks', 'd': ca / n - cb / n}}, {{'m': 'impressions', 'd': ia / n - ib / n}}, {{'m': 'ctr', 'd': ca / ia - cb / ib}}, {{'m': 'position', 'd': wa / ia - wb / ib}}]) AS x FROM g)
    SELECT days::INT AS days, x.m AS metric, 'effect' AS kind, max(n) FILTER (t) AS treatment, max(n) FILTER (NOT t) AS control, round(max(x.d) FILTER (t) - max(x.d) FILTER (NOT t), 9) AS effect FROM d GROUP BY days, x.m""",
)
def did_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect on each metric in windows of 14, 30 and 60 days."""
    rows = latest(spark, sf_dir).where("page is not null")
    out = None
    for days in E.WINDOWS:
        p = E.before_after(rows, "page", "2025-03-15", days).withColumn("treated", F.substring(F.md5("page"), 1, 1).isin("0", "1"))
        for metric in E.METRICS:
            one = E.did(p, "treated", metric).select(F.lit(days).alias("days"), F.lit(metric).alias("metric"), "kind", "treatment", "control", F.round("effect", 9).alias("effect"))
            out = one if out is None else out.unionByName(one)
    return out


@REG.add(
    "opportunity_rank",
    _PAGES
    + """, c(i, ctr) AS (VALUES (1, 0.28), (2, 0.15), (3, 0.11), (4, 0.08), (5, 0.07), (6, 0.05), (7, 0.04), (8, 0.03), (9, 0.03), (10, 0.03)),
    u AS (SELECT site, page, CASE WHEN position <= 3 THEN 0.0 ELSE impressions * (0.11 - ctr)::DOUBLE END AS upside FROM pages JOIN c ON i = least(greatest(floor(position + 0.5)::INT, 1), 10))
    SELECT site, page, round(upside, 6) AS upside FROM u ORDER BY upside DESC, page LIMIT 100""",
)
def opportunity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_metrics_range(spark, sf_dir)
    u = p.select("site", "page", E.click_upside(F.col("impressions"), F.col("position")).alias("upside"))
    return u.orderBy(F.desc("upside"), "page").limit(100).select("site", "page", F.round("upside", 6).alias("upside"))


@REG.add("control_group")
def control_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_metrics_range(spark, sf_dir).groupBy("page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.avg("position").alias("position"))
    t = F.substring(F.md5("page"), 1, 1) == "0"
    return E.control_group(p.where(t), p.where(~t))
