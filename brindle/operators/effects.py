"""Effects with uncertainty: paired resampling, difference in differences, control groups, and ranked opportunities.

Resamples are rows: ``resamples x n`` draws of the counter-based generator, joined to the sample by a dense index and
averaged. Nothing is sequential, so the same seed gives the same interval under any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.stats import with_draw
from brindle.session import cut

#: Expected click rate at positions 1 to 10 (fixed values).
CTR = (0.28, 0.15, 0.11, 0.08, 0.07, 0.05, 0.04, 0.03, 0.03, 0.03)


#: Units of a sample up to which it travels as one array (8 MB).
MAX_ARRAY = 1_000_000


def indexed(df: DataFrame, order: str, *values: str) -> DataFrame:
    """``i`` and the values: a dense index from 0 in the order of an id. The sort is distributed; only the number of rows of
    each partition is summed up in one place."""
    s = df.select(F.col(order).alias("_o"), *values).orderBy("_o").withColumn("_m", F.monotonically_increasing_id())
    s = cut(s, "order")  # the numbers must not be drawn twice
    at = s.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("n"))
    before = at.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_before"))  # one row for each partition
    i = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return s.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(before), "_p").select(i.alias("i"), *values)


def resample_means(sample: DataFrame, n: int, seed: int, resamples: int, per_round: int, skip: int) -> DataFrame:
    """``r, mean``: the mean of ``n`` draws with replacement for each resample ``r``. Draw ``i`` of a round is number
    ``r * per_round + skip + i + 1`` of the generator."""
    spark = sample.sparkSession
    d = spark.range(resamples * n).select(F.expr(f"id div {n}").alias("r"), (F.col("id") % n).alias("k"))
    d = with_draw(d, seed, F.col("r") * per_round + F.lit(skip) + F.col("k") + 1, "u").select("r", F.floor(F.col("u") * n).cast("int").alias("i"))
    if n <= MAX_ARRAY:
        # the sample as one array: a lookup by position needs no join
        one = sample.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("a"))
        drawn = d.crossJoin(F.broadcast(one)).select("r", F.get("a", F.col("i")).alias("value"))
    else:
        drawn = d.join(sample, "i")
    return drawn.groupBy("r").agg(F.avg("value").alias("mean"))


def paired(df: DataFrame, unit: str, difference: str, seed: int, resamples: int = 10_000) -> DataFrame:
    """One row ``pairs, mean, low, high``: the mean difference with its percentile interval (2.5 % and 97.5 %). No pairs
    give zeros, one pair an interval without width."""
    s = cut(indexed(df, unit, difference).withColumnRenamed(difference, "value"), "sample")
    n = s.count()
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "pairs bigint, mean double, low double, high double")
    observed = s.agg(F.count("*").alias("pairs"), F.avg("value").alias("mean"))
    if n == 1:
        return observed.select("pairs", "mean", F.col("mean").alias("low"), F.col("mean").alias("high"))
    means = resample_means(s, n, seed, resamples, n, 0)
    q = means.agg(F.array_sort(F.collect_list("mean")).alias("m"))  # as long as the number of resamples
    low, high = int(0.025 * (resamples - 1) + 0.5), int(0.975 * (resamples - 1) + 0.5)
    return observed.crossJoin(q).select("pairs", "mean", F.get("m", F.lit(low)).alias("low"), F.get("m", F.lit(high)).alias("high"))


METRICS = ("clicks", "impressions", "ctr", "position")
#: Days of the windows of a measurement, fewest pages of each side (fixed values).
WINDOWS, MIN_TREATED, MIN_CONTROL = (14, 30, 60), 1, 5
_SUMS = tuple(f"{m}_{w}" for w in ("before", "after") for m in ("clicks", "impressions", "weighted"))


def before_after(daily: DataFrame, page: str, change: str, days: int) -> DataFrame:
    """Clicks, impressions and position (weighted by impressions; ``weighted`` is their product) of each page in the closed
    windows ``[change - days, change]`` and ``[change, change + days]``; a page that is missing in one has zeros there. One
    scan and one aggregation for both windows."""
    c = F.lit(change).cast("date")
    inside = daily.where(F.col("date").between(F.date_sub(c, days), F.date_add(c, days)))
    position = F.coalesce("position", F.lit(0.0)) if "position" in daily.columns else F.lit(0.0)
    aggs = []
    for tag, test in (("before", F.col("date") <= c), ("after", F.col("date") >= c)):
        for name, value in (("clicks", F.col("clicks")), ("impressions", F.col("impressions")), ("weighted", position * F.col("impressions"))):
            aggs.append(F.coalesce(F.sum(F.when(test, value)), F.lit(0)).alias(f"{name}_{tag}"))
    return inside.groupBy(page).agg(*aggs)


def _level(metric: str, tag: str, n: Column) -> Column:
    """The level of a group from its sums: per page for counts, over impressions for rates and positions."""
    if metric in ("clicks", "impressions"):
        return F.col(f"{metric}_{tag}") / n
    return F.coalesce(F.col(f"{'clicks' if metric == 'ctr' else 'weighted'}_{tag}") / F.nullif(F.col(f"impressions_{tag}").cast("double"), F.lit(0.0)), F.lit(0.0))


def did(panel: DataFrame, treated: str, metric: str, min_control: int = MIN_CONTROL) -> DataFrame:
    """``kind, treatment, control, effect``: the change of the treated less the change of the others. ``metric`` is one of
    ``METRICS``; clicks and impressions are means for each page. Too few pages on a side, or a rate or position without any
    impressions, is a refusal without an effect."""
    sums = [c for c in _SUMS if c in panel.columns]
    g = panel.groupBy(F.col(treated).alias("t")).agg(F.count("*").alias("n"), *(F.sum(c).cast("double").alias(c) for c in sums))
    change = (_level(metric, "after", F.col("n")) - _level(metric, "before", F.col("n"))).alias("d")
    seen = (F.col("impressions_before") + F.col("impressions_after")) if "impressions_before" in sums else F.lit(1.0)
    one = g.select("t", "n", change, seen.alias("seen")).agg(
        F.coalesce(F.sum(F.when(F.col("t"), F.col("n"))), F.lit(0)).alias("treatment"), F.coalesce(F.sum(F.when(~F.col("t"), F.col("n"))), F.lit(0)).alias("control"),
        F.max(F.when(F.col("t"), F.col("d"))).alias("dt"), F.max(F.when(~F.col("t"), F.col("d"))).alias("dc"), F.coalesce(F.sum("seen"), F.lit(0.0)).alias("seen"),
    )
    kind = F.when(F.col("treatment") < MIN_TREATED, "no-treatment").when(F.col("control") < min_control, "no-control").when(F.lit(metric in ("ctr", "position")) & (F.col("seen") == 0), "no-impressions").otherwise("effect")
    return one.select(kind.alias("kind"), "treatment", "control", F.when(kind == "effect", F.col("dt") - F.col("dc")).alias("effect"))


def _resampled(side: DataFrame, unit: str, n: int, seed: int, resamples: int, per_round: int, skip: int) -> DataFrame:
    """``r`` and the sums of ``n`` draws with replacement among the units of one side, for each resample ``r``."""
    spark = side.sparkSession
    d = spark.range(resamples * n).select(F.expr(f"id div {n}").alias("r"), (F.col("id") % n).alias("k"))
    d = with_draw(d, seed, F.col("r") * per_round + F.lit(skip) + F.col("k") + 1, "u").select("r", F.floor(F.col("u") * n).cast("int").alias("i"))
    s = side.select(F.col(unit).alias("_o"), *(F.col(c).cast("double").alias(c) for c in _SUMS))
    if n <= MAX_ARRAY:
        one = s.agg(F.array_sort(F.collect_list(F.struct("_o", *_SUMS))).alias("a"))
        drawn = d.crossJoin(F.broadcast(one)).select("r", F.get("a", F.col("i")).alias("x")).select("r", *(F.col(f"x.{c}").alias(c) for c in _SUMS))
    else:
        drawn = d.join(indexed(s, "_o", *_SUMS), "i")
    return drawn.groupBy("r").agg(*(F.sum(c).alias(c) for c in _SUMS))


def did_interval(panel: DataFrame, unit: str, treated: str, metric: str, seed: int, resamples: int = 5000, min_control: int = MIN_CONTROL) -> DataFrame:
    """The effect with the percentile interval of resampling units on both sides (a unit brings both its windows; treatment
    draws come first), whether it is significant, and its direction: for positions, lower is better."""
    e = did(panel, treated, metric, min_control)
    na, nb = (panel.where(x).count() for x in (F.col(treated), ~F.col(treated)))
    none = {"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "significant": F.lit(None).cast("boolean"), "direction": F.lit(None).cast("string")}
    if na < MIN_TREATED or nb < min_control:
        return e.withColumns(none)
    full = panel.withColumns({c: F.lit(0.0) for c in _SUMS if c not in panel.columns})
    change = (_level(metric, "after", F.col("n")) - _level(metric, "before", F.col("n"))).alias("d")
    a = _resampled(full.where(F.col(treated)), unit, na, seed, resamples, na + nb, 0).withColumn("n", F.lit(na)).select("r", change.alias("ma"))
    b = _resampled(full.where(~F.col(treated)), unit, nb, seed, resamples, na + nb, na).withColumn("n", F.lit(nb)).select("r", change.alias("mb"))
    q = a.join(b, "r").agg(F.array_sort(F.collect_list(F.col("ma") - F.col("mb"))).alias("m"))  # as long as the number of resamples
    out = e.crossJoin(q).select("kind", "treatment", "control", "effect", *(F.when(F.col("kind") == "effect", F.get("m", F.lit(min(resamples - 1, int(p * resamples))))).alias(n) for p, n in ((0.025, "low"), (0.975, "high"))))
    spread = F.col("high") - F.col("low") > F.greatest(F.abs("effect"), F.lit(1.0)) * 1e-9
    sure = ((F.col("low") > 0) | (F.col("high") < 0)) & spread
    better = (F.col("effect") < 0) if metric == "position" else (F.col("effect") > 0)
    return out.withColumn("significant", sure).withColumn("direction", F.when(F.col("significant"), F.when(better, "better").otherwise("worse")))


def verdict_sentence(days: Column, metric: Column) -> Column:
    """One sentence on a row of ``did_interval``."""
    name = F.when(metric == "clicks", "clicks per page").when(metric == "impressions", "impressions per page").when(metric == "ctr", "click rate").otherwise("position")

    def shown(c: str) -> Column:
        return F.when(metric == "ctr", F.format_string("%.2f pp", F.col(c) * 100)).otherwise(F.format_string("%.2f", F.col(c)))

    start = F.concat(F.lit("After "), days.cast("string"), F.lit(" days, "), name)
    measured = F.concat(start, F.lit(": "), F.when(F.col("effect") >= 0, "+").otherwise(""), shown("effect"), F.lit(" (interval "), shown("low"), F.lit(" to "), shown("high"), F.lit("), "), F.when(F.col("significant"), F.concat("direction", F.lit(" against "), F.col("control").cast("string"), F.lit(" control pages."))).otherwise("not significant yet."))
    return F.when(F.col("kind") == "effect", measured).otherwise(F.concat(start, F.lit(" can't be measured: "), "kind", F.lit(".")))


#: Candidates of a cell of the search for near pages, and about how many cells there are at most.
CELL, MOST_CELLS = 512, 4096
#: Distances that a worker holds at once.
_BLOCK = 1 << 20
_POINT = "page string, x double, y double, z double, depth double"


def _points(df: DataFrame) -> DataFrame:
    """``page, x, y, z, depth``: orders of magnitude of impressions and clicks, position, click depth. Pages that lack one of
    the first three have no distance to others."""
    depth = F.col("depth") if "depth" in df.columns else F.lit(None)
    p = df.select("page", F.log10(F.col("impressions") + 1).alias("x"), F.log10(F.col("clicks") + 1).alias("y"), F.col("position").cast("double").alias("z"), depth.cast("double").alias("depth"))
    return p.where("page is not null and x is not null and y is not null and z is not null")


def _floats(t: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [t.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names]


def page_distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How far each page of ``a`` is from each of ``b`` (both ``x, y, z, depth``): orders of magnitude of impressions and
    clicks, position and click depth (0.5 where either depth is unknown)."""
    x, y, z, depth = (np.abs(u[:, None] - v[None, :]) for u, v in zip(a, b, strict=True))
    return x + y + z / 20 + np.where(np.isnan(depth), 0.5, depth / 5)


def _celled(points: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """``points`` with a ``cell``, about ``CELL`` to each, cut at quantiles of x, then y, then z; and the box of each cell."""
    n = points.count()
    m = max(1, round((n / max(CELL, n / MOST_CELLS)) ** (1 / 3)))
    d = points.withColumn("cell", F.lit(0))
    for c in ("x", "y", "z") if m > 1 else ():
        # an index among quantiles; there are fewer than m * m rows of them
        value = F.col(c)
        at = d.groupBy("cell").agg(F.percentile_approx(c, [i / m for i in range(1, m)]).alias("q"))
        d = d.join(F.broadcast(at), "cell").withColumn("cell", F.col("cell") * m + F.size(F.filter("q", lambda v: v < value))).drop("q")
    d = cut(d, "cells")
    sides = [f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))]
    box = d.groupBy("cell").agg(*sides, F.count("*").alias("n"), (F.count("depth") > 0).alias("deep")).toPandas()
    return d, {c: box[c].to_numpy().astype({"deep": bool, "n": np.int64, "cell": np.int32}.get(c, np.float64)) for c in box.columns}


def _routed(points: DataFrame, boxes: dict[str, np.ndarray], most: int) -> DataFrame:
    """``page, x, y, z, depth, cell``. Without a column ``radius``: the cells that may be nearest, with more than ``most``
    candidates together. With it: the other cells that may hold something within the radius."""
    again = "radius" in points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _BLOCK // max(1, len(boxes["n"])))
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                x, y, z, depth = _floats(b, "x", "y", "z", "depth")
                out = [np.maximum(0, np.maximum(boxes[f"{c}_low"][None, :] - v[:, None], v[:, None] - boxes[f"{c}_high"][None, :])) for c, v in (("x", x), ("y", y), ("z", z))]
                least = out[0] + out[1] + out[2] / 20 + np.where(np.isnan(depth)[:, None] | ~boxes["deep"][None, :], 0.5, 0.0)
                order = np.argsort(least, axis=1, kind="stable")
                counts = boxes["n"][order]
                home = np.zeros(least.shape, dtype=bool)
                np.put_along_axis(home, order, np.cumsum(counts, axis=1) - counts <= most, axis=1)
                use = ~home & (least <= _floats(b, "radius")[0][:, None] + 1e-9) if again else home
                row, cell = np.nonzero(use)
                t = b.select(["page", "x", "y", "z", "depth"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(boxes["cell"][cell], pa.int32())], names=[*t.schema.names, "cell"])

    return points.mapInArrow(run, f"{_POINT}, cell int")


def _near_in_cells(who: DataFrame, celled: DataFrame, most: int) -> DataFrame:
    """``treated, control, distance``: of each cell that a page is sent to, the ``most + 1`` nearest."""

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        got: dict[str, list[np.ndarray]] = {"treated": [], "control": [], "distance": []}
        if a.num_rows and b.num_rows:
            b = b.take(pc.sort_indices(b.column("page")))  # so that a stable sort leaves ties in order of the address
            left, right, k = _floats(a, "x", "y", "z", "depth"), _floats(b, "x", "y", "z", "depth"), min(most + 1, b.num_rows)
            step = max(1, _BLOCK // b.num_rows)
            for i in range(0, a.num_rows, step):
                d = page_distances([v[i : i + step] for v in left], right)
                order = np.argsort(d, axis=1, kind="stable")[:, :k]
                got["treated"].append(np.repeat(np.arange(i, i + len(d)), k))
                got["control"].append(order.ravel())
                got["distance"].append(np.take_along_axis(d, order, axis=1).ravel())
        t, c, d = (np.concatenate(v) if v else np.empty(0, dtype=kind) for v, kind in zip(got.values(), (np.int64, np.int64, np.float64), strict=True))
        return pa.table({"treated": a.column("page").take(pa.array(t)), "control": b.column("page").take(pa.array(c)), "distance": d})

    return who.groupBy("cell").cogroup(celled.select("page", "x", "y", "z", "depth", "cell").groupBy("cell")).applyInArrow(near, "treated string, control string, distance double")


def _nearest(who: DataFrame, free: DataFrame, most: int) -> DataFrame:
    """``treated, control, distance, more``: the ``most`` nearest candidates, by distance, then address, and whether there are
    others. Cells around a page give a radius that holds enough; then only cells that it touches are searched."""
    celled, boxes = _celled(free)
    first = cut(_near_in_cells(_routed(who, boxes, most), celled, most), "near")
    radius = first.groupBy(F.col("treated").alias("page")).agg(F.coalesce(F.get(F.sort_array(F.collect_list("distance")), F.lit(most)), F.lit(float("inf"))).alias("radius"))
    around = who.join(radius, "page")
    second = _near_in_cells(_routed(around, boxes, most), celled, most).join(radius.withColumnRenamed("page", "treated"), "treated").where("distance <= radius").drop("radius")
    by = Window.partitionBy("treated")
    ranked = first.unionByName(second).withColumn("n", F.row_number().over(by.orderBy("distance", "control"))).where(F.col("n") <= most + 1)
    return ranked.withColumn("more", F.max("n").over(by) > most).where(F.col("n") <= most).select("treated", "control", "distance", "more")


def control_group(treatment: DataFrame, candidates: DataFrame, rounds: int = 4, nearest: int = 16) -> DataFrame:
    """``treated, control, distance, round``: in each round every treated page takes its nearest candidate that is free;
    one that two want goes to the nearer, then the smaller address, and the other chooses again. The nearest candidates of a
    page are found first; a page that finds them all taken is searched again among what is free."""
    treated, free = cut(_points(treatment), "treated"), cut(_points(candidates), "free")
    most = nearest * rounds
    pairs = cut(_nearest(treated, free, most), "control")
    out = None
    for r in range(1, rounds + 1):
        left = treated.select(F.col("page").alias("treated"))
        while True:
            open_ = pairs.join(left, "treated", "left_semi")
            gone = F.lit(False)
            if out is not None:
                open_, gone = open_.join(out.select("control", F.lit(True).alias("gone")), "control", "left"), F.coalesce("gone", F.lit(False))
            best = open_.groupBy("treated").agg(F.min(F.when(~gone, F.struct("distance", "control"))).alias("m"), F.max("more").alias("more"))
            # one that has nothing free among its nearest, and no others, has nothing left
            best = best.where("m is not null or more").select("treated", "m.distance", "m.control")
            first = F.row_number().over(Window.partitionBy("control").orderBy("distance", "treated")) == 1
            want = cut(best.withColumn("won", F.col("control").isNotNull() & first), "want")
            n = want.agg(F.count("*").alias("all"), F.count_if("won").alias("won"), F.count_if(F.col("control").isNull()).alias("unsure")).first()
            if n["unsure"]:
                unsure = want.where("control is null").select("treated")
                rest = free.join(out.select(F.col("control").alias("page")), "page", "left_anti")
                found = _nearest(treated.join(unsure.withColumnRenamed("treated", "page"), "page", "left_semi"), rest, most)
                pairs = cut(pairs.join(unsure, "treated", "left_anti").unionByName(found), "control")
                left = want.select("treated")
                continue
            if n["won"]:
                won = want.where("won").select("treated", "control", "distance", F.lit(r).alias("round"))
                out = won if out is None else out.unionByName(won)
            if n["won"] == n["all"]:
                break
            left = want.where("not won").select("treated")
    return out if out is not None else pairs.limit(0).select("treated", "control", "distance", F.lit(1).alias("round"))


def shortfall(treatment: DataFrame, matches: DataFrame, rounds: int = 4) -> DataFrame:
    """``wanted, matched, missing``: how many control pages the treated ones lack."""
    return treatment.agg((F.count("*") * rounds).alias("wanted")).crossJoin(matches.agg(F.count("*").alias("matched"))).withColumn("missing", F.col("wanted") - F.col("matched"))


def expected_ctr(position: Column) -> Column:
    i = F.least(F.greatest(F.floor(position + 0.5).cast("int"), F.lit(1)), F.lit(len(CTR)))
    return F.element_at(F.array(*map(F.lit, CTR)), i)


def click_upside(impressions: Column, position: Column, target: int = 3) -> Column:
    """Clicks gained by moving up to the target position; none for pages that are there."""
    return F.when(position <= target, 0.0).otherwise(impressions * (expected_ctr(F.lit(float(target))) - expected_ctr(position)))


def score(impact: Column, confidence: Column, fit: Column, effort: Column, risk: Column) -> Column:
    return impact * confidence * fit / (F.greatest(effort, F.lit(0.1)) * F.greatest(risk, F.lit(0.1)))
