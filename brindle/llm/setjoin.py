"""Exact similarity joins of sets under a Jaccard threshold, as a blocked sparse product.

A collection of sets is a sparse matrix (set x item); the overlaps of all pairs are its product with its transpose.
``candidate_pairs`` computes the part of that product that can hold pairs above the threshold:

* items are put in one global order, rare ones first (``item_counts``: a count table of fixed size, so the order needs
  no join with the item frequencies and what is broadcast never grows with the data);
* of each set only its rarest items are multiplied. A set of ``n`` items needs ``n - ceil(t n) + l`` of them as a probe
  and ``n - ceil(2 t n / (1 + t)) + l`` as the smaller partner: a pair above ``t`` meets on at least ``l`` of them;
* the product is a shuffle join on the item (the block), overlap counts are accumulated with map-side combine, and a
  pair is discarded by bounds derived from the sizes: size ratio, position of the shared item, and fewer than ``l`` hits;
* items in very many sets are blocked further by the partner's size: the position of such an item in a set leaves only
  few sizes that a partner may have, so sets that share nothing but that item never meet.

No cap, no sampling: every pair at or above the threshold is a candidate. ``verified`` computes exact overlaps.
Identical sets must be collapsed to one row before (a class), or a group of copies would be quadratic here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import cut

#: Buckets of the item count table (4 bytes each): its size is a parameter, not a function of the data.
COUNT_BITS = 20
#: An item in a bucket of more sets than this is blocked by partner size, too; what other items add to a bucket on average
#: is taken off twice, or in a large table every bucket would be hot.
HOT = 256
#: Items, and postings of hot items, that a Python worker holds at once.
CHUNK_ITEMS = 1 << 18
#: Bits of a packed one-bit minhash code, and the probability with which its filter may lose a pair at the threshold.
CODE_BITS, LOSS = 256, 1e-10

_EPS = 1e-9


def item_counts(classes: DataFrame, bits: int = COUNT_BITS) -> np.ndarray:
    """How many sets hold an item of each of ``2 ** bits`` hash buckets. At most that many rows reach the driver."""
    rows = (
        classes.select(F.explode("items").alias("x"))
        .groupBy(F.pmod(F.col("x"), F.lit(1 << bits)).cast("int").alias("k"))
        .agg(F.least(F.count("*"), F.lit(2**31 - 1)).cast("int").alias("n"))
        .where("n > 1")
        .toPandas()
    )
    counts = np.ones(1 << bits, dtype=np.int32)
    counts[rows["k"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int32)
    return counts


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each."""
    lens = np.diff(np.asarray(col.offsets))
    return np.asarray(col.flatten()).astype(np.int64), np.repeat(np.arange(len(col)), lens)


def _ordered(col: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items of all rows in the global order: row, item, position in the row, count of the item, size of each row."""
    x, row = _flat(col)
    c = counts[np.mod(x, len(counts))]
    at = np.lexsort((x, c, row))
    x, row, c = x[at], row[at], c[at]
    n = np.bincount(row, minlength=len(col)).astype(np.int64)
    pos = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    return row, x, pos, c, n


def _ceil(v: np.ndarray) -> np.ndarray:
    return np.ceil(v - _EPS).astype(np.int64)


def radius_for(t: float, bits: int = CODE_BITS, loss: float = LOSS) -> int:
    """The Hamming radius that a pair of similarity ``t`` exceeds with a probability below ``loss``: a bit of its codes
    differs with probability ``(1 - t) / 2``, so the distance is binomial."""
    p = (1 - t) / 2
    if p <= 0:
        return 0
    tail = 0.0
    for r in range(bits, -1, -1):
        tail += math.exp(math.lgamma(bits + 1) - math.lgamma(r + 1) - math.lgamma(bits - r + 1) + r * math.log(p) + (bits - r) * math.log1p(-p))
        if tail >= loss:
            return r
    return 0


def _hot(counts: np.ndarray) -> float:
    """The count from which a bucket is hot: ``HOT`` above what the other items of a full table put in each bucket."""
    return HOT + 2 * (float(counts.mean()) - 1)


def _slices(b: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` values in a list column, or one row."""
    ends = np.cumsum(np.diff(np.asarray(b.column(b.schema.get_field_index(column)).offsets)).astype(np.int64))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield b.slice(at, to - at)
        at = to


def _emit(batch: pa.RecordBatch, keep: list[str], row: np.ndarray, cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    taken = {k: batch.column(batch.schema.get_field_index(k)).take(pa.array(row)) for k in keep}
    return pa.RecordBatch.from_pydict({**taken, **{k: pa.array(v) for k, v in cols.items()}})


def _postings(classes: DataFrame, keep: list[str], counts: np.ndarray, t: float, hits: int, probe: bool) -> DataFrame:
    """Rows (keep, tok, at) of the probe or the index side. ``tok`` mixes the item, its ``src`` and, for hot items, the
    partner's size, so that one number is the join key; ``at`` packs the size of the set and the place of the item in it."""
    shared = classes.sparkSession.sparkContext.broadcast(counts)

    from_count, most = _hot(counts), CHUNK_ITEMS

    def of(b: pa.RecordBatch, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, x, pos, c, n = _ordered(b.column(b.schema.get_field_index("items")), table)
        part = t if probe else 2 * t / (1 + t)
        length = np.minimum(n, n - _ceil(part * n) + hits)
        use = (pos < length[row]) & (c > 1)
        row, x, pos, hot = row[use], x[use], pos[use], c[use] > from_count
        size, low, times = n[row], np.zeros(len(row), dtype=np.int64), np.ones(len(row), dtype=np.int64)
        if hot.any():
            if probe:
                high = np.minimum(size, np.floor((size - pos + hits - 1) * (1 + t) / t - size + _EPS).astype(np.int64))
                low = np.where(hot, _ceil(t * size), 0)
                times = np.where(hot, np.maximum(high - low + 1, 0), 1)
            else:
                low = np.where(hot, size, 0)
        names = b.column(b.schema.get_field_index("src")).to_pylist()
        known = {s: xxhash.xxh3_64_intdigest(s or "") for s in set(names)}
        src = np.fromiter((known[s] for s in names), dtype=np.uint64, count=len(names))
        ends = np.cumsum(times)
        first = 0
        while first < len(row):  # so many at a time, for a hot item of a probe has a posting for each partner's size
            last = max(first + 1, int(np.searchsorted(ends, most + (ends[first - 1] if first else 0), "right")))
            k = times[first:last]
            at = np.repeat(np.arange(first, last), k)
            m = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
            tok = x[at].view(np.uint64) ^ src[row[at]] ^ (m.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield _emit(b, keep, row[at], {"tok": tok.view(np.int64), "at": (size[at] << 32) | pos[at]})
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, "items", most):
                yield from of(part, shared.value)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema if f.name in keep)
    return classes.select(*keep, "src", "items").mapInArrow(run, f"{kinds}, tok bigint, at bigint")


def candidate_pairs(classes: DataFrame, t: float, hits: int = 1, counts: np.ndarray | None = None, codes: list[str] | None = None, radius: int | None = None) -> DataFrame:
    """Pairs ``(a, b)`` of classes of one ``src`` that may have a Jaccard similarity of at least ``t``; ``a`` is the larger set.

    ``classes``: ``src, cid, items array<bigint>`` (distinct items, no null; ``cid`` is unique over all ``src``) and, where
    ``codes`` names them, the words of a packed one-bit minhash code: pairs farther apart than ``radius`` bits (by default
    ``radius_for(t)``) are dropped before any set is fetched. ``hits`` must not exceed the overlap of the smallest pair that
    is to be found. Run it on a written table: it is read three times.
    """
    if not 0 < t <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    counts = item_counts(classes) if counts is None else counts
    keep = ["cid", *(codes or [])]

    def side(name: str, probe: bool) -> DataFrame:
        p = _postings(classes, keep, counts, t, hits, probe)
        return p.select(*(F.col(c).alias(f"{c}_{name}") for c in keep), "tok", F.shiftright("at", 32).alias(f"n_{name}"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"p_{name}"))

    na, nb = F.col("n_a"), F.col("n_b")
    alpha = F.ceil(F.lit(t / (1 + t)) * (na + nb) - F.lit(_EPS))
    room = F.lit(hits) + F.least(na - F.col("p_a"), nb - F.col("p_b")) - 1
    on = ((na > nb) | ((na == nb) & (F.col("cid_a") < F.col("cid_b")))) & (nb >= F.lit(t) * na - F.lit(_EPS)) & (room >= alpha)
    if codes:
        far: Column = F.lit(0)
        for c in codes:
            far = far + F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
        on = on & (far <= (radius_for(t) if radius is None else radius))
    met = side("a", True).join(side("b", False), "tok").where(on).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))
    if hits == 1:
        return met.distinct()
    return met.groupBy("a", "b").agg(F.count("*").alias("_met")).where(F.col("_met") >= hits).drop("_met")


def verified(pairs: DataFrame, sets: DataFrame, column: str, t: float) -> DataFrame:
    """``src, a, b, overlap, jaccard`` of the ``pairs (a, b)`` whose exact similarity of ``column`` (an array of distinct values)
    is at or above ``t``. The pairs are written first: their size is then known, and only the sets of classes in a pair
    move (none, where the list of those classes is small enough to be broadcast)."""
    p = cut(pairs.select("a", "b"), "pairs")
    inside = cut(p.select(F.col("a").alias("cid")).unionAll(p.select(F.col("b").alias("cid"))).distinct(), "inside")
    s = sets.select("src", "cid", F.col(column).alias("v")).join(inside, "cid", "left_semi")
    x = (
        p.join(s.select("src", F.col("cid").alias("a"), F.col("v").alias("va")), "a")
        .join(s.select(F.col("cid").alias("b"), F.col("v").alias("vb")), "b")
        .withColumn("overlap", F.size(F.array_intersect("va", "vb")))
        .withColumn("jaccard", F.col("overlap") / (F.size("va") + F.size("vb") - F.col("overlap")))
    )
    return x.where(F.col("jaccard") >= F.lit(t) - F.lit(_EPS)).select("src", "a", "b", "overlap", "jaccard")


def one_bit_codes(df: DataFrame, bits: int = CODE_BITS, seed: int = 0x5EED) -> tuple[DataFrame, list[str]]:
    """``df`` with one-bit minhashes of ``items``, packed into columns of 64 bits. Sets without items get zeros."""
    words = bits // 64
    names = [f"code{i}" for i in range(words)]
    rng = np.random.default_rng(seed)
    mults, adds = rng.integers(1, 2**63, bits, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, bits, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column(b.schema.get_field_index("items"))
            x, row = _flat(col)
            code = np.zeros((b.num_rows, words), dtype=np.uint64)
            if len(x):
                rows, starts = np.unique(row, return_index=True)
                u = x.view(np.uint64)
                for j in range(bits):
                    h = u * mults[j] + adds[j]
                    h ^= h >> np.uint64(32)
                    h *= np.uint64(0xD6E8FEB86659FD93)
                    h ^= h >> np.uint64(29)
                    code[rows, j // 64] |= (np.minimum.reduceat(h, starts) & np.uint64(1)) << np.uint64(j % 64)
            cols = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            yield pa.RecordBatch.from_pydict({**cols, **{n: pa.array(code[:, i].view(np.int64)) for i, n in enumerate(names)}})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, {', '.join(f'{n} bigint' for n in names)}"), names


def pairs_of_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of member ids ``(src, id_a, id_b)``, ``id_a < id_b``: those between similar classes and those within one.

    ``members``: distinct ``src, cid, id``. Only for results that are defined as pairs of rows; a class of k copies has
    k (k - 1) / 2 of them.
    """
    m = members.select("src", "cid", "id")
    left, right = m.select("src", F.col("cid").alias("a"), F.col("id").alias("x")), m.select("src", F.col("cid").alias("b"), F.col("id").alias("y"))
    between = pairs.select("src", "a", "b").join(left, ["src", "a"]).join(right, ["src", "b"]).select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    within = (
        left.join(right, (left["src"] == right["src"]) & (left["a"] == right["b"]) & (left["x"] < right["y"]))
        .select(left["src"].alias("src"), F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    )
    return between.unionByName(within)


def needed(n: int, t: float) -> int:
    """The overlap that two sets of ``n`` items need for a similarity of ``t``."""
    return math.ceil(2 * n * t / (1 + t) - _EPS)
