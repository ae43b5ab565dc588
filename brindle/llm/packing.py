"""Problem 9: filling containers of fixed capacity with items.

Hierarchical residual packing. Every partition packs its own items best-fit decreasing (blocks of bounded size on top of
the bins still open) and closes the bins that are nearly full. The underfull ones go on as single items of their used
size: they are spread over fewer partitions, packed best-fit again, and so on up a tree until one task packs the rest or
a round no longer pays. Documents never move after the first round except inside their bin, and a task never holds more
than ``merge_bins`` bins (or its own input), so no step grows with the corpus.

An item larger than the capacity is cut into full containers and one remainder (``part`` numbers the pieces); all other
items stay whole. Defined cases: items of size 0 (null or empty texts) take no space and are put into existing bins, at
most ``capacity`` of them into one; a negative size counts as 0, a null size as 0; a capacity below 1 or null is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import cut

#: Share of the capacity from which a bin counts as nearly full; items packed at once; bins of one merging task.
FULL, BLOCK_ITEMS, MERGE_BINS = 0.985, 50_000, 50_000
#: Most container kinds (they are parameters, sent to every task).
MAX_KINDS = 1000

BINS = "container string, capacity int, bin_id bigint, used int, full boolean, docs array<bigint>, parts array<int>, tokens array<int>"


class BestFit:
    """Open bins of one capacity; a bitmap of the free sizes finds the tightest one in a few machine operations."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.free: dict[int, list[list]] = {}
        self.mask = 0

    def add(self, size: int) -> list:
        """The bin ``[used, payload]`` that takes the item: the fullest one with room, else a new one."""
        m = self.mask >> size
        if m:
            room = size + (m & -m).bit_length() - 1
            stack = self.free[room]
            b = stack.pop()
            if not stack:
                self.mask ^= 1 << room
        else:
            b = [0, []]
        b[0] += size
        left = self.capacity - b[0]
        self.free.setdefault(left, []).append(b)
        self.mask |= 1 << left
        return b

    def take(self, upto: int) -> list[list]:
        """Removes and returns the bins with at most ``upto`` free."""
        out = []
        for room in [r for r in self.free if r <= upto]:
            out += self.free.pop(room)
            self.mask &= ~(1 << room)
        return out


def _batch(kind: str, capacity: int, bins: list[list], full: bool, first_id: int) -> pa.RecordBatch:
    """Bins ``[used, [(doc, part, tokens), ...]]`` as rows of ``BINS``."""
    lens = [len(b[1]) for b in bins]
    offsets = pa.array(np.concatenate(([0], np.cumsum(lens))).astype(np.int32))
    flat = [x for b in bins for x in b[1]]

    def col(i: int, t: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(offsets, pa.array([x[i] for x in flat], t))

    n = len(bins)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * n, pa.string()), pa.array([capacity] * n, pa.int32()), pa.array(range(first_id, first_id + n), pa.int64()),
            pa.array([b[0] for b in bins], pa.int32()), pa.array([full] * n), col(0, pa.int64()), col(1, pa.int32()), col(2, pa.int32()),
        ],
        names=["container", "capacity", "bin_id", "used", "full", "docs", "parts", "tokens"],
    )


class _Ids:
    """Bin ids that are unique over rounds and partitions."""

    def __init__(self, round_no: int) -> None:
        ctx = TaskContext.get()
        self.next = (round_no << 56) | ((ctx.partitionId() if ctx else 0) << 32)

    def take(self, n: int) -> int:
        first, self.next = self.next, self.next + n
        return first


def _pack_local(items: DataFrame, kinds: list[tuple[str, int]], full: float, block: int) -> DataFrame:
    """Bins of each partition's own items ``(doc_id, tokens)``, for every container kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(0)
        open_bins = {k: BestFit(c) for k, c in kinds}
        empty: list[int] = []
        sizes: list[tuple[int, int]] = []

        def emit(kind: str, cap: int, bins: list[list], done: bool) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(bins), 5000):
                part = bins[i : i + 5000]
                yield _batch(kind, cap, part, done, ids.take(len(part)))

        def flush() -> Iterator[pa.RecordBatch]:
            sizes.sort(key=lambda x: (-x[1], x[0]))
            for kind, cap in kinds:
                fit, whole = open_bins[kind], []
                rest: list[tuple[int, int, int]] = []
                for doc, n in sizes:
                    if n <= cap:
                        rest.append((doc, 0, n))
                        continue
                    pieces = n // cap
                    whole += [[cap, [(doc, p, cap)]] for p in range(pieces)]
                    if n % cap:
                        rest.append((doc, pieces, n % cap))
                    if len(whole) >= 5000:
                        yield from emit(kind, cap, whole, True)
                        whole = []
                rest.sort(key=lambda x: -x[2])
                for x in rest:
                    fit.add(x[2])[1].append(x)
                yield from emit(kind, cap, whole + fit.take(int(cap * (1 - full))), True)
            sizes.clear()

        for b in batches:
            for doc, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n and n > 0:
                    sizes.append((doc, n))
                    if len(sizes) >= block:
                        yield from flush()
                else:
                    empty.append(doc)
        if sizes:
            yield from flush()
        for kind, cap in kinds:
            bins = open_bins[kind].take(cap)
            at = 0
            for b in bins:
                take = empty[at : at + cap - len(b[1])]
                b[1] += [(d, 0, 0) for d in take]
                at += len(take)
            while at < len(empty):
                bins.append([0, [(d, 0, 0) for d in empty[at : at + cap]]])
                at += cap
            yield from emit(kind, cap, bins, False)

    return items.select("doc_id", "tokens").mapInArrow(run, BINS)


def _merge(bins: DataFrame, full: float, round_no: int) -> DataFrame:
    """Best fit of underfull bins as items; the contents of merged bins are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(round_no)
        rows: dict[tuple[str, int], list] = {}
        for b in batches:
            for r in b.to_pylist():
                rows.setdefault((r["container"], r["capacity"]), []).append((r["used"], r["bin_id"], r["docs"], r["parts"], r["tokens"]))
        for (kind, cap), items in sorted(rows.items()):
            fit = BestFit(cap)
            for used, _, docs, parts, tokens in sorted(items, key=lambda x: (-x[0], x[1])):
                fit.add(used)[1].extend(zip(docs, parts, tokens))
            for done, group in ((True, fit.take(int(cap * (1 - full)))), (False, fit.take(cap))):
                for i in range(0, len(group), 5000):
                    part = group[i : i + 5000]
                    yield _batch(kind, cap, part, done, ids.take(len(part)))

    return bins.mapInArrow(run, BINS)


def pack(items: DataFrame, kinds: list[tuple[str, int]], full: float = FULL, block: int = BLOCK_ITEMS, merge_bins: int = MERGE_BINS) -> DataFrame:
    """Bins (``BINS``) for the items ``(doc_id bigint, tokens)`` in each container kind ``(name, capacity)``."""
    if not kinds or len(kinds) > MAX_KINDS or any(c is None or c < 1 for _, c in kinds):
        raise ValueError("container kinds are 1 to 1000 pairs of a name and a capacity of at least 1")
    state = cut(_pack_local(items, kinds, full, block), "bins")
    done, before = [state.where("full")], None
    for round_no in count(1):
        rest = state.where("not full")
        n = rest.count()
        if n <= len(kinds) or (before is not None and n >= before):
            break
        tasks = -(-n // merge_bins)
        spread = rest.repartition(tasks, F.xxhash64("bin_id", F.lit(round_no))) if tasks > 1 else rest.coalesce(1)
        state = cut(_merge(spread, full, round_no), "bins")
        done.append(state.where("full"))
        if tasks == 1:
            break
        before = n
    out = state.where("not full")
    for d in done:
        out = out.unionByName(d)
    return out


def assignments(bins: DataFrame) -> DataFrame:
    """``container, bin_id, doc_id, part, tokens``: one row for each item or piece of an item."""
    return bins.select("container", "bin_id", F.explode(F.arrays_zip("docs", "parts", "tokens")).alias("x")).select(
        "container", "bin_id", F.col("x.docs").alias("doc_id"), F.col("x.parts").alias("part"), F.col("x.tokens").alias("tokens")
    )


def summary(bins: DataFrame) -> DataFrame:
    """For each container kind: bins, tokens, fill rate, and the bins that no packing can go below."""
    return (
        bins.groupBy("container", "capacity")
        .agg(F.count("*").alias("bins"), F.sum("used").alias("tokens"))
        .withColumn("fill", F.col("tokens") / (F.col("bins") * F.col("capacity")))
        .withColumn("least_bins", F.ceil(F.col("tokens") / F.col("capacity")).cast("bigint"))
    )
