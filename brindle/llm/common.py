"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and text bytes that a Python worker holds at once.
CHUNK_ROWS, CHUNK_BYTES = 2000, 8 << 20


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has few rows and, unless one row alone is larger, few bytes."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        step = max(1, min(CHUNK_ROWS, int(n * CHUNK_BYTES / max(b.nbytes, 1))))
        for i in range(0, n, step):
            yield b.slice(i, step)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: a table in few files would leave most of them idle
    in a pass of Python work. Tables in many files are passed on as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
