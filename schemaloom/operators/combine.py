"""Sums of many groups in bounded memory, however many rows a task reads.

Before the shuffle, rows meet in chunks of ``CHUNK``, so that hot keys become small and a task never holds more than a
chunk; after it, a partition gets ``SHARE`` rows at most, as there are as many partitions as the rows need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK, SHARE = 1 << 18, 1 << 20


def chunks(summed: Callable[[pa.Table], pa.RecordBatch | pa.Table], size: int = CHUNK, most: int = 64 << 20) -> Callable:
    """A function for mapInArrow: ``summed`` of every ``size`` rows, or ``most`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, space = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, space = rows + batch.num_rows, space + batch.nbytes
            if rows >= size or space >= most:
                yield from summed(pa.Table.from_batches(held)).to_batches()
                held, rows, space = [], 0, 0
        if rows:
            yield from summed(pa.Table.from_batches(held)).to_batches()

    return run


def shares(rows: int) -> int:
    """Partitions in which so many rows meet."""
    return max(1, -(-rows // SHARE))


def dealt(partial: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The rows by their keys, in partitions of bounded size; a grouping by these keys needs no further shuffle."""
    return partial.repartition(shares(rows), *keys)
