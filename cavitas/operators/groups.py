"""Rows of whole keys in Python, many keys a batch: a small group's call would cost more than its work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _starts(table: pa.Table, key: tuple[str, ...]) -> list[int]:
    """Where a key's rows begin, the first row's aside."""
    change = np.zeros(max(len(table) - 1, 0), bool)
    for c in key:
        column = table[c].combine_chunks()
        change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return (np.nonzero(change)[0] + 1).tolist()


def map_keys(rows: DataFrame, key: tuple[str, ...], order: list, run: Callable[[pa.Table, list[int]], pa.Table], schema: str) -> DataFrame:
    """run on tables of whole keys, each key's rows in their order, and the bounds of the keys: key i has rows bounds[i] to bounds[i + 1] - 1.

    A table holds the keys that end in one batch of Arrow; memory is that of a batch and of one key's rows. Rows come along with their place in the key.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(parts).combine_chunks()
            yield from run(table, [0, *_starts(table, key), len(table)]).to_batches()

        held: list[pa.Table] = []  # rows of a key that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            starts = _starts(table, key)
            if held and any(held[-1][c][-1] != table[c][0] for c in key):
                starts = [0, *starts]
            if starts:
                if held or starts[-1]:
                    yield from done([*held, table.slice(0, starts[-1])])
                held = [table.slice(starts[-1])]
            else:
                held.append(table)
        if held:
            yield from done(held)

    # the window puts a key's rows into one task, in their order
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return placed.sortWithinPartitions(*key, "place").mapInArrow(each, schema)
