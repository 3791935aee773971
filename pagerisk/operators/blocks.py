"""Bringing rows of two tables together that may match, without pairing them.

Used when the smaller side is too large to broadcast. Both sides are dealt to tasks of
bounded size by what partners have in common, a band of lengths or a bucket; the function
of a task sends back at most one row per left row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_BYTES = 256 << 20
BLOCK_BYTES = 64 << 20


def compare_in_bands(
    left: DataFrame,
    left_key: str,
    right: DataFrame,
    right_key: str,
    ratio: float,
    row_bytes: int,
    block_bytes: int,
    compare: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """Rows of ``compare(left block, right block)`` over strings of comparable length.

    Partners are strings whose lengths differ by at most the factor ``ratio`` (over 1). A
    right row lies in one band of lengths of that width, a left row goes to its own band and
    the two beside it. A band is cut into blocks by bytes on either side, so one very long
    string weighs on its own band only.
    """
    width = math.log(ratio)

    def band(key: str) -> Column:
        return F.floor(F.log(F.greatest(F.length(key), F.lit(1))) / width).cast("int")

    def blocks(rows: DataFrame, key: str) -> dict[int, int]:
        size = F.sum(row_bytes + 4 * F.length(key))
        # One row per band: their number grows with the logarithm of the longest string.
        found = rows.groupBy("__band").agg(size.alias("size")).collect()
        return {row["__band"]: max(1, math.ceil(row["size"] / block_bytes)) for row in found}

    near = F.array(*(band(left_key) + step for step in (-1, 0, 1)))
    lefts = left.withColumn("__band", F.explode(near))
    rights = right.withColumn("__band", band(right_key))
    left_blocks, right_blocks = blocks(lefts, left_key), blocks(rights, right_key)
    shared = sorted(left_blocks.keys() & right_blocks.keys())
    if not shared:
        return left.sparkSession.createDataFrame([], schema)

    def dealt(rows, key, own, own_blocks, other, other_blocks):
        def count(numbers):
            pairs = [F.lit(n) for band in shared for n in (band, numbers[band])]
            return F.create_map(*pairs)[F.col("__band")]

        number = F.pmod(F.xxhash64(key), count(own_blocks)).cast("int")
        every = F.sequence(F.lit(0), count(other_blocks) - 1)
        there = rows.filter(F.col("__band").isin(shared))
        return there.withColumn(own, number).withColumn(other, F.explode(every))

    keys = ["__band", "__l", "__r"]
    lefts = dealt(lefts, left_key, "__l", left_blocks, "__r", right_blocks)
    rights = dealt(rights, right_key, "__r", right_blocks, "__l", left_blocks)
    return lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInArrow(compare, schema)


CELL_ROWS = 65536
_MOST_TASKS = 8192


def compare_in_cells(
    left: DataFrame,
    left_counts: np.ndarray,
    right: DataFrame,
    right_counts: np.ndarray,
    key: str,
    compare: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Rows of ``compare(left rows, right rows)`` over rows that agree in a bucket column.

    ``key`` is a bucket number and the counts tell how many rows of either side each bucket
    has; their number is fixed, so the plan made from them is small however many rows there
    are. Buckets are packed into cells of about ``cell_rows``; one with more rows is a grid
    of cells of its own, of bounded size on both sides. Buckets of one side only are left out.
    """
    shared = np.flatnonzero((left_counts > 0) & (right_counts > 0))
    if not len(shared):
        return left.sparkSession.createDataFrame([], schema)
    across = [np.ceil(counts[shared] / cell_rows).astype(np.int64) for counts in (left_counts, right_counts)]
    light = (across[0] == 1) & (across[1] == 1)
    weight = np.where(light, left_counts[shared] + right_counts[shared], 0)
    cell = np.cumsum(weight) // cell_rows
    cell = np.where(light, cell, cell.max() + 1 + np.cumsum(~light))
    plan = pa.table({key: shared, "__cell": cell, "__ls": across[0], "__rs": across[1]})

    def dealt(rows: DataFrame, own: str, count: str, other: str, others: str) -> DataFrame:
        spread = F.pmod(F.xxhash64(*rows.columns), F.col(count)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(others).cast("int") - 1))
        # A row for each bucket at most; each side has a table of its own to join.
        there = rows.join(F.broadcast(left.sparkSession.createDataFrame(plan)), key)
        return there.withColumn(own, spread).withColumn(other, every).drop("__ls", "__rs")

    keys = ["__cell", "__l", "__r"]
    # A cell is little to shuffle and much to compare, so cells are not put together by bytes.
    tasks = min(2 * int((across[0] * across[1])[~light].sum() + len(np.unique(cell[light]))), _MOST_TASKS)
    lefts = dealt(left, "__l", "__ls", "__r", "__rs").repartition(tasks, *keys)
    rights = dealt(right, "__r", "__rs", "__l", "__ls").repartition(tasks, *keys)
    return lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInArrow(compare, schema)
