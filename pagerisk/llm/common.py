"""Helpers that several corpus operators share."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# ASCII white space is what separates words everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
_NO_ID = -(2**63)
#: Bits of the table that keeps rows without a partner out of a shuffle, and of one of its parts.
_FILTER_BITS = 1 << 24
_PART_BITS = 1 << 15


def row_key(id_col: str, text_col: str) -> Column:
    """Two longs that tell rows of different id or text apart; NULLs are values of their own."""
    ident = F.col(id_col).cast("long")
    text = F.col(text_col)
    return F.struct(
        F.coalesce(ident, F.lit(_NO_ID)).alias("d"),
        F.xxhash64(text, ident.isNull(), text.isNull()).alias("h"),
    )


def running_total(
    rows: DataFrame, groups: list[str], cells: list[str], order: list[str], value: str, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to and with each row, in the order of a group.

    ``cells`` are two integer columns that cut the order of a group coarsely and then
    finely. Only the rows of one cell are sorted together, sums of cells supply the rest,
    so a group may hold any share of the table.
    """
    coarse, fine = cells
    sums = rows.groupBy(*groups, coarse, fine).agg(F.sum(value).alias("_cell"))
    tops = sums.groupBy(*groups, coarse).agg(F.sum("_cell").alias("_top"))
    before = (Window.unboundedPreceding, -1)
    tops = tops.withColumn(
        "_before_top",
        F.sum("_top").over(Window.partitionBy(*groups).orderBy(coarse).rowsBetween(*before)),
    ).drop("_top")
    sums = sums.withColumn(
        "_before_cell",
        F.sum("_cell").over(Window.partitionBy(*groups, coarse).orderBy(fine).rowsBetween(*before)),
    ).drop("_cell")
    offsets = _join(sums, tops, [*groups, coarse]).select(
        *groups,
        *cells,
        (
            F.coalesce("_before_top", F.lit(0)) + F.coalesce("_before_cell", F.lit(0))
        ).alias("_offset"),
    )
    inside = Window.partitionBy(*groups, *cells).orderBy(*order)
    own = rows.withColumn(
        "_own", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        _join(own, offsets, [*groups, *cells])
        .withColumn(name, F.col("_own") + F.col("_offset"))
        .drop("_own", "_offset")
    )


def known_longs(rows: DataFrame, column: str) -> Callable[[str], Column]:
    """A test that is true for every value of a column of longs, and false for most others.

    It goes before a join, so that rows without a partner are not shuffled. Values leave marks
    in a table of 2 MB, whatever their number; the fuller it is, the more rows pass.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(_FILTER_BITS))
    at = rows.select((place(column) + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")
    )
    marks = np.zeros((_FILTER_BITS // _PART_BITS, _PART_BITS // 8), np.uint8)
    for row in parts.collect():
        marks[row["part"] - 1] = np.frombuffer(row["bits"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(marks.reshape(-1))

    @F.arrow_udf("boolean")
    def known(places: pa.Array) -> pa.Array:
        at = places.to_numpy()
        return pa.array((shared.value[at >> 3] >> (at & 7)) & 1 == 1)

    return lambda c: known(place(c))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys)


class Hashed(dict):
    """Bucket of each name; names are few and come again and again."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, name: str) -> int:
        self[name] = bucket = zlib.crc32(name.encode()) % self.buckets
        return bucket


def utf8_rows(column):
    """Bytes of each value of an Arrow string array; None for NULL."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
