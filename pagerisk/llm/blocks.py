"""Comparing the members of groups of any size in tasks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _blocks(weight: Column, members: Column, limit: int, most: int) -> Column:
    count = F.greatest(F.ceil(weight / F.lit(limit)), F.ceil(members / F.lit(most)), F.lit(1))
    return count.cast("int")


def own_blocks(
    rows: DataFrame, group: str, ident: str, weight: str, limit: int, most: int
) -> DataFrame:
    """Cut each group into blocks of about ``limit`` weight and ``most`` members, by a hash.

    Adds columns _blocks, how many the group has, and _block, the row's own.
    """
    totals = rows.groupBy(group).agg(
        _blocks(F.sum(weight), F.count("*"), limit, most).alias("_blocks")
    )
    own = F.pmod(F.xxhash64(ident), F.col("_blocks")).cast("int")
    return rows.join(totals, group).withColumn("_block", own)


def rest_against_all(
    rows: DataFrame, group: str, rest: str, ident: str, weight: str, limit: int, most: int
) -> DataFrame:
    """Deal rows to tasks in which each row of the rest meets each row of its group.

    ``rest`` is a boolean column. The rest and the whole group are cut into blocks of about
    ``limit`` weight and ``most`` members; a block of the one meets a block of the other in
    the task (_ask, _told). Rows of the rest come as those that ask (_asks) and as those
    asked. The work is that of the rest times the group, so a settled group costs nothing.
    """
    asking = F.col(rest)
    totals = rows.groupBy(group).agg(
        _blocks(F.sum(weight), F.count("*"), limit, most).alias("_blocks"),
        _blocks(
            F.sum(F.when(asking, F.col(weight)).otherwise(0)), F.count_if(asking), limit, most
        ).alias("_rests"),
        F.max(asking).alias("_any"),
    ).filter("_any").drop("_any")
    placed = rows.join(totals, group)
    mark = F.xxhash64(ident)
    told = placed.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_rests") - 1)).alias("_ask"),
        F.pmod(mark, F.col("_blocks")).cast("int").alias("_told"), F.lit(False).alias("_asks"),
    )
    asks = placed.filter(asking).select(
        "*", F.pmod(mark, F.col("_rests")).cast("int").alias("_ask"),
        F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_told"),
        F.lit(True).alias("_asks"),
    )
    return asks.unionByName(told).drop("_blocks", "_rests")
