"""Connected components of a graph that is held in a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagerisk.session import gathered, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the smallest node reachable, for every node of an edge.

    ``edges`` has columns a and b of one orderable type; direction, repeats and loops do not
    matter. Large-star and small-star rounds alternate until every node points at a root, which
    then is the smallest of its component, as edges lead to smaller nodes. Rounds grow with the logarithm of
    the longest path. A node with very many edges only ever meets a minimum, which is
    combined before the shuffle, and a join that may split it. Every round is written to the
    shared folder, which keeps the lineage short and survives lost executors.
    """
    pairs = edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).filter("a > b")
    pairs, done = _settled(pairs)
    while not done:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("low"))
        large = (
            both.filter("b > a")
            .join(smallest, "a")
            .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        )
        smallest = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(smallest, "a")
        star = F.array(
            F.struct(F.col("a").alias("a"), F.col("low").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
        )
        small = joined.select(F.explode(star).alias("e")).select("e.a", "e.b").filter("a > b")
        pairs, done = _settled(small)
    roots = pairs.select("b").distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )


def _settled(pairs: DataFrame) -> tuple[DataFrame, bool]:
    """The distinct pairs, written, and whether every node of theirs points at a root."""
    written = materialise(gathered(pairs.distinct()), "component-edges")
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")),
    )
    nodes = written.select(F.explode(ends).alias("e")).select("e.*").groupBy("node")
    nodes = nodes.agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    unsettled = nodes.filter("out > 1 OR out = 1 AND into = 1")
    return written, unsettled.isEmpty()
