"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pagerisk.llm.common import WORD, row_key, running_total
from pagerisk.session import gathered, materialise

_FIRST_CELLS = 1024
_CELLS = 64


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...], share_percent: int, max_repeats: int
) -> DataFrame:
    """One row per source: rank, source_size and target.

    ``sizes`` holds (source, size). Sources in code-point order, NULL last, get the weights
    in turn and share ``share_percent`` of all sizes. No target passes ``max_repeats`` times
    the size of its source; what a capped source cannot use goes to the others by weight.
    In the order of cap per weight the capped sources come first, so the level at which the
    others settle needs one pass over the sources instead of repeated rounds.
    """
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    sources = sources.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1)
    ).withColumn("cap", F.col("source_size") * max_repeats)
    budget = F.sum("source_size").over(whole) * share_percent / F.lit(100.0)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    later = by_level.rowsBetween(0, Window.unboundedFollowing)
    sources = sources.withColumn("budget", budget).withColumn(
        "level",
        (F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        / F.sum("weight").over(later),
    )
    settled = F.when(
        F.col("level") * F.col("weight") <= F.col("cap"),
        F.struct((F.col("cap") / F.col("weight")).alias("at"), "rank", "level"),
    )
    level = F.min(settled).over(whole)["level"]
    capped = F.col("cap").cast("double")
    target = F.when(level.isNull(), capped).otherwise(F.least(capped, level * F.col("weight")))
    return sources.withColumn("target", target).select(
        "source", "rank", "source_size", "target", "budget"
    )


def mix_plan(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share_percent: int = 150,
    max_repeats: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """How often each row is taken: key, doc_id, size, source_size, target, times, taken.

    Every source queues its documents in an order that depends on seed, id and text alone,
    once for each allowed repeat. The virtual finish time of an entry is the number of words
    queued up to its end over the target of its source. All entries are then sorted by
    finish time in ranges of it, and the queue ends before the entry that would pass the
    total budget. Documents are taken whole.

    NULL or empty texts have size 0 and are taken 0 words; a NULL source is a source, the
    last one; a NULL id is a value; rows that agree in everything are queued one by one;
    other columns are ignored; an empty table gives an empty plan.
    """
    spark = documents.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    words = F.coalesce(F.md5(F.col(text_col)), F.lit(""))
    queue = F.md5(F.concat(F.lit(f"{seed}:"), ident, F.lit(":"), words))
    rows = materialise(
        documents.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            size.alias("size"),
            queue.alias("queue"),
            row_key(id_col, text_col).alias("key"),
        ),
        "mix-sizes",
    )
    targets = materialise(source_targets(rows, weights, share_percent, max_repeats), "mix-targets")
    digits = F.conv(F.substring("queue", 1, 8), 16, 10).cast("long")
    queued = rows.join(
        targets.withColumnRenamed("source", "_source"),
        F.col("source").eqNullSafe(F.col("_source")),
    ).drop("_source")
    queued = queued.withColumn("_coarse", F.shiftright(digits, 22)).withColumn(
        "_fine", F.shiftright(digits, 16).bitwiseAND(F.lit(63))
    )
    queued = running_total(queued, ["rank"], ["_coarse", "_fine"], ["queue"], "size", "_end")
    queued = materialise(gathered(queued.drop("_coarse", "_fine")), "mix-queue")

    def finish(entry):
        end = F.col("_end") + entry * F.col("source_size")
        return F.when(F.col("target") > 0, end / F.col("target")).otherwise(F.lit(0.0))

    entries = queued.select(
        "rank", "size", "queue", "budget", "_end", "source_size", "target",
        F.explode(F.array(*[F.lit(n) for n in range(max_repeats)])).alias("pass"),
    ).withColumn("finish", finish(F.col("pass")))
    # Monotone in the finish time, and bounded.
    place = F.floor(F.col("finish") / (1 + F.col("finish")) * (_FIRST_CELLS * _CELLS))
    ranged = entries.withColumn("_coarse", F.floor(place / _CELLS)).withColumn(
        "_fine", place % _CELLS
    )
    order = ["finish", "rank", "queue", "pass"]
    total = running_total(ranged, [], ["_coarse", "_fine"], order, "size", "total")
    end = (
        total.filter(F.col("total") > F.col("budget"))
        .agg(F.min(F.struct(*order)).alias("end"))
        .collect()[0]["end"]
    )

    def taken(entry: int):
        if end is None:
            return F.lit(1)
        here = F.struct(
            finish(F.lit(entry)).alias("finish"), "rank", "queue", F.lit(entry).alias("pass")
        )
        stop = F.struct(
            F.lit(end["finish"]).alias("finish"),
            F.lit(end["rank"]).alias("rank"),
            F.lit(end["queue"]).alias("queue"),
            F.lit(end["pass"]).alias("pass"),
        )
        return F.when(here < stop, 1).otherwise(0)

    times = sum((taken(n) for n in range(1, max_repeats)), taken(0))
    return queued.withColumn("times", times).select(
        "key", "doc_id", "size", "source_size", "target", "times",
        (F.col("times") * F.col("size")).cast("long").alias("taken"),
    )


def mix(documents: DataFrame, *, id_col="doc_id", text_col="text", **settings) -> DataFrame:
    """The mixed corpus: every row as often as ``mix_plan`` takes it, with its own columns.

    Rows of size 0 carry no words and are left out. Rows that agree in id and text share
    out the takes planned for them. Cases as in ``mix_plan``.
    """
    plan = mix_plan(documents, id_col=id_col, text_col=text_col, **settings)
    takes = (
        plan.filter((F.col("taken") > 0))
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("times"), asc=False).alias("_llm_times"))
        .select(
            F.col("key.d").alias("_llm_d"), F.col("key.h").alias("_llm_h"), "_llm_times"
        )
    )
    key = row_key(id_col, text_col)
    rows = documents.withColumn("_llm_d", key["d"]).withColumn("_llm_h", key["h"])
    rows = rows.join(takes, ["_llm_d", "_llm_h"])
    same = Window.partitionBy("_llm_d", "_llm_h").orderBy(F.lit(1))
    rows = rows.withColumn("_llm_n", F.row_number().over(same))
    times = F.when(
        F.col("_llm_n") <= F.size("_llm_times"), F.col("_llm_times")[F.col("_llm_n") - 1]
    ).otherwise(0)
    return (
        rows.withColumn("_llm_copy", F.explode(F.array_repeat(F.lit(0), times)))
        .select(*[F.col(f"`{name}`") for name in documents.columns])
    )
