"""The page store: a parquet table that grows by epochs and is folded when read.

    <root>/pages/epoch=E/batch_group=G/*.parquet   one row per page touched in epoch E
    <root>/state/epoch=E/*.parquet                 progress row; writing it commits epoch E

An epoch holds only the pages it touched, already folded to one row per key and carrying
the batch of their first insertion. Re-running a failed epoch overwrites its own folder,
and readers see committed epochs only. ``compact`` writes the folded store as a new base
epoch, after which older epochs are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagerisk.functions.urls import url_key
from pagerisk.operators import batches as B
from pagerisk.schemas import INGEST_STATE, WEBPAGE
from pagerisk.session import materialise

STORED = T.StructType(
    [T.StructField("url_key", T.StringType())]
    + list(WEBPAGE.fields)
    + [
        T.StructField("batch_id", T.IntegerType()),
        T.StructField("is_new", T.BooleanType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("batch_group", T.IntegerType()),
    ]
)
_STATE = T.StructType(
    list(INGEST_STATE.fields)
    + [
        T.StructField("base_epoch", T.LongType()),
        T.StructField("token", T.StringType()),
        T.StructField("epoch", T.LongType()),
    ]
)


class Commit(NamedTuple):
    epoch: int = 0
    base_epoch: int = 0
    state: B.BatchState = B.BatchState()


def _states(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(_STATE).parquet(f"{root}/state")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STATE)


def last_commit(spark: SparkSession, root: str) -> Commit:
    """The newest committed epoch; zeros for an empty store."""
    row = _states(spark, root).agg(
        F.max_by(F.struct("epoch", "base_epoch", "last_batch_id", "last_item_index"), "epoch").alias("s")
    ).first()["s"]
    if row is None:
        return Commit()
    return Commit(row.epoch, row.base_epoch, B.BatchState(row.last_batch_id, row.last_item_index))


def is_committed(spark: SparkSession, root: str, token: str) -> bool:
    """Whether an ingest with this token has been committed."""
    return bool(_states(spark, root).filter(F.col("token") == token).take(1))


def load_state(spark: SparkSession, root: str) -> DataFrame:
    """One row of last ids, zeros when nothing has been stored."""
    return _states(spark, root).agg(
        F.coalesce(F.max_by("last_batch_id", "epoch"), F.lit(0)).alias("last_batch_id"),
        F.coalesce(F.max_by("last_item_index", "epoch"), F.lit(0)).alias("last_item_index"),
    )


def _committed(spark: SparkSession, root: str, commit: Commit) -> DataFrame:
    if commit.epoch == 0:
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(STORED).parquet(f"{root}/pages")
    return rows.filter(F.col("epoch").between(max(commit.base_epoch, 1), commit.epoch))


def read_pages(spark: SparkSession, root: str, batch_ids=None) -> DataFrame:
    """One merged row per page. ``batch_ids`` prunes to those batches before the fold."""
    commit = last_commit(spark, root)
    rows = _committed(spark, root, commit)
    if batch_ids is not None:
        ids = sorted({int(i) for i in batch_ids})
        groups = sorted({i // B.BATCHES_PER_GROUP for i in ids})
        rows = rows.filter(F.col("batch_group").isin(groups) & F.col("batch_id").isin(ids))
    if commit.base_epoch == commit.epoch or commit.epoch == 1:
        return rows.drop("is_new", "epoch")
    return B.fold_updates(rows, ["epoch"], carry=("batch_id", "batch_group"))


def read_lookup(spark: SparkSession, root: str, commit: Commit | None = None) -> DataFrame:
    """url_key -> batch_id, from the two narrow columns of the inserting rows."""
    rows = _committed(spark, root, commit or last_commit(spark, root))
    return rows.filter("is_new").select("url_key", "batch_id")


def read_batches(spark: SparkSession, root: str, batch_ids) -> DataFrame:
    """Pages of the requested batches; a missing batch gives one row of NULLs."""
    return B.batch_contents(read_pages(spark, root, batch_ids), batch_ids)


def _write_epoch(rows: DataFrame, root: str, epoch: int) -> None:
    grouped = rows.withColumn(
        "batch_group", F.floor(F.col("batch_id") / B.BATCHES_PER_GROUP).cast("int")
    )
    (
        grouped.hint("rebalance", "batch_group")
        .write.mode("overwrite")
        .partitionBy("batch_group")
        .parquet(f"{root}/pages/epoch={epoch}")
    )


def _write_state(state: DataFrame, root: str, epoch: int, base_epoch: int, token: str | None) -> None:
    tagged = state.withColumn("base_epoch", F.lit(base_epoch).cast("long")).withColumn(
        "token", F.lit(token).cast("string")
    )
    tagged.coalesce(1).write.mode("overwrite").parquet(f"{root}/state/epoch={epoch}")


def ingest(spark: SparkSession, root: str, landed: DataFrame, token: str | None = None) -> Commit:
    """Insert or merge landed page rows as one epoch.

    ``landed`` is a stored table of page rows with file_idx and record_no; of several rows
    of a URL, in one file or more, each field's latest usable value counts. It is read
    narrowly to number the new pages and once in full to fold the updates. Pages of archives
    of two kinds may share file and record numbers; their keys then decide the order. A ``token`` that was committed before makes the call a no-op.
    """
    before = last_commit(spark, root)
    if token is not None and is_committed(spark, root, token):
        return before
    keyed = landed.selectExpr("*", f"{url_key('url')} AS url_key")
    first_seen = keyed.groupBy("url_key").agg(
        F.min(F.struct("file_idx", "record_no")).alias("first")
    )
    # Read several times below, so written once: keys and positions only.
    classified = materialise(
        B.classify_new_existing(
            first_seen.select("url_key", "first.*"), read_lookup(spark, root, before)
        ),
        "classified",
    )
    placed_new = B.assign_batches(
        classified.filter("is_new"), before.state, ties=("url_key",)
    )
    placed = placed_new.select("url_key", "batch_id", "is_new").unionByName(
        classified.filter("not is_new").select(
            "url_key", F.col("existing_batch_id").alias("batch_id"), "is_new"
        )
    )
    folded = B.fold_updates(
        keyed.withColumn("__file", F.col("file_idx") + 1).withColumn("__rec", F.col("record_no") + 1),
        ["__file", "__rec"],
    )
    epoch = before.epoch + 1
    _write_epoch(folded.join(placed, "url_key"), root, epoch)
    counted = classified.agg(F.count_if("is_new").alias("n_new"))
    row = B.next_state(counted, before.state).first()
    state = spark.createDataFrame([row], INGEST_STATE)
    _write_state(state, root, epoch, before.base_epoch, token)
    return Commit(epoch, before.base_epoch, B.BatchState(row.last_batch_id, row.last_item_index))


def compact(spark: SparkSession, root: str) -> Commit:
    """Write the merged store as a new base epoch."""
    before = last_commit(spark, root)
    if before.epoch == before.base_epoch:
        return before
    epoch = before.epoch + 1
    merged = read_pages(spark, root).drop("batch_group").withColumn("is_new", F.lit(True))
    _write_epoch(merged, root, epoch)
    kept = spark.createDataFrame([before.state], "last_batch_id int, last_item_index int")
    _write_state(kept.withColumn("updated_at", F.current_timestamp()), root, epoch, epoch, None)
    return last_commit(spark, root)
