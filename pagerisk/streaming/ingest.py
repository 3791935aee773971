"""Incremental ingestion: landed page files into the page store, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagerisk.schemas import LANDED
from pagerisk.session import materialise
from pagerisk.sources.archives import crawl_pages
from pagerisk.sources.page_store import Commit, ingest, is_committed, last_commit


def start_ingest(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Ingest whatever landed since the last run, then stop.

    The checkpoint knows which files are done; the micro-batch number is the store's
    commit token, so a replayed micro-batch changes nothing.
    """
    reader = spark.readStream.schema(LANDED)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def commit(batch: DataFrame, number: int) -> None:
        ingest(batch.sparkSession, root, batch, token=f"{checkpoint}#{number}")

    return (
        reader.parquet(landing)
        .writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_crawl(
    spark: SparkSession,
    archives: str,
    root: str,
    kind: str,
    start: int = 0,
    end: int | None = None,
    token: str | None = None,
) -> Commit:
    """Extract archives, all or one range, land the pages in the shared folder, ingest them.

    The range is its own commit token unless one is given, so a range that is run again
    changes nothing and a long crawl can be resumed range by range.
    """
    token = token or f"{archives}|{kind}|{start}|{'' if end is None else end}"
    if is_committed(spark, root, token):
        return last_commit(spark, root)
    pages = crawl_pages(spark, archives, kind, start, end, dedupe=False)
    landed = materialise(pages, f"landed-{kind}")
    return ingest(spark, root, landed, token=token)
