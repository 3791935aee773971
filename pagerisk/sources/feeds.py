"""File feeds: labelled headlines, phishing URLs, stored threat-list responses, label files."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pagerisk.operators.urls import clean_url
from pagerisk.schemas import HEADLINE, THREAT_RESPONSE
from pagerisk.session import materialise

logger = logging.getLogger(__name__)


def read_headlines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, headline, clickbait) of header CSV files, numbered from 0 by file name and row.

    Spark packs files into partitions by size, so rows are written once with their file and
    their place, and files are put into order by their counts.
    """
    rows = spark.read.csv(
        path, schema=HEADLINE, header=True, quote='"', escape='"', multiLine=True, enforceSchema=False
    )
    rows = materialise(
        rows.select(
            F.col("_metadata.file_path").alias("__file"),
            F.monotonically_increasing_id().alias("__place"),
            *rows.columns,
        ),
        "headlines",
    )
    earlier = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("__file").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first")
    )
    before = F.coalesce(F.sum("__n").over(earlier), F.lit(0))
    files = files.withColumn("__before", before - F.col("__first"))
    numbered = rows.join(files, "__file")
    return numbered.select(
        (F.col("__before") + F.col("__place")).alias("idx"), "headline", "clickbait"
    )


def phish_urls(lines: DataFrame, line: str = "value") -> DataFrame:
    """Distinct cleaned URLs of non-blank lines."""
    trimmed = lines.select(F.regexp_replace(line, r"^\s+|\s+$", "").alias("raw"))
    cleaned = clean_url(trimmed.filter(F.col("raw") != ""), "raw", "url")
    return cleaned.select("url").distinct()


def read_phish_feed(spark: SparkSession, path: str) -> DataFrame:
    feed = phish_urls(spark.read.text(path))
    if feed.isEmpty():
        logger.warning("no phishing URLs in %s", path)
    return feed


def read_threat_matches(spark: SparkSession, path: str) -> DataFrame:
    """(url, threat_type, error): one row per match, one with NULL type where there is none."""
    responses = spark.read.schema(THREAT_RESPONSE).json(path)
    return responses.select("url", "error", F.explode_outer("matches").alias("m")).select(
        "url", F.col("m.threatType").alias("threat_type"), "error"
    )


def write_labels_csv(labelled: DataFrame, path: str) -> None:
    labelled.write.mode("overwrite").option("header", True).csv(path)
