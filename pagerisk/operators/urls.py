"""URL canonicalisation over a DataFrame column: each operator adds one column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagerisk.functions import urls as U


def normalize_url(df: DataFrame, url: str = "url", out: str = "normalized_url") -> DataFrame:
    """RFC 3986 syntax-based normalisation; a missing scheme becomes https."""
    return df.withColumn(out, F.expr(U.normalize_url(f"`{url}`")))


def url_components(df: DataFrame, url: str = "url", out: str = "parts") -> DataFrame:
    """Struct of scheme, netloc, path, params, query, fragment."""
    return df.withColumn(out, F.expr(U.url_components(f"`{url}`")))


def remove_default_port(df: DataFrame, url: str = "url", out: str = "portless_url") -> DataFrame:
    return df.withColumn(out, F.expr(U.remove_default_port(f"`{url}`")))


def sort_query(df: DataFrame, url: str = "url", out: str = "sorted_url") -> DataFrame:
    return df.withColumn(out, F.expr(U.sort_query(f"`{url}`")))


def collapse_slashes(df: DataFrame, url: str = "url", out: str = "collapsed_url") -> DataFrame:
    """Runs of slashes in the path become one; parameters are left alone."""
    return df.withColumn(out, F.expr(U.collapse_slashes(f"`{url}`")))


def drop_fragment(df: DataFrame, url: str = "url", out: str = "defragmented_url") -> DataFrame:
    return df.withColumn(out, F.expr(U.drop_fragment(f"`{url}`")))


def clean_url(df: DataFrame, url: str = "url", out: str = "clean_url") -> DataFrame:
    """Normalise, drop the default port, sort the query, collapse slashes, drop the fragment.

    All five steps work on the parts of one cut.
    """
    return df.withColumn(out, F.expr(U.clean_url(f"`{url}`")))


def with_url_key(df: DataFrame, url: str = "url", out: str = "url_key") -> DataFrame:
    return df.withColumn(out, F.expr(U.url_key(f"`{url}`")))


def url_from_key(df: DataFrame, key: str = "url_key", out: str = "url") -> DataFrame:
    return df.withColumn(out, F.expr(U.url_from_key(f"`{key}`")))
