"""URL canonicalisation over the page table.

The stored URLs are tidy already, so the queries first write each of them in an untidy
but equivalent form; the SQL twin states the expected outcome from the stored form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagerisk.operators import urls as O
from pagerisk.operators.threats import compare_urls
from pagerisk.functions.fuzzy import url_similarity
from pagerisk.plans.catalog import query, table

URL_PARTS_SQL = r"""
  SELECT page_id, url, p.scheme AS scheme, p.host AS host, p.path AS path, p.query AS query,
         p.fragment AS fragment
  FROM (SELECT page_id, url, regexp_extract(url,
          '^(https?)://([^/?#]+)(/[^?#]*)?(?:\?([^#]*))?(?:#(.*))?$',
          ['scheme', 'host', 'path', 'query', 'fragment']) AS p FROM pages)
"""
SORTED_QUERY_SQL = """
  array_to_string(list_sort(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''),
    lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)), '&')
"""


def _untidy(url: Column) -> Column:
    """Upper-case scheme and host, default port, dot segments, escaped letters."""
    scheme = F.regexp_extract(url, "^(https?)://", 1)
    host = F.regexp_extract(url, "^https?://([^/?#]+)", 1)
    rest = F.regexp_replace(url, "^https?://[^/?#]+", "")
    port = F.when(scheme == "http", ":80").otherwise(":443")
    escaped = F.regexp_replace(rest, "e", "%65")
    return F.concat(
        F.lit("  "), F.upper(scheme), F.lit("://"), F.upper(host), F.lit("."), port,
        F.lit("/a/.././b/.."), escaped, F.lit(" "),
    )


def _pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


@query("SELECT page_id, url AS normalized_url FROM pages")
def normalize_url(spark, sf_dir):
    messy = _pages(spark, sf_dir).select("page_id", _untidy(F.col("url")).alias("raw"))
    return O.normalize_url(messy, "raw").select("page_id", "normalized_url")


@query(
    f"""SELECT page_id, scheme, host AS netloc, coalesce(path, '') AS path,
         'v=' || page_id AS params, coalesce(query, '') AS query,
         coalesce(fragment, '') AS fragment
       FROM ({URL_PARTS_SQL})"""
)
def url_components(spark, sf_dir):
    with_params = _pages(spark, sf_dir).select(
        "page_id",
        F.concat(
            F.regexp_extract("url", r"^[^?#]+", 0), F.lit(";v="), "page_id",
            F.regexp_extract("url", r"[?#].*$", 0),
        ).alias("url"),
    )
    return O.url_components(with_params).select("page_id", "parts.*")


@query("SELECT page_id, url AS portless_url, other_port_url FROM (SELECT *, "
       r"regexp_replace(url, '^(https?://[^/?#]+)', '\1:8080') AS other_port_url FROM pages)")
def remove_default_port(spark, sf_dir):
    port = F.when(F.col("url").startswith("https:"), ":443").otherwise(":80")
    ported = _pages(spark, sf_dir).select(
        "page_id",
        F.concat(
            F.regexp_extract("url", "^https?://[^/?#]+", 0), port,
            F.regexp_replace("url", "^https?://[^/?#]+", ""),
        ).alias("ported"),
        F.regexp_replace("url", "^(https?://[^/?#]+)", "$1:8080").alias("other"),
    )
    both = O.remove_default_port(ported, "ported")
    return O.remove_default_port(both, "other", "other_port_url").select(
        "page_id", "portless_url", "other_port_url"
    )


@query(
    f"""SELECT page_id, scheme || '://' || host || coalesce(path, '') || '?' || {SORTED_QUERY_SQL}
         || CASE WHEN coalesce(fragment, '') <> '' THEN '#' || fragment ELSE '' END AS sorted_url
       FROM (SELECT page_id, scheme, host, path, fragment,
               'zz=9&id=' || page_id || '&blank&id=10' ||
               CASE WHEN coalesce(query, '') <> '' THEN '&' || query ELSE '' END AS query
             FROM ({URL_PARTS_SQL}))"""
)
def sort_query(spark, sf_dir):
    longer = _pages(spark, sf_dir).select(
        "page_id",
        F.concat(
            F.regexp_extract("url", r"^[^?#]+", 0), F.lit("?zz=9&id="), "page_id",
            F.lit("&blank&&id=10"),
            F.regexp_replace(F.regexp_extract("url", r"\?[^#]*", 0), r"^\?", "&"),
            F.regexp_extract("url", r"#.*$", 0),
        ).alias("url"),
    )
    return O.sort_query(longer).select("page_id", "sorted_url")


@query("SELECT page_id, url AS collapsed_url FROM pages")
def collapse_slashes(spark, sf_dir):
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    doubled = F.concat(
        F.regexp_extract("url", "^https?://[^/?#]+", 0),
        F.replace(path, F.lit("/"), F.expr("repeat('/', 1 + int(page_id % 4))")),
        F.regexp_extract("url", r"[?#].*$", 0),
    )
    pages = _pages(spark, sf_dir).select("page_id", doubled.alias("url"))
    return O.collapse_slashes(pages).select("page_id", "collapsed_url")


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS defragmented_url FROM pages")
def drop_fragment(spark, sf_dir):
    return O.drop_fragment(_pages(spark, sf_dir)).select("page_id", "defragmented_url")


CLEAN_URL_SQL = f"""
  SELECT page_id, url, scheme || '://' || host || CASE WHEN coalesce(path, '') = '' THEN '/' ELSE path END
         || CASE WHEN coalesce(query, '') <> '' THEN '?' || {SORTED_QUERY_SQL} ELSE '' END AS clean_url
  FROM ({URL_PARTS_SQL})
"""


@query(f"SELECT page_id, clean_url, clean_url AS untidy_clean_url FROM ({CLEAN_URL_SQL})")
def clean_url(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("raw", _untidy(F.col("url")))
    both = O.clean_url(O.clean_url(pages), "raw", "untidy_clean_url")
    return both.select("page_id", "clean_url", "untidy_clean_url")


@query(
    "SELECT page_id, replace(replace(to_base64(encode(url || '?long=' || repeat('ü/~', 30))),"
    " '+', '-'), '/', '_') AS url_key, url || '?long=' || repeat('ü/~', 30) AS url FROM pages"
)
def url_key(spark, sf_dir):
    longer = _pages(spark, sf_dir).select(
        "page_id", F.concat("url", F.lit("?long="), F.repeat(F.lit("ü/~"), 30)).alias("raw")
    )
    keyed = O.with_url_key(longer, "raw")
    return O.url_from_key(keyed).select("page_id", "url_key", "url")


@query(
    """SELECT page_id, longer, longer >= 90 AS alike, shorter FROM (
         SELECT page_id,
           CAST(round_even(200.0 * n / (2 * n + page_id % 40), 0) AS INTEGER) AS longer,
           CAST(CASE WHEN n > page_id % 30
             THEN round_even(200.0 * (n - page_id % 30) / (2 * n - page_id % 30), 0) ELSE 0 END
             AS INTEGER) AS shorter
         FROM (SELECT page_id, length(url) AS n FROM pages))"""
)
def url_similarity_ratio(spark, sf_dir):
    """Ratios to the URL with up to 39 characters more, spread over it, or 29 fewer."""
    more = F.expr("int(page_id % 40)")
    half = F.expr("int(page_id % 40) div 2")
    longer = F.concat(F.repeat(F.lit("~"), half), "url", F.repeat(F.lit("^"), more - half))
    shorter = F.expr("substring(url, 1 + int(page_id % 30))")
    return _pages(spark, sf_dir).select(
        "page_id",
        url_similarity(F.col("url"), longer).alias("longer"),
        compare_urls(F.col("url"), longer, 90).alias("alike"),
        url_similarity(F.col("url"), shorter).alias("shorter"),
    )


@query(
    f"""SELECT c.host, count(*) AS pages, count(DISTINCT clean_url) AS clean_urls,
         round(avg(headings), 6) AS mean_headings, round(avg(links), 6) AS mean_links
       FROM (SELECT u.page_id, host, clean_url,
               len(regexp_extract_all(html, '<h[1-5][ >]')) AS headings,
               len(regexp_extract_all(html, '<a[ >]')) AS links
             FROM ({URL_PARTS_SQL}) u JOIN ({CLEAN_URL_SQL}) k USING (page_id)
             JOIN pages USING (page_id)) c
       GROUP BY c.host"""
)
def host_profile(spark, sf_dir):
    """Per host: pages, distinct cleaned URLs, mean headings and links."""
    from pagerisk.operators.pages import extract
    from pagerisk.plans.catalog import heavy_table

    pages = extract(heavy_table(spark, sf_dir, "pages"), ["headings", "links"])
    cleaned = O.url_components(O.clean_url(pages), "clean_url")
    return cleaned.groupBy(F.col("parts.netloc").alias("host")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_distinct("clean_url").alias("clean_urls"),
        F.round(F.avg(F.size("page.headings")), 6).alias("mean_headings"),
        F.round(F.avg(F.size("page.links")), 6).alias("mean_links"),
    )
