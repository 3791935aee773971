"""Phishing and threat checks, and the combined verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagerisk.operators import threats as J
from pagerisk.operators.urls import clean_url
from pagerisk.plans.catalog import heavy_table, query, table
from pagerisk.plans.label_queries import page_prediction, pages_against, scored_pages_sql
from pagerisk.plans.text_queries import ENCODER, document_corpus
from pagerisk.plans.url_queries import CLEAN_URL_SQL
from pagerisk.session import materialise, scratch_path
from pagerisk.sources import feeds

# ---- phishing ------------------------------------------------------------------------
# The feed: every page URL with its host moved to a look-alike domain, as a phisher would.

FEED_SQL = f"SELECT DISTINCT replace(clean_url, 'example.com', 'examp1e.co') AS url FROM ({CLEAN_URL_SQL})"

# Common subsequence by bit-parallel steps over the second URL: ``v`` keeps a set bit per
# unmatched character of the first. The pairs are those a plain edit distance cannot rule out.
SIMILAR_SQL = f"""
  WITH RECURSIVE urls AS (SELECT DISTINCT clean_url AS a FROM ({CLEAN_URL_SQL})),
  feed AS ({FEED_SQL}),
  pairs AS (SELECT a, url AS b, length(a) AS la, length(url) AS lb FROM urls CROSS JOIN feed
            WHERE abs(length(a) - length(url)) <= 105 * (length(a) + length(url)) // 1000
              AND levenshtein(a, url) <= 105 * (length(a) + length(url)) // 1000),
  masks AS (SELECT a, substr(a, i, 1) AS ch, sum(1::HUGEINT << (i - 1)::INTEGER)::HUGEINT AS mask
            FROM (SELECT a, unnest(range(1, length(a) + 1)) AS i FROM urls)
            GROUP BY a, ch),
  steps AS (
    SELECT a, b, la, lb, 0::BIGINT AS j, ((1::HUGEINT << la::INTEGER) - 1)::HUGEINT AS v FROM pairs
    UNION ALL
    SELECT s.a, s.b, la, lb, j + 1,
      (((v + (v & coalesce(mask, 0))) | (v - (v & coalesce(mask, 0))))
        & ((1::HUGEINT << la::INTEGER) - 1))::HUGEINT
    FROM steps s LEFT JOIN masks m ON m.a = s.a AND m.ch = substr(s.b, j + 1, 1) WHERE j < lb),
  common AS (SELECT a, la, lb, la - bit_count(v) AS lcs FROM steps WHERE j = lb)
  SELECT DISTINCT a FROM common WHERE 2000 * lcs >= 895 * (la + lb)
"""
TRACE_SQL = f"""
  SELECT page_id, url, clean_url IN ({SIMILAR_SQL}) AS phishing_trace FROM ({CLEAN_URL_SQL})"""


def _lookalikes(spark, sf_dir) -> DataFrame:
    cleaned = clean_url(table(spark, sf_dir, "pages").select("url"))
    moved = F.replace(F.col("clean_url"), F.lit("example.com"), F.lit("examp1e.co"))
    return feeds.phish_urls(cleaned.select(moved.alias("value")))


@query(f"SELECT clean_url AS url FROM ({CLEAN_URL_SQL}) GROUP BY clean_url")
def read_phish_feed(spark, sf_dir):
    """Page URLs written twice as a text feed with blank lines and padding, read back clean."""
    urls = table(spark, sf_dir, "pages").select("url")
    lines = urls.select(
        F.explode(F.array("url", F.concat(F.lit("  "), "url", F.lit(" \t")), F.lit("  "))).alias("value")
    )
    path = scratch_path(spark, "phish-feed")
    lines.write.text(path)
    return feeds.read_phish_feed(spark, path)


@query(
    f"""SELECT page_id, clean_url FROM ({CLEAN_URL_SQL})
         WHERE clean_url IN (SELECT url FROM ({FEED_SQL}))"""
)
def exact_feed_matches(spark, sf_dir):
    pages = clean_url(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
    return J.exact_feed_matches(pages, _lookalikes(spark, sf_dir)).select("page_id", "clean_url")


def _trace(spark, sf_dir, **bound) -> DataFrame:
    pages = heavy_table(spark, sf_dir, "pages").select("page_id", "url")
    traced = J.phishing_trace(pages, _lookalikes(spark, sf_dir), **bound)
    return traced.select("page_id", "url", "phishing_trace")


@query(TRACE_SQL)
def phishing_trace(spark, sf_dir):
    """Whether a page's URL is at least 90 alike to any feed URL."""
    return _trace(spark, sf_dir)


@query(TRACE_SQL)
def phishing_trace_large_feed(spark, sf_dir):
    """The same with a broadcast bound below the feed size, through comparison in bands."""
    return _trace(spark, sf_dir, broadcast_bytes=8 << 10)


# ---- threat lists --------------------------------------------------------------------
# An event is a stored response about its user; its type stands for a threat type. Errors
# are failed checks.

THREAT_OF_EVENT = {
    "view": "THREAT_TYPE_UNSPECIFIED",
    "click": "MALWARE",
    "purchase": "SOCIAL_ENGINEERING",
    "signup": "SOMETHING_NEW",
}
_CASES = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in THREAT_OF_EVENT.items())
MATCHES_SQL = f"""
  SELECT CAST(user_id AS VARCHAR) AS url, CASE event_type {_CASES} END AS threat_type,
    CASE WHEN event_type = 'error' AND value > 99 THEN 'timeout' END AS error FROM events"""
VERDICT_SQL = f"""
  SELECT url, CASE WHEN NOT failed THEN unspecified >= 15 END AS is_clickbait,
    CASE WHEN NOT failed THEN unspecified >= 15 END AS is_payfraud,
    CASE WHEN NOT failed THEN greatest(malware, social) >= 15 END AS is_harmful
  FROM (SELECT url, bool_or(error IS NOT NULL) AS failed,
          count(*) FILTER (WHERE threat_type = 'THREAT_TYPE_UNSPECIFIED') AS unspecified,
          count(*) FILTER (WHERE threat_type = 'MALWARE') AS malware,
          count(*) FILTER (WHERE threat_type = 'SOCIAL_ENGINEERING') AS social
        FROM ({MATCHES_SQL}) GROUP BY url)"""


def threat_matches(spark, sf_dir) -> DataFrame:
    """(url, threat_type, error) rows from the events."""
    names = F.create_map(*(F.lit(x) for pair in THREAT_OF_EVENT.items() for x in pair))
    failed = (F.col("event_type") == "error") & (F.col("value") > 99)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("url"),
        names[F.col("event_type")].alias("threat_type"),
        F.when(failed, "timeout").alias("error"),
    )


@query(
    f"""SELECT url, count(*) AS rows, count(threat_type) AS matches, count(error) AS errors
       FROM ({MATCHES_SQL}) GROUP BY url"""
)
def read_threat_matches(spark, sf_dir):
    """Responses written as JSON and read back as matches."""
    match = F.when(
        F.col("threat_type").isNotNull(), F.array(F.struct(F.col("threat_type").alias("threatType")))
    )
    responses = threat_matches(spark, sf_dir).select("url", match.alias("matches"), "error")
    path = scratch_path(spark, "threat-responses")
    responses.write.json(path)
    return feeds.read_threat_matches(spark, path).groupBy("url").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("threat_type").alias("matches"),
        F.count("error").alias("errors"),
    )


@query(
    "SELECT url, "
    + ", ".join(
        f"count(*) FILTER (WHERE threat_type = '{t}') AS {t.lower()}" for t in J.THREAT_TYPES
    )
    + f" FROM ({MATCHES_SQL}) GROUP BY url"
)
def threat_counts(spark, sf_dir):
    return J.threat_counts(threat_matches(spark, sf_dir))


@query(VERDICT_SQL)
def threat_verdict(spark, sf_dir):
    """Flags per user at a threshold of 15 matches."""
    matches = threat_matches(spark, sf_dir)
    return J.threat_verdict(matches.select("url").distinct(), matches, threshold=15)


# ---- combined verdict ----------------------------------------------------------------


@query(
    f"""SELECT url, clickbait, payfraud, harmful,
         rtrim(CASE WHEN clickbait THEN 'clickbait ' ELSE '' END ||
               CASE WHEN payfraud THEN 'payfraud ' ELSE '' END ||
               CASE WHEN harmful THEN 'harmful ' ELSE '' END) AS verdict
       FROM (SELECT p.url,
               l.label = 1 OR CASE WHEN v.url IS NULL THEN false ELSE v.is_clickbait END AS clickbait,
               CASE WHEN v.url IS NULL THEN false ELSE v.is_payfraud END OR t.phishing_trace AS payfraud,
               CASE WHEN v.url IS NULL THEN false ELSE v.is_harmful END AS harmful
             FROM pages p JOIN ({TRACE_SQL}) t USING (page_id)
             JOIN (SELECT page_id, CAST((f1 + f2 + f3 + f4) / 4 >= 0.5 AS INTEGER) AS label
                   FROM ({scored_pages_sql([0.75])})) l USING (page_id)
             LEFT JOIN ({VERDICT_SQL}) v ON v.url = CAST(p.page_id AS VARCHAR))"""
)
def multi_label_verdict(spark, sf_dir):
    """Page label, phishing trace and threat flags together; user n stands for page n.

    Every URL, label and trace comes twice, and some checks have failed.
    """
    from pagerisk.operators.labeling import label_pages

    corpus = document_corpus(spark, sf_dir)
    pages = pages_against(spark, sf_dir, corpus).select("url", "html")
    labels = label_pages(pages, corpus, [0.75], ENCODER, page_prediction).select("url", "label")
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    matches = threat_matches(spark, sf_dir).withColumnRenamed("url", "user")
    of_page = urls.select("url", F.col("page_id").cast("string").alias("user"))
    threats = J.threat_verdict(
        of_page.select("url"), matches.join(of_page, "user").drop("user"), threshold=15
    )
    traces = _trace(spark, sf_dir).select("url", "phishing_trace")
    # What comes twice is searched once, and one search after the other.
    labels, traces = materialise(labels, "page-labels"), materialise(traces, "page-traces")
    sides = [urls.select("url"), labels, traces, threats]
    verdict = J.multi_label_verdict(*(side.union(side) for side in sides))
    return verdict.withColumn("verdict", F.array_join("verdict", " "))
