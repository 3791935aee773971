"""Batch store semantics over the page table.

Page URLs are distinct, so the queries key pages by host where keys must repeat: the http
pages of a host play the stored versions, its https pages the updates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagerisk.operators import batches as B
from pagerisk.operators.urls import with_url_key
from pagerisk.plans.catalog import query, table
from pagerisk.session import materialise, scratch_path

STATE = B.BatchState(3, 30)

# ---- pages as versions of their host -------------------------------------------------

KEY_SQL = "replace(replace(to_base64(encode({})), '+', '-'), '/', '_')"
HOST_ROWS_SQL = f"""
  SELECT page_id, {KEY_SQL.format('host')} AS url_key, host AS url, html,
    CASE WHEN title = '' OR contains(page_url, '.html') THEN NULL ELSE title END AS title,
    CASE WHEN contains(page_url, '?') THEN [] ELSE hrefs END AS links, secure
  FROM (SELECT page_id, html, url AS page_url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
          regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
          regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs,
          starts_with(url, 'https:') AS secure FROM pages)
"""


def _folded_sql(where: str) -> str:
    """The host's versions merged by field, the latest usable value first."""
    return f"""
      SELECT url_key, min(url) AS url, arg_max(html, page_id) AS html,
        arg_max(title, page_id) FILTER (WHERE title IS NOT NULL) AS title,
        coalesce(arg_max(links, page_id) FILTER (WHERE len(links) > 0),
                 arg_min(links, page_id)) AS links
      FROM ({HOST_ROWS_SQL}) WHERE {where} GROUP BY url_key"""


STORE_SQL, UPDATES_SQL = _folded_sql("NOT secure"), _folded_sql("secure")
DIGEST_SQL = (
    "url_key, url, md5(html) AS html_md5, title, len(links) AS n_links,"
    " md5(array_to_string(links, ' ')) AS links_md5"
)
LOOKUP_SQL = f"""
  SELECT url_key, CAST(1 + (n - 1) // 10 AS INTEGER) AS batch_id FROM (
    SELECT url_key, row_number() OVER (ORDER BY first) AS n FROM (
      SELECT url_key, min(page_id) AS first FROM ({HOST_ROWS_SQL}) WHERE NOT secure GROUP BY url_key))
"""


def host_rows(spark, sf_dir) -> DataFrame:
    """One row per page, keyed by host; .html pages lack a title, pages with a query their links."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    rows = pages.select(
        "page_id",
        host.alias("url"),
        "html",
        F.when((title != "") & ~F.col("url").contains(".html"), title).alias("title"),
        F.when(F.col("url").contains("?"), F.array().cast("array<string>"))
        .otherwise(links)
        .alias("links"),
        F.col("url").startswith("https:").alias("secure"),
    )
    return with_url_key(rows)


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = host_rows(spark, sf_dir)
    return rows.filter("not secure"), rows.filter("secure")


def _digest(df: DataFrame) -> DataFrame:
    return df.select(
        "url_key",
        "url",
        F.md5(F.col("html").cast("binary")).alias("html_md5"),
        "title",
        F.size("links").cast("long").alias("n_links"),
        F.md5(F.array_join("links", " ").cast("binary")).alias("links_md5"),
    )


def _lookup(spark, sf_dir) -> DataFrame:
    """Hosts of the http pages in batches of ten, in order of their first page."""
    stored, _ = _sides(spark, sf_dir)
    first = stored.groupBy("url_key").agg(F.min("page_id").alias("record_no"))
    placed = B.assign_batches(first.withColumn("file_idx", F.lit(0)), batch_size=10)
    return placed.select("url_key", "batch_id")


def _update_keys(spark, sf_dir) -> DataFrame:
    return _sides(spark, sf_dir)[1].select("url_key").distinct()


@query(
    f"SELECT {DIGEST_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY page_id DESC)"
    f" AS rn FROM ({HOST_ROWS_SQL})) WHERE rn = 1"
)
def last_wins(spark, sf_dir):
    return _digest(B.last_wins(host_rows(spark, sf_dir), ["url_key"], "page_id"))


@query(f"SELECT {DIGEST_SQL} FROM ({_folded_sql('true')})")
def fold_updates(spark, sf_dir):
    return _digest(B.fold_updates(host_rows(spark, sf_dir), ["page_id"]))


@query(
    f"""SELECT {DIGEST_SQL} FROM (
      SELECT coalesce(o.url_key, n.url_key) AS url_key, coalesce(o.url, n.url) AS url,
        coalesce(n.html, o.html) AS html, coalesce(n.title, o.title) AS title,
        CASE WHEN o.url_key IS NULL OR len(n.links) > 0 THEN n.links ELSE o.links END AS links
      FROM ({STORE_SQL}) o FULL OUTER JOIN ({UPDATES_SQL}) n ON o.url_key = n.url_key)"""
)
def merge_pages(spark, sf_dir):
    """Upsert the https versions into the http versions."""
    stored, updates = (B.fold_updates(side, ["page_id"]) for side in _sides(spark, sf_dir))
    return _digest(B.merge_pages(stored, updates))


@query(
    f"""SELECT page_id, page_id % 3 <> 0 AS has_url,
         '[' || concat_ws(',', CASE WHEN page_id % 3 <> 0 THEN '"url"' END,
           CASE WHEN title IS NOT NULL THEN '"title"' END) || ']' AS fields
       FROM ({HOST_ROWS_SQL})"""
)
def drop_null_fields(spark, sf_dir):
    """Which fields the document form keeps; every third page has lost its URL."""
    rows = host_rows(spark, sf_dir)
    rows = rows.withColumn("url", F.when(F.col("page_id") % 3 != 0, F.col("url")))
    documents = B.document_json(rows, ["url", "title"])
    return documents.select(
        "page_id",
        F.get_json_object("document", "$.url").isNotNull().alias("has_url"),
        F.to_json(F.json_object_keys("document")).alias("fields"),
    )


@query(
    f"""SELECT u.url_key, l.batch_id AS existing_batch_id, l.batch_id IS NULL AS is_new
       FROM (SELECT DISTINCT url_key FROM ({HOST_ROWS_SQL}) WHERE secure) u
       LEFT JOIN ({LOOKUP_SQL}) l USING (url_key)"""
)
def classify_new_existing(spark, sf_dir):
    return B.classify_new_existing(_update_keys(spark, sf_dir), _lookup(spark, sf_dir))


@query(
    f"""SELECT DISTINCT url_key FROM ({HOST_ROWS_SQL}) WHERE secure
         AND url_key NOT IN (SELECT url_key FROM ({LOOKUP_SQL}))"""
)
def new_pages(spark, sf_dir):
    return B.new_pages(_update_keys(spark, sf_dir), _lookup(spark, sf_dir))


@query(
    f"""SELECT DISTINCT url_key, batch_id FROM ({HOST_ROWS_SQL}) JOIN ({LOOKUP_SQL}) USING (url_key)
         WHERE secure"""
)
def existing_pages(spark, sf_dir):
    return B.existing_pages(_update_keys(spark, sf_dir), _lookup(spark, sf_dir))


@query(
    f"""SELECT page_id, CAST({STATE.last_batch_id} + (n - 1 + {STATE.last_item_index}) // 100 AS INTEGER)
         AS batch_id FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS n FROM pages)"""
)
def assign_batches(spark, sf_dir):
    """All pages as new rows after an open batch; a file holds 1000 pages."""
    rows = table(spark, sf_dir, "pages").select(
        "page_id",
        F.expr("page_id div 1000").alias("file_idx"),
        (F.col("page_id") % 1000).alias("record_no"),
    )
    return B.assign_batches(rows, STATE).select("page_id", "batch_id")


@query(
    """SELECT CAST(CASE WHEN (n + 30) % 100 = 0 THEN 3 + (n + 30) // 100 - 1
                        ELSE 3 + (n + 30) // 100 END AS INTEGER) AS last_batch_id,
         CAST((n + 30) % 100 AS INTEGER) AS last_item_index
       FROM (SELECT count(*) AS n FROM pages)"""
)
def next_state(spark, sf_dir):
    counted = table(spark, sf_dir, "pages").agg(F.count(F.lit(1)).alias("n_new"))
    return B.next_state(counted, STATE).drop("updated_at")


@query(
    f"""SELECT url_key, arg_max(batch_id, seq) AS batch_id FROM (
         SELECT url_key, batch_id, 0 AS seq FROM ({LOOKUP_SQL})
         UNION ALL SELECT url_key, CAST(page_id AS INTEGER), page_id + 1 FROM ({HOST_ROWS_SQL})
         WHERE secure) GROUP BY url_key"""
)
def upsert_lookup(spark, sf_dir):
    """Point each https host to its last page's number."""
    updates = _sides(spark, sf_dir)[1].select(
        "url_key", F.col("page_id").cast("int").alias("batch_id"), (F.col("page_id") + 1).alias("seq")
    )
    return B.upsert_lookup(_lookup(spark, sf_dir), updates)


@query(
    f"""SELECT url_key, batch_id FROM ({LOOKUP_SQL})
         WHERE url_key IN (SELECT url_key FROM ({HOST_ROWS_SQL}) WHERE secure)"""
)
def lookup_batches(spark, sf_dir):
    return B.lookup_batches(_sides(spark, sf_dir)[1], _lookup(spark, sf_dir))


@query(
    f"""SELECT b.batch_id, l.url_key FROM (SELECT unnest([1, 2, 999999]) AS batch_id) b
         LEFT JOIN ({LOOKUP_SQL}) l ON b.batch_id = l.batch_id"""
)
def batch_contents(spark, sf_dir):
    """Two present batches and a missing one."""
    return B.batch_contents(_lookup(spark, sf_dir), [1, 2, 999999]).select("batch_id", "url_key")


@query(f"SELECT coalesce(max(batch_id), 0) AS last_batch_id FROM ({LOOKUP_SQL})")
def last_batch_id(spark, sf_dir):
    return B.last_batch_id(_lookup(spark, sf_dir))


@query(f"SELECT count(DISTINCT batch_id) AS batches FROM ({LOOKUP_SQL})")
def count_batches(spark, sf_dir):
    return B.count_batches(_lookup(spark, sf_dir))


# ---- the persisted store -------------------------------------------------------------


def landed_pages(spark, sf_dir, secure: bool) -> DataFrame:
    """The http or https pages as landed rows, keyed by the host's root URL; a file holds 1000."""
    rows = host_rows(spark, sf_dir).filter(F.col("secure") == secure)
    whole = rows.select(
        F.expr("page_id div 1000").alias("file_idx"),
        (F.col("page_id") % 1000).alias("record_no"),
        "url", "html", "title", "links",
        *(F.lit(None).cast("array<string>").alias(c)
          for c in ("embedded_scripts", "external_scripts", "headers")),
    )
    # Within a file the last row of a URL replaces the others, at the first one's place.
    rest = ["html", "embedded_scripts", "external_scripts", "title", "links", "headers"]
    once = whole.groupBy("file_idx", "url").agg(
        F.min("record_no").alias("record_no"), F.max_by(F.struct(*rest), "record_no").alias("r")
    )
    return once.select("file_idx", "record_no", "url", "r.*")


FILE_ROWS_SQL = f"""
  SELECT url_key, url, secure, page_id // 1000 AS file_idx, min(page_id) AS first,
    arg_max({{'html': html, 'title': title, 'links': links}}, page_id) AS r
  FROM ({HOST_ROWS_SQL}) GROUP BY url_key, url, secure, page_id // 1000
"""
STORED_SQL = f"""
  SELECT p.url_key, p.url, md5(html) AS html_md5, title, len(links) AS n_links, batch_id FROM (
    SELECT url_key, min(url) AS url, arg_max(r.html, seq) AS html,
      arg_max(r.title, seq) FILTER (WHERE r.title IS NOT NULL) AS title,
      coalesce(arg_max(r.links, seq) FILTER (WHERE len(r.links) > 0), arg_min(r.links, seq)) AS links
    FROM (SELECT *, CASE WHEN secure THEN 1000000000 ELSE 0 END + file_idx AS seq
          FROM ({FILE_ROWS_SQL})) GROUP BY url_key) p
  JOIN (SELECT url_key, CAST(1 + (n - 1) // 100 AS INTEGER) AS batch_id FROM (
    SELECT url_key, row_number() OVER (ORDER BY secure_first, first) AS n FROM (
      SELECT url_key, bool_and(secure) AS secure_first, min(first) FILTER (
        WHERE secure = only_secure) AS first
      FROM (SELECT *, bool_and(secure) OVER (PARTITION BY url_key) AS only_secure
            FROM ({FILE_ROWS_SQL})) GROUP BY url_key))) b USING (url_key)
"""


def _stored_digest(pages: DataFrame) -> DataFrame:
    return pages.select(
        "url_key", "url", F.md5(F.col("html").cast("binary")).alias("html_md5"), "title",
        F.size("links").cast("long").alias("n_links"), "batch_id",
    )


def _ingested_store(spark, sf_dir) -> str:
    from pagerisk.sources.page_store import ingest

    root = scratch_path(spark, "store")
    for secure in (False, True):
        ingest(spark, root, materialise(landed_pages(spark, sf_dir, secure), "landed"))
    return root


@query(STORED_SQL)
def page_store(spark, sf_dir):
    """Two ingests, http pages then https pages, read back merged."""
    from pagerisk.sources.page_store import read_pages

    return _stored_digest(read_pages(spark, _ingested_store(spark, sf_dir)))


@query(STORED_SQL)
def page_store_compacted(spark, sf_dir):
    from pagerisk.sources.page_store import compact, read_pages

    root = _ingested_store(spark, sf_dir)
    compact(spark, root)
    return _stored_digest(read_pages(spark, root))


@query(
    f"""SELECT CAST(CASE WHEN n % 100 = 0 THEN n // 100 ELSE 1 + n // 100 END AS INTEGER) AS last_batch_id,
         CAST(n % 100 AS INTEGER) AS last_item_index
       FROM (SELECT count(DISTINCT url_key) AS n FROM ({HOST_ROWS_SQL}))"""
)
def load_state(spark, sf_dir):
    from pagerisk.sources.page_store import load_state as load

    return load(spark, _ingested_store(spark, sf_dir))


@query(STORED_SQL)
def streaming_ingest(spark, sf_dir):
    """The same two loads arriving as files of a landing folder, one run each."""
    from pagerisk.sources.page_store import read_pages
    from pagerisk.streaming.ingest import start_ingest

    landing, root, progress = (
        scratch_path(spark, label) for label in ("landing", "streamed-store", "progress")
    )
    for secure in (False, True):
        landed_pages(spark, sf_dir, secure).write.mode("append").parquet(landing)
        start_ingest(spark, landing, root, progress).awaitTermination()
    return _stored_digest(read_pages(spark, root))
