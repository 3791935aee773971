"""Archive files written from the page table, so that the crawl source has input that grows
with it. A file holds a fixed span of page numbers, so the group written by one call is bounded.
"""

from __future__ import annotations

import gzip
import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pagerisk.plans.html_queries import with_added_elements
from pagerisk.session import scratch_path
from pagerisk.sources.paths import open_filesystem

PAGES_PER_FILE = 64


def warc_record(rec_type: str, uri: str | None, block: bytes) -> bytes:
    """One record as its own gzip member."""
    lines = ["WARC/1.0", f"WARC-Type: {rec_type}", f"Content-Length: {len(block)}"]
    if uri:
        lines.append(f"WARC-Target-URI: {uri}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1)


def http_response(html: bytes, content_type: str = "text/html; charset=utf-8") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\n\r\n".encode() + html


def wat_block(uri: str, title: str | None, links: list[str]) -> bytes:
    """The metadata envelope of one page."""
    page = {"Head": {"Title": title} if title else {}, "Links": [{"url": u, "path": "A@/href"} for u in links]}
    return json.dumps(
        {
            "Envelope": {
                "WARC-Header-Metadata": {"WARC-Type": "response", "WARC-Target-URI": uri},
                "Payload-Metadata": {"HTTP-Response-Metadata": {"HTML-Metadata": page}},
            }
        }
    ).encode()


def archive_name(kind: str, number: int) -> str:
    return f"{kind}/part-{number:08d}.{kind}.gz"


def write_archives(pages: DataFrame, kind: str) -> str:
    """Write every page into an archive of one kind below a fresh folder; returns the folder.

    A WARC file holds a request, a JSON response and the HTML response per page; a WAT file
    a broken and a complete metadata record.
    """
    root = scratch_path(pages.sparkSession, "crawl")

    def write(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["file_no"].iloc[0])
        records = [warc_record("warcinfo", None, b"software: derived\r\n")]
        for row in group.sort_values("page_id").itertuples():
            if kind == "warc":
                records.append(warc_record("request", row.url, b"GET / HTTP/1.1\r\n\r\n"))
                records.append(
                    warc_record("response", row.url, http_response(b"{}", "application/json"))
                )
                body = http_response(row.html.encode() + b"\xff")
                records.append(warc_record("response", row.url, body))
            else:
                records.append(warc_record("metadata", row.url, b'{"Envelope": '))
                block = wat_block(row.url, row.title, list(row.links))
                records.append(warc_record("metadata", row.url, block))
        filesystem, name = open_filesystem(f"{root}/{archive_name(kind, number)}")
        filesystem.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with filesystem.open_output_stream(name, compression=None) as out:
            out.write(b"".join(records))
        return pd.DataFrame({"file_no": [number], "records": [len(records)]})

    rows = pages.select(
        "page_id",
        "url",
        "html",
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)).alias("links"),
        F.expr(f"page_id div {PAGES_PER_FILE}").alias("file_no"),
    )
    rows = with_added_elements(rows) if kind == "warc" else rows.drop("html")
    rows.groupBy("file_no").applyInPandas(write, "file_no long, records long").count()
    return root
