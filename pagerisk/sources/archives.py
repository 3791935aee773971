"""Crawl archives: file listing, record reading, and page extraction.

Files are read by tasks that get paths as rows. A gzip file is streamed member by member,
so memory holds one record, not one archive. Nothing is limited unless a limit is given.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pagerisk.functions.html import PageElements, RejectedMarkup
from pagerisk.schemas import LANDED, RAW_RECORD, WAT_ENVELOPE
from pagerisk.sources.paths import open_filesystem

KINDS = {"warc": r"\.warc\.gz$", "wat": r"wat/.*\.wat\.gz$"}

_MOST_TASKS = 100_000
_CHUNK = 1 << 20
_BATCH_BYTES = 16 << 20
_ARROW_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("file_idx", pa.int64()),
        ("record_no", pa.int64()),
        ("rec_type", pa.string()),
        ("target_uri", pa.string()),
        ("http_content_type", pa.string()),
        ("payload", pa.binary()),
    ]
)


def list_crawl_files(
    spark: SparkSession,
    root: str,
    kind: str,
    start: int = 0,
    end: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Paths of one archive kind, numbered in listing order, sliced ``[start:end]``.

    Listing order is folder by folder, then by name. Only the path column is read, so no
    file content is touched. Files are numbered inside their folder, folders by their counts.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", F.regexp_extract("path", "^(.*/)", 1).alias("__folder"))
        .filter(F.col("path").rlike(KINDS[kind]))
    )
    earlier = Window.orderBy("__folder").rowsBetween(Window.unboundedPreceding, -1)
    folders = listed.groupBy("__folder").agg(F.count(F.lit(1)).alias("__n"))
    folders = folders.select(
        "__folder", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    inside = F.row_number().over(Window.partitionBy("__folder").orderBy("path"))
    numbered = listed.withColumn("__rn", inside).join(folders, "__folder")
    number = F.col("__before") + F.col("__rn") - 1
    files = numbered.select("path", F.lit(kind).alias("kind"), number.cast("long").alias("file_idx"))
    bounds = [n for n in (end, limit) if n is not None]
    wanted = F.col("file_idx") >= start
    return files.filter(wanted & (F.col("file_idx") < min(bounds)) if bounds else wanted)


class Damage:
    """What a file held that could not be read."""

    def __init__(self):
        self.skipped = 0
        self.truncated = False


class DamagedArchive(ValueError):
    """A record or the tail of an archive cannot be read."""


class _Bytes:
    """Line and block reads over a stream of decompressed chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self._chunks = chunks
        self._buffer = bytearray()
        self._pos = 0

    def _fill(self) -> bool:
        chunk = next(self._chunks, None)
        if chunk is None:
            return False
        del self._buffer[: self._pos]
        self._pos = 0
        self._buffer += chunk
        return True

    def _take(self, end: int) -> bytes:
        taken = bytes(memoryview(self._buffer)[self._pos : end])
        self._pos += len(taken)
        return taken

    def line(self) -> bytes | None:
        searched = 0
        while (end := self._buffer.find(b"\n", self._pos + searched)) < 0:
            searched = len(self._buffer) - self._pos
            if not self._fill():
                return self._take(len(self._buffer)) or None
        return self._take(end + 1)

    def block(self, size: int) -> bytes:
        while len(self._buffer) - self._pos < size and self._fill():
            pass
        return self._take(self._pos + size)


def _gunzip(stream, damage: Damage) -> Iterator[bytes]:
    """Decompressed chunks of a gzip file of any number of members, up to a broken tail."""
    member, begun = zlib.decompressobj(wbits=31), False
    while data := stream.read(_CHUNK):
        while data:
            try:
                chunk = member.decompress(data, _CHUNK)
            except zlib.error:
                damage.truncated = True
                return
            begun = True
            if chunk:
                yield chunk
            if member.eof:
                data = member.unused_data.lstrip(b"\0")
                member, begun = zlib.decompressobj(wbits=31), False
            else:
                data = member.unconsumed_tail
    if rest := member.flush():
        yield rest
    damage.truncated |= begun


def _headers(source: _Bytes) -> dict[str, str]:
    """Header lines up to the empty one, names in lower case."""
    headers: dict[str, str] = {}
    while (line := source.line()) not in (None, b"\r\n", b"\n"):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers.setdefault(name.strip().lower(), value.strip())
    return headers


def _http_body(block: bytes) -> tuple[str | None, bytes]:
    """Content type and decoded body of a stored HTTP response."""
    source = _Bytes(iter([block]))
    if not (source.line() or b"").startswith(b"HTTP/"):
        return None, block
    headers = _headers(source)
    body = source.block(len(block))
    if "chunked" in headers.get("transfer-encoding", "").lower():
        body = _unchunk(body)
    coding = headers.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompress(body, wbits=47)
        except zlib.error:
            pass
    return headers.get("content-type"), body


def _unchunk(body: bytes) -> bytes:
    """Join HTTP chunks; a body that is not chunked after all is kept as it is."""
    source, out = _Bytes(iter([body])), []
    while line := source.line():
        try:
            size = int(line.split(b";")[0], 16)
        except ValueError:
            return body if not out else b"".join(out)
        if size == 0:
            break
        out.append(source.block(size))
        source.line()
    return b"".join(out)


def _records(source: _Bytes, wanted: frozenset[str], damage: Damage) -> Iterator[tuple]:
    """(record_no, type, uri, content type, payload) of the wanted record types.

    A record without a usable length, or cut short, is counted as skipped.
    """
    record_no = -1
    while (line := source.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        headers = _headers(source)
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError):
            damage.skipped += 1
            continue
        block = source.block(length)
        if len(block) < length:
            damage.skipped += 1
            damage.truncated = True
            return
        record_no += 1
        rec_type = headers.get("warc-type", "")
        if wanted and rec_type not in wanted:
            continue
        content_type = None
        if rec_type in ("response", "request"):
            content_type, block = _http_body(block)
        uri = headers.get("warc-target-uri", "").strip("<>") or None
        yield record_no, rec_type, uri, content_type, block


def _has_both_scripts(uri: str | None, content_type: str | None, payload: bytes) -> bool:
    if not uri or "text/html" not in (content_type or ""):
        return False
    try:
        page = PageElements(payload.decode("utf-8", "ignore"))
    except RejectedMarkup:
        return False
    return bool(page.field("embedded_scripts") and page.field("external_scripts"))


def _has_title_and_links(uri: str | None, content_type: str | None, payload: bytes) -> bool:
    try:
        envelope = json.loads(payload)["Envelope"]
        page = envelope["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
        named = envelope["WARC-Header-Metadata"]["WARC-Target-URI"] and page["Head"]["Title"]
        return bool(named and any(link.get("url") is not None for link in page["Links"]))
    except (ValueError, KeyError, TypeError, AttributeError):
        return False


_ACCEPT = {"warc": _has_both_scripts, "wat": _has_title_and_links}


def _scan(
    path: str, wanted: frozenset[str], accepts=None, stop_after: int = 0, strict: bool = False
) -> Iterator[tuple | Damage]:
    """Records of one file, then its damage; with ``stop_after`` only so many accepted ones."""
    filesystem, name = open_filesystem(path)
    damage, accepted = Damage(), 0
    with filesystem.open_input_stream(name, compression=None) as stream:
        for record in _records(_Bytes(_gunzip(stream, damage)), wanted, damage):
            yield record
            accepted += bool(stop_after) and accepts(*record[2:])
            if stop_after and accepted >= stop_after:
                break
    if strict and (damage.skipped or damage.truncated):
        raise DamagedArchive(f"{path}: {damage.skipped} records skipped, tail cut: {damage.truncated}")
    yield damage


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, _ARROW_SCHEMA)]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW_SCHEMA)


def _spread(files: DataFrame) -> DataFrame:
    """Paths dealt to tasks, about one each: a file costs far more than a task."""
    tasks = min(max(files.count(), 1), _MOST_TASKS)
    return files.select("path", "file_idx").repartition(tasks)


def _paths(batches) -> Iterator[tuple[str, int]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


_RECORD_TYPES = {"warc": "response", "wat": "metadata"}


def read_archives(
    files: DataFrame,
    kind: str,
    stop_after: int | None = None,
    rec_types: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Raw records of the listed files; ``rec_types`` is a comma list, "," for all.

    With ``stop_after`` n, reading a file ends after n records that the kind's acceptance
    test would keep, so a capped extraction does not decompress whole archives. A damaged
    file gives what can be read, see ``archive_status``, or fails the job if ``strict``.
    """
    wanted = frozenset(t for t in (rec_types or _RECORD_TYPES[kind]).split(",") if t)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, file_idx in _paths(batches):
            rows, size = [], 0
            for record in _scan(path, wanted, _ACCEPT[kind], stop_after or 0, strict):
                if isinstance(record, Damage):
                    continue
                rows.append((path, file_idx, *record))
                size += len(record[-1])
                if size >= _BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return _spread(files).mapInArrow(read, RAW_RECORD)


def archive_status(files: DataFrame) -> DataFrame:
    """Per file: records read, records skipped, and whether its tail could not be read."""
    names = ["path", "file_idx", "records", "skipped", "truncated"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, file_idx in _paths(batches):
            records = -1
            for found in _scan(path, frozenset()):
                records += 1
            row = [path, file_idx, records, found.skipped, found.truncated]
            yield pa.RecordBatch.from_arrays([pa.array([value]) for value in row], names)

    schema = "path string, file_idx long, records long, skipped long, truncated boolean"
    return _spread(files).mapInArrow(count, schema)


def _first_accepted(pages: DataFrame, per_file: int | None) -> DataFrame:
    if per_file is None:
        return pages
    order = Window.partitionBy("file_idx").orderBy("record_no")
    return pages.withColumn("__rn", F.row_number().over(order)).filter(
        F.col("__rn") <= per_file
    ).drop("__rn")


def _as_landed(pages: DataFrame, dedupe: bool) -> DataFrame:
    """The landed-page schema; with ``dedupe`` one row per file and URL, namely the last
    record's fields at the first record's place."""
    fields = [
        F.col(f.name) if f.name in pages.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in LANDED
    ]
    if not dedupe:
        return pages.select(*fields)
    rest = [name for name in pages.columns if name not in ("file_idx", "url", "record_no")]
    folded = pages.groupBy("file_idx", "url").agg(
        F.max_by(F.struct(*rest), "record_no").alias("__row"), F.min("record_no").alias("record_no")
    )
    return folded.select("file_idx", "url", "record_no", "__row.*").select(*fields)


_PARSED = "struct<html:string,embedded_scripts:array<string>,external_scripts:array<string>>"
_PARSED_ARROW = pa.struct(
    [
        ("html", pa.string()),
        ("embedded_scripts", pa.list_(pa.string())),
        ("external_scripts", pa.list_(pa.string())),
    ]
)


def _parsed(payload: Column) -> Column:
    """The page as text, invalid bytes dropped, and its scripts, from one pass over it."""

    @F.arrow_udf(_PARSED)
    def parse(blocks: pa.Array) -> pa.Array:
        rows = []
        for block in blocks:
            html = block.as_py().decode("utf-8", "ignore") if block.is_valid else ""
            try:
                page = PageElements(html)
            except RejectedMarkup:
                rows.append(None)
                continue
            scripts = {name: page.field(name) for name in _PARSED_ARROW.names if name != "html"}
            rows.append({"html": html, **scripts})
        return pa.array(rows, type=_PARSED_ARROW)

    # Else a filter on the result would be pushed below it, as a second parse.
    return parse.asNondeterministic()(payload)


def _first(values: Column | str, count: int | None) -> Column:
    values = F.col(values) if isinstance(values, str) else values
    return values if count is None else F.slice(values, 1, count)


def warc_html_pages(
    records: DataFrame,
    per_file: int | None = None,
    script_limit: int | None = None,
    dedupe: bool = True,
) -> DataFrame:
    """HTML responses that have inline and external scripts.

    ``per_file`` keeps the first so many of a file, ``script_limit`` of the scripts.
    """
    parsed = records.filter(
        (F.col("rec_type") == "response")
        & (F.col("target_uri") != "")
        & F.col("http_content_type").contains("text/html")
    ).select(
        "file_idx",
        "record_no",
        F.col("target_uri").alias("url"),
        _parsed(F.col("payload")).alias("page"),
    )
    complete = parsed.filter(
        (F.col("page.html") != "")
        & (F.size("page.embedded_scripts") > 0)
        & (F.size("page.external_scripts") > 0)
    )
    pages = complete.select(
        "file_idx",
        "record_no",
        "url",
        "page.html",
        _first("page.embedded_scripts", script_limit).alias("embedded_scripts"),
        _first("page.external_scripts", script_limit).alias("external_scripts"),
    )
    return _as_landed(_first_accepted(pages, per_file), dedupe)


def wat_pages(
    records: DataFrame,
    per_file: int | None = None,
    links: int | None = None,
    dedupe: bool = True,
) -> DataFrame:
    """Page metadata with a title and links, if wanted the first so many of each."""
    parsed = records.filter(F.col("rec_type") == "metadata").select(
        "file_idx",
        "record_no",
        F.from_json(F.try_validate_utf8(F.col("payload").cast("string")), WAT_ENVELOPE).alias("wat"),
    )
    envelope = F.col("wat.Envelope")
    response = envelope["Payload-Metadata"]["HTTP-Response-Metadata"]
    urls = F.filter(response["HTML-Metadata"]["Links"]["url"], lambda u: u.isNotNull())
    pages = parsed.select(
        "file_idx",
        "record_no",
        envelope["WARC-Header-Metadata"]["WARC-Target-URI"].alias("url"),
        F.coalesce(response["HTML"]["Content"], F.lit("")).alias("html"),
        response["HTML-Metadata"]["Head"]["Title"].alias("title"),
        _first(urls, links).alias("links"),
    ).filter((F.col("url") != "") & (F.col("title") != "") & (F.size("links") > 0))
    return _as_landed(_first_accepted(pages, per_file), dedupe)


def crawl_pages(
    spark: SparkSession,
    root: str,
    kind: str,
    start: int = 0,
    end: int | None = None,
    per_file: int | None = None,
    dedupe: bool = True,
) -> DataFrame:
    """List, read and extract archives, all or one range, into landed page rows.

    Without ``dedupe`` a URL may come several times per file, and no page is shuffled. That
    is enough for ``ingest``: accepted records of one kind fill the same fields, so folding
    them by field, latest first, equals keeping the last one.
    """
    files = list_crawl_files(spark, root, kind, start, end)
    records = read_archives(files, kind, stop_after=per_file)
    extract = warc_html_pages if kind == "warc" else wat_pages
    return extract(records, per_file, dedupe=dedupe)
