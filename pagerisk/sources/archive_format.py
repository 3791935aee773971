"""Crawl archives as a Spark source: ``spark.read.format("crawl_archives").load(root)``.

A task reads one file, or one byte range of it where a table of splits is given, or, in a
stream, one file that has landed. Filters on record type and content type reach the reader.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from pagerisk.schemas import RAW_RECORD
from pagerisk.sources.archives import (
    _BATCH_BYTES, _CHUNK, _RECORD_TYPES, KINDS, Damage, DamagedArchive, _batch, _Bytes, _paths,
    _records, _spread,
)
from pagerisk.sources.paths import open_filesystem

FORMAT = "crawl_archives"
SPLIT_BYTES = 128 << 20
#: Records of one gzip member that can be told apart from those of the next byte.
_PER_BYTE = 1 << 20
_MAGIC = b"WARC/"
_WHOLE = 2**62


def members(stream, start: int, damage: Damage) -> Iterator[tuple[int, bytes]]:
    """(offset of its member in the file, decompressed chunk), from a member's start on.

    The first chunk of a member has enough bytes to tell whether it starts a record.
    """
    at = opened = start
    member, begun, first, held = zlib.decompressobj(wbits=31), False, True, b""
    while data := stream.read(_CHUNK):
        while data:
            try:
                chunk = held + member.decompress(data, _CHUNK)
            except zlib.error:
                damage.truncated = True
                return
            begun, held = True, b""
            rest = member.unused_data if member.eof else member.unconsumed_tail
            if first and len(chunk) < len(_MAGIC) and not member.eof:
                held = chunk
            elif chunk:
                yield opened, chunk
                first = False
            at += len(data) - len(rest)
            if member.eof:
                data = rest.lstrip(b"\0")
                at += len(rest) - len(data)
                member, begun, first, opened = zlib.decompressobj(wbits=31), False, True, at
            else:
                data = rest
    if rest := held + member.flush():
        yield opened, rest
    damage.truncated |= begun


def record_starts(chunks: Iterator[tuple[int, bytes]], stop: int):
    """(offset, chunks) of each member before ``stop`` that starts a record.

    The members that only go on with a record are handed out with the one that starts it.
    """
    ahead = next(chunks, None)

    def run(offset: int) -> Iterator[bytes]:
        nonlocal ahead
        while ahead is not None:
            at, chunk = ahead
            if at != offset and chunk.startswith(_MAGIC):
                return
            offset = at
            ahead = next(chunks, None)
            yield chunk

    while ahead is not None and ahead[0] < stop:
        offset = ahead[0]
        part = run(offset)
        yield offset, part
        for _ in part:
            pass


def split_points(stream, split_bytes: int) -> list[int]:
    """Offsets that cut a file into ranges of about ``split_bytes``, each a record's start."""
    points = [0]
    for offset, _ in record_starts(members(stream, 0, Damage()), _WHOLE):
        if offset - points[-1] >= split_bytes:
            points.append(offset)
    return points


def archive_splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Byte ranges of the listed files: path, file_idx, start, stop (of the last one NULL).

    One pass over each file finds where members start that start a record. Looking for the
    mark of a member from the middle of a file would not do: a record may hold an archive.
    Keep the result as a table; it serves all later reads. A file of one member is one range.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, file_idx in _paths(batches):
            filesystem, name = open_filesystem(path)
            with filesystem.open_input_stream(name, compression=None) as stream:
                points = split_points(stream, split_bytes)
            yield pa.RecordBatch.from_pydict(
                {
                    "path": [path] * len(points),
                    "file_idx": pa.array([file_idx] * len(points), pa.int64()),
                    "start": pa.array(points, pa.int64()),
                    "stop": pa.array([*points[1:], None], pa.int64()),
                }
            )

    return _spread(files).mapInArrow(find, "path string, file_idx long, start long, stop long")


@dataclass
class Range(D.InputPartition):
    """A byte range of one file."""

    path: str
    file_idx: int
    start: int = 0
    stop: int = _WHOLE


@dataclass
class Ranges(D.InputPartition):
    """Neighbouring byte ranges that one task reads, in their order."""

    ranges: list[Range]


#: Tasks that a table of splits is read by at least, as long as it has so many ranges.
_LEAST_TASKS = 256


def packed(ranges: list[Range]) -> list[Ranges]:
    """Ranges put together up to ``SPLIT_BYTES``, so that small ones do not make a task each.

    The last range of a file has no known end and counts as the file's largest; a file that is
    one range counts as the largest known one.
    """
    largest: dict[str, int] = {}
    for part in ranges:
        if part.stop != _WHOLE:
            largest[part.path] = max(largest.get(part.path, 0), part.stop - part.start)
    most = max(largest.values(), default=SPLIT_BYTES)
    sizes = [
        part.stop - part.start if part.stop != _WHOLE else largest.get(part.path, most)
        for part in ranges
    ]
    enough = min(SPLIT_BYTES, sum(sizes) // _LEAST_TASKS)
    packs, size = [], 0
    for part, own in zip(ranges, sizes):
        if not packs or size + own > enough:
            packs.append(Ranges([]))
            size = 0
        packs[-1].ranges.append(part)
        size += own
    return packs


def read_range(part: Range, wanted: frozenset[str], accepts, strict: bool):
    """Arrow batches of the records that start in the range.

    record_no orders the records of a file and does not depend on the ranges: it is the
    offset of the gzip member times a constant, plus the place inside the member.
    """
    filesystem, name = open_filesystem(part.path)
    damage, rows, size = Damage(), [], 0
    with filesystem.open_input_file(name) as stream:
        stream.seek(part.start)
        for offset, chunks in record_starts(members(stream, part.start, damage), part.stop):
            for nth, *record in _records(_Bytes(chunks), wanted, damage):
                if not accepts(record[2]):
                    continue
                rows.append((part.path, part.file_idx, offset * _PER_BYTE + nth, *record))
                size += len(record[-1])
                if size >= _BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
    if rows:
        yield _batch(rows)
    if strict and (damage.skipped or damage.truncated):
        raise DamagedArchive(f"{part.path}: {damage.skipped} records skipped, tail cut: {damage.truncated}")


def _landed(root: str, kind: str) -> list[tuple[int, str]]:
    """(modification time, path) of the archives below a folder, folder by folder, by name."""
    from pyarrow import fs

    filesystem, folder = open_filesystem(root)
    infos = filesystem.get_file_info(fs.FileSelector(folder, recursive=True))
    prefix = root.rstrip("/") + "/"
    found = [
        (info.mtime_ns or 0, prefix + info.path[len(folder.rstrip("/")) + 1 :])
        for info in infos
        if info.type == fs.FileType.File and re.search(KINDS[kind], info.path)
    ]
    return sorted(found, key=lambda file: (file[1].rpartition("/")[0] + "/", file[1]))


class _Reads:
    """What batch and stream readers share: options, filters, and reading a range."""

    def __init__(self, options):
        self.root = options["path"]
        self.kind = options.get("kind", "warc")
        types = options.get("rec_types", _RECORD_TYPES[self.kind])
        self.wanted = frozenset(t for t in types.split(",") if t)
        self.strict = options.get("strict", "false").lower() == "true"
        self.content: list = []
        self.none = False

    def _narrow(self, types) -> None:
        self.none |= bool(self.wanted) and not self.wanted & set(types)
        self.wanted = frozenset(types) & self.wanted if self.wanted else frozenset(types)

    def pushFilters(self, filters):
        """Take what can be decided before a record is handed over; the rest goes back."""
        for one in filters:
            column = getattr(one, "attribute", None)
            if column == ("rec_type",) and isinstance(one, D.EqualTo):
                self._narrow([one.value])
            elif column == ("rec_type",) and isinstance(one, D.In):
                self._narrow(one.value)
            elif column == ("http_content_type",) and isinstance(
                one, (D.EqualTo, D.StringContains, D.StringStartsWith)
            ):
                self.content.append(one)
            else:
                yield one

    def _accepts(self, content_type: str | None) -> bool:
        for one in self.content:
            if content_type is None:
                return False
            if isinstance(one, D.EqualTo):
                fits = content_type == one.value
            elif isinstance(one, D.StringContains):
                fits = one.value in content_type
            else:
                fits = content_type.startswith(one.value)
            if not fits:
                return False
        return True

    def read(self, part):
        if part is None or self.none:
            return
        for one in part.ranges if isinstance(part, Ranges) else [part]:
            yield from read_range(one, self.wanted, self._accepts, self.strict)


class ArchiveReader(_Reads, D.DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        self.splits = options.get("splits")

    def partitions(self):
        if self.splits is None:
            files = _landed(self.root, self.kind)
            return [Range(path, n) for n, (_, path) in enumerate(files)] or [None]
        import pyarrow.parquet as pq

        filesystem, name = open_filesystem(self.splits)
        rows = pq.read_table(name, filesystem=filesystem).to_pylist()
        ranges = [
            Range(r["path"], r["file_idx"], r["start"], _WHOLE if r["stop"] is None else r["stop"])
            for r in rows
        ]
        return packed(ranges) or [None]


class ArchiveStream(_Reads, D.DataSourceStreamReader):
    """Files as they land, in the order of modification time and path."""

    def initialOffset(self):
        return {"at": json.dumps([-1, ""])}

    def latestOffset(self):
        files = _landed(self.root, self.kind)
        return {"at": json.dumps(list(max(files)))} if files else self.initialOffset()

    def partitions(self, start, end):
        low, high = (tuple(json.loads(offset["at"])) for offset in (start, end))
        files = sorted(file for file in _landed(self.root, self.kind) if low < file <= high)
        return [Range(path, mtime) for mtime, path in files] or [None]

    def commit(self, end):
        pass


class CrawlArchives(D.DataSource):
    """Records of crawl archives.

    Options: path, the folder; kind, warc or wat; rec_types, a comma list, "," for all;
    strict, whether damage fails the job; splits (batch only), the folder of a Parquet table
    made by ``archive_splits``, whose ranges are then read, whatever the folder holds.

    Columns as of ``read_archives``; see ``read_range`` for record_no. In a stream a file is
    read once, whole, and file_idx is its modification time; a file must land at once, and
    not with a time older than that of files read before.
    """

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return RAW_RECORD

    def reader(self, schema):
        return ArchiveReader(self.options)

    def streamReader(self, schema):
        return ArchiveStream(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to the session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CrawlArchives)
    return spark
