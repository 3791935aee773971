import gzip
import io
import os

import pytest
from pyspark.sql import functions as F

from pagerisk.plans.derive import http_response, warc_record
from pagerisk.sources import archive_format as AF
from pagerisk.sources import archives as A

COLUMNS = ["rec_type", "target_uri", "http_content_type", "payload"]


def response(n: int, kind: str = "text/html") -> bytes:
    body = http_response(b"<p>%d</p>" % n * (n % 50 + 1), kind)
    return warc_record("response", f"http://h/{n}", body)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("format")
    (root / "a").mkdir()
    records = [warc_record("warcinfo", None, b"x")]
    records += [response(n, "text/html" if n % 3 else "image/png") for n in range(300)]
    # A record that holds an archive, stored as it is.
    nested = b"".join(response(n) for n in range(1000, 1005))
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(nested)
    records.insert(150, gzip.compress(head + nested + b"\r\n\r\n", 0))
    (root / "a" / "many.warc.gz").write_bytes(b"".join(records))
    plain = b"".join(gzip.decompress(response(n)) for n in range(20))
    (root / "a" / "one.warc.gz").write_bytes(gzip.compress(plain))
    cut = [plain[:70], plain[70:200], plain[200:]]
    (root / "a" / "spanning.warc.gz").write_bytes(b"".join(map(gzip.compress, cut)))
    (root / "b.warc.gz").write_bytes(response(7) + response(8)[:-20])
    (root / "a" / "no.txt").write_bytes(b"no")
    return str(root)


def rows(frame):
    return [tuple(r) for r in frame.orderBy("file_idx", "record_no").select("file_idx", *COLUMNS).collect()]


def test_source_equals_read_archives(spark, root):
    AF.register(spark)
    want = A.read_archives(A.list_crawl_files(spark, root, "warc"), "warc", rec_types=",")
    assert rows(spark.read.format(AF.FORMAT).option("rec_types", ",").load(root)) == rows(want)
    assert len(rows(spark.read.format(AF.FORMAT).load(root))) == 341


def test_filters_reach_the_reader(spark, root):
    AF.register(spark)
    every = spark.read.format(AF.FORMAT).option("rec_types", ",").load(root)
    wanted = every.filter("rec_type = 'response' AND http_content_type LIKE '%html%'")
    plan = spark._jvm.PythonSQLUtils.explainString(wanted._jdf.queryExecution(), "formatted")
    pushed = "PushedFilters: [EqualTo(rec_type,response), StringContains(http_content_type,html)]"
    assert pushed in plan and wanted.count() == 241
    assert every.filter("rec_type = 'none'").count() == 0
    reader = AF.ArchiveReader({"path": root})
    kept = list(reader.pushFilters([AF.D.EqualTo(("rec_type",), "response"), AF.D.IsNotNull(("path",))]))
    assert kept == [AF.D.IsNotNull(("path",))] and reader.wanted == {"response"}


def test_splits_read_every_record_once(spark, root, tmp_path):
    AF.register(spark)
    files = A.list_crawl_files(spark, root, "warc")
    table = str(tmp_path / "splits")
    AF.archive_splits(files, 2000).write.parquet(table)
    per_file = dict(spark.read.parquet(table).groupBy("path").count().collect())
    counts = {os.path.basename(path): n for path, n in per_file.items()}
    assert counts["many.warc.gz"] > 10 and counts["one.warc.gz"] == counts["spanning.warc.gz"] == 1
    reader = spark.read.format(AF.FORMAT).option("rec_types", ",")
    split = reader.option("splits", table).load(root)
    whole = spark.read.format(AF.FORMAT).option("rec_types", ",").load(root)
    assert split.rdd.getNumPartitions() == sum(counts.values())
    assert rows(split) == rows(whole)
    key = ["file_idx", "record_no"]
    assert sorted(split.select(*key).collect()) == sorted(whole.select(*key).collect())


def test_damage_fails_a_strict_read(spark, root):
    AF.register(spark)
    with pytest.raises(Exception, match="tail cut"):
        spark.read.format(AF.FORMAT).option("strict", "true").load(root).collect()


def test_members_in_small_reads(monkeypatch):
    monkeypatch.setattr(AF, "_CHUNK", 7)
    data = response(1) + response(2) + response(3)
    points = AF.split_points(io.BytesIO(data), 1)
    assert points == [0, len(response(1)), len(response(1) + response(2))]


def test_stream_takes_each_file_once_over_restarts(spark, tmp_path):
    AF.register(spark)
    landing = tmp_path / "landing"
    landing.mkdir()

    def run():
        records = spark.readStream.format(AF.FORMAT).load(str(landing))
        query = (
            records.select("target_uri").writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True).start(str(tmp_path / "out"))
        )
        query.awaitTermination()
        out = spark.read.parquet(str(tmp_path / "out"))
        return sorted(r.target_uri for r in out.select(F.col("target_uri")).collect())

    def land(name, numbers, at):
        file = landing / name
        file.write_bytes(b"".join(map(response, numbers)))
        os.utime(file, (at, at))

    land("z.warc.gz", [1, 2], 1000)
    land("y.warc.gz", [3], 1000)
    assert run() == ["http://h/1", "http://h/2", "http://h/3"]
    land("a.warc.gz", [4, 5], 2000)
    assert run() == [f"http://h/{n}" for n in range(1, 6)]
    assert run() == [f"http://h/{n}" for n in range(1, 6)]


def test_small_ranges_share_tasks_and_large_ones_do_not():
    def ranges(files, each, size):
        ends = lambda n: AF._WHOLE if n == each - 1 else (n + 1) * size
        return [AF.Range(f"f{f}", f, n * size, ends(n)) for f in range(files) for n in range(each)]

    for many in (2000, 20000):
        packs = AF.packed(ranges(many, 8, 1 << 14))
        assert AF._LEAST_TASKS <= len(packs) <= 2 * AF._LEAST_TASKS
        assert [r for p in packs for r in p.ranges] == ranges(many, 8, 1 << 14)
    assert len(AF.packed(ranges(100, 8, AF.SPLIT_BYTES))) == 800
    assert AF.packed([]) == [] and len(AF.packed(ranges(3, 1, 5))) == 3
