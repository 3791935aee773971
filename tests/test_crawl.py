import gzip
import json

import pytest

from pagerisk.plans.derive import http_response, warc_record, wat_block
from pagerisk.sources import archives as A
from pagerisk.sources.page_store import last_commit, read_pages
from pagerisk.streaming.ingest import ingest_crawl

BOTH = b"<script>x()</script><script src='/s.js'></script>"


def page(text: bytes) -> bytes:
    return http_response(b"<title>" + text + b"</title>" + BOTH)


@pytest.fixture(scope="module")
def crawl(tmp_path_factory):
    root = tmp_path_factory.mktemp("crawl")
    (root / "a").mkdir()
    (root / "wat").mkdir()
    first = [
        warc_record("warcinfo", None, b"x"),
        warc_record("request", "http://r/", b"GET / HTTP/1.1\r\n\r\n"),
        warc_record("response", "http://ok/1", page(b"one \xff\xfe")),
        warc_record("response", "http://only-inline/", http_response(b"<script>x</script>")),
        warc_record("response", "http://json/", http_response(BOTH, "application/json")),
        warc_record("response", "http://case/", http_response(BOTH, "Text/HTML")),
        warc_record("response", "http://empty/", http_response(b"")),
        warc_record("response", "http://ok/2", page(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc")),
        warc_record("response", "http://ok/1", page(b"again")),
    ]
    (root / "a" / "first.warc.gz").write_bytes(b"".join(first))
    many = [warc_record("response", f"http://many/{i}", page(b"%d" % i)) for i in range(12)]
    (root / "a" / "second.warc.gz").write_bytes(b"".join(many))
    chunked = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n"
    chunked += b"%x\r\n" % len(BOTH) + BOTH + b"\r\n0\r\n\r\n"
    zipped = gzip.compress(BOTH)
    coded = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip\r\n\r\n" + zipped
    third = warc_record("response", "http://chunked/", chunked) + warc_record("response", "http://gz/", coded)
    (root / "a" / "third.warc.gz").write_bytes(third + warc_record("response", "http://cut/", page(b"x"))[:40])
    (root / "a" / "ignored.txt").write_bytes(b"no")
    links = [f"http://l/{i}" for i in range(5)]
    nameless = json.loads(wat_block("http://nameless/", "t", ["x", "y"]))
    found = nameless["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Links"]
    del found[0]["url"]
    wat = [
        wat_block("http://ok/1", "Title one", links),
        wat_block("http://untitled/", None, links),
        wat_block("http://linkless/", "t", []),
        json.dumps(nameless).encode(),
        b'{"Envelope": ',
        b"{}",
        b"\xff\xfe\xfd",
    ]
    records = [warc_record("metadata", "http://x/", block) for block in wat]
    (root / "wat" / "first.wat.gz").write_bytes(b"".join(records))
    (root / "a" / "elsewhere.wat.gz").write_bytes(b"".join(records))
    return str(root)


def test_listing(spark, crawl):
    warc = A.list_crawl_files(spark, crawl, "warc", 0, 100).orderBy("file_idx").collect()
    assert [r.path.rsplit("/", 1)[1] for r in warc] == ["first.warc.gz", "second.warc.gz", "third.warc.gz"]
    assert [r.file_idx for r in warc] == [0, 1, 2]
    assert [r.file_idx for r in A.list_crawl_files(spark, crawl, "warc", 1, 2).collect()] == [1]
    wat = A.list_crawl_files(spark, crawl, "wat").collect()
    assert [r.path.rsplit("/", 2)[1:] for r in wat] == [["wat", "first.wat.gz"]]


def test_listing_reads_no_content(spark, crawl):
    plan = A.list_crawl_files(spark, crawl, "warc")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_warc_pages(spark, crawl):
    rows = A.crawl_pages(spark, crawl, "warc", 0, 10).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r.file_idx, {})[r.url] = r
    assert set(by_file[0]) == {"http://ok/1", "http://ok/2"}
    assert "again" in by_file[0]["http://ok/1"].html and by_file[0]["http://ok/1"].record_no == 2
    assert "abc" in by_file[0]["http://ok/2"].html
    assert set(by_file[1]) == {f"http://many/{i}" for i in range(12)}
    assert set(by_file[2]) == {"http://chunked/", "http://gz/"}
    assert by_file[2]["http://gz/"].embedded_scripts == ["x()"]
    assert rows[0].headers is None


def test_uncapped_reads_everything(spark, crawl):
    assert A.crawl_pages(spark, crawl, "warc", 1, 2, None).count() == 12


def test_bad_bytes_are_dropped(spark, crawl):
    files = A.list_crawl_files(spark, crawl, "warc", 0, 1)
    pages = A.warc_html_pages(A.read_archives(files, "warc").filter("record_no = 2"))
    assert "<title>one </title>" in pages.first().html


def test_wat_pages(spark, crawl):
    rows = {r.url: r for r in A.crawl_pages(spark, crawl, "wat").collect()}
    assert set(rows) == {"http://ok/1", "http://nameless/"}
    assert rows["http://ok/1"].links == [f"http://l/{i}" for i in range(5)]
    assert rows["http://ok/1"].title == "Title one" and rows["http://ok/1"].html == ""
    assert rows["http://nameless/"].links == ["y"]


def test_wat_then_warc_merge_in_the_store(spark, crawl):
    from pagerisk.session import scratch_path

    root = scratch_path(spark, "crawl-store")
    ingest_crawl(spark, crawl, root, "wat")
    ingest_crawl(spark, crawl, root, "warc", 0, 3)
    merged = {r.url: r for r in read_pages(spark, root).collect()}["http://ok/1"]
    assert merged.title == "Title one" and merged.embedded_scripts == ["x()"] and "again" in merged.html
    assert last_commit(spark, root).state == (1, 17)
    epoch = last_commit(spark, root).epoch
    ingest_crawl(spark, crawl, root, "warc", 0, 3)
    assert last_commit(spark, root).epoch == epoch


def test_reader_stops_after_enough_accepted(spark, crawl):
    files = A.list_crawl_files(spark, crawl, "warc", 1, 2)
    assert A.read_archives(files, "warc", stop_after=3).count() == 3
    assert A.crawl_pages(spark, crawl, "warc", 1, 2, per_file=10).count() == 10


def test_empty_listing_gives_an_empty_frame(spark, crawl):
    assert A.crawl_pages(spark, crawl, "warc", 50, 60).collect() == []
    assert A.read_archives(A.list_crawl_files(spark, crawl, "wat", 9), "wat").collect() == []


def test_more_than_ten_thousand_files_are_listed(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        for n in range(5010):
            (tmp_path / folder / f"{n:05d}.warc.gz").write_bytes(b"x")
    listed = A.list_crawl_files(spark, str(tmp_path), "warc")
    facts = listed.selectExpr("count(*)", "min(file_idx)", "max(file_idx)", "count(DISTINCT file_idx)")
    assert tuple(facts.first()) == (10_020, 0, 10_019, 10_020)
    assert listed.filter("file_idx = 5010").first().path.endswith("b/00000.warc.gz")


def test_damage_is_counted(spark, tmp_path):
    whole = b"".join(warc_record("response", f"http://w/{i}", page(b"%d" % i)) for i in range(50))
    (tmp_path / "a.warc.gz").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(whole[: len(whole) // 2])
    bad = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: x\r\n\r\n")
    (tmp_path / "c.warc.gz").write_bytes(bad + warc_record("response", "http://w/", page(b"x")))
    files = A.list_crawl_files(spark, str(tmp_path), "warc")
    status = {r.file_idx: r for r in A.archive_status(files).collect()}
    assert (status[0].records, status[0].skipped, status[0].truncated) == (50, 0, False)
    assert 20 < status[1].records < 30 and status[1].truncated
    assert (status[2].records, status[2].skipped, status[2].truncated) == (1, 1, False)
    assert A.read_archives(files, "warc").count() == 51 + status[1].records
    with pytest.raises(Exception, match="DamagedArchive"):
        A.read_archives(files, "warc", strict=True).count()


def test_pages_are_parsed_once(spark, crawl):
    plan = A.crawl_pages(spark, crawl, "warc")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("ArrowEvalPython") <= 1


def test_lines_and_blocks_across_chunks():
    source = A._Bytes(iter([b"ab", b"c\nde", b"f", b"ghi\n"]))
    assert [source.line(), source.block(4), source.line(), source.line()] == [b"abc\n", b"defg", b"hi\n", None]


def test_cap_is_pushed_before_the_shuffle(spark, crawl):
    pages = A.crawl_pages(spark, crawl, "warc", 0, 10, per_file=10)
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["warc_html_pages", "warc_html_pages_uncapped", "wat_pages_uncapped"])
def test_pages_of_one_url_in_one_file_stay_apart(spark, tmp_path, name):
    from pagerisk.plans import catalog

    catalog.load()
    html = (
        "<html><head><title>t{0}</title><script>x({0})</script></head>"
        "<body><h1>h</h1><a href=\"/a{0}\">a</a></body></html>"
    )
    rows = [(i, "http://twice.example/", html.format(i)) for i in range(3)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(
        str(tmp_path / "pages.parquet")
    )
    found = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    column, text = ("embedded", "x({})") if name.startswith("warc") else ("title", "t{}")
    assert sorted(row[column] for row in found) == [text.format(i) for i in range(3)]
