import time

from pyspark.sql import functions as F

from pagerisk.functions.html import FIELD_TYPES, PageElements, page_elements
from pagerisk.functions.scanner import MarkupScanner
from pagerisk.operators import pages as H

SAMPLE = """
<html><head>
<meta name="description" content="Una página"><meta name="keywords" content="clics, noticias">
<title>惊人的新闻！</title></head><body>
<h1>主标题</h1><h2>副标题</h2><h3>另一个</h3>
<a href="https://example.com/1">Leer más</a><a href="https://example.com/2">Descubre</a>
<a href="https://example.com/3">Haz clic</a>
<img src="image1.jpg" alt="图一"><img src="image2.jpg" alt="图二"><img src="image3.jpg" alt="图三">
<script>console.log('uno');</script><script>console.log('dos');</script><script>console.log('tres');</script>
<script src="https://example.com/1.js"></script><script src="https://example.com/2.js"></script>
<script src="https://example.com/3.js"></script></body></html>
"""


def fields(html, *names):
    page = PageElements(html)
    return [page.field(n) for n in names]


def test_sample_page(spark):
    df = spark.createDataFrame([(1, SAMPLE)], "page_id int, html string")
    page = df.select(page_elements(F.col("html")).alias("p")).first().p
    assert page.title == "惊人的新闻！"
    assert [(h.level, h.text) for h in page.headings] == [(1, "主标题"), (2, "副标题"), (3, "另一个")]
    assert [(a.text, a.href) for a in page.links][0] == ("Leer más", "https://example.com/1")
    assert page.meta == {"description": "Una página", "keywords": "clics, noticias"}
    assert [i.src for i in page.images] == ["image1.jpg", "image2.jpg", "image3.jpg"]
    assert page.embedded_scripts == [f"console.log('{w}');" for w in ("uno", "dos", "tres")]
    assert page.external_scripts == [f"https://example.com/{i}.js" for i in (1, 2, 3)]
    assert page.text == "惊人的新闻！ 主标题 副标题 另一个 Leer más Descubre Haz clic"


def test_titles():
    assert fields("<p>x</p>", "title") == ["No Title"]
    assert fields("<title></title>", "title") == [""]
    assert fields("<title> a <b>b </b></title>x", "title")[0].startswith("a")
    assert fields("<title>one</title><title>two</title>", "title") == ["one"]


def test_headings_by_level_then_position():
    html = "<h3>c</h3><h1>a <b>bold</b></h1><h6>no</h6><h2></h2><h1>d</h1>"
    assert [h["text"] for h in fields(html, "headings")[0]] == ["abold", "d", "", "c"]


def test_text_nodes():
    assert fields("<h1>x &amp; y&nbsp;</h1>", "headings")[0][0]["text"] == "x & y"
    assert fields("<p>a<!-- no -->b</p><style>s</style><script>t</script> c", "text") == ["a b c"]
    assert fields("<template><p>x</p></template><ruby>k<rt>r</rt></ruby>", "text") == ["k"]
    assert fields("<h1>a<script>s()</script>b</h1>", "headings")[0][0]["text"] == "ab"


def test_unclosed_and_unmatched_tags():
    assert fields("<p><b>x<h1>y</p>z", "headings")[0][0]["text"] == "y"
    assert fields("</div><h1>x</i>y", "headings")[0][0]["text"] == "xy"
    assert fields("<br><h1>a<br>b</h1>", "headings")[0][0]["text"] == "ab"


def test_attributes():
    links = fields("<a>x</a><a href>y</a><a href='1' HREF='2'>z</a>", "links")[0]
    assert [a["href"] for a in links] == ["#", "", "2"]
    assert fields("<img><img src=a>", "images") == [[{"src": "", "alt": ""}, {"src": "a", "alt": ""}]]
    meta = "<meta name='A' content='1'><meta name='a'><meta charset=x><meta name=''>"
    assert fields(meta, "meta") == [[("a", "")]]


def test_scripts_count_in_both_lists():
    html = "<script src='x'>body</script><script> </script><script src></script><script></script>"
    assert fields(html, "embedded_scripts", "external_scripts") == [["body", ""], ["x", ""]]


def test_script_limit_and_tables(spark):
    html = "".join(f"<script src='{i}'>b{i}</script><img src={i}>" for i in range(5))
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    whole = {r.page_id: r for r in H.scripts(df, "page_id").collect()}
    assert whole[1].embedded_scripts == [f"b{i}" for i in range(5)]
    assert whole[1].external_scripts == [str(i) for i in range(5)]
    found = {r.page_id: r for r in H.scripts(df, "page_id", limit=3).collect()}
    assert found[1].embedded_scripts == ["b0", "b1", "b2"]
    assert found[1].external_scripts == ["0", "1", "2"]
    assert found[2].embedded_scripts is None
    assert H.image_table(df, "page_id").count() == 5
    assert H.link_table(df, "page_id").count() == 0


def test_sentences(spark):
    texts = ["One. Two!  Three? four", "", "No end", "a.b c."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(H.sentences(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == [["One.", "Two!", "Three?", "four"], [], ["No end"], ["a.b c."]]


def test_only_named_fields_are_returned(spark):
    df = spark.createDataFrame([("<title>t</title>",)], "html string")
    assert H.extract(df, ["title"]).schema["page"].dataType.names == ["title"]


def test_unreadable_page_is_null(spark):
    df = spark.createDataFrame([("<title>t</title>",), ("<![bad[x]]><p>",)], "html string")
    assert H.extract(df, ["title"]).count() == 2


def test_deeply_nested_page_is_linear():
    html = "<div>" * 50_000 + "<h1>x</h1>" + "</p>" * 50_000
    assert fields(html, "headings")[0][0]["text"] == "x"


def test_hostile_pages_take_linear_time_and_space():
    size = 1 << 20
    for piece in (
        "<!--", "<a ", "<![CDATA[", "<a b='", '<a b="x\'', "</a", "<a>", "<h1>", "<title>", "<?", "<!x",
        "<", "<a href=>", "<script>", "<b ", "&amp", "<!-", "<![if ", "<a b='>", "</a b='\">", "<p/",
    ):
        start = time.process_time()
        page = PageElements(piece * (size // len(piece)))
        fields = [page.field(name) for name in FIELD_TYPES]
        assert time.process_time() - start < 8, piece
        assert sum(len(link["text"]) for link in fields[2]) <= size


def test_scanner_events():
    class Events(MarkupScanner):
        def __init__(self, page):
            self.found = []
            self.scan(page)

        def handle_starttag(self, tag, attrs):
            self.found.append((tag, dict(attrs)))

        def handle_endtag(self, tag):
            self.found.append("/" + tag)

        def handle_data(self, data):
            self.found.append(data)

        def handle_comment(self, data):
            self.found.append(("!", data))

    for page, found in {
        "a < b<P Q=1 r='2>' s>x</p >": ["a ", "<", " b", ("p", {"q": "1", "r": "2>", "s": None}), "x", "/p"],
        "<br/>&lt;&eacute;": [("br", {}), "/br", "<é"],
        "<!-- a > b --><!-->x<!doctype html>": [("!", " a > b "), ("!", ""), "x", ("!", "doctype html")],
        "<script>a<b</b></SCRIPT >c": [("script", {}), "a<b</b>", "/script", "c"],
        "<script>a": [("script", {})],
        "x<!-- y <b>z": ["x", "<", "!-- y ", ("b", {}), "z"],
        "x<a b='y>z": ["x", ("a", {"b": "'y"}), "z"],
        "x<a b='y' c <b": ["x", "<a b='y' c <b"],
        "<a b=c/>d</><1></ >": [("a", {"b": "c/"}), "d", "<", "1>", ("!", " ")],
        '<a href="?a=1&amp;b">': [("a", {"href": "?a=1&b"})],
    }.items():
        assert Events(page).found == found, page
