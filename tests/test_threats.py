import difflib
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pagerisk.functions import fuzzy
from pagerisk.functions.fuzzy import UrlSearch, lcs_length, reaches, similarity_ratio
from pagerisk.operators import threats as J
from pagerisk.sources import feeds


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], previous + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


WORDS = st.text("abcé/😀", max_size=12)


@settings(deadline=None)
@given(WORDS, WORDS)
def test_lcs_is_exact(a, b):
    assert lcs_length(a, b) == plain_lcs(a, b)


@settings(deadline=None)
@given(WORDS, WORDS, st.integers(50, 100))
def test_integer_test_equals_rounded_ratio(a, b, r):
    assert reaches(a, b, r) == (similarity_ratio(a, b) >= r)


def test_ratio_edges():
    assert similarity_ratio("abc", "abc") == 100
    assert similarity_ratio("", "abc") == 0 and similarity_ratio("", "") == 100
    assert similarity_ratio("a" * 179, "a" * 179 + "b" * 42) == 90  # 89.5
    assert not reaches("a" * 1788, "a" * 1788 + "b" * 424, 90)  # 89.4


def mutated(rng, url):
    chars = list(url)
    for _ in range(rng.randint(0, 8)):
        i = rng.randrange(len(chars))
        rng.choice([lambda: chars.insert(i, "x"), lambda: chars.__setitem__(i, "y"), lambda: chars.pop(i)])()
    return "".join(chars) or "z"


def some_urls(rng, n):
    return [f"https://{rng.choice(['a', 'shop', 'login'])}{rng.randrange(50)}.example.{rng.choice(['com', 'net'])}/{rng.randrange(9999)}" for _ in range(n)]


def test_search_equals_brute_force():
    rng = random.Random(5)
    feed = some_urls(rng, 80)
    urls = [mutated(rng, u) for u in feed] + some_urls(rng, 80) + ["", "short"]
    found = UrlSearch(feed, 90).matches_each(urls)
    expected = [any(similarity_ratio(u, f) >= 90 for f in feed) for u in urls]
    assert found == expected and 20 < sum(expected) < 160
    for u, hit in zip(urls, expected):
        if not hit:
            assert all(round(100 * difflib.SequenceMatcher(None, u, f).ratio()) < 90 for f in feed)


@pytest.mark.parametrize("bound", [J.BROADCAST_BYTES, 8 << 10])
def test_phishing_trace_both_ways(spark, bound):
    rng = random.Random(6)
    feed = sorted(set(some_urls(rng, 40)))
    urls = [mutated(rng, u) for u in feed] + some_urls(rng, 40) + [feed[0]] * 50
    left = spark.createDataFrame([(u,) for u in urls] + [(None,)], "clean_url string")
    right = spark.createDataFrame([(u,) for u in feed], "url string")
    rows = J.similar_urls(left, right, broadcast_bytes=bound).collect()
    expected = {u: any(similarity_ratio(u, f) >= 90 for f in feed) for u in urls}
    assert len(rows) == len(urls) + 1
    assert all(r.phishing_trace == expected.get(r.clean_url) for r in rows)


def test_rare_pieces_decide_on_every_partner():
    rng = random.Random(11)
    counts = np.zeros(fuzzy.PIECE_BUCKETS, np.int64)
    counts[fuzzy.piece_bucket("htt")] = 1000
    for url in some_urls(rng, 60):
        for ratio in (90, 95):
            pieces = fuzzy.rare_pieces(url, counts, ratio)
            places = [at for _, at in pieces]
            assert len(pieces) == fuzzy.most_partner_indels(len(url), ratio) + 1
            assert all(b - a >= fuzzy.PIECE for a, b in zip(places, places[1:]))
            assert 0 not in places
            other = mutated(rng, url)
            if similarity_ratio(url, other) >= ratio:
                assert any(url[at : at + 3] in other for at in places)


def hosted_urls(rng, sites, a_site):
    """URLs of many sites with names of their own, and one look-alike of each."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    urls = []
    for _ in range(sites):
        host = word(14)
        urls += [f"https://www.{host}.com/{word(8)}/{word(12)}" for _ in range(a_site)]
    return urls, [mutated(rng, u) for u in urls]


@pytest.mark.parametrize("ratio", [75, 90])
def test_large_feed_equals_brute_force(spark, ratio):
    rng = random.Random(8)
    urls, feed = hosted_urls(rng, 150, 2)
    urls += some_urls(rng, 60) + ["a", "ab", "http://x/", "é" * 20, "long" * 90]
    feed += ["a", "http://y/", "é" * 19 + "x", "long" * 89, "q" * 300]
    left = spark.createDataFrame([(u,) for u in urls], "clean_url string")
    right = spark.createDataFrame([(u,) for u in set(feed)], "url string")
    found = {
        r.clean_url: r.phishing_trace
        for r in J.similar_urls(left, right, ratio, broadcast_bytes=64 << 10).collect()
    }
    search = UrlSearch(feed, ratio)
    assert found == {u: search.matches(u) for u in urls} and 100 < sum(found.values()) < len(found)


def test_candidates_stay_flat_when_both_sides_grow(spark):
    rates = []
    for sites in (1250, 5000):
        urls, feed = hosted_urls(random.Random(sites), sites, 1)
        left = spark.createDataFrame([(u,) for u in urls], "clean_url string").repartition(8)
        right = spark.createDataFrame([(u,) for u in set(feed)], "url string").repartition(8)
        rows = J.compare_by_pieces(left, right, cell_rows=8192).collect()
        hits = {r.clean_url for r in rows if r.hit}
        wanted = {u for u, f in zip(urls, feed) if similarity_ratio(u, f) >= 90}
        assert wanted <= hits
        assert all(u in wanted or UrlSearch(feed, 90).matches(u) for u in hits)
        rates.append(sum(r.compared for r in rows) / len(urls))
    assert rates[1] < 1.5 * rates[0] < 15


def test_a_crowd_settles_strings_with_a_likely_partner():
    feed = [f"https://crowd.example.com/en/{i:05d}" for i in range(600)]
    urls = [f"https://crowd.example.com/en/{i:05d}?" for i in range(50)] + ["ftp://else.where/crowd"]
    matcher = fuzzy.PieceMatcher(urls, feed, 90)
    at = np.array([8] * 50 + [17])
    # All share an earlier piece too, at which each pair would be compared.
    matcher.meet(np.arange(51), at, np.arange(600), np.full(600, 8), [[0]] * 600)
    assert matcher.hit.tolist() == [True] * 50 + [False]
    assert matcher.compared.sum() <= 51 * 4


def moved_urls(n):
    """URLs of one host, and the same on a host that looks like it, as a feed."""
    urls = [f"https://shop.example.com/{'en' if i % 3 else 'de'}/{i * 7919 % 100_003}.html" for i in range(n)]
    return urls, [u.replace("example.com", "examp1e.co") for u in urls]


TEXTS = st.text("abcé/😀\0", max_size=150)


@settings(deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=6), st.lists(TEXTS, min_size=1, max_size=6), st.integers(50, 100))
def test_many_pairs_at_once_equal_one_by_one(left, right, ratio):
    left, right = [*left, left[0] * 5], [*right, left[0] * 5 + "x"]
    rows, columns = (n.ravel() for n in np.indices((len(left), len(right))))
    pairs = [(left[i], right[j]) for i, j in zip(rows, columns)]
    assert fuzzy.lcs_lengths(left, rows, right, columns).tolist() == [lcs_length(*p) for p in pairs]
    alike = [reaches(*p, ratio) for p in pairs]
    assert fuzzy.reach_each(left, rows, right, columns, ratio).tolist() == alike
    sides = fuzzy.Sketches(left), fuzzy.Sketches(right)
    near = set(zip(*(n.tolist() for n in sides[0].near(np.arange(len(left)), sides[1], np.arange(len(right)), ratio)[:2])))
    some, _ = sides[0].near_each(rows, sides[1], columns, ratio)
    assert near == {(rows[k], columns[k]) for k in some}
    assert all(a == b or (i, j) in near for i, j, (a, b), hit in zip(rows, columns, pairs, alike) if hit)


def test_urls_with_a_partner_next_to_them_meet_no_pieces(spark, monkeypatch):
    urls, feed = moved_urls(600)
    urls += ["https://other.host.example.net/without/a/partner", "ftp://else.where/at/all"]
    left = spark.createDataFrame([(u,) for u in urls], "clean_url string")
    right = spark.createDataFrame([(u,) for u in feed], "url string")
    met = []
    whole = J.compare_by_pieces
    monkeypatch.setattr(J, "compare_by_pieces", lambda rest, *rest_of: met.append(rest.count()) or whole(rest, *rest_of))
    rows = J.similar_urls(left, right, broadcast_bytes=8 << 10).collect()
    assert {r.clean_url for r in rows if not r.phishing_trace} == set(urls[600:]) and len(rows) == 602
    assert 2 <= sum(met) < 10


def test_partners_far_apart_in_order_are_found(spark):
    rng = random.Random(12)
    urls, feed = hosted_urls(rng, 300, 1)
    # Both ends differ, so neither order brings the partners together.
    urls, feed = [f"{i % 7}{u}{i % 5}" for i, u in enumerate(urls)], [f"{f}{'xyz'[i % 3]}" for i, f in enumerate(feed)]
    urls += [f"https://crowd.example.com/{'q' * (i % 40)}{i:03d}" for i in range(200)]
    feed += [f"https://crowd.example.com/{'w' * (i % 40)}{i:03d}" for i in range(200)]
    left = spark.createDataFrame([(u,) for u in set(urls)], "clean_url string")
    right = spark.createDataFrame([(u,) for u in set(feed)], "url string")
    rows = J.similar_urls(left, right, broadcast_bytes=8 << 10).collect()
    wanted = {u: any(reaches(u, f, 90) for f in feed) for u in set(urls)}
    assert {r.clean_url: r.phishing_trace for r in rows} == wanted and 100 < sum(wanted.values()) < len(wanted)


def test_a_piece_that_all_share_is_a_grid_of_cells(spark):
    rng = random.Random(3)
    stem = "https://same.host.example/always/the/same/path/"
    urls = [stem + "".join(rng.choice("xyz") for _ in range(9)) for _ in range(400)]
    feed = [stem + "".join(rng.choice("pqr") for _ in range(9)) for _ in range(400)]
    left = spark.createDataFrame([(u,) for u in set(urls)], "clean_url string")
    right = spark.createDataFrame([(u,) for u in set(feed)], "url string")
    rows = J.compare_by_pieces(left, right, 80, cell_rows=50).collect()
    assert not rows  # the pieces have no room at this ratio
    rows = J.compare_by_pieces(left, right, 90, cell_rows=50).collect()
    search = UrlSearch(feed, 90)
    assert {r.clean_url for r in rows if r.hit} == {u for u in urls if search.matches(u)}


def test_search_looks_at_all_urls_for_few(monkeypatch):
    urls, feed = moved_urls(600)
    urls += ["ftp://else.where/at/all", "é" * 30, "", "https://x.example.com/" + "z" * 600]
    feed += ["é" * 29 + "\0", "https://x.example.com/" + "z" * 590, "q" * 5000]
    asked = []
    whole = fuzzy.UrlSearch._search
    monkeypatch.setattr(fuzzy.UrlSearch, "_search", lambda self, some: asked.extend(some) or whole(self, some))
    found = UrlSearch(feed, 90).matches_each([*urls, None])
    assert found == [*([True] * 600), False, True, False, True, None]
    assert len(asked) < 10


def test_no_pair_table_in_the_plans(spark):
    left = spark.createDataFrame([("http://a/",)], "clean_url string")
    right = spark.createDataFrame([("http://b/",)], "url string")
    for bound in (J.BROADCAST_BYTES, 1):
        plan = J.similar_urls(left, right, broadcast_bytes=bound)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_one_huge_feed_url_changes_nothing(spark):
    feed = some_urls(random.Random(7), 60)
    urls = [mutated(random.Random(i), u) for i, u in enumerate(feed)]
    left = spark.createDataFrame([(u,) for u in urls], "clean_url string")
    found = []
    for extra in ([], ["https://x.com/" + "z" * 2_000_000]):
        right = spark.createDataFrame([(u,) for u in {*feed, *extra}], "url string")
        found.append(sorted(J.similar_urls(left, right, broadcast_bytes=4 << 10).collect()))
    assert found[0] == found[1] and any(r.phishing_trace for r in found[0])


def test_exact_matches_are_a_semi_join(spark):
    left = spark.createDataFrame([("http://a/",), ("http://c/",)], "clean_url string")
    right = spark.createDataFrame([("http://a/",)], "url string")
    matched = J.exact_feed_matches(left, right)
    assert [r.clean_url for r in matched.collect()] == ["http://a/"]
    assert "LeftSemi" in matched._jdf.queryExecution().executedPlan().toString()


def test_empty_feed(spark):
    left = spark.createDataFrame([("http://a/",)], "url string")
    feed = spark.createDataFrame([], "url string")
    assert J.phishing_trace(left, feed).first().phishing_trace is False


def test_phish_feed(spark, tmp_path):
    path = tmp_path / "feed.txt"
    path.write_text("\n  http://A.com:80/x \nhttp://a.com/x\n\t\nhttps://b.com\n")
    assert sorted(r.url for r in feeds.read_phish_feed(spark, str(path)).collect()) == ["http://a.com/x", "https://b.com/"]


def test_headlines(spark, tmp_path):
    path = tmp_path / "headlines.csv"
    path.write_text('headline,clickbait\n"One, two",1\n"He said ""no""",0\nÜber alles,1\n"two\nlines",0\n', encoding="utf-8")
    rows = feeds.read_headlines(spark, str(path)).orderBy("idx").collect()
    assert [(r.headline, r.clickbait) for r in rows] == [
        ("One, two", 1), ('He said "no"', 0), ("Über alles", 1), ("two\nlines", 0),
    ]


def test_headlines_of_several_files_are_in_order(spark, tmp_path):
    many = "".join(f"a{i},0\n" for i in range(3))
    (tmp_path / "a.csv").write_text("headline,clickbait\n" + many)
    (tmp_path / "b.csv").write_text("headline,clickbait\n" + "".join(f"b{i},1\n" for i in range(5000)))
    rows = feeds.read_headlines(spark, str(tmp_path)).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(5003))
    assert [r.headline for r in rows] == ["a0", "a1", "a2"] + [f"b{i}" for i in range(5000)]


def response(url, *types, error=None):
    body = {"url": url}
    if types:
        body["matches"] = [{"threatType": t, "threat": {"url": url}} for t in types]
    if error:
        body["error"] = error
    return json.dumps(body)


def test_threat_verdict(spark, tmp_path):
    path = tmp_path / "responses.json"
    path.write_text("\n".join([
        response("unspecified2", *["THREAT_TYPE_UNSPECIFIED"] * 2),
        response("unspecified1", "THREAT_TYPE_UNSPECIFIED"),
        response("one-each", "MALWARE", "SOCIAL_ENGINEERING"),
        response("malware", "MALWARE", "MALWARE"),
        response("unknown", *["NEW"] * 3),
        response("none"),
        response("failed", error="timeout"),
    ]))
    matches = feeds.read_threat_matches(spark, str(path))
    urls = matches.select("url").distinct().union(spark.createDataFrame([("unseen",)], "url string"))
    got = {r.url: (r.is_clickbait, r.is_payfraud, r.is_harmful) for r in J.threat_verdict(urls, matches).collect()}
    no = (False, False, False)
    assert got == {
        "unspecified2": (True, True, False), "unspecified1": no, "one-each": no,
        "malware": (False, False, True), "unknown": no, "none": no, "unseen": no,
        "failed": (None, None, None),
    }
    counts = {r.url: r.malware for r in J.threat_counts(matches).collect()}
    assert counts["malware"] == 2 and counts["none"] == 0


def test_multi_label_verdict(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "url string, label int")
    phishing = spark.createDataFrame([("b", True), ("a", False)], "url string, phishing_trace boolean")
    threats = spark.createDataFrame(
        [("a", False, False, True), ("c", None, None, None)],
        "url string, is_clickbait boolean, is_payfraud boolean, is_harmful boolean",
    )
    got = {r.url: r.verdict for r in J.multi_label_verdict(urls, labels, phishing, threats).collect()}
    assert got == {"a": ["clickbait", "harmful"], "b": ["payfraud"], "c": []}


def test_multi_label_verdict_of_repeated_urls(spark):
    urls = spark.createDataFrame([("a",)] * 10 + [("b",), ("c",), ("d",)], "url string")
    urls = urls.union(spark.range(100_000).selectExpr("'hot' AS url"))
    hot = spark.range(100_000).selectExpr("'hot' AS url", "int(id = 5) AS label")
    labels = hot.union(spark.createDataFrame([("a", 0)] * 10, "url string, label int"))
    phishing = urls.selectExpr("url", "url = 'b' AS phishing_trace")
    threats = spark.createDataFrame(
        [("a", None, False, None)] * 10 + [("a", False, False, True), ("b", None, None, None)]
        + [("c", None, None, False)],
        "url string, is_clickbait boolean, is_payfraud boolean, is_harmful boolean",
    )
    rows = J.multi_label_verdict(urls, labels, phishing, threats).collect()
    got = {r.url: (r.clickbait, r.payfraud, r.harmful, r.verdict) for r in rows}
    assert len(rows) == 5
    assert got == {
        "a": (None, False, True, ["harmful"]), "b": (None, True, None, ["payfraud"]),
        "c": (None, None, False, []), "d": (False, False, False, []),
        "hot": (True, False, False, ["clickbait"]),
    }
