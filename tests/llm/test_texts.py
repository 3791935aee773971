import itertools
import random
import re
import time

import numpy as np
import pytest

from pagerisk.llm import langid, lines, main_text, mixing, quality, repetition
from tests.llm import frames

SPACE = r"[^\x20\x09-\x0D]+"


def words_of(text):
    return re.findall(SPACE, text or "")


def order(row):
    return tuple((v is None, v) for v in row)


# Repetition rules


def brute_measures(text, min_repeat):
    words = words_of(text)
    count = len(words)
    longest = [0] * count
    for i, j in itertools.permutations(range(count), 2):
        size = 0
        while max(i, j) + size < count and words[i + size] == words[j + size]:
            size += 1
        longest[i] = max(longest[i], size)
    windows, spans = set(), set()
    for at, size in enumerate(longest):
        if size >= 5:
            windows.update(range(at, at + 5))
        if size >= min_repeat:
            spans.update(range(at, at + size))
    full = [line for line in text.split("\n") if words_of(line)]
    return [
        count, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
        len(full) - len(set(full)), len(windows), len(spans),
        max((n for n in longest if n >= min_repeat), default=0),
    ]


def repeated_texts():
    chance = random.Random(3)
    pool = ["a", "b", "c", "é", "#x", "\n", "\x0b"]
    texts = ["", " ", "a"]
    for spread in (1, 3, 30):
        for _ in range(40):
            some = [chance.choice([*pool, f"d{chance.randrange(spread)}"]) for _ in range(60)]
            texts.append(" ".join(some[: chance.randrange(60)]))
    run = " ".join(map(str, range(40)))
    return [*texts, f"{run} x y z {run}", f"{run} {run} {run}"]


def test_measures_equal_brute_force():
    texts = repeated_texts()
    found = repetition.measure([t.encode() for t in texts], 7)
    for n, text in enumerate(texts):
        own = [int(found[name][n]) for name in repetition._MEASURES]
        assert own == brute_measures(text, 7), text


def test_judge(spark):
    long = " ".join(f"w{n}" for n in range(60))
    rows = [
        (1, " ".join(f"u{n}" for n in range(300))), (2, "too short"),
        (3, " ".join(f"v{n}" for n in range(3000)) + f" {long} x {long}"), (4, "a b " * 40),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in repetition.judge(frame).collect()}
    assert [found[n].base_failed for n in (1, 2, 3, 4)] == [False, True, False, True]
    assert [found[n].kept for n in (1, 2, 3, 4)] == [True, False, False, False]
    assert found[3].longest_repeat == 60 and found[3].n_covered_words == 120


def test_judge_on_awkward_rows(spark):
    found = repetition.judge(frames.awkward(spark), keep=["doc_id", "text", "kept"]).collect()
    assert len(found) == len(frames.rows())
    for row in found:
        if row.text is None or len(row.text) < 1000:
            brute = brute_measures(row.text or "", 20)
            assert [row[name] for name in repetition._MEASURES] == brute
    kept = repetition.judge(frames.awkward(spark), drop_rejected=True)
    assert kept.columns == frames.awkward(spark).columns
    assert {r.kept for r in kept.collect()} == {"x"}
    assert repetition.judge(frames.empty(spark)).collect() == []


# Line runs


def brute_lines(rows, min_words):
    """Deletes by the definition: every run of any length that starts earlier elsewhere."""
    texts = sorted({row for row in rows if row[1] is not None}, key=order)
    sequence = []
    for doc, (_, text) in enumerate(texts):
        for i, line in enumerate(text.split("\n")):
            if words_of(line):
                sequence.append((doc, i, line.strip(" \t\n\x0b\x0c\r"), len(words_of(line))))
    gone = set()
    for b in range(len(sequence)):
        for a in range(b):
            size = total = 0
            while (
                b + size < len(sequence)
                and sequence[b + size][0] == sequence[b][0]
                and sequence[a + size][0] == sequence[a][0]
                and sequence[a + size][2] == sequence[b + size][2]
            ):
                total += sequence[b + size][3]
                size += 1
            if total >= min_words:
                gone.update(sequence[b + n][:2] for n in range(size))
    place = {row: n for n, row in enumerate(texts)}
    out = []
    for row in rows:
        if row[1] is None:
            out.append((row[0], None, 0, 0))
            continue
        doc, parts = place[row], row[1].split("\n")
        own = [i for d, i in gone if d == doc]
        text = "\n".join(line for i, line in enumerate(parts) if i not in own)
        out.append((row[0], text, sum(bool(words_of(p)) for p in parts), len(own)))
    return out


def line_rows(seed):
    chance = random.Random(seed)
    pool = [" ".join(f"l{n}x{m}" for m in range(chance.choice([1, 2, 3, 5, 11]))) for n in range(9)]
    pool += ["", "  "]
    rows = []
    for ident in range(30):
        some = [chance.choice(pool) for _ in range(chance.randrange(0, 14))]
        rows.append((chance.randrange(100) * 100 + ident, "\n".join(some)))
    rows += [(7, "\n".join(["same words here"] * 9)), (8, rows[3][1]), (8, rows[3][1])]
    return rows


@pytest.mark.parametrize("min_words", [10, 3])
def test_line_runs_equal_brute_force(spark, min_words):
    rows = line_rows(min_words)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = lines.dedup_lines(frame, min_words=min_words).collect()
    assert sorted(map(tuple, found), key=order) == sorted(brute_lines(rows, min_words), key=order)


def test_repeated_runs_are_the_longest_that_begin_earlier(spark):
    chance = random.Random(5)
    texts = [[chance.choice("ab") for _ in range(chance.randrange(1, 25))] for _ in range(12)]
    texts += [["a"] * 70, texts[3] * 3, ["c"] + texts[4] + texts[5]]
    rows = [(ident, "\n".join(text)) for ident, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    repeated = lines._named(lines.line_table(frame, "doc_id", "text"), ["x", "y"])
    found = {(r.d, r.n): (r.length, r.first.d, r.first.n) for r in lines.repeated_runs(repeated).collect()}
    places = [(d, n) for d, text in enumerate(texts) for n in range(len(text))]
    want = {}
    for at, (d, n) in enumerate(places):
        for e, m in places[:at]:
            size = 0
            while texts[d][n + size : n + size + 1] == texts[e][m + size : m + size + 1] != []:
                size += 1
            if size > want.get((d, n), (0,))[0]:
                want[d, n] = (size, e, m)
    assert found == want


def test_line_runs_on_awkward_rows(spark):
    frame = frames.awkward(spark)
    out = lines.dedup_lines(frame)
    assert [c for c in out.columns if c not in ("n_lines", "n_deleted")] == [
        c for c in frame.columns if c != "n_lines"
    ]
    found = [(r.doc_id, r.text, r.n_lines, r.n_deleted) for r in out.collect()]
    by_text = {(r[0], r[1]) for r in frames.rows()}
    assert len(found) == len(frames.rows())
    gone = [r for r in found if r[3]]
    assert [(r[0], r[1]) for r in sorted(gone)] == [(2, ""), (2, "")]
    assert all((r[0], r[1]) in by_text for r in found if not r[3])
    assert lines.dedup_lines(frames.empty(spark)).collect() == []


def test_line_dedup_runs_no_python(spark):
    frame = spark.createDataFrame(line_rows(1), "doc_id long, text string")
    plans = [lines.dedup_lines(frame), mixing.mix(frames.awkward(spark))]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|BroadcastNestedLoop|Cartesian", text)


# Mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {name: weights[n % 3] for n, name in enumerate(names)}
    budget, left = share * sum(sizes.values()), set(names)
    target = {}
    while left:
        level = (budget - sum(target.values())) / sum(weight[n] for n in left)
        full = {n for n in left if level * weight[n] > most * sizes[n]}
        if not full:
            return target | {n: level * weight[n] for n in left}
        target |= {n: most * sizes[n] for n in full}
        left -= full
    return target


def mix_rows():
    chance = random.Random(9)
    sources = ["b", "a", "é", "Z", None, "tiny", "hot"]
    return [
        (n, " ".join(["w"] * chance.randrange(0, 40)), "en", source)
        for n, source in enumerate(chance.choices(sources, [5, 5, 5, 5, 5, 1, 30], k=600))
    ]


def test_mix_meets_its_targets(spark):
    rows = mix_rows()
    sizes = {}
    for row in rows:
        sizes[row[3]] = sizes.get(row[3], 0) + len(words_of(row[1]))
    target = brute_targets(sizes)
    frame = spark.createDataFrame(rows, frames.DOCUMENTS)
    found = mixing.mix_plan(frame).collect()
    again = mixing.mix_plan(frame.repartition(5)).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    source = {row[0]: row[3] for row in rows}
    taken = dict.fromkeys(sizes, 0)
    for row in found:
        assert row.size == len(words_of(rows[row.doc_id][1]))
        assert row.source_size == sizes[source[row.doc_id]]
        assert row.target == pytest.approx(target[source[row.doc_id]])
        assert row.taken in (0, row.size, 2 * row.size)
        taken[source[row.doc_id]] += row.taken
    for name, words in taken.items():
        assert abs(words - target[name]) <= 80
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    mixed = mixing.mix(frame).collect()
    assert sum(len(words_of(row.text)) for row in mixed) == sum(taken.values())


def test_mix_on_awkward_rows(spark):
    frame = frames.awkward(spark)
    plan = mixing.mix_plan(frame).collect()
    assert len(plan) == len(frames.rows())
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    assert out.count() == sum(row.times for row in plan if row.size)
    assert mixing.mix_plan(frames.empty(spark)).collect() == []
    assert mixing.mix(frames.empty(spark)).collect() == []


# Main text

PROSE = "the cat is on the mat and it was in the house of the king for the night"


def test_main_text_of_an_article():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body
    class="has-sidebar"><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="ad">Buy the best of all</div><article><h1>A &amp; B</h1><p><b>One<br>two
    &nbsp; three<p>Short.<script>var x = "</p>";</script><form><p>Name</p></form>
    <aside>{PROSE}</aside><p>&lt;tag&gt; caf&eacute; &#x41;</p><ul><li><a href=y>More</a></ul>
    <div id="comments"><p>{PROSE}</p></div></article><div class="cookie-notice">{PROSE}</div>
    <footer>&copy; all</footer>"""
    assert main_text.main_text(page) == "A & B\n\nOne two three\n\nShort.\n\n<tag> café A"


def test_main_text_without_an_article():
    page = f"""<div class="header">Big site</div><div><h2>Head</h2><p>{PROSE}</p><p>Brief one.</p>
    <p>{PROSE}</p><p><a href=a>go</a> <a href=b>there</a></p></div><p>Far off</p>
    <p>{"alpha beta gamma delta " * 5}</p><![if x]><p>Copyright</p>"""
    assert main_text.main_text(page) == f"Head\n\n{PROSE}\n\nBrief one.\n\n{PROSE}"


@pytest.mark.parametrize(
    "names",
    [
        'class="content has-sidebar"',
        'id="page" class="no-sidebar"',
        'class="site comments-open"',
        'class="sticky-header"',
        'class="content sidebar-left"',
        'class="search-page"><div class="nav-layout"',
    ],
)
def test_main_text_in_a_container_named_after_furniture(names):
    rest = f"""<div class="sidebar"><p>{PROSE}</p></div><div id="comments"><article>{PROSE}
    <p>{PROSE}</p></article></div><div class="ad">{PROSE}</div>"""
    page = f"<nav>Home</nav><div {names}><article><h1>Title</h1><p>{PROSE}</p></article>{rest}"
    assert main_text.main_text(page) == f"Title\n\n{PROSE}"
    page = f"<nav>Home</nav><div {names}><p>{PROSE}</p><p>{PROSE}</p><div class=ad>{PROSE}</div>"
    assert main_text.main_text(page) == f"{PROSE}\n\n{PROSE}"


def test_main_text_in_pieces_of_one_name():
    piece = f'<div class="elementor-widget"><p>{PROSE}</p></div>'
    page = f"""<article><h1>A</h1>{piece}{piece}<section id="how-to-share-a-widget"><p>Short.</p>
    </section><div class="comments">{PROSE}</div></article>"""
    assert main_text.main_text(page) == f"A\n\n{PROSE}\n\n{PROSE}\n\nShort."


def test_main_text_beside_teasers_in_articles():
    card = "<article><h3><a href=x>A linked title</a></h3><p>Few words here.</p></article>"
    page = f"<div><h1>Head</h1><p>{PROSE}</p><p>Brief.</p><p>{PROSE}</p></div>{card}{card}"
    assert main_text.main_text(page) == f"Head\n\n{PROSE}\n\nBrief.\n\n{PROSE}"
    page = f"<article><p>Brief.</p><p>{PROSE}</p></article><p>Far off</p><div><p>{PROSE}</p></div>"
    assert main_text.main_text(page) == f"Brief.\n\n{PROSE}\n\nFar off\n\n{PROSE}"


def test_main_text_with_links_in_an_article():
    links = "".join(f"<li><a href={n}>Link {n}</a>" for n in range(4))
    page = f"""<nav>Home</nav><article><ul>{links}</ul><h1><a href=x>Title</a></h1><p>{PROSE}</p>
    <p>See <a href=x>the full report</a>.</p><ul><li><a href=x>A source</a></ul><p>{PROSE}</p>
    <ul>{links}</ul><p>Last.</p><p><a href=x>More on it</a></p></article><footer>All</footer>"""
    listed = "\n\n".join(f"Link {n}" for n in range(4))
    text = f"Title\n\n{PROSE}\n\nSee the full report.\n\nA source\n\n{PROSE}\n\n{listed}"
    assert main_text.main_text(page) == f"{text}\n\nLast.\n\nMore on it"
    page = f"<article><p>{PROSE}</p><ul>{links}</ul><div class=ad>Buy</div><p>Last.</p></article>"
    assert main_text.main_text(page) == f"{PROSE}\n\nLast."


def test_main_text_without_stop_words():
    italian = "Ogni mattina gli operai arrivano presto davanti alla fabbrica, poi bevono caffè"
    chinese = "每天早上工人们很早就来到工厂门口然后他们一起喝咖啡聊天再开始一天的工作"
    table = "alpha beta gamma delta " * 4
    for text in (italian, chinese):
        page = f"<h1>A</h1><p>{text}</p><p>Sì</p><p>{text}</p><p><a>{text}</a></p><p>far</p>"
        assert main_text.main_text(page) == f"A\n\n{text}\n\nSì\n\n{text}"
    page = f"<p>{PROSE}</p><pre>{table}</pre><p>{PROSE}</p><p><a>{PROSE}</a></p><p>{table}</p>"
    assert main_text.main_text(page) == f"{PROSE}\n\n{table.strip()}\n\n{PROSE}"


def test_main_text_asks_every_element_for_its_name():
    page = f"""<article><h2 id="comments">On comments</h2><p class="advert">{PROSE}<p>One <a
    class="promo" href=x>Buy</a><b class="ad">it <b>now</b> or</b> two.<p class="cookie-notice">
    <span>{PROSE}</p><ul><li class="comment">{PROSE}<ul><li>Reply</ul>{PROSE}<li>Item</ul>
    <table><tr class="ad"><td>{PROSE}<tr><td>Cell<td class="sponsored">{PROSE}<th>Side</table>
    <dl><dt class="ad">Term<dd>Meaning</dl><p class="related"><div>Div</div><p>{PROSE}"""
    kept = ["On comments", "One two.", "Item", "Cell", "Side", "Meaning", "Div", PROSE]
    assert main_text.main_text(page) == "\n\n".join(kept)


def test_main_text_of_many_open_elements():
    page = "<ul>" + "<li><b class=x>" * 20_000 + "<td><dd>" * 5_000 + f"</ul><p>{PROSE}"
    assert main_text.main_text(page) == PROSE


def brute_main_text(parts):
    """Kept texts of (place, [(kind, text)]): every short block looks about on its own.

    Where no block of the page is good by itself, the short ones are its text.
    """
    labels = [
        [
            {"good": True, "nav": False, "linked": False}.get(kind, True if inside else None)
            for kind, _ in blocks
        ]
        for inside, blocks in parts
    ]
    if not any(mark for marks in labels for mark in marks):
        labels = [[True if mark is None else mark for mark in marks] for marks in labels]
    out = []
    for (_, blocks), marks in zip(parts, labels, strict=True):
        decided = [n for n, mark in enumerate(marks) if mark is not None]
        for n, (kind, text) in enumerate(blocks):
            gap = min((abs(m - n) for m in decided), default=None)
            near = [m for m in decided if abs(m - n) == gap]
            votes = {marks[m] for m in near}
            if votes == {True} or len(votes) == 2 and kind == "h" and marks[near[-1]]:
                out.append(text)
    return "\n\n".join(out)


def test_main_text_equals_brute_force(spark):
    chance = random.Random(3)
    rows, expected = [], []
    for ident in range(300):
        parts, html = [], []
        for _ in range(chance.randrange(1, 4)):
            inside = ident % 2 == 1 and (not parts or not parts[-1][0])
            kinds = chance.choices(["good", "short", "h", "nav", "linked"], k=chance.randrange(1, 9))
            if inside:
                kinds += ["good"] * 9
                kinds = [kind for kind in kinds if kind != "linked"]
            blocks = [
                (kind, f"{kind} {n} {PROSE}" if kind in ("good", "linked") else f"{kind} {n}")
                for n, kind in enumerate(kinds)
            ]
            marks = {"nav": "<nav>{}</nav>", "linked": "<p><a>{}</a></p>", "h": "<h2>{}</h2>"}
            body = "".join(marks.get(kind, "<p>{}</p>").format(text) for kind, text in blocks)
            html.append(f"<article>{body}</article>" if inside else f"<div>{body}</div>")
            if parts and not inside and not parts[-1][0]:
                parts[-1][1].extend(blocks)
            else:
                parts.append((inside, blocks))
        rows.append((ident, "".join(html)))
        expected.append((ident, brute_main_text(parts)))
    frame = spark.createDataFrame(rows, "page_id long, html string")
    found = main_text.extract(frame, keep=["page_id"]).select("page_id", "text").collect()
    assert sorted(map(tuple, found)) == expected
    assert len({text == "" for _, text in expected}) == 2


def test_unsure_blocks_inherit():
    good, bad, unsure = main_text.GOOD, main_text.BAD, main_text.UNSURE
    plain = [False] * 5
    assert main_text.settle([good, unsure, unsure, unsure, bad], plain) == [1, 1, 0, 0, 0]
    heading = [False, False, True, False, False]
    assert main_text.settle([bad, unsure, unsure, unsure, good], heading) == [0, 0, 1, 1, 1]
    assert main_text.settle([unsure], [True]) == [False]


def test_main_text_on_awkward_rows(spark):
    pages = [(1, None, "x"), (2, "", "x"), (3, f"<article>{PROSE}", "x"), (3, "<p", "x")]
    pages += [(4, "<p>" * 20_000 + PROSE, "x"), (5, "<article>" + f"<p>{PROSE}" * 5000, "x")]
    frame = spark.createDataFrame(pages, "page_id long, html string, text string")
    found = sorted(map(tuple, main_text.extract(frame).collect()))
    assert [(r[0], r[2]) for r in found[:4]] == [(1, 0), (2, 0), (3, 0), (3, len(PROSE))]
    assert found[4][1] == PROSE
    assert found[5][1] == "\n\n".join([PROSE] * 5000)
    assert main_text.extract(frame.limit(0)).collect() == []


# Languages


def test_forward_backward_equals_enumeration():
    chance = np.random.default_rng(1)
    potentials, matrix = chance.random((9, 3)) + 0.1, chance.random((3, 3)) + 0.1
    starts, lengths = np.array([0, 4, 5]), np.array([4, 1, 4])
    posterior, _ = langid.forward_backward(potentials.copy(), matrix, starts, lengths)
    for start, length in zip(starts, lengths, strict=True):
        total = np.zeros((length, 3))
        for path in itertools.product(range(3), repeat=int(length)):
            weight = np.prod([potentials[start + n, label] for n, label in enumerate(path)])
            weight *= np.prod([matrix[a, b] for a, b in itertools.pairwise(path)])
            for n, label in enumerate(path):
                total[n, label] += weight
        want = total / total.sum(1, keepdims=True)
        assert np.allclose(posterior[start : start + length], want)


def test_held_out_languages(spark):
    import zlib

    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(documents).collect()
    truth = dict(documents.select("doc_id", "lang").collect())
    assert len(found) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_code_switching_is_followed():
    english = "the cat of the house and the king with that night".split()
    french = "les chats de la maison et le roi avec cette nuit".split()
    model = langid.fit([("en", english)] * 30 + [("fr", french)] * 30)
    tagger = langid.Tagger(model)
    text = " ".join([*english, *french, *french]).encode()
    shares, lengths = tagger.tag([text, None, b"12 ...", text])
    assert lengths.tolist() == [33, 0, 0, 33]
    assert shares[0, model.languages.index("fr")] == pytest.approx(2 / 3, abs=0.1)


def test_languages_on_awkward_rows(spark):
    found = langid.identify(frames.awkward(spark)).collect()
    assert len(found) == len(frames.rows())
    und = [r.doc_id for r in found if r.lang_pred == "und"]
    assert sorted(und, key=lambda v: (v is None, v)) == [3, 4, 5, 9, None]
    assert all(r.held_out is False for r in found if r.doc_id is None)
    assert langid.identify(frames.empty(spark)).collect() == []
    unlabelled = frames.empty(spark).union(
        spark.createDataFrame([(1, "text", None, None)], frames.DOCUMENTS)
    )
    assert [tuple(r)[2:] for r in langid.identify(unlabelled).collect()] == [("und", 0.0)]


# Quality


def test_accuracies_are_recovered():
    chance = np.random.default_rng(5)
    good = chance.random(20_000) < 0.8
    rates = np.array([[0.7, 0.02], [0.5, 0.01], [0.6, 0.05], [0.4, 0.02]])
    alarm = chance.random((len(good), 4)) < rates[:, good.astype(int)].T
    speaks = chance.random(alarm.shape) < 0.9
    votes = np.where(speaks, np.where(alarm, -1, 1), 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(model.alarm - rates).max() < 0.06
    assert abs(model.prior - 0.8) < 0.03


def test_quality_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    truth = dict(
        spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()
    )
    found = {r.doc_id: r for r in quality.classify(documents).collect()}
    assert len(found) == documents.count()
    right = [found[ident].kept == bool(value) for ident, value in truth.items()]
    assert sum(right) >= 0.95 * len(right)


def test_quality_on_awkward_rows(spark):
    found = quality.classify(frames.awkward(spark)).collect()
    assert len(found) == len(frames.rows())
    blank = [r for r in found if r.n_words == 0]
    assert len(blank) == 4 and not any(r.kept or r.score for r in blank)
    same = {(r.score, r.weak_label) for r in found if r.doc_id == 2}
    assert len(same) == 1
    assert quality.classify(frames.empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, " ", None, None)], frames.DOCUMENTS)
    assert [tuple(r) for r in quality.classify(blank).collect()] == [(1, 0, 0.0, 0.0, False)]


def test_numbers_without_a_letter_have_no_letters():
    assert "".join(map(langid.letters_of, "² ½ ① Ⅷ 12 ٣ _".split())) == ""
    assert langid.letters_of("x²Y½") == "xy"


STORY = "The story of the house is that it was on the hill and all of the people in it were well. "


def test_comments_and_adverts_in_articles_go():
    for markup, kept in {
        f"<article><p>{STORY * 3}</p></article><article class='comment'><p>{STORY}</p></article>": 1,
        f"<article><p>{STORY * 3}</p></article><article class='promo'><p>{STORY}</p></article>": 1,
        f"<div class='post'><p>{STORY * 3}</p></div><section id='comments'>"
        f"<article><p>{STORY}</p></article><article><p>{STORY}</p></article></section>": 1,
        f"<article><p>{STORY * 3}</p></article><ol class='commentlist'><li>{STORY}</li></ol>": 1,
        f"<article><p>{STORY * 3}</p></article><div class='user-responses'><p>{STORY}</p></div>": 1,
        f"<article><p>{STORY * 3}</p><div hidden><p>{STORY}</p></div></article>": 1,
        f"<article class='post promo'><p>{STORY * 3}</p></article>": 1,
    }.items():
        assert main_text.main_text(markup).split("\n\n") == [(STORY * 3).strip()] * kept, markup


def test_a_page_of_short_blocks_keeps_its_text():
    page = (
        "<nav><a href=x>Home</a></nav><h1>Recipe</h1><p>Mix flour and water.</p><p>Bake it.</p>"
        "<p><a href=y>More recipes</a></p><footer>Imprint</footer>"
    )
    assert main_text.main_text(page) == "Recipe\n\nMix flour and water.\n\nBake it."


def test_hostile_pages_take_linear_time():
    for piece in ("<!--", "<a ", "<![CDATA[", "<a b='", "<a>x", "<div>", "<li>x", "</p"):
        start = time.process_time()
        main_text.main_text(piece * ((1 << 19) // len(piece)))
        assert time.process_time() - start < 12, piece


def test_quality_works_out_a_pattern_of_characters_once(monkeypatch):
    asked, real = [], quality._facts_of
    monkeypatch.setattr(quality, "_facts_of", lambda word: asked.append(word) or real(word))
    known = quality.WordFacts()
    plain = [f"id{n}x" for n in range(10, 99)] + ["the", "und", "été", "\"und\"", "$$a!!"]
    odd = ["İst", "Ⓐ", "ǅ", "ﬁ²", "١٢"]
    for word in plain + odd:
        known[word.encode()]
    known.learn()
    assert len(asked) == 4 + len(odd)
    for word, number in known.items():
        text = word.decode()
        *facts, _, hashed = real(text)
        stop = text.strip(".,;:!?\"'()").lower() in quality.STOP_WORDS
        assert known.facts[number].tolist() == [*map(float, facts), float(stop)]
        assert known.shape[number] == hashed
