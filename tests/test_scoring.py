import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagerisk.functions import text as X
from pagerisk.functions.encoders import TrigramEncoder, encode_distinct
from pagerisk.operators import evaluation as E, labeling as L, scoring, similarity as S
from pagerisk.operators.blocks import compare_in_cells
from pagerisk.operators.scoring import FEATURES

ENCODER = TrigramEncoder()


def brute_nearest(queries, vectors, labels):
    out = []
    for q in queries:
        best = None
        for i, v in enumerate(vectors):
            if not np.any(q) or not np.any(v):
                continue
            sim = (float(q @ v) / (np.linalg.norm(q) * np.linalg.norm(v)) + 1) / 2
            if best is None or sim > best[0] + 1e-12:
                best = (sim, labels[i], i)
        out.append(best)
    return out


def test_cosine01(spark):
    rows = [([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 3.0]), ([1.0], [-2.0]), ([0.0], [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r.s for r in S.with_cosine01(df, "a", "b", "s").collect()]
    assert got[:3] == pytest.approx([1.0, 0.5, 0.0]) and got[3] is None


def test_mean_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 5.0])], "g int, v array<double>")
    got = {r.g: r["mean"] for r in S.mean_vector(df, ["g"], "v").collect()}
    assert got == {1: [2.0, 3.0], 2: [5.0, 5.0]}


def test_encoder_is_stable_and_deduplicates():
    a, b = ENCODER.encode(["Hello"]), TrigramEncoder().encode(["hello"])
    assert (a == b).all() and a.any()
    assert not ENCODER.encode([""]).any()
    calls = []

    class Counting(TrigramEncoder):
        def encode(self, texts):
            calls.append(list(texts))
            return super().encode(texts)

    vectors, positions = encode_distinct(Counting(), ["x", "yy", "x"])
    assert calls == [["x", "yy"]] and positions.tolist() == [0, 1, 0] and len(vectors) == 2


@pytest.mark.parametrize("bound", [S.BROADCAST_BYTES, 2048])
def test_nearest_headline_equals_brute_force(spark, bound):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (40, 8)).astype(float)
    vectors[7] = vectors[3]
    vectors[9] = 0
    queries = np.vstack([rng.integers(-3, 4, (25, 8)).astype(float), vectors[3], np.zeros(8)])
    labels = [i % 2 for i in range(40)]
    corpus = spark.createDataFrame(
        [(i, v.tolist(), l) for i, (v, l) in enumerate(zip(vectors, labels))],
        "idx long, embedding array<double>, label int",
    )
    contents = spark.createDataFrame(
        [(i, q.tolist()) for i, q in enumerate(queries)] + [(99, None)], "key int, embedding array<double>"
    )
    found = S.HeadlineCorpus(corpus, bound)
    assert found.small == (bound > 10_000)
    got = {r.key: r for r in S.nearest_headline(contents, found, "key").collect()}
    for i, expected in enumerate(brute_nearest(queries, vectors, labels)):
        if expected is None:
            assert got[i].sim is None and got[i].label is None
        else:
            assert (got[i].label, got[i].idx) == expected[1:] and math.isclose(got[i].sim, expected[0])
    assert got[99].sim is None and len(got) == len(queries) + 1


def test_cells_leave_most_of_the_corpus_out(spark):
    rng = np.random.default_rng(9)
    groups = rng.normal(size=(60, 16))
    vectors = np.repeat(groups, 60, axis=0) + rng.normal(scale=0.08, size=(3600, 16))
    vectors[100:130] = vectors[99]
    queries = groups[rng.integers(0, 60, 200)] + rng.normal(scale=0.08, size=(200, 16))
    labels = [i % 2 for i in range(len(vectors))]
    corpus = spark.createDataFrame(
        [(i, v.tolist(), l) for i, (v, l) in enumerate(zip(vectors, labels))],
        "idx long, embedding array<double>, label int",
    )
    contents = spark.createDataFrame(
        [(f"q{i}", q.tolist()) for i, q in enumerate([*queries, vectors[110], np.zeros(16)])],
        "name string, vector array<double>",
    )
    found = S.nearest_in_cells(contents, S.HeadlineCorpus(corpus, 1), "name", cell_rows=100)
    got = {r.name: r for r in found.collect()}
    for i, expected in enumerate(brute_nearest(np.vstack([queries, vectors[110]]), vectors, labels)):
        row = got[f"q{i}"]
        assert (row.label, row.idx) == expected[1:] and math.isclose(row.sim, expected[0])
    assert got["q200"].idx == 99 and "q201" not in got
    assert sum(r.compared for r in got.values()) < len(got) * len(vectors) / 10


def test_nearest_is_exact_in_blocks(monkeypatch):
    monkeypatch.setattr(S, "_QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(S, "_ROWS_AT_ONCE", 5)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(40, 8))
    vectors[20] = vectors[4] * (1 + 1e-12)
    vectors[30:33], vectors[9] = vectors[2], 0
    vectors[21] = vectors[7] + rng.normal(scale=1e-6, size=8)  # told apart in double precision only
    queries = np.vstack([rng.normal(size=(20, 8)), vectors[[2, 7, 21, 31]], np.zeros((1, 8))])
    sims, rows = S._Nearest(vectors, np.arange(40)).search(queries)
    for i, expected in enumerate(brute_nearest(queries[:20], vectors, [0] * 40)):
        assert rows[i] == expected[2] and math.isclose(sims[i], expected[0])
    assert rows[20:24].tolist() == [2, 7, 21, 2] and np.isnan(sims[24])


def test_visits_are_taken_in_bounded_slices():
    sizes = np.array([3, 3, 3, 50, 1, 1])
    slices = S._slices(sizes, 10)
    assert [i for part in slices for i in range(len(sizes))[part]] == list(range(len(sizes)))
    assert max(sizes[part].sum() for part in slices) <= 10 + sizes.max()
    assert S._slices(sizes[:0], 10) == []


def test_cells_keep_tasks_of_their_own(spark):
    rows = [(i, i % 8) for i in range(400)]
    left, right = (spark.createDataFrame(rows, "idx long, group int") for _ in range(2))
    counts = np.full(8, 50)

    def compare(a, b):
        return a.select(["idx"])

    out = compare_in_cells(left, counts, right, counts, "group", compare, "idx long", cell_rows=50)
    assert out.rdd.getNumPartitions() >= 8 and out.count() == 400


def test_large_corpus_is_not_broadcast(spark):
    corpus = spark.createDataFrame([(1, [1.0], 1)], "idx long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        S.HeadlineCorpus(corpus, 1).shared()


def test_url_content_similarity(spark):
    df = spark.createDataFrame(
        [("https://shop.com/red-shoes", ["red shoes", "shop"]), ("https://shop.com/red-shoes", [])],
        "url string, content array<string>",
    )
    same, empty = S.url_content_similarity(df, ENCODER).collect()
    assert 0.5 < same.similarity <= 1 and (empty.similarity, empty.match) == (0.0, False)


def test_texts_at_right_angles_are_exactly_half_similar(spark):
    title = "Lere\u00e8 et est\u00e9eaureque de leaiaux\u00e9re oueuxtre."
    rows = [("https://m.ththed.example.net/fr/174625?utm_source=feed", [title, title])]
    pages = spark.createDataFrame(rows, "url string, content array<string>")
    found = S.url_content_similarity(pages, TrigramEncoder(), threshold=0.5).first()
    assert (found.similarity, found.match) == (0.5, True)


def test_compare_encoders(spark):
    pages = spark.createDataFrame([("http://a/", "<title>a</title>"), ("http://b/", "<h1>b</h1>")], "url string, html string")
    rows = S.compare_encoders(pages, [ENCODER, TrigramEncoder("other", 16)]).collect()
    assert S.compare_encoders(pages, [ENCODER], preview=1).count() == 1
    assert sorted((r.Model, r.URL) for r in rows) == sorted(
        (m, u) for m in ("hashed-trigrams-64", "other") for u in ("http://a/", "http://b/")
    )


def test_fear_score(spark):
    rows = [(1, X.FEAR_LABEL, 0.9), (1, X.FEAR_LABEL, 0.7), (1, X.NO_FEAR_LABEL, 0.99), (2, X.NO_FEAR_LABEL, 0.8)]
    predictions = spark.createDataFrame(rows, "page_id int, label string, score double")
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_id int")
    got = {r.page_id: r.fear_score for r in scoring.fear_score(predictions, "page_id", pages).collect()}
    assert got == {1: pytest.approx(0.8), 2: 0.0, 3: 0.0}


def test_fear_score_of_array(spark):
    df = spark.createDataFrame([(["Deadly crisis!", "calm", "PANIC"],), ([],), (["fearless"],)], "h array<string>")
    got = [r.s for r in df.select(scoring.fear_score_of(F.col("h")).alias("s")).collect()]
    assert got == [pytest.approx((2 / 3 + 1 / 2) / 2), 0.0, 0.0]


@pytest.mark.parametrize("sentence, errors", [
    ("All is well.", 0), ("lower case start.", 1), ("The the end.", 1), ("So so so it goes.", 2),
    ("What?!", 1), ("Space , here.", 1), ("No,space.", 1), ("It is a apple.", 1), ("It is an cat.", 1),
    ("Open (bracket.", 1), ('A "quote.', 1), ("", 0),
])
def test_grammar_rules(spark, sentence, errors):
    df = spark.createDataFrame([([sentence],)], "s array<string>")
    assert df.select(X.grammar_error_rate("s").alias("r")).first().r == errors


def test_grammar_rate(spark):
    df = spark.createDataFrame([("fine not. Well done.",), ("",)], "t string")
    assert [r.r for r in scoring.grammar_scores(df, "t", "r").collect()] == [0.5, 0.0]


CLICKBAIT = """<html><head><title>Breaking: You Won't Believe What Happened!</title></head><body>
<h1>This New Discovery Will Change Everything!</h1><h2>Experts Are Warning About an Upcoming Crisis</h2>
<h3>Find Out the Hidden Truth Behind These Events</h3></body></html>"""
HEADLINES = [
    (0, "You Won't Believe What Happened", 1), (1, "Parliament passes the budget", 0),
    (2, "This New Discovery Will Change Everything", 1), (3, "Experts warn about a crisis", 0),
]


def corpus(spark, bound=S.BROADCAST_BYTES):
    rows = spark.createDataFrame(HEADLINES, "idx long, headline string, clickbait int")
    return S.read_corpus(rows, ENCODER, broadcast_bytes=bound)


def pages(spark):
    return spark.createDataFrame(
        [
            ("https://example.com/shocking-news", CLICKBAIT),
            ("https://example.com/normal", "<title>A Normal Article</title><body><p>This is normal.</p></body>"),
            ("https://example.com/none", None),
        ],
        "url string, html string",
    )


def test_clickbait_features(spark):
    rows = {r.url.rsplit("/")[-1]: r for r in scoring.clickbait_features(pages(spark), corpus(spark)).collect()}
    loud = rows["shocking-news"]
    assert 0 < loud[FEATURES[0]] < 1
    assert loud[FEATURES[1]] == pytest.approx(2 / 3), "one heading, two fear words"
    assert loud[FEATURES[3]] == 0.5, "two of four strings have a close clickbait headline"
    assert rows["none"][FEATURES[2]] == 0.0 and rows["none"][FEATURES[3]] == 0.0


def test_labels_per_threshold_and_large_corpus(spark):
    def rows(bound):
        labelled = L.label_pages(pages(spark), corpus(spark, bound), [0.5, 0.75])
        return sorted((r.url, r.threshold, *(round(r[f], 9) for f in FEATURES), r.label) for r in labelled.collect())

    small = rows(S.BROADCAST_BYTES)
    assert len(small) == 6 and rows(64) == small


def test_equal_pages_stay_separate_rows(spark):
    copies = pages(spark).union(pages(spark))
    for bound in (S.BROADCAST_BYTES, 64):
        assert L.label_pages(copies, corpus(spark, bound), [0.5]).count() == 6


def test_batched_labels_equal_plain_ones(spark):
    three = spark.createDataFrame(
        [(7 * i, f"https://example.com/{i}", f"<p>Article {i}</p>") for i in range(3)],
        "page_id long, url string, html string",
    )
    plain = L.label_pages(three.drop("page_id"), corpus(spark), [0.5, 0.75]).collect()
    batched = L.label_pages_in_batches(three, corpus(spark), [0.5, 0.75], batch_size=2)
    assert len(plain) == 6 and sorted(plain) == sorted(batched.drop("batch").collect())
    assert {(r.url[-1], r.batch) for r in batched.collect()} == {("0", 0), ("1", 0), ("2", 1)}
    assert L.label_pages_in_batches(three.limit(0), corpus(spark), [0.5]).count() == 0


def test_flagship_plan_has_no_shuffle(spark):
    plan = L.label_pages(pages(spark), corpus(spark), [0.5, 0.75])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") <= 3


def test_label_is_at_least_threshold(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5), (0.0, 0.0, 1.9, 0.0), (0.0, 0.0, 3.0, 0.0)], list(FEATURES))
    assert [r.label for r in L.label_features(df).collect()] == [1, 0, 1]


def test_constant_features_have_scale_one(spark):
    df = spark.range(1000).repartition(3).selectExpr(
        "0.1 + 0 * id AS a", "cast(0.1 AS double) AS b", "0.1D + 1e-17D * (id % 2) AS c", "id * 1D AS d",
    ).selectExpr("cast(a AS double) a", "b", "c", "d")
    scale = dict(L.scaler_stats(df, ["a", "b", "c", "d"]).select("feature", "scale").collect())
    assert (scale["a"], scale["b"], scale["c"]) == (1.0, 1.0, 1.0) and scale["d"] > 200


def test_soft_vote(spark):
    data = np.array([[0.1, 1, 0.2, 5], [0.4, 1, 0.9, 1], [0.9, 1, 0.1, 2]])
    df = spark.createDataFrame(data.tolist(), list(FEATURES))
    scaler = L.fit_scaler(df, weights=[0.2, 0.2, 0.2, 0.4])
    std = data.std(axis=0)
    std[std == 0] = 1
    expected = (data - data.mean(axis=0)) / std @ np.array([0.2, 0.2, 0.2, 0.4])
    rows = L.soft_vote(df, scaler).orderBy(FEATURES[0]).collect()
    assert [r.vote_score for r in rows] == pytest.approx(expected.tolist())
    assert [r.vote_label for r in rows] == [int(s >= 0.5) for s in expected]
    assert L.fit_scaler(df).weights == (0.25,) * 4


def test_metrics(spark):
    rows = [("perfect", i, i % 2, i % 2) for i in range(4)] + [("negative", i, i % 2, 0) for i in range(4)]
    df = spark.createDataFrame(rows, "model string, sample_id int, y_true int, y_pred int")
    got = {r.model: (r.f1, r.accuracy, r.precision) for r in E.evaluate_models(df).collect()}
    assert got == {"perfect": (1.0, 1.0, 1.0), "negative": (0.0, 0.5, 0.0)}


def test_faulty_models_do_not_stop_the_others(spark):
    rows = [("good", i, i % 2, i % 2) for i in range(4)] + [("short", i, 1, 1) for i in range(3)]
    rows += [("null", i, 1, None if i == 0 else 1) for i in range(4)] + [("three", i, 1, 3) for i in range(4)]
    df = spark.createDataFrame(rows, "model string, sample_id int, y_true int, y_pred int")
    checked = E.evaluate_models_checked(df, ["good", "short", "null", "three", "absent"], 4)
    got = {r.model: r for r in checked.collect()}
    assert got["good"].f1 == 1.0 and got["good"].error is None
    assert all(math.isnan(got[m].f1) and got[m].error for m in ("short", "null", "three", "absent"))
    with pytest.raises(ValueError):
        E.evaluate_models_checked(df, [], 4)


def test_split_is_stable(spark):
    whole = E.split_train_test(spark.range(1000), "id").orderBy("id").collect()
    again = E.split_train_test(spark.range(1000).repartition(7), "id").orderBy("id").collect()
    assert whole == again and 600 < sum(r.is_train for r in whole) < 800


def test_training(spark):
    from pagerisk.operators import training as M
    from pagerisk.session import scratch_path

    rng = np.random.default_rng(42)
    x = rng.normal(size=(100, 4))
    data = [(i, *map(float, row), float(row[0] + row[1] > 0)) for i, row in enumerate(x)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, d double, label double")
    rows = E.split_train_test(M.assemble(df, list("abcd")), "id").repartition(1).cache()
    train, test = rows.filter("is_train"), rows.filter("not is_train")
    models = {a: M.train_label_model(train, a, trees=5, bags=3, max_iter=3) for a in M.ALGORITHMS}
    predictions = M.predictions_of(models, test, "id", "label")
    metrics = {r.model: r.accuracy for r in E.evaluate_models(predictions).collect()}
    assert set(metrics) == set(M.ALGORITHMS) and min(metrics.values()) > 0.6
    tuned = M.train_label_model(train, M.RANDOM_FOREST, trees=3, folds=2)
    assert tuned.getNumTrees == 3
    svm = M.train_label_model(train, M.BAGGED_SVM, bags=2, max_iter=3, folds=2)
    assert len({m.getRegParam() for m in svm.models}) == 1 and len(svm.models) == 2
    loaded = {}
    for name, model in models.items():
        path = scratch_path(spark, "model")
        M.save_model(model, path)
        loaded[name] = M.load_model(spark, path)
    again = M.predictions_of(loaded, test, "id", "label")
    assert sorted(again.collect()) == sorted(predictions.collect())
    with pytest.raises(ValueError):
        M.train_label_model(train, "other")


def test_text_classifier(spark):
    from pagerisk.operators.training import classify_text, train_text_classifier

    rows = [("deadly crisis ahead", 1), ("calm sunny day", 0)] * 5
    df = spark.createDataFrame(rows, "text string, label int")
    model = train_text_classifier(df, features=256, max_iter=5)
    got = {r.text: r.label_name for r in classify_text(model, df).collect()}
    assert got == {"deadly crisis ahead": X.FEAR_LABEL, "calm sunny day": X.NO_FEAR_LABEL}


def test_a_shared_corpus_is_small_and_as_exact():
    import pickle

    chance = np.random.default_rng(9)
    counts = chance.integers(-40, 40, (500, 64)).astype(float)
    queries = chance.integers(-3, 3, (50, 64)).astype(float)
    numbers = np.arange(500)
    for vectors in (counts, counts / 3, counts * 1e4, counts / 4):
        plain, small = S._Nearest(vectors, numbers), S._Nearest(vectors, numbers, True)
        for a, b in zip(plain.search(queries), small.search(queries)):
            assert np.array_equal(a, b)
        assert np.array_equal(small.vectors, plain.vectors)
    size = len(pickle.dumps(S._Nearest(counts, numbers, True)))
    assert size < 500 * (2 * 64 + 32) + 1000


def test_pages_meet_a_large_corpus_in_more_tasks(spark, monkeypatch):
    from types import SimpleNamespace

    from pagerisk.plans import label_queries as Q

    monkeypatch.setattr(Q, "PAIRS_PER_TASK", 10)
    folder = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    want = -(-pages.count() * 3 // 10)
    many = Q.pages_against(spark, folder, SimpleNamespace(small=True, rows=3))
    assert many.rdd.getNumPartitions() == max(want, spark.sparkContext.defaultParallelism)
    assert sorted(r.page_id for r in many.collect()) == sorted(r.page_id for r in pages.collect())
