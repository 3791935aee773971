import random
import pytest
from pyspark.sql import Row

from pagerisk.operators import batches as B
from pagerisk.schemas import LANDED, WEBPAGE
from pagerisk.session import materialise, scratch_path
from pagerisk.sources import page_store as S
from pagerisk.streaming.ingest import start_ingest


def landed(spark, rows, file_idx=0):
    data = [
        Row(
            file_idx=file_idx, record_no=i, url=r["url"], html=r.get("html"),
            embedded_scripts=r.get("embedded_scripts"), external_scripts=r.get("external_scripts"),
            title=r.get("title"), links=r.get("links"), headers=r.get("headers"),
        )
        for i, r in enumerate(rows)
    ]
    return materialise(spark.createDataFrame(data, LANDED), "test-landed")


def first_load():
    return [
        {"url": f"https://example{i}.com", "html": f"<p>{i}</p>", "embedded_scripts": [f"log({i})"],
         "external_scripts": [f"https://example{i}.com/s.js"]}
        for i in range(1, 231)
    ]


def second_load():
    return [
        {"url": f"https://example{i}.com", "html": "Updated", "title": f"Example {i}",
         "links": [f"https://example{i}.com/about", f"https://example{i}.com/contact"],
         "headers": [f"https://example{i}.com/a.js"], "embedded_scripts": []}
        for i in range(1, 236)
    ]


@pytest.fixture(scope="module")
def loaded(spark):
    root = scratch_path(spark, "test-store")
    one = S.ingest(spark, root, landed(spark, first_load()))
    two = S.ingest(spark, root, landed(spark, second_load()))
    return root, one, two


def test_batches_after_insert_and_update(spark, loaded):
    root, one, two = loaded
    assert one.state == (3, 30) and two.state == (3, 35)
    pages = S.read_pages(spark, root)
    sizes = {r.batch_id: r["count"] for r in pages.groupBy("batch_id").count().collect()}
    assert sizes == {1: 100, 2: 100, 3: 35}
    assert B.last_batch_id(pages).first().last_batch_id == 3
    assert B.count_batches(pages).first().batches == 3
    state = S.load_state(spark, root).first()
    assert (state.last_batch_id, state.last_item_index) == (3, 35)


def test_update_merges_fields(spark, loaded):
    pages = {r.url: r for r in S.read_pages(spark, loaded[0]).collect()}
    old, new = pages["https://example7.com"], pages["https://example233.com"]
    assert old.html == "Updated" and old.title == "Example 7" and len(old.links) == 2
    assert old.embedded_scripts == ["log(7)"], "an empty list replaces nothing"
    assert old.external_scripts == ["https://example7.com/s.js"]
    assert new.embedded_scripts == [] and new.external_scripts is None


def test_lookup_and_batch_reads(spark, loaded):
    root = loaded[0]
    assert S.read_lookup(spark, root).count() == 235
    rows = S.read_batches(spark, root, [3, 77]).collect()
    assert sum(r.batch_id == 3 for r in rows) == 35
    assert [r.url for r in rows if r.batch_id == 77] == [None]


def test_same_load_again_changes_nothing(spark, loaded):
    root = scratch_path(spark, "test-store")
    load = landed(spark, second_load())
    S.ingest(spark, root, load)
    before = sorted(map(repr, S.read_pages(spark, root).collect()))
    S.ingest(spark, root, load)
    assert sorted(map(repr, S.read_pages(spark, root).collect())) == before


def test_compaction_keeps_pages_and_state(spark, loaded):
    root, _, two = loaded
    before = sorted(map(repr, S.read_pages(spark, root).select("url", "html", "batch_id").collect()))
    after = S.compact(spark, root)
    assert after.state == two.state
    pages = S.read_pages(spark, root)
    assert sorted(map(repr, pages.select("url", "html", "batch_id").collect())) == before
    S.ingest(spark, root, landed(spark, [{"url": "https://new.com", "html": ""}]))
    assert S.read_pages(spark, root).count() == 236
    assert S.last_commit(spark, root).state == (3, 36)


def test_uncommitted_epoch_is_invisible(spark):
    root = scratch_path(spark, "test-store")
    S.ingest(spark, root, landed(spark, first_load()))
    stray = S.read_pages(spark, root).limit(5)
    stray.drop("batch_group").write.parquet(f"{root}/pages/epoch=2/batch_group=0")
    assert S.read_pages(spark, root).count() == 230


def test_empty_store(spark):
    root = scratch_path(spark, "test-store")
    assert S.last_commit(spark, root) == S.Commit()
    assert S.read_pages(spark, root).count() == 0
    assert S.load_state(spark, root).first().last_batch_id == 0


def webpages(spark, rows):
    from pagerisk.operators.urls import with_url_key

    data = [tuple(r.get(f.name) for f in WEBPAGE) for r in rows]
    return with_url_key(spark.createDataFrame(data, WEBPAGE))


def test_merge_pages(spark):
    store = webpages(spark, [
        {"url": "a", "html": "old", "links": ["x"], "title": "t"},
        {"url": "b", "html": "keep"},
    ])
    updates = webpages(spark, [
        {"url": "a", "html": "", "links": [], "title": None},
        {"url": "c", "html": "new", "links": []},
    ])
    merged = {r.url: r for r in B.merge_pages(store, updates).collect()}
    assert merged["a"].html == "" and merged["a"].links == ["x"] and merged["a"].title == "t"
    assert merged["b"].html == "keep" and merged["b"].links is None
    assert merged["c"].html == "new" and merged["c"].links == []


def test_fold_equals_merging_one_by_one(spark):
    import random

    rng = random.Random(7)
    versions = []
    for seq in range(1, 60):
        versions.append({
            "url": rng.choice("abcd"), "html": rng.choice([None, "", f"h{seq}"]),
            "title": rng.choice([None, f"t{seq}"]), "links": rng.choice([None, [], [f"l{seq}"]]),
        })
    expected = {}
    for v in versions:
        if v["url"] not in expected:
            expected[v["url"]] = dict(v)
            continue
        for field in ("html", "title", "links"):
            if v[field] is not None and v[field] != []:
                expected[v["url"]][field] = v[field]
    rows = [(s + 1, v["url"], v["url"], v["html"], v["title"], v["links"]) for s, v in enumerate(versions)]
    df = spark.createDataFrame(
        rows, "seq long, url_key string, url string, html string, title string, links array<string>"
    )
    got = {r.url: {k: r[k] for k in ("url", "html", "title", "links")} for r in B.fold_updates(df, ["seq"]).collect()}
    assert got == expected


def arrivals(spark, n, start=0, per_file=37, shift=0):
    return spark.range(start, start + n).selectExpr(
        "id", f"id div {per_file} as file_idx", f"id % {per_file} + {shift} as record_no"
    )


def batches_of(df):
    return [r.batch_id for r in df.orderBy("id").collect()]


def test_assign_batches(spark):
    got = batches_of(B.assign_batches(arrivals(spark, 230)))
    assert got == [1 + i // 100 for i in range(230)]
    resumed = batches_of(B.assign_batches(arrivals(spark, 80), B.BatchState(3, 30)))
    assert resumed == [3 + (30 + i) // 100 for i in range(80)]


def test_assign_in_two_calls_equals_one(spark):
    whole = batches_of(B.assign_batches(arrivals(spark, 310), B.BatchState(4, 60)))
    first = batches_of(B.assign_batches(arrivals(spark, 140), B.BatchState(4, 60)))
    state = B.next_state(spark.createDataFrame([(140,)], "n_new long"), B.BatchState(4, 60)).first()
    middle = B.BatchState(state.last_batch_id, state.last_item_index)
    second = batches_of(B.assign_batches(arrivals(spark, 170, 140), middle))
    assert first + second == whole


def test_dense_index_over_many_blocks_and_files(spark, monkeypatch):
    monkeypatch.setattr(B, "NUMBERING_BLOCK", 8)
    monkeypatch.setattr(B, "FILE_GROUP", 3)
    df = arrivals(spark, 500, shift=5)
    rows = B.dense_index(df, "file_idx", "record_no", "n").orderBy("id").collect()
    assert [r.n for r in rows] == list(range(500))


def test_numbering_windows_are_partitioned(spark):
    plan = B.assign_batches(arrivals(spark, 10))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    whole = [line for line in windows if "record_no" in line and "__block" not in line]
    assert windows and not whole


@pytest.mark.parametrize("state, n, expected", [
    ((0, 0), 0, (0, 0)), ((0, 0), 230, (3, 30)), ((3, 30), 70, (3, 0)), ((3, 0), 5, (4, 5)),
    ((3, 30), 0, (3, 30)), ((0, 0), 100, (1, 0)),
])
def test_next_state(spark, state, n, expected):
    row = B.next_state(spark.createDataFrame([(n,)], "n_new long"), B.BatchState(*state)).first()
    assert (row.last_batch_id, row.last_item_index) == expected and row.updated_at


def test_lookup_operators(spark):
    lookup = spark.createDataFrame([("a", 1), ("b", 2)], "url_key string, batch_id int")
    updates = spark.createDataFrame(
        [("b", 5, 1), ("c", 6, 2), ("c", 7, 3)], "url_key string, batch_id int, seq long"
    )
    got = {r.url_key: r.batch_id for r in B.upsert_lookup(lookup, updates).collect()}
    assert got == {"a": 1, "b": 5, "c": 7}
    keys = spark.createDataFrame([("a",), ("a",), ("z",)], "url_key string")
    assert [tuple(r) for r in B.lookup_batches(keys, lookup).collect()] == [("a", 1)]
    assert B.lookup_batches(keys.limit(0), lookup).count() == 0
    split = {r.url_key: r.is_new for r in B.classify_new_existing(keys.distinct(), lookup).collect()}
    assert split == {"a": False, "z": True}
    assert B.existing_pages(keys.distinct(), lookup).first().batch_id == 1


def test_document_form_drops_nulls(spark):
    row = B.document_json(webpages(spark, [{"url": "u", "title": "t"}]), ["url", "html", "title"]).first()
    assert row.document == '{"url":"u","title":"t"}'


def test_streaming_equals_batch_and_replay_changes_nothing(spark):
    landing, root, progress = (scratch_path(spark, n) for n in ("l", "s", "p"))
    for load in (first_load(), second_load()):
        landed(spark, load).write.mode("append").parquet(landing)
        start_ingest(spark, landing, root, progress).awaitTermination()
    assert S.last_commit(spark, root).state == (3, 35)
    pages = {r.url: r for r in S.read_pages(spark, root).collect()}
    assert len(pages) == 235 and pages["https://example7.com"].embedded_scripts == ["log(7)"]
    commit = S.last_commit(spark, root)
    again = S.ingest(spark, root, landed(spark, second_load()), token=f"{progress}#1")
    assert again == commit
    start_ingest(spark, landing, root, progress).awaitTermination()
    assert S.last_commit(spark, root) == commit


def test_hot_key_and_hot_file(spark):
    """A third of the rows share a key, another third a file; results stay whole."""
    versions = spark.range(30_000).selectExpr(
        "id + 1 as seq", "if(id % 3 = 0, 'hot', string(id)) as url_key",
        "if(id % 3 = 0, 'hot', string(id)) as url", "string(id) as html",
    )
    folded = B.fold_updates(versions, ["seq"])
    assert folded.count() == 20_001
    assert folded.filter("url_key = 'hot'").first().html == "29997"
    rows = spark.range(200_000).selectExpr(
        "id", "if(id < 150000, 0, id) as file_idx", "if(id < 150000, id, 0) as record_no"
    )
    numbered = B.dense_index(rows, "file_idx", "record_no", "n")
    assert numbered.filter("n <> id").count() == 0 and numbered.count() == 200_000


def test_equal_arrival_places_are_ordered_by_key(spark):
    rows = [(key + str(place), 0, place) for place in range(3) for key in "zyx"]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame(rows, "url_key string, file_idx long, record_no long")
        placed = B.assign_batches(frame.repartition(3), batch_size=2, ties=("url_key",))
        got = sorted((r.record_no, r.url_key, r.batch_id) for r in placed.collect())
        assert [batch for *_, batch in got] == [1, 1, 2, 2, 3, 3, 4, 4, 5]
