"""The registered corpus queries against their SQL twins, and the pipeline stage by stage."""

import itertools
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pagerisk import session
from pagerisk.llm import mixing, queries
from tests.llm import frames
from tests.llm.test_graphs import brute_groups
from tests.llm.test_texts import brute_lines, brute_measures, order
from tests.test_queries import SF_DIR, duck, sorted_rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    result = queries.QUERIES[name](spark, SF_DIR)
    rows = result.collect()
    table = {"op1": "embeddings", "op3": "pages"}.get(name.split("_")[0], "documents")
    if name != "op12_conversation_trie":  # its rows are nodes
        assert len(rows) == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    if name in queries.ORACLES:
        cursor = duck.execute(queries.ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(result.columns)
        assert sorted_rows(result.columns, rows) == sorted_rows(columns, cursor.fetchall())


def test_entry_point_has_the_corpus_queries():
    import __spark_entry__ as driver

    names = driver.queries()
    assert {f"op{n}" for n in range(1, 14)} == {
        name.split("_")[0] for name in names if name.startswith("op")
    }
    assert "pipeline" in names and set(driver.oracle_sql()) <= set(names)


def pipeline_rows():
    chance = random.Random(11)
    pool = [f"p{n}" for n in range(400)]

    def prose(count):
        return " ".join(chance.choice(pool) for _ in range(count))

    boiler = prose(14)
    rows = []
    for ident in range(60):
        text = "\n".join(prose(chance.randrange(4, 40)) for _ in range(chance.randrange(1, 6)))
        kind = ident % 6
        if kind == 0:
            text += "\n" + boiler
        elif kind == 1:
            text = " ".join([prose(6)] * 9)
        elif kind == 2 and rows:
            words = rows[-2][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif kind == 3 and rows:
            text = rows[chance.randrange(len(rows))][1]
        rows.append((ident, text, "en", chance.choice(["a", "b", None])))
    return [*rows, (97, None, "en", "a"), (98, "", None, "b"), (99, "too short", "en", "b")]


def test_pipeline_equals_brute_force(spark):
    rows = pipeline_rows()
    docs = spark.createDataFrame(rows, frames.DOCUMENTS)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality_rules", "line_dedup", "near_dedup", "mix_sources", "byte_bpe"
    ]

    def step(name, docs):
        out = stages[name](spark, docs, "")
        return spark.createDataFrame(out.collect(), out.schema)

    def content(frame):
        return sorted(((r.doc_id, r.text) for r in frame.collect()), key=order)

    judged = step("quality_rules", docs)
    good = []
    for row in rows:
        words, *_, windows, spans, longest = brute_measures(row[1] or "", 20)
        if words >= 10 and 5 * windows <= words and 10 * spans <= words and longest <= 50:
            good.append(row[:2])
    assert judged.schema == docs.schema and content(judged) == sorted(good, key=order)

    lined = step("line_dedup", judged)
    want = [r[:2] for r in brute_lines(good, 10) if not r[2] or r[3] < r[2]]
    assert lined.schema == docs.schema and content(lined) == sorted(want, key=order)
    assert len(want) < len(good)

    single = step("near_dedup", lined)
    kept = [row for row, group in zip(want, brute_groups(want, 5), strict=True) if group[3]]
    assert single.schema == docs.schema and content(single) == sorted(kept, key=order)

    mixed = step("mix_sources", single)
    times = {r.doc_id: r.times for r in mixing.mix_plan(single).collect()}
    wanted = [row for row in kept for _ in range(times[row[0]])]
    assert mixed.schema == docs.schema and content(mixed) == sorted(wanted, key=order)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = stages["byte_bpe"](spark, mixed, "").collect()
    assert sorted((r.doc_id, r.text) for r in encoded) == content(mixed)
    assert all(r.ids == library.encode(r.text).ids for r in encoded)


def test_pipeline_takes_awkward_and_empty_tables(spark):
    for docs in (frames.awkward(spark), frames.empty(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            docs = spark.createDataFrame(out.collect(), out.schema)
            if name != "byte_bpe":
                assert docs.columns == columns


def test_stages_write_few_files_whatever_the_shuffle(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame(pipeline_rows(), frames.DOCUMENTS).coalesce(4)
    settings = {
        "spark.sql.shuffle.partitions": "96",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    made = itertools.count()
    monkeypatch.setattr(session, "scratch_path", lambda _, label: f"{tmp_path}/{label}-{next(made)}")
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        for name in ("line_dedup", "near_dedup", "mix_sources"):
            out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
            assert out.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    tables = list(tmp_path.iterdir())
    files = [len(list(table.glob("part-*"))) for table in tables]
    assert len(tables) > 10 and max(files) <= 2 * spark.sparkContext.defaultParallelism
