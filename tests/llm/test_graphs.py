import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagerisk.llm import components, minhash, vectors
from pagerisk.llm.common import known_longs
from pagerisk.llm.components import connected_components
from tests.llm import frames


def union(count, links):
    root = list(range(count))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(n) for n in range(count)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    chance = random.Random(seed)
    links = [(chance.randrange(200), chance.randrange(200)) for _ in range(110)]
    links += [(n, n + 1) for n in range(200, 260)] + [(300, n) for n in range(301, 400)] + [(5, 5)]
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    want = union(400, links)
    assert len({row.node for row in found}) == len(found)
    assert {row.node: row.component for row in found} == {
        n: want[n] for n in {x for link in links if link[0] != link[1] for x in link}
    }


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stars_are_settled_when_written(spark, monkeypatch):
    written, real = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda *a: written.append(1) or real(*a))
    links = [(100, n) for n in range(101, 140)] + [(1, 7), (7, 1)]
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {row.node for row in found if row.component == 100} == set(range(100, 140))
    assert len(found) == 42 and len(written) == 1


def test_known_longs_pass_and_most_others_do_not(spark):
    values = [-(2**63), -1, 0, 2**63 - 1, *range(5, 5000, 7)]
    known = known_longs(spark.createDataFrame([(v,) for v in values], "v long"), "v")
    tried = spark.createDataFrame([(v,) for v in {*values, *range(20000)}], "v long")
    passed = {row.v for row in tried.filter(known("v")).collect()}
    assert passed >= set(values) and len(passed) < len(values) + 20
    nothing = known_longs(tried.filter("v > v"), "v")
    assert tried.filter(nothing("v")).count() == 0


def shingles(text, width):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[n : n + width]) for n in range(len(words) - width + 1))


def brute_groups(rows, width):
    sets = [shingles(text, width) for _, text in rows]
    links = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if sets[a] and rows[a][0] is not None and rows[b][0] is not None
        and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    root = union(len(rows), links)
    least = {}
    for n, (ident, _) in enumerate(rows):
        if ident is not None:
            least[root[n]] = min(least.get(root[n], ident), ident)
    return [
        (ident, len(sets[n]), least.get(root[n]), ident is None or ident == least[root[n]])
        for n, (ident, _) in enumerate(rows)
    ]


def corpus(seed):
    chance = random.Random(seed)
    pool = [f"w{n}" for n in range(300)]
    rows = []
    for group in range(25):
        base = [chance.choice(pool) for _ in range(chance.choice([1, 2, 3, 6, 12, 40, 150]))]
        for _ in range(chance.randrange(1, 12)):
            copy = list(base)
            for _ in range(int(len(copy) * chance.choice([0, 0, 0.02, 0.05, 0.08, 0.12]))):
                copy[chance.randrange(len(copy))] = chance.choice(pool)
            rows.append((chance.randrange(10_000), " ".join(copy)))
    chance.shuffle(rows)
    return list({ident: (ident, text) for ident, text in rows}.values())


@pytest.mark.parametrize("small_tasks", [False, True])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small_tasks):
    if small_tasks:
        monkeypatch.setattr(minhash, "_SHINGLES_AT_ONCE", 300)
        monkeypatch.setattr(minhash, "_MEMBERS_AT_ONCE", 3)
    rows = corpus(3)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(frame, width=2).collect()
    assert sorted(map(tuple, found)) == sorted(brute_groups(rows, 2))


def test_near_duplicates_on_awkward_rows(spark):
    found = minhash.near_duplicates(frames.awkward(spark), width=2).collect()
    want = brute_groups([(r[0], r[1]) for r in frames.rows()], 2)
    key = lambda row: tuple((v is None, v) for v in row)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert minhash.near_duplicates(frames.empty(spark)).collect() == []


def test_drop_near_duplicates(spark):
    frame = frames.awkward(spark)
    kept = minhash.drop_near_duplicates(frame, width=2)
    assert kept.columns == frame.columns
    ids = [(row.doc_id, row.text) for row in kept.collect()]
    assert sum(i == 1 for i, _ in ids) == 1 and not any(i == 2 for i, _ in ids)
    assert len(ids) == len(frames.rows()) - 2
    assert minhash.drop_near_duplicates(frames.empty(spark)).collect() == []


def test_estimate_is_close():
    chance = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.8, 0.95):
        both = chance.integers(0, 2**63, int(4000 * share)).astype(np.uint64)
        rest = [chance.integers(0, 2**63, 2000 - len(both) // 2).astype(np.uint64) for _ in "ab"]
        sets = [np.unique(np.concatenate((both, r))) for r in rest]
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        table = minhash.registers(sets)
        found, bar = minhash.estimate(
            table[0], table[1], np.float64(len(sets[0])), np.float64(len(sets[1]))
        )
        assert abs(found - true) < 0.16
        assert bar < 0.8


def brute_vectors(rows, threshold=0.98):
    def usable(row):
        ident, label, v = row
        return (
            ident is not None and label is not None and v
            and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
        )

    links = []
    for a, one in enumerate(rows):
        for b, two in enumerate(rows[:a]):
            if usable(one) and usable(two) and one[1] == two[1] and len(one[2]) == len(two[2]):
                x, y = np.array(one[2], float), np.array(two[2], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links.append((a, b))
    root = union(len(rows), links)
    least = {}
    for n, row in enumerate(rows):
        if row[0] is not None:
            least[root[n]] = min(least.get(root[n], row[0]), row[0])
    return [
        (row[0], sum(n in link for link in links), least.get(root[n]),
         row[0] is None or least[root[n]] == row[0])
        for n, row in enumerate(rows)
    ]


def vector_rows():
    chance = np.random.default_rng(2)
    rows, ident = [], 0
    for label in (0, 1, 1, 2):
        for _ in range(12):
            base = chance.normal(size=16)
            for _ in range(int(chance.integers(1, 8))):
                noisy = base + chance.normal(size=16) * chance.choice([0, 0.05, 0.15, 0.22])
                rows.append((int(ident * 7919 % 10_007), label, noisy.tolist()))
                ident += 1
    rows += [
        (20_001, None, [1.0] * 16), (20_002, 1, None), (20_003, 1, []), (20_004, 1, [0.0] * 16),
        (20_005, 1, [float("nan")] + [1.0] * 15), (20_006, 1, [None] + [1.0] * 15),
        (20_007, 1, [float("inf")] + [1.0] * 15), (None, 1, [1.0] * 16), (20_008, 1, [1.0] * 16),
        (20_009, 1, [1e300] * 16), (20_010, 1, [1.0, 2.0]), (20_011, 1, [2.0, 4.0]),
        (20_012, 1, [1e-300] * 16),
    ]
    return rows


@pytest.mark.parametrize("small_tasks", [False, True])
def test_near_vectors_equal_brute_force(spark, monkeypatch, small_tasks):
    if small_tasks:
        for name in ("_RESIDENTS", "_VISITORS"):
            monkeypatch.setattr(vectors, name, 5)
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    frame = frame.withColumn("kept", F.lit(1)).withColumn("list", F.lit("x"))
    found = [tuple(row) for row in vectors.near_vectors(frame).collect()]
    key = lambda row: tuple((v is None, v) for v in row)
    assert sorted(found, key=key) == sorted(brute_vectors(rows), key=key)


def test_near_vectors_without_rows(spark):
    schema = "vec_id long, label long, embedding array<float>"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).collect() == []
    only = vectors.near_vectors(spark.createDataFrame([(1, 1, None)], schema)).collect()
    assert [tuple(row) for row in only] == [(1, 0, 1, True)]


def near_copies(count, seed=5):
    chance = random.Random(seed)
    base = [f"b{n}" for n in range(60)]
    out = []
    for n in range(count):
        copy = list(base)
        copy[chance.randrange(len(base))] = f"own{n}"
        out.append(" ".join(copy))
    return out


def test_a_hub_settles_its_copies_in_few_comparisons(monkeypatch):
    compared = []
    real = minhash._promising

    def counted(table, size, one, others):
        compared.append(len(others))
        return real(table, size, one, others)

    monkeypatch.setattr(minhash, "_promising", counted)
    work = []
    for count in (400, 1600):
        compared.clear()
        sets = minhash.Shingler(2).sets([t.encode() for t in near_copies(count)])
        assert len(minhash.link_sets(sets)) == count - 1
        work.append(sum(compared) / count)
    assert work[1] < 2 * work[0] + 2


def test_those_that_ask_meet_those_apart_only():
    chance = random.Random(9)
    texts = [t for _, t in corpus(8)]
    sets = minhash.Shingler(2).sets([t.encode() for t in texts])
    labels = np.array([chance.randrange(4) for _ in texts])
    asks = np.array([chance.random() < 0.4 for _ in texts])
    words = [shingles(t, 2) for t in texts]
    joined = [(int(labels[n]), n + 10) for n in range(len(texts))]
    allowed = [
        (a + 10, b + 10) for a in range(len(texts)) for b in range(len(texts))
        if asks[a] and not asks[b] and 100 * len(words[a] & words[b]) >= 80 * len(words[a] | words[b])
    ]
    found = [(a + 10, b + 10) for a, b in minhash.link_sets(sets, labels, asks)]
    size = len(texts) + 10
    assert union(size, joined + found) == union(size, joined + allowed)
    assert all(asks[a - 10] and not asks[b - 10] for a, b in found)


def test_rest_meets_all_of_its_group(spark):
    from pagerisk.llm.blocks import rest_against_all

    rows = [("a", n, n % 7 == 0) for n in range(40)] + [("b", n, False) for n in range(5)]
    frame = spark.createDataFrame(rows, "g string, n long, rest boolean").selectExpr("*", "1L AS one")
    tasks = {}
    for row in rest_against_all(frame, "g", "rest", "n", "one", 4, 4).collect():
        tasks.setdefault((row.g, row._ask, row._told), ([], []))[row._asks].append(row.n)
    met = sorted((a, b) for told, asks in tasks.values() for a in asks for b in told)
    assert met == sorted((a, b) for a in range(0, 40, 7) for b in range(40))
    assert {g for g, _, _ in tasks} == {"a"}
