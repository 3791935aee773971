"""Importance resampling, the conversation trie and repeated windows against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagerisk.llm import resample, substrings, trie
from tests.llm import frames

# Importance resampling


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(run.encode()) % 10_000 for run in runs]


def brute_resample(rows, target):
    own, wanted = Counter(), Counter()
    for _, text in rows:
        own.update(brute_features(text)[1])
    for text in target:
        wanted.update(brute_features(text)[1])
    sums = own.total(), wanted.total()
    found = []
    for ident, text in rows:
        count, features = brute_features(text)
        weight = sum(
            math.floor(
                1000
                * math.log(
                    (wanted[b] + 1) * (sums[0] + 10_000.0) / ((own[b] + 1) * (sums[1] + 10_000.0))
                )
            )
            for b in features
        )
        mark = int(hashlib.sha256(f"42:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((mark + 0.5) / 4294967296)))
        found.append([ident, count, len(features), weight, weight + noise, None])
    fit = sorted(
        (r for r in found if r[1] >= 20),
        key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]),
    )
    for rank, row in enumerate(fit[: 5 * len(fit) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, found), key=repr)


def test_buckets_of_composed_payloads():
    long = "x" * 100
    texts = ["Hello World foo-bar é1x zz", "", "a", "a b", f"{long} y {long} {'ü' * 80} {long}", "!!",
             "\x01\x010 İ Σ 𝒳 A_B", "a " * 50]
    found, owner, counts = resample.buckets_of([t.encode() for t in texts], 10_000)
    for n, text in enumerate(texts):
        words, want = brute_features(text)
        assert counts[n] == words and sorted(found[owner == n].tolist()) == sorted(want), text


def test_resample_equals_brute_force(spark):
    chance = random.Random(5)
    pool = [f"w{n}" for n in range(60)]
    rows = [
        (n, " ".join(chance.choice(pool) for _ in range(chance.randrange(10, 80))))
        for n in range(300)
    ]
    rows += [(7, rows[7][1]), (7, rows[7][1])]
    rows += [(r[0], r[1]) for r in frames.rows()]
    frame = frames.awkward(spark).select("doc_id", "text", *frames.CLASH)
    plain = spark.createDataFrame(rows[:302], "doc_id long, text string")
    documents = plain.unionByName(frame, allowMissingColumns=True).repartition(5)
    target = [" ".join(chance.choice(pool[:9]) for _ in range(30)) for _ in range(6)] + [None, ""]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = resample.resample(documents, wanted)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_resample(rows, target)


def test_resample_of_empty_tables(spark):
    nothing = spark.createDataFrame([], "text string")
    assert resample.resample(frames.empty(spark), nothing).collect() == []
    few = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")
    assert [r["rank"] for r in resample.resample(few, nothing).collect()] == [None, None]


# Conversation trie


def brute_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    nodes = {}
    for c, ts in turns.items():
        shared = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        whole = tuple(turns.get(base, [])[:shared] + ts[shared:])
        for depth in range(len(whole) + 1):
            nodes.setdefault(whole[:depth], []).append((c, depth == len(whole)))
    kids = Counter(path[:-1] for path in nodes if path)
    leaves, saved = Counter(), Counter()
    for path, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for depth in range(len(path) + 1):
            leaves[path[:depth]] += not kids[path]
            saved[path[:depth]] += (len(members) - 1) * words
    found = []
    for path, members in nodes.items():
        ends = sorted(c for c, last in members if last)
        found.append((
            min(c for c, _ in members), len(path),
            min(c for c, _ in nodes[path[:-1]]) if path else None, len(members), kids[path],
            leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(found, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def talks(seed, texts, count, most):
    chance = random.Random(seed)
    rows = []
    for conv in range(-30, count):
        for turn in range(chance.randrange(0, most)):
            text = f"some words {chance.randrange(texts)}" if turn else "the same first turn"
            number = None if chance.random() < 0.05 else turn
            rows.append((conv, number, chance.choice(["user", "user", None]), text))
    return rows


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 200, "fan_in": 2}, {"block_bytes": 1}])
def test_trie_equals_brute_force(spark, settings):
    rows = talks(1, 2, 90, 6) + [(300, n, "user", f"deep {n}") for n in range(60)]
    rows += [(None, 0, "user", "nobody"), (500, 0, None, None), (501, 1, "a", ""), (501, 1, "b", "")]
    rows += [(c, 0, "user", "the same first turn") for c in range(600, 660)]
    frame = spark.createDataFrame(rows, TURNS).repartition(4)
    for name in ("key", "name", "depth", "kind", "words"):
        frame = frame.withColumn(name, frame["text"])
    found = trie.trie_nodes(trie.conversation_keys(frame), **settings)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_trie(rows)


def test_trie_of_few_rows(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    alone = [(3, 0, "user", "only its own first turn, which is replaced")]
    found = trie.prefix_trie(spark.createDataFrame(alone, TURNS)).collect()
    assert sorted(map(tuple, found), key=repr) == brute_trie(alone)


def test_radix_tree_grows_its_nodes():
    chance = random.Random(2)
    spread = (30, 256, 256)
    keys = [
        bytes([chance.randrange(n) for n in spread[: chance.randrange(4)]]) for _ in range(3000)
    ]
    keys += [bytes([200, n]) for n in range(12)]
    tree = trie.RadixTree()
    for number, key in enumerate(keys):
        tree.insert(key, number)
    path, found, kinds = bytearray(), {}, set()
    for branch, depth, after in tree.walk():
        if not after:
            del path[depth - len(branch.path) :]
            path += branch.path
            kinds.add(type(branch.layout).__name__)
            assert branch.ends or len(branch.layout.items()) > 1 or not depth
            if branch.ends:
                found[bytes(path)] = branch.ends
    assert list(found) == sorted(set(keys)) and len(kinds) == 4
    assert all(keys[n] == key for key, ends in found.items() for n in ends)


# Repeated windows


def brute_windows(rows, window):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    places = Counter(
        tuple(words[i : i + window]) for words in texts for i in range(len(words) - window + 1)
    )
    found = []
    for (ident, _), words in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if places[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [word for n, word in enumerate(words) if n not in gone]
        found.append((ident, " ".join(kept), len(words), len(gone)))
    return sorted(found, key=repr)


def passages(seed):
    chance = random.Random(seed)

    def prose(count, spread=1000):
        return [f"w{chance.randrange(spread)}" for _ in range(count)]

    shared = prose(40)
    rows = []
    for ident in range(60):
        words = prose(chance.randrange(0, 60))
        if ident % 3 == 0:
            at = chance.randrange(len(words) + 1)
            cut = shared[chance.randrange(9) : chance.randrange(30, 41)]
            words[at:at] = cut
        if ident % 7 == 0:
            words += prose(30, 2)
        rows.append((ident, chance.choice([" ", "\n", "\t "]).join(words)))
    rows += [(90, rows[0][1]), (91, rows[0][1]), (92, " ".join(shared * 3)), (93, "same " * 50)]
    return rows


@pytest.mark.parametrize("hot", [4096, 3, 0])
def test_repeats_equal_brute_force(spark, hot):
    rows = passages(3) + [r[:2] for r in frames.rows()]
    plain = spark.createDataFrame(rows[: -len(frames.rows())], "doc_id long, text string")
    frame = plain.unionByName(frames.awkward(spark), allowMissingColumns=True).repartition(4)
    for window, anchor in ((12, 4), (5, 5)):
        found = substrings.remove_repeats(
            frame, window=window, anchor=anchor, hot_passages=hot, keep=["doc_id"]
        )
        assert sorted(map(tuple, found.collect()), key=repr) == brute_windows(rows, window)


def test_repeats_keep_columns_and_take_empty_tables(spark):
    out = substrings.remove_repeats(frames.awkward(spark))
    assert out.columns[-3:] == ["text", "n_words", "n_removed"] and "kept" in out.columns
    assert substrings.remove_repeats(frames.empty(spark)).collect() == []
    named = spark.createDataFrame([("x", "a b"), (None, "a b")], "doc_id string, text string")
    rows = substrings.remove_repeats(named, window=2, anchor=1).collect()
    assert [(r["text"], r["n_removed"]) for r in rows] == [("", 2), ("", 2)]


def test_matching_statistics_equal_brute_force():
    chance = random.Random(4)
    for spread, most in itertools.product((1, 2, 5, 50), (3, 7)):
        text = [spread] + [chance.randrange(spread) for _ in range(200)]
        index = substrings.FmIndex(np.array(text, np.int64), spread + 1, most)
        streams = [[chance.randrange(-1, spread) for _ in range(n)] for n in (0, 1, 30, 9)]
        streams.append(text[50:90])
        ends = np.cumsum([len(s) for s in streams])
        flat = np.array([w for s in streams for w in s], np.int64)
        matched, times = index.statistics(flat, ends)
        held = Counter(
            tuple(text[i : i + n]) for n in range(1, most + 1) for i in range(len(text) - n + 1)
        )
        place = 0
        for stream in streams:
            for i in range(len(stream)):
                best = 0
                while best < most and held[tuple(stream[i : i + best + 1])] and i + best < len(stream):
                    best += 1
                assert matched[place] == best
                assert times[place] == (held[tuple(stream[i : i + best])] if best else 0)
                place += 1


def test_wavelet_tree_ranks():
    chance = np.random.default_rng(1)
    for alphabet in (1, 2, 3, 70):
        text = chance.integers(0, alphabet, 333)
        tree = substrings.WaveletTree(text, alphabet)
        for symbol in range(alphabet):
            at = np.arange(334)
            want = np.concatenate(([0], np.cumsum(text == symbol)))
            assert (tree.rank(np.full(334, symbol), at) == want).all()
