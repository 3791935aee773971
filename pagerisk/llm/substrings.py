"""Removing word windows that occur more than once, with compressed FM-indexes.

Shards are cut by content, so that each text meets only what it may share. Every window has
an anchor, the run of a few words in it whose hash is least; equal windows have equal anchors
at equal places. The windows of one anchor form a passage, and the passages of an anchor that
occurs once leave at once. All others go to the shard of their anchor, which makes an FM-index
of their distinct texts: a wavelet tree over the Burrows-Wheeler transform and the common
prefixes of neighbouring suffixes. Passages are streamed through it backwards; their
matching statistics tell for each window how often the shard holds it.

The passages of a very frequent anchor do not fit into a shard. Their windows go by
fingerprints of their own, which are counted with partial sums, so that no task has them all.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagerisk.llm.common import utf8_rows
from pagerisk.session import materialise

WINDOW = 35
#: Words of an anchor.
ANCHOR = 8
#: An anchor with more passages than this has its windows counted by fingerprints.
HOT_PASSAGES = 4096
#: Passages are indexed together up to so many words; those of one anchor are never parted.
_SHARD_WORDS = 1 << 19

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


# The index


class Bits:
    """A bit vector with constant-time ranks: a count for every 64 bits."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate((packed, np.zeros(8 + -len(packed) % 8, np.uint8)))
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletTree:
    """Ranks of symbols in a sequence, level by level from the highest bit down."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.depth = max(1, (alphabet - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        rest = symbols
        for level in range(self.depth - 1, -1, -1):
            ones = ((rest >> level) & 1).astype(bool)
            self.levels.append((Bits(ones), int(len(rest) - ones.sum())))
            rest = np.concatenate((rest[~ones], rest[ones]))
        every = np.arange(alphabet, dtype=np.int64)
        self.start = self._place(every, np.zeros(alphabet, np.int64))

    def _place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - level)) & 1
            ones = bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._place(symbol, at) - self.start[symbol]


def _suffixes(text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a ring, sorted by more than ``most`` symbols, and the common prefix of each
    with the one before it, up to ``most``."""
    size = len(text)
    order = np.argsort(text, kind="stable")
    ranks, length = [], 1
    key = text[order]
    while True:
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank = np.empty(size, np.int64)
        rank[order] = np.cumsum(fresh)
        ranks.append(rank)
        if length > most or fresh.all():
            break
        pair = rank * (size + 1) + np.roll(rank, -length)
        order = np.argsort(pair, kind="stable")
        key = pair[order]
        length *= 2
    near = np.zeros(size - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        same = ranks[level][(order[:-1] + near) % size] == ranks[level][(order[1:] + near) % size]
        near += same.astype(np.int64) << level
    common = np.zeros(size + 1, np.int64)
    common[1:size] = np.minimum(near, most)
    return order, common.astype(np.uint8)


class FmIndex:
    """Backward search in a sequence of symbols, with matching statistics up to ``most``.

    The sequence begins with a symbol that no streamed text has, as it is closed to a ring.
    """

    def __init__(self, text: np.ndarray, alphabet: int, most: int):
        if most > 255:
            raise ValueError("matches are told up to 255 symbols")
        order, self.common = _suffixes(text, most)
        self.size, self.most, self.alphabet = len(text), most, alphabet
        self.tree = WaveletTree(text[order - 1], alphabet)
        counts = np.bincount(text, minlength=alphabet)
        self.first = np.cumsum(counts) - counts
        self._bounds: dict[int, tuple[Bits, np.ndarray]] = {}

    def _widen(self, low: np.ndarray, high: np.ndarray, depth: int):
        """The suffixes that share ``depth`` symbols with those in each interval."""
        if depth not in self._bounds:
            starts = self.common < depth
            starts[[0, -1]] = True
            self._bounds[depth] = (Bits(starts), np.flatnonzero(starts).astype(np.int32))
        bits, places = self._bounds[depth]
        return places[bits.rank(low + 1) - 1], places[bits.rank(high)]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The intervals of the matches with one more symbol before them."""
        both = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return self.first[symbol] + both[: len(low)], self.first[symbol] + both[len(low) :]

    def statistics(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the joined texts: length of the longest match that starts there
        within its text, up to ``most``, and how often the index holds that match.

        A symbol of -1 is not in the index. All texts advance together, from their ends.
        """
        lengths = np.diff(ends, prepend=0)
        by_size = np.argsort(-lengths, kind="stable")
        matched = np.zeros(len(words), np.int64)
        times = np.zeros(len(words), np.int64)
        low = np.zeros(len(ends), np.int64)
        high = np.full(len(ends), self.size, np.int64)
        depth = np.zeros(len(ends), np.int64)
        longest = int(lengths.max()) if len(ends) else 0
        active = len(ends)
        sorted_lengths = lengths[by_size]
        for back in range(1, longest + 1):
            active = int(np.searchsorted(-sorted_lengths[:active], -back, "right"))
            at = ends[by_size[:active]] - back
            symbol = words[at]
            todo = np.arange(active)
            unknown = symbol < 0
            if unknown.any():
                low[todo[unknown]], high[todo[unknown]], depth[todo[unknown]] = 0, self.size, 0
                todo = todo[~unknown]
            while len(todo):
                a, b = self.step(symbol[todo], low[todo], high[todo])
                found = a < b
                hit = todo[found]
                low[hit], high[hit] = a[found], b[found]
                depth[hit] += 1
                todo = todo[~found]
                lost = depth[todo] == 0
                todo = todo[~lost]
                if len(todo):
                    shorter = np.maximum(self.common[low[todo]], self.common[high[todo]])
                    for size in np.unique(shorter).tolist():
                        some = todo[shorter == size]
                        low[some], high[some] = self._widen(low[some], high[some], size)
                        depth[some] = size
            over = np.flatnonzero(depth[:active] > self.most)
            if len(over):
                low[over], high[over] = self._widen(low[over], high[over], self.most)
                depth[over] = self.most
            matched[at] = depth[:active]
            times[at] = np.where(depth[:active] > 0, high[:active] - low[:active], 0)
        return matched, times


# Anchors


def _finish(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return value ^ (value >> np.uint64(29))


def _rolled(words: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """A hash of every run of ``size`` words, from hashes of the words."""
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for place in range(size):
        total = total * factor + words[place : place + len(total)]
    return _finish(total)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, joined, and where each text ends."""
    import xxhash

    class Hashes(dict):
        def __missing__(self, word):
            self[word] = value = xxhash.xxh3_64_intdigest(word)
            return value

    hashes, parts, ends = Hashes(), [], []
    total = 0
    for text in texts:
        words = text.split()
        parts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        total += len(words)
        ends.append(total)
    joined = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return joined, np.array(ends, np.int64)


class Anchored:
    """The passages of all texts: the windows of one anchor after the other."""

    def __init__(self, texts: list[bytes], window: int, anchor: int):
        self.words, self.ends = _word_hashes(texts)
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        marks = _rolled(self.words, anchor, _MIX[0])
        total = max(0, len(self.words) - window + 1)
        # The place of the least mark among the runs of each window, the first of equals.
        least = np.arange(len(marks))
        size, wide = 1, window - anchor + 1
        while size < wide:
            shift = min(size, wide - size)
            left, right = least[: len(least) - shift], least[shift:]
            least = np.where(marks[left] <= marks[right], left, right)
            size += shift
        text = np.repeat(np.arange(len(texts)), self.ends - self.starts)[:total]
        inside = np.flatnonzero(np.arange(total) + window <= self.ends[text])
        place = least[:total][inside]
        new = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else place
        opens = np.flatnonzero(new)
        #: Per passage: its text, hash, first window, and the end of its last window.
        self.text = text[inside[opens]]
        self.hash = marks[place[opens]].view(np.int64)
        self.first = inside[opens]
        closes = np.concatenate((opens[1:], [len(place)])).astype(np.int64) - 1
        self.end = inside[closes] + window if len(place) else self.first
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))


def _anchor_lists(batches, window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Anchored([t or b"" for t in utf8_rows(batch.column(2))], window, anchor)
        lists = pa.ListArray.from_arrays(
            pa.array(found.bounds.astype(np.int32)), pa.array(found.hash)
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), lists], ["k1", "k2", "hashes"]
        )


_PASSAGE = "kind string, g long, f long, k1 long, k2 long, start int, size int, words binary"


def _passages(batches, window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Passages of repeated anchors, and the windows of very frequent ones."""
    for batch in batches:
        texts = [t or b"" for t in utf8_rows(batch.column(2))]
        found = Anchored(texts, window, anchor)
        prints = None
        rows: list[tuple] = []
        windows = [[], [], [], [], []]
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        marks = batch.column(3).to_pylist()
        for n, (k1, k2) in enumerate(keys):
            split = texts[n].split()
            base, low = int(found.starts[n]), int(found.bounds[n])
            for place, hot in {(m["place"], m["hot"]) for m in marks[n]}:
                first, end = int(found.first[low + place]), int(found.end[low + place])
                if not hot:
                    words = b" ".join(split[first - base : end - base])
                    hashed = int(found.hash[low + place])
                    rows.append(("passage", hashed, None, k1, k2, first - base, None, words))
                    continue
                if prints is None:
                    prints = [
                        _rolled(found.words, window, factor).view(np.int64) for factor in _MIX
                    ]
                count = end - window + 1 - first
                rows.append(("hot", None, None, k1, k2, first - base, count, None))
                at = slice(first, first + count)
                for column, values in zip(
                    windows,
                    (
                        prints[0][at], prints[1][at], np.full(count, k1), np.full(count, k2),
                        np.arange(first - base, first - base + count),
                    ),
                    strict=True,
                ):
                    column.append(values)
        names = [field.split()[0] for field in _PASSAGE.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary()]
        for low in range(0, len(rows), 65536):
            columns = zip(*rows[low : low + 65536], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names
            )
        if windows[0]:
            g, f, k1, k2, start = (np.concatenate(c) for c in windows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["window"] * len(g)), pa.array(g), pa.array(f), pa.array(k1),
                    pa.array(k2), pa.array(start.astype(np.int32)), pa.nulls(len(g), pa.int32()),
                    pa.nulls(len(g), pa.binary()),
                ],
                names,
            )


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of set flags begin and end."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def repeated_windows(passages: list[bytes], times: list[int], window: int) -> list[list[tuple]]:
    """Runs of window starts, per distinct passage, that the passages hold more than once.

    ``times`` tells how often each passage occurs.
    """
    numbers: dict[bytes, int] = {}
    joined: list[int] = []
    ends, sizes = [], []
    for passage in passages:
        words = passage.split()
        joined.append(0)  # parts the passages; no word has it
        joined += [numbers.setdefault(word, len(numbers) + 1) for word in words]
        sizes.append(len(words))
        ends.append(len(joined))
    text = np.array(joined, np.int64)
    index = FmIndex(text, len(numbers) + 1, window)
    stream = text[text > 0]
    stops = np.cumsum(np.array(sizes, np.int64))
    matched, found = index.statistics(stream, stops)
    out = []
    start = 0
    for stop, count in zip(stops.tolist(), times, strict=True):
        full = matched[start:stop] >= window
        out.append(_runs(full & ((found[start:stop] > 1) | (count > 1))))
        start = stop
    return out


def _match(batches, window: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows; passages come sorted by anchor and text."""
    held: list[tuple] = []  # distinct passage, its owners
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        spans = [[], [], [], []]
        runs = repeated_windows([p for p, _ in held], [len(o) for _, o in held], window)
        for (_, owners), own in zip(held, runs, strict=True):
            for low, high in own:
                for k1, k2, start in owners:
                    spans[0].append(k1), spans[1].append(k2)
                    spans[2].append(start + low), spans[3].append(start + high + window - 1)
        held.clear()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(spans[0], pa.int64()), pa.array(spans[1], pa.int64()),
                pa.array(spans[2], pa.int32()), pa.array(spans[3], pa.int32()),
            ],
            ["k1", "k2", "low", "high"],
        )

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for _, group in groupby(rows(), key=lambda row: row[0]):
        for words, same in groupby(group, key=lambda row: row[4]):
            held.append((words, [(k1, k2, start) for _, k1, k2, start, _ in same]))
            size += words.count(b" ") + 1
        if size >= shard_words:
            yield from flush()
            size = 0
    if held:
        yield from flush()


def removed_words(facts, window: int) -> list[tuple[int, int]]:
    """Disjoint spans of words, ascending, from the facts on one document."""
    sides: tuple[set, set, set] = (set(), set(), set())
    for fact in facts:
        sides[fact["what"]].add((fact["low"], fact["high"]))
    spans = sides[0]
    alone = sorted(low for low, _ in sides[2])
    for low, high in sides[1]:
        inside = alone[bisect_left(alone, low) : bisect_left(alone, high)]
        for stop in [*inside, high]:
            if low < stop:
                spans.add((low, stop + window - 1))
            low = stop + 1
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(span) for span in out]


# Tables


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Two longs that tell rows of different id or text apart."""
    ident, text = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")
    marks = [ident.isNull(), text.isNull()]
    return [
        F.xxhash64(ident, text, *marks).alias("k1"),
        F.xxhash64(*marks, text, F.lit(1), ident).alias("k2"),
    ]


def repeated_facts(
    documents: DataFrame,
    *,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    hot_passages: int = HOT_PASSAGES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (k1, k2, low, high, what) on the repeated windows of each document.

    What is 0 for words of repeated windows, from low up to high; 1 for windows, by their
    first words, of which all are repeated but those that a row with what 2 names by low.
    """
    if not 1 <= anchor <= window:
        raise ValueError("an anchor must fit into a window")
    keyed = documents.select(*_keys(id_col, text_col), F.col(f"`{text_col}`").alias("text"))
    lists = materialise(
        keyed.mapInArrow(
            lambda batches: _anchor_lists(batches, window, anchor),
            "k1 long, k2 long, hashes array<long>",
        ),
        "substring-anchors",
    )
    places = lists.select("k1", "k2", F.posexplode("hashes").alias("place", "hash"))
    # Written first, so that the join below is one of two exchanges and may split a hot hash.
    counts = materialise(
        places.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"), "substring-counts"
    )
    hot = (F.col("n") > hot_passages).alias("hot")
    marks = (
        places.join(counts, "hash")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("place", hot)).alias("marks"))
    )
    found = materialise(
        keyed.join(marks, ["k1", "k2"]).mapInArrow(
            lambda batches: _passages(batches, window, anchor), _PASSAGE
        ),
        "substring-passages",
        "kind",
    )
    shards = (
        found.filter("kind = 'passage'")
        .select("g", "k1", "k2", "start", "words")
        .repartition("g")
        .sortWithinPartitions("g", "words")
    )
    spans = shards.mapInArrow(
        lambda batches: _match(batches, window, _SHARD_WORDS),
        "k1 long, k2 long, low int, high int",
    )
    hot = found.filter("kind = 'hot'").select(
        "k1", "k2", F.col("start").alias("low"), (F.col("start") + F.col("size")).alias("high")
    )
    # A window that is alone has one owner, so no join is needed to find it.
    alone = (
        found.filter("kind = 'window'")
        .groupBy("g", "f")
        .agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("k1", "k2", "start")])
        .filter("n = 1")
        .select("k1", "k2", F.col("start").alias("low"), F.col("start").alias("high"))
    )
    facts = [spans, hot, alone]
    facts = [rows.withColumn("what", F.lit(n)) for n, rows in enumerate(facts)]
    return facts[0].unionByName(facts[1]).unionByName(facts[2])


def remove_repeats(
    documents: DataFrame,
    *,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    hot_passages: int = HOT_PASSAGES,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Documents without the words of repeated windows: all columns, n_words and n_removed.

    A window is ``window`` consecutive words of one document; every word is removed that lies
    in a window whose words start anywhere else too, in the same document or in another one.
    All windows are judged on the input. The words that stay are joined by one space.

    Texts are whole. A NULL or empty text has no word and becomes an empty one; rows equal in
    id and text are documents of their own, and so copies of each other; ids may be NULL or
    of any type; input columns n_words and n_removed are replaced; an empty table gives an
    empty one. One text and its passages must fit in a task's memory.
    """
    spans = repeated_facts(
        documents, window=window, anchor=anchor, hot_passages=hot_passages, id_col=id_col,
        text_col=text_col,
    )
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high", "what")).alias("spans"))
    names = [c for c in documents.columns if c not in ("n_words", "n_removed")]
    others = [c for c in (names if keep is None else keep) if c != text_col]
    k1, k2 = _keys(id_col, text_col)
    rows = documents.select(
        k1.alias("_llm_k1"), k2.alias("_llm_k2"),
        *[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`").alias("_llm_text"),
    )
    spans = spans.toDF("_llm_k1", "_llm_k2", "_llm_spans")
    rows = rows.join(spans, ["_llm_k1", "_llm_k2"], "left").drop("_llm_k1", "_llm_k2")
    schema = rows.select(*[F.col(f"`{c}`") for c in others]).schema
    schema = schema.add(text_col, "string").add("n_words", "long").add("n_removed", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            size = batch.num_columns
            for text, own in zip(
                utf8_rows(batch.column(size - 2)), batch.column(size - 1).to_pylist(), strict=True
            ):
                words = (text or b"").split()
                counts.append(len(words))
                gone = 0
                for low, high in reversed(removed_words(own or [], window)):
                    gone += high - low
                    del words[low:high]
                removed.append(gone)
                texts.append(b" ".join(words))
            kept = [batch.column(i) for i in range(size - 2)]
            kind = pa.large_string() if pa.types.is_large_string(batch.column(size - 2).type) else pa.string()
            kept.append(pa.array(texts, pa.binary()).cast(kind))
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], schema.names
            )

    return rows.mapInArrow(run, schema)
