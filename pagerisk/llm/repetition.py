"""Quality rules over repeated passages of a text, found with a suffix array of its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagerisk.llm.common import utf8_rows

# Characters counted as symbols. Fixed value.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Texts are sorted together up to so many words; a longer text is sorted alone.
_WORDS_AT_ONCE = 1 << 20

_MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words",
    "longest_repeat",
]
SCHEMA = ", ".join([f"{m} long" for m in _MEASURES]) + ", base_failed boolean, kept boolean"


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run from it that its text holds twice.

    Exact for lengths of four and more; shorter ones may be given as 0. ``words`` are the
    numbered words of all texts, joined, ``ends`` where each text ends. The suffixes of
    every text are sorted by prefix doubling. Each round refines the groups that are still
    equal, and the ranks of a round tell equal runs of its length apart, from which the
    common prefix of neighbours in the suffix array is put together. The longest repeat
    from a word is the longer of its two common prefixes.
    """
    total = len(words)
    longest = np.zeros(total, np.int64)
    if not total:
        return longest
    lengths = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), lengths)
    end = ends[text]
    key = text * (int(words.max()) + 1) + words
    suffixes = np.argsort(key, kind="stable")
    rank = np.empty(total, np.int32)
    slots = np.arange(total)
    key = key[suffixes]
    ranks = []
    while True:
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        group = slots[fresh][np.cumsum(fresh) - 1]
        rank[suffixes[slots]] = group
        ranks.append(rank.copy())
        size = np.diff(np.append(np.flatnonzero(fresh), len(slots)))
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots):
            break
        active = suffixes[slots]
        step = active + (1 << (len(ranks) - 1))
        inside = step < end[active]
        second = np.where(inside, rank[np.where(inside, step, 0)].astype(np.int64) + 1, 0)
        key = rank[active].astype(np.int64) * (total + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        suffixes[slots] = active[order]
    if len(ranks) < 4:
        return longest
    # Neighbours that share four words at least.
    near = ranks[2][suffixes[1:]] == ranks[2][suffixes[:-1]]
    first, second = suffixes[:-1][near], suffixes[1:][near]
    common = np.zeros(len(first), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        a, b = first + common, second + common
        inside = (a < end[first]) & (b < end[second])
        same = inside & (
            ranks[level][np.where(inside, a, 0)] == ranks[level][np.where(inside, b, 0)]
        )
        common += same.astype(np.int64) << level
    np.maximum.at(longest, first, common)
    np.maximum.at(longest, second, common)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, total: int) -> np.ndarray:
    """Which words the spans cover."""
    change = np.bincount(starts, minlength=total + 1) - np.bincount(
        starts + lengths, minlength=total + 1
    )
    return np.cumsum(change)[:total] > 0


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[ends], prepend=0)


def measure(texts: list[bytes], min_repeat: int) -> dict[str, np.ndarray]:
    """The measures of each text, in numpy arrays."""
    numbers: dict[bytes, int] = {}
    words: list[int] = []
    ends, duplicates = [], []
    for text in texts:
        words += [numbers.setdefault(word, len(numbers)) for word in text.split()]
        ends.append(len(words))
        lines = [line for line in text.split(b"\n") if line.strip()]
        duplicates.append(len(lines) - len(set(lines)))
    ends = np.array(ends, np.int64)
    repeat = longest_repeats(np.array(words, np.int64), ends)

    def cover(shortest: int, span=None) -> np.ndarray:
        at = np.flatnonzero(repeat >= shortest)
        return covered(at, repeat[at] if span is None else np.full(len(at), span), len(words))

    raw = np.frombuffer(b"".join(texts), np.uint8)
    raw_ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    letters = np.ones(256, np.int8)
    letters[0x80:0xC0] = 0
    letters[[0x20, *range(0x09, 0x0E)]] = 0
    symbols = np.zeros(256, np.int8)
    symbols[list(SYMBOLS)] = 1
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0)), repeat)
    return {
        "n_words": np.diff(ends, prepend=0),
        "word_chars": _sums(letters[raw].astype(np.int64), raw_ends),
        "n_symbols": _sums(symbols[raw].astype(np.int64), raw_ends),
        "n_dup_lines": np.array(duplicates, np.int64),
        "n_repeat_words": _sums(cover(WINDOW, WINDOW).astype(np.int64), ends),
        "n_covered_words": _sums(cover(min_repeat).astype(np.int64), ends),
        "longest_repeat": np.where(longest >= min_repeat, longest, 0),
    }


def judge(
    documents: DataFrame,
    *,
    text_col: str = "text",
    min_repeat: int = 20,
    max_covered_percent: int = 10,
    max_repeat: int = 50,
    min_words: int = 10,
    max_window_percent: int = 20,
    keep: list[str] | None = None,
    drop_rejected: bool = False,
) -> DataFrame:
    """Measure every whole text and judge it: the columns ``keep`` and those of SCHEMA.

    A maximal repeated passage is a run of words that occurs twice in the text and cannot be
    extended. Those of ``min_repeat`` words and more are united; they may cover at most
    ``max_covered_percent`` of the words and be at most ``max_repeat`` words long.
    base_failed: fewer than ``min_words`` words, or over ``max_window_percent`` of the words
    in five-word windows found twice. kept: not base_failed and within the two limits.
    With ``drop_rejected`` only kept rows are returned, with their own columns alone.

    A NULL or empty text has no words and fails; rows are judged one by one, so repeated
    ones get equal results; an input column of the name of a new one is replaced; an empty
    table gives an empty one. A text must fit in a task's memory, several times over.
    """
    if min_repeat < 4:
        raise ValueError("repeats are exact from four words")
    new = [*_MEASURES, "base_failed", "kept"]
    names = documents.columns if keep is None else keep
    if not drop_rejected:
        names = [name for name in names if name not in new]
    source = documents.select(
        *[documents[f"`{c}`"] for c in names], documents[f"`{text_col}`"].alias("_llm_text")
    )
    inputs = source.drop("_llm_text")
    schema = inputs.schema
    if not drop_rejected:
        for field in documents.sparkSession.createDataFrame([], SCHEMA).schema.fields:
            schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in utf8_rows(batch.column(batch.num_columns - 1))]
            for low, high in _portions(texts):
                found = measure(texts[low:high], min_repeat)
                n = found["n_words"]
                failed = (n < min_words) | (
                    100 * found["n_repeat_words"] > max_window_percent * n
                )
                good = (
                    ~failed
                    & (100 * found["n_covered_words"] <= max_covered_percent * n)
                    & (found["longest_repeat"] <= max_repeat)
                )
                part = batch.slice(low, high - low)
                kept = [part.column(i) for i in range(batch.num_columns - 1)]
                if drop_rejected:
                    out = pa.RecordBatch.from_arrays(kept, schema.names)
                    yield out.filter(pa.array(good))
                else:
                    made = [pa.array(found[m]) for m in _MEASURES]
                    made += [pa.array(failed), pa.array(good)]
                    yield pa.RecordBatch.from_arrays([*kept, *made], schema.names)

    return source.mapInArrow(run, schema)


def _portions(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with a bounded number of bytes, which bounds their words."""
    low = size = 0
    for n, text in enumerate(texts):
        if n > low and size + len(text) > 8 * _WORDS_AT_ONCE:
            yield low, n
            low = n
            size = 0
        size += len(text)
    if texts:
        yield low, len(texts)
