"""Language of texts by a linear-chain conditional random field over their words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagerisk.llm.common import Hashed, utf8_rows

UNDETERMINED = "und"
#: Labelled documents per language that the model is fitted on, at most, and the words of
#: each that are used, in segments from places spread over the whole text.
SAMPLE_DOCUMENTS = 600
SEGMENTS = 4
SEGMENT_WORDS = 30
#: Size of the feature table, words per training sequence, and rounds of training.
BUCKETS = 1 << 16
SEQUENCE = 40
ROUNDS = 40
LEXICON = 300
_CACHED_WORDS = 400_000
_STATES_AT_ONCE = 1 << 23
_WORDS_AT_ONCE = 1 << 15
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(word: str) -> str:
    """The letters of a word in lower case, without marks, digits and signs."""
    if word.isalpha() and word.islower():
        return word
    found = _NOT_LETTERS.sub("", word.lower())
    return found if found.isalpha() else "".join(filter(str.isalpha, found))


def features(word: str, hashed: Hashed) -> list[int]:
    """Hashed features of a word: itself, its affixes, and its n-grams with the ends marked."""
    marked = f"<{word}>"
    names = [f"p{word[:1]}", f"p{word[:2]}", f"p{word[:3]}"]
    names += [f"s{word[-1:]}", f"s{word[-2:]}", f"s{word[-3:]}"]
    names += map("".join, zip(marked, marked[1:], strict=False))
    names += map("".join, zip(marked, marked[1:], marked[2:], strict=False))
    out = list(map(hashed.__getitem__, names))
    out.append(zlib.crc32(f"w{word}".encode()) % BUCKETS)
    return out


def forward_backward(
    potentials: np.ndarray, transitions: np.ndarray, starts: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every label at every word, and the backward weights behind it.

    ``potentials`` has a row per word of all sequences, joined; ``transitions`` is the matrix
    of exponentiated transition weights. All sequences move on together, the longest first,
    and every step is scaled to sum to one.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    forward = np.empty_like(potentials)
    state = None
    for step in range(longest):
        at = starts[: active[step]] + step
        state = potentials[at] if state is None else (state[: len(at)] @ transitions) * potentials[at]
        state = state / state.sum(1, keepdims=True)
        forward[at] = state
    posterior, backward = forward, np.empty_like(potentials)
    state = np.zeros((0, potentials.shape[1]), potentials.dtype)
    for step in range(longest - 1, -1, -1):
        at = starts[: active[step]] + step
        if len(state):
            state = (state * potentials[at[: len(state)] + 1]) @ transitions.T
            state = state / state.sum(1, keepdims=True)
        ended = np.ones((len(at) - len(state), potentials.shape[1]), potentials.dtype)
        state = np.concatenate((state, ended))
        backward[at] = state
        both = forward[at] * state
        posterior[at] = both / both.sum(1, keepdims=True)
    return posterior, backward


@dataclass
class Model:
    """Weights of features and of transitions, and the words that mark each language."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int]

    def potentials(self, words: list[str], hashed: Hashed) -> np.ndarray:
        """Exponentiated weights of all labels at each word, the largest being one."""
        flat, starts = _flat_features(words, self.lexicon, hashed)
        found = np.add.reduceat(self.weights[flat], starts, axis=0)
        return np.exp(found - found.max(1, keepdims=True))


def _flat_features(
    words: list[str], lexicon: dict[str, int], hashed: Hashed
) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words, joined, and where each word's start."""
    flat: list[int] = []
    starts = []
    for word in words:
        starts.append(len(flat))
        flat += features(word, hashed)
        if word in lexicon:
            flat.append(BUCKETS + lexicon[word])
    return np.array(flat, np.int64), np.array(starts, np.int64)


def fit(samples: list[tuple[str, list[str]]]) -> Model:
    """Train on segments of words with the language of their document.

    Segments of several documents are chained to sequences, so that transitions see
    languages change. The likelihood of the labels of all words climbs by its gradient:
    observed less expected counts, the latter from forward-backward.
    """
    languages = sorted({language for language, _ in samples})
    count = len(languages)
    chance = np.random.default_rng(7)
    segments = [(languages.index(language), words) for language, words in samples if words]
    order = chance.permutation(len(segments))
    words: list[str] = []
    labels: list[int] = []
    for at in order:
        label, found = segments[at]
        take = int(chance.integers(6, SEGMENT_WORDS + 1))
        words += found[:take]
        labels += [label] * len(found[:take])
    vocabulary, numbers = np.unique(np.array(words, object), return_inverse=True)
    label = np.array(labels, np.int64)
    per_word = np.zeros((len(vocabulary), count))
    np.add.at(per_word, (numbers, label), 1)
    share = per_word / per_word.sum(1, keepdims=True)
    lexicon: dict[str, int] = {}
    for place in range(count):
        marked = np.where(share[:, place] >= 0.9, per_word[:, place], 0)
        for at in np.argsort(-marked, kind="stable")[:LEXICON]:
            if marked[at] >= 3:
                lexicon[vocabulary[at]] = place
    flat, starts = _flat_features(list(vocabulary), lexicon, Hashed(BUCKETS))
    owner = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(flat)))
    weights = np.zeros((BUCKETS + count, count))
    transitions = np.zeros((count, count))
    total = len(label)
    begin = np.arange(0, total, SEQUENCE)
    length = np.minimum(SEQUENCE, total - begin)
    inner = np.ones(total, bool)
    inner[begin] = False
    following = np.flatnonzero(inner)
    observed = np.zeros((count, count))
    np.add.at(observed, (label[following - 1], label[following]), 1)
    squares = np.full(weights.shape, 1e-6)
    square = np.full(transitions.shape, 1e-6)
    for _ in range(ROUNDS):
        emission = np.add.reduceat(weights[flat], starts, axis=0)
        potentials = np.exp(emission - emission.max(1, keepdims=True))[numbers]
        matrix = np.exp(transitions)
        posterior, backward = forward_backward(potentials, matrix, begin, length)
        error = -posterior
        error[np.arange(total), label] += 1
        by_word = np.stack(
            [np.bincount(numbers, error[:, n], len(vocabulary)) for n in range(count)], 1
        )
        gradient = np.stack(
            [np.bincount(flat, by_word[owner, n], len(weights)) for n in range(count)], 1
        )
        gradient -= 1e-3 * weights
        # The marginal of a pair: forward to the first word, over the matrix, on to the end.
        left = posterior[following - 1] / backward[following - 1]
        right = potentials[following] * backward[following]
        pair = left[:, :, None] * matrix * right[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        change = observed - pair.sum(0) - 1e-3 * transitions
        squares += gradient**2
        square += change**2
        weights += 0.5 * gradient / np.sqrt(squares)
        transitions += 0.5 * change / np.sqrt(square)
    return Model(languages, weights.astype(np.float32), transitions, lexicon)


def held_out(ident: Column, folds: int, fold: int) -> Column:
    """Whether the checksum of the id, as text, falls into the fold; false without an id."""
    return F.coalesce(F.crc32(ident.cast("string")) % folds == fold, F.lit(False))


def training_sample(
    documents: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, fold: int
) -> list[tuple[str, list[str]]]:
    """Segments of a bounded number of labelled documents of each language.

    The documents with the smallest hashes of a language are chosen: their number fixes a
    bar for the hash in a pass over ids alone, a second pass takes texts below the bar.
    """
    ident = F.col(id_col).cast("long")
    rows = documents.filter(
        F.col(lang_col).isNotNull() & ident.isNotNull() & ~held_out(ident, folds, fold)
    ).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(ident).alias("mark"),
             F.col(text_col).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    bars = (
        rows.select("lang", "mark")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= SAMPLE_DOCUMENTS)
        .groupBy("lang")
        .agg(F.max("mark").alias("bar"))
    )
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # One row per language; the model, which tasks get too, has thousands of numbers for each.
    chosen = (
        rows.join(F.broadcast(bars), "lang").filter("mark <= bar").select("lang", "mark", words.alias("words"))
    )
    spread = F.greatest(F.size("words") - SEGMENT_WORDS, F.lit(0)) / (SEGMENTS - 1)
    cuts = [
        F.slice("words", (F.floor(spread * n) + 1).cast("int"), F.lit(SEGMENT_WORDS))
        for n in range(SEGMENTS)
    ]
    taken = chosen.filter(F.size("words") > 0).select("lang", "mark", F.array_distinct(F.array(*cuts)))
    found = sorted(tuple(row) for row in taken.collect())
    out = []
    for language, _, parts in found:
        for part in parts:
            cleaned = [letters_of(word) for word in part]
            out.append((language, [word for word in cleaned if word]))
    return [(language, part) for language, part in out if part]


class Tagger:
    """Applies a model; keeps the emissions of words it has met, up to a fixed number."""

    def __init__(self, model: Model):
        self.model = model
        self.matrix = np.exp(model.transitions).astype(np.float32)
        self._reset()

    def _reset(self):
        self._numbers = _Numbers()
        self._known: dict[str, int] = {}
        self._hashed = Hashed(BUCKETS)
        self._row = np.zeros(0, np.int64)
        self._potentials = np.zeros((0, len(self.model.languages)), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        rows: list[int] = []
        new: list[str] = []
        known = self._known
        for raw in words:
            word = letters_of(raw.decode("utf-8", "replace"))
            if word and word not in known:
                known[word] = len(known)
                new.append(word)
            rows.append(known[word] if word else -1)
        self._row = np.concatenate((self._row, np.array(rows, np.int64)))
        made = [
            self.model.potentials(new[low : low + _WORDS_AT_ONCE], self._hashed).astype(np.float32)
            for low in range(0, len(new), _WORDS_AT_ONCE)
        ]
        self._potentials = np.concatenate((self._potentials, *made))

    def tag(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean posterior of each label over the words of each text; numbers of words."""
        if len(self._numbers) > _CACHED_WORDS:
            self._reset()
        numbers: list[int] = []
        ends = []
        for text in texts:
            numbers.extend(map(self._numbers.__getitem__, (text or b"").split()))
            ends.append(len(numbers))
        if self._numbers.new:
            new, self._numbers.new = self._numbers.new, []
            self._learn(new)
        rows = self._row[np.array(numbers, np.int64)]
        kept = rows >= 0
        reached = np.concatenate(([0], np.cumsum(kept)))
        stops = reached[np.array(ends, np.int64)] if ends else np.zeros(0, np.int64)
        lengths = np.diff(stops, prepend=0)
        starts = stops - lengths
        rows = rows[kept]
        shares = np.zeros((len(texts), len(self.model.languages)))
        full = np.flatnonzero(lengths)
        if len(full):
            posterior, _ = forward_backward(
                self._potentials[rows], self.matrix, starts[full], lengths[full]
            )
            sums = np.add.reduceat(posterior, starts[full], axis=0, dtype=np.float64)
            shares[full] = sums / lengths[full, None]
        return shares, lengths


class _Numbers(dict):
    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word):
        self[word] = number = len(self)
        self.new.append(word)
        return number


def identify(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    fold: int = 2,
) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    The model learns from documents with a language whose id falls outside the held-out
    fold, from at most SAMPLE_DOCUMENTS of each language. Every word of every whole text is
    then labelled by forward-backward; the language with the largest mean posterior is
    predicted and that mean is its score.

    A NULL text, and one without a letter, is ``und`` with score 0; if nothing can be learned
    all are. A NULL id is not held out and not learned from. Equal texts get equal
    predictions; other columns are ignored; an empty table gives an empty one.
    """
    samples = training_sample(documents, id_col, text_col, lang_col, folds, fold)
    model = fit(samples) if samples else None
    shared = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select(
        F.col(id_col).alias("doc_id"),
        held_out(F.col(id_col), folds, fold).alias("held_out"),
        F.col(text_col).alias("_llm_text"),
    )
    schema = source.schema
    schema = type(schema)(schema.fields[:-1]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tagger = Tagger(model) if model else None
        for whole in batches:
            for batch in _portions(whole, len(model.languages) if model else 1):
                names = [UNDETERMINED] * batch.num_rows
                scores = np.zeros(batch.num_rows)
                if tagger:
                    shares, lengths = tagger.tag(utf8_rows(batch.column(2)))
                    best = shares.argmax(1)
                    scores = np.clip(shares[np.arange(len(best)), best], 0, 1)
                    for n in np.flatnonzero(lengths):
                        names[n] = model.languages[best[n]]
                made = [batch.column(0), batch.column(1), pa.array(names, pa.string())]
                yield pa.RecordBatch.from_arrays([*made, pa.array(scores)], schema.names)

    return source.mapInArrow(run, schema)


def _portions(batch: pa.RecordBatch, labels: int) -> Iterator[pa.RecordBatch]:
    """Slices whose texts hold a bounded number of states; a longer text is one by itself."""
    low = size = 0
    for n, text in enumerate(batch.column(batch.num_columns - 1)):
        states = (len(text.as_py() or "") // 4 + 1) * labels
        if n > low and size + states > _STATES_AT_ONCE:
            yield batch.slice(low, n - low)
            low, size = n, 0
        size += states
    if batch.num_rows:
        yield batch.slice(low)
