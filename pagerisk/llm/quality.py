"""Quality classifier: weak labels by expectation-maximisation train a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagerisk.llm.common import utf8_rows
from pagerisk.llm.main_text import STOP_WORDS
from pagerisk.session import materialise

#: Documents that the scorer is trained on, at most.
SAMPLE_DOCUMENTS = 4096
BUCKETS = 1 << 12
EM_ROUNDS = 100
TRAINING_ROUNDS = 200
_CACHED_WORDS = 400_000
_SIGNS = re.compile(r"[#*$%&|<>]")
_RUNS = re.compile(r"(.)\1+")
_MARKS = ".,;:!?\"'()"

#: Measures by word, summed over a text.
_WORD_FACTS = ["signs", "sign_chars", "chars", "unclean", "upper", "letters", "shouted", "stop"]
#: The labellers: measure, good at most / at least, bad at least / at most, words needed.
LABELLERS = [
    ("sign_share", 0.10, 0.30, 5),
    ("sign_char_share", 0.02, 0.06, 5),
    ("unclean_share", 0.10, 0.30, 5),
    ("upper_share", 0.30, 0.60, 5),
    ("shouted_share", 0.10, 0.30, 5),
    ("echo_share", 0.05, 0.20, 8),
    ("repeat_share", 0.10, 0.30, 12),
    ("sameness", 0.60, 0.75, 50),
    ("line_copies", 0.05, 0.30, 12),
    ("function_lack", 0.95, 0.99, 20),
]


class _Kinds(dict):
    """Letters as x and X, digits as d, other signs as they are, by code point."""

    def __missing__(self, code):
        c = chr(code)
        self[code] = found = (
            "d" if c.isdigit() else c if not c.isalpha() else "X" if c.isupper() else "x"
        )
        return found


_KINDS = _Kinds()


class WordFacts(dict):
    """Number of each word, with its measures and hashed shape, up to a fixed number of words.

    But for being a stop word, what counts of a word of Latin letters follows from the kinds of
    its characters, which far fewer patterns hold than there are words.
    """

    def __init__(self):
        self.new: list[bytes] = []
        self.facts = np.zeros((0, len(_WORD_FACTS)))
        self.shape = np.zeros(0, np.int64)
        self._patterns: dict[str, int] = {}
        self._table = np.zeros((0, len(_WORD_FACTS) + 1))

    def __missing__(self, word):
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def learn(self) -> None:
        rows, found, stops = [], [], []
        known = len(self._table)
        for raw in self.new:
            word = raw.decode("utf-8", "replace")
            regular = word.isascii() or max(word) < "\u0100"
            pattern = word.translate(_KINDS) if regular else None
            number = self._patterns.get(pattern)
            if number is None:
                number = known + len(rows)
                rows.append(_facts_of(word))
                if regular:
                    self._patterns[pattern] = number
            found.append(number)
            stops.append(word.strip(_MARKS).lower() in STOP_WORDS)
        if found:
            if rows:
                self._table = np.concatenate((self._table, np.array(rows, float)))
            new = self._table[found]
            facts = new[:, :-1]
            facts[:, -1] = stops
            self.facts = np.concatenate((self.facts, facts))
            self.shape = np.concatenate((self.shape, new[:, -1].astype(np.int64)))
        self.new = []


def _facts_of(word: str) -> list:
    """The measures of a word, without telling stop words, and its hashed shape."""
    letters = sum(map(str.isalpha, word))
    upper = 0 if word.islower() else sum(map(str.isupper, word))
    plain = word.strip(_MARKS).lower()
    signs = len(_SIGNS.findall(word))
    unclean = not (plain.isalpha() or plain.isdigit())
    hashed = zlib.crc32(shape(word).encode()) % BUCKETS
    return [signs > 0, signs, len(word), unclean, upper, letters, "!!" in word, False, hashed]


def shape(word: str) -> str:
    """Letters as x and X, digits as d, other signs as they are, runs drawn together."""
    return _RUNS.sub(r"\1", word.translate(_KINDS))


def _share(part, whole):
    return part / np.maximum(whole, 1)


def read(texts: list[bytes], known: WordFacts) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all texts, and their words: shape number, text number, distinct per text."""
    numbers: list[int] = []
    ends, copies, lines = [], [], []
    for text in texts:
        numbers.extend(map(known.__getitem__, text.split()))
        ends.append(len(numbers))
        full = [line for line in text.split(b"\n") if line.strip()]
        lines.append(len(full))
        copies.append(len(full) - len(set(full)))
    known.learn()
    words = np.array(numbers, np.int64)
    count = np.diff(np.array(ends, np.int64), prepend=0)
    text = np.repeat(np.arange(len(texts)), count)

    def total(values):
        return np.bincount(text, values, len(texts))

    sums = {
        name: total(known.facts[words, place]) for place, name in enumerate(_WORD_FACTS)
    }
    same_text = text[1:] == text[:-1] if len(text) else np.zeros(0, bool)
    echo = np.bincount(text[1:][same_text & (words[1:] == words[:-1])], minlength=len(texts))
    size = len(known) + 1
    distinct = _distinct(text, words, size, len(texts))
    repeated = _repeated_triples(words, text, len(texts))
    measures = {
        "n_words": count,
        "sign_share": _share(sums["signs"], count),
        "sign_char_share": _share(sums["sign_chars"], sums["chars"]),
        "unclean_share": _share(sums["unclean"], count),
        "upper_share": _share(sums["upper"], sums["letters"]),
        "shouted_share": _share(sums["shouted"], count),
        "echo_share": _share(echo, count),
        "repeat_share": _share(repeated, np.maximum(count - 2, 0)),
        "sameness": 1 - _share(distinct, count),
        "line_copies": _share(np.array(copies, float), np.array(lines)),
        "function_lack": 1 - _share(sums["stop"], count),
    }
    return measures, known.shape[words], text, count


def _repeated_triples(words: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Per text, the runs of three words that an earlier place of the text holds already."""
    if len(words) < 3:
        return np.zeros(texts)
    size = int(words.max()) + 1
    if size < 1 << 21:
        runs = (words[:-2] * size + words[1:-1]) * size + words[2:]
    else:
        pairs = np.unique(words[:-1] * size + words[1:], return_inverse=True)[1]
        runs = pairs[:-1] * size + words[2:]
    inside = text[2:] == text[:-2]
    where, triples = text[2:][inside], np.unique(runs[inside], return_inverse=True)[1]
    count = int(triples.max()) + 1 if len(triples) else 1
    return np.bincount(where, minlength=texts) - _distinct(where, triples, count, texts)


def _distinct(text: np.ndarray, values: np.ndarray, size: int, texts: int) -> np.ndarray:
    """Per text, the number of its different values, which are below ``size``."""
    keys = np.sort(text * size + values)
    return np.bincount(keys[np.diff(keys, prepend=-1) > 0] // size, minlength=texts)


def votes(measures: dict[str, np.ndarray]) -> np.ndarray:
    """One column per labeller: 1 good, -1 bad, 0 nothing to say."""
    out = []
    for name, good, bad, least in LABELLERS:
        value = measures[name]
        said = np.where(value <= good, 1, np.where(value >= bad, -1, 0))
        out.append(np.where(measures["n_words"] >= least, said, 0))
    return np.stack(out, 1).astype(np.int8)


@dataclass
class VoteModel:
    """How often each labeller calls bad texts bad, and good ones, when it votes."""

    prior: float
    alarm: np.ndarray  # labeller, bad or good

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good; who abstains says nothing."""
        bad, good = self.alarm[:, 0], self.alarm[:, 1]
        logs = np.where(
            patterns < 0,
            np.log(good) - np.log(bad),
            np.where(patterns > 0, np.log1p(-good) - np.log1p(-bad), 0.0),
        )
        odds = logs.sum(1) + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray) -> VoteModel:
    """Fit prior and accuracies to vote patterns and their numbers.

    At first a text is good if no labeller calls it bad. The two accuracies of a labeller
    are free of each other, as one that knows a single defect misses most bad texts and
    yet is seldom wrong when it speaks. An alarm is kept at most as likely on good texts.
    """
    good = np.where((patterns < 0).any(1), 0.1, 0.9)
    for _ in range(EM_ROUNDS):
        weight = np.stack((counts * (1 - good), counts * good), 1)
        says_bad = (patterns < 0).T @ weight
        says_good = (patterns > 0).T @ weight
        alarm = (says_bad + [0.5, 0.05]) / (says_bad + says_good + 1)
        alarm[:, 1] = np.minimum(alarm[:, 1], alarm[:, 0])
        alarm = np.clip(alarm, 1e-4, 1 - 1e-4)
        prior = float(np.clip((weight[:, 1].sum() + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6))
        model = VoteModel(prior, alarm)
        new = model.posterior(patterns)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return model


def _features(measures, shapes, text, count) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hashed feature and value: shapes, pairs of shapes, and binned measures."""
    pairs = (shapes[:-1] * 31 + shapes[1:] * 17 + 7) % BUCKETS
    inside = text[1:] == text[:-1] if len(text) else np.zeros(0, bool)
    pair_text = text[1:][inside]
    keys = np.concatenate((text * BUCKETS + shapes, pair_text * BUCKETS + pairs[inside]))
    keys, times = np.unique(keys, return_counts=True)
    owner, bucket = keys // BUCKETS, keys % BUCKETS
    value = np.sqrt(times / np.maximum(count[owner], 1))
    owners, buckets, values = [owner], [bucket], [value]
    for name, *_ in LABELLERS:
        bins = np.minimum((measures[name] * 20).astype(int), 20)
        hashed = np.array([zlib.crc32(f"{name}={n}".encode()) % BUCKETS for n in range(21)])
        owners.append(np.arange(len(count)))
        buckets.append(hashed[bins])
        values.append(np.where(count > 0, 1.0, 0.0))
    return np.concatenate(owners), np.concatenate(buckets), np.concatenate(values)


def train_scorer(owner, bucket, value, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic scorer, by descent on the soft labels.

    Both sides weigh the same in total, however rare one of them is.
    """
    weights, offset = np.zeros(BUCKETS), 0.0
    sides = np.array([max((1 - target).sum(), 1e-9), max(target.sum(), 1e-9)])
    importance = target / sides[1] + (1 - target) / sides[0]
    importance /= importance.sum()
    squares, square = np.full(BUCKETS, 1e-9), 1e-9
    for _ in range(TRAINING_ROUNDS):
        score = np.bincount(owner, weights[bucket] * value, len(target)) + offset
        error = (target - 1 / (1 + np.exp(-np.clip(score, -30, 30)))) * importance
        gradient = np.bincount(bucket, error[owner] * value, BUCKETS) - 1e-5 * weights
        squares += gradient**2
        square += error.sum() ** 2
        weights += 0.3 * gradient / np.sqrt(squares)
        offset += 0.3 * error.sum() / np.sqrt(square)
    return weights, offset


def classify(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
) -> DataFrame:
    """Per row: doc_id, n_words, weak_label, score and kept.

    Ten overlapping labellers call a text good or bad, or abstain. Their votes over all
    documents, as numbers of each pattern of votes (at most 3^10), give their accuracies by
    expectation-maximisation, and these the weak_label, the probability that a text is good.
    At most SAMPLE_DOCUMENTS documents, those with the smallest hashes, train a linear
    scorer over hashed word shapes, pairs of them and binned measures; ``score`` is its
    probability for every document and kept means a score of ``threshold`` or more.

    A NULL text, or one without words, has score 0 and is not kept. Equal texts get equal
    scores; a NULL id is a value; other columns are ignored; an empty table gives an
    empty one.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_llm_text"))
    names = ", ".join(f"v{n} byte" for n in range(len(LABELLERS)))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, known in _texts(batches):
            measures, *_ = read(texts, known)
            found = votes(measures)[measures["n_words"] > 0]
            # Equal patterns of a batch are counted here already.
            patterns, counts = np.unique(found, axis=0, return_counts=True)
            columns = [pa.array(patterns[:, n]) for n in range(patterns.shape[1])]
            fields = [*[f"v{n}" for n in range(len(LABELLERS))], "n"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], fields)

    counted = source.select("_llm_text").mapInArrow(vote, f"{names}, n long")
    columns = [f"v{n}" for n in range(len(LABELLERS))]
    counted = counted.groupBy(*columns).agg(F.sum("n").alias("n")).orderBy(*columns)
    table = counted.toPandas()
    if not len(table):
        empty = F.lit(0.0)
        return source.select(
            "doc_id", F.lit(0).cast("long").alias("n_words"), empty.alias("weak_label"),
            empty.alias("score"), F.lit(False).alias("kept"),
        )
    model = expectation_maximisation(table[columns].to_numpy(), table["n"].to_numpy(float))

    mark = F.xxhash64(F.col("_llm_text"))
    chosen = source.filter(F.col("_llm_text").isNotNull()).select(mark.alias("mark"))
    last = chosen.distinct().orderBy("mark").limit(SAMPLE_DOCUMENTS).agg(F.max("mark")).collect()[0][0]
    sample = source.filter(mark <= F.lit(last)).dropDuplicates(["_llm_text"])
    schema = "mark long, weak double, bucket array<int>, value array<float>"

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in utf8_rows(batch.column(1))]
            measures, shapes, text, count = read(texts, WordFacts())
            owner, bucket, value = _features(measures, shapes, text, count)
            weak = model.posterior(votes(measures))
            order = np.argsort(owner, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
            offsets = pa.array(ends.astype(np.int32))
            buckets = pa.array(bucket[order].astype(np.int32))
            values = pa.array(value[order].astype(np.float32))
            made = [
                batch.column(0),
                pa.array(weak),
                pa.ListArray.from_arrays(offsets, buckets),
                pa.ListArray.from_arrays(offsets, values),
            ]
            yield pa.RecordBatch.from_arrays(made, ["mark", "weak", "bucket", "value"])

    rows = sample.select(mark.alias("mark"), "_llm_text").mapInArrow(sampled, schema)
    rows = materialise(rows, "quality-sample").orderBy("mark").toArrow()
    lengths = rows["bucket"].combine_chunks().value_lengths().to_numpy()
    weights, offset = train_scorer(
        np.repeat(np.arange(len(lengths)), lengths),
        rows["bucket"].combine_chunks().flatten().to_numpy(),
        rows["value"].combine_chunks().flatten().to_numpy().astype(float),
        rows["weak"].to_numpy(),
    )
    shared = spark.sparkContext.broadcast((model, weights, offset))
    out = source.select("doc_id").schema
    for name, kind in (("n_words", "long"), ("weak_label", "double"), ("score", "double")):
        out = out.add(name, kind)
    out = out.add("kept", "boolean")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, offset = shared.value
        known = WordFacts()
        for batch in batches:
            known = known if len(known) < _CACHED_WORDS else WordFacts()
            texts = [t or b"" for t in utf8_rows(batch.column(1))]
            measures, shapes, text, count = read(texts, known)
            owner, bucket, value = _features(measures, shapes, text, count)
            linear = np.bincount(owner, weights[bucket] * value, len(texts)) + offset
            found = 1 / (1 + np.exp(-np.clip(linear, -30, 30)))
            found = np.where(count > 0, found, 0.0)
            weak = np.where(count > 0, model.posterior(votes(measures)), 0.0)
            made = [
                batch.column(0), pa.array(count), pa.array(weak), pa.array(found),
                pa.array((found >= threshold) & (count > 0)),
            ]
            yield pa.RecordBatch.from_arrays(made, out.names)

    return source.mapInArrow(score, out)


def _texts(batches) -> Iterator[tuple[list[bytes], WordFacts]]:
    known = WordFacts()
    for batch in batches:
        known = known if len(known) < _CACHED_WORDS else WordFacts()
        yield [t or b"" for t in utf8_rows(batch.column(0))], known
