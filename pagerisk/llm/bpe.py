"""Byte-level BPE with a pair occurrence index over all distinct words of a batch."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

# Words of the byte-level tokenizer. Fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stretches of text kept from batch to batch by a Python worker; then it starts anew.
_CACHED_STRETCHES = 300_000
#: Characters of the texts that are encoded together; a longer text is encoded alone.
_CHARS_AT_ONCE = 1 << 22
_SPACE_IN_RUN = re.compile(r"\s (?:\s|\Z)")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _unassigned():
    """Matches code points on whose class Unicode versions may differ."""
    import regex

    spans, start = [], None
    for code in range(sys.maxunicode + 2):
        new = code <= sys.maxunicode and unicodedata.category(chr(code)) == "Cn"
        if new and start is None:
            start = code
        elif not new and start is not None:
            spans.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return regex.compile(f"[{''.join(spans)}]")


class Vocabulary:
    """Ids, bytes and merge ranks of a byte-level BPE file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        ids = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        alphabet = byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = self.left * self.size + self.right
        self._rank = np.argsort(keys, kind="stable")
        self._keys = keys[self._rank]
        self.byte_ids = np.zeros(256, np.int64)
        for char, byte in alphabet.items():
            self.byte_ids[byte] = ids[char]
        spelled = [b""] * self.size
        for token, number in ids.items():
            spelled[number] = bytes(alphabet[c] for c in token)
        for token, number in self.special.items():
            spelled[number] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.token_length = np.array([len(s) for s in spelled], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where there is none."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._rank[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_bytes, self.token_start[ids], self.token_length[ids]).tobytes()


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``values[start:start + length]``, joined."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def merge_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, joined, and the number of each word.

    Every adjacent pair with a rank is entered under it with all its positions. The lowest
    active rank is applied to all its positions at once; pairs that come into being are
    entered under their own ranks. Words do not touch, so the lowest rank of all is also the
    lowest of every word that holds it, and entries that an earlier merge has overtaken
    are passed over.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    text = np.frombuffer(b"".join(words), np.uint8)
    size = len(text)
    symbol = vocabulary.byte_ids[text]
    after = np.arange(1, size + 1)
    before = np.arange(-1, size - 1)
    ends = np.cumsum(lengths)
    filled = lengths > 0
    after[ends[filled] - 1] = -1
    before[(ends - lengths)[filled]] = -1
    alive = np.ones(size, bool)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(start: np.ndarray) -> None:
        start = start[after[start] >= 0]
        rank = vocabulary.ranks(symbol[start], symbol[after[start]])
        known = rank >= 0
        start, rank = start[known], rank[known]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        start, rank = start[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(rank)]
        firsts = rank[bounds[:-1]].tolist()
        for number, low, high in zip(firsts, bounds, bounds[1:], strict=False):
            if number in index:
                index[number].append(start[low:high])
            else:
                index[number] = [start[low:high]]
                heapq.heappush(active, number)

    enter(np.arange(size))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        left, right = vocabulary.left[rank], vocabulary.right[rank]
        nxt = after[at]
        at = at[(nxt >= 0) & alive[at] & (symbol[at] == left) & (symbol[nxt] == right)]
        if left == right and len(at) > 1:
            # In a run of equal symbols every second position starts a merge.
            chained = after[at[:-1]] == at[1:]
            first = np.flatnonzero(np.concatenate(([True], ~chained)))
            place = np.arange(len(at)) - np.repeat(first, np.diff([*first, len(at)]))
            at = at[place % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        follow = after[gone]
        symbol[at] = vocabulary.merged[rank]
        alive[gone] = False
        after[at] = follow
        before[follow[follow >= 0]] = at[follow >= 0]
        back = before[at]
        enter(np.unique(np.concatenate((at, back[back >= 0]))))

    word = np.repeat(np.arange(len(words)), lengths)
    return symbol[alive].astype(np.uint32), np.bincount(word[alive], minlength=len(words))


class Encoder:
    """Encodes texts; keeps the tokens of stretches it has met, up to a fixed number.

    A text is cut before each single space that does not stand inside a run of white space.
    No word reaches over such a cut, so equal stretches have equal tokens.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        self._split = regex.compile(WORDS)
        self._odd = _unassigned()
        self._library = Tokenizer.from_file(path).pre_tokenizer
        names = sorted(map(regex.escape, self.vocabulary.special), key=len, reverse=True)
        self._special = regex.compile("|".join(names)) if names else None
        self._reset()

    def _reset(self) -> None:
        self._known = _Stretches()
        self._ids = np.zeros(0, np.uint32)
        self._length = np.zeros(0, np.int64)
        self._words = _Words()
        self._word_ids = np.zeros(0, np.uint32)
        self._word_length = np.zeros(0, np.int64)

    def _stretches(self, text: str) -> list[int]:
        if not text:
            return []
        if _SPACE_IN_RUN.search(text):
            return [self._known[(text,)]]
        first, *rest = text.split(" ")
        numbers = [self._known[(first,)]] if first else []
        numbers.extend(map(self._known.__getitem__, rest))
        return numbers

    def _cut(self, stretch: str) -> list[str]:
        if not stretch.isascii() and self._odd.search(stretch):
            # Unicode versions class this text differently; the tokenizer's own decides.
            return [stretch[a:b] for _, (a, b) in self._library.pre_tokenize_str(stretch)]
        return self._split.findall(stretch)

    def _learn(self) -> None:
        """Tokens of the stretches not met before."""
        cut = [self._cut(stretch) for stretch in self._known.new]
        self._known.new = []
        words = np.array([self._words[word] for words in cut for word in words], np.int64)
        count = np.array([len(words) for words in cut], np.int64)
        if self._words.new:
            ids, length = merge_words(self.vocabulary, self._words.new)
            self._words.new = []
            self._word_ids = np.concatenate((self._word_ids, ids))
            self._word_length = np.concatenate((self._word_length, length))
        length = self._word_length[words]
        starts = (np.cumsum(self._word_length) - self._word_length)[words]
        self._ids = np.concatenate((self._ids, gather(self._word_ids, starts, length)))
        reached = np.concatenate(([0], np.cumsum(length)))[np.cumsum(count)]
        self._length = np.concatenate((self._length, np.diff(reached, prepend=0)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and the end of each text in them."""
        if len(self._known) > _CACHED_STRETCHES:
            self._reset()
        special = self.vocabulary.special
        numbers: list[int] = []
        ends = []
        for text in texts:
            if self._special is not None and self._special.search(text):
                done = 0
                for match in self._special.finditer(text):
                    numbers += self._stretches(text[done : match.start()])
                    numbers.append(-1 - special[match.group()])
                    done = match.end()
                numbers += self._stretches(text[done:])
            else:
                numbers += self._stretches(text)
            ends.append(len(numbers))
        if self._known.new:
            self._learn()
        # Special tokens stand behind the stretches, one id each.
        names = np.arange(self.vocabulary.size if special else 0, dtype=np.uint32)
        used = np.array(numbers, np.int64)
        used = np.where(used >= 0, used, len(self._length) - 1 - used)
        values = np.concatenate((self._ids, names))
        length = np.concatenate((self._length, np.ones(len(names), np.int64)))
        starts = np.cumsum(length) - length
        out = gather(values, starts[used], length[used])
        reached = np.concatenate(([0], np.cumsum(length[used])))
        return out, reached[np.array(ends, np.int64)] if ends else np.zeros(0, np.int64)


class _Stretches(dict):
    """Number of each stretch; the key is the text after its space, or (text,) without one."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key):
        self[key] = number = len(self)
        self.new.append(" " + key if isinstance(key, str) else key[0])
        return number


class _Words(dict):
    """Number of each word; a word not met before is queued for merging."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word):
        self[word] = number = len(self)
        self.new.append(word.encode("utf-8", "surrogatepass"))
        return number


_ENCODERS: dict[str, Encoder] = {}
_FIELDS = {
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "n_tokens": (T.LongType(), pa.int64()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def encode_decode(
    documents: DataFrame,
    path: str,
    fields: tuple[str, ...] = ("ids", "n_tokens", "decoded"),
    *,
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Encode every whole text with the byte-level BPE file at ``path``, and decode it again.

    Returns the columns ``keep`` (all, if not given) and the chosen ones of: ids, n_tokens,
    ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded,
    decoded_sha256 (of its UTF-8). Strings of special tokens in a text become those tokens.

    A NULL or empty text has no ids and decodes to an empty text; rows that repeat are
    encoded each; an input column of the name of a new one is replaced; an empty table
    gives an empty one. A row depends on its text only, so a lost task is just run again.
    """
    names = [c for c in (documents.columns if keep is None else keep) if c not in fields]
    source = documents.select(
        *[documents[f"`{c}`"] for c in names], documents[f"`{text_col}`"].alias("_llm_text")
    )
    schema = T.StructType(
        [*source.schema.fields[:-1], *[T.StructField(f, _FIELDS[f][0]) for f in fields]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for low, high in _portions(texts):
                ids, ends = encoder.encode(texts[low:high])
                made = [_column(f, encoder.vocabulary, ids, ends) for f in fields]
                part = batch.slice(low, high - low)
                kept = [part.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *made], [f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with a bounded number of characters."""
    low = size = 0
    for n, text in enumerate(texts):
        if n > low and size + len(text) > _CHARS_AT_ONCE:
            yield low, n
            low = n
            size = 0
        size += len(text)
    if texts:
        yield low, len(texts)


def _column(field: str, vocabulary: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    bounds = [0, *ends.tolist()]
    spans = list(zip(bounds, bounds[1:], strict=False))
    if field == "ids":
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype("i4")))
    if field == "n_tokens":
        return pa.array([b - a for a, b in spans], pa.int64())
    if field == "ids_sha256":
        flat = ids.astype("<u4")
        digests = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in spans]
        return pa.array(digests, pa.string())
    texts = [vocabulary.decode(ids[a:b]).decode("utf-8", "replace") for a, b in spans]
    if field == "decoded":
        return pa.array(texts, pa.string())
    return pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
