"""Text encoders: plug-ins that turn a list of strings into a matrix of vectors.

An encoder has ``name``, ``dim`` and ``encode(list[str]) -> ndarray[n, dim]``. The default
needs no model files: signed counts of hashed character trigrams.
"""

from __future__ import annotations

from hashlib import md5
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

_CACHE_LIMIT = 1_000_000
_CHARS_AT_ONCE = 1_000_000
_CODE_MASK = (1 << 21) - 1


class Encoder(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class TrigramEncoder:
    """Counts of character trigrams of `` text `` in lower case, hashed to ``dim`` signed slots.

    A trigram's slot is the first 32 bits of its MD5 modulo ``dim``; it counts negative when
    the quotient is odd.
    """

    def __init__(self, name: str = "hashed-trigrams-64", dim: int = 64):
        self.name = name
        self.dim = dim
        self._slots: dict[int, tuple[int, int]] = {}

    def __getstate__(self):
        return {"name": self.name, "dim": self.dim, "_slots": {}}

    def _slot(self, key: int) -> tuple[int, int]:
        """Slot and sign of a trigram given as three 21-bit code points."""
        slot = self._slots.get(key)
        if slot is None:
            gram = "".join(chr(key >> shift & _CODE_MASK) for shift in (42, 21, 0))
            quotient, index = divmod(int(md5(gram.encode()).hexdigest()[:8], 16), self.dim)
            slot = (index, -1 if quotient % 2 else 1)
            if len(self._slots) >= _CACHE_LIMIT:
                self._slots.clear()
            self._slots[key] = slot
        return slot

    def encode(self, texts: list[str]) -> np.ndarray:
        vectors = np.zeros((len(texts), self.dim))
        start = size = 0
        for stop, text in enumerate(texts, 1):
            size += len(text)
            if size >= _CHARS_AT_ONCE or stop == len(texts):
                vectors[start:stop] = self._encode(texts[start:stop])
                start, size = stop, 0
        return vectors

    def _encode(self, texts: list[str]) -> np.ndarray:
        padded = [f" {text.lower()} " for text in texts]
        codes = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
        keys = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
        inside = owner[:-2] == owner[2:]
        grams, which = np.unique(keys[inside], return_inverse=True)
        slots = np.array([self._slot(g) for g in grams.tolist()], dtype=np.int64).reshape(-1, 2)
        cells = owner[:-2][inside] * self.dim + slots[which, 0]
        counted = np.bincount(cells, weights=slots[which, 1], minlength=len(texts) * self.dim)
        return counted.reshape(len(texts), self.dim)


def encode_distinct(encoder: Encoder, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the distinct texts and, per text, the row of its vector."""
    rows: dict[str, int] = {}
    positions = np.fromiter((rows.setdefault(t, len(rows)) for t in texts), int, len(texts))
    return encoder.encode(list(rows)), positions


def text_vector(text: Column, encoder: Encoder) -> Column:
    """One vector per text; equal texts of an Arrow batch are encoded once."""

    @F.arrow_udf("array<double>")
    def encode(batch: pa.Array) -> pa.Array:
        known = [t for t in batch.to_pylist() if t is not None]
        vectors, positions = encode_distinct(encoder, known)
        found = iter(positions)
        rows = [vectors[next(found)] if ok else None for ok in batch.is_valid().to_pylist()]
        return pa.array(rows, type=pa.list_(pa.float64()))

    return encode(text)


def total_text_vector(texts: Column, encoder: Encoder) -> Column:
    """Sum of the vectors of an array of texts; NULL for a NULL or empty array.

    It has the direction of the mean, but no rounding where an encoder counts, so that texts
    at right angles have the cosine 0 exactly.
    """

    @F.arrow_udf("array<double>")
    def encode(batch: pa.Array) -> pa.Array:
        lists = [[t for t in texts if t is not None] if texts else [] for texts in batch.to_pylist()]
        vectors, positions = encode_distinct(encoder, [t for texts in lists for t in texts])
        rows, start = [], 0
        for texts in lists:
            stop = start + len(texts)
            rows.append(vectors[positions[start:stop]].sum(axis=0) if texts else None)
            start = stop
        return pa.array(rows, type=pa.list_(pa.float64()))

    return encode(texts)
