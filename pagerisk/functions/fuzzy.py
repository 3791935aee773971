"""Fuzzy URL matching: the similarity ratio and a lossless search over a list of URLs."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

_CLASSES = 64


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[str, int] = {}
    for i, char in enumerate(a):
        masks[char] = masks.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for char in b:
        hit = free & masks.get(char, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def similarity_ratio(a: str, b: str) -> int:
    """0 to 100: twice the common subsequence over both lengths, rounded half to even."""
    if a == b:
        return 100
    if not a or not b:
        return 0
    return round(200 * lcs_length(a, b) / (len(a) + len(b)))


def reaches(a: str, b: str, min_ratio: int) -> bool:
    """Whether the rounded ratio is at least ``min_ratio``, in integers."""
    if a == b:
        return True
    if not a or not b:
        return min_ratio <= 0
    have, need = 400 * lcs_length(a, b), (2 * min_ratio - 1) * (len(a) + len(b))
    return have > need or (have == need and min_ratio % 2 == 0)


def max_indels(total_length, min_ratio: int):
    """Most insertions plus deletions between strings that reach the ratio."""
    return total_length * (201 - 2 * min_ratio) // 200


def _flat(texts: list[str]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The characters of strings one after the other, and the lengths, for some at a time."""
    lengths = np.array([len(t) for t in texts], np.int64)
    # A string counts as its length and a bit more, for the table that is made of it.
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths + 128) >> 20)) + 1
    ends = [*cuts.tolist(), len(texts)] if texts else []
    for low, high in zip([0, *ends], ends):
        codes = np.frombuffer("".join(texts[low:high]).encode("utf-32-le"), np.uint32)
        yield slice(low, high), codes, lengths[low:high]


# ---- many pairs at once --------------------------------------------------------------

#: Pairs with a longer string are compared one by one.
LONGEST = 512
_PAIRS = 4096
_MASKS = 1 << 22


def _coded(texts: list[str]) -> np.ndarray:
    """A row of characters, counted from 1, for each string; 0 after its end."""
    lengths = np.array([len(t) for t in texts])
    wide = max(1, int(lengths.max()))
    codes = np.array(texts, f"<U{wide}").view(np.uint32).reshape(-1, wide).astype(np.int64) + 1
    codes[np.arange(wide) >= lengths[:, None]] = 0
    return codes


def lcs_lengths(left: list[str], rows: np.ndarray, right: list[str], columns: np.ndarray) -> np.ndarray:
    """``lcs_length`` of each pair, given by the numbers of its strings."""
    sizes = [
        np.array([len(side[i]) for i in numbers.tolist()], np.int64)
        for side, numbers in ((left, rows), (right, columns))
    ]
    found = np.zeros(len(rows), np.int64)
    long = (sizes[0] > LONGEST) | (sizes[1] > LONGEST)
    for i in np.flatnonzero(long).tolist():
        found[i] = lcs_length(left[rows[i]], right[columns[i]])
    words = -(-sizes[0] // 64)
    rest = np.flatnonzero(~long)
    rest = rest[np.lexsort((sizes[1][rest], words[rest]))]
    bounds = np.searchsorted(words[rest], np.arange(LONGEST // 64 + 2))
    todo = [
        rest[low : min(low + _PAIRS, stop)]
        for start, stop in zip(bounds, bounds[1:])
        for low in range(start, stop, _PAIRS)
    ]
    while todo:
        some = todo.pop()
        firsts, first_of = np.unique(rows[some], return_inverse=True)
        seconds, second_of = np.unique(columns[some], return_inverse=True)
        a, b = (_coded([side[i] for i in n.tolist()]) for side, n in ((left, firsts), (right, seconds)))
        there = np.zeros(max(a.max(), b.max()) + 1, bool)
        there[a] = there[b] = there[0] = True
        number = np.cumsum(there) - 1
        if len(some) > 1 and len(firsts) * (number[-1] + 1) * max(1, a.shape[1] // 64) > _MASKS:
            todo += [some[: len(some) // 2], some[len(some) // 2 :]]
            continue
        found[some] = _lcs_of_codes(number[a], first_of, number[b], second_of, int(number[-1]) + 1)
    return found


def _lcs_of_codes(a: np.ndarray, first_of: np.ndarray, b: np.ndarray, second_of: np.ndarray, size: int):
    """The steps of ``lcs_length`` for pairs of rows of small numbers; 0 is no character."""
    words = -(-a.shape[1] // 64)
    masks = np.zeros((words, len(a), size), np.uint64)
    every = np.arange(len(a))
    for place in range(a.shape[1]):
        masks[place // 64, every, a[:, place]] |= np.uint64(1 << place % 64)
    masks[:, :, 0] = 0
    masks = masks.reshape(words, -1)
    own, steps = first_of * size, np.ascontiguousarray(b.T)
    free = [np.full(len(own), ~np.uint64(0)) for _ in range(words)]
    for step in steps:
        at = own + step[second_of]
        carry = None
        for word in range(words):
            old = free[word]
            hit = old & masks[word][at]
            added = old + hit
            if words > 1:
                over = added < hit
                if carry is not None:
                    added += carry
                    over |= added < carry
                carry = over.astype(np.uint64)
            free[word] = added | (old ^ hit)
    return 64 * words - sum(np.bitwise_count(word).astype(np.int64) for word in free)


def reach_each(
    left: list[str], rows: np.ndarray, right: list[str], columns: np.ndarray, min_ratio: int
) -> np.ndarray:
    """``reaches`` of each pair, given by the numbers of its strings."""
    both = [len(left[i]) + len(right[j]) for i, j in zip(rows.tolist(), columns.tolist())]
    both = np.array(both, np.int64)
    have, need = 400 * lcs_lengths(left, rows, right, columns), (2 * min_ratio - 1) * both
    return (have > need) | ((have == need) & (min_ratio % 2 == 0)) | (both == 0)


def reach_some(
    left: list[str], rows: np.ndarray, right: list[str], columns: np.ndarray, apart: np.ndarray,
    min_ratio: int, hit: np.ndarray, choose=lambda pairs: pairs, most: int | None = None,
) -> None:
    """Mark in ``hit`` the strings that reach one of their partners, the likeliest first.

    A string that has found one meets no more: it tries one, then three, then twelve. ``choose``
    leaves out pairs of a round by their place, ``most`` all but so many of a string.
    """
    order = np.lexsort((apart, rows))
    first = np.flatnonzero(np.diff(rows[order], prepend=-1))
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    low, high = 0, 1
    stop = int(rank.max(initial=-1)) + 1
    stop = stop if most is None else min(stop, most)
    while low < stop:
        open_ = (rank >= low) & (rank < min(high, stop)) & ~hit[rows[order]]
        tried = choose(order[open_])
        met = reach_each(left, rows[tried], right, columns[tried], min_ratio)
        hit[rows[tried][met]] = True
        low, high = high, 4 * high


class Sketches:
    """Character counts of strings as bits: one for each of the first eight of every class.

    Every insertion or deletion changes one count by one, so a pair has no more in common than
    its counts have.
    """

    LEVELS = 8

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], np.int32)
        self.bits = np.zeros((self.LEVELS * _CLASSES // 64, len(texts)), np.uint64)
        self.over = np.zeros(len(texts), np.int32)
        for some, codes, lengths in _flat(texts):
            classes = codes % 32 + 32 * (codes >= 64)
            cells = np.repeat(np.arange(len(lengths)) * _CLASSES, lengths) + classes
            counts = np.bincount(cells, minlength=len(lengths) * _CLASSES).reshape(-1, _CLASSES)
            levels = counts[:, :, None] > np.arange(self.LEVELS)
            packed = np.packbits(levels.reshape(len(lengths), -1), axis=1).view(np.uint64)
            self.bits[:, some] = packed.T
            self.over[some] = np.maximum(counts - self.LEVELS, 0).sum(1)

    def near(self, rows, other: Sketches, columns, min_ratio: int) -> tuple:
        """Places in ``rows`` and ``columns`` of the pairs that counts do not rule out, and how far apart."""
        keep, apart = self._apart(rows[:, None], other, columns, min_ratio)
        own, others = np.nonzero(keep)
        return own, others, apart(own, others)

    def near_each(self, rows, other: Sketches, columns, min_ratio: int) -> tuple:
        """Those of aligned rows and columns that counts do not rule out, and how far apart."""
        keep, apart = self._apart(rows, other, columns, min_ratio)
        (own,) = np.nonzero(keep)
        return own, apart(own, own)

    def _apart(self, rows, other: Sketches, columns, min_ratio: int) -> tuple:
        a, b = self.lengths[rows], other.lengths[columns]
        if max(a.max(initial=0), b.max(initial=0)) > 1 << 20:
            a, b = a.astype(np.int64), b.astype(np.int64)
        common = np.zeros(np.broadcast_shapes(a.shape, b.shape), a.dtype)
        for own, others in zip(self.bits, other.bits):
            common += np.bitwise_count(own[rows] & others[columns])
        over = self.over[rows], other.over[columns]
        if over[0].any() and over[1].any():
            common += np.minimum(*over)
        # Twice the common part is at least both lengths less ``max_indels``, times 200.
        least = 2 * min_ratio - 1

        def apart(i, j):
            dense = common.ndim == 2
            return a.ravel()[i] + b[j] - 2 * (common[i, j] if dense else common[i])

        return 400 * common - least * a >= least * b, apart


#: Neighbours in order that a string tries, on either side.
_AROUND = 16


def reach_around(
    asked: list[str], listed: list[str], order: np.ndarray, places: np.ndarray, min_ratio: int,
    sketches: Sketches,
) -> np.ndarray:
    """Whether each string reaches one of those next to its place in an order of listed ones.

    One that does not may still reach another. ``sketches`` are of the listed.
    """
    hit = np.zeros(len(asked), bool)
    own = Sketches(asked)
    step = np.arange(_AROUND)
    offsets = np.stack([step, -1 - step], 1).ravel()
    for low in range(0, len(asked), _PAIRS):
        columns = places[low : low + _PAIRS, None] + offsets
        rows, rank = np.nonzero((columns >= 0) & (columns < len(order)))
        columns, rows = order[columns[rows, rank]], rows + low
        keep, _ = own.near_each(rows, sketches, columns, min_ratio)
        reach_some(asked, rows[keep], listed, columns[keep], rank[keep], min_ratio, hit)
    return hit


def _same(text: str) -> str:
    return text


def _reverse(text: str) -> str:
    return text[::-1]


_KEYS = _same, _reverse


class UrlSearch:
    """Finds out whether any URL of a list is similar enough to a given one.

    Most that have a partner reach one next to them in the order of the URLs, or of their
    reverses. The others meet all URLs, and those pairs that lengths and character counts do
    not rule out are compared in full.
    """

    _ROWS, _COLUMNS = 16, 4096

    def __init__(self, urls: list[str], min_ratio: int):
        self.min_ratio = min_ratio
        self.urls = sorted(set(urls), key=lambda u: (len(u), u))
        self.exact = frozenset(self.urls)
        self.sketches = Sketches(self.urls)
        short = [i for i, u in enumerate(self.urls) if len(u) <= LONGEST]
        self.orders = [
            np.array(sorted(short, key=lambda i: key(self.urls[i])), np.int32) for key in _KEYS
        ]

    def matches(self, url: str) -> bool:
        return self.matches_each([url])[0]

    def matches_each(self, urls: list[str | None]) -> list[bool | None]:
        """Answers for a batch; equal URLs are searched once."""
        found = {u: u in self.exact for u in set(urls) if u is not None}
        for order, key in zip(self.orders, _KEYS):
            open_ = [u for u, hit in found.items() if not hit and len(u) <= LONGEST]
            at = [bisect.bisect_left(order, key(u), key=lambda i: key(self.urls[i])) for u in open_]
            at = np.array(at, np.int64)
            hits = reach_around(open_, self.urls, order, at, self.min_ratio, self.sketches)
            found.update(zip(open_, hits.tolist()))
        open_ = sorted((u for u, hit in found.items() if not hit), key=len)
        found.update(zip(open_, self._search(open_).tolist()))
        return [found.get(u) for u in urls]

    def _search(self, urls: list[str]) -> np.ndarray:
        """Whether each of some URLs, by length, reaches any of the list."""
        hit = np.zeros(len(urls), bool)
        asked, lengths = Sketches(urls), self.sketches.lengths.astype(np.int64)
        for low in range(0, len(urls), self._ROWS):
            rows = np.arange(low, min(low + self._ROWS, len(urls)))
            own = asked.lengths[rows].astype(np.int64)
            least, most = (np.abs(lengths - n) <= max_indels(lengths + n, self.min_ratio) for n in (own[0], own[-1]))
            band = np.flatnonzero(least | most | ((lengths > own[0]) & (lengths < own[-1])))
            for start in range(band[0], band[-1] + 1, self._COLUMNS) if len(band) else ():
                rows = rows[~hit[rows]]
                if not len(rows):
                    break
                columns = slice(start, min(start + self._COLUMNS, band[-1] + 1))
                mine, theirs, apart = asked.near(rows, self.sketches, columns, self.min_ratio)
                reach_some(urls, rows[mine], self.urls, theirs + start, apart, self.min_ratio, hit)
        return hit


# ---- an index of rare pieces ---------------------------------------------------------
# Cut any D + 1 pieces out of a string, none over another. An insertion or deletion spoils one
# piece at most, so a string within D of them holds some piece as it is, no more than D
# characters off its place. Pieces are three characters, and each string gives its rarest.

PIECE = 3
PIECE_BUCKETS = 1 << 18
#: Longer strings have too many pieces to send each of them out.
MOST_INDEXED = 256
#: Of more strings with a piece than this, so many are looked at first, and the likeliest tried.
_CROWD = 256
_LIKELIEST = 4
#: Pairs whose counts are looked at in one go.
NEAR_PAIRS = 1 << 15


def most_partner_indels(length, min_ratio: int):
    """Most insertions plus deletions between a string of a length and any partner."""
    change = 201 - 2 * min_ratio
    return max_indels(length * (200 + change) // (200 - change) + length, min_ratio)


def indexable(length, min_ratio: int):
    """Whether strings of a length have room for all the pieces they need."""
    room = PIECE * (most_partner_indels(length, min_ratio) + 1) <= length
    return room & (length <= MOST_INDEXED)


def piece_bucket(piece: str) -> int:
    return zlib.crc32(piece.encode()) % PIECE_BUCKETS


def rare_pieces(url: str, counts: np.ndarray, min_ratio: int) -> list[tuple[int, int]]:
    """(bucket, place) of the pieces of least total count that decide on all partners."""
    return rare_pieces_each([url], counts, min_ratio)[0]


def rare_pieces_each(
    urls: list[str], counts: np.ndarray, min_ratio: int
) -> list[list[tuple[int, int]]]:
    """``rare_pieces`` of each string, worked out for all of one length at once."""
    found: list = [None] * len(urls)
    lengths = np.array([len(u) for u in urls])
    for length in np.unique(lengths).tolist():
        numbers = np.flatnonzero(lengths == length)
        buckets = _piece_buckets([urls[i] for i in numbers.tolist()])
        places = _rarest(counts[buckets] + 1, most_partner_indels(length, min_ratio) + 1)
        chosen = np.take_along_axis(buckets, places, 1)
        for i, own, at in zip(numbers.tolist(), chosen.tolist(), places.tolist()):
            found[i] = list(zip(own, at))
    return found


_CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)


def _piece_buckets(urls: list[str]) -> np.ndarray:
    """``piece_bucket`` of all pieces of strings of one length."""
    size = len(urls[0]) - PIECE + 1
    codes = np.array(urls, f"<U{len(urls[0])}").view(np.uint32).reshape(len(urls), -1)
    crc = np.full((len(urls), size), 0xFFFFFFFF, np.uint32)
    for i in range(PIECE):
        crc = _CRC[(crc ^ codes[:, i : i + size]) & 0xFF] ^ (crc >> 8)
    buckets = (crc ^ 0xFFFFFFFF).astype(np.int64) % PIECE_BUCKETS
    for row in np.flatnonzero((codes >= 128).any(1)).tolist():
        buckets[row] = [piece_bucket(urls[row][i : i + PIECE]) for i in range(size)]
    return buckets


def _rarest(costs: np.ndarray, need: int) -> np.ndarray:
    """Places of ``need`` pieces of least total cost in each row, none over another."""
    rows, size = costs.shape
    # best[n] is the least cost of n pieces among the characters so far.
    start = np.full((rows, need + 1), np.inf)
    start[:, 0] = 0
    best = [start] * PIECE
    taken = np.zeros((size, rows, need + 1), bool)
    for place in range(size):
        more = np.full((rows, need + 1), np.inf)
        more[:, 1:] = best[-PIECE][:, :-1] + costs[:, place, None]
        taken[place] = more < best[-1]
        best = [*best[1:], np.minimum(more, best[-1])]
    found = np.zeros((rows, need), np.int64)
    every, left, free = np.arange(rows), np.full(rows, need), np.full(rows, size)
    for place in range(size - 1, -1, -1):
        here = np.flatnonzero((place < free) & (left > 0) & taken[place, every, left])
        left[here] -= 1
        found[here, left[here]] = place
        free[here] = place - PIECE + 1
    return found


def _piece_histograms(texts: list[str]) -> np.ndarray:
    """How often each string has the pieces of each class, up to 255 times."""
    counts = np.zeros((len(texts), 256), np.uint8)
    for some, codes, lengths in _flat(texts):
        size = max(0, len(codes) - PIECE + 1)
        mixed = sum(codes[i : i + size] * np.uint32(31**i) for i in range(PIECE)) % 256
        owner = np.repeat(np.arange(len(lengths)), lengths)
        inside = owner[:size] == owner[len(owner) - size :]
        cells = owner[:size][inside] * 256 + mixed[inside]
        found = np.bincount(cells, minlength=len(lengths) * 256).reshape(-1, 256)
        counts[some] = np.minimum(found, 255)
    return counts


class PieceMatcher:
    """Compares strings that share a piece; strings of one kind are told by their number."""

    def __init__(self, left: list[str], right: list[str], min_ratio: int):
        self.min_ratio = min_ratio
        self.sides = left, right
        self.sketches = [Sketches(side) for side in self.sides]
        self.lengths = [sketch.lengths.astype(np.int64) for sketch in self.sketches]
        self.pieces = [_piece_histograms(side) for side in self.sides]
        self.hit = np.zeros(len(left), bool)
        self.compared = np.zeros(len(left), np.int64)
        self._seen: set[int] = set()

    def meet(
        self,
        left: np.ndarray,
        left_at: np.ndarray,
        right: np.ndarray,
        right_at: np.ndarray,
        before: list[list[int]],
    ):
        """Compare all strings of one piece, given by number and place of the piece.

        ``before`` has the places of the pieces that each right string gave before this one; a
        pair that shares one of those meets there.
        """
        if len(right) > _CROWD:
            some = np.linspace(0, len(right) - 1, _CROWD).astype(int)
            self._look(left, left_at, right[some], right_at[some])
        for own, rows, columns, allowed, apart in self._near(left, left_at, right, right_at):
            self._compare(rows, columns, apart, lambda i: before[own[i]], allowed)

    def meet_each(self, left, left_at, right, right_at, before: Callable[[int], list[int]]):
        """``meet`` of aligned pairs of any pieces; ``before`` gives the places by number of the pair."""
        open_ = np.flatnonzero(~self.hit[left])
        near, _ = self.sketches[0].near_each(left[open_], self.sketches[1], right[open_], self.min_ratio)
        own = open_[near]
        kept = self._keep(own, left[own], right[own], left_at[own], right_at[own])
        own, rows, columns, allowed, apart = kept
        self._compare(rows, columns, apart, lambda i: before(int(own[i])), allowed)

    def _look(self, left, left_at, right, right_at):
        """Compare each string with the few likeliest of some, wherever those pairs would meet.

        Where many share a piece, most that have a partner are done after that.
        """
        for _, rows, columns, _, apart in self._near(left, left_at, right, right_at):
            self._compare(rows, columns, apart, most=_LIKELIEST)

    def _near(self, left, left_at, right, right_at):
        """Pairs that lengths, places and counts do not rule out, for strings without a match."""
        step = max(1, NEAR_PAIRS // max(1, len(right)))
        for low in range(0, len(left), step):
            open_ = low + np.flatnonzero(~self.hit[left[low : low + step]])
            if not len(open_):
                continue
            some, at = left[open_], left_at[open_]
            rows, own, _ = self.sketches[0].near(some, self.sketches[1], right, self.min_ratio)
            yield self._keep(own, some[rows], right[own], at[rows], right_at[own])

    def _keep(self, own, rows, columns, at, right_at) -> tuple:
        """The aligned pairs that places and counts of pieces do not rule out."""
        allowed = max_indels(self.lengths[0][rows] + self.lengths[1][columns], self.min_ratio)
        keep = np.abs(at - right_at) <= allowed
        own, rows, columns, allowed = own[keep], rows[keep], columns[keep], allowed[keep]
        # An insertion or deletion takes or brings all pieces that overlap it, and brings or
        # takes one less.
        apart = np.zeros(len(rows), np.int64)
        for start in range(0, len(rows), _PAIRS):
            part = slice(start, start + _PAIRS)
            a, b = self.pieces[0][rows[part]], self.pieces[1][columns[part]]
            apart[part] = (np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.int64)
        keep = apart <= (2 * PIECE - 1) * allowed
        return own[keep], rows[keep], columns[keep], allowed[keep], apart[keep]

    def _compare(self, rows, columns, apart, before=lambda pair: (), allowed=None, most=None) -> None:
        """Compare each string with its partners, the likeliest first, until one matches."""

        def unseen(pairs: np.ndarray) -> np.ndarray:
            chosen = []
            for pair in pairs.tolist():
                row, column = int(rows[pair]), int(columns[pair])
                number = row * len(self.sides[1]) + column
                if number in self._seen or self._met(row, column, before(pair), allowed, pair):
                    continue
                self._seen.add(number)
                chosen.append(pair)
            np.add.at(self.compared, rows[chosen], 1)
            return np.array(chosen, np.int64)

        left, right = self.sides
        reach_some(left, rows, right, columns, apart, self.min_ratio, self.hit, unseen, most)

    def _met(self, row: int, column: int, before: list[int], allowed, pair: int) -> bool:
        """Whether a pair shares a piece that the right string gave before."""
        if not before:
            return False
        a, b, most = self.sides[0][row], self.sides[1][column], int(allowed[pair])
        return any(b[at : at + PIECE] in a[max(0, at - most) : at + most + PIECE] for at in before)


def url_similarity(a: Column, b: Column) -> Column:
    """Similarity of two URL columns, 0 to 100."""

    @F.arrow_udf("int")
    def ratio(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist())
        return pa.array(
            [None if x is None or y is None else similarity_ratio(x, y) for x, y in pairs],
            type=pa.int32(),
        )

    return ratio(a, b)
