"""Near-duplicate documents: compressed MinHash registers, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from pagerisk.llm.blocks import own_blocks, rest_against_all
from pagerisk.llm.common import known_longs, row_key, utf8_rows
from pagerisk.llm.components import connected_components
from pagerisk.session import gathered, materialise

BANDS = 40
ROWS = 5
REGISTERS = BANDS * ROWS
#: Bits kept below the leading one of a register's hash.
MANTISSA = 10
_EMPTY = 0xFFFF
#: Shingles of the sets that one task compares, and sets that meet in one.
_SHINGLES_AT_ONCE = 1 << 22
_MEMBERS_AT_ONCE = 2048
_CACHED_WORDS = 250_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sets of word shingles, as sorted arrays of 64-bit hashes."""

    def __init__(self, width: int):
        self.width = width
        self._reset()

    def _reset(self):
        self._numbers: dict[bytes, int] = _Numbers()
        self._hashes = np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Distinct shingles of each text; shorter texts are one shingle, empty ones none."""
        import xxhash

        if len(self._numbers) > _CACHED_WORDS:
            self._reset()
        lookup = self._numbers.__getitem__
        words = [list(map(lookup, (t or b"").lower().split())) for t in texts]
        new, self._numbers.new = self._numbers.new, []
        fresh = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in new), np.uint64, len(new))
        self._hashes = np.concatenate((self._hashes, fresh))
        return [self._set(np.array(w, np.int64)) for w in words]

    def _set(self, words: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.uint64)
        width = min(self.width, len(words))
        hashes = self._hashes[words]
        count = len(words) - width + 1
        shingles = np.full(count, width, np.uint64)
        for n in range(width):
            shingles = _mix(shingles * _U(0x9E3779B97F4A7C15) + hashes[n : n + count])
        shingles.sort()
        return shingles[np.concatenate(([True], shingles[1:] != shingles[:-1]))]


class _Numbers(dict):
    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word):
        self[word] = number = len(self)
        self.new.append(word)
        return number


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of compressed registers per set.

    The upper half of a shingle's hash picks the bucket, the lower half is its value. A
    bucket keeps its smallest value as the number of leading zeros and the bits that follow
    the leading one. As the hashes are sorted, so are the buckets.
    """
    out = np.full((len(sets), REGISTERS), _EMPTY, np.uint16)
    lengths = np.array([len(s) for s in sets], np.int64)
    if not lengths.sum():
        return out
    hashes = np.concatenate(sets)
    bucket = ((hashes >> _U(32)) * _U(REGISTERS) >> _U(32)).astype(np.int64)
    place = np.repeat(np.arange(len(sets)) * REGISTERS, lengths) + bucket
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    least = np.minimum.reduceat(_mix(hashes) & _U(0xFFFFFFFF), starts)
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = 32 - exponent
    mantissa = np.floor((np.maximum(fraction, 0.5) * 2 - 1) * (1 << MANTISSA))
    out.reshape(-1)[place[starts]] = (zeros * (1 << MANTISSA) + mantissa).astype(np.uint16)
    return out


def band_keys(table: np.ndarray) -> np.ndarray:
    """One key per row and band. Empty buckets borrow from others in an order of their own."""
    full = table.copy()
    # Each bucket walks all buckets with a stride of its own; strides share no factor with 200.
    strides = np.array([s for s in range(1, REGISTERS) if np.gcd(s, REGISTERS) == 1])
    stride = strides[_mix(np.arange(REGISTERS, dtype=np.uint64)) % _U(len(strides))]
    row, column = np.nonzero((full == _EMPTY) & (table != _EMPTY).any(axis=1)[:, None])
    for turn in range(1, REGISTERS):
        if not len(row):
            break
        found = table[row, (column + turn * stride[column]) % REGISTERS]
        done = found != _EMPTY
        full[row[done], column[done]] = found[done]
        row, column = row[~done], column[~done]
    values = full.reshape(len(table), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2])
    for n in range(ROWS):
        keys = _mix(keys * _U(0x9E3779B97F4A7C15) + values[:, :, n])
    return keys.view(np.int64)


def estimate(
    left: np.ndarray, right: np.ndarray, left_size: np.ndarray, right_size: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Similarity estimated from registers, and the least estimate that may mean 0.8.

    Equal registers count, less those expected to collide by chance: with loads x and y per
    bucket the chance that the two smallest values fall into one cell of the compressed
    scale is summed over the leading zeros. The bar lies six standard deviations below.
    """
    filled = ((left != _EMPTY) | (right != _EMPTY)).sum(axis=-1)
    equal = ((left == right) & (left != _EMPTY)).sum(axis=-1)
    if np.ndim(left_size) == 0 and np.ndim(right_size) == 1:
        # Sizes come again and again.
        sizes, at = np.unique(right_size, return_inverse=True)
        chance = _chance(left_size / REGISTERS, sizes / REGISTERS)[at]
    else:
        chance = _chance(left_size / REGISTERS, right_size / REGISTERS)
    count = np.maximum(filled, 1)
    found = (equal - REGISTERS * chance * (1 - equal / count)) / count
    return found, 0.8 - 6 * np.sqrt(0.16 / count)


def _chance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The chance that two smallest values fall into one cell, at these loads."""
    both = np.maximum(x + y, 1e-300)
    chance = np.zeros(np.broadcast(x, y).shape)
    for zeros in range(1, 33):
        span = np.exp(-both * 2.0**-zeros) - np.exp(-both * 2.0 ** (1 - zeros))
        chance = chance + 2.0 ** -(zeros + MANTISSA) * x * y / both * span
    return chance


_SIGNATURE = (
    "_d long, _h long, doc_id long, n_shingles long, set_key binary, registers binary"
)


def signatures(documents: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: its key, id, set size, a 128-bit key of the set, and registers."""
    key = row_key(id_col, text_col)
    source = documents.select(
        key["d"].alias("_d"), key["h"].alias("_h"),
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(width)
        names = [part.split()[0] for part in _SIGNATURE.split(", ")]
        for batch in batches:
            sets = shingler.sets(utf8_rows(batch.column(3)))
            table = registers(sets)
            made = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([row.tobytes() for row in table], pa.binary()),
            ]
            kept = [batch.column(i) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names)

    return source.mapInArrow(run, _SIGNATURE)


def _matches(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint16).reshape(len(blobs), REGISTERS)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _bands(blobs: pa.Array) -> pa.Array:
    """Band keys of registers; they come cheaper than they are shuffled and stored."""
    keys = band_keys(_matches(blobs.to_pylist()))
    ends = np.arange(0, keys.size + 1, BANDS, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))


@F.pandas_udf(T.BooleanType())
def _may_link(
    left: pd.Series, right: pd.Series, left_size: pd.Series, right_size: pd.Series
) -> pd.Series:
    a, b = left_size.to_numpy(float), right_size.to_numpy(float)
    found, bar = estimate(_matches(left), _matches(right), a, b)
    near = 100 * np.minimum(a, b) >= 80 * np.maximum(a, b)
    return pd.Series(near & (found >= bar))


class Forest:
    """Labels of what is joined; the smaller part takes the label of the larger."""

    def __init__(self, labels: np.ndarray):
        _, self.label = np.unique(labels, return_inverse=True)
        order = np.argsort(self.label, kind="stable")
        cuts = np.flatnonzero(np.diff(self.label[order])) + 1
        self._parts = dict(enumerate(part.tolist() for part in np.split(order, cuts)))

    def whole(self) -> bool:
        return len(self._parts) < 2

    def join(self, one: int, other: int) -> bool:
        """Whether the two were apart; now they are together."""
        a, b = int(self.label[one]), int(self.label[other])
        if a == b:
            return False
        if len(self._parts[a]) < len(self._parts[b]):
            a, b = b, a
        part = self._parts.pop(b)
        self.label[part] = a
        self._parts[a] += part
        return True


def _promising(table: np.ndarray, size: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Those of ``others`` that size and registers let link with ``one``."""
    mine, theirs = size[one], size[others]
    others = others[100 * np.minimum(mine, theirs) >= 80 * np.maximum(mine, theirs)]
    if not len(others):
        return others
    found, bar = estimate(table[one], table[others], np.float64(mine), size[others].astype(float))
    return others[found >= bar]


def link_sets(
    sets: list[np.ndarray], labels: np.ndarray | None = None, asks: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """A forest of the sets: pairs that link, enough to join all that are linked.

    Sets of equal ``labels`` are joined already. With ``asks`` only those that ask are
    compared, with those that do not. A set's partners share a band with it, are not joined
    with it yet, and pass by size and registers; the full sets decide. Sets whose bands are
    the most frequent come first, so that a hub joins its copies in one step.
    """
    count = len(sets)
    if not count:
        return []
    table = registers(sets)
    keys = band_keys(table)
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(size)
    # Shingles by number, so that a mark per number tells those of one set.
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1).astype(np.int32)
    mark = np.zeros(int(flat.max()) + 1, bool)
    _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    popular = times[at.reshape(keys.shape)].sum(axis=1)
    forest = Forest(np.arange(count) if labels is None else labels)
    partner = np.ones(count, bool) if asks is None else ~asks
    pairs = []
    for one in np.argsort(-popular, kind="stable"):
        if forest.whole():
            break
        if asks is None:
            partner[one] = False
        elif not asks[one]:
            continue
        others = np.flatnonzero(partner & (forest.label != forest.label[one]))
        others = others[(keys[others] == keys[one]).any(axis=1)]
        others = _promising(table, size, one, others)
        if not len(others):
            continue
        lengths = size[others]
        stops = np.cumsum(lengths)
        place = np.repeat(ends[others] - stops, lengths) + np.arange(int(stops[-1]))
        own = flat[ends[one] - size[one] : ends[one]]
        mark[own] = True
        common = np.add.reduceat(mark[flat[place]].astype(np.int64), stops - lengths)
        mark[own] = False
        union = lengths + size[one] - common
        pairs += [
            (int(one), int(other))
            for other in others[100 * common >= 80 * union]
            if forest.join(one, other)
        ]
    return pairs


_EDGE = "a struct<d:long,h:long>, b struct<d:long,h:long>"


def _edges(pairs, d, h) -> pa.Table:
    kind = pa.struct([("d", pa.int64()), ("h", pa.int64())])
    node = lambda n: {"d": int(d[n]), "h": int(h[n])}
    return pa.table(
        {
            "a": pa.array([node(a) for a, _ in pairs], kind),
            "b": pa.array([node(b) for _, b in pairs], kind),
        }
    )


def _bucket_edges(group: pa.Table) -> pa.Table:
    """Pairs of a bucket that registers allow, enough to join all that such pairs join."""
    table = _matches(group["registers"].to_pylist())
    size = group["n_shingles"].to_numpy()
    asks = group["_asks"].to_numpy()
    forest = Forest(_labels(group))
    pairs = []
    for one in np.flatnonzero(asks):
        if forest.whole():
            break
        others = np.flatnonzero(~asks & (forest.label != forest.label[one]))
        others = _promising(table, size, one, others)
        pairs += [(one, int(other)) for other in others if forest.join(one, other)]
    return _edges(pairs, group["d"].to_numpy(), group["h"].to_numpy())


def _labels(group: pa.Table) -> np.ndarray:
    """One number per root, which is a pair of longs."""
    roots = np.column_stack([group["root_d"].to_numpy(), group["root_h"].to_numpy()])
    return np.unique(roots, axis=0, return_inverse=True)[1].reshape(-1)


def candidate_edges(sets: DataFrame) -> DataFrame:
    """Pairs of sets that may link, enough to join all that may; columns a and b.

    Members of a bucket are compared, by registers, with its smallest. Where all agree that
    settles the bucket. Where some do not, those are compared with all of the bucket.
    """
    node = F.struct("d", "h").alias("node")
    members = sets.select("d", "h", F.explode(_bands("registers")).alias("band"))
    # One shuffle; a task goes through a bucket row by row, however many rows it has.
    so_far = Window.partitionBy("band").orderBy("d", "h").rowsBetween(Window.unboundedPreceding, 0)
    members = members.select("band", node, F.first(node).over(so_far).alias("head"))
    spokes = materialise(gathered(members.filter("node != head")), "minhash-buckets")
    pairs = spokes.select("node", "head").distinct()
    met = spokes.select(F.explode(F.array("node.h", "head.h")).alias("h"))
    held = sets.filter(known_longs(met, "h")("h")).select(node, "n_shingles", "registers")
    held = materialise(held, "minhash-held")
    near = held.select(
        "node", F.col("n_shingles").alias("size"), F.col("registers").alias("own")
    )
    far = held.select(
        F.col("node").alias("head"), F.col("n_shingles").alias("head_size"),
        F.col("registers").alias("other"),
    )
    judged = materialise(
        gathered(
            pairs.join(near, "node")
            .join(far, "head")
            .select("node", "head", _may_link("own", "other", "size", "head_size").alias("near"))
        ),
        "minhash-pairs",
    )
    good = judged.filter("near").select(F.col("node").alias("a"), F.col("head").alias("b"))
    mixed = spokes.join(judged, ["node", "head"])
    odd = mixed.filter("NOT near").select("band").distinct()
    mixed = mixed.join(odd, "band", "left_semi").select("band", "node", "head", "near")
    mixed = materialise(gathered(mixed), "minhash-mixed")
    first = mixed.select("band", F.col("head").alias("node"), "head", F.lit(True).alias("near"))
    root = F.when(F.col("near"), F.col("head")).otherwise(F.col("node"))
    inside = (
        mixed.union(first.distinct())
        .withColumn("root", root)
        .join(held, "node")
        .select(
            "band", "node.d", "node.h", "n_shingles", "registers", (~F.col("near")).alias("rest"),
            F.col("root.d").alias("root_d"), F.col("root.h").alias("root_h"), F.lit(1).alias("one"),
        )
    )
    dealt = rest_against_all(
        inside, "band", "rest", "h", "one", _MEMBERS_AT_ONCE, _MEMBERS_AT_ONCE
    )
    found = dealt.groupBy("band", "_ask", "_told").applyInArrow(_bucket_edges, _EDGE)
    return good.union(found)


def _settled(
    documents: DataFrame, sets: DataFrame, clusters: DataFrame, id_col: str, text_col: str, width: int
) -> DataFrame:
    """Components of the links inside clusters, decided on full sets: node and component.

    A cluster is settled block by block, and its smallest member is in every block: that
    joins a large group of copies in work linear in its members. What a large cluster has
    apart from its largest part then is compared with all of the cluster.
    """
    limits = (_SHINGLES_AT_ONCE, _MEMBERS_AT_ONCE)
    named = sets.filter(known_longs(clusters, "node.h")("h"))
    members = clusters.join(named.select(F.struct("d", "h").alias("node"), "n_shingles", "set_key"), "node")
    members = own_blocks(members, "cluster", "node", "n_shingles", *limits)
    members = materialise(gathered(members), "minhash-clusters")
    texts = documents.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("text"))
    texts = texts.filter(known_longs(members, "node.d")("d"))

    def verify(group: pa.Table) -> pa.Table:
        import xxhash

        asks = group["_asks"].to_numpy() if "_asks" in group.column_names else None
        keys = group["set_key"].to_pylist()
        place, kept = {}, []
        for n, found in enumerate(Shingler(width).sets(utf8_rows(group["text"]))):
            # Texts of one id may differ; only the one of this set counts, and once.
            own = (keys[n], asks is not None and bool(asks[n]))
            if own not in place and xxhash.xxh3_128_digest(found.tobytes()) == keys[n]:
                place[own] = n
                kept.append(found)
        chosen = np.array(list(place.values()), np.int64)
        if asks is None:
            pairs = link_sets(kept)
        else:
            pairs = link_sets(kept, _labels(group)[chosen], asks[chosen])
        return _edges(pairs, group["d"].to_numpy()[chosen], group["h"].to_numpy()[chosen])

    everywhere = F.when(
        F.col("node") == F.col("cluster"), F.sequence(F.lit(0), F.col("_blocks") - 1)
    ).otherwise(F.array("_block"))
    placed = members.select(
        "cluster", "node.d", "node.h", "set_key", F.explode(everywhere).alias("_block")
    ).join(texts, "d")
    links = placed.groupBy("cluster", "_block").applyInArrow(verify, _EDGE)
    links = materialise(gathered(links), "minhash-links")
    heads = connected_components(links)
    parts = (
        members.filter("_blocks > 1")
        .drop("_blocks", "_block")
        .join(heads, "node", "left")
        .withColumn("root", F.coalesce("component", "node"))
    )
    sizes = parts.groupBy("cluster", "root").agg(F.count("*").alias("size"))
    largest = (
        sizes.groupBy("cluster")
        .agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.count("*").alias("parts"))
        .filter("parts > 1")
    )
    apart = parts.join(largest, "cluster").select(
        "cluster", "node.d", "node.h", "n_shingles", "set_key",
        (F.col("root") != F.col("largest")).alias("rest"),
        F.col("root.d").alias("root_d"), F.col("root.h").alias("root_h"),
    )
    apart = materialise(gathered(apart), "minhash-apart")
    if apart.isEmpty():
        return heads
    dealt = rest_against_all(apart, "cluster", "rest", "h", "n_shingles", *limits).join(texts, "d")
    more = dealt.groupBy("cluster", "_ask", "_told").applyInArrow(verify, _EDGE)
    return connected_components(links.union(more))


def duplicate_groups(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5
) -> DataFrame:
    """Groups of near-duplicate rows: _d, _h, doc_id, n_shingles, node, head.

    ``width`` words make a shingle; two rows link where their sets of shingles are similar
    by 0.8 and more. Equal sets are first folded into one node, named by its smallest id and
    a hash of the set. Buckets of equal bands give pairs of nodes, registers rule most of
    the wrong ones out, and what they join forms clusters. Each cluster is then settled
    on full sets taken from the texts, in one task or, if it is large, block by block: sets
    that share a band and pass by registers are compared in full. ``head`` is the smallest node of those that links join; it is NULL, like
    ``node``, for rows without words or without an id, which link with nothing.
    Banding misses a pair at similarity 0.8 with a chance of about 1e-7.
    """
    rows = materialise(signatures(documents, width, id_col, text_col), "minhash-rows")
    usable = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = (
        usable.groupBy("set_key")
        .agg(
            F.min("doc_id").alias("d"),
            F.min_by(F.struct("n_shingles", "registers"), "doc_id").alias("held"),
        )
        .select("set_key", "d", F.xxhash64("set_key").alias("h"), "held.*")
    )
    sets = materialise(gathered(sets), "minhash-sets")
    clusters = connected_components(candidate_edges(sets)).withColumnRenamed(
        "component", "cluster"
    )
    heads = _settled(documents, sets, clusters, id_col, text_col, width)
    named = sets.select("set_key", F.struct("d", "h").alias("node"))
    named = named.join(heads, "node", "left").select(
        "set_key", "node", F.coalesce("component", "node").alias("head")
    )
    named = named.withColumnRenamed("set_key", "_set")
    match = (F.col("set_key") == F.col("_set")) & F.col("doc_id").isNotNull()
    return rows.join(named, match & (F.col("n_shingles") > 0), "left").select(
        "_d", "_h", "doc_id", "n_shingles", "node", "head"
    )


def near_duplicates(documents: DataFrame, **settings) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept.

    component_id is the smallest id of the rows that links join with this one, kept tells
    whether it is the row's own id. Rows with NULL, empty or blank text link with nothing
    and are their own component; a row with a NULL id has none and is kept. Rows of one id
    with different texts are told apart; equal rows share a component. Other columns are
    ignored; an empty table gives an empty one. Settings as in ``duplicate_groups``.
    """
    groups = duplicate_groups(documents, **settings)
    component = F.coalesce("head.d", "doc_id")
    return groups.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5
) -> DataFrame:
    """The documents without later copies: one row of each group stays, all of the rest.

    Of a group the row with the smallest id stays, one of them if several are equal. Rows
    that link with nothing stay, as do those without words or id. Columns as they were.
    """
    groups = duplicate_groups(documents, id_col=id_col, text_col=text_col, width=width)
    alone = F.col("head").isNull()
    first = (F.col("node") == F.col("head")) & (F.col("doc_id") == F.col("head.d"))
    stay = (
        groups.filter(alone | first)
        .groupBy(F.col("_d").alias("_llm_d"), F.col("_h").alias("_llm_h"))
        .agg(F.min("head").alias("_llm_head"))
    )
    key = row_key(id_col, text_col)
    rows = documents.withColumn("_llm_d", key["d"]).withColumn("_llm_h", key["h"])
    rows = rows.join(stay, ["_llm_d", "_llm_h"])
    # Rows that differ in white space or case alone share their set: one of those stays too.
    group = F.coalesce("_llm_head", F.struct(F.col("_llm_d").alias("d"), F.col("_llm_h").alias("h")))
    same = Window.partitionBy(group).orderBy("_llm_d", "_llm_h")
    rows = rows.withColumn("_llm_n", F.row_number().over(same))
    return rows.filter(F.col("_llm_head").isNull() | (F.col("_llm_n") == 1)).select(
        *[F.col(f"`{name}`") for name in documents.columns]
    )
