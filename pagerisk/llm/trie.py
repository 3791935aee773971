"""Prefix trie of conversations from adaptive radix trees over fixed-width turn ids.

A turn's id is a digest of its role and text, a conversation's key the ids of its turns one
after the other. Keys are range-sorted together with the conversation's id, so neighbours
share prefixes, and a prefix or even a whole key that very many conversations hold goes over
several tasks. Each block of keys becomes an adaptive radix tree. A node that no key of
another block can pass through is closed and final; the others lie on the paths of the
block's first and last key, and only their sums leave the task. Blocks are neighbours in key
order, so groups of neighbouring blocks merge their open paths, which closes nodes in turn,
until one group is left: each merge sees a bounded number of paths.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pagerisk.llm.common import WORD
from pagerisk.session import materialise

WIDTH = 16
ROOT = bytes(WIDTH)
_NOTHING = hashlib.sha256(b"").hexdigest()
#: A block ends with the key that brings it to so many bytes.
_BLOCK_BYTES = 4 << 20
#: So many neighbouring groups of blocks merge at once.
_FAN_IN = 64

_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)


# Nodes of the tree


class _Small:
    """Up to ``room`` children as sorted key bytes beside the children."""

    room = 4
    __slots__ = ("keys", "children")

    def __init__(self, items=()):
        self.keys = bytearray(byte for byte, _ in items)
        self.children = [child for _, child in items]

    def get(self, byte: int):
        at = bisect_left(self.keys, byte)
        return self.children[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, child) -> bool:
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.children[at] = child
            return True
        if len(self.keys) == self.room:
            return False
        self.keys.insert(at, byte)
        self.children.insert(at, child)
        return True

    def items(self):
        return list(zip(self.keys, self.children, strict=True))


class _Four(_Small):
    __slots__ = ()


class _Sixteen(_Small):
    room = 16
    __slots__ = ()


class _FortyEight:
    """A slot number for each byte, and up to 48 slots."""

    room = 48
    __slots__ = ("slot", "children")

    def __init__(self, items):
        self.slot = bytearray(256)
        self.children = []
        for byte, child in items:
            self.put(byte, child)

    def get(self, byte: int):
        slot = self.slot[byte]
        return self.children[slot - 1] if slot else None

    def put(self, byte: int, child) -> bool:
        slot = self.slot[byte]
        if slot:
            self.children[slot - 1] = child
            return True
        if len(self.children) == self.room:
            return False
        self.children.append(child)
        self.slot[byte] = len(self.children)
        return True

    def items(self):
        return [(b, self.children[s - 1]) for b, s in enumerate(self.slot) if s]


class _Full:
    """A place for every byte."""

    room = 256
    __slots__ = ("children",)

    def __init__(self, items):
        self.children = [None] * 256
        for byte, child in items:
            self.children[byte] = child

    def get(self, byte: int):
        return self.children[byte]

    def put(self, byte: int, child) -> bool:
        self.children[byte] = child
        return True

    def items(self):
        return [(b, c) for b, c in enumerate(self.children) if c is not None]


_LARGER = {_Four: _Sixteen, _Sixteen: _FortyEight, _FortyEight: _Full}


class _Branch:
    """The bytes that lead here from the parent, the children, and the keys that end here."""

    __slots__ = ("path", "layout", "ends")

    def __init__(self, path: bytes):
        self.path = path
        self.layout = _Four()
        self.ends: list[int] = []

    def put(self, byte: int, child: _Branch) -> None:
        while not self.layout.put(byte, child):
            self.layout = _LARGER[type(self.layout)](self.layout.items())


class RadixTree:
    """An adaptive radix tree of byte keys; each key holds the numbers put under it."""

    def __init__(self):
        self.root = _Branch(b"")

    def insert(self, key: bytes, number: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.layout.get(key[at])
            if child is None:
                leaf = _Branch(key[at:])
                leaf.ends.append(number)
                node.put(key[at], leaf)
                return
            path = child.path
            if key.startswith(path, at):
                node, at = child, at + len(path)
                continue
            same = 1
            while at + same < len(key) and path[same] == key[at + same]:
                same += 1
            middle = _Branch(path[:same])
            child.path = path[same:]
            middle.put(child.path[0], child)
            node.put(key[at], middle)
            node, at = middle, at + same
        node.ends.append(number)

    def walk(self) -> Iterator[tuple[_Branch, int, bool]]:
        """Every branch before (False) and after (True) its children, with its depth in bytes."""
        stack = [(self.root, 0, False)]
        while stack:
            branch, depth, after = stack.pop()
            yield branch, depth, after
            if not after:
                stack.append((branch, depth, True))
                for _, child in reversed(branch.layout.items()):
                    stack.append((child, depth + len(child.path), False))


# Sums of trie nodes


class _Sums:
    """What is known of a trie node: own numbers, and those of its closed subtrees."""

    __slots__ = ("n", "low", "words", "children", "leaves", "saved", "ends")

    def __init__(self, words: int):
        self.n = 0
        self.low: int | None = None
        self.words = words
        self.children = self.leaves = self.saved = 0
        self.ends: list[int] = []

    def add(self, other: _Sums) -> None:
        """Members of a child are members here; whether it is a child here is not said."""
        self.n += other.n
        if self.low is None or (other.low is not None and other.low < self.low):
            self.low = other.low

    def close(self) -> None:
        """All members and children are in: count the node itself."""
        self.saved += (self.n - 1) * self.words
        if not self.children:
            self.leaves = 1

    def take(self, child: _Sums) -> None:
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved


def _chain(key: bytes) -> list[bytes]:
    """A name for every turn-aligned prefix of a key, the empty one first."""
    names = [ROOT]
    for at in range(0, len(key), WIDTH):
        names.append(hashlib.md5(names[-1] + key[at : at + WIDTH]).digest())
    return names


class _Block:
    """The trie nodes of the keys of one block, cut at the paths of its first and last key."""

    def __init__(self, keys: list[bytes], convs: list[int], words: list[list[int]]):
        tree = RadixTree()
        for number, key in enumerate(keys):
            tree.insert(key, number)
        first, last = keys[0], keys[-1]
        names = {0: _chain(first), 1: _chain(last)}
        self.closed: list[tuple] = []
        #: name: (sums, depth, name of the parent), for the nodes on the two paths.
        self.open: dict[bytes, tuple[_Sums, int, bytes | None]] = {}
        path = bytearray()
        # A node on the way: sums, depth, children that wait for its smallest member, its
        # name if it is open, and whether it lies on the path of the first and last key.
        stack: list[tuple[_Sums, int, list, bytes | None, bool, bool]] = []

        def enter(depth: int, sample: int) -> None:
            on_first = on_last = True
            if depth:
                low, high = (depth - 1) * WIDTH, depth * WIDTH
                turn = path[low:high]
                on_first = stack[-1][4] and turn == first[low:high]
                on_last = stack[-1][5] and turn == last[low:high]
            name = names[0 if on_first else 1][depth] if on_first or on_last else None
            sums = _Sums(words[sample][depth - 1] if depth else 0)
            stack.append((sums, depth, [], name, on_first, on_last))

        def leave() -> None:
            sums, depth, waiting, name, _, _ = stack.pop()
            parent = stack[-1] if stack else None
            if name is None:
                sums.close()
                self._settle(sums, waiting)
                parent[0].take(sums)
                row = [sums.low, depth, None, sums.n, sums.children, sums.leaves, sums.saved]
                hashed = _digest([convs[n] for n in sums.ends])
                if parent[3] is None:
                    parent[2].append((row, hashed))
                else:
                    self.closed.append((*row, hashed, parent[3]))
            else:
                above = parent[3] if parent else None
                self.open[name] = (sums, depth, above)
            if parent:
                parent[0].add(sums)

        samples = _samples(tree)
        for branch, depth, after in tree.walk():
            start = depth - len(branch.path)
            aligned = range(start // WIDTH + 1, depth // WIDTH + 1)
            if not after:
                del path[start:]
                path += branch.path
                if not depth:
                    enter(0, samples[id(branch)])
                for turns in aligned:
                    enter(turns, samples[id(branch)])
                if branch.ends:
                    sums = stack[-1][0]
                    sums.ends = branch.ends
                    sums.n += len(branch.ends)
                    low = min(convs[n] for n in branch.ends)
                    sums.low = low if sums.low is None else min(sums.low, low)
            else:
                for _ in aligned:
                    leave()
        leave()
        self.first, self.last = names[0], names[1]
        self.chunks = {
            name: [convs[n] for n in sums.ends]
            for name, (sums, _, _) in self.open.items()
            if sums.ends
        }

    def _settle(self, sums: _Sums, waiting: list) -> None:
        for row, hashed in waiting:
            row[2] = sums.low
            self.closed.append((*row, hashed, None))


def _samples(tree: RadixTree) -> dict[int, int]:
    """For each branch the number of some key below it."""
    found: dict[int, int] = {}
    for branch, _, after in tree.walk():
        if after:
            if branch.ends:
                found[id(branch)] = branch.ends[0]
            else:
                found[id(branch)] = found[id(branch.layout.items()[0][1])]
    return found


def _digest(convs: list[int]) -> str:
    if not convs:
        return _NOTHING
    return hashlib.sha256(",".join(map(str, sorted(convs))).encode()).hexdigest()


# Tables


def conversation_keys(
    conversations: DataFrame, *, stride: int = 20, most_shared: int = 3
) -> DataFrame:
    """Rows (conv_id, key, words), one per rebuilt conversation.

    Conversation c starts with the first h turns of conversation c - c % stride, h being the
    CRC-32 of its decimal id modulo ``most_shared`` + 1, and goes on with its own turns after
    its first h. Turns are ordered by number, NULL first, then by role and digest of the
    text; words holds the number of words of each turn.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    ident = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"), role.alias("role"), ident.alias("id"),
            F.regexp_count(text, F.lit(WORD)).alias("words"),
        ).alias("t"),
    )
    # An ascending sort puts NULL turns first.
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    own = materialise(
        own.select(
            "conv_id",
            F.transform("own", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words")))
            .alias("own"),
        ),
        "conversations",
    )
    heads = own.filter(F.col("conv_id") % stride == 0).select(
        F.col("conv_id").alias("base"), F.slice("own", 1, most_shared).alias("head")
    )
    shared = (F.crc32(F.col("conv_id").cast("string")) % (most_shared + 1)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % stride
    joined = own.withColumns({"base": base, "h": shared}).join(heads, "base", "left")
    nothing = F.slice("own", 1, 0)
    head = F.when(F.col("head").isNull(), nothing).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))
    rebuilt = joined.select("conv_id", F.concat(head, rest).alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    return rebuilt.select(
        "conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")
    )


_PATH = (
    "name binary, parent binary, depth long, words long, n long, low long, children long, "
    "leaves long, saved long, has_ends boolean"
)
_FOUND = (
    f"kind string, part long, block long, {_NODE}, name binary, "
    f"chunk string, paths array<struct<{_PATH.replace(' ', ':').replace(',:', ',')}>>, "
    "first binary, last binary"
)


def _blocks(
    batches: Iterator[pa.RecordBatch], block_bytes: int
) -> Iterator[pa.RecordBatch]:
    """Trees of the sorted keys of a partition: closed nodes, chunks of ends, open paths."""
    part = TaskContext.get().partitionId()
    keys: list[bytes] = []
    convs: list[int] = []
    words: list[list[int]] = []
    size = number = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size, number
        block = _Block(keys, convs, words)
        place = {"part": part, "block": number}
        rows = [_node_row(place, "node", node[:8], node[8]) for node in block.closed]
        for name, ends in block.chunks.items():
            rows.append(place | {"kind": "chunk", "name": name, "chunk": ",".join(map(str, ends))})
        rows.append(place | _open_row(block.open, block.first[-1], block.last[-1]))
        yield _arrow(rows)
        keys.clear(), convs.clear(), words.clear()
        size, number = 0, number + 1

    for batch in batches:
        columns = [column.to_pylist() for column in batch.columns]
        for conv, key, count in zip(*columns, strict=True):
            keys.append(key), convs.append(conv), words.append(count)
            size += len(key) + WIDTH
            if size >= block_bytes:
                yield from flush()
    if keys:
        yield from flush()


def _node_row(place: dict, kind: str, node: tuple, name: bytes | None) -> dict:
    fields = [field.split()[0] for field in _NODE.split(", ")]
    return place | {"kind": kind, "name": name} | dict(zip(fields, node, strict=True))


def _open_row(nodes: dict, first: bytes, last: bytes) -> dict:
    paths = [
        {
            "name": name, "parent": parent, "depth": depth, "words": sums.words, "n": sums.n,
            "low": sums.low, "children": sums.children, "leaves": sums.leaves,
            "saved": sums.saved, "has_ends": bool(sums.ends),
        }
        for name, (sums, depth, parent) in nodes.items()
    ]
    return {"kind": "open", "paths": paths, "first": first, "last": last}


_ARROW: list[pa.Schema] = []


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    if not _ARROW:
        kinds = {
            "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
        }
        inner = pa.struct([(f.split()[0], kinds[f.split()[1]]) for f in _PATH.split(", ")])
        flat = _FOUND.split(", paths ")[0] + ", first binary, last binary"
        fields = [(f.split()[0], kinds[f.split()[1]]) for f in flat.split(", ")]
        fields.insert(-2, ("paths", pa.list_(inner)))
        _ARROW.append(pa.schema(fields))
    return pa.RecordBatch.from_pylist(rows, _ARROW[0])


def _merge(table: pa.Table, last_round: bool) -> pa.Table:
    """Open paths of neighbouring groups of blocks: sums by node, and what that closes."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
    nodes: dict[bytes, tuple[_Sums, int, bytes | None]] = {}
    for row in rows:
        for path in row["paths"]:
            name = path["name"]
            if name not in nodes:
                nodes[name] = (_Sums(path["words"]), path["depth"], path["parent"])
            sums = nodes[name][0]
            sums.n += path["n"]
            sums.low = path["low"] if sums.low is None else min(sums.low, path["low"])
            sums.children += path["children"]
            sums.leaves += path["leaves"]
            sums.saved += path["saved"]
            if path["has_ends"]:
                sums.ends = [0]
    still: set[bytes] = set()
    if not last_round:
        for name in (rows[0]["first"], rows[-1]["last"]):
            while name is not None and name not in still:
                still.add(name)
                name = nodes[name][2]
    place = {"part": rows[0]["part"], "block": rows[0]["block"]}
    found = []
    for name, (sums, depth, parent) in sorted(nodes.items(), key=lambda x: -x[1][1]):
        if name in still:
            continue
        sums.close()
        above = nodes[parent] if parent is not None else None
        if above:
            above[0].take(sums)
        node = (
            sums.low, depth, None, sums.n, sums.children, sums.leaves, sums.saved,
            None if sums.ends else _NOTHING,
        )
        row = _node_row(place, "merged", node, parent)
        # Merged nodes are asked for their smallest member, and for their ends, by name.
        found.append(row | {"first": name})
    if still:
        kept = {name: nodes[name] for name in nodes if name in still}
        found.append(place | _open_row(kept, rows[0]["first"], rows[-1]["last"]))
    return pa.Table.from_batches([_arrow(found)])


def _merger(last_round: bool):
    def merge(table: pa.Table) -> pa.Table:
        return _merge(table, last_round)

    return merge


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash a name over its chunks, which come one after the other."""
    own, state = None, None
    for batch in batches:
        names, hashes = [], []
        for name, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != own:
                if own is not None:
                    names.append(own), hashes.append(state.hexdigest())
                own, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(chunk.encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array(hashes, pa.string())], ["name", "hashed"]
        )
    if own is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([own], pa.binary()), pa.array([state.hexdigest()])], ["name", "hashed"]
        )


def trie_nodes(
    keyed: DataFrame, *, block_bytes: int = _BLOCK_BYTES, fan_in: int = _FAN_IN
) -> DataFrame:
    """The nodes of the trie of rows (conv_id, key, words): see ``prefix_trie``."""
    keyed = materialise(keyed, "trie-keys")
    ordered = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    blocks = ordered.select("conv_id", "key", "words").mapInArrow(
        lambda batches: _blocks(batches, block_bytes), _FOUND
    )
    found = materialise(blocks, "trie-blocks", "kind")
    # Blocks are numbered one after the other; there is one row of each.
    open_rows = found.filter("kind = 'open'").withColumn(
        "place", F.row_number().over(Window.orderBy("part", "block")) - 1
    )
    open_rows = materialise(open_rows, "trie-open")
    count = open_rows.count()
    merged = []
    columns = found.columns
    while count:
        count = -(-count // fan_in)
        last_round = count == 1
        groups = open_rows.withColumn("place", F.floor(F.col("place") / fan_in))
        step = groups.groupBy("place").applyInArrow(_merger(last_round), _FOUND)
        step = materialise(step, "trie-merged", "kind").select(*columns)
        merged.append(step.filter("kind = 'merged'"))
        if last_round:
            break
        open_rows = step.filter("kind = 'open'").withColumn(
            "place", F.row_number().over(Window.orderBy("part", "block")) - 1
        )
    fields = [field.split()[0] for field in _NODE.split(", ")]
    closed = found.filter("kind = 'node'")
    if not merged:
        return closed.select(*fields)
    chunks = found.filter("kind = 'chunk'").select("name", "chunk", "part", "block")
    hashed = (
        chunks.repartition("name")
        .sortWithinPartitions("name", "part", "block")
        .select("name", "chunk")
        .mapInArrow(_hash_chunks, "name binary, hashed string")
        .withColumnRenamed("name", "first")
    )
    top = merged[0]
    for step in merged[1:]:
        top = top.unionByName(step)
    top = top.select(*fields, "name", "first").join(hashed, "first", "left")
    top = top.withColumn("ends_sha256", F.coalesce("ends_sha256", "hashed"))
    top = materialise(top.drop("hashed"), "trie-top")
    lows = top.select(F.col("first").alias("name"), F.col("conv_id").alias("low"))
    waiting = closed.filter("name IS NOT NULL").select(*fields, "name").unionByName(
        top.select(*fields, "name")
    )
    named = waiting.join(lows, "name", "left").withColumn("parent_conv_id", F.col("low"))
    return closed.filter("name IS NULL").select(*fields).unionByName(named.select(*fields))


def prefix_trie(
    conversations: DataFrame, *, stride: int = 20, most_shared: int = 3
) -> DataFrame:
    """Every node of the trie of rebuilt conversations (see ``conversation_keys``).

    A node is a distinct sequence of first turns, the empty one included. Its row has conv_id,
    the smallest member, depth, parent_conv_id, the parent's smallest member, n_convs,
    n_children, n_leaves, the childless nodes of its subtree, saved_tokens, the words that its
    subtree need not repeat when members share their turns, and ends_sha256, a hash of the
    ids of the members that end here, ascending, with commas between.

    A NULL role or text is an empty one; rows without conv_id belong to no conversation and
    are left out; a repeated turn number counts each time; other columns are ignored; an
    empty table has no conversation, so no node. A conversation must fit in memory; ids must
    be whole numbers. The ids of one node's ends pass through one task, in chunks, as the
    hash asks for their order.
    """
    keys = conversation_keys(conversations, stride=stride, most_shared=most_shared)
    return trie_nodes(keys)
