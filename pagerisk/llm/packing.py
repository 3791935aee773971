"""Token ids in fixed-width bit-packed files: writing, reading, random access.

A file holds whole documents in ascending order. Its parts, all little-endian: the magic,
a header of six unsigned 64-bit integers (bits per id, ids per block, documents, ids, blocks,
vocabulary size), the document ids (signed 64-bit) with one byte each that is 1 where the
id is NULL, the end of each document in ids of this file, the byte offset of each block
in the payload, and the payload. A block packs its ids back to back, lowest bit first, and
starts on a byte.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagerisk.llm.bpe import byte_alphabet, gather
from pagerisk.llm.common import running_total
from pagerisk.session import materialise, scratch_path
from pagerisk.sources.paths import open_filesystem

MAGIC = b"IDPACK01"
BLOCK_IDS = 1 << 16
#: A file ends with the document that brings it to so many ids.
FILE_IDS = 1 << 25
_CACHED_WORDS = 800_000


def bits_for(vocabulary_size: int) -> int:
    """The fewest bits that hold every id of the vocabulary."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids back to back, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(packed, np.uint8), count=count * bits, bitorder="little")
    powers = np.uint32(1) << np.arange(bits, dtype=np.uint32)
    return (flat.reshape(count, bits) * powers).sum(axis=1, dtype=np.uint32)


def file_bytes(
    doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, vocabulary_size: int
) -> Iterator[bytes]:
    """The content of one file, part by part."""
    bits = bits_for(vocabulary_size)
    blocks = -(-len(ids) // BLOCK_IDS)
    header = [bits, BLOCK_IDS, len(doc_ids), len(ids), blocks, vocabulary_size]
    yield MAGIC + np.array(header, "<u8").tobytes()
    yield np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    yield np.array([d is None for d in doc_ids], np.uint8).tobytes()
    yield np.cumsum(np.array(lengths, np.int64)).astype("<u8").tobytes()
    yield (np.arange(blocks, dtype=np.int64) * (-(-BLOCK_IDS * bits // 8))).astype("<u8").tobytes()
    for start in range(0, len(ids), BLOCK_IDS):
        yield pack(ids[start : start + BLOCK_IDS], bits)


class PackedFile:
    """Random access to one file: only the blocks that hold a document are read."""

    def __init__(self, file):
        self._file = file
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a file of packed ids")
        numbers = np.frombuffer(file.read(48), "<u8").astype(np.int64).tolist()
        self.bits, self.block_ids, documents, self.n_ids, blocks, self.vocabulary_size = numbers
        values = np.frombuffer(file.read(8 * documents), "<i8").tolist()
        null = np.frombuffer(file.read(documents), np.uint8).tolist()
        self.doc_ids = [None if n else v for v, n in zip(values, null, strict=True)]
        self.ends = np.frombuffer(file.read(8 * documents), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(file.read(8 * blocks), "<u8").astype(np.int64)
        self._payload = file.tell()
        self._held = (-1, np.zeros(0, np.uint32))

    def _block(self, number: int) -> np.ndarray:
        if self._held[0] != number:
            count = min(self.block_ids, self.n_ids - number * self.block_ids)
            self._file.seek(self._payload + int(self.offsets[number]))
            packed = self._file.read(-(-count * self.bits // 8))
            self._held = (number, unpack(packed, self.bits, count))
        return self._held[1]

    def ids(self, document: int) -> np.ndarray:
        """The ids of the n-th document of the file."""
        start = int(self.ends[document - 1]) if document else 0
        end = int(self.ends[document])
        parts = []
        while start < end:
            number, first = divmod(start, self.block_ids)
            parts.append(self._block(number)[first : first + end - start])
            start += len(parts[-1])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class WordEncoder:
    """The tokenizers library over distinct words.

    The word tokenizer drops white space and no token reaches over it, so a text has the
    ids of its words. Words of ASCII and Latin-1 letters, which the normalizer only lowers,
    are cut as the pre-tokenizer cuts them, and each distinct piece goes to the library's
    model once; all other words take the library's whole way.
    """

    _PLAIN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
    _PIECES = re.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]"
        r"|[^a-z0-9\n\xdf-\xf6\xf8-\xff]+|\n"
    )

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self.vocabulary_size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        specials = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        if any(len(s.split()) != 1 for s in specials):
            raise ValueError("special tokens may not hold white space")
        self._special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
        self._shown = {b: c for c, b in byte_alphabet().items()}
        self._reset()

    def _reset(self) -> None:
        self._numbers = _Numbers()
        self._ids = np.zeros(0, np.uint32)
        self._length = np.zeros(0, np.int64)
        self._pieces = _Numbers()
        self._piece_ids = np.zeros(0, np.uint32)
        self._piece_length = np.zeros(0, np.int64)

    def _spelled(self, piece: str) -> str:
        if piece.isascii():
            return piece if piece != "\n" else ""
        return "".join([self._shown[b] for b in piece.encode()])

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, joined, and the number of each word."""
        cut = self._PIECES.findall("\n".join(["", *words]).lower())
        pieces = np.fromiter(map(self._pieces.__getitem__, cut), np.int64, len(cut))
        new, self._pieces.new = self._pieces.new, []
        tokenize = self._tokenizer.model.tokenize
        made = [[token.id for token in tokenize(self._spelled(piece))] for piece in new]
        flat = np.fromiter(chain.from_iterable(made), np.uint32)
        self._piece_ids = np.concatenate((self._piece_ids, flat))
        length = np.array([len(ids) for ids in made], np.int64)
        self._piece_length = np.concatenate((self._piece_length, length))
        length = self._piece_length[pieces]
        starts = (np.cumsum(self._piece_length) - self._piece_length)[pieces]
        marks = np.flatnonzero(pieces == self._pieces["\n"])
        numbers = np.add.reduceat(length, marks) if len(marks) else np.zeros(0, np.int64)
        return gather(self._piece_ids, starts, length), numbers

    def _learn(self, words: list[bytes]) -> None:
        texts = [word.decode("utf-8", "replace") for word in words]
        whole = self._PLAIN.fullmatch
        plain = np.array(
            [bool(whole(t)) and not ("<" in t and self._special.search(t)) for t in texts], bool
        )
        ids, numbers = self._plain([t for t, easy in zip(texts, plain, strict=True) if easy])
        others = [t for t, easy in zip(texts, plain, strict=True) if not easy]
        made = self._tokenizer.encode_batch(others, add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(e.ids for e in made), np.uint32)
        length = np.empty(len(words), np.int64)
        length[plain] = numbers
        length[~plain] = [len(encoding.ids) for encoding in made]
        # Plain words come first, then the others; the starts bring them into order.
        start = np.empty(len(words), np.int64)
        start[plain] = np.cumsum(numbers) - numbers
        start[~plain] = np.cumsum(length[~plain]) - length[~plain] + len(ids)
        ids = gather(np.concatenate((ids, flat)), start, length)
        self._ids = np.concatenate((self._ids, ids))
        self._length = np.concatenate((self._length, length))

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and the number of each text."""
        if len(self._numbers) > _CACHED_WORDS:
            self._reset()
        numbers: list[int] = []
        ends = [0]
        for text in texts:
            numbers.extend(map(self._numbers.__getitem__, (text or b"").split()))
            ends.append(len(numbers))
        if self._numbers.new:
            new, self._numbers.new = self._numbers.new, []
            self._learn(new)
        used = np.array(numbers, np.int64)
        length = self._length[used]
        starts = (np.cumsum(self._length) - self._length)[used]
        reached = np.concatenate(([0], np.cumsum(length)))[ends]
        return gather(self._ids, starts, length), np.diff(reached)


class _Numbers(dict):
    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word):
        self[word] = number = len(self)
        self.new.append(word)
        return number


_ENCODERS: dict[str, WordEncoder] = {}
_WRITTEN = "part long, seq long, path string, n_docs long, n_ids long"


def write_packed(
    documents: DataFrame,
    tokenizer_path: str,
    out_dir: str,
    *,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode every text, append ``end_id``, write files in ascending id order.

    Returns the manifest: part, seq, path, n_docs, n_ids and base, the ids in all files
    before it. Rows are range-partitioned by id, and by a hash of the text among equal ids,
    and each task writes its rows as files of bounded size. A file is written under a name
    of its attempt and then renamed; a task that is run again writes equal files.

    A NULL or empty text has the end id alone; NULL ids come first; rows of one id stand in
    the order of their texts; other columns are ignored; an empty table writes no file.
    """
    tie = F.xxhash64(F.col(text_col))
    rows = (
        documents.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
            tie.alias("tie"),
        )
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .drop("tie")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = WordEncoder(tokenizer_path)
        encoder = _ENCODERS[tokenizer_path]
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        docs: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        count = seq = 0

        def flush():
            nonlocal docs, lengths, held, count, seq
            path = f"{out_dir}/part-{part:06d}-{seq:04d}.ids"
            ids = np.concatenate(held)
            _write(path, attempt, file_bytes(docs, lengths, ids, encoder.vocabulary_size))
            row = [part, seq, path, len(docs), len(ids)]
            docs, lengths, held, count, seq = [], [], [], 0, seq + 1
            names = ["part", "seq", "path", "n_docs", "n_ids"]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names)

        for batch in batches:
            found, numbers = encoder.encode(_bytes(batch.column(1)))
            ends = np.cumsum(numbers)
            ids = np.insert(found, ends, end_id)
            start = 0
            for doc, length in zip(batch.column(0).to_pylist(), (numbers + 1).tolist(), strict=True):
                docs.append(doc)
                lengths.append(length)
                held.append(ids[start : start + length])
                start += length
                count += length
                if count >= file_ids:
                    yield flush()
        if docs:
            yield flush()

    written = materialise(rows.mapInArrow(run, _WRITTEN), "packed-manifest")
    cells = written.withColumn("_coarse", F.floor(F.col("part") / 1024)).withColumn(
        "_fine", F.col("part")
    )
    total = running_total(cells, [], ["_coarse", "_fine"], ["seq"], "n_ids", "base")
    return total.withColumn("base", F.col("base") - F.col("n_ids")).drop("_coarse", "_fine")


def _bytes(column) -> list[bytes | None]:
    large = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def _write(path: str, attempt: int, parts: Iterator[bytes]) -> None:
    system, target = open_filesystem(path)
    system.create_dir(os.path.dirname(target), recursive=True)
    own = f"{target}.{attempt}.tmp"
    with system.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    try:
        system.move(own, target)
    except OSError:
        # Some stores do not rename onto a file; an earlier attempt has written an equal one.
        if not system.get_file_info(target).is_file:
            raise
        system.delete_file(own)


def read_packed(spark: SparkSession, manifest: DataFrame, fields=("ids",)) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start, n_tokens and the chosen fields.

    ``start`` counts the ids of all documents before. Fields are ids (array) and ids_crc32,
    the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    kinds = {"ids": "array<int>", "ids_crc32": "long"}
    schema = ", ".join(
        ["doc_id long", "start long", "n_tokens long", *[f"{f} {kinds[f]}" for f in fields]]
    )
    names = ["doc_id", "start", "n_tokens", *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, source = open_filesystem(path)
                with system.open_input_file(source) as file:
                    packed = PackedFile(file)
                    for low in range(0, len(packed.doc_ids), 512):
                        high = min(low + 512, len(packed.doc_ids))
                        columns = [[], [], [], *[[] for _ in fields]]
                        for n in range(low, high):
                            ids = packed.ids(n)
                            columns[0].append(packed.doc_ids[n])
                            columns[1].append(base + int(packed.ends[n]) - len(ids))
                            columns[2].append(len(ids))
                            for place, field in enumerate(fields, 3):
                                crc = field == "ids_crc32"
                                columns[place].append(
                                    zlib.crc32(ids.astype("<u4").tobytes())
                                    if crc
                                    else ids.astype("i4")
                                )
                        types = [pa.int64()] * 3 + [
                            pa.int64() if f == "ids_crc32" else pa.list_(pa.int32())
                            for f in fields
                        ]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
                        )

    # Files are few and large, so they are dealt one by one.
    files = manifest.select("path", "base").repartition(
        max(1, spark.sparkContext.defaultParallelism * 4)
    )
    return files.mapInArrow(run, schema)


def pack_documents(
    documents: DataFrame, tokenizer_path: str, *, fields=("ids",), **settings
) -> DataFrame:
    """Write all documents to files in the shared folder and read them back."""
    spark = documents.sparkSession
    manifest = write_packed(
        documents, tokenizer_path, scratch_path(spark, "packed-ids"), **settings
    )
    return read_packed(spark, manifest, fields)
