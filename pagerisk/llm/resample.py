"""Importance resampling of documents towards a target text, over hashed runs of words.

Every run of one to three words is a feature, and its bucket is a CRC-32 of its bytes. No
run is ever spelled out: a batch's distinct words, each between two delimiters, make an
Aho-Corasick automaton whose payloads are the CRC and the length of a word. A scan of the
texts emits one payload a word, and the CRC of a run is composed of neighbouring payloads,
since appending bytes to a text acts on its CRC as a linear map that depends on their number.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagerisk.llm.common import running_total, utf8_rows
from pagerisk.session import materialise

BUCKETS = 10_000
RUN = 3
#: Words of more bytes stand in the automaton under a short name, so its size is bounded.
_LONG_WORD = 64
#: Texts are scanned together up to so many bytes; a longer one is scanned alone.
_BYTES_AT_ONCE = 8 << 20
_COARSE = 4096

# Letters are lowered and everything in ASCII but letters and digits is a delimiter.
_FOLD = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if byte >= 128 or chr(byte).isalnum() else 32
    for byte in range(256)
)
_SPACE = np.uint32(zlib.crc32(b" "))


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & 255]
    for place in (1, 2, 3):
        out = out ^ tables[place][(crc >> np.uint32(8 * place)) & 255]
    return out


def _append_tables() -> list[np.ndarray]:
    """For each power of two, what so many zero bytes make of a CRC, byte by byte of it."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0))
    # One zero byte shifts the CRC down and folds in what falls out.
    parts = [step] + [byte << np.uint32(8 * (place - 1)) for place in (1, 2, 3)]
    tables = [np.stack(parts)]
    while len(tables) < 40:
        tables.append(np.stack([_apply(tables[-1], row) for row in tables[-1]]))
    return tables


_APPEND = _append_tables()


def append(crc: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of two texts one after the other, from their CRCs and the second one's length."""
    crc = crc.astype(np.uint32)
    top = int(length.max()).bit_length() if len(length) else 0
    for power in range(top):
        at = np.flatnonzero((length >> power) & 1)
        crc[at] = _apply(_APPEND[power], crc[at])
    return crc ^ other


def payloads(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and length of every word of all texts, in order, and the words of each text."""
    import ahocorasick

    folded = [text.translate(_FOLD) for text in texts]
    counts = np.zeros(len(texts), np.int64)
    distinct: set[bytes] = set()
    for n, text in enumerate(folded):
        words = text.split()
        counts[n] = len(words)
        distinct.update(words)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), counts
    dictionary = ahocorasick.Automaton()
    short: dict[bytes, bytes] = {}
    for word in sorted(distinct):  # neighbours in the trie are made one after the other
        name = word
        if len(word) > _LONG_WORD:
            name = short[word] = b"\x01%d" % len(short)
        key = (b" " + name + b" ").decode("utf-8", "surrogateescape")
        dictionary.add_word(key, (len(word) << 32) | zlib.crc32(word))
    dictionary.make_automaton()
    if short:
        folded = [b" ".join([short.get(w, w) for w in text.split()]) for text in folded]
    scan = b" ".join([b"", *folded, b""]).decode("utf-8", "surrogateescape")
    found = np.fromiter(map(itemgetter(1), dictionary.iter(scan)), np.int64, total)
    return (found & 0xFFFFFFFF).astype(np.uint32), found >> 32, counts


def buckets_of(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature, the text it belongs to, and the words of each text."""
    crc, length, counts = payloads(texts)
    text = np.repeat(np.arange(len(texts)), counts)
    found, owner = [crc % buckets], [text]
    run = crc
    for size in range(2, RUN + 1):
        if len(crc) < size:
            break
        spaced = _apply(_APPEND[0], run[: len(crc) - size + 1]) ^ _SPACE
        run = append(spaced, crc[size - 1 :], length[size - 1 :])
        whole = text[: len(run)] == text[size - 1 :]
        found.append(run[whole] % buckets)
        owner.append(text[: len(run)][whole])
    return np.concatenate(found), np.concatenate(owner), counts


def _portions(column) -> Iterator[tuple[int, list[bytes]]]:
    rows = [text or b"" for text in utf8_rows(column)]
    low = size = 0
    for n, text in enumerate(rows):
        if n > low and size + len(text) > _BYTES_AT_ONCE:
            yield low, rows[low:n]
            low, size = n, 0
        size += len(text)
    if rows:
        yield low, rows[low:]


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n): how many features of all whole texts fall into each bucket.

    A task sums up its texts, so at most ``buckets`` rows of it are shuffled. NULL and empty
    texts have no feature; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in _portions(batch.column(0)):
                total += np.bincount(buckets_of(part, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = texts.select(F.col(f"`{text_col}`")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket adds to a weight; the two tables have a row a bucket."""
    sides = source.withColumn("side", F.lit(0)).unionByName(target.withColumn("side", F.lit(1)))
    counts = np.zeros((2, buckets), np.int64)
    for row in sides.collect():
        counts[row["side"], row["bucket"]] = row["n"]
    own, wanted = counts.astype(np.float64)
    ratio = (wanted + 1) * (own.sum() + buckets) / ((own + 1) * (wanted.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def _noise(seed: int, ident: str | None) -> int:
    mark = int(hashlib.sha256(f"{seed}:{ident or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((mark + 0.5) / 4294967296)))


def score(
    documents: DataFrame,
    gains: np.ndarray,
    *,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (id, n_words, n_features, weight, score), one per document."""
    ident = F.col(f"`{id_col}`")
    source = documents.select(
        ident.alias("_id"), ident.cast("string").alias("_name"), F.col(f"`{text_col}`").alias("_t")
    )
    made = ["n_words", "n_features", "weight", "score"]
    schema = source.select("_id").schema
    for name in made:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pylist()
            for low, part in _portions(batch.column(2)):
                found, owner, words = buckets_of(part, len(gains))
                features = np.bincount(owner, minlength=len(part))
                weight = np.bincount(owner, gains[found], len(part)).astype(np.int64)
                noise = np.array([_noise(seed, n) for n in names[low : low + len(part)]], np.int64)
                columns = [words, features.astype(np.int64), weight, weight + noise]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(part)), *map(pa.array, columns)],
                    schema.names,
                )

    return source.mapInArrow(run, schema)


def _ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``scored`` with the rank of each drawn document.

    Counts of coarse ranges of scores tell below which range nothing is drawn; only what
    stands above is sorted, in cells of equal score.
    """
    fit = F.col("n_words") >= min_words
    coarse: Column = F.floor(-F.col("score") / _COARSE)
    counts = scored.filter(fit).groupBy(coarse.alias("cell")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("cell")) - F.col("n")
    drawn = F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100)
    cut = (
        counts.select("cell", before.alias("before"), drawn.cast("long").alias("drawn"))
        .filter("before < drawn")
        .agg(F.max("cell").alias("cell"), F.max("drawn").alias("drawn"))
        .collect()[0]
    )
    none = F.lit(None).cast("long").alias("rank")
    if cut["drawn"] is None:
        return scored.withColumn("rank", none)
    above = F.coalesce(fit & (coarse <= cut["cell"]), F.lit(False))
    order = [F.asc_nulls_last("_id"), "n_features", "weight"]
    cells = scored.filter(above).withColumns(
        {"_coarse": coarse, "_fine": -F.col("score"), "_one": F.lit(1).cast("long")}
    )
    ranked = running_total(cells, [], ["_coarse", "_fine"], order, "_one", "_rank")
    rank = F.when(F.col("_rank") <= cut["drawn"], F.col("_rank").cast("long"))
    ranked = ranked.select(*scored.columns, rank.alias("rank"))
    return ranked.unionByName(scored.filter(~above).withColumn("rank", none))


def resample(
    documents: DataFrame,
    target: DataFrame,
    *,
    percent: int = 5,
    min_words: int = 20,
    seed: int = 42,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """Every document's id, n_words, n_features, weight, score and rank among the drawn ones.

    Features are runs of one to three words of the whole text, ASCII letters lowered and
    joined by a space; each adds the gain of its bucket, the log of how much more frequent the
    bucket is in ``target``, to the document's weight. A Gumbel variate of the id makes it a
    score, and of the documents with ``min_words`` words that share ``percent`` of the
    highest scores is drawn, ties to the smaller id; all others have a NULL rank.

    NULL and empty texts have no feature and the weight 0; NULL ids draw like an empty one
    and come last among ties; rows repeated in id and text score alike and take ranks one
    after the other; other columns are ignored, whatever their names; ids may be of any
    type that orders; an empty table gives an empty one, an empty target flat counts. A
    text must fit in a task's memory.
    """
    gains = bucket_gains(
        bucket_counts(documents, text_col, buckets),
        bucket_counts(target, target_text_col, buckets),
        buckets,
    )
    scored = score(documents, gains, seed=seed, id_col=id_col, text_col=text_col)
    ranked = _ranked(materialise(scored, "resample-scores"), percent, min_words)
    return ranked.withColumnRenamed("_id", id_col)
