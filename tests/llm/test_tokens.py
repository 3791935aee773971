import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagerisk.llm import bpe, packing
from tests.llm import frames

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(count=800):
    chance = random.Random(5)
    pool = ["a", "B", " ", "\n", "é", "e", "一", "\U0001f600", "1", "'", "s", "̀", "\xa0", "\x85"]
    pool += ["\x1c", "\x00", "\x7f", "Σ", "ς", "İ", "՘", "<|endoftext|>", "  ", "<"]
    texts = ["", "aaaaaaaaaaaaaaaaaaa", " \n\n  \t x", "x<|endoftext|><|endoftext|> y", "a   b  "]
    for _ in range(count):
        some = [chance.choice(pool) for _ in range(chance.randrange(1, 60))]
        some.append(chr(chance.randrange(32, 0xD7FF)))
        some.append(chr(chance.randrange(0x10000, 0x10FFFF)))
        chance.shuffle(some)
        texts.append("".join(some))
    return texts


def test_byte_bpe_equals_library():
    library, own = Tokenizer.from_file(BYTE), bpe.Encoder(BYTE)
    texts = odd_texts()
    ids, ends = own.encode(texts)
    start = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[start:end].tolist() == want
        decoded = own.vocabulary.decode(ids[start:end]).decode("utf-8", "replace")
        assert decoded == library.decode(want, skip_special_tokens=False)
        start = end


def test_texts_are_encoded_in_bounded_portions(spark):
    most = bpe._CHARS_AT_ONCE
    sizes = [most // 3] * 4 + [0, 2 * most, 5, 0, most - 5, 1]
    spans = list(bpe._portions(["x" * size for size in sizes]))
    assert spans == [(0, 3), (3, 5), (5, 6), (6, 9), (9, 10)]
    assert list(bpe._portions([])) == []
    texts = [f"{n} " + f"word{n % 7} of a text, " * 60_000 for n in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in bpe.encode_decode(docs, BYTE).collect()}
    library = Tokenizer.from_file(BYTE)
    assert all(found[n].decoded == text for n, text in enumerate(texts))
    assert all(found[n].ids == library.encode(text).ids for n, text in enumerate(texts))


def test_overlapping_pairs_merge_from_the_left():
    vocabulary = bpe.Vocabulary(BYTE)
    library = Tokenizer.from_file(BYTE)
    words = ["a" * n for n in range(1, 40)] + ["ababab", "hahaha", "lll"]
    ids, counts = bpe.merge_words(vocabulary, [w.encode() for w in words])
    ends = np.cumsum(counts)
    for word, end, count in zip(words, ends, counts, strict=True):
        assert ids[end - count : end].tolist() == library.encode(word).ids


def test_word_bpe_equals_library():
    library, own = Tokenizer.from_file(WORD), packing.WordEncoder(WORD)
    texts = [*odd_texts(), "Don't STOP, it's 1984!! naïve Ärger <|startoftext|>x"]
    ids, counts = own.encode([t.encode() for t in texts])
    start = 0
    for text, count in zip(texts, counts.tolist(), strict=True):
        assert ids[start : start + count].tolist() == library.encode(
            text, add_special_tokens=False
        ).ids
        start += count


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 12, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 999, dtype=np.uint64).astype(np.uint32)
    packed = packing.pack(ids, bits)
    assert len(packed) == -(-999 * bits // 8)
    assert (packing.unpack(packed, bits, 999) == ids).all()
    assert packing.bits_for(2**bits) == bits


def test_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_IDS", 64)
    chance = np.random.default_rng(1)
    lengths = [0, 5, 200, 1, 63, 64, 65]
    ids = chance.integers(0, 5000, sum(lengths)).astype(np.uint32)
    path = tmp_path / "x.ids"
    path.write_bytes(b"".join(packing.file_bytes([None, *range(6)], lengths, ids, 5000)))
    with open(path, "rb") as file:
        packed = packing.PackedFile(file)
        assert packed.bits == 13 and packed.doc_ids == [None, 0, 1, 2, 3, 4, 5]
        ends = np.cumsum(lengths)
        for n in (6, 2, 0, 5, 1, 4, 3):
            assert (packed.ids(n) == ids[ends[n] - lengths[n] : ends[n]]).all()


def test_encode_decode_on_awkward_rows(spark):
    library = Tokenizer.from_file(BYTE)
    found = bpe.encode_decode(frames.awkward(spark), BYTE).collect()
    assert len(found) == len(frames.rows())
    for row in found:
        assert row.decoded == (row.text or "")
        assert row.ids == library.encode(row.text or "").ids and row.n_tokens == len(row.ids)
    assert bpe.encode_decode(frames.empty(spark), BYTE).collect() == []
    digest = bpe.encode_decode(frames.awkward(spark), BYTE, ("decoded_sha256",), keep=["doc_id"])
    one = digest.filter("doc_id = 7").collect()[0]
    text = frames.rows()[7][1]
    assert one.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_packed_files_on_awkward_rows(spark):
    library = Tokenizer.from_file(WORD)
    rows = frames.awkward(spark)
    found = packing.pack_documents(
        rows, WORD, fields=("ids", "ids_crc32"), file_ids=40
    ).collect()
    found = sorted(found, key=lambda r: r.start)
    assert len(found) == len(frames.rows())
    start = 0
    for row in found:
        assert row.start == start and row.n_tokens == len(row.ids) and row.ids[-1] == 1
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        start += row.n_tokens
    order = [row.doc_id for row in found]
    assert order[:2] == [None, None]
    assert order[2:] == sorted(order[2:])
    texts = sorted((r[0] or 0, library.encode(r[1] or "").ids + [1]) for r in frames.rows())
    assert sorted((r.doc_id or 0, list(r.ids)) for r in found) == texts
    assert packing.pack_documents(frames.empty(spark), WORD).collect() == []
