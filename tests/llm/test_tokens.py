"""Encoding, counting and packing against the public libraries and against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sitelattice.llm import bpe, packing, tokencount

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*"abc  \n\t'sΣİé ▁\x1c\x85 12中文🙂\x00½Ⅷ<|>", "<|endoftext|>", "<|startoftext|>", "<s>", "<0x0A>",
         " the", " ing", "'re", "thonre", "  \n "]
SCHEMA = "doc_id long, text string, ids string, start string, id string"


def odd_texts(n=1500):
    rnd = random.Random(3)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows(spark, small):
    given = [(r.doc_id, r.text, "x", "y", "z") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    odd = [(10_000 + i, t, None, None, None) for i, t in enumerate(odd_texts(300))]
    extra = [(None, None, "a", None, "b"), (None, "", None, None, None), (5, "again and again", None, None, None),
             (5, "again and again", None, None, None), (6, "verylongword" * 4000, None, None, None),
             (7, "ab c " * 9000, None, None, None)]
    return given + odd + extra


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def library_ids(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_word_bpe_equals_the_library_on_odd_texts():
    own, lib = bpe.WordBpe(open(WORD, "rb").read()), Tokenizer.from_file(WORD)
    for t in odd_texts():
        ids = own.encode(t)
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert own.decode(ids).decode() == lib.decode(want, skip_special_tokens=False)


def test_byte_bpe_equals_the_library_on_odd_texts():
    own, texts = packing.ByteBpe(open(BYTE, "rb").read()), odd_texts()
    for t, want in zip(texts, library_ids(BYTE, texts)):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == want, t


def test_piece_counts_equal_the_library_on_odd_texts():
    pieces = tokencount.Pieces(open(PIECE, "rb").read())
    whole = pieces.whole_tokens()
    own, lib = tokencount.Counter(pieces, whole, memo=50), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for t in odd_texts():
        assert own.count(t) == len(lib.encode(t)), t
    assert {"▁the", "▁of"} <= whole


def test_merges_equal_rescanning():
    rnd = random.Random(1)
    pairs = {a << bpe.SYMBOL_BITS | b: bpe.pair_value(rnd.randint(0, 9), rnd.randint(0, 7))
             for a in range(8) for b in range(8) if rnd.random() < .5}
    for _ in range(300):
        symbols = [rnd.randint(0, 7) for _ in range(rnd.randint(0, 12))]
        want = list(symbols)
        while True:
            found = [(pairs[k] >> bpe.SYMBOL_BITS, i) for i in range(len(want) - 1)
                     if (k := want[i] << bpe.SYMBOL_BITS | want[i + 1]) in pairs]
            if not found:
                break
            _, i = min(found)
            want[i:i + 2] = [pairs[want[i] << bpe.SYMBOL_BITS | want[i + 1]] & (1 << bpe.SYMBOL_BITS) - 1]
        assert bpe.merge_symbols(list(symbols), pairs) == want


def test_encode_decode_rows(docs, rows):
    lib = Tokenizer.from_file(WORD)
    want = []
    for doc, text, *_ in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    out = bpe.encode_decode(docs, WORD)
    got = [tuple(r)[:4] for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]


def test_count_rows(docs, rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = [(d, len((t or "").encode()), n := len(lib.encode(t or "")), n > 4096) for d, t, *_ in rows]
    assert sorted(map(tuple, tokencount.count_tokens(docs, PIECE).collect()), key=repr) == sorted(want, key=repr)


def test_best_fill_is_the_best():
    rnd = random.Random(2)
    for _ in range(300):
        counts = {rnd.randint(1, 12): rnd.randint(0, 3) for _ in range(rnd.randint(0, 4))}
        room = rnd.randint(0, 25)
        taken = packing.best_fill(counts, room)
        assert all(0 < k <= counts[n] for n, k in taken.items())
        all_sums = {sum(n * k for n, k in zip(counts, ks))
                    for ks in itertools.product(*[range(c + 1) for c in counts.values()])}
        assert sum(n * k for n, k in taken.items()) == max(s for s in all_sums if s <= room)


def check_pieces(pieces, want_ids, capacity):
    """want_ids: list of (doc, ids). Each id in exactly one piece; sequences gapless and within capacity."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append(p)
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for doc, ids in want_ids:
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    return len(by_seq) * capacity - sum(p.length for p in pieces)


def test_pack_rows(spark, rows):
    unique = [(i, r[1]) for i, r in enumerate(rows)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in unique], "doc_id long, text string, length string")
    want = [(i, ids + [0]) for (i, _), ids in zip(unique, library_ids(BYTE, [t or "" for _, t in unique]))]
    for window in (8192, 10):
        pieces = packing.pack(docs.repartition(3), BYTE, window=window).collect()
        padding = check_pieces(pieces, want, 1024)
        assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 for p in pieces)
        if window == 8192:
            assert padding < 3 * 1024  # the last window of each task at most


def test_pack_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (1, "x y"), (1, "x y")], "doc_id long, text string")
    got = packing.pack(docs.coalesce(1), BYTE, capacity=4)
    assert sorted((p.doc_id or 0, p.doc_tokens) for p in got.collect() if p.start == 0) == [(0, 1), (0, 3), (1, 3), (1, 3)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))
    assert packing.pack(empty, BYTE).count() == 0
    assert bpe.encode_decode(empty, WORD).count() == 0
    assert tokencount.count_tokens(empty, PIECE).count() == 0
