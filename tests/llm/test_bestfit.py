"""Bounded-space best-fit: pieces against the library, bins against a plain search over all open bins."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitelattice.llm import bestfit
from tests.llm.test_tokens import SCHEMA, WORD, odd_texts


@pytest.mark.parametrize("most", [1, 3, 50])
def test_bins_equal_a_search_over_all_open_bins(most):
    rnd, own, open_, next_ = random.Random(most), bestfit.OpenBins(40, most), {}, 0
    for _ in range(3000):
        n = rnd.randint(1, 40)
        number, offset = own.put(n)
        fits = [f for f in open_.values() if f >= n]
        if fits:
            assert open_[number] == min(fits) and offset == 40 - min(fits)
            open_[number] -= n
            if not open_[number]:
                del open_[number]
        else:
            assert (number, offset) == (next_, 0)
            next_ += 1
            if n < 40:
                if len(open_) == most:
                    fullest = min(open_.values())
                    gone = [k for k, f in open_.items() if f == fullest]
                    assert len(own.bins[fullest]) == len(gone) - 1 + (40 - n == fullest)
                    del open_[next(k for k in gone if k not in own.bins[fullest])]
                open_[number] = 40 - n
        assert sorted(f for f, b in enumerate(own.bins) for _ in b) == sorted(open_.values())
        assert all(bool(own.free >> f & 1) == bool(b) for f, b in enumerate(own.bins))


def test_ids_equal_the_library():
    own, lib = bestfit.RankedWordBpe(open(WORD, "rb").read()), Tokenizer.from_file(WORD)
    rnd, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyzéàçñüσжø中"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 16))) for _ in range(5000)]
    vocabulary = [s.replace("</w>", "") for s in own.vocab]
    words += [rnd.choice(vocabulary) + rnd.choice(vocabulary) for _ in range(5000)] + vocabulary[512:20_000:7]
    for t in [*odd_texts(), *words]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_pieces_and_sequences(spark, small):
    given = [(r.doc_id, r.text, "x", "y", "z") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    given += [(None, None, "a", None, "b"), (None, "", None, None, None), (5, "again and again", None, None, None),
              (5, "again and again", None, None, None), (6, "verylongword" * 4000, None, None, None), (7, "ab c " * 9000, None, None, None)]
    docs = spark.createDataFrame(given, SCHEMA).repartition(3)
    out = bestfit.pack(docs, WORD)
    rows = out.collect()
    lib, texts = Tokenizer.from_file(WORD), {}
    for doc, text, *_ in given:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        texts.setdefault(doc, []).append(np.array(ids, "<u4").tobytes())
    want = sorted((repr(doc), i, 2048 * i, len(part) // 4, zlib.crc32(part)) for doc, many in texts.items() for ids in many
                  for i, part in enumerate(ids[at:at + 8192] for at in range(0, len(ids), 8192)))
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    bins = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048
    assert len(bins) <= 1.1 * sum(bins.values()) / 2048 + 3
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]


def test_few_open_bins_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 40)) for i in range(500)], "doc_id long, text string").coalesce(1)
    few, many = (bestfit.pack(docs, WORD, capacity=64, open_bins=n, keep=False).select("sequence_id").distinct().count() for n in (1, 500))
    assert many <= few
    none = bestfit.pack(docs.where("doc_id < 0"), WORD, keep=False)
    assert none.count() == 0 and none.schema["piece"].dataType.simpleString() == "int"
    with pytest.raises(ValueError):
        bestfit.pack(docs, public_tokenizers.path("word_bpe_49k.json"), open_bins=0)
