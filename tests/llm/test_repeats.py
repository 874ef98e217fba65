"""Removal of repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from sitelattice.llm import chunks, repeats

WINDOW = 20
SCHEMA = "doc_id long, text string, lang string, c0 string, chunk string, bits string, n_words int"


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, window=WINDOW):
    """rows: (doc_id, text) in input order -> [(doc_id, n_words, n_removed, sha)]"""
    words = [split(t or "") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), [None] * len(rows)
    for i in order:
        w, gone = words[i], set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (rows[i][0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def made_rows():
    rnd = random.Random(7)
    vocab = ["a", "b", "ab", "é", "x y", "\x1c", "中", "end.", "The"]
    word = lambda: rnd.choice(vocab) + str(rnd.randint(0, 30))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 25, 39, 60)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            parts += [word() for _ in range(rnd.randint(0, 30))]
            if rnd.random() < .6:
                p = rnd.choice(passages)
                a = rnd.randint(0, 3)
                parts += p[a:]
        rows.append((rnd.randint(0, 10**12), rnd.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(5, "same " * 50), (6, "same " * 19), (7, None), (8, ""), (9, "\n \t"), (10, rows[3][1]), (11, rows[3][1]),
             (None, rows[3][1]), (12, " ".join(passages[5]) + "x"), (13, "long " + " ".join(map(str, range(200_000)))),
             (14, " ".join(map(str, range(150_000, 210_000))))]
    return rows


@pytest.mark.parametrize("chunk_bytes", [500, 20_000, 4 << 20])
def test_equals_brute_force(spark, chunk_bytes):
    rows = made_rows()
    df = spark.createDataFrame([(i, t, "x", None, "y", "z", 1) for i, t in rows], SCHEMA).coalesce(1)
    got = repeats.remove_repeats(df, chunk_bytes=chunk_bytes, carry=["lang", "c0"]).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=repr) == sorted(brute(rows), key=repr)
    texts = dict(rows)
    for r in got:
        assert hashlib.sha256(" ".join(split(r.kept)).encode()).hexdigest() == r.kept_sha256
        if not r.n_removed and r.doc_id is not None:
            assert r.kept == (texts[r.doc_id] or "")
    assert got[0].__fields__ == ["doc_id", "lang", "c0", "n_words", "n_removed", "kept_sha256", "kept"]


def test_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = repeats.remove_repeats(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"))
    assert sorted(r.n_removed for r in got.collect()) == [0, 30]


def test_on_the_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = repeats.remove_repeats(docs, keep=False)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packed_integers():
    rnd = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.zeros(5, np.uint64), rnd.integers(0, 2**63, 999).astype(np.uint64)):
        assert (chunks.unpack_ints(chunks.pack_ints(x)) == x).all()
        assert (chunks.unpack_sorted(chunks.pack_sorted(np.sort(x))) == np.sort(x)).all()
