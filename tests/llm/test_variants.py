"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitelattice.llm import variants

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, least=6, count=5, factor=5, every=199):
    n = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= count}
    by = {}
    for w in n:  # only words that share all letters but one can be near
        for i in range(len(w)):
            by.setdefault(w[:i] + w[i + 1:], []).append(w)
        by.setdefault(w, []).append(w)
    close = {w: {v for i in range(len(w)) for v in by[w[:i] + w[i + 1:]] if near(w, v)} | {v for v in by[w] if near(w, v)} for w in n}
    form = {}
    for w, k in n.items():
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * k else None
    out = []
    for w, k in n.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, k, len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def edits(rnd, w):
    i = rnd.randrange(len(w) + 1)
    c = rnd.choice("abcdéÿ÷")
    return rnd.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]])


@pytest.fixture(scope="module")
def texts():
    rnd, rows = random.Random(2), []
    stems = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(6, 14))) for _ in range(60)]
    stems += ["common" + "".join(rnd.choice("xyzw") for _ in range(5)) for _ in range(80)]
    for i in range(400):
        words = []
        for _ in range(60):
            w = stems[int(len(stems) * rnd.random() ** 3)]
            for _ in range(int(rnd.random() ** 6 * 4)):
                w = edits(rnd, w)
            words.append(rnd.choice([w, w.upper(), w.capitalize()]))
        rows.append((i if i % 9 else None, rnd.choice([" ", "_", ", ", "中", "Ā", "\n1"]).join(words)))
    chain = [(500, "chainword " * 6), (501, "Chainwords " * 40), (502, "chainwordsy " * 300)]
    return rows + chain + [(1, None), (2, ""), (3, "commonx " * 40_000), (3, "Commonx " * 7), (3, "Commonx " * 7), (4, "ÀÉÎõü× " * 30)]


def test_equals_brute_force(spark, texts):
    docs = spark.createDataFrame([(d, t, "w", "n") for d, t in texts], "doc_id long, text string, word string, n string").repartition(5)
    got, want = rows_of(variants.group_variants(docs)), brute(texts)
    assert got == want
    assert any(r[1] for r in want) and ("chainword", "chainwords", "chainwordsy") in {r[:3] for r in want}


def test_short_words_and_a_small_dictionary(spark, texts):
    docs = spark.createDataFrame(texts[:150], "doc_id long, text string").repartition(2)
    got = rows_of(variants.group_variants(docs, least_length=2, least_count=2, factor=2, every=7))
    assert got == brute(texts[:150], 2, 2, 2, 7)
    small = variants.count_words(docs, 7, 2, "doc_id", "text", held=20)
    assert small.count() == variants.count_words(docs, 7, 2, "doc_id", "text").count()


def test_pairs_come_once_and_within_one_hot_bucket(spark):
    rnd = random.Random(4)
    words = {"samebeginningofallwords" + "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 6))) for _ in range(900)}
    words |= {"ab", "abc", "ac", "b", "bb"} - {"b"}
    given = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = sorted(tuple(sorted((r.a, r.b))) for r in variants.near_pairs(given).collect())
    ordered = sorted(words)
    assert got == [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1:] if near(a, b)]


def test_registered_words_of_the_given_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    given = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(variants.group_variants(docs)) == brute(given)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(variants.group_variants(none)) == []
    with pytest.raises(ValueError):
        variants.group_variants(none, least_length=1)
    assert rows_of(variants.group_variants(none.union(none.select(F.lit(1).cast("long"), F.lit("too rare"))))) == []
