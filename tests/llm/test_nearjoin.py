"""The Jaccard join against brute force over all pairs, and components against union-find."""

import random

import numpy as np
import pytest

from sitelattice.llm import components, nearjoin
from tests.llm.test_repeats import split

SCHEMA = "doc_id long, text string, lang string, c0 string, node string, bands string, n_links int"


def sets_of(text):
    w = split(text or "")
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, class_id, n_links) per row."""
    sets = [sets_of(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    pick = lambda ids: min((d for d in ids if d is not None), default=None)
    return [(d, pick(least[find(i)]), links[i]) for i, (d, _) in enumerate(rows)]


def near_copies():
    rnd = random.Random(11)
    rows = []
    for base in range(6):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([9, 30, 120]))]
        for _ in range(rnd.choice([2, 12, 90])):
            w = list(words)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 9)}"
            rows.append((rnd.randint(0, 10**9), rnd.choice([" ", "\n"]).join(w)))
    rows += [(1, None), (2, ""), (3, None), (4, "one two"), (5, "one two"), (6, "one  two"), (7, "two one"), (8, "\n"),
             (None, "one two"), (None, "quite alone in this whole table of texts"), (9, "a b c d e"), (9, "a b c d e"),
             (10, "long " + " ".join(map(str, range(50_000)))), (11, " ".join(map(str, range(50_000)))),
             (12, "x y " * 30_000), (13, "y x " * 30_000)]
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nearjoin, "BLOCK", block)
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, "x", None, "n", "b", 1) for i, t in rows], SCHEMA).repartition(4)
    got = nearjoin.jaccard_join(docs, carry=["lang"]).collect()
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in got], key=repr) == sorted(brute(rows), key=repr)
    groups = {}
    for r in got:
        groups.setdefault((r.class_id, r.n_links if r.class_id is None else 0), []).append(r)
    for (c, _), g in groups.items():
        if c is not None and any(r.n_links for r in g):
            assert sum(r.keep for r in g) == 1 and next(r for r in g if r.keep).doc_id == c
    assert all(r.keep for r in got if not r.n_links)


def test_on_the_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = nearjoin.jaccard_join(docs).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_pruning_keeps_what_can_reach_the_threshold():
    least = nearjoin.least_matches(0.8, 1e-6)
    assert (np.diff(least) > 0).all() and least[0] < 0.8 * 16 and least[-1] < 0.8 * 128
    rnd = np.random.default_rng(2)
    lost = total = 0
    for _ in range(2000):
        path = np.cumsum((rnd.random(128) < 0.8).reshape(-1, 16).sum(1))
        lost += (path < least).any()
        total += 1
    assert lost == 0
    assert all((np.cumsum((rnd.random(128) < 0.3).reshape(-1, 16).sum(1)) < least).any() for _ in range(200))


def test_signatures_estimate_similarity():
    words = [f"w{i}" for i in range(400)]
    value, starts = nearjoin.shingles([" ".join(words).encode(), " ".join(words[40:] + ["z"] * 9).encode()])
    sig, _ = nearjoin.signatures(value, starts)
    a, b = (set(value[starts[i]:starts[i + 1]].tolist()) for i in (0, 1))
    assert abs((sig[0] == sig[1]).mean() - len(a & b) / len(a | b)) < 0.12


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    edges += [(300, i) for i in range(301, 400)] + [(None, 5), (6, None), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)


def test_empty_table(spark):
    assert nearjoin.jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0
