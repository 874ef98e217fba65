"""Ranked search against scoring every document for every query."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from check import TABLES, compare
from sitelattice.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                    for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def given():
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abÀ中9") for _ in range(rnd.randint(1, 5))) for _ in range(400)]
    text = lambda n: "".join(words[int(400 * rnd.random() ** 2)].capitalize() + rnd.choice([" ", ", ", "\x1f", "_", "\x7f"]) for _ in range(n))
    docs = [(i if i % 13 else None, text(rnd.randint(0, 60))) for i in range(2600)]
    docs += [(7, docs[7][1])] * 3 + [(9001, None), (9002, ""), (9003, " ,;"), (9004, text(40_000)), (9005, "rare rare À"), (3, "rare À")]
    items = [(i, text(rnd.randint(1, 30))) for i in range(40)] + [(41, None), (42, ""), (43, "rare"), (43, "rare"), (None, "À 9"), (44, "absent words only")]
    return docs, items


def test_terms_of_bytes_equal_the_pattern():
    rnd = random.Random(1)
    for _ in range(500):
        t = "".join(rnd.choice("aZ09 _\x00\x1c\x7f\x80é中🙂@[`{") for _ in range(30))
        assert [w.decode() for w in lexical.terms(t.encode())] == terms(t)


@pytest.mark.parametrize("coordinates,batch_rows", [(8192, 1024), (8, 15)])
def test_equals_brute_force(spark, given, coordinates, batch_rows):
    docs, items = given
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, text string, score int, item int, rank int").repartition(3)
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, id string")
    out = lexical.search(d, q, coordinates=coordinates, batch_rows=batch_rows)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(docs, items, 10)


def test_bounds_hold_and_spare_documents():
    rnd = random.Random(3)
    texts = [" ".join(f"w{int(3000 * rnd.random() ** 2)}" for _ in range(80)) for _ in range(900)]
    q = lexical.Queries([texts[5], texts[70]])
    held = {i: sum(t.decode() in x.split() for x in texts) for t, i in q.numbers.items()}
    s = lexical.Searcher(q.weigh(900, held), 900, 900 * 80, 3, 2048)
    for i, t in enumerate(texts):
        s.add(i, t.encode())
    bounds = s._bounds()
    exact = np.array([[s._score(own, i) for own in s.weighed] for i in range(900)])
    assert (bounds >= exact).all()
    s.search()
    assert s.best[0][0][2] == 5 and s.scored < 300


def test_empty_tables(spark, given):
    d = spark.createDataFrame(given[0][:5], "doc_id long, text string")
    q = spark.createDataFrame(given[1][:5], "item_id long, text string")
    assert lexical.search(d.where("doc_id < 0"), q).count() == 0
    assert lexical.search(d, q.where("item_id < 0")).count() == 0


def test_matches_sql(spark, small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    status, _, msg = compare(spark, con, "op11", queries.QUERIES["op11_lexical_search"], queries.ORACLES["op11_lexical_search"], small)
    assert status == "ok", msg
