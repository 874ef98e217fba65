"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelattice.llm import ann, topk

SCHEMA = "vec_id long, embedding array<double>, ids string, block string, dim string, score string"


def wrap(rows):
    return [(i, v, "a", None, "b", "c") for i, v in rows]


ODD = [(100, None), (200, []), (300, [None, 1.0, 2.0]), (400, [float("nan"), 1.0, 2.0]), (500, [float("inf"), 1.0, 2.0]),
       (None, [1.0, 2.0, 3.0]), (600, [0.0, 0.0, 0.0]), (700, [1.0, 2.0]), (701, [2.0, 1.0]), (702, [1.0, 1.0])]


@pytest.fixture(scope="module")
def mixed():
    rnd = np.random.default_rng(5)
    same = [0.5, -0.25, 1.0]
    rows = [(i, list(map(float, rnd.normal(size=3)))) for i in range(60)]
    return rows + [(1000 + i, same) for i in range(40)] + ODD + [(7, rows[7][1])]


def valid(v, zero=True):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))


def brute(rows, asked, k, score, zero=True):
    rows = list({(i, tuple(v)): (i, v) for i, v in rows if i is not None and valid(v, zero)}.values())
    out = set()
    for q, x in rows:
        if asked(q):
            found = sorted(((-score(x, v), i) for i, v in rows if i != q and len(v) == len(x)))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


def test_largest_products(spark, mixed):
    ints = lambda v: [int(np.floor(64 * x)) for x in v]
    want = brute(mixed, lambda q: q % 20 == 0, 20, lambda a, b: int(np.dot(ints(a), ints(b))))
    for rows in (4096, 16):
        df = spark.createDataFrame(wrap(mixed), SCHEMA)
        got = topk.largest_products(df, F.col("id") % 20 == 0, block_rows=rows)
        assert {tuple(r) for r in got.collect()} == want


def test_largest_products_many_dimensions(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, list(map(float, rnd.normal(size=40) * rnd.exponential()))) for i in range(300)]
    want = brute(rows, lambda q: q % 20 == 0, 5,
                 lambda a, b: int(np.dot(np.floor(64 * np.array(a)).astype(int), np.floor(64 * np.array(b)).astype(int))))
    got = topk.largest_products(spark.createDataFrame(wrap(rows), SCHEMA), F.col("id") % 20 == 0, k=5, block_rows=100)
    assert {tuple(r) for r in got.collect()} == want


def test_large_components_stay_exact(spark):
    rows = [(0, [3e7, 1.0]), (1, [3e7, 1.0 / 64]), (2, [3e7, 2.0 / 64]), (3, [-1.0, 0.0])]
    got = topk.largest_products(spark.createDataFrame(wrap(rows), SCHEMA), F.col("id") == 0, k=3)
    big = 64 * 30_000_000
    assert [(r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [
        (2, big * big + 128), (1, big * big + 64), (3, -64 * big)]


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))


def test_nearest_with_all_candidates(spark, mixed):
    want = brute(mixed, lambda q: q % 50 == 0, 5, cosine, zero=False)
    got = ann.nearest(spark.createDataFrame(wrap(mixed), SCHEMA), F.col("id") % 50 == 0, n_pivots=8, depth=3, recall=1.0)
    assert {(r.query_id, r.rank, r.vec_id) for r in got.collect()} == {w[:3] for w in want}


def test_recall_on_the_given_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in df.collect()]
    want = brute(rows, lambda q: q % 50 == 0, 5, cosine, zero=False)
    got = ann.nearest(df, F.col("id") % 50 == 0)
    found = {(r.query_id, r.vec_id): r.score for r in got.collect()}
    exact = {(q, i): s for q, _, i, s in want}
    assert len(found.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(abs(found[x] - exact[x]) < 1e-12 for x in found.keys() & exact.keys())


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.largest_products(empty, F.col("id") % 20 == 0).count() == 0
    assert ann.nearest(empty, F.col("id") % 50 == 0).count() == 0


def test_recall_beside_a_group_of_near_copies(spark):
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(6000, 64))
    x[::3] = rnd.normal(size=64) + 0.05 * rnd.normal(size=(2000, 64))
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"),
                      F.col("id") % 50 == 0, block_rows=2048)
    found = {(r.query_id, r.vec_id) for r in got.collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = {True: [], False: []}
    for q in range(0, 6000, 50):
        score = unit @ unit[q]
        score[q] = -9
        hits[q % 3 == 0].append(np.mean([(q, int(i)) in found for i in np.argsort(-score)[:5]]))
    print("ann", {k: float(np.mean(v)) for k, v in hits.items()})
    assert all(np.mean(v) >= 0.9 for v in hits.values())


@pytest.mark.parametrize("dim", [64, 256, 768])
@pytest.mark.parametrize("clusters", [None, 300, 20])
def test_the_learned_cut_keeps_the_recall(dim, clusters):
    rnd = np.random.default_rng(dim)
    x = rnd.normal(size=(8000, dim))
    if clusters:
        x = rnd.normal(size=(clusters, dim))[rnd.integers(0, clusters, 8000)] + 0.3 * x
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pivots = ann.distant(unit[:4096], 512)
    cut = ann.learned_cut(unit[:4096], pivots, 64, 5, 0.97)
    order = ann.nearest_pivots(unit, pivots, 64)
    asked = np.arange(4200, 8000, 95)
    cosine = unit[asked] @ unit.T
    cosine[np.arange(len(asked)), asked] = -9
    within = ann.footrules(order[asked], order, len(pivots), 64) <= cut
    recall = np.take_along_axis(within, np.argsort(-cosine, 1)[:, :5], 1).mean()
    print("ann", dim, clusters, recall, within.mean())
    assert recall >= 0.9
    assert within.mean() < (0.2 if clusters else 1.0)


@pytest.mark.parametrize("run", [topk.largest_products, ann.nearest])
def test_no_side_of_the_meetings_is_broadcast(spark, run):
    """Query blocks are few bytes on disk, but there is a copy of each for every index block."""
    rnd = np.random.default_rng(8)
    rows = [(i, list(map(float, rnd.normal(size=4)))) for i in range(400)]
    got = run(spark.createDataFrame(wrap(rows), SCHEMA), F.col("id") % 20 == 0, k=3, block_rows=50)
    assert got.count() == 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("decay", [1.0, 0.9])
def test_largest_products_that_drop_rows_early(spark, decay):
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(1500, 48)) * decay ** np.arange(48)
    x[700:760] = x[700]  # ties at the k-th place
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    v = np.floor(64 * np.array([r[1] for r in rows]))
    got = topk.largest_products(spark.createDataFrame(wrap(rows), SCHEMA), F.col("id") % 20 == 0, k=7, block_rows=500)
    want = set()
    for q in range(0, 1500, 20):
        s = v @ v[q]
        s[q] = -np.inf
        want |= {(q, r + 1, int(i), int(s[i])) for r, i in enumerate(np.lexsort((np.arange(1500), -s))[:7])}
    assert {tuple(r) for r in got.collect()} == want
