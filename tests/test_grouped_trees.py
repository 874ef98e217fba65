"""Grouped boosting against plain boosting of each group by trying every split."""

import numpy as np
import pandas as pd
import pytest

from sitelattice.operators import grouped_trees as GT

XS = ["a", "b", "c"]


def plain(x, y, trees, leaves, rate, l2, min_leaf):
    """Raw scores of the rows themselves after ``trees`` trees, grown level by level."""
    eta = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-eta))
        g, h = p - y, p * (1 - p)
        leaf = {0: np.arange(len(y))}
        value, open_, next_ = {0: 0.0}, [0], 1
        while open_:
            found = []
            for n in open_:
                at, best = leaf[n], None
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
                for left in (False, True):
                    for f in range(x.shape[1]):
                        v = x[at, f]
                        for cut in [*np.unique(v[~np.isnan(v)])]:
                            low = np.where(np.isnan(v), left, v <= cut)
                            lo, hi = at[low], at[~low]
                            if min(len(lo), len(hi)) < min_leaf:
                                continue
                            gain = score(lo) + score(hi) - score(at)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, n, lo, hi)
                if best:
                    found.append(best)
            chosen = sorted(sorted(found, key=lambda b: (-b[0], b[1]))[:leaves - len(leaf)], key=lambda b: b[1])
            open_ = []
            for _, n, lo, hi in chosen:
                del leaf[n]
                for rows in (lo, hi):
                    leaf[next_], value[next_] = rows, -rate * g[rows].sum() / (h[rows].sum() + l2)
                    open_.append(next_)
                    next_ += 1
            if len(leaf) == leaves:
                break
        for n, rows in leaf.items():
            eta[rows] += value[n]
    return eta


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(3)
    n = 900
    x = rnd.integers(0, 9, (n, 3)).astype(float)
    x[rnd.random((n, 3)) < 0.25] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=7) + 2 * np.isnan(x[:, 1]) + rnd.normal(size=n) * 2 > 5).astype(int)
    pdf = pd.DataFrame(x, columns=XS).assign(y=y, site=rnd.choice(["p", "q", "r"], n, p=[0.6, 0.3, 0.1]), id=np.arange(n))
    return pdf


def frame(spark, pdf):
    given = [(int(r.id), r.site, int(r.y), *[None if np.isnan(v) else float(v) for v in (r.a, r.b, r.c)]) for r in pdf.itertuples()]
    return spark.createDataFrame(given, "id long, site string, y int, a double, b double, c double").repartition(4)


def test_equals_plain_boosting(spark, rows):
    edges = [list(map(float, range(8)))] * 3
    model = GT.fit_grouped(frame(spark, rows), "site", "y", XS, ["id"], iterations=12, leaves=6, share=0.0, min_leaf=10, edges=edges)
    got = GT.score_grouped(frame(spark, rows), "site", model).toPandas().set_index("id").sort_index()
    expit = lambda e: 1 / (1 + np.exp(-e))
    pooled = expit(plain(rows[XS].to_numpy(), rows["y"].to_numpy(), 12, 6, 0.1, 1.0, 10))
    assert np.allclose(got["p_pooled"], pooled, atol=1e-9)
    for site in "pqr":
        at = (rows["site"] == site).to_numpy()
        own = expit(plain(rows.loc[at, XS].to_numpy(), rows.loc[at, "y"].to_numpy(), 12, 6, 0.1, 1.0, 10))
        assert np.allclose(got.loc[at, "p_local"], own, atol=1e-9)
    assert got["p_ensemble"].between(0, 1).all()


def test_early_stopping_and_odd_groups(spark, rows):
    noise = rows.assign(y=np.random.default_rng(1).integers(0, 2, len(rows)))
    noise.loc[noise["site"] == "r", "y"] = 1
    noise.loc[noise.index[:5], "site"] = None
    model = GT.fit_grouped(frame(spark, noise), "site", "y", XS, ["id"], iterations=40, leaves=4)
    assert model.stopped.all() and 0 < len(model.trees[GT.POOLED]) < 40
    s = GT.score_grouped(frame(spark, noise), "site", model).toPandas().set_index("id").sort_index()
    assert s.loc[(noise["site"] == "r").to_numpy(), "p_local"].isna().all() and s["p_pooled"].notna().all()
    assert s.loc[noise["site"].isna().to_numpy(), "p_local"].isna().all()


def test_no_rows(spark, rows):
    none = frame(spark, rows).where("id < 0")
    model = GT.fit_grouped(none, "site", "y", XS, ["id"], iterations=2)
    s = GT.score_grouped(frame(spark, rows), "site", model).select("p_local", "p_ensemble", "p_pooled").first()
    assert tuple(s) == (None, None, None)


def test_finished_trees_are_applied_once():
    """A level gets the growing trees only; the scores of finished ones come with the blocks."""
    import inspect
    assert "recent" not in inspect.signature(GT._best_splits).parameters
    assert "recent" not in inspect.signature(GT._refreshed).parameters


def test_rows_of_leaves():
    rng = np.random.default_rng(0)
    bins = rng.integers(0, 6, (400, 2)).astype(np.uint8)
    bins[rng.random((400, 2)) < 0.2] = GT.MISSING
    t = GT.Tree()
    a, b = t.split(0, 0, 2, True, (0.1, 0.2))
    c, d = t.split(b, 1, 3, False, (0.3, 0.4))
    left = (bins[:, 0] <= 2) | (bins[:, 0] == GT.MISSING)
    low = (bins[:, 1] <= 3) & (bins[:, 1] != GT.MISSING)
    want = np.where(left, a, np.where(low, c, d))
    assert (t.nodes(bins) == want).all()
    got = t.rows(bins.T, [c])
    assert list(got) == [c] and (got[c] == np.flatnonzero(want == c)).all()
