"""Sliced ordering against plain windows, with one group holding most rows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitelattice.functions.hashing import digest
from sitelattice.operators import metrics as ME
from sitelattice.operators import ordered as O
from sitelattice.operators import ranktests as RT
from sitelattice.operators import thresholds as T


@pytest.fixture(params=[3, 29], ids=["few", "many"])
def path(request, monkeypatch):
    monkeypatch.setattr(O, "slices_for", lambda spark: request.param)


@pytest.fixture(scope="module")
def skewed(spark):
    d = spark.range(4000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 20).cast("string"))).alias("g"),
        F.round(F.abs(F.sin(F.col("id") * 1.7)), 3).alias("v"), (F.pmod(F.xxhash64("id"), F.lit(5)) < 2).cast("int").alias("y"),
        F.concat(F.lit("s"), (F.col("id") % 6).cast("string")).alias("site"))
    return d.withColumn("g", F.when(F.col("id") % 50 == 1, None).otherwise(F.col("g"))).cache()


def test_hash_row_number_equals_window(skewed):
    got = O.hash_row_number(skewed, ["g"], ["id"], "s", digits=2)
    w = Window.partitionBy("g").orderBy(digest("s", "id"), "id")
    want = skewed.withColumn("rn", F.row_number().over(w)).withColumn(
        "group_n", F.count(F.lit(1)).over(Window.partitionBy("g")))
    key = lambda df: sorted(map(tuple, df.select("id", "rn", "group_n").collect()))
    assert key(got) == key(want)


@pytest.mark.parametrize("groups", [["g"], []])
def test_running_sums_equal_window(skewed, path, groups):
    got = O.running_by_value(skewed, groups, "v", {"n": F.lit(1), "y": F.col("y")})
    p = skewed.toPandas()
    p["g"] = p["g"].astype(object).where(p["g"].notna(), None)
    want = {}
    for k, part in ([(None, p)] if not groups else p.groupby("g", dropna=False)):
        k = k if isinstance(k, str) else None
        a = part.groupby("v")["y"].agg(["count", "sum"]).sort_index()
        for v, c, s, cb, sb in zip(a.index, a["count"], a["sum"], a["count"].cumsum() - a["count"], a["sum"].cumsum() - a["sum"]):
            want[(k, v)] = (c, s, cb, sb, a["count"].sum(), a["sum"].sum())
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r["n"], r["y"], r["n_before"], r["y_before"], r["n_total"], r["y_total"]) == want[
            (r["g"] if groups else None, r["v"])]


def test_quantiles_equal_numpy(skewed, path):
    probs = T.linspace(0.05, 0.95, 19)
    got = {(r["g"], r["k"]): r["q"] for r in O.quantiles(skewed, ["g"], "v", probs).collect()}
    p = skewed.toPandas()
    for g, part in p.groupby("g", dropna=False):
        g = g if isinstance(g, str) else None
        for k, q in enumerate(np.quantile(part["v"], probs)):
            assert got[(g, k)] == pytest.approx(q, abs=1e-12)


def test_auroc_and_precision(skewed, path):
    got = {r["g"]: r for r in ME.score_metrics(skewed, ["g"], "y", "v").collect()}
    for g, part in skewed.toPandas().groupby("g"):
        y, v = part["y"].to_numpy(), np.clip(part["v"].to_numpy(), 1e-6, 1 - 1e-6)
        pos, neg = v[y == 1], v[y == 0]
        auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
        assert got[g]["auroc"] == pytest.approx(auc, abs=1e-12)
        ap = sum(np.mean(y[v >= t]) for t in pos) / len(pos)
        assert got[g]["auprc"] == pytest.approx(ap, abs=1e-12)


def test_one_class_has_no_discrimination(spark):
    d = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y int, p double")
    r = ME.score_metrics(d, []).first()
    assert r["auroc"] is None and r["auprc"] is None and r["prevalence"] == 1.0


def test_missing_scores_count_nowhere_and_one_range_may_hold_all(spark):
    rows = [("a", i % 2, 0.3 + i * 1e-9) for i in range(50)] + [("a", 1, None), ("b", 1, None), (None, 0, 0.1), (None, 1, 0.9), (None, 1, 0.1)]
    d = spark.createDataFrame(rows, "g string, y int, p double")
    got = {r["g"]: r for r in ME.score_metrics(d, ["g"]).collect()}
    assert set(got) == {"a", None} and got["a"]["n"] == 50 and got["a"]["n_positive"] == 25
    assert got["a"]["auroc"] == pytest.approx(325 / 625) and got[None]["auroc"] == pytest.approx(0.75)


def test_metrics_write_nothing(skewed, monkeypatch):
    """One exchange of the scores and no table between."""
    monkeypatch.setattr(O, "materialise", None)
    monkeypatch.setattr(ME, "materialise", None)
    assert ME.score_metrics(skewed, ["g"], "y", "v").count() > 0


def test_held_out_site_rules(skewed, path):
    """Against direct fitting on the other sites' rows."""
    d = skewed.withColumn("f", F.lit("v"))
    probs = T.linspace(0.05, 0.95, 19)
    got = T.loso_accuracy(d, "f", "site", "v", "y", probs).first()
    p = skewed.toPandas()
    hits = 0
    for s in p["site"].unique():
        tr, te = p[p["site"] != s], p[p["site"] == s]
        best, rule = -1, None
        for t in np.quantile(tr["v"], probs):
            for sign in (1, -1):
                pred = (tr["v"] < t) if sign > 0 else (tr["v"] >= t)
                acc = (pred == (tr["y"] == 1)).mean()
                if acc > best + 1e-15:
                    best, rule = acc, (t, sign)
        pred = (te["v"] < rule[0]) if rule[1] > 0 else (te["v"] >= rule[0])
        hits += (pred == (te["y"] == 1)).sum()
    assert got["n_scored"] == len(p)
    assert got["loso_acc"] == pytest.approx(hits / len(p), abs=1e-12)


def test_rules_order_the_cells_once(spark, monkeypatch):
    """Against pandas, with ties, nulls and many blocks; the tables written hold the benefits and the cells once."""
    rnd = np.random.default_rng(5)
    n = 6000
    a, b = np.round(rnd.normal(size=n), 4), rnd.integers(0, 3, n).astype(float)
    gain = np.round(0.3 * a + rnd.normal(size=n), 2)
    rows = [(f"s{i % 4}", float(a[i]), None if i % 9 == 0 else float(b[i]), None if i % 50 == 0 else float(gain[i]),
             int(gain[i] > 0)) for i in range(n)]
    d = spark.createDataFrame(rows, "site string, a double, b double, benefit double, helped int")
    written, plain = [], O.materialise

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    for m in (O, T, RT):
        monkeypatch.setattr(m, "materialise", counted)
    got = {r["feature"]: r for r in T.evaluate_rules(d, ["a", "b"]).collect()}
    p = d.toPandas()
    for f in "ab":
        q = p.dropna(subset=[f, "benefit"])
        assert got[f]["rho"] == pytest.approx(q[f].rank().corr(q["benefit"].rank()), abs=1e-12)
        q, hits = p.dropna(subset=[f]), 0
        for s in q["site"].unique():
            tr, te = q[q["site"] != s], q[q["site"] == s]
            rules = [(t, sign) for t in np.quantile(tr[f], T.linspace(0.05, 0.95, 19)) for sign in (True, False)]
            t, sign = max(rules, key=lambda r: (((tr[f] < r[0]) == r[1]) == (tr["helped"] == 1)).sum())
            hits += (((te[f] < t) == sign) == (te["helped"] == 1)).sum()
        assert got[f]["loso_acc"] == pytest.approx(hits / len(q), abs=1e-12)
    cells = sum(len(p.dropna(subset=[f])[["site", f]].drop_duplicates()) for f in "ab")
    assert sum(written) <= cells + 2 * p["benefit"].nunique() + 1500


def test_quadratic_of_close_fractions(spark):
    """Pools whose harm fractions differ by thousandths: the curve is the exact one."""
    hits = [3590 + 2 * i for i in range(12)]
    n = spark.createDataFrame([(f"p{i}", h) for i, h in enumerate(hits)], "pool string, h int")
    d = n.select("pool", F.inline(F.transform(F.sequence(F.lit(1), F.lit(10_000)), lambda k: F.struct(
        F.when(k <= F.col("h"), 2000).otherwise(10).alias("n_target")))))
    f = np.array(hits) / 10_000
    lift = -40 * (f - 0.3605) ** 2 + 0.01
    law = spark.createDataFrame([(f"p{i}", float(v)) for i, v in enumerate(lift)], "pool string, lift double")
    r = T.quadratic_sweep(d, law, "pool", [1000.0]).first()
    assert r["curvature"] == pytest.approx(-40, abs=1e-6) and r["peak"] == pytest.approx(0.3605, abs=1e-8)
    assert r["r2"] == pytest.approx(1.0, abs=1e-8)


def test_first_by_hash_equals_row_numbers_and_moves_no_rows(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"))
    rows = rows.unionByName(spark.createDataFrame([("one", 9)], "id string, g long"))  # round(0.3) rows: none
    want = O.hash_row_number(rows, ["g"], ["id"], "s").where(F.col("rn") <= F.round(F.col("group_n") * 0.3)).select("id")
    got = O.first_by_hash(rows, ["g"], ["id"], "s", 0.3, "first")
    assert got.count() == 5001 and got.columns == ["id", "g", "first"]
    assert sorted(r[0] for r in got.where("first").collect()) == sorted(r[0] for r in want.collect())
    whole = O.first_by_hash(rows, [], ["id"], "s", 0.35, "first")
    assert whole.where("first").count() == 1750
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
