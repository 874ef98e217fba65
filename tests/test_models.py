"""Fitted models against plain numpy, and the properties the method promises."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitelattice.operators import imputation as IM
from sitelattice.operators import neighbours as NB
from sitelattice.operators import newton as N
from sitelattice.operators import patternblend as PB
from sitelattice.operators import fused as FU
from sitelattice.operators import patternmodels as PM
from sitelattice.operators import patterns as PT
from sitelattice.operators import sitemodels as SM
from sitelattice.session import materialise

XS = ["x0", "x1", "x2", "x3"]


def newton_fit(z, y, c=1.0):
    full = np.column_stack([z, np.ones(len(z))])
    t = np.zeros(full.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ t))
        g = c * full.T @ (y - p)
        g[:-1] -= t[:-1]
        h = c * (full * (p * (1 - p))[:, None]).T @ full
        h[np.arange(len(t) - 1), np.arange(len(t) - 1)] += 1
        t = t + np.linalg.solve(h, g)
    return t


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 900
    x = rng.normal(size=(n, 4))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 3])))).astype(int)
    site = np.where(np.arange(n) % 3 == 0, "a", np.where(np.arange(n) % 3 == 1, "b", "c"))
    x[rng.random((n, 4)) < np.array([0.25, 0.25, 0.25, 0.0])] = np.nan
    x[site == "c", 1] = np.nan
    p = pd.DataFrame(x, columns=XS).assign(y=y, site=site, row_id=[f"r{i:04d}" for i in range(n)])
    return p


@pytest.fixture(scope="module")
def df(spark, frame):
    d = spark.createDataFrame(frame.astype(object).where(frame.notna(), None),
                              "x0 double, x1 double, x2 double, x3 double, y int, site string, row_id string")
    return d.repartition(5).cache()


@pytest.fixture(scope="module")
def patterns(df):
    real = materialise(PT.pattern_counts(df, XS, {"pos": F.col("y")}))
    fit = materialise(PT.with_support(real, 4).where("support >= 30 AND size > 0"))
    return real, fit, materialise(PT.immediate_ancestors(fit, 4))


def test_site_models_equal_numpy(df, frame):
    model, coef = SM.fit_sites(df, "site", "y", XS)
    c, m = coef.toPandas(), model.toPandas().set_index("site")
    assert set(c[c["site"] == "c"]["var"]) == {0, 2, 3}  # x1 is not in that site's schema
    for s, part in frame.groupby("site"):
        cols = [x for j, x in enumerate(XS) if part[x].notna().mean() >= 0.5]
        a = part[cols].to_numpy()
        mu = np.nanmean(a, 0)
        a = np.where(np.isnan(a), mu, a)
        sd = a.std(0)
        t = newton_fit((a - mu) / sd, part["y"].to_numpy())
        got = c[c["site"] == s].sort_values("var")
        assert np.allclose(got["coef"], t[:-1], atol=1e-7)
        raw_b = t[-1] - (t[:-1] / sd) @ mu
        assert m.loc[s, "raw_b"] == pytest.approx(raw_b, abs=1e-7)
        p = 1 / (1 + np.exp(-(raw_b + a @ (t[:-1] / sd))))
        assert np.allclose(got["info"], (p * (1 - p)) @ (a * a), rtol=1e-6)


def test_batched_state_gives_the_same_models(df, monkeypatch):
    want = SM.fit_sites(df, "site", "y", XS)[1].toPandas().sort_values(["site", "var"])["coef"].to_numpy()
    monkeypatch.setattr(N, "STATE_BYTES", 1)
    got = SM.fit_sites(df, "site", "y", XS)[1].toPandas().sort_values(["site", "var"])["coef"].to_numpy()
    assert np.allclose(got, want, atol=1e-9)


def test_federated_round_equals_numpy(df, frame):
    _, snaps = SM.fedavg(df, "site", "y", XS, 2, (2,), local_epochs=3)
    w = np.zeros(5)
    for _ in range(2):
        acc, tot = np.zeros(5), 0
        for _, part in frame.groupby("site"):
            ix = [j for j, x in enumerate(XS) if part[x].notna().mean() >= 0.5]
            a = part[[XS[j] for j in ix]].to_numpy()
            mu = np.nanmean(a, 0)
            a = np.where(np.isnan(a), mu, a)
            z = (a - mu) / a.std(0)
            idx = np.r_[ix, 4]
            wl = w[idx].copy()
            for _ in range(3):
                r = 1 / (1 + np.exp(-(z @ wl[:-1] + wl[-1]))) - part["y"].to_numpy()
                wl -= np.r_[z.T @ r / len(z), r.mean()]
            up = w.copy()
            up[idx] = wl
            acc += len(z) * up
            tot += len(z)
        w = acc / tot
    assert np.allclose(snaps[2], w, atol=1e-9)


def test_federated_rounds_pass_over_empty_tasks(df):
    _, few = SM.fedavg(df, "site", "y", XS, rounds=1, checkpoints=(1,), local_epochs=1)
    _, many = SM.fedavg(df.repartition(1200), "site", "y", XS, rounds=1, checkpoints=(1,), local_epochs=1)
    assert np.allclose(few[1], many[1])


def test_private_fedavg_runs_all_rounds(spark, small, monkeypatch):
    from sitelattice.suite import models

    class Asked(Exception):
        pass

    def fedavg_budgets(df, key, y, xs, rounds, budgets, checkpoints, **__):
        raise Asked(rounds, checkpoints)
    monkeypatch.setattr(SM, "fedavg_budgets", fedavg_budgets)
    with pytest.raises(Asked) as asked:
        models.private_fedavg(spark, small)
    assert asked.value.args == (30, (30,))


def test_federated_budgets_share_their_scans(df, monkeypatch):
    """Rows are packed once, a null site's rows in no block, and an epoch of all budgets is one scan."""
    holes = df.withColumn("site", F.when(F.rand(1) < 0.9, F.col("site")))
    told = dict(rounds=2, checkpoints=(1, 2), local_epochs=2, lr=0.5, unit=True)
    alone = [SM.fedavg(holes, "site", "y", XS, eps=eps, **told)[1] for eps in (None, 1.0, float("inf"))]
    scans = []
    scan = SM._site_gradients
    monkeypatch.setattr(SM, "_site_gradients", lambda blocks, *a: scans.append(blocks.columns) or scan(blocks, *a))
    _, both = SM.fedavg_budgets(holes, "site", "y", XS, budgets=[None, 1.0, float("inf")], **told)
    assert scans == [["k", "z", "y"]] * 4
    assert all(np.allclose(both[b][r], alone[b][r]) for b in range(3) for r in (1, 2))
    assert not np.allclose(both[0][2], both[1][2]) and np.allclose(both[0][2], both[2][2])


def test_gradients_of_pairs_pass_over_empty_tasks(df):
    from sitelattice.plans.combiners import pair_gradients
    one = np.ones((3, 4), bool)
    design = N.Design(["a", "b", "c"], np.zeros((3, 4)), one, np.zeros((3, 4)), np.ones((3, 4)), one, np.ones(3))
    few = pair_gradients(df, "site", "y", XS, design, np.zeros((3, 5)))
    many = pair_gradients(df.repartition(1200), "site", "y", XS, design, np.zeros((3, 5)))
    assert np.allclose(few[0], many[0]) and np.allclose(many[1], 300)


def test_mask_interactions_equal_numpy(df, frame):
    x = frame[XS].to_numpy(float)
    mu, obs = np.nanmean(x, axis=0), (~np.isnan(x)).astype(float)
    a = np.where(obs > 0, x, mu)
    z = np.hstack([a, obs, np.einsum("ni,nj->nij", obs, a).reshape(len(x), -1)])
    want = newton_fit(z, frame["y"].to_numpy(), 1e-2)
    score = IM.mask_interaction_logistic(df, "y", XS, 1e-2)
    assert np.allclose(np.r_[score.weights, score.bias], want, atol=1e-6)
    got = score(df).select("row_id", "p").toPandas().set_index("row_id")["p"][frame["row_id"]].to_numpy()
    assert np.allclose(got, 1 / (1 + np.exp(-(z @ want[:-1] + want[-1]))), atol=1e-6)


def test_ancestors_are_immediate(patterns):
    _, fit, edges = patterns
    key = lambda d: sorted(map(tuple, d.select("child", "parent").collect()))
    sets = {r["pattern"]: frozenset(r["vars"]) for r in fit.collect()}
    want = []
    for e, se in sets.items():
        inside = [a for a, sa in sets.items() if sa < se]
        want += [(e, a) for a in inside if not any(sets[a] < sets[b] for b in inside)]
    assert key(edges) == sorted(want)


def test_submodels_equal_numpy(df, frame, patterns):
    real, fit, _ = patterns
    mu, sd = PM.observed_scaler(df, XS)
    theta = PM.fit_submodels(df, XS, "y", real, fit, mu, sd).toPandas()
    x = frame[XS].to_numpy()
    for r in fit.collect():
        cols = list(r["vars"])
        rows = ~np.isnan(x[:, cols]).any(1)
        assert rows.sum() == r["support"]
        t = newton_fit(((x - mu) / sd)[np.ix_(rows, cols)], frame["y"].to_numpy()[rows])
        got = theta[theta["pattern"] == r["pattern"]].set_index("var")["value"]
        assert np.allclose([got[v] for v in [*cols, -1]], t, atol=1e-6)


@pytest.mark.parametrize("coordinatewise", [False, True])
def test_shrinkage_by_hand(df, patterns, coordinatewise):
    real, fit, edges = patterns
    mu, sd = PM.observed_scaler(df, XS)
    theta = materialise(PM.fit_submodels(df, XS, "y", real, fit, mu, sd))
    got = {(r["pattern"], r["var"]): r["value"]
           for r in PM.shrink(theta, fit, edges, [60.0], coordinatewise).collect()}
    own: dict = {}
    for r in theta.collect():
        own.setdefault(r["pattern"], {})[r["var"]] = r["value"]
    meta = {r["pattern"]: r for r in fit.collect()}
    up: dict = {}
    for r in edges.collect():
        up.setdefault(r["child"], []).append(r["parent"])
    done: dict = {}
    for e in sorted(own, key=lambda p: meta[p]["size"]):
        ps, n = up.get(e, []), meta[e]["support"]
        have = {k: [p for p in ps if k in done[p]] for k in own[e]}
        mass = {k: sum(meta[p]["support"] for p in v) for k, v in have.items() if k >= 0 and v}
        bar = np.mean(list(mass.values())) if mass else 0
        out = {}
        for k, v in own[e].items():
            if not have[k]:
                out[k] = v
                continue
            w = [meta[p]["support"] for p in have[k]]
            target = sum(a * done[p][k] for a, p in zip(w, have[k])) / sum(w)
            kap = 60.0 * mass[k] / bar if coordinatewise and k in mass else 60.0
            out[k] = n / (n + kap) * v + kap / (n + kap) * target
        done[e] = out
    for e, vals in done.items():
        for k, v in vals.items():
            assert got[(e, k)] == pytest.approx(v, abs=1e-9)


def test_rooted_corner_equals_root(df, patterns):
    real, fit, edges = patterns
    _, score = SM.pooled_fit(df, "y", XS, indicators=False)
    theta = materialise(PM.fit_submodels(df, XS, "y", real, fit, score.mu, score.sd))
    root = {-1: score.std_bias, **{j: float(w) for j, w in enumerate(score.std_weights)}}
    th = PM.shrink_rooted(theta, fit, edges, root, [float("inf"), 0.0])
    p = PM.predict_at(df, XS, th, fit, [float("inf"), 0.0], ["row_id"], prior=0.5, mu=score.mu, sd=score.sd,
                      root=root, fill=score.fill)
    j = p.join(score(df).select("row_id", F.col("p").alias("q")), "row_id").groupBy("kappa").agg(
        F.max(F.abs(F.col("p") - F.col("q"))).alias("gap")).collect()
    gap = {r["kappa"]: r["gap"] for r in j}
    assert gap[float("inf")] < 1e-9 < gap[0.0]


def test_fused_limits(df, patterns):
    """Heavy fusion makes neighbours agree on shared coordinates; none leaves them apart."""
    real, fit, edges = patterns
    mu, sd = PM.observed_scaler(df, XS)
    assigned = PT.most_specific(fit, real, 4)
    gap = {}
    for lam in (0.0, 200.0):
        t = FU.fit_fused(df, XS, "y", PM.pattern_key(XS), assigned, fit, edges, mu, sd, lam=lam)
        gap[lam] = PM.ancestor_discrepancy(t, edges, fit).agg(F.max("mean_abs_diff")).first()[0]
        assert t.where("NOT converged").count() == 0
    assert 10 * gap[200.0] < gap[0.0]


def test_blend_oracle_never_below_pooled(df):
    from sitelattice.operators.metrics import score_metrics
    d = df.withColumn("g", PM.pattern_key(["x0"]))
    d = d.withColumn("g", F.concat(F.lit("p"), "g"))
    tr, te = d.where("row_id < 'r0600'"), d.where("row_id >= 'r0600'")
    scored = materialise(PB.fit_blend(tr, te, "g", "y", XS, ["row_id"])[0])
    ap = lambda x: score_metrics(x, []).first()["auprc"]
    assert ap(PB.blend_oracle(scored, "g", "y", passes=1)) >= ap(PB.arm(scored, "pooled")) - 1e-12


def test_neighbours_do_not_depend_on_blocks(df):
    a = NB.knn_impute(df, XS, "row_id", 5).orderBy("row_id").select(*XS).toPandas().to_numpy()
    b = NB.knn_impute(df, XS, "row_id", 5, block=150).orderBy("row_id").select(*XS).toPandas().to_numpy()
    assert np.allclose(a, b) and not np.isnan(a).any()


def test_residual_mask_equals_numpy(df, frame):
    got = IM.residual_mask(df, XS).orderBy("row_id").select(*[f"r{j}" for j in range(4)]).toPandas().to_numpy()
    x = frame[XS].to_numpy()
    m = (~np.isnan(x)).astype(float)
    a = np.where(np.isnan(x), np.nanmean(x, 0), x)
    z = (a - a.mean(0)) / a.std(0)
    want = m.copy()
    for j in range(4):
        if m[:, j].std() < 1e-12:
            want[:, j] = 0
            continue
        o = [i for i in range(4) if i != j]
        g = z[:, o].T @ z[:, o] + 1e-3 * len(z) * np.eye(3)
        want[:, j] = m[:, j] - z[:, o] @ np.linalg.solve(g, z[:, o].T @ m[:, j])
    assert np.allclose(got, want, atol=1e-6)


def test_chained_equations_recover_a_linear_column(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(400, 2))
    x = np.column_stack([a, a @ [2.0, -1.0] + 3])
    hole = x.copy()
    hole[::4, 2] = np.nan
    p = pd.DataFrame(hole, columns=["x0", "x1", "x2"])
    d = spark.createDataFrame(p.astype(object).where(p.notna(), None), "x0 double, x1 double, x2 double")
    fill = IM.chained_equations(d, ["x0", "x1", "x2"], sweeps=3, ridge=1e-9)
    assert np.allclose(fill(hole)[::4, 2], x[::4, 2], atol=1e-3)


def test_containment_in_slices(spark):
    """A variable that all patterns hold is dealt over slices; the pairs are those of brute force."""
    rnd = np.random.default_rng(5)
    sets = {frozenset([0, *np.flatnonzero(rnd.random(9) < 0.6)]) for _ in range(150)} | {frozenset(), frozenset([3]), frozenset([3, 4])}
    rows = [(sum(1 << int(j) for j in s), 1) for s in sets]
    given = PT.describe(spark.createDataFrame(rows, "w0 long, n long"), 9).persist()
    key = lambda s: ",".join(map(str, sorted(s)))
    for strict in (False, True):
        want = sorted((key(a), key(b)) for a in sets for b in sets if a < b or (a == b and not strict))
        for size in (7, 20_000):
            got = PT.containment(given, given, 9, strict, size).select("e.pattern", F.col("o.pattern").alias("large"), "e.__slice")
            assert sorted(tuple(r)[:2] for r in got.collect()) == want
            assert (got.select("__slice").distinct().count() > 5) == (size == 7)


def test_blend_groups_without_a_model_stay_pooled_and_rows_stay_in_place(df):
    d = df.withColumn("g", F.when(F.col("row_id") < "r0020", F.lit("few")).otherwise(F.lit("many")))
    scored, _ = PB.fit_blend(d, d, "g", "y", XS, ["row_id"])
    assert "Aggregate" not in scored._jdf.queryExecution().optimizedPlan().toString()
    got = {r["g"]: r for r in scored.groupBy("g").agg(F.count("z_local").alias("l"), F.count("z_pool").alias("p"), F.count("lam").alias("w")).collect()}
    assert got["few"]["l"] == 0 and got["few"]["w"] == 0 and got["few"]["p"] > 0
    assert got["many"]["l"] == got["many"]["p"] == got["many"]["w"] > 0


def test_chained_equations_read_the_rows_twice(df, frame, monkeypatch):
    """Column statistics and pattern moments read the rows; a sweep reads the patterns."""
    seen = []
    real = IM.summed_rows
    monkeypatch.setattr(IM, "summed_rows", lambda rows, *a: seen.append(rows.count()) or real(rows, *a))
    out = IM.chained_equations(df, XS, sweeps=2)(frame[XS].to_numpy())
    assert len(seen) == 2 and max(seen) <= 2 ** len(XS) and not np.isnan(out).any()
