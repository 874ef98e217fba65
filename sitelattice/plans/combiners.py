"""Combiner and privacy comparisons over merge decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.functions.scalars import clip, expit
from sitelattice.operators import merging as MG
from sitelattice.operators import newton as N
from sitelattice.operators.memberships import fit_bank, score_bank
from sitelattice.operators.metrics import calibration_line, score_metrics
from sitelattice.operators.sitemodels import model_rows, private_sites, score_std
from sitelattice.plans.decision_table import Fitted, complete, method_scores
from sitelattice.session import materialise


def pooled_by_decision(fit: Fitted, members: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(method, decision, unit, y, p): a pooled logistic on [imputed, mask] per partner set.

    Every decision's model trains on its members' rows in the same scans; imputation means
    and scales come from unit sums.
    """
    d = len(xs)
    flags = [F.col(x).isNotNull().cast("double").alias(f"__m{j}") for j, x in enumerate(xs)]
    cols = [*xs, *[f"__m{j}" for j in range(d)]]
    train = fit.train.select("unit", y, *xs, *flags)
    test = fit.test.select("unit", y, *xs, *flags)
    m = members.select("decision", "unit", "is_target").toPandas()  # decisions x partners
    models = {k: v["unit"].tolist() for k, v in m.groupby("decision")}
    targets = m[m["is_target"]].groupby("unit")["decision"].apply(list).to_dict()
    bank = fit_bank(train, "unit", y, cols, models)
    s = score_bank(test, "unit", ["unit", y], cols, bank, targets)
    return s.select(F.lit("pooled").alias("method"), F.col("model").alias("decision"), "unit", y, "p")


def fedavg_by_decision(fit: Fitted, members: DataFrame, y: str, xs: list[str], rounds: int = 5,
                       local_epochs: int = 5, lr: float = 1.0) -> DataFrame:
    """(method, decision, unit, y, p): federated averaging inside every partner set.

    Each (decision, unit) pair has its own weights; one scan per local epoch gives all
    gradients. Scored with the target's scaler.
    """
    d, spark = len(xs), members.sparkSession
    c = fit.coef.toPandas()  # units x variables
    units = sorted(c["unit"].unique())
    at = {u: i for i, u in enumerate(units)}
    mu, sd = np.zeros((len(units), d)), np.ones((len(units), d))
    act = np.zeros((len(units), d), bool)
    ui = c["unit"].map(at).to_numpy()
    mu[ui, c["var"]], sd[ui, c["var"]], act[ui, c["var"]] = c["mu"], c["sd"], True
    size = dict(fit.model.select("unit", "n").collect())
    m = members.select("decision", "unit", "is_target").toPandas()
    decisions = sorted(m["decision"].unique())
    out = None
    for part in N.batches(len(decisions), d * int(m.groupby("decision").size().max())):
        names = {decisions[i]: i - part.start for i in part}
        p = m[m["decision"].isin(names)].reset_index(drop=True)
        pu, pd_ = p["unit"].map(at).to_numpy(), p["decision"].map(names).to_numpy()
        of_unit = [np.flatnonzero(pu == u) for u in range(len(units))]
        n = p["unit"].map(size).to_numpy(float)
        glob = np.zeros((len(names), d + 1))
        free = np.column_stack([act[pu], np.ones(len(p), bool)])
        design = N.Design(units, mu, act, mu[pu], sd[pu], act[pu], np.ones(len(p)), of_unit)
        rows = fit.train.select("unit", y, *xs).persist()
        for _ in range(rounds):
            w = glob[pd_].copy()
            for _ in range(local_epochs):
                g, cnt = pair_gradients(rows, "unit", y, xs, design, w)
                w -= lr * np.where(free, g / np.maximum(cnt, 1)[:, None], 0.0)
            acc = np.zeros_like(glob)
            np.add.at(acc, pd_, n[:, None] * w)
            glob = acc / np.bincount(pd_, n, len(names))[:, None]
        rows.unpersist()
        t = p[p["is_target"]]
        recs = [(r.decision, r.unit, float(glob[names[r.decision], d]), *[
            [float(v) if a else None for v, a in zip(arr, act[at[r.unit]])]
            for arr in (glob[names[r.decision], :d], mu[at[r.unit]], sd[at[r.unit]])]) for r in t.itertuples()]
        models = spark.createDataFrame(recs, "decision string, unit string, intercept double, "
                                       "__coef array<double>, __mu array<double>, __sd array<double>")
        j = fit.test.join(models, "unit")
        s = j.select(F.lit("fedavg5").alias("method"), "decision", "unit", y, score_std(j, xs, F.col("intercept")).alias("p"))
        out = s if out is None else out.unionByName(s)
    return out


def pair_gradients(df: DataFrame, key: str, y: str, xs: list[str], design: N.Design, w: np.ndarray):
    """Summed gradient and row count of every model at its own weights, in one scan."""
    d = len(xs)
    shared = df.sparkSession.sparkContext.broadcast((design, w))

    def scan(batches):
        design, w = shared.value
        index = {k: i for i, k in enumerate(design.keys)}
        acc = np.zeros((len(w), d + 2))
        for pdf in batches:
            x, yy = pdf[xs].to_numpy(dtype=float), pdf[y].to_numpy(dtype=float)
            for name, at in pdf.groupby(key).indices.items():
                k = index.get(name)
                for m in (design.members[k] if k is not None else ()):
                    cols, _, z = N._rows_of(design, k, m, x[at])
                    r = 1 / (1 + np.exp(-np.clip(z @ w[m, cols] + w[m, d], -35, 35))) - yy[at]
                    acc[m, cols] += r @ z
                    acc[m, d] += r.sum()
                    acc[m, d + 1] += len(at)
        hit = np.flatnonzero(acc[:, d + 1])
        if hit.size:  # a task without rows has no sums to send
            yield pd.DataFrame({"m": hit, "vec": list(acc[hit])})

    got = df.select(key, y, *xs).mapInPandas(scan, "m int, vec array<double>").groupBy("m").agg(
        vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec")).toPandas()
    out = np.zeros((len(w), d + 2))
    for m, v in zip(got["m"], got["vec"]):
        out[m] = v
    return out[:, :d + 1], out[:, d + 1]


def combiner_gains(fit: Fitted, members: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(decision, epv_target, lr_merge, lr_ensemble, lr_pooled, lr_fedavg5): gains over local."""
    members = materialise(complete(members, fit))
    s = method_scores(fit, members, y, xs).unionByName(pooled_by_decision(fit, members, y, xs)).unionByName(
        fedavg_by_decision(fit, members, y, xs))
    m = score_metrics(materialise(s), ["method", "decision"], y)  # read twice
    at = lambda name: F.max(F.when(F.col("method") == name, F.col("auprc")))
    wide = m.groupBy("decision").agg(*[at(n).alias(n) for n in ("local", "merge", "ensemble", "pooled", "fedavg5")])
    epv = members.where("is_target").select(
        "decision", (F.col("minority") / F.greatest("d_schema", F.lit(1))).alias("epv_target"))
    return wide.join(epv, "decision").where("local IS NOT NULL").select(
        "decision", "epv_target", *[(F.col(n) - F.col("local")).alias(f"lr_{n}") for n in ("merge", "ensemble", "pooled", "fedavg5")])


ARMS = ["rows", "rows_squared", "uniform", "own_half", "own_epv"]


def privacy_sweep(fit: Fitted, members: DataFrame, y: str, xs: list[str], budgets: list[float],
                  seed: str = "dp") -> DataFrame:
    """(eps, arm, decision, auprc, brier, slope) of private merges and of the private local model.

    Budget and weighting are columns, so all cells come from one merge and one scoring job.
    """
    d = len(xs)
    members = materialise(complete(members, fit))
    model, coef = private_sites(fit.train, "unit", y, xs, budgets, seed)
    size = members.groupBy("decision").agg(F.count(F.lit(1)).alias("k"))
    mem = members.join(size, "decision").select(
        "decision", "unit", "is_target", "k",
        F.least(F.lit(1.0), F.col("minority") / F.greatest("d_schema", F.lit(1)) / 10.0).alias("w_epv"))
    own_epv = mem.where("is_target").select("decision", F.col("w_epv").alias("w"))
    mem = mem.join(own_epv, "decision").drop("w_epv").withColumn(
        "arm", F.explode(F.array(*[F.lit(a) for a in [*ARMS, "local"]]))).where("arm <> 'local' OR is_target")
    n = F.col("n").cast("double")
    weight = (F.when(F.col("arm") == "rows", n).when(F.col("arm") == "rows_squared", n * n)
              .when(F.col("arm") == "own_half", MG.own_weight(F.col("is_target"), 0.5, F.col("k")))
              .when(F.col("arm") == "own_epv", MG.own_weight(F.col("is_target"), F.col("w"), F.col("k")))
              .otherwise(F.lit(1.0)))
    keys = ["decision", "eps", "arm"]
    c = MG.weighted_merge(coef.join(mem, "unit"), keys, weight)
    b = model.join(mem, "unit").withColumn("__w", weight).groupBy(*keys).agg(
        (F.sum(F.col("__w") * F.col("intercept")) / F.greatest(F.sum("__w"), F.lit(1e-9))).alias("intercept"))
    models = model_rows(c, b, keys, d, ["coef", "mu", "sd"])
    tgt = members.where("is_target").select("decision", "unit")
    j = fit.test.join(materialise(tgt.join(models, "decision")), "unit")
    z = [F.coalesce((F.col(x) - F.col("__mu")[i]) / F.col("__sd")[i], F.lit(0.0)) for i, x in enumerate(xs)]
    norm = F.greatest(F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0])), F.lit(1.0))
    eta = F.col("intercept")
    for i, v in enumerate(z):
        eta = eta + F.coalesce(F.col("__coef")[i] * v / norm, F.lit(0.0))
    s = materialise(j.select(*keys, y, expit(clip(eta, -35, 35)).alias("p")))
    m = score_metrics(s, keys, y)
    slope = calibration_line(s, keys, y, c=1.0).select(*keys, "slope")
    return m.join(slope, keys, "left").select(*keys, "auprc", "brier", "slope")


def privacy_summary(cells: DataFrame) -> DataFrame:
    """Per (eps, arm): mean benefit over the private local model, change in Brier and slope."""
    loc = cells.where("arm = 'local'").select("decision", "eps", F.col("auprc").alias("a0"),
                                              F.col("brier").alias("b0"), F.col("slope").alias("s0"))
    j = cells.where("arm <> 'local'").join(loc, ["decision", "eps"]).where("auprc IS NOT NULL AND a0 IS NOT NULL")
    return j.groupBy("eps", "arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("auprc") - F.col("a0")).alias("benefit"),
        F.avg((F.col("auprc") > F.col("a0")).cast("double")).alias("helped"),
        F.avg(F.col("brier") - F.col("b0")).alias("d_brier"), F.avg(F.col("slope") - F.col("s0")).alias("d_slope"))
