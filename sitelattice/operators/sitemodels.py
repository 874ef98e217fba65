"""Site models: fitting, scoring, recalibration, federated rounds and private variants."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelattice.functions.hashing import gaussian
from sitelattice.functions.scalars import clip, expit, gaussian_sigma, per_round_epsilon
from sitelattice.operators import newton as N
from sitelattice.operators.matrix import SCHEMA_THRESHOLD, column_stats
from sitelattice.operators.metrics import calibration_in_the_large


def _group_table(df: DataFrame, key: str, y: str, xs: list[str]) -> pd.DataFrame:
    """Counts and column statistics per group: groups x variables, one scan."""
    agg = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"),
        *[e for j, x in enumerate(xs) for e in (
            F.count(x).alias(f"c{j}"), F.avg(x).alias(f"m{j}"), F.stddev_pop(x).alias(f"s{j}"))])
    return agg.orderBy(key).toPandas()


def _filled_scale(t: pd.DataFrame, d: int):
    """Mean and population sd of each column after its missing cells are set to the mean."""
    n = t["n"].to_numpy(float)[:, None]
    cnt = t[[f"c{j}" for j in range(d)]].to_numpy(float)
    mu = t[[f"m{j}" for j in range(d)]].to_numpy(float)
    sd = t[[f"s{j}" for j in range(d)]].to_numpy(float) * np.sqrt(cnt / n)
    return np.nan_to_num(mu), np.where(np.isfinite(sd) & (sd > 0), sd, 1.0), cnt / n


def fit_sites(df: DataFrame, key: str, y: str, xs: list[str], c: float | dict = 1.0,
              threshold: float = SCHEMA_THRESHOLD, min_schema: int = 1) -> tuple[DataFrame, DataFrame]:
    """One L2 logistic per group over its own schema: ``(site_model, site_coef)``.

    Missing cells take the group mean; columns below the schema threshold are absent. Groups
    with one class get no model. Coefficients come in standardised and raw units with the
    raw-unit Fisher information.
    """
    spark = df.sparkSession
    d = len(xs)
    t = _group_table(df, key, y, xs)
    mu, sd, share = _filled_scale(t, d)
    active = share >= threshold
    ok = ((t["pos"] > 0) & (t["pos"] < t["n"])).to_numpy() & (active.sum(1) >= min_schema)
    t, mu, sd, active = t[ok].reset_index(drop=True), mu[ok], sd[ok], active[ok]
    models, coefs = [], []
    for b in N.batches(len(t), d):
        ix = list(b)
        keys = t[key].iloc[ix].tolist()
        cs = np.array([c[k] if isinstance(c, dict) else c for k in keys], float)
        design = N.Design(keys, mu[ix], active[ix], mu[ix], sd[ix], active[ix], cs)
        rows = df if len(ix) == len(t) else df.where(F.col(key).isin(keys))
        theta, info, _ = N.fit(rows, key, y, xs, design)
        raw = np.where(active[ix], theta[:, :d] / sd[ix], 0.0)
        raw_b = theta[:, d] - (raw * mu[ix]).sum(1)
        models.append(pd.DataFrame({key: keys, "n": t["n"].iloc[ix].to_numpy("int64"),
                                    "intercept": theta[:, d], "raw_b": raw_b}))
        g, v = np.nonzero(active[ix])
        coefs.append(pd.DataFrame({
            key: np.array(keys, object)[g], "var": v.astype("int32"),
            "n": t["n"].iloc[ix].to_numpy("int64")[g], "mu": mu[ix][g, v], "sd": sd[ix][g, v],
            "coef": theta[g, v], "raw": raw[g, v], "info": info[g, v]}))
    kt = dict(df.dtypes)[key]
    model = spark.createDataFrame(
        pd.concat(models) if models else pd.DataFrame(columns=[key, "n", "intercept", "raw_b"]),
        f"{key} {kt}, n bigint, intercept double, raw_b double")
    coef = spark.createDataFrame(
        pd.concat(coefs) if coefs else pd.DataFrame(
            columns=[key, "var", "n", "mu", "sd", "coef", "raw", "info"]),
        f"{key} {kt}, var int, n bigint, mu double, sd double, coef double, raw double, info double")
    return model, coef


def model_rows(coef: DataFrame, model: DataFrame, keys: list[str], d: int, fields: list[str]) -> DataFrame:
    """One row per model with each coefficient field as an array over the variables."""
    pick = lambda f, j: F.max(F.when(F.col("var") == j, F.col(f)))
    arr = coef.groupBy(*keys).agg(*[
        F.array(*[pick(f, j) for j in range(d)]).alias(f"__{f}") for f in fields])
    return model.join(arr, keys)


def score_raw(df: DataFrame, xs: list[str], intercept: Column) -> Column:
    """Raw-unit score of a row joined with ``__raw`` and ``__mu``; absent coordinates add nothing."""
    z = intercept
    for j, x in enumerate(xs):
        z = z + F.coalesce(F.col("__raw")[j] * F.coalesce(F.col(x), F.col("__mu")[j]), F.lit(0.0))
    return expit(clip(z, -35, 35))


def mean_raw_score(xs: list[str], models: str) -> Column:
    """Mean of the raw-unit scores of the models in a row's array, each with raw_b, __raw and __mu: the row is not copied."""
    def one(m):
        z = m["raw_b"]
        for j, x in enumerate(xs):
            z = z + F.coalesce(m["__raw"][j] * F.coalesce(F.col(x), m["__mu"][j]), F.lit(0.0))
        return expit(clip(z, -35, 35))

    return F.aggregate(models, F.lit(0.0), lambda a, m: a + one(m)) / F.size(models)


def score_std(df: DataFrame, xs: list[str], intercept: Column) -> Column:
    """Standardised score with ``__coef``, ``__mu``, ``__sd``; a missing cell adds nothing."""
    z = intercept
    for j, x in enumerate(xs):
        z = z + F.coalesce(F.col("__coef")[j] * (F.col(x) - F.col("__mu")[j]) / F.col("__sd")[j], F.lit(0.0))
    return expit(clip(z, -35, 35))


def score_local(df: DataFrame, key: str, xs: list[str], model: DataFrame, coef: DataFrame) -> DataFrame:
    """Rows scored by their own group's model in raw units (``p``)."""
    m = model_rows(coef, model.select(key, "raw_b"), [key], len(xs), ["raw", "mu"])
    j = df.join(m, key)
    return j.withColumn("p", score_raw(j, xs, F.col("raw_b"))).drop("raw_b", "__raw", "__mu")


def score_by_all(df: DataFrame, site: str, xs: list[str], model: DataFrame, coef: DataFrame,
                 pairs: DataFrame) -> DataFrame:
    """(row columns, member, p): each row scored by the models its site is paired with.

    ``pairs``: site, member. Bounded by partners per site, not by sites.
    """
    m = model_rows(coef, model.select(site, "raw_b"), [site], len(xs), ["raw", "mu"]).withColumnRenamed(
        site, "member")
    j = df.join(pairs, site).join(m, "member")
    return j.withColumn("p", score_raw(j, xs, F.col("raw_b"))).drop("raw_b", "__raw", "__mu")


def ensemble(scored: DataFrame, ids: list[str], y: str) -> DataFrame:
    """Unweighted mean of the members' probabilities per row."""
    return scored.groupBy(*ids).agg(F.avg("p").alias("p"), F.first(y).alias(y))


def recalibrated(scored: DataFrame, site: str, y: str, p: str) -> DataFrame:
    """(site, shift): intercept refitted on the site's own rows, coefficients fixed."""
    return calibration_in_the_large(scored, [site], y, p).drop("converged")


def pooled_fit(df: DataFrame, y: str, xs: list[str], c: float = 1.0, indicators: bool = True):
    """One logistic on [imputed, mask] (or imputed values only) over all stacked rows.

    Returns ``(columns, score)``: ``score(rows)`` adds ``p``. Standardised on the training
    rows; penalty 0.5|w|^2 + C*loss.
    """
    d = len(xs)
    stats = column_stats(df, [], xs).orderBy("var").toPandas()
    fill = stats["mean"].fillna(0.0).to_numpy(float)

    def design(rows: DataFrame) -> DataFrame:
        cols = [F.coalesce(F.col(x), F.lit(float(fill[j]))).alias(f"z{j}") for j, x in enumerate(xs)]
        if indicators:
            cols += [F.col(x).isNotNull().cast("double").alias(f"z{d + j}") for j, x in enumerate(xs)]
        return rows.select("*", *cols)

    zs = [f"z{j}" for j in range(2 * d if indicators else d)]
    tr = design(df).withColumn("__g", F.lit("all"))
    t = _group_table(tr, "__g", y, zs)
    mu, sd, _ = _filled_scale(t, len(zs))
    act = np.ones_like(mu, bool)
    theta, _, _ = N.fit(tr, "__g", y, zs, N.Design(["all"], mu, act, mu, sd, act, np.array([c])))
    w, b = theta[0, :-1] / sd[0], float(theta[0, -1] - (theta[0, :-1] / sd[0]) @ mu[0])

    def score(rows: DataFrame) -> DataFrame:
        z = F.lit(b)
        for j, name in enumerate(zs):
            z = z + F.lit(float(w[j])) * F.col(name)
        return design(rows).withColumn("p", expit(clip(z, -35, 35))).drop(*zs)

    score.weights, score.bias, score.fill = w, b, fill
    score.std_weights, score.std_bias, score.mu, score.sd = theta[0, :-1], float(theta[0, -1]), mu[0], sd[0]
    return zs, score


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


# --- federated averaging -------------------------------------------------------------------

#: Rows of a packed block, few enough for the JVM to copy a block like any small array, and blocks that a task holds at once.
PACKED_ROWS = 4096
HELD_BLOCKS = 128


def _packed_sites(df: DataFrame, key: str, y: str, xs: list[str], design: N.Design, unit: bool) -> DataFrame:
    """Blocks (k, z, y) of rows of one site, standardised on the site's own columns once for all rounds; ``unit`` scales them
    into the unit ball. Rows without a site are in no block."""
    shared = df.sparkSession.sparkContext.broadcast(design)

    def pack(batches):
        design = shared.value
        index = {k: i for i, k in enumerate(design.keys) if k is not None}
        for k, x, yy in N._blocks(batches, key, y, xs, index):
            _, _, z = N._rows_of(design, k, k, x)
            if unit:
                z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1.0)
            cuts = range(0, len(yy), PACKED_ROWS)
            yield pd.DataFrame({"k": [k] * len(cuts), "z": [z[c:c + PACKED_ROWS].tobytes() for c in cuts],
                                "y": [yy[c:c + PACKED_ROWS].tobytes() for c in cuts]})

    return df.where(F.col(key).isNotNull()).select(key, y, *xs).mapInPandas(pack, "k int, z binary, y binary")


def _site_gradients(blocks: DataFrame, active: np.ndarray, w: np.ndarray) -> dict[int, np.ndarray]:
    """Summed gradients (a row a set of weights) and row count of every site at its current weights, in one scan.

    ``w``: sets x sites x (columns and intercept)."""
    sets, sites, d = w.shape[0], w.shape[1], w.shape[2] - 1
    shared = blocks.sparkSession.sparkContext.broadcast((active, w))

    def scan(batches):
        active, w = shared.value
        acc = np.zeros((sites, sets, d + 2))
        for b in batches:
            for k, z, yy in zip(b["k"].to_pylist(), b["z"], b["y"]):
                cols = np.flatnonzero(active[k])
                yy = np.frombuffer(yy.as_buffer())
                z = np.frombuffer(z.as_buffer()).reshape(len(yy), len(cols))
                r = 1 / (1 + np.exp(-np.clip(z @ w[:, k, cols].T + w[:, k, d], -35, 35))) - yy[:, None]
                acc[k][:, cols] += r.T @ z
                acc[k, :, d] += r.sum(0)
                acc[k, :, d + 1] += len(yy)
        hit = np.flatnonzero(acc[:, 0, d + 1])
        if hit.size:  # a task without rows has no sums to send
            yield pa.RecordBatch.from_pydict({"k": pa.array(hit, pa.int32()), "vec": pa.array(
                [acc[k].ravel() for k in hit], pa.list_(pa.float64()))})

    got = blocks.mapInArrow(scan, "k int, vec array<double>").groupBy("k").agg(
        vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec")).toPandas()
    return {int(k): np.asarray(v).reshape(sets, d + 2) for k, v in zip(got["k"], got["vec"])}


def fedavg(df: DataFrame, key: str, y: str, xs: list[str], rounds: int, checkpoints=(1, 2, 5, 30),
           local_epochs: int = 5, lr: float = 1.0, threshold: float = SCHEMA_THRESHOLD,
           eps: float | None = None, lam: float = 0.01, seed: str = "fed", unit: bool = False):
    """Federated averaging: full-batch local epochs, n-weighted average of site weights.

    A site's absent coordinates keep the global value. With ``eps`` each round's release is
    perturbed at its share of the privacy budget. Returns (design, {round: weights}).
    """
    design, snaps = fedavg_budgets(df, key, y, xs, rounds, [eps], checkpoints, local_epochs, lr, threshold, lam, seed, unit)
    return design, snaps[0]


def fedavg_budgets(df: DataFrame, key: str, y: str, xs: list[str], rounds: int, budgets: list[float | None],
                   checkpoints=(1, 2, 5, 30), local_epochs: int = 5, lr: float = 1.0, threshold: float = SCHEMA_THRESHOLD,
                   lam: float = 0.01, seed: str = "fed", unit: bool = False):
    """``fedavg`` at several budgets in the same scans: (design, [{round: weights} of every budget])."""
    d = len(xs)
    t = _group_table(df, key, y, xs)
    mu, sd, share = _filled_scale(t, d)
    active = share >= threshold
    keys = t[key].tolist()
    design = N.Design(keys, mu, active, mu, sd, active, np.ones(len(keys)))
    n = t["n"].to_numpy(float)
    glob = np.zeros((len(budgets), d + 1))
    snaps = [{} for _ in budgets]
    shares = [None if eps is None else per_round_epsilon(eps, rounds) for eps in budgets]
    data = _packed_sites(df, key, y, xs, design, unit).persist()
    conf = df.sparkSession.conf
    before = conf.get(ARROW_ROWS)
    try:
        data.count()  # packed before the batches become short
        conf.set(ARROW_ROWS, str(HELD_BLOCKS))
        for r in range(1, rounds + 1):
            w = np.repeat(glob[:, None], len(keys), 1)
            for _ in range(local_epochs):
                for k, v in _site_gradients(data, active, w).items():
                    ix = np.r_[np.flatnonzero(active[k]), d]
                    w[:, k, ix] -= lr * v[:, ix] / v[:, [d + 1]]
            for b, eps0 in enumerate(shares):
                if eps0 is not None and np.isfinite(eps0):
                    w[b] += _noise(df, keys, n, active, d, eps0, lam, f"{seed}/{r}")
                glob[b] = (n[:, None] * w[b]).sum(0) / n.sum()
                if r in checkpoints:
                    snaps[b][r] = glob[b].copy()
    finally:
        conf.set(ARROW_ROWS, before)
        data.unpersist()
    return design, snaps


def _noise(df, keys, n, active, d, eps, lam, seed) -> np.ndarray:
    """Gaussian noise per (site, coordinate) drawn from hashes, zero on absent coordinates."""
    spark = df.sparkSession
    grid = spark.createDataFrame(pd.DataFrame({"site": [str(k) for k in keys], "k": range(len(keys))}))
    z = grid.withColumn("var", F.explode(F.sequence(F.lit(0), F.lit(d)))).select(
        "k", "var", gaussian(seed, "site", "var").alias("z")).toPandas()
    out = np.zeros((len(keys), d + 1))
    out[z["k"], z["var"]] = z["z"]
    sigma = np.array([gaussian_sigma(2.0 / (ni * lam), eps) for ni in n])[:, None]
    return out * sigma * np.column_stack([active, np.ones(len(keys))])


def private_sites(df: DataFrame, key: str, y: str, xs: list[str], eps: list[float], seed: str = "dp",
                  lam: float = 0.01, threshold: float = SCHEMA_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Site models with output perturbation at several budgets: (model, coef) with ``eps``.

    Rows are standardised per site and scaled into the unit ball, the averaged loss carries
    regulariser ``lam``, and each coordinate gets hash-drawn Gaussian noise. The clean fit is
    shared by all budgets.
    """
    d = len(xs)
    stats = _group_table(df, key, y, xs)
    mu, sd, share = _filled_scale(stats, d)
    keys = stats[key].tolist()
    active = share >= threshold
    cells = [(k, [float(a) for a in m], [float(s) for s in sd_], [bool(b) for b in act])
             for k, m, sd_, act in zip(keys, mu, sd, active)]
    spark = df.sparkSession
    kt = dict(df.dtypes)[key]
    st = spark.createDataFrame(cells, f"{key} {kt}, __mu array<double>, __sd array<double>, __act array<boolean>")
    j = df.join(st, key)
    z = [F.when(F.col("__act")[i], (F.coalesce(F.col(x), F.col("__mu")[i]) - F.col("__mu")[i]) / F.col("__sd")[i])
         for i, x in enumerate(xs)]
    norm = F.sqrt(sum((F.coalesce(c * c, F.lit(0.0)) for c in z[1:]), F.coalesce(z[0] * z[0], F.lit(0.0))))
    ball = j.select(key, y, *[(c / F.greatest(norm, F.lit(1.0))).alias(x) for c, x in zip(z, xs)])
    ok = ((stats["pos"] > 0) & (stats["pos"] < stats["n"])).to_numpy()
    n = stats["n"].to_numpy(float)[ok]
    ks = [k for k, o in zip(keys, ok) if o]
    zero, one = np.zeros((len(ks), d)), np.ones((len(ks), d))
    theta, _, _ = N.fit(ball, key, y, xs, N.Design(
        ks, zero, active[ok], zero, one, active[ok], 1.0 / (n * lam)))
    rows, models = [], []
    for e in eps:
        noise = _noise(df, ks, n, active[ok], d, e, lam, f"{seed}/{e}") if np.isfinite(e) else 0.0
        th = theta + noise
        for i, k in enumerate(ks):
            models.append((k, float(e), int(n[i]), float(th[i, d])))
            rows += [(k, float(e), int(v), int(n[i]), float(mu[ok][i, v]), float(sd[ok][i, v]), float(th[i, v]))
                     for v in np.flatnonzero(active[ok][i])]
    return (spark.createDataFrame(models, f"{key} {kt}, eps double, n bigint, intercept double"),
            spark.createDataFrame(rows, f"{key} {kt}, eps double, var int, n bigint, mu double, sd double, coef double"))
