"""Imputation, residual masks and reduced-feature ensembles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.operators import newton as N
from sitelattice.operators.matrix import column_stats
from sitelattice.operators.memberships import fit_bank
from sitelattice.session import materialise

RIDGE = 1e-3


def _means(df: DataFrame, xs: list[str]) -> np.ndarray:
    return column_stats(df, [], xs).orderBy("var").toPandas()["mean"].fillna(0.0).to_numpy(float)


def summed_rows(df: DataFrame, cols: list[str], local, shape: tuple[int, int]) -> np.ndarray:
    """Sum of a per-batch matrix over all rows; one matrix row per reduce key."""
    r, c = shape

    def scan(batches):
        acc = np.zeros(shape)
        for pdf in batches:
            acc += local(pdf[cols].to_numpy(dtype=float))
        yield pd.DataFrame({"i": np.arange(r), "vec": list(acc)})

    got = df.select(*cols).mapInPandas(scan, "i int, vec array<double>").groupBy("i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec")).toPandas()
    out = np.zeros(shape)
    for i, v in zip(got["i"], got["vec"]):
        out[i] = v
    return out


def mapped(df: DataFrame, xs: list[str], fn, outs: list[str]) -> DataFrame:
    """Replace columns by a numpy function of the row matrix, batch by batch."""
    keep = [c for c in df.columns if c not in outs]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + "".join(
        f", `{o}` double" for o in outs)

    def scan(batches):
        for pdf in batches:
            res = fn(pdf[xs].to_numpy(dtype=float))
            out = pdf[keep].copy()
            for j, o in enumerate(outs):
                out[o] = res[:, j]
            yield out

    return df.mapInPandas(scan, schema)


def residual_mask_model(df: DataFrame, xs: list[str], ridge: float = RIDGE):
    """Leave-own-column-out ridge of each mask indicator on the values: a row function.

    One scan for the moments of [z, mask]; d small solves; a column that is always or never
    observed has residual zero.
    """
    d = len(xs)
    mu = _means(df, xs)

    def moments(x):
        obs = (~np.isnan(x)).astype(float)
        a = np.column_stack([np.where(obs > 0, x, mu) - mu, obs, np.ones(len(x))])
        return a.T @ a

    g = summed_rows(df, xs, moments, (2 * d + 1, 2 * d + 1))
    n = g[-1, -1]
    shift = g[:d, -1] / n
    cov = g[:d, :d] - n * np.outer(shift, shift)
    sd = np.sqrt(np.diag(cov) / n)
    sd = np.where(sd > 1e-12, sd, 1.0)
    gram = cov / np.outer(sd, sd) + ridge * n * np.eye(d)
    cross = (g[:d, d:2 * d] - np.outer(shift, g[d:2 * d, -1])) / sd[:, None]
    share = g[d:2 * d, -1] / n
    w = np.zeros((d, d))
    flat = share * (1 - share) < 1e-24
    for j in range(d):
        o = np.array([i for i in range(d) if i != j])
        if not flat[j]:
            w[o, j] = np.linalg.solve(gram[np.ix_(o, o)], cross[o, j])

    def residual(x):
        obs = (~np.isnan(x)).astype(float)
        z = (np.where(obs > 0, x, mu) - mu - shift) / sd
        return np.where(flat, 0.0, obs - z @ w)

    return residual


def residual_mask(df: DataFrame, xs: list[str], ridge: float = RIDGE) -> DataFrame:
    """Rows with ``r0..r{d-1}``: the part of each mask indicator the values do not explain."""
    return mapped(df, xs, residual_mask_model(df, xs, ridge), [f"r{j}" for j in range(len(xs))])


@dataclass
class MaskInteractions:
    """Row function [x, m, m (x) x]: mean-filled values, the mask (1: observed), every mask times every value."""

    mu: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        obs = (~np.isnan(x)).astype(float)
        a = np.where(obs > 0, x, self.mu)
        return np.column_stack([a, obs, (obs[:, :, None] * a[:, None, :]).reshape(len(x), -1)])


def mask_interaction_logistic(df: DataFrame, y: str, xs: list[str], c: float = 1e-4):
    """Logistic on [x, m, m (x) x] as it is, penalty 0.5|w|^2 + C*summed loss: a function that adds ``p``.

    Rows hold the values only; the products are formed inside the scans and never stored.
    """
    d = len(xs) * (len(xs) + 2)
    expand = MaskInteractions(_means(df, xs))
    zero, one, every = np.zeros((1, d)), np.ones((1, d)), np.ones((1, d), bool)
    theta, _, _ = N.fit(df.withColumn("__k", F.lit("all")), "__k", y, xs, N.Design(
        ["all"], zero, every, zero, one, every, np.array([c]), expand=expand))
    w, b = theta[0, :-1], float(theta[0, -1])

    def p(x):
        return 1 / (1 + np.exp(-np.clip(expand(x) @ w + b, -35, 35)))[:, None]

    def score(rows: DataFrame) -> DataFrame:
        return mapped(rows, xs, p, ["p"])

    score.weights, score.bias = w, b
    return score


def chained_equations(df: DataFrame, xs: list[str], sweeps: int = 10, ridge: float = 1e-3):
    """Iterative ridge imputation; returns a function on row matrices.

    Within a missingness pattern the filled cells are linear in the observed ones, so the rows collapse first, in one
    scan, to the moments of every pattern's observed cells. A sweep fills these moments, gathers those of all columns'
    regressions and then updates the columns in order of missingness; rows are not read again.
    """
    d = len(xs)
    stats = column_stats(df, [], xs).orderBy("var").toPandas()
    mu = stats["mean"].fillna(0.0).to_numpy(float)
    sd = stats["sd"].fillna(0.0).to_numpy(float)
    sd = np.where(sd > 0, sd, 1.0)
    order = np.argsort(-stats["n_obs"].to_numpy(), kind="stable")
    history: list[np.ndarray] = []
    patterns = materialise(_pattern_moments(df, xs, mu, sd))
    cells = [c for c in patterns.columns if c.startswith("q")]
    upper = np.triu_indices(d + 1)

    def filler(miss, history):
        """Rows of [z, 1] after the sweeps, as combinations of the observed [z, 1]."""
        m = np.eye(d + 1)
        m[:d][miss] = 0.0
        for w in history:
            for j in order:
                if miss[j]:
                    m[j] = w[:, j] @ m
        return m

    for _ in range(sweeps):
        past = list(history)

        def moments(rows):
            out = np.zeros((d * (d + 1), d + 1))
            for r in rows:
                miss, g = r[:d] == 0, np.zeros((d + 1, d + 1))
                g[upper] = r[d:]
                g = g + np.triu(g, 1).T
                m = filler(miss, past)
                g = m @ g @ m.T
                for j in np.flatnonzero(~miss):
                    out[j * (d + 1):(j + 1) * (d + 1)] += g
            return out

        g = summed_rows(patterns, [*[f"o{j}" for j in range(d)], *cells], moments, (d * (d + 1), d + 1)).reshape(d, d + 1, d + 1)
        w = np.zeros((d + 1, d))
        for j in range(d):
            o = np.array([i for i in range(d + 1) if i != j])
            pen = ridge * max(g[j, d, d], 1.0) * np.eye(d)
            pen[-1, -1] = 1e-9
            w[o, j] = np.linalg.solve(g[j][np.ix_(o, o)] + pen, g[j][o, j])
        history.append(w)

    def fill(x):
        gaps = np.isnan(x)
        z = np.column_stack([np.where(gaps, 0.0, (x - mu) / sd), np.ones(len(x))])
        seen, at = np.unique(gaps, axis=0, return_inverse=True)
        at = at.ravel()
        for k, miss in enumerate(seen):
            if miss.any():
                rows = np.flatnonzero(at == k)
                z[np.ix_(rows, np.flatnonzero(miss))] = z[rows] @ filler(miss, history)[:d][miss].T
        return z[:, :d] * sd + mu

    return fill


def _pattern_moments(df: DataFrame, xs: list[str], mu: np.ndarray, sd: np.ndarray) -> DataFrame:
    """A row a missingness pattern: o0.. (1: observed) and q0.., the upper triangle of the sums of products of
    [z, 1], where a missing cell is zero."""
    z = [F.coalesce((F.col(x) - float(mu[j])) / float(sd[j]), F.lit(0.0)) for j, x in enumerate(xs)]
    rows = df.select(*[F.col(x).isNotNull().cast("int").alias(f"o{j}") for j, x in enumerate(xs)], *[c.alias(f"z{j}") for j, c in enumerate(z)])
    side = [*[F.col(f"z{j}") for j in range(len(xs))], F.lit(1.0)]
    pairs = [(a, b) for a in range(len(side)) for b in range(a, len(side))]
    return rows.groupBy(*[f"o{j}" for j in range(len(xs))]).agg(*[F.sum(side[a] * side[b]).alias(f"q{k}") for k, (a, b) in enumerate(pairs)])


def fit_forest_imputer(df: DataFrame, xs: list[str], trees: int = 20, depth: int = 8, sweeps: int = 4, seed: int = 0):
    """Iterative imputation with a random forest per column, one Spark fit per column and sweep.

    Returns the fitted rows and a function that fills other rows by the same forests in the same order.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    mu = _means(df, xs)
    flags = [f"__m{j}" for j in range(len(xs))]
    others = [VectorAssembler(inputCols=[x for i, x in enumerate(xs) if i != j], outputCol="__f") for j in range(len(xs))]

    def opened(rows: DataFrame) -> DataFrame:
        gaps = rows.select("*", *[F.col(x).isNull().alias(m) for x, m in zip(xs, flags)])
        return materialise(gaps.fillna({x: float(mu[j]) for j, x in enumerate(xs)}))

    def filled(rows: DataFrame, j: int, model) -> DataFrame:
        p = model.transform(others[j].transform(rows))
        return p.withColumn(xs[j], F.when(F.col(flags[j]), F.col("__p")).otherwise(F.col(xs[j]))).drop("__f", "__p")

    cur = opened(df)
    gaps = cur.agg(*[F.count_if(F.col(m)).alias(m) for m in flags]).first()
    order = sorted((j for j, m in enumerate(flags) if gaps[m] > 0), key=lambda j: gaps[flags[j]])
    history = []
    for _ in range(sweeps):
        past = []
        for j in order:
            forest = RandomForestRegressor(featuresCol="__f", labelCol=xs[j], predictionCol="__p", numTrees=trees, maxDepth=depth, seed=seed)
            past.append((j, forest.fit(others[j].transform(cur.where(~F.col(flags[j]))))))
            cur = filled(cur, *past[-1])
        cur = materialise(cur)
        history.append(past)

    def apply(rows: DataFrame) -> DataFrame:
        out = opened(rows)
        for past in history:
            for j, model in past:
                out = filled(out, j, model)
            out = materialise(out)
        return out.drop(*flags)

    return cur.drop(*flags), apply


def reduced_feature_ensemble(train: DataFrame, test: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """``p`` per test row: mean of the members leaving out one of the row's missing columns.

    The full model and every leave-one-out member are fitted in the same scans. Rows missing
    nothing use the full model.
    """
    d = len(xs)
    gaps = train.agg(*[F.count_if(F.col(x).isNull()).alias(x) for x in xs]).first()
    ever = [j for j, x in enumerate(xs) if gaps[x] > 0]
    tr = train.withColumn("__k", F.lit("all"))
    names = ["full", *[f"no{j}" for j in ever]]
    act = {n: np.ones(d, bool) for n in names}
    for j in ever:
        act[f"no{j}"][j] = False
    bank = fit_bank(tr, "__k", y, xs, {n: ["all"] for n in names}, 1.0, act)
    w, b = bank.raw()
    mu = bank.mu[0]

    def score(x):
        miss = np.isnan(x)
        z = np.where(miss, mu, x)
        p = 1 / (1 + np.exp(-np.clip(z @ w.T + b, -35, 35)))
        use = miss[:, ever]
        k = use.sum(1)
        mean = (p[:, 1:] * use).sum(1) / np.maximum(k, 1)
        return np.where(k > 0, mean, p[:, 0])[:, None]

    return mapped(test, xs, score, ["p"])
