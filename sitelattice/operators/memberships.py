"""Models trained on unions of row groups: folds, fractions, partner sets, reduced features.

Rows carry a key (site and fold, say). A model lists the keys it trains on; one scan per
Newton step serves every model, and no row is copied for the models it belongs to.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.operators import newton as N


@dataclass
class KeyStats:
    """Per key: rows, positives, and per column observed count, sum and sum of squares."""

    keys: list[str]
    n: np.ndarray
    pos: np.ndarray
    cnt: np.ndarray
    total: np.ndarray
    square: np.ndarray


def key_stats(df: DataFrame, key: str, y: str, xs: list[str]) -> KeyStats:
    agg = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"),
        *[e for j, x in enumerate(xs) for e in (
            F.count(x).alias(f"c{j}"), F.sum(x).alias(f"s{j}"), F.sum(F.col(x) * F.col(x)).alias(f"q{j}"))])
    t = agg.orderBy(key).toPandas()
    col = lambda p: t[[f"{p}{j}" for j in range(len(xs))]].fillna(0.0).to_numpy(float)
    return KeyStats(t[key].tolist(), t["n"].to_numpy(float), t["pos"].to_numpy(float),
                    col("c"), col("s"), col("q"))


@dataclass
class Bank:
    """Fitted models: names, parameters in standardised units, scales and active columns."""

    names: list[str]
    theta: np.ndarray
    mu: np.ndarray
    sd: np.ndarray
    active: np.ndarray
    ok: np.ndarray

    def raw(self):
        d = self.mu.shape[1]
        w = np.where(self.active, self.theta[:, :d] / self.sd, 0.0)
        return w, self.theta[:, d] - (w * self.mu).sum(1)


def fit_bank(df: DataFrame, key: str, y: str, xs: list[str], models: dict[str, list[str]],
             c: float | dict[str, float] = 1.0, active: dict[str, np.ndarray] | None = None,
             threshold: float = 0.0, stats: KeyStats | None = None) -> Bank:
    """One logistic per model over its keys' rows: mean fill, standardised, 0.5|w|^2 + C*loss.

    A model whose rows have one class is not fitted (``ok`` is False).
    """
    st = stats or key_stats(df, key, y, xs)
    at = {k: i for i, k in enumerate(st.keys)}
    names, d = list(models), len(xs)
    mu, sd = np.zeros((len(names), d)), np.ones((len(names), d))
    act, ok = np.zeros((len(names), d), bool), np.zeros(len(names), bool)
    for m, name in enumerate(names):
        ix = [at[k] for k in models[name] if k in at]
        if not ix:
            continue
        n, pos = st.n[ix].sum(), st.pos[ix].sum()
        cnt, tot, sq = st.cnt[ix].sum(0), st.total[ix].sum(0), st.square[ix].sum(0)
        mu[m] = np.divide(tot, cnt, out=np.zeros(d), where=cnt > 0)
        var = np.maximum(sq - cnt * mu[m] ** 2, 0.0) / n
        sd[m] = np.where(var > 1e-18, np.sqrt(var), 1.0)
        act[m] = active[name] if active is not None else cnt / n >= threshold
        ok[m] = 0 < pos < n and act[m].any()
    theta = np.zeros((len(names), d + 1))
    for b in N.batches(len(names), d):
        ix = np.array([m for m in b if ok[m]], int)
        if not ix.size:
            continue
        local = {m: i for i, m in enumerate(ix)}
        by_key: dict[str, list[int]] = {}
        for m in ix:
            for k in models[names[m]]:
                if k in at:
                    by_key.setdefault(k, []).append(local[m])
        keys = list(by_key)
        cs = np.array([c[names[m]] if isinstance(c, dict) else c for m in ix], float)
        design = N.Design(keys, mu[ix], np.ones((len(keys), d), bool), mu[ix], sd[ix], act[ix], cs,
                          [np.array(by_key[k]) for k in keys], fill_by_model=True)
        theta[ix], _, _ = N.fit(df, key, y, xs, design)
    return Bank(names, theta, mu, sd, act, ok)


def score_bank(df: DataFrame, key: str, carry: list[str], xs: list[str], bank: Bank,
               scored_by: dict[str, list[str]]) -> DataFrame:
    """(carry, model, p): each row scored by the models listed for its key."""
    out = None
    for part in N.batches(len(bank.names), len(xs)):
        s = _score_part(df, key, carry, xs, bank, scored_by, part)
        out = s if out is None else out.unionByName(s)
    return out


def _score_part(df, key, carry, xs, bank, scored_by, part: range) -> DataFrame:
    at = {bank.names[i]: i - part.start for i in part}
    w, b = (a[part.start:part.stop] for a in bank.raw())
    ok, mus = bank.ok[part.start:part.stop], bank.mu[part.start:part.stop]
    use = {k: np.array([at[m] for m in ms if m in at and ok[at[m]]], int) for k, ms in scored_by.items()}
    shared = df.sparkSession.sparkContext.broadcast((use, w, b, mus, list(at)))
    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in carry) + ", model string, p double"

    def scan(batches):
        use, w, b, mu, names = shared.value
        for pdf in batches:
            x = pdf[xs].to_numpy(dtype=float)
            for k, rows in pdf.groupby(key).indices.items():
                for m in use.get(k, ()):
                    a = x[rows]
                    z = b[m] + np.where(np.isnan(a), mu[m], a) @ w[m]
                    yield pdf.iloc[rows][carry].assign(
                        model=names[m], p=1 / (1 + np.exp(-np.clip(z, -35, 35))))

    cols = list(dict.fromkeys([key, *carry, *xs]))
    return df.select(*cols).mapInPandas(scan, schema)


def anova_f(df: DataFrame, key: str, y: str, xs: list[str], groups: dict[str, list[str]]) -> dict[str, np.ndarray]:
    """Univariate F statistic of each mean-filled column between the classes, per key union."""
    ks = df.withColumn("__ky", F.concat_ws("#", key, F.col(y).cast("string")))
    st = key_stats(ks, "__ky", y, xs)
    at = {k: i for i, k in enumerate(st.keys)}
    out = {}
    for name, keys in groups.items():
        both = [[at[f"{k}#{v}"] for k in keys if f"{k}#{v}" in at] for v in (0, 1)]
        ix = both[0] + both[1]
        n = st.n[ix].sum()
        cnt, tot = st.cnt[ix].sum(0), st.total[ix].sum(0)
        mu = np.divide(tot, cnt, out=np.zeros(len(xs)), where=cnt > 0)
        ssb = np.zeros(len(xs))
        sst = st.square[ix].sum(0) - cnt * mu**2
        for part in both:
            nk = st.n[part].sum()
            if nk > 0:
                mean = (st.total[part].sum(0) + (nk - st.cnt[part].sum(0)) * mu) / nk
                ssb += nk * (mean - mu) ** 2
        ssw = np.maximum(sst - ssb, 1e-300)
        out[name] = ssb / (ssw / max(n - 2, 1))
    return out
