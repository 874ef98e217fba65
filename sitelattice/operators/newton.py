"""Logistic models for many groups at once, fitted by distributed Newton steps.

Rows never move: a pass over them adds each row's gradient and Hessian to the models it
belongs to, partition by partition; the partial sums are summed by Spark per matrix row,
and each model's small system is solved in its own task. Only parameters travel back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parameters, scales and masks of one batch of models stay below this many bytes.
STATE_BYTES = 128 << 20
# A task emits its partial sums early once they exceed this; rows that wait for others of their key stay below it too.
FLUSH_BYTES = 64 << 20
# Rows of a key that are added at once.
BLOCK = 1 << 14


@dataclass
class Design:
    """How raw rows become standardised rows.

    A row has a key (its site or pattern). ``fill`` and ``row_active`` belong to keys;
    ``mu``, ``sd``, ``active`` and ``c`` to models. ``members[key]`` lists the models the
    key's rows take part in. Coordinates active on both sides enter, the others are zero.
    With ``fill_by_model`` missing cells take the model's value instead of the key's.
    ``expand`` turns a matrix of the given columns into that of the model's columns, inside the scan.
    """

    keys: list[str]
    fill: np.ndarray
    row_active: np.ndarray
    mu: np.ndarray
    sd: np.ndarray
    active: np.ndarray
    c: np.ndarray
    members: list[np.ndarray] = field(default_factory=list)
    fill_by_model: bool = False
    expand: Callable[[np.ndarray], np.ndarray] | None = None

    def __post_init__(self):
        if not self.members:
            self.members = [np.array([i]) for i in range(len(self.keys))]


def _rows_of(design: Design, k: int, m: int, x: np.ndarray):
    cols = np.flatnonzero(design.row_active[k] & design.active[m])
    a = x[:, cols]
    a = np.where(np.isnan(a), design.fill[m if design.fill_by_model else k, cols], a)
    z = (a - design.mu[m, cols]) / design.sd[m, cols]
    return cols, a, z


def _blocks(batches, key: str, y: str, xs: list[str], index: dict):
    """(key's number, rows, y): a key's rows wait for each other, so that many small keys cost no more steps than rows ask for."""
    held: dict[int, list[np.ndarray]] = {}
    count: dict[int, int] = {}
    size = 0
    for pdf in batches:
        codes = pdf[key].map(index).to_numpy()
        seen = ~pd.isna(codes)
        if not seen.any():
            continue
        codes = codes[seen].astype(int)
        v = pdf[[*xs, y]].to_numpy(dtype=float, na_value=np.nan)[seen]
        order = np.argsort(codes, kind="stable")
        codes, v = codes[order], v[order]
        cuts = np.flatnonzero(np.diff(codes)) + 1
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(codes)]):
            k = int(codes[s])
            held.setdefault(k, []).append(v[s:e])
            count[k] = count.get(k, 0) + e - s
            if count[k] >= BLOCK:
                v_k = np.concatenate(held.pop(k))
                size -= v_k.nbytes
                del count[k]
                yield k, v_k[:, :-1], v_k[:, -1]
        size += v.nbytes
        if size > FLUSH_BYTES:
            for k, part in held.items():
                v_k = np.concatenate(part)
                yield k, v_k[:, :-1], v_k[:, -1]
            held, count, size = {}, {}, 0
    for k, part in held.items():
        v_k = np.concatenate(part)
        yield k, v_k[:, :-1], v_k[:, -1]


def _loss(eta, y):
    return float(np.sum(np.logaddexp(0, eta) - y * eta))


def newton_pass(df: DataFrame, key: str, y: str, xs: list[str], design: Design,
                theta: np.ndarray, live: np.ndarray):
    """One scan. Returns a DataFrame (m, i, vec): row i of the Hessian, its gradient entry and
    its raw-unit information; i = d is the intercept and i = d+1 holds loss and row count."""
    d = design.mu.shape[1]
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast((design, theta, live))

    def scan(batches):
        design, theta, live = shared.value
        index = {k: i for i, k in enumerate(design.keys)}
        acc: dict[int, np.ndarray] = {}

        def flush():
            if not acc:
                return None
            ms = list(acc)
            out = pd.DataFrame({
                "m": np.repeat(ms, d + 2), "i": np.tile(np.arange(d + 2), len(ms)),
                "vec": [row for m in ms for row in acc[m]]})
            acc.clear()
            return out

        for k, x, yy in _blocks(batches, key, y, xs, index):
            if design.expand is not None:
                x = design.expand(x)
            for m in design.members[k]:
                if not live[m]:
                    continue
                cols, a, z = _rows_of(design, k, m, x)
                ix = np.r_[cols, d]
                full = np.column_stack([z, np.ones(len(x))])
                eta = np.clip(full @ theta[m, ix], -35, 35)
                p = 1 / (1 + np.exp(-eta))
                w = p * (1 - p)
                t = acc.get(m)
                if t is None:
                    t = acc[m] = np.zeros((d + 2, d + 3))
                t[np.ix_(ix, ix)] += (full * w[:, None]).T @ full
                t[ix, d + 1] += full.T @ (yy - p)
                t[cols, d + 2] += w @ (a * a)
                t[d + 1, 0] += _loss(eta, yy)
                t[d + 1, 1] += len(x)
            if len(acc) * (d + 2) * (d + 3) * 8 > FLUSH_BYTES:
                yield flush()
        last = flush()
        if last is not None:
            yield last

    part = df.select(key, y, *xs).mapInPandas(scan, "m int, i int, vec array<double>")
    return part.groupBy("m", "i").agg(vector_to_array(
        Summarizer.sum(array_to_vector("vec"))).alias("vec"))


def _solve(sums: DataFrame, design: Design, theta: np.ndarray, d: int, ridge: float) -> pd.DataFrame:
    """Newton step per model, each solved in its own task from its d+2 summed rows."""
    shared = sums.sparkSession.sparkContext.broadcast((design.active, design.c, theta))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        active, c, theta = shared.value
        m = int(pdf["m"].iloc[0])
        t = np.zeros((d + 2, d + 3))
        for i, v in zip(pdf["i"], pdf["vec"]):
            t[i] = v
        cols = np.flatnonzero(active[m])
        ix = np.r_[cols, d]
        h = c[m] * t[np.ix_(ix, ix)]
        g = c[m] * t[ix, d + 1]
        w = theta[m, cols]
        g[:-1] -= w
        h[np.arange(len(cols)), np.arange(len(cols))] += 1.0
        h[np.diag_indices_from(h)] += ridge * max(np.trace(h) / len(h), 1.0)
        step = np.zeros(d + 1)
        step[ix] = np.linalg.lstsq(h, g, rcond=None)[0]
        return pd.DataFrame({"m": [m], "step": [step], "loss": [c[m] * t[d + 1, 0] + 0.5 * float(w @ w)],
                             "info": [t[:d, d + 2]], "n": [t[d + 1, 1]]})

    return sums.groupBy("m").applyInPandas(
        one, "m int, step array<double>, loss double, info array<double>, n double").toPandas()


def fit(df: DataFrame, key: str, y: str, xs: list[str], design: Design, max_iter: int = 30,
        tol: float = 1e-6):
    """Newton to convergence for every model: (theta, info, n). A step that raises a model's
    loss is halved. A model whose step is below ``tol`` takes it and drops out of later
    passes; the steps converge quadratically, so what is left is of the order of its square."""
    k, d = design.mu.shape
    theta = np.zeros((k, d + 1))
    base, step = theta.copy(), np.zeros_like(theta)
    size, loss = np.ones(k), np.full(k, np.inf)
    info, n = np.zeros((k, d)), np.zeros(k)
    live = np.ones(k, bool)
    data = df.select(key, y, *xs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(max_iter):
            if not live.any():
                break
            got = _solve(newton_pass(data, key, y, xs, design, theta, live), design, theta, d, 0.0)
            seen = np.zeros(k, bool)
            for m, s, ls, nfo, cnt in got.itertuples(index=False):
                seen[m] = True
                info[m], n[m] = nfo, cnt
                if ls > loss[m] + 1e-9 * abs(loss[m]) and size[m] > 1e-3:
                    size[m] /= 2
                    theta[m] = base[m] + size[m] * step[m]
                    continue
                loss[m], base[m], step[m], size[m] = ls, theta[m].copy(), np.asarray(s), 1.0
                theta[m] = base[m] + step[m]
                if np.max(np.abs(step[m])) < tol:
                    live[m] = False
            live &= seen
    finally:
        data.unpersist()
    return theta, info, n


def batches(n_models: int, d: int) -> list[range]:
    """Model index ranges whose parameters, scales and masks fit the state bound."""
    per = max(1, STATE_BYTES // (8 * (4 * d + 8)))
    return [range(s, min(s + per, n_models)) for s in range(0, n_models, per)]


def trial_losses(df: DataFrame, key: str, y: str, xs: list[str], design: Design,
                 thetas: list[np.ndarray]) -> np.ndarray:
    """Summed loss of one model (model 0) at several parameter vectors, in one scan."""
    d = len(xs)
    shared = df.sparkSession.sparkContext.broadcast((design, thetas))

    def scan(batches):
        design, thetas = shared.value
        index = {k: i for i, k in enumerate(design.keys)}
        tot = np.zeros(len(thetas))
        for pdf in batches:
            codes = pdf[key].map(index).to_numpy()
            x, yy = pdf[xs].to_numpy(dtype=float), pdf[y].to_numpy(dtype=float)
            for k in np.unique(codes[~pd.isna(codes)]).astype(int):
                at = codes == k
                cols, _, z = _rows_of(design, k, 0, x[at])
                for j, th in enumerate(thetas):
                    tot[j] += _loss(np.clip(z @ th[cols] + th[d], -35, 35), yy[at])
        yield pd.DataFrame({"j": np.arange(len(thetas)), "loss": tot})

    got = df.select(key, y, *xs).mapInPandas(scan, "j int, loss double").groupBy("j").agg(
        F.sum("loss").alias("loss")).toPandas()
    out = np.zeros(len(thetas))
    out[got["j"]] = got["loss"]
    return out


def aggregated_newton(df: DataFrame, key: str, y: str, xs: list[str], design: Design,
                      start: np.ndarray, checkpoints=(1, 2, 5, 10, 25, 50, 100), ridge: float = 1e-6):
    """Penalised Newton on the union of sites from a merged start, in one standardised space.

    Each step is a score-and-information scan and one scan for all eight trial step sizes.
    Returns {step count: parameters}; stops when no trial lowers the objective.
    """
    d = len(xs)
    theta, out = start.copy(), {}
    for i in range(1, max(checkpoints) + 1):
        got = _solve(newton_pass(df, key, y, xs, design, theta[None, :], np.ones(1, bool)),
                     design, theta[None, :], d, ridge)
        step, best = np.asarray(got["step"].iloc[0]), float(got["loss"].iloc[0])
        sizes = [0.5**j for j in range(8)]
        tries = [theta + s * step for s in sizes]
        c = float(design.c[0])
        vals = c * trial_losses(df, key, y, xs, design, tries) + [
            0.5 * float(t[:d] @ t[:d]) for t in tries]
        better = np.flatnonzero(vals < best)
        if better.size:
            theta = tries[better[0]]
        if i in checkpoints:
            out[i] = theta.copy()
        if not better.size:
            for c_ in checkpoints:
                out.setdefault(c_, theta.copy())
            break
    return out
