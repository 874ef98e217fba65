"""Fused pattern regression: one logistic model per pattern, tied along the containment order.

The joint loss is the logistic loss of every row under its assigned pattern, plus ``ridge`` times the squared
weights, plus ``lam`` times the squared differences of shared weights along every edge (intercepts are free).
It is minimised by Newton steps whose systems are solved by preconditioned conjugate gradients. Everything is a
table keyed by pattern: rows are dealt once by (assigned pattern, slice), so that a pattern with very many rows is many
tasks; a step adds up block Hessians and gradients in one pass; a matrix-vector product is one join along the edges, one
aggregate and one product with the pattern's own block. The driver sees the scalars of a step only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sitelattice.operators.newton import FLUSH_BYTES
from sitelattice.session import materialise

INTERCEPT = -1
#: Rows of one pattern that share a slice.
SLICE_ROWS = 200_000


def _with_slices(df: DataFrame, xs: list[str], y: str, pattern, assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their assigned ``model`` and its slice, and (model, slices)."""
    to = assigned.where("assigned IS NOT NULL").select(F.col("pattern").alias("__k"), F.col("assigned").alias("model"))
    rows = df.select(pattern.alias("__k"), F.col(y).cast("double").alias("__y"), *xs).join(to, "__k").drop("__k")
    slices = materialise(rows.groupBy("model").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices")))
    at = F.pmod(F.xxhash64("__y", *xs), F.col("slices")).cast("int")
    return rows.join(slices, "model").withColumn("slice", at).drop("slices"), slices


def _data_terms(rows: DataFrame, theta: DataFrame, xs: list[str], mu: np.ndarray, sd: np.ndarray) -> DataFrame:
    """(model, sums): d + 2 rows (i, vec) a model; row i of its Hessian and its gradient entry, the last one the loss."""
    d = len(xs)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"model": np.repeat(list(acc), d + 2), "i": np.tile(np.arange(d + 2), len(acc)),
                                "vec": [row for t in acc.values() for row in t]})
            acc.clear()
            return out

        for pdf in batches:
            for model, at in pdf.groupby("model", sort=False).indices.items():
                x = (pdf[xs].to_numpy(dtype=float)[at] - mu) / sd
                z = np.column_stack([np.where(np.isnan(x), 0.0, x), np.ones(len(at))])
                y = pdf["__y"].to_numpy()[at]
                eta = np.clip(z @ pdf["t"].iloc[at[0]], -35, 35)
                p = 1 / (1 + np.exp(-eta))
                t = acc.setdefault(model, np.zeros((d + 2, d + 2)))
                t[:d + 1, :d + 1] += (z * (p * (1 - p))[:, None]).T @ z
                t[:d + 1, d + 1] += z.T @ (y - p)
                t[d + 1, 0] += np.sum(np.logaddexp(0, eta) - y * eta)
            if len(acc) * (d + 2) ** 2 * 8 > FLUSH_BYTES:
                yield flush()
        if acc:
            yield flush()

    part = rows.join(theta, ["model", "slice"]).mapInPandas(scan, "model string, i int, vec array<double>")
    one = part.groupBy("model", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec"))
    return one.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("i", "vec"))).alias("sums"))


def _around(links: DataFrame, vectors: DataFrame, v: str) -> DataFrame:
    """(model, s): for every pattern the sum of its neighbours' vectors."""
    far = vectors.select(F.col("model").alias("other"), F.col(v).alias("v"))
    return links.join(far, "other").groupBy("model").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("s"))


def _vec(value, n: int) -> np.ndarray:
    return np.zeros(n) if value is None else np.asarray(value, float)


def _blocks(known: DataFrame, sums: DataFrame, theta: DataFrame, links: DataFrame, lam: float, ridge: float,
            d: int) -> tuple[DataFrame, float]:
    """(model, tie, block, inverse, grad, loss): the pattern's part of the system and of the objective at ``theta``, and
    the objective."""
    around = _around(links, theta, "t")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                free, t = np.asarray(r.free), np.asarray(r.t)
                shared = np.r_[free[:d], 0.0]
                ties, near = _vec(r.ties, d + 1) * shared, _vec(r.s, d + 1) * shared
                h, g, loss = np.zeros((d + 1, d + 1)), np.zeros(d + 1), 0.0
                if r.sums is not None:
                    full = np.array([s["vec"] for s in r.sums])
                    h, g, loss = full[:d + 1, :d + 1], full[:d + 1, d + 1], full[d + 1, 0]
                pull = 2 * ridge * shared + 2 * lam * ties
                grad = (g - pull * t + 2 * lam * near) * free
                block = h * np.outer(free, free) + np.diag(pull + 1e-9 + (1 - free))
                # each edge is seen from both ends: half of lam (a a - a b) from either gives lam (a - b)^2
                own = loss + ridge * (t * t * shared).sum() + lam * (ties * t * t - near * t).sum()
                out.append((r.model, 2 * lam * shared, block.ravel(), np.linalg.inv(block).ravel(), grad, own))
            yield pd.DataFrame(out, columns=["model", "tie", "block", "inverse", "grad", "loss"])

    rows = known.join(theta, "model").join(sums, "model", "left").join(around, "model", "left")
    out, total = _written(rows.select("model", "free", "ties", "t", "sums", "s").mapInPandas(
        build, "model string, tie array<double>, block array<double>, inverse array<double>, grad array<double>, loss double"), loss="loss")
    return out, total["loss"]


def _axpy(a: float, x: str, y: str):
    """a x + y"""
    return F.zip_with(x, y, lambda u, v: F.lit(a) * u + v)


def _written(df: DataFrame, **sums: str) -> tuple[DataFrame, dict[str, float]]:
    """The written table and the totals of some of its columns, taken while it is written."""
    seen = Observation()
    done = materialise(df.observe(seen, *[F.sum(c).alias(k) for k, c in sums.items()]))
    return done, {k: float(v or 0.0) for k, v in seen.get.items()}


_STATE = ", ".join(f"{c} array<double>" for c in "xrpsuw")


def _advance(blocks: DataFrame, state: DataFrame, links: DataFrame, alpha: float, beta: float, n: int) -> tuple[DataFrame, float, float]:
    """One step of conjugate gradients: p and s = A p move on by beta, x and r by alpha, then u is the residual
    divided by the pattern's own block, w = A u. Also r . u and w . u. One join along the edges and one aggregate."""
    def divide(batches):
        for pdf in batches:
            yield pdf.drop(columns="inverse").assign(u=[np.reshape(m, (n, n)) @ r for m, r in zip(pdf["inverse"], pdf["r"])])

    def multiply(batches):
        for pdf in batches:
            w = [np.reshape(b, (n, n)) @ u - t * _vec(v, n) for b, u, t, v in zip(pdf["block"], pdf["u"], pdf["tie"], pdf["near"])]
            yield pdf.drop(columns=["block", "tie", "near"]).assign(
                w=w, ru=[float(a @ b) for a, b in zip(pdf["r"], pdf["u"])], wu=[float(a @ b) for a, b in zip(w, pdf["u"])])

    own = blocks.select("model", "inverse")
    turned = state.select("model", "x", "r", _axpy(beta, "p", "u").alias("p"), _axpy(beta, "s", "w").alias("s"))
    moved = turned.select("model", _axpy(alpha, "p", "x").alias("x"), _axpy(-alpha, "s", "r").alias("r"), "p", "s").join(own, "model")
    parts = _STATE.split(", ")
    moved = moved.mapInPandas(divide, "model string, " + ", ".join(parts[:5]))
    near = _around(links, moved, "u").withColumnRenamed("s", "near")
    met = moved.join(blocks.select("model", "tie", "block"), "model").join(near, "model", "left")
    out, sums = _written(met.mapInPandas(multiply, f"model string, {_STATE}, ru double, wu double"), ru="ru", wu="wu")
    return out, sums["ru"], sums["wu"]


def _solve(blocks: DataFrame, links: DataFrame, n: int, most: int) -> tuple[DataFrame, float]:
    """(model, x) of the Newton system, and the squared Newton decrement. The system is solved the closer the smaller
    the decrement is, so that Newton's steps keep converging faster than linearly."""
    zero = F.transform("grad", lambda g: g * 0.0)
    state = blocks.select("model", zero.alias("x"), F.col("grad").alias("r"), *[zero.alias(c) for c in "psuw"])
    state, gamma, delta = _advance(blocks, state, links, 0.0, 0.0, n)
    first, beta = gamma, 0.0
    if first <= 0:
        return state.select("model", "x"), first
    alpha = gamma / max(delta, 1e-300)
    for _ in range(most):
        state, new, delta = _advance(blocks, state, links, alpha, beta, n)
        if new <= min(0.01, first) * first or new < 1e-18:
            break
        beta, gamma = new / gamma, new
        alpha = gamma / max(delta - beta * gamma / alpha, 1e-300)
    return state.select("model", "x"), first


def fit_fused(df: DataFrame, xs: list[str], y: str, pattern, assigned: DataFrame, fitted: DataFrame, edges: DataFrame,
              mu: np.ndarray, sd: np.ndarray, lam: float = 1.0, ridge: float = 1e-2, max_iter: int = 60,
              tol: float = 1e-10, max_inner: int = 200) -> DataFrame:
    """theta (pattern, var, value, converged) of the joint loss; ``pattern`` is the column of a row's own pattern.

    Converged when the squared Newton decrement, about twice the distance to the least loss, is below ``tol``. A step that
    raises the loss is halved. A fitted pattern without rows of its own is placed by its neighbours alone.
    """
    d = len(xs)
    n = d + 1
    links = materialise(edges.select(F.col("child").alias("model"), F.col("parent").alias("other")).unionAll(
        edges.select(F.col("parent").alias("model"), F.col("child").alias("other"))))
    free = F.transform(F.sequence(F.lit(0), F.lit(d)), lambda i: (F.array_contains("vars", i) | (i == d)).cast("double"))
    own = materialise(fitted.select(F.col("pattern").alias("model"), free.alias("free")))
    ties = _around(links, own, "free").withColumnRenamed("s", "ties")
    known = materialise(own.join(ties, "model", "left"))
    rows, slices = _with_slices(df, xs, y, pattern, assigned)
    rows = rows.repartition("model", "slice").persist(StorageLevel.MEMORY_AND_DISK)
    theta = materialise(known.select("model", F.transform("free", lambda x: x * 0.0).alias("t")))
    base, step, size, least, converged = theta, None, 1.0, float("inf"), False
    try:
        for _ in range(max_iter):
            dealt = theta.join(slices, "model").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
            blocks, loss = _blocks(known, _data_terms(rows, dealt, xs, mu, sd), theta, links, lam, ridge, d)
            if step is not None and loss > least + 1e-9 * abs(least) and size > 1e-3:
                size /= 2
            else:
                base, size, least = theta, 1.0, loss
                step, decrement = _solve(blocks, links, n, max_inner)
                converged = decrement < tol
            s = size
            theta = materialise(base.join(step, "model").select("model", F.zip_with("t", "x", lambda a, b: a + F.lit(s) * b).alias("t")))
            if converged:
                break
    finally:
        rows.unpersist()
    cells = theta.join(own, "model").select(F.col("model").alias("pattern"), "free", F.posexplode("t").alias("at", "value"))
    var = F.when(F.col("at") == d, INTERCEPT).otherwise(F.col("at")).cast("int")
    return cells.where(F.element_at("free", F.col("at") + 1) > 0).select("pattern", var.alias("var"), "value", F.lit(converged).alias("converged"))
