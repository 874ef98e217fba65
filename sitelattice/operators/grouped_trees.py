"""Gradient-boosted trees with missing values, for every group and for all rows together in the same jobs.

Values become bins by exact quantile edges; a bin of its own holds the missing ones, and every split learns on which side
they go. A level of all models' trees is one job: tasks add up gradients, Hessians and counts per (model, node, feature, bin), Spark
sums these histograms, and each node's best split is found where its histogram ends up. The driver receives splits only. A row
counts for two models, its group's and the pooled one, and is never copied. Trees grow level by level, the splits of
largest gain first, up to ``leaves`` leaves. A model stops when the loss on its validation rows (a share of each group, drawn by
digest) has not become less for ``patience`` trees.

Rows are held as blocks of bins with the scores of all trees so far: a finished tree is applied to each row once. The blocks are
cached tree by tree and written every ``REFRESH`` trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.functions.hashing import uniform
from sitelattice.operators.newton import FLUSH_BYTES, STATE_BYTES
from sitelattice.operators.ordered import quantiles
from sitelattice.session import materialise

MISSING = 255
BINS = MISSING + 1
REFRESH = 10
#: The pooled model's place in every list of models; groups follow.
POOLED = 0
LOSS = -1


@dataclass
class Tree:
    """Nodes as arrays; a node without feature is a leaf, the right child follows the left one."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.missing_left[node], self.left[node] = feature, cut, missing_left, len(self.feature)
        for v in values:
            for a, x in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, 0), (self.value, v)):
                a.append(x)
        return self.left[node], self.left[node] + 1

    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)

    def rows(self, bins: np.ndarray, wanted: list[int] | None = None) -> dict[int, np.ndarray]:
        """The rows, in order, of every leaf (or of the wanted ones) that has any; ``bins`` is a row a feature."""
        out, waits = {}, [(0, np.arange(bins.shape[1]))]
        while waits:
            n, at = waits.pop()
            if not len(at):
                continue
            if self.feature[n] < 0:
                if wanted is None or n in wanted:
                    out[n] = at
                continue
            b = bins[self.feature[n]][at]
            right = b > self.cut[n]
            if self.missing_left[n]:
                right &= b != MISSING
            waits += [(self.left[n], at[~right]), (self.left[n] + 1, at[right])]
        return out

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row of bins ends up in."""
        out = np.zeros(len(bins), np.int64)
        for n, at in self.rows(bins.T).items():
            out[at] = n
        return out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Boosted:
    """Models by name (the pooled one has none): where they start and their trees. ``fitted`` tells which could be fitted."""

    xs: list[str]
    edges: list[np.ndarray]
    names: list[str | None]
    base: np.ndarray
    fitted: np.ndarray
    trees: list[list[Tree]]
    stopped: np.ndarray


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(e, x[:, j], side="left"))
    return out


def _edges(df: DataFrame, xs: list[str], max_bins: int) -> list[np.ndarray]:
    """At most ``max_bins - 1`` exact quantile edges a column; the last bin is open."""
    cells = F.array(*[F.struct(F.lit(j).alias("var"), F.col(x).cast("double").alias("value")) for j, x in enumerate(xs)])
    stacked = df.select(F.inline(cells)).where("value IS NOT NULL")
    probs = [(i + 1) / max_bins for i in range(max_bins - 1)]
    rows = quantiles(stacked, ["var"], "value", probs).collect()  # columns x bins
    return [np.unique([r["q"] for r in rows if r["var"] == j]) for j in range(len(xs))]


def _blocks(df: DataFrame, group: str, y: str, xs: list[str], ids: list[str], model: Boosted, share: float, seed) -> DataFrame:
    """Blocks of rows of few groups each: group numbers, bins, outcome, whether for validation, and both models' scores."""
    number, edges, base = {g: i for i, g in enumerate(model.names)}, model.edges, model.base
    drawn = (uniform(f"{seed}/validation", *ids) < share) if share else F.lit(False)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = pdf["__g"].map(number).fillna(-1).to_numpy(np.int32)  # -1: a group with validation rows only
            raw = np.stack([base[m], np.full(len(m), base[POOLED])])
            yield pd.DataFrame({"m": [m.tobytes()], "bins": [_binned(pdf[xs].to_numpy(dtype=float), edges).tobytes()],
                                "y": [pdf["__y"].to_numpy(np.uint8).tobytes()], "held": [pdf["__held"].to_numpy(np.uint8).tobytes()],
                                "raw": [raw.tobytes()]})

    rows = df.select(F.col(group).alias("__g"), F.col(y).cast("int").alias("__y"), drawn.alias("__held"), *ids, *xs)
    return materialise(rows.repartitionByRange("__g", *ids).mapInPandas(pack, _BLOCK))


_BLOCK = "m binary, bins binary, y binary, held binary, raw binary"


def _open_block(r, d: int):
    m = np.frombuffer(r.m, np.int32)
    return (m, np.frombuffer(r.bins, np.uint8).reshape(len(m), d), np.frombuffer(r.y, np.uint8).astype(float),
            np.frombuffer(r.held, np.uint8) > 0, np.frombuffer(r.raw, float).reshape(2, len(m)))


def _both(m: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(model, which of a row's two scores, rows) of every model in a block."""
    yield POOLED, 1, np.arange(len(m))
    for k in np.unique(m[m >= 0]):
        yield int(k), 0, np.flatnonzero(m == k)


def _refreshed(blocks: DataFrame, grown: dict[int, Tree], d: int) -> DataFrame:
    """The blocks with the scores of one more tree a model."""
    shared = blocks.sparkSession.sparkContext.broadcast(grown)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                m, bins, _, _, raw = _open_block(r, d)
                raw = raw.copy()
                for k, side, at in _both(m):
                    if k in shared.value:
                        raw[side, at] += shared.value[k].scores(bins[at])
                out.append(raw.tobytes())
            yield pdf.assign(raw=out)
    return blocks.mapInPandas(run, _BLOCK)


_FOUND = "model int, node int, feature int, cut int, missing_left boolean, gain double, sums array<double>"


def _best_splits(blocks: DataFrame, growing: dict[int, tuple[Tree, list[int]]], edges: list[np.ndarray], l2: float,
                 min_leaf: int, with_loss: bool) -> list:
    """Best split (none if no gain) of every open node of every growing tree; with the validation losses, if asked for."""
    shared = blocks.sparkSession.sparkContext.broadcast(growing)
    d = len(edges)
    size = d * BINS
    used = np.concatenate([j * BINS + np.r_[np.arange(len(e) + 1), MISSING] for j, e in enumerate(edges)])  # the others hold no row

    def scan(batches):
        growing = shared.value
        acc: dict[tuple[int, int], np.ndarray] = {}

        def flush():
            out = pd.DataFrame([(m, n, v if n == LOSS else v[:, used].ravel()) for (m, n), v in acc.items()], columns=["model", "node", "vec"])
            acc.clear()
            return out

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                m, bins, y, held, raw = _open_block(r, d)
                for k, side, at in _both(m):
                    if k not in growing:
                        continue
                    eta, v = raw[side, at], held[at]
                    if with_loss and v.any():
                        loss = np.logaddexp(0, eta[v]) - y[at][v] * eta[v]
                        acc[k, LOSS] = acc.get((k, LOSS), np.zeros(2)) + [loss.sum(), v.sum()]
                    tree, nodes = growing[k]
                    at, eta = at[~v], eta[~v]
                    cols = np.ascontiguousarray(bins[at].T)
                    p = 1 / (1 + np.exp(-np.clip(eta, -35, 35)))
                    g, h, leaf = p - y[at], p * (1 - p), tree.rows(cols, nodes)
                    if not leaf:
                        continue
                    # all nodes of a block in one count a feature
                    on = np.concatenate(list(leaf.values()))
                    slot = BINS * np.repeat(np.arange(len(leaf)), [len(a) for a in leaf.values()])
                    sums = np.empty((3, d, len(leaf) * BINS))
                    weights = g[on], h[on], None
                    for j in range(d):
                        flat = slot + cols[j][on]
                        for i, w in enumerate(weights):
                            sums[i, j] = np.bincount(flat, w, len(leaf) * BINS)
                    for i, n in enumerate(leaf):
                        acc[k, n] = acc.get((k, n), 0) + sums[:, :, i * BINS:(i + 1) * BINS].reshape(3, size)
                    if sum(a.nbytes for a in acc.values()) > FLUSH_BYTES:
                        yield flush()
        if acc:
            yield flush()

    def find(batches):
        for pdf in batches:
            out = []
            for model, node, vec in zip(pdf["model"], pdf["node"], pdf["vec"]):
                if node == LOSS:
                    out.append((model, node, -1, 0, False, 0.0, list(vec)))
                    continue
                dense = np.zeros((3, size))
                dense[:, used] = np.asarray(vec).reshape(3, -1)
                g, h, c = dense.reshape(3, d, BINS)
                total = [a[0].sum() for a in (g, h, c)]
                best = None
                for left in (False, True):  # missing values on the left
                    low = [np.cumsum(a[:, :-1], 1) + (a[:, -1:] if left else 0) for a in (g, h, c)]
                    high = [t - a for t, a in zip(total, low)]
                    gain = low[0] ** 2 / (low[1] + l2) + high[0] ** 2 / (high[1] + l2) - total[0] ** 2 / (total[1] + l2)
                    gain = np.where((low[2] >= min_leaf) & (high[2] >= min_leaf), gain, -np.inf)
                    f, cut = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[f, cut] > 1e-9 and (best is None or gain[f, cut] > best[5] + 1e-9):
                        best = (model, node, f, cut, left, gain[f, cut], [a[f, cut] for a in (*low, *high)])
                if best:
                    out.append(best)
            yield pd.DataFrame(out, columns=["model", "node", "feature", "cut", "missing_left", "gain", "sums"])

    part = blocks.mapInPandas(scan, "model int, node int, vec array<double>")
    total = part.groupBy("model", "node").agg(vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec"))
    return total.mapInPandas(find, _FOUND).collect()


def _stops(losses: list[float], patience: int, tol: float) -> bool:
    return len(losses) > patience and min(losses[-patience:]) > losses[-patience - 1] - tol


def fit_grouped(df: DataFrame, group: str, y: str, xs: list[str], ids: list[str], iterations: int = 200, leaves: int = 15,
                rate: float = 0.1, l2: float = 1.0, min_leaf: int = 20, max_bins: int = MISSING, share: float = 0.15,
                patience: int = 10, tol: float = 1e-7, seed=0, edges: list[list[float]] | None = None) -> Boosted:
    """A model of every group's rows and one of all rows. A group with one class only, or a null name, has none.
    With ``share`` 0 there are no validation rows and all ``iterations`` trees grow."""
    if not 2 <= max_bins <= MISSING:
        raise ValueError("max_bins is 2 to 255")
    df = df.where(F.col(group).isNotNull() & F.col(y).isNotNull())
    trained = (uniform(f"{seed}/validation", *ids) >= share) if share else F.lit(True)
    counts = df.where(trained).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos")).orderBy(group).collect()
    names = [None, *[r[group] for r in counts]]
    n = np.array([sum(r["n"] for r in counts), *[r["n"] for r in counts]], float)
    pos = np.array([sum(r["pos"] for r in counts), *[r["pos"] for r in counts]], float)
    fitted = (pos > 0) & (pos < n)
    mean = np.where(fitted, pos / np.maximum(n, 1), 0.5)
    bounds = [np.array(e, float) for e in edges] if edges is not None else _edges(df, xs, max_bins)
    model = Boosted(xs, bounds, names, np.log(mean / (1 - mean)), fitted, [[] for _ in names], ~fitted)
    blocks = _blocks(df, group, y, xs, ids, model, share, seed)
    d, held = len(xs), []
    losses: list[list[float]] = [[] for _ in names]
    for i in range(iterations):
        grown = {k: Tree() for k in np.flatnonzero(~model.stopped).tolist()}
        open_ = {k: [0] for k in grown}
        first = True
        while open_:
            found = _best_splits(blocks, {k: (grown[k], nodes) for k, nodes in open_.items()}, bounds, l2, min_leaf, first and share > 0)
            for r in found:
                if r["node"] == LOSS:
                    losses[r["model"]].append(r["sums"][0] / r["sums"][1])
            for k in list(open_):
                children = [] if first and _stops(losses[k], patience, tol) else _grow(
                    grown[k], [r for r in found if r["model"] == k and r["node"] != LOSS], leaves, rate, l2)
                if first and not children:  # enough trees, or no split that a further tree would find
                    model.stopped[k] = True
                    del grown[k]
                open_[k] = children
                if not children or grown[k].leaves() == leaves:
                    del open_[k]
            first = False
        for k, tree in grown.items():
            model.trees[k].append(tree)
        if model.stopped.all():
            break
        if i + 1 < iterations:
            blocks = _refreshed(blocks, grown, d)
            # held, so that a level applies no finished tree; written at times, so that what is lost can be made again in few steps
            if (i + 1) % REFRESH == 0:
                blocks = materialise(blocks)
                for b in held:
                    b.unpersist()
                held = []
            else:
                blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
                held.append(blocks)
    for b in held:
        b.unpersist()
    return model


def _grow(tree: Tree, splits: list, leaves: int, rate: float, l2: float) -> list[int]:
    """Make the splits of largest gain that the number of leaves allows; the new nodes."""
    able = sorted(splits, key=lambda r: (-r["gain"], r["node"]))[:leaves - tree.leaves()]
    children: list[int] = []
    for r in sorted(able, key=lambda r: r["node"]):
        gl, hl, _, gr, hr, _ = r["sums"]
        children += tree.split(r["node"], r["feature"], r["cut"], r["missing_left"], (-rate * gl / (hl + l2), -rate * gr / (hr + l2)))
    return children


def score_grouped(rows: DataFrame, group: str, model: Boosted) -> DataFrame:
    """Rows with ``p_local`` (their own group's model), ``p_ensemble`` (mean over all groups' models) and ``p_pooled``; null
    where there is no such model. Models go to the tasks in batches of bounded size."""
    xs, base, edges = model.xs, model.base, model.edges
    cost = np.cumsum([64 + sum(48 * len(t.feature) for t in ts) for ts in model.trees])
    batch = (cost // STATE_BYTES).astype(int)
    usable = np.flatnonzero(model.fitted).tolist()
    cur = rows.select("*", F.lit(None).cast("double").alias("p_local"), F.lit(0.0).alias("__sum"), F.lit(None).cast("double").alias("p_pooled"))
    schema = cur.schema
    for b in np.unique(batch):
        part = {k: (model.names[k], base[k], model.trees[k]) for k in usable if batch[k] == b}
        shared = rows.sparkSession.sparkContext.broadcast(part)

        def scan(batches, shared=shared):
            for pdf in batches:
                bins = _binned(pdf[xs].to_numpy(dtype=float), edges)
                own, total, pooled = (pdf[c].to_numpy(float, na_value=np.nan).copy() for c in ("p_local", "__sum", "p_pooled"))
                at = pdf[group].to_numpy()
                for k, (name, start, trees) in shared.value.items():
                    eta = np.full(len(bins), start)
                    for t in trees:
                        eta += t.scores(bins)
                    p = 1 / (1 + np.exp(-eta))
                    if k == POOLED:
                        pooled = p
                    else:
                        total += p
                        own = np.where(at == name, p, own)
                yield pdf.assign(p_local=own, __sum=total, p_pooled=pooled)

        cur = cur.mapInPandas(scan, schema)
    groups = len([k for k in usable if k != POOLED])
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return cur.select(*rows.columns, clean("p_local").alias("p_local"),
                      (F.when(F.lit(groups > 0), F.col("__sum") / max(groups, 1))).alias("p_ensemble"), clean("p_pooled").alias("p_pooled"))
