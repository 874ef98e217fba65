"""Exact top-k inner products by columnar branch and bound.

A block keeps its vectors dimension by dimension (vertical layout), with the mass (Euclidean norm)
that remains after every few dimensions. A query block adds up the inner products over one group of
dimensions after the other. After each group the k rows with the largest sums are scored in full; the least of these
scores is a lower bound of the k-th largest. It is compared with the upper bounds (sum plus the largest
possible rest, the product of both remaining masses); vectors below it are dropped and, once few are left, the
survivors are moved together. What survives all groups has its exact score.

Scores are integers: components are turned to floor(scale * x). Sums are held in doubles where
they stay below 2**53, which makes them exact, and in Python's integers otherwise.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows without
id, take no part; only vectors of equal dimension are compared; rows with the query's id are its own
and no candidates; a repeated id counts once, with its best score; ties go to the smaller id; scores
beyond 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelattice.llm.common import materialise
from sitelattice.llm.vectors import best, blocks, search, usable

FIELDS = ["ids", "columns", "rest"]
STEP = 16
#: Share of a block's rows below which a query's survivors are moved together.
FEW = 1 / 8
#: Bounds are widened by this share, above what rounding of their few operations can cost.
ROUNDING = 1e-9


def columnar(ids: np.ndarray, matrix: np.ndarray) -> dict[str, bytes]:
    """The block's binaries: ids, vertical components, and remaining mass per group of dimensions."""
    squares = matrix * matrix
    rest = [np.sqrt(squares[:, d:].sum(1)) for d in range(STEP, matrix.shape[1], STEP)]
    return {"ids": ids.astype("<i8").tobytes(), "columns": np.ascontiguousarray(matrix.T, "<f8").tobytes(),
            "rest": np.array(rest, "<f8").tobytes()}


def _exact_scores(q: np.ndarray, columns: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Inner products in Python's integers, for components too large for doubles."""
    return np.array([sum(int(a) * int(b) for a, b in zip(q, columns[:, i])) for i in kept], object)


def _finder(k: int):
    def find(q_ids: np.ndarray, q: np.ndarray, block: dict) -> Iterator[tuple]:
        ids = np.frombuffer(block["ids"], "<i8")
        columns = np.frombuffer(block["columns"], "<f8").reshape(-1, len(ids))
        dim, n = len(columns), len(ids)
        rest = np.frombuffer(block["rest"], "<f8").reshape(-1, n)
        largest = float(np.abs(columns).max(initial=0)) * float(np.abs(q).max(initial=0)) * dim
        kept, scores = {}, {}
        if largest < 2.0**53:
            kept, scores = _survivors(q_ids, q, ids, columns, rest, k, len(np.unique(ids)) == n)
        for qi in range(len(q_ids)):
            if largest >= 2.0**53:
                kept[qi] = np.flatnonzero(ids != q_ids[qi])
                scores[qi] = _exact_scores(q[qi], columns, kept[qi])
            top = best(ids[kept[qi]], scores[qi], k)
            yield q_ids[qi], ids[kept[qi]][top], np.array([int(x) for x in scores[qi][top]], np.int64)
    return find


def _survivors(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, columns: np.ndarray, rest: np.ndarray, k: int,
               bounded: bool) -> tuple[dict, dict]:
    """By query, the rows that survive all groups of dimensions and their exact scores. All queries add up a group in one
    product as long as most rows stay; a query whose rows are few moves them together and goes on with these alone."""
    n, dim = len(ids), len(columns)
    kept: dict[int, np.ndarray] = {}
    scores: dict[int, np.ndarray] = {}
    sums = q[:, :STEP] @ columns[:STEP]
    least = np.full(len(q), -np.inf)
    enough = np.zeros(len(q), bool)
    for i in range(len(q)):
        own = ids == q_ids[i]
        sums[i, own] = -np.inf
        enough[i] = bounded and n - own.sum() > k

    def raised(i: int, partial: np.ndarray, rows: np.ndarray | None) -> float:
        """What k rows reach in full is a lower bound of the k-th largest score."""
        first = np.argpartition(partial, len(partial) - k)[len(partial) - k:]
        low = (q[i] @ columns[:, first if rows is None else rows[first]]).min()
        return max(least[i], low - ROUNDING * abs(low))

    whole = np.arange(len(q))
    for g, d in enumerate(range(STEP, dim, STEP)):
        mass = np.sqrt((q[:, d:] ** 2).sum(1)) * (1 + ROUNDING)
        for i in kept:
            least[i] = raised(i, scores[i], kept[i])
            stay = scores[i] + rest[g][kept[i]] * mass[i] >= least[i]
            kept[i], scores[i] = kept[i][stay], scores[i][stay]
        moved = np.zeros(len(whole), bool)
        for at, i in enumerate(whole):
            if enough[i]:
                least[i] = raised(i, sums[at], None)
                stay = sums[at] + rest[g] * mass[i] >= least[i]
                if np.count_nonzero(stay) <= n * FEW:
                    kept[i] = np.flatnonzero(stay)
                    scores[i] = sums[at, kept[i]]
                    moved[at] = True
        if moved.any():
            whole, sums = whole[~moved], sums[~moved]
        if len(whole):
            sums += q[whole, d:d + STEP] @ columns[d:d + STEP]
        for i in kept:
            scores[i] = scores[i] + q[i, d:d + STEP] @ columns[d:d + STEP, kept[i]]
    for at, i in enumerate(whole):
        kept[i] = np.flatnonzero((sums[at] >= least[i]) & (sums[at] > -np.inf))
        scores[i] = sums[at, kept[i]]
    for i in np.flatnonzero(enough):
        stay = scores[i] >= np.partition(scores[i], len(scores[i]) - k)[len(scores[i]) - k]
        kept[i], scores[i] = kept[i][stay], scores[i][stay]
    return kept, scores


def largest_products(vectors: DataFrame, asked: Column, k: int = 20, scale: int = 64, block_rows: int = 16_384,
                     id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products for every row where
    ``asked`` (a condition on a column ``id``) holds."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    own = own.where(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("vec", F.transform(
        F.col("vec").cast("array<double>"), lambda x: _floor(x, scale)))
    index = materialise(blocks(own, block_rows, columnar, FIELDS))
    return search(index, own.where(asked), FIELDS, k, _finder(k), "long")


def _floor(x: Column, scale: int) -> Column:
    """floor(scale * x) as a double; doubles from 2**52 on are whole already."""
    y = x * float(scale)
    return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
