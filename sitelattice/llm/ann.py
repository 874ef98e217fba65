"""Approximate nearest neighbours by a permutation index.

``n_pivots`` mutually distant vectors of a bounded sample (those with the least hash of their id) serve as
pivots, so that a group of near copies takes few of them. Every vector is represented by its ``depth`` nearest
pivots in order. An index block holds an inverted file: for each pivot the vectors that have it, with its place in
their order. A query walks the lists of its own pivots and gathers the footrule distance of the two orders (a pivot
that one side lacks counts as place ``depth``); every vector within a footrule ``cut`` is compared by the true cosine,
in double precision. Nothing caps the candidates.

The cut is learned from the same sample: it is the footrule within which the share ``recall`` of the sample's nearest
neighbours lie, and the neighbours of the whole table are nearer than those of the sample. Where orders of pivots tell
little (many dimensions without structure) the cut is so wide that most vectors are compared; where vectors lie in
groups it spares most. Ties in cosine go to the smaller id.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows
without id, take no part; only vectors of equal dimension are compared; rows with the query's id
are its own and no candidates; a repeated id counts once, with its best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelattice.llm.common import materialise
from sitelattice.llm.vectors import best, blocks, search, usable

FIELDS = ["ids", "data", "post_rows", "post_places", "post_starts", "pivots", "cut"]
#: Rows of the sample whose neighbours within it tell the cut.
ASKED = 256


def nearest_pivots(matrix: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Row numbers of each vector's nearest pivots, nearest first, ties to the smaller number."""
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :depth]


def distant(unit: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` of the unit rows, each the one least like all taken before; none equal to one taken."""
    taken, near = [0], unit @ unit[0]
    while len(taken) < n:
        i = int(np.argmin(near))
        if near[i] > 1 - 1e-9:
            break
        taken.append(i)
        near = np.maximum(near, unit @ unit[i])
    return unit[taken]


def footrules(order: np.ndarray, others: np.ndarray, n_pivots: int, depth: int) -> np.ndarray:
    """Footrule distances of each order (rows) to each of the others (columns)."""
    places = np.full((len(others), n_pivots), depth, np.int32)
    np.put_along_axis(places, others, np.arange(others.shape[1], dtype=np.int32)[None, :], 1)
    own = np.arange(order.shape[1])
    most = 2 * int((depth - own).sum())
    return np.array([most - 2 * (depth - np.maximum(own, places[:, o])).sum(1) for o in order])


def learned_cut(sample: np.ndarray, pivots: np.ndarray, depth: int, k: int, recall: float) -> int:
    """The footrule within which the share ``recall`` of the k nearest of some sampled rows lie; beyond any footrule
    (all vectors are compared) if the share is 1 or the sample is too small to tell."""
    asked = sample[:ASKED]
    if recall >= 1 or len(sample) <= 4 * k:
        return np.iinfo(np.int64).max
    order = nearest_pivots(sample, pivots, depth)
    cosine = asked @ sample.T
    cosine[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argpartition(-cosine, k, axis=1)[:, :k]
    found = np.take_along_axis(footrules(order[:len(asked)], order, len(pivots), depth), near, 1)
    return int(np.quantile(found, recall, method="higher"))


def sample_pivots(vectors: DataFrame, n: int, depth: int, k: int, recall: float) -> dict[int, tuple[np.ndarray, int]]:
    """Unit pivots and the cut by dimension, from one collected sample of at most ``8 n`` distinct rows."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(8 * n).collect()
    by_dim: dict[int, dict] = {}
    for r in rows:
        v = np.array(r["vec"], float)
        by_dim.setdefault(len(v), {})[v.tobytes()] = v / np.linalg.norm(v)
    out = {}
    for d, found in by_dim.items():
        sample = np.array(list(found.values()))
        pivots = distant(sample, n)
        out[d] = pivots, learned_cut(sample, pivots, depth, k, recall)
    return out


def build_index(vectors: DataFrame, n_pivots: int, depth: int, block_rows: int, k: int, recall: float) -> DataFrame:
    pivots = sample_pivots(vectors, n_pivots, depth, k, recall)

    def build(ids: np.ndarray, matrix: np.ndarray) -> dict[str, bytes]:
        # a dimension that the sample lacks is rare: one of its vectors serves as pivot, and all are compared
        own, cut = pivots.get(matrix.shape[1], (matrix[:1] / np.linalg.norm(matrix[:1]), np.iinfo(np.int64).max))
        order = nearest_pivots(matrix, own, depth)
        pivot, row = order.ravel(), np.repeat(np.arange(len(ids)), order.shape[1])
        place = np.tile(np.arange(order.shape[1]), len(ids))
        by = np.argsort(pivot, kind="stable")
        starts = np.searchsorted(pivot[by], np.arange(len(own) + 1))
        return {"ids": ids.astype("<i8").tobytes(), "data": matrix.astype("<f8").tobytes(),
                "post_rows": row[by].astype("<i4").tobytes(), "post_places": place[by].astype("<i4").tobytes(),
                "post_starts": starts.astype("<i8").tobytes(), "pivots": own.astype("<f8").tobytes(),
                "cut": np.array([cut], "<i8").tobytes()}

    return materialise(blocks(vectors, block_rows, build, FIELDS))


def _finder(k: int, depth: int):
    def find(q_ids: np.ndarray, q: np.ndarray, block: dict) -> Iterator[tuple]:
        ids = np.frombuffer(block["ids"], "<i8")
        data = np.frombuffer(block["data"], "<f8").reshape(len(ids), -1)
        rows, places = np.frombuffer(block["post_rows"], "<i4"), np.frombuffer(block["post_places"], "<i4")
        starts = np.frombuffer(block["post_starts"], "<i8")
        pivots = np.frombuffer(block["pivots"], "<f8").reshape(-1, data.shape[1])
        norms, q_norms = np.sqrt((data * data).sum(1)), np.sqrt((q * q).sum(1))
        n = len(ids)
        cut = np.frombuffer(block["cut"], "<i8")[0]
        for qi, order in enumerate(nearest_pivots(q, pivots, depth)):
            spans = [slice(starts[p], starts[p + 1]) for p in order]
            listed = np.concatenate([rows[s] for s in spans])
            near = np.concatenate([depth - np.maximum(i, places[s]) for i, s in enumerate(spans)])
            most = 2 * int((depth - np.arange(len(order))).sum())
            footrule = most - 2 * np.bincount(listed, near, n)  # whole numbers
            chosen = np.flatnonzero((footrule <= cut) & (ids != q_ids[qi]))
            scores = (data[chosen] * q[qi]).sum(1) / (norms[chosen] * q_norms[qi])
            top = best(ids[chosen], scores, k)
            yield q_ids[qi], ids[chosen][top], scores[top]
    return find


def nearest(vectors: DataFrame, asked: Column, k: int = 5, n_pivots: int = 512, depth: int = 64,
            recall: float = 0.97, block_rows: int = 8192, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (cosine): the k nearest found for every row where ``asked`` (a
    condition on a column ``id``) holds."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    own = own.where(F.col("id").isNotNull() & usable(F.col("vec"))
                    & F.exists("vec", lambda x: x != 0)).withColumn("vec", F.col("vec").cast("array<double>"))
    index = build_index(own, n_pivots, depth, block_rows, k, recall)
    return search(index, own.where(asked), FIELDS, k, _finder(k, depth), "double")
