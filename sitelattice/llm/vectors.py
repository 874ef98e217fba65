"""Vectors packed into blocks, and pairs of query and index blocks.

A block is one row: the ids and the matrix of about ``block_rows`` vectors as binaries. Rows go
to blocks by the hash of their id, so blocks are even whatever the vectors are. Only vectors of
equal dimension are compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelattice.llm.common import materialise

#: Query blocks that meet one copy of an index block in one task.
GROUP = 64


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component there and finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & whole, F.lit(False))


def blocks(vectors: DataFrame, block_rows: int, build: Callable[[np.ndarray, np.ndarray], dict[str, bytes]],
           fields: list[str]) -> DataFrame:
    """(block, dim, *fields) from rows (id long, vec array<double>): ``build(ids, matrix)`` makes a
    block's binaries; its rows come in the order of ids, repeated ids included. ``block`` counts from 0."""
    n = max(1, -(-vectors.count() // block_rows))
    keyed = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("dim", F.size("vec"))

    def pack(t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        flat = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        made = build(ids[order], flat.reshape(len(ids), -1)[order])
        names = ["block", "dim", *fields]
        return pa.table([pa.array([t["block"][0].as_py()], pa.int32()), pa.array([t["dim"][0].as_py()], pa.int32()),
                         *[pa.array([made[f]], pa.binary()) for f in fields]], names=names)

    schema = "block int, dim int, " + ", ".join(f"{f} binary" for f in fields)
    return keyed.groupBy("block", "dim").applyInArrow(pack, schema)


def plain(ids: np.ndarray, matrix: np.ndarray) -> dict[str, bytes]:
    return {"ids": ids.astype("<i8").tobytes(), "data": matrix.astype("<f8").tobytes()}


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id; an id counts once."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def search(index: DataFrame, queries: DataFrame, fields: list[str], k: int, find: Callable, kind: str,
           query_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: every query block meets every index block of its dimension;
    each meeting returns at most ``k`` rows a query, and the k best of these stay.

    ``find(query_ids, query_matrix, block)`` yields (query id, ids, scores); ``block`` is a dict of
    the index row's binaries.
    """
    n = (index.agg(F.max("block")).first()[0] or 0) + 1
    asked = materialise(blocks(queries, query_rows, plain, ["ids", "data"]))
    groups = ((asked.agg(F.max("block")).first()[0] or 0) + GROUP) // GROUP
    asked = asked.select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
                         F.floor(F.col("block") / GROUP).cast("int").alias("q_group"),
                         F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    copies = index.withColumn("q_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    score = {"double": pa.float64(), "long": pa.int64()}[kind]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", score)])

    def run(block: pa.Table, meets: pa.Table) -> pa.Table:
        out = []
        for row in block.select(["dim", *fields]).to_pylist() if meets.num_rows else []:
            for r in range(meets.num_rows):
                q_ids = np.frombuffer(meets["q_ids"][r].as_py(), "<i8")
                matrix = np.frombuffer(meets["q_data"][r].as_py(), "<f8").reshape(len(q_ids), row["dim"])
                out += [(np.full(len(i), q), i, s) for q, i, s in find(q_ids, matrix, row) if len(i)]
        if not out:
            return schema.empty_table()
        q, i, s = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, score)], schema=schema)

    # grouped on both sides: a block goes to Python once for all queries of its group, and neither side is ever broadcast,
    # which the files' sizes would tell Spark to do though every query block is copied for every index block
    keys = ["block", "dim", "q_group"]
    found = copies.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, f"query_id long, vec_id long, score {kind}")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
