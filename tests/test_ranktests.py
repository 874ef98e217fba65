"""Signed-rank p-values of few pairs against all assignments of signs."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from sitelattice.operators import ranktests as RT


@pytest.mark.parametrize("diffs", [[1.0, -2.0, 3.0, 4.0, 5.0, 6.0], [0.5, 1.5, -2.5, 3.5], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, -7.0, 8.0]])
def test_exact_p_counts_sign_assignments(spark, diffs):
    n = len(diffs)
    ranks = {a: i + 1 for i, a in enumerate(sorted(map(abs, diffs)))}
    up = sum(ranks[d] for d in diffs if d > 0)
    w = min(up, n * (n + 1) // 2 - up)
    at_most = sum(sum(r for r, s in zip(range(1, n + 1), signs) if s) <= w for signs in product((0, 1), repeat=n))
    row = RT.signed_rank(spark.createDataFrame([("m", d) for d in diffs], "g string, d double"), ["g"], "d").first()
    assert row["exact"] and row["p"] == pytest.approx(min(1.0, 2 * at_most / 2**n))


@pytest.mark.parametrize("diffs", [[1.0, -1.0, 2.0], [0.0, 1.0, 2.0], [float(i) for i in range(1, 52)]])
def test_ties_zeros_and_many_pairs_use_the_normal_tail(spark, diffs):
    row = RT.signed_rank(spark.createDataFrame([("m", d) for d in diffs], "g string, d double"), ["g"], "d").first()
    assert not row["exact"] and 0 <= row["p"] <= 1


def test_rank_sums_beyond_32_bits(spark):
    d = spark.range(140_000).select(F.lit("m").alias("g"), ((F.col("id") + 1) * F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).cast("double").alias("d"))
    row = RT.signed_rank(d, ["g"], "d").first()
    assert not row["exact"] and row["w_plus"] + row["w_minus"] == 140_000 * 140_001 / 2
