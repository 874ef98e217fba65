"""Metrics of many models over the same rows against the metrics of a row per score."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitelattice.operators import blockmetrics as BM
from sitelattice.operators.metrics import score_metrics
from sitelattice.operators.sitemodels import score_raw, score_std

XS = ["x0", "x1"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 3000
    x = np.round(rng.normal(size=(n, 2)) * 8) / 8  # ties; sums of eighths are exact, so that no library's exp decides on them
    x[rng.random((n, 2)) < 0.2] = np.nan
    unit = np.where(np.arange(n) % 3 > 0, "a", "b")
    y = (rng.random(n) < np.where(np.nan_to_num(x[:, 0]) > 0, 0.5, 0.2)).astype(int)
    y[unit == "b"] = 0  # one class only
    pdf = pd.DataFrame({"unit": unit, "y": y, "x0": x[:, 0], "x1": x[:, 1]})
    return spark.createDataFrame(pdf).replace(float("nan"), None)


def _same(got, want, keys):
    cols = [*keys, "n", "n_positive", "auroc", "auprc", "prevalence", "accuracy", "brier"]
    got, want = (d.select(*cols).toPandas().sort_values(keys).reset_index(drop=True) for d in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)


@pytest.mark.parametrize("group", [50_000, 100])
def test_standardised_models(spark, rows, monkeypatch, group):
    monkeypatch.setattr(BM, "GROUP", group)
    monkeypatch.setattr(BM, "ROWS", 700)
    models = spark.createDataFrame([("a", "d1", 0.0, -0.5, [1.0, 0.25], [0.125, 0.0], [1.0, 2.0]), ("a", "d1", 0.5, 0.0, [0.0, None], [0.0, None], [1.0, None]),
                                    ("b", "d2", 0.0, 40.0, [1.0, 1.0], [0.0, 0.0], [1.0, 1.0]), ("c", "d3", 0.0, 0.0, [1.0, 1.0], [0.0, 0.0], [1.0, 1.0])],
                                   "unit string, decision string, w double, intercept double, __coef array<double>, __mu array<double>, __sd array<double>")
    j = rows.join(models, "unit")
    want = score_metrics(j.select("decision", "w", "y", score_std(j, XS, F.col("intercept")).alias("p")), ["decision", "w"])
    _same(BM.linear_metrics(rows, models, ["decision", "w"], "unit", "y", XS), want, ["decision", "w"])


def test_raw_models(spark, rows):
    models = spark.createDataFrame([("a", -0.5, [1.0, 0.25], [0.125, 0.0]), ("b", 0.125, [None, -2.0], [None, 0.5])],
                                   "unit string, raw_b double, __raw array<double>, __mu array<double>")
    j = rows.join(models, "unit")
    want = score_metrics(j.select("unit", "y", score_raw(j, XS, F.col("raw_b")).alias("p")), ["unit"])
    _same(BM.linear_metrics(rows, models, ["unit"], "unit", "y", XS, "raw"), want, ["unit"])


def test_no_row_a_score(spark, rows):
    """300 models over the same rows send a value a task and group, not a row a score."""
    models = spark.createDataFrame([("a", i, i / 100, [1.0, 0.3], [0.1, 0.0], [1.0, 2.0]) for i in range(300)],
                                   "unit string, i int, intercept double, __coef array<double>, __mu array<double>, __sd array<double>")
    sent = []
    finish = BM._finish
    BM._finish, keep = (lambda r, above: (sent.append(r.count()), finish(r, above))[1]), finish
    try:
        assert BM.linear_metrics(rows.coalesce(2), models, ["i"], "unit", "y", XS).count() == 300
    finally:
        BM._finish = keep
    assert sum(sent) <= 600


def test_no_models(spark, rows):
    models = spark.createDataFrame([], "unit string, i int, intercept double, __coef array<double>, __mu array<double>, __sd array<double>")
    assert BM.linear_metrics(rows, models, ["i"], "unit", "y", XS).count() == 0


def test_dimension_ladder_splits_once(spark, small, monkeypatch):
    from sitelattice.plans import decision_table as DT
    from sitelattice.suite import models
    calls, real = [], DT.split_rows
    monkeypatch.setattr(DT, "split_rows", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    assert models.dimension_ladder(spark, small).count() == 2
    assert len(calls) == 1


def test_local_scores_without_a_row_a_score(spark, small, monkeypatch):
    from sitelattice.suite import models
    monkeypatch.setattr(models.SM, "score_local", None)
    assert models.local_scores(spark, small).count() > 0


def test_weighted_rows_score_like_repeated_ones(spark):
    from pyspark.sql import functions as F
    from sitelattice.operators.metrics import score_metrics
    rows = spark.createDataFrame([("a", 0.2, 0, 3), ("a", 0.2, 1, 2), ("a", 0.7, 1, 5), ("a", 0.9, 0, 1), ("a", None, 1, 4)], "g string, p double, y int, w long")
    many = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    a, b = (list(x.first()) for x in (score_metrics(rows, ["g"], weight="w"), score_metrics(many, ["g"])))
    assert a[1:3] == b[1:3] == [11, 7] and max(abs(x - y) for x, y in zip(a[3:], b[3:])) < 1e-12
