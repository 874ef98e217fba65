"""Screens for columns whose presence or value gives the outcome away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.operators.matrix import to_long
from sitelattice.operators.ordered import running_by_value


class LeakageError(ValueError):
    """A column reveals the outcome."""


def observation_rate_by_class(df: DataFrame, xs: list[str], y: str = "y",
                              strata: list[str] | None = None) -> DataFrame:
    """(strata, var, rate_pos, rate_neg, gap) from one aggregate over the rows."""
    g = strata or []
    agg = df.groupBy(*g).agg(
        F.count_if(F.col(y) == 1).alias("np"), F.count_if(F.col(y) == 0).alias("nn"),
        *[e for j, x in enumerate(xs) for e in (
            F.count(F.when(F.col(y) == 1, F.col(x))).alias(f"p{j}"),
            F.count(F.when(F.col(y) == 0, F.col(x))).alias(f"q{j}"))])
    cells = F.array(*[F.struct(
        F.lit(j).alias("var"),
        F.try_divide(F.col(f"p{j}"), F.col("np")).alias("rate_pos"),
        F.try_divide(F.col(f"q{j}"), F.col("nn")).alias("rate_neg")) for j in range(len(xs))])
    out = agg.select(*g, (F.col("np") + F.col("nn")).alias("n"), F.inline(cells))
    return out.withColumn("gap", F.abs(F.col("rate_pos") - F.col("rate_neg")))


def missingness_leaks(df: DataFrame, xs: list[str], y: str = "y", strata: list[str] | None = None,
                      max_gap: float = 0.5, min_rows: int = 100) -> DataFrame:
    """Columns over the gap; strata that are small or have one class are not judged."""
    r = observation_rate_by_class(df, xs, y, strata)
    judged = F.col("gap").isNotNull()
    if strata:
        judged = judged & (F.col("n") >= min_rows)
    return r.where(judged & (F.col("gap") >= max_gap))


def assert_no_missingness_leak(df: DataFrame, xs: list[str], y: str = "y",
                               strata: list[str] | None = None, max_gap: float = 0.5) -> None:
    """Raise if a column's observation rate separates the classes, overall or in a stratum."""
    both = df.agg(F.count_distinct(y).alias("k")).first()["k"]
    if both < 2:
        raise ValueError("need both classes present to assess leakage")
    for s in ([None, strata] if strata else [None]):
        bad = missingness_leaks(df, xs, y, s, max_gap).collect()  # at most strata x columns
        if bad:
            names = ", ".join(sorted({xs[b["var"]] for b in bad}))
            raise LeakageError(f"outcome-conditional missingness in: {names}")


def value_leakage_report(df: DataFrame, xs: list[str], y: str = "y",
                         min_observed: int = 30) -> DataFrame:
    """(var, auroc, n_observed, skipped): univariate AUROC of observed values, folded at 0.5.

    Every column appears; one with too few rows or one class is marked skipped.
    """
    run = running_by_value(to_long(df, [y], xs), ["var"], "value",
                           {"n": F.lit(1), "pos": F.col(y)})
    rank = F.col("n_before") + (F.col("n") + 1) / 2.0
    agg = run.groupBy("var").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"),
                                 F.sum(F.col("pos") * rank).alias("rs"))
    names = df.sparkSession.range(len(xs)).select(F.col("id").cast("int").alias("var"))
    j = names.join(agg, "var", "left")
    n, pos = F.coalesce("n", F.lit(0)), F.coalesce("pos", F.lit(0)).cast("double")
    neg = n - pos
    skipped = (n < min_observed) | (pos == 0) | (neg == 0)
    auc = F.when(~skipped, (F.col("rs") - pos * (pos + 1) / 2) / (pos * neg))
    return j.select("var", F.greatest(auc, 1 - auc).alias("auroc"), n.alias("n_observed"),
                    skipped.alias("skipped")).orderBy(F.desc_nulls_last("auroc"), "var")


def value_leaks(df: DataFrame, xs: list[str], y: str = "y", max_auroc: float = 0.90,
                min_observed: int = 30) -> DataFrame:
    r = value_leakage_report(df, xs, y, min_observed)
    return r.where(~F.col("skipped") & (F.col("auroc") >= max_auroc))


def assert_no_value_leak(df: DataFrame, xs: list[str], y: str = "y", max_auroc: float = 0.90,
                         min_observed: int = 30) -> None:
    bad = value_leaks(df, xs, y, max_auroc, min_observed).collect()  # at most one row per column
    if bad:
        names = ", ".join(f"{xs[b['var']]} ({b['auroc']:.4f})" for b in bad)
        raise LeakageError(f"values alone predict the outcome: {names}")
