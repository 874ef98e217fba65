"""Discrimination, calibration and interval estimates for grouped scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelattice.functions.scalars import EPS, clip, logit
from sitelattice.operators.ordered import _same
from sitelattice.session import materialise

# Two-sided 95 % Student t quantiles by degrees of freedom 1..30.
T975 = [12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004,
        2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905,
        2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899,
        2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272]


#: Ranges of scores that a group is cut into; its rows are ordered range by range.
SCORE_RANGES = 512


def t_quantile_975(df: Column) -> Column:
    """t quantile: table up to 30 degrees of freedom, series expansion beyond."""
    z = 1.959963984540054
    v = df.cast("double")
    tail = (z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v * v)
            + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v * v * v))
    table = F.array(*[F.lit(t) for t in T975])
    return F.when(df <= 30, F.element_at(table, F.greatest(df.cast("int"), F.lit(1)))).otherwise(tail)


def score_metrics(df: DataFrame, groups: list[str], y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """AUROC, average precision, prevalence, accuracy, Brier and counts per group.

    Rows first collapse to one cell per (group, score); ties are handled exactly.
    Discrimination is NULL where a group has one class. With ``weight`` a row stands for that many rows.

    A group is cut into ranges of scores of equal width. The sums of the ranges, which are few, say how
    many rows lie above a range; a row then moves once, to its range, and nothing is written.
    """
    # a missing score counts nowhere; a filter would have every score worked out once more
    s = df.select(*groups, F.when(F.col(p).isNotNull(), clip(F.col(p), EPS, 1 - EPS).cast("double")).alias("__p"), F.col(y).alias("__y"),
                  *([F.col(weight).alias("__w")] if weight else []))
    s = s.withColumn("__s", F.floor(F.col("__p") * SCORE_RANGES).cast("int"))
    part = [*groups, "__s"]
    over = Window.partitionBy(*[F.col(g) for g in groups]) if groups else Window.partitionBy(F.lit(0))  # ranges, not rows
    higher = over.orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("__p").isNotNull()
    own = F.count("__p"), F.coalesce(F.sum(F.when(known, F.col("__y"))), F.lit(0))
    if weight:
        own = tuple(F.coalesce(F.sum(F.when(known, c)), F.lit(0)) for c in (F.col("__w"), F.col("__y") * F.col("__w")))
    ranges = s.groupBy(*part).agg(own[0].alias("__n"), own[1].alias("__k")).select(
        *part, F.sum("__n").over(over).alias("__nt"), F.sum("__n").over(higher).alias("__na"), F.sum("__k").over(higher).alias("__ka"))
    cells = s.repartition(*part).groupBy(*part, "__p").agg(own[0].alias("n"), own[1].alias("pos"))
    before = Window.partitionBy(*part).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    run = cells.select(*part, "__p", "n", "pos", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__b{c}") for c in ("n", "pos")])
    run = run.alias("c").join(ranges.alias("t"), _same(part, "c", "t")).select("c.*", "t.__nt", "t.__na", "t.__ka")
    neg = F.col("n") - F.col("pos")
    above_n, above_pos = F.col("__na") - F.col("__bn"), F.col("__ka") - F.col("__bpos")
    rank = F.col("__nt") - above_n + (F.col("n") + 1) / 2.0
    right = F.when(F.col("__p") >= 0.5, F.col("pos")).otherwise(neg)
    agg = run.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("n_positive"),
        F.sum(F.col("pos") * rank).alias("__rs"),
        F.sum(F.try_divide(F.col("pos") * above_pos, above_n)).alias("__ap"),
        F.sum(F.col("pos") * (1 - F.col("__p")) * (1 - F.col("__p"))
              + neg * F.col("__p") * F.col("__p")).alias("__br"),
        F.sum(right).alias("__ok")).where("n > 0")
    n, pos = F.col("n").cast("double"), F.col("n_positive").cast("double")
    both = (pos > 0) & (pos < n)
    return agg.select(
        *groups, "n", "n_positive",
        F.when(both, (F.col("__rs") - pos * (pos + 1) / 2) / (pos * (n - pos))).alias("auroc"),
        F.when(both, F.col("__ap") / pos).alias("auprc"),
        (pos / n).alias("prevalence"), (F.col("__ok") / n).alias("accuracy"),
        (F.col("__br") / n).alias("brier"))


def calibration_cells(df: DataFrame, groups: list[str], y: str, p: str) -> DataFrame:
    """Scores collapsed to (group, logit score) with row and positive counts."""
    return (df.withColumn("__l", logit(F.col(p)))
            .groupBy(*groups, "__l").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos")))


def _newton_by_group(cells: DataFrame, start: DataFrame, groups: list[str], advance, steps: int) -> DataFrame:
    """Repeat ``advance(cells joined with the state)`` until no group moves by 1e-10.

    The state (groups, parameters, ``moved``) is a table, written after each step; only the
    largest move reaches the driver. Groups that still move after ``steps`` have a larger ``moved``.
    """
    state = materialise(start.withColumn("moved", F.lit(float("inf"))))
    for _ in range(steps):
        cond = F.lit(True)
        for g in groups:
            cond = cond & F.col(f"c.{g}").eqNullSafe(F.col(f"t.{g}"))
        extra = [c for c in state.columns if c not in groups]
        met = cells.alias("c").join(state.alias("t"), cond).select("c.*", *[F.col(f"t.{c}") for c in extra])
        state = materialise(advance(met))
        if (state.agg(F.max("moved")).first()[0] or 0.0) < 1e-10:
            break
    return state.withColumn("converged", F.col("moved") < 1e-10)


def calibration_line(df: DataFrame, groups: list[str], y: str = "y", p: str = "p",
                     c: float = math.inf, steps: int = 25) -> DataFrame:
    """Slope and intercept of y on logit(p); penalty ``0.5*slope^2 + C*loss`` if C is finite.

    Newton steps on the collapsed score cells, for all groups in one job a step; ``converged``
    tells whether the last step moved by less than 1e-10. A group of one class is left out.
    """
    ridge = 0.0 if math.isinf(c) else 1.0 / c
    cells = materialise(calibration_cells(df, groups, y, p))
    start = cells.groupBy(*groups).agg(F.sum("pos").alias("P"), F.sum("n").alias("N")).where(
        (F.col("P") > 0) & (F.col("P") < F.col("N"))).select(
        *groups, F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))

    def advance(met: DataFrame) -> DataFrame:
        q = 1.0 / (1.0 + F.exp(-clip(F.col("a") + F.col("b") * F.col("__l"), -35, 35)))
        w, r, x = F.col("n") * q * (1 - q), F.col("pos") - F.col("n") * q, F.col("__l")
        sums = met.groupBy(*groups, "a", "b").agg(
            F.sum(r).alias("g0"), (F.sum(r * x) - ridge * F.col("b")).alias("g1"), F.sum(w).alias("h0"),
            F.sum(w * x).alias("h1"), (F.sum(w * x * x) + ridge).alias("h2"))
        det = F.col("h0") * F.col("h2") - F.pow("h1", F.lit(2.0))
        solve = lambda e: F.when(det > 1e-12, F.expr(e) / det).otherwise(0.0)
        moved = sums.withColumn("da", solve("g0 * h2 - g1 * h1")).withColumn("db", solve("g1 * h0 - g0 * h1"))
        return moved.select(*groups, (F.col("a") + F.col("da")).alias("a"), (F.col("b") + F.col("db")).alias("b"),
                            F.greatest(F.abs("da"), F.abs("db")).alias("moved"))

    fitted = _newton_by_group(cells, start, groups, advance, steps)
    return fitted.select(*groups, F.col("b").alias("slope"), F.col("a").alias("intercept"), "converged")


def calibration_in_the_large(df: DataFrame, groups: list[str], y: str = "y", p: str = "p",
                             steps: int = 200) -> DataFrame:
    """Intercept shift at fixed slope: Newton damped to +-1 and bounded at +-20, with ``converged``."""
    cells = materialise(calibration_cells(df, groups, y, p))

    def advance(met: DataFrame) -> DataFrame:
        q = 1.0 / (1.0 + F.exp(-clip(F.col("__l") + F.col("shift"), -35, 35)))
        sums = met.groupBy(*groups, "shift").agg(F.sum(F.col("pos") - F.col("n") * q).alias("g"),
                                                 F.sum(F.col("n") * q * (1 - q)).alias("h"))
        step = F.when(F.col("h") < 1e-8, 0.0).otherwise(clip(F.col("g") / F.col("h"), -1.0, 1.0))
        to = clip(F.col("shift") + step, -20.0, 20.0)
        # at a bound the shift stays, however long the step
        return sums.select(*groups, to.alias("shift"), F.abs(to - F.col("shift")).alias("moved"))

    start = cells.select(*groups).distinct().withColumn("shift", F.lit(0.0))
    return _newton_by_group(cells, start, groups, advance, steps).select(*groups, "shift", "converged")


def expected_calibration_error(df: DataFrame, groups: list[str], y: str = "y", p: str = "p",
                               bins: int = 10) -> DataFrame:
    """Row-weighted gap between mean outcome and mean score over equal-width bins."""
    b = df.withColumn("__b", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    cell = b.groupBy(*groups, "__b").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(p).alias("sp"))
    return cell.groupBy(*groups).agg(
        (F.sum(F.abs(F.col("sy") - F.col("sp"))) / F.sum("n")).alias("ece"),
        F.sum("n").alias("n"))


def logit_interval(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """95 % t-interval of a bounded metric on the logit scale, back-transformed."""
    z = logit(F.col(value))
    a = df.groupBy(*groups).agg(F.avg(z).alias("m"), F.stddev_samp(z).alias("s"),
                                F.count(z).alias("n")).where("n >= 2")
    half = t_quantile_975(F.col("n") - 1) * F.col("s") / F.sqrt(F.col("n"))
    return a.select(*groups, "n",
                    (1 / (1 + F.exp(-(F.col("m") - half)))).alias("lo"),
                    (1 / (1 + F.exp(-(F.col("m") + half)))).alias("hi"))
