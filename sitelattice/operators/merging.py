"""Coordinate-wise combination of site models and between-site heterogeneity.

``site_coef``: model_id, site, var, n, mu, sd, coef, raw, info.
``site_model``: model_id, site, n, intercept, raw_b.
All grouping keys go in ``keys`` (decision, seed, epsilon, ...).
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coordinate_merge(coef: DataFrame, keys: list[str], space: str = "std",
                     weight: str = "n") -> DataFrame:
    """(keys, var, coef, mu, sd, n_sites): weighted mean over the sites that have the variable."""
    c = F.col({"std": "coef", "raw": "raw"}[space])
    w = F.col({"n": "n", "fisher": "info"}[weight])
    n = F.col("n")
    return coef.groupBy(*keys, "var").agg(
        (F.sum(w * c) / F.sum(w)).alias("coef"), (F.sum(n * F.col("mu")) / F.sum(n)).alias("mu"),
        F.greatest(F.sum(n * F.col("sd")) / F.sum(n), F.lit(1e-9)).alias("sd"),
        F.count(F.lit(1)).alias("n_sites"))


def merged_intercept(model: DataFrame, keys: list[str], column: str = "intercept") -> DataFrame:
    n = F.col("n")
    return model.groupBy(*keys).agg(
        (F.sum(n * F.col(column)) / F.sum(n)).alias("intercept"), F.sum(n).alias("n"))


def weighted_merge(coef: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Merge under any site weight; a coordinate that is not finite becomes (0, mu 0, sd 1)."""
    n = F.col("n")
    m = coef.withColumn("__w", weight).groupBy(*keys, "var").agg(
        F.try_divide(F.sum(F.col("__w") * F.col("coef")), F.sum("__w")).alias("coef"),
        (F.sum(n * F.col("mu")) / F.sum(n)).alias("mu"),
        F.greatest(F.sum(n * F.col("sd")) / F.sum(n), F.lit(1e-9)).alias("sd"),
        F.max((F.col("coef").isNull() | F.col("mu").isNull() | F.col("sd").isNull()
               | F.isnan("coef") | F.isnan("mu") | F.isnan("sd")).cast("int")).alias("__bad"))
    ok = (F.col("__bad") == 0) & F.col("coef").isNotNull()
    return m.select(*keys, "var", F.when(ok, F.col("coef")).otherwise(0.0).alias("coef"),
                    F.when(ok, F.col("mu")).otherwise(0.0).alias("mu"),
                    F.when(ok, F.col("sd")).otherwise(1.0).alias("sd"))


def own_weight(is_own: Column, w, n_models: Column) -> Column:
    """Fixed share for the target, the rest split evenly over its partners."""
    own = w if isinstance(w, Column) else F.lit(float(w))
    return F.when(is_own, own).otherwise((1 - own) / F.greatest(n_models - 1, F.lit(1)))


def blend(merged: DataFrame, local: DataFrame, keys: list[str], w: Column) -> DataFrame:
    """Convex mix of a target's own coordinates with the merged ones.

    ``local`` has coef (standardised), mu, sd; coordinates the target lacks keep the merge.
    """
    loc = local.select(*keys, "var", F.col("coef").alias("lc"), F.col("mu").alias("lm"),
                       F.col("sd").alias("ls"))
    j = merged.join(loc, [*keys, "var"], "left")
    mix = lambda own, theirs: F.when(F.col(own).isNull(), F.col(theirs)).otherwise(
        w * F.col(own) + (1 - w) * F.col(theirs))
    passed = [c for c in merged.columns if c not in (*keys, "var", "coef", "mu", "sd")]
    return j.select(*keys, "var", *passed, mix("lc", "coef").alias("coef"),
                    mix("lm", "mu").alias("mu"), mix("ls", "sd").alias("sd"))


def cochran_q(coef: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, var, q, df, i2, fixed): heterogeneity of coordinates shared by two or more sites.

    Two passes: the fixed effect first, then squared distances from it.
    """
    w = F.greatest(F.col("info"), F.lit(1e-12))
    k = [*keys, "var"]
    fe = coef.groupBy(*k).agg((F.sum(w * F.col("raw")) / F.sum(w)).alias("fixed"))
    d = coef.join(fe, k).groupBy(*k).agg(
        F.sum(w * F.pow(F.col("raw") - F.col("fixed"), 2)).alias("q"),
        (F.count(F.lit(1)) - 1).alias("df"), F.first("fixed").alias("fixed"),
        F.sum(w).alias("sw"), F.sum(w * w).alias("sww")).where("df >= 1")
    return d.withColumn("i2", F.when(
        F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.col("q"))).otherwise(0.0))


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees > x): the finite sums for even and odd df."""
    half, term, total = x / 2, 1.0, 0.0
    if df % 2 == 0:
        for i in range(df // 2):
            total += term
            term *= half / (i + 1)
        return math.exp(-half) * total
    term = math.sqrt(half) / math.gamma(1.5)
    for i in range(1, (df + 1) // 2):
        total += term
        term *= half / (i + 0.5)
    return math.erfc(math.sqrt(half)) + math.exp(-half) * total


LISTED_DF = 100


def chi2_cut(df: Column, level: float = 0.05) -> Column:
    """Upper chi-square quantile by degrees of freedom: solved for up to 100, by the cube-root
    normal approximation (off by less than 1e-4 of the value) beyond."""
    listed = []
    for k in range(1, LISTED_DF + 1):
        lo, hi = 0.0, 20.0 + 4.0 * k
        while hi - lo > 1e-9:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if chi2_tail(mid, k) > level else (lo, mid)
        listed.append(F.lit(lo))
    z, share = NormalDist().inv_cdf(1 - level), 2.0 / (9.0 * df)
    return F.when(df <= LISTED_DF, F.try_element_at(F.array(*listed), df.cast("int"))).otherwise(
        df * F.pow(1 - share + z * F.sqrt(share), F.lit(3.0)))


def heterogeneity_summary(q: DataFrame, keys: list[str]) -> DataFrame:
    """Median Q and I2 over a model set's shared variables, and the share of Q whose chi-square
    tail probability at its degrees of freedom is below 5 %.

    One row per variable enters, so the exact median's buffer is bounded by the columns.
    """
    return q.groupBy(*keys).agg(
        F.median("q").alias("q_median"), F.avg("q").alias("q_mean"),
        F.median("i2").alias("i2_median"),
        F.avg((F.col("q") > chi2_cut(F.col("df"))).cast("double")).alias("share_over"))


def random_effects(coef: DataFrame, keys: list[str]) -> DataFrame:
    """DerSimonian-Laird (keys, var, tau2, raw): between-site variance and re-weighted mean."""
    k = [*keys, "var"]
    w = F.greatest(F.col("info"), F.lit(1e-12))
    q = cochran_q(coef, keys)
    den = F.col("sw") - F.col("sww") / F.col("sw")
    tau = q.select(*k, F.when(den > 0, F.greatest(
        F.lit(0.0), (F.col("q") - F.col("df")) / den)).otherwise(0.0).alias("t"))
    j = coef.join(tau, k, "left").withColumn("tau2", F.coalesce("t", F.lit(0.0)))
    wr = 1.0 / (1.0 / w + F.col("tau2"))
    return j.withColumn("__w", wr).groupBy(*k).agg(
        F.first("tau2").alias("tau2"), (F.sum(F.col("__w") * F.col("raw")) / F.sum("__w")).alias("raw"),
        F.count(F.lit(1)).alias("n_sites"))


def bias_variance(draws: DataFrame, reference: DataFrame, keys: list[str],
                  min_draws: int = 8) -> DataFrame:
    """Squared bias and variance of coefficient vectors over draws, against a reference.

    ``draws``: keys, draw, var, coef; ``reference``: keys (without k), var, ref. Variables
    of the reference only.
    """
    rk = [c for c in reference.columns if c not in ("var", "ref")]
    j = draws.join(reference, [*rk, "var"])
    per = j.groupBy(*keys, "var").agg(
        F.avg("coef").alias("m"), F.var_pop("coef").alias("v"), F.first("ref").alias("ref"),
        F.count(F.lit(1)).alias("n_draws")).where(F.col("n_draws") >= min_draws)
    return per.groupBy(*keys).agg(
        F.sum(F.pow(F.col("m") - F.col("ref"), 2)).alias("bias2"), F.sum("v").alias("variance"),
        F.max("n_draws").alias("n_draws"))
