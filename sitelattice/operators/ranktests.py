"""Rank correlations, paired signed-rank tests and step-down correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelattice.operators.ordered import _same, average_ranks, quantile_columns
from sitelattice.session import materialise

_ALL = "__all"
#: Pairs up to which the signed-rank p-value is exact, as long as no two differences tie and none is zero.
EXACT_PAIRS = 50


def normal_tail_two_sided(z: Column) -> Column:
    """2*(1-Phi(|z|)) by the complementary error function's rational form (error < 1.2e-7)."""
    x = F.abs(z) / 1.4142135623730951
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418,
              0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + F.lit(c)
    return t * F.exp(-x * x + poly)


def with_ranks(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """Rows collapsed to distinct value combinations, each column with its centred rank.

    Output has ``n`` rows per combination and ``rank_<column>``.
    """
    clean = df.dropna(subset=columns).select(
        *groups, *[F.col(c).cast("double").alias(c) for c in columns])
    cells = materialise(clean.groupBy(*groups, *columns).agg(F.count(F.lit(1)).alias("n")))
    out = cells
    for c in columns:
        r = average_ranks(cells, groups, c, f"rank_{c}", F.col("n"), centred=True).drop("n")
        out = out.alias("l").join(r.alias("k"), _same([*groups, c], "l", "k")).select(
            "l.*", F.col(f"k.rank_{c}"))
    return out


def _weighted_corr(x: str, y: str) -> Column:
    """Pearson correlation of two rank columns, centred on (n+1)/2, from weighted power sums."""
    n = F.sum("n").cast("double")
    sx, sy = F.sum(F.col("n") * F.col(x)), F.sum(F.col("n") * F.col(y))
    sxy = F.sum(F.col("n") * F.col(x) * F.col(y))
    sxx = F.sum(F.col("n") * F.col(x) * F.col(x))
    syy = F.sum(F.col("n") * F.col(y) * F.col(y))
    den = F.sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))
    return F.when(den > 0, (sxy - sx * sy / n) / den)


def spearman(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Spearman rho per group, with n and the large-sample p-value."""
    out = with_ranks(df, groups, [x, y]).groupBy(*groups).agg(
        F.sum("n").alias("n"), _weighted_corr(f"rank_{x}", f"rank_{y}").alias("rho"))
    return with_p(out)


def with_p(out: DataFrame) -> DataFrame:
    """Large-sample p-value of a correlation ``rho`` of ``n`` pairs."""
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    return out.withColumn("p", F.when(F.abs(F.col("rho")) < 1, normal_tail_two_sided(t))
                          .otherwise(F.when(F.col("rho").isNotNull(), F.lit(0.0))))


def partial_spearman(df: DataFrame, groups: list[str], x: str, y: str, given: str) -> DataFrame:
    """Rank correlation of x and y with the ranks of ``given`` partialled out of both."""
    r = with_ranks(df, groups, [x, y, given]).groupBy(*groups).agg(
        F.sum("n").alias("n"),
        _weighted_corr(f"rank_{x}", f"rank_{y}").alias("rxy"),
        _weighted_corr(f"rank_{x}", f"rank_{given}").alias("rxz"),
        _weighted_corr(f"rank_{y}", f"rank_{given}").alias("ryz"))
    den = F.sqrt((1 - F.col("rxz") ** 2) * (1 - F.col("ryz") ** 2))
    return r.select(*groups, "n", F.when(
        den > 0, (F.col("rxy") - F.col("rxz") * F.col("ryz")) / den).alias("partial_rho"))


def signed_rank_null(spark: SparkSession, most: int = EXACT_PAIRS) -> DataFrame:
    """(__n, __w, __p): two-sided p of a smaller rank sum w among n untied differences.

    Every rank falls on either side with equal chance, so the chance of a sum is the share of subsets
    of 1..n that have it: counts of n - 1 ranks, plus the same counts moved up by n.
    """
    rows, counts = [], [1]
    for n in range(1, most + 1):
        wider = counts + [0] * n
        counts = [c + (counts[w - n] if w >= n else 0) for w, c in enumerate(wider)]
        below = 0
        for w in range(n * (n + 1) // 4 + 1):
            below += counts[w]
            rows.append((n, w, min(1.0, 2 * below / 2**n)))
    return spark.createDataFrame(rows, "__n int, __w int, __p double")


def signed_rank(df: DataFrame, groups: list[str], diff: str) -> DataFrame:
    """Wilcoxon signed-rank with zero differences split between the signs.

    Returns w_plus, w_minus, z (normal approximation with tie correction), p and exact. The p-value of at most
    ``EXACT_PAIRS`` differences without ties and zeros is that of the null distribution, else that of z;
    an all-zero group has p = 1.
    """
    d = df.where(F.col(diff).isNotNull()).withColumn("__abs", F.abs(diff))
    ranks = average_ranks(d, groups, "__abs").withColumnRenamed("n", "__tie")
    signed = d.groupBy(*groups, "__abs").agg(
        F.count_if(F.col(diff) > 0).alias("up"), F.count_if(F.col(diff) < 0).alias("down"),
        F.count_if(F.col(diff) == 0).alias("zero"))
    j = signed.alias("l").join(ranks.alias("k"), _same([*groups, "__abs"], "l", "k")).select(
        "l.*", "k.rank", "k.__tie")
    a = j.groupBy(*groups).agg(
        F.sum(F.col("up") + F.col("down") + F.col("zero")).alias("n_pairs"),
        F.sum((F.col("up") + F.col("zero") / 2.0) * F.col("rank")).alias("w_plus"),
        F.sum((F.col("down") + F.col("zero") / 2.0) * F.col("rank")).alias("w_minus"),
        F.sum(F.col("up") + F.col("down")).alias("__nz"),
        F.sum(F.when(F.col("zero") == 0,
                     F.pow(F.col("__tie"), 3) - F.col("__tie")).otherwise(0.0)).alias("__t"),
        F.sum("zero").alias("__z"))
    n, z0 = F.col("n_pairs").cast("double"), F.col("__z").cast("double")
    ties = F.col("__t") + (z0 * z0 * z0 - z0)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    z = F.when(var > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(var))
    exact = (F.col("n_pairs") <= EXACT_PAIRS) & (F.col("__t") == 0) & (F.col("__z") == 0)
    out = a.withColumn("z", F.when(F.col("__nz") > 0, z)).withColumn("exact", exact)
    null = F.broadcast(signed_rank_null(df.sparkSession))  # fixed size: EXACT_PAIRS decides
    at = F.col("exact") & (F.col("n_pairs") == F.col("__n")) & (F.least("w_plus", "w_minus").cast("bigint") == F.col("__w"))
    return out.join(null, at, "left").select(*groups, "n_pairs", "w_plus", "w_minus", "z", F.when(F.col("__nz") == 0, F.lit(1.0)).when(
        F.col("exact"), F.col("__p")).otherwise(normal_tail_two_sided(F.col("z"))).alias("p"), "exact")


def holm(df: DataFrame, groups: list[str], p: str, tie: str) -> DataFrame:
    """Step-down adjusted p-values, monotone; one row per tested method, so groups are small."""
    keys = groups or [_ALL]
    base = df if groups else df.withColumn(_ALL, F.lit(0))
    w = Window.partitionBy(*keys).orderBy(p, tie)
    stepped = base.withColumn("__i", F.row_number().over(w)).withColumn(
        "__m", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    adj = F.least((F.col("__m") - F.col("__i") + 1) * F.col(p), F.lit(1.0))
    return stepped.withColumn("p_holm", F.max(adj).over(
        w.rowsBetween(Window.unboundedPreceding, 0))).drop("__i", "__m", *([] if groups else [_ALL]))


class DuplicateKeyError(ValueError):
    """A (method, seed, fold) key occurs twice, so pairing would multiply rows."""


def paired_differences(folds: DataFrame, reference: str, metric: str) -> DataFrame:
    """(method, seed, fold, diff): reference minus method on the same split.

    Refuses duplicated keys; a pair with a missing side keeps a NULL diff.
    """
    dup = folds.groupBy("method", "seed", "fold").count().where("count > 1").limit(1).collect()
    if dup:
        raise DuplicateKeyError(f"duplicate (seed, fold) for method {dup[0]['method']!r}")
    ref = folds.where(F.col("method") == reference).select(
        "seed", "fold", F.col(metric).alias("__r"))
    oth = folds.where(F.col("method") != reference)
    return oth.join(ref, ["seed", "fold"]).select(
        "method", "seed", "fold", (F.col("__r") - F.col(metric)).alias("diff"))


def paired_test_table(folds: DataFrame, reference: str, metric: str) -> DataFrame:
    """Median difference, signed-rank p, Holm p, pairs used and pairs dropped per method."""
    d = paired_differences(folds, reference, metric)
    counts = d.groupBy("method").agg(
        F.count("diff").alias("n_pairs"), F.count_if(F.col("diff").isNull()).alias("n_dropped"))
    short = counts.where("n_pairs < 2").limit(1).collect()
    if short:
        raise ValueError(f"fewer than two usable pairs for {short[0]['method']!r}")
    med = quantile_columns(d, ["method"], "diff", {"median_diff": 0.5})
    test = signed_rank(d, ["method"], "diff").withColumnRenamed("p", "p_raw").drop("n_pairs", "exact")
    out = holm(counts.join(med, "method").join(test, "method"), [], "p_raw", "method")
    if out.limit(1).count() == 0:
        raise ValueError(f"no method to compare against {reference!r}")
    return out
