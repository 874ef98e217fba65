"""Analytics over tables of merge decisions and policy scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelattice.operators.ranktests import partial_spearman, spearman

GAIN_EPS = 1e-9
MIN_GAIN = 0.002
HARM_CUT = -0.002


class RowCountDrift(ValueError):
    """A decision table no longer has the number of rows a report quotes."""


def check_row_count(df: DataFrame, expected: int) -> None:
    seen = df.count()
    if seen != expected:
        raise RowCountDrift(f"{seen} decisions, the report quotes {expected}")


def benefit_by_band(df: DataFrame, groups: list[str], benefit: str, min_cell: int) -> DataFrame:
    """Mean benefit per cell; a cell with too few rows keeps its count and a NULL mean."""
    a = df.where(F.col(benefit).isNotNull()).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(benefit).alias("m"))
    return a.select(*groups, "n", F.when(F.col("n") >= min_cell, F.col("m")).alias("mean_benefit"))


def policy_share(scores: DataFrame, pool: str, policies: list[str]) -> DataFrame:
    """(pool, policy, share): percent of the attainable gain each policy realises."""
    a = scores.groupBy(pool).agg(
        F.avg("ap_never_merge").alias("nev"), F.avg("ap_oracle_lambda").alias("orc"),
        *[F.avg(f"ap_{p}").alias(f"p_{p}") for p in policies])
    gain = F.col("orc") - F.col("nev")
    return a.where(gain > GAIN_EPS).select(pool, F.inline(F.array(*[
        F.struct(F.lit(p).alias("policy"),
                 (100.0 * (F.col(f"p_{p}") - F.col("nev")) / gain).alias("share"))
        for p in policies])))


def policy_rollup(shares: DataFrame) -> DataFrame:
    """Mean, median, worst pool and pools below zero; one row per pool enters each policy."""
    return shares.groupBy("policy").agg(
        F.avg("share").alias("mean_share"), F.median("share").alias("median_share"),
        F.min("share").alias("worst_share"), F.count_if(F.col("share") < 0).alias("n_negative"))


def harmful_pools(scores: DataFrame, pool: str, cut: float = HARM_CUT) -> DataFrame:
    b = scores.groupBy(pool).agg(
        F.avg(F.col("ap_always_merge") - F.col("ap_never_merge")).alias("mean_benefit"))
    return b.where(F.col("mean_benefit") < cut)


def mode_pools(scores: DataFrame, mode: str, pool: str, arms: list[str]) -> DataFrame:
    return scores.groupBy(mode, pool).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"ap_{a}").alias(a) for a in arms])


def common_pools(per: DataFrame, mode: str, pool: str) -> DataFrame:
    """Pools every mode has run."""
    n_modes = per.agg(F.count_distinct(mode).alias("__m"))
    have = per.groupBy(pool).agg(F.count_distinct(mode).alias("__h"))
    return have.join(F.broadcast(n_modes), F.col("__h") == F.col("__m")).select(pool)  # one row


def classify_pools(per: DataFrame, mode: str, pool: str) -> DataFrame:
    """(pool, harmful, above): merging harms under some mode; gain clears the floor in all."""
    c = per.join(common_pools(per, mode, pool), pool, "left_semi")
    return c.groupBy(pool).agg(
        F.max((F.col("always_merge") < F.col("never_merge")).cast("int")).alias("harmful"),
        F.min(((F.col("oracle_lambda") - F.col("never_merge")) >= MIN_GAIN).cast("int")).alias("above"))


def mode_comparison(scores: DataFrame, mode: str = "mode", pool: str = "pool") -> DataFrame:
    """Modes compared on the common pools above the gain floor only.

    Unweighted mean over pools of merged, blended and oracle scores; blend share of the
    attainable gain; pools where the blend loses; and two warnings about the pool set.
    """
    arms = ["never_merge", "always_merge", "blend", "oracle_lambda"]
    per = mode_pools(scores, mode, pool, arms)
    cls = classify_pools(per, mode, pool)
    flags = cls.agg(F.count_if(F.col("harmful") == 1).alias("n_harmful"),
                    F.count_if(F.col("above") == 1).alias("n_above"))
    a = per.join(cls.where("above = 1").select(pool), pool, "left_semi").groupBy(mode).agg(
        F.avg("always_merge").alias("merged_ap"), F.avg("blend").alias("blend_ap"),
        F.avg("oracle_lambda").alias("oracle_ap"), F.avg("never_merge").alias("never_ap"),
        F.count_if(F.col("blend") < F.col("never_merge")).alias("n_blend_negative"),
        F.array_join(F.array_sort(F.collect_list(
            F.when(F.col("blend") < F.col("never_merge"), F.col(pool)))), ",").alias("negative_pools"))
    att = F.col("oracle_ap") - F.col("never_ap")
    return a.join(F.broadcast(flags)).select(  # one row
        mode, "merged_ap", "blend_ap", "oracle_ap", att.alias("attainable"),
        F.when(att > 0, 100.0 * (F.col("blend_ap") - F.col("never_ap")) / att).alias("blend_share"),
        F.when(att > 0, 100.0 * (F.col("merged_ap") - F.col("never_ap")) / att).alias("merged_share"),
        "n_blend_negative", "negative_pools", "n_harmful", "n_above",
        (F.col("n_harmful") == 0).alias("warn_no_harmful"), (F.col("n_above") < 8).alias("provisional"))


def drop_arm(decisions: DataFrame, column: str, arm: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a duplicated arm, and one row saying how many matched it."""
    hit = F.coalesce(F.col(column) == arm, F.lit(False))
    return decisions.where(~hit), decisions.agg(
        F.count_if(hit).alias("n_removed"), (F.count_if(hit) == 0).alias("matched_nothing"))


def supersession(files: DataFrame, old: str = r"^(gate|lam)_", new: str = "cut_") -> DataFrame:
    """(file, n, twin, twin_n, superseded): a twin of equal size replaces the file."""
    olds = files.where(F.col("file").rlike(old)).withColumn(
        "twin", F.regexp_replace("file", old, new))
    twins = files.select(F.col("file").alias("twin"), F.col("n").alias("twin_n"))
    return olds.join(twins, "twin", "left").select(
        "file", "n", "twin", "twin_n",
        F.coalesce(F.col("n") == F.col("twin_n"), F.lit(False)).alias("superseded"))


def census(files: DataFrame, conditioned: str, duplicate_rows: DataFrame) -> DataFrame:
    """One row: primary and conditioned totals, exclusions and the headline count.

    ``files``: file, n; ``conditioned``: regular expression on file names;
    ``duplicate_rows``: one row with ``n_removed``.
    """
    cond = F.col("file").rlike(conditioned)
    tot = files.agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(~cond).alias("n_primary_files"),
        F.coalesce(F.sum(F.when(~cond, F.col("n"))), F.lit(0)).alias("primary_rows"),
        F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias("conditioned_rows"))
    sup = supersession(files).agg(
        F.coalesce(F.sum(F.when(F.col("superseded"), F.col("n"))), F.lit(0)).alias("superseded_rows"),
        F.count_if(~F.col("superseded")).alias("n_unmatched"))
    dup = duplicate_rows.select("n_removed")
    return tot.join(F.broadcast(sup)).join(F.broadcast(dup)).select(  # one row each
        "n_files", "n_primary_files", "primary_rows", "conditioned_rows", "n_removed",
        "superseded_rows", "n_unmatched", (F.col("primary_rows") - F.col("n_removed")).alias("headline"),
        (F.col("conditioned_rows") - F.col("superseded_rows")).alias("conditioned_kept"))


def judged(jobs: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Jobs with their verdict, UNJUDGED where none was written."""
    return jobs.join(verdicts, key, "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit("UNJUDGED")))


def verdict_tally(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def failure_rates(tally: DataFrame) -> DataFrame:
    """Share of predictions that did not hold, of the judged and of all recorded."""
    of = lambda *v: F.coalesce(F.sum(F.when(F.col("verdict").isin(*v), F.col("n"))), F.lit(0))
    hard, total = of("REFUTED", "PARTLY"), F.sum("n")
    seen = total - of("UNJUDGED", "NOT TESTED")
    return tally.agg(hard.alias("n_failed"), seen.alias("n_judged"), total.alias("n_all"),
                     (hard / F.greatest(seen, F.lit(1))).alias("rate_judged"),
                     (hard / F.greatest(total, F.lit(1))).alias("rate_recorded"))


def check_claims(claims: DataFrame, derived: DataFrame, key: str, tolerance: Column) -> DataFrame:
    """Quoted against recomputed values: VERIFIED, MISMATCH or UNVERIFIABLE."""
    j = claims.join(derived, key, "left")
    gap = F.abs(F.col("quoted") - F.col("derived"))
    return j.withColumn("verdict", F.when(F.col("derived").isNull(), F.lit("UNVERIFIABLE"))
                        .when(gap <= tolerance, F.lit("VERIFIED")).otherwise(F.lit("MISMATCH")))


def gradient_table(decisions: DataFrame, keys: list[str], flat: float = 0.05) -> DataFrame:
    """rho(EPV, benefit) per pool or control, with its sign class."""
    r = spearman(decisions, keys, "epv_target", "benefit")
    return r.withColumn("sign", F.when(F.col("rho") < -flat, "starved gain")
                        .when(F.col("rho") > flat, "wrong sign").otherwise("no gradient"))


def cross_source(decisions: DataFrame, groups: list[str], fraction: str = "frac_cross") -> DataFrame:
    """Helped rate and mean benefit by EPV band and partner mix (cells of eight or more)."""
    from sitelattice.operators.cohort import band
    mix = (F.when(F.col(fraction) == 0, "within").when(F.col(fraction) == 1, "cross")
           .otherwise("mixed"))
    d = decisions.select(*groups, "benefit", band(F.col("epv_target"), [0, 5, 10, 20]).alias("band"),
                         mix.alias("mix"))
    return d.groupBy(*groups, "band", "mix").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("benefit") > 0).cast("double")).alias("helped"),
        F.avg("benefit").alias("mean_benefit")).where("n >= 8")


def cross_source_partial(decisions: DataFrame, groups: list[str], fraction: str = "frac_cross") -> DataFrame:
    return partial_spearman(decisions, groups, fraction, "benefit", "epv_target")


def union_of_keys(frames: list[DataFrame]) -> DataFrame:
    """Stack result rows whose columns differ; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
