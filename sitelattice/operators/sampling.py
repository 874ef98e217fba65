"""Deterministic folds, splits, caps and subset draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelattice.functions.hashing import uniform
from sitelattice.operators.ordered import first_by_hash, hash_row_number
from sitelattice.session import materialise


def stratified_folds(df: DataFrame, ids: list[str], y: str, seed, k: int = 5) -> DataFrame:
    """Fold number per row, class counts balanced within one."""
    r = hash_row_number(df, [y], ids, seed)
    return r.withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(k)).cast("int")).drop("rn", "group_n")


def stratified_split(df: DataFrame, site: str, y: str, ids: list[str], seed,
                     test: float = 0.3) -> DataFrame:
    """``is_test`` for round(test*n) rows of every (site, class). The rows are written once and then only read."""
    return first_by_hash(materialise(df), [site, y], ids, seed, test, "is_test")


def cap_sites(df: DataFrame, site: str, y: str, ids: list[str], seed, cap: int,
              prevalence: float | None = None, max_sites: int | None = None) -> DataFrame:
    """Exactly ``cap`` rows per site, optionally at one outcome rate and for few sites.

    Sites without enough rows (of either class, if a rate is asked for) are dropped.
    """
    counts = df.groupBy(site).agg(F.count(F.lit(1)).alias("__n"), F.sum(y).alias("__p"))
    if prevalence is None:
        fit = F.col("__n") >= cap
    else:
        npos = round(cap * prevalence)
        fit = (F.col("__p") >= npos) & (F.col("__n") - F.col("__p") >= cap - npos)
    kept = counts.where(fit).select(site)
    if max_sites is not None:
        chosen = hash_row_number(kept, [], [site], f"{seed}/sites")
        kept = chosen.where(F.col("rn") <= max_sites).select(site)
    rows = df.join(kept, site, "left_semi")
    if prevalence is None:
        r = hash_row_number(rows, [site], ids, seed)
        return r.where(F.col("rn") <= cap).drop("rn", "group_n")
    r = hash_row_number(rows, [site, y], ids, seed)
    quota = F.when(F.col(y) == 1, F.lit(npos)).otherwise(F.lit(cap - npos))
    return r.where(F.col("rn") <= quota).drop("rn", "group_n")


def log_uniform_sites(df: DataFrame, site: str, ids: list[str], seed, low: int) -> DataFrame:
    """Each site keeps a log-uniform number of rows between ``low`` and its natural size."""
    r = hash_row_number(df, [site], ids, seed)
    n = F.col("group_n").cast("double")
    lo = F.log(F.lit(float(low)))
    target = F.floor(F.exp(lo + uniform(f"{seed}/size", site) * (F.log(n) - lo)))
    return r.where((n <= low) | (F.col("rn") <= target)).drop("rn", "group_n")


def nested_fraction(df: DataFrame, groups: list[str], ids: list[str], seed,
                    fractions: list[float]) -> DataFrame:
    """Smallest listed fraction whose nested subsample holds the row (``min_fraction``)."""
    r = hash_row_number(df, groups, ids, seed)
    out = F.lit(None).cast("double")
    for f in sorted(fractions, reverse=True):
        out = F.when(F.col("rn") <= F.round(F.col("group_n") * f), F.lit(float(f))).otherwise(out)
    return r.withColumn("min_fraction", out).drop("rn", "group_n")


def pick_without_replacement(u: list[Column], pool: Column) -> list[Column]:
    """Distinct 0-based positions in a pool from independent uniforms.

    Draw i takes one of the ``pool - i`` positions left; stepping over the earlier picks in
    ascending order turns it into a position in the whole pool.
    """
    picks: list[Column] = []
    for i, ui in enumerate(u):
        pos = F.floor(ui * (pool - i))
        if picks:
            taken = F.array_sort(F.array(*picks))
            pos = F.aggregate(taken, pos, lambda acc, t: F.when(acc >= t, acc + 1).otherwise(acc))
        picks.append(pos)
    return picks


def draw_subsets(pools: DataFrame, keys: list[str], size: str, seed, draws: int = 12,
                 most: int = 4) -> DataFrame:
    """(keys, draw, pos): member positions of each drawn subset, from pool sizes alone."""
    d = pools.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    ids = [*keys, "draw"]
    m = F.floor(uniform(f"{seed}/m", *ids) * F.least(F.col(size), F.lit(most))) + 1
    u = [uniform(f"{seed}/{i}", *ids) for i in range(most)]
    picks = F.array(*pick_without_replacement(u, F.col(size)))
    return (d.withColumn("__m", m).withColumn("__picks", picks)
            .select(*keys, "draw", F.explode(F.slice("__picks", F.lit(1), F.col("__m").cast("int"))).alias("pos")))
