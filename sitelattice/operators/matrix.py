"""Feature matrices with missing cells: column statistics, designs and masks.

Wide form is ``row_id, site, y, x0..x{d-1}`` with NULL for missing. Column statistics are
taken in one aggregate over the wide rows; long form is built only where it is the answer.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Interaction, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelattice.functions.hashing import uniform
from sitelattice.operators.ordered import hash_row_number
from sitelattice.operators.patterns import BITS, packed_words, word_names

SCHEMA_THRESHOLD = 0.5


def to_long(df: DataFrame, ids: list[str], xs: list[str]) -> DataFrame:
    """(ids, var, value): one row per observed cell."""
    cells = F.array(*[F.struct(F.lit(j).alias("var"), F.col(x).alias("value"))
                      for j, x in enumerate(xs)])
    seen = F.filter(cells, lambda c: c.value.isNotNull())
    return df.select(*ids, F.inline(seen))


def to_wide(long: DataFrame, ids: list[str], d: int) -> DataFrame:
    return long.groupBy(*ids).agg(
        *[F.max(F.when(F.col("var") == j, F.col("value"))).alias(f"x{j}") for j in range(d)])


def column_stats(df: DataFrame, groups: list[str], xs: list[str]) -> DataFrame:
    """(groups, var, n, n_obs, mean, sd): one pass, population sd, NULL mean if never seen."""
    agg = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        *[e for j, x in enumerate(xs) for e in (
            F.count(x).alias(f"c{j}"), F.avg(x).alias(f"m{j}"), F.stddev_pop(x).alias(f"s{j}"))])
    cells = F.array(*[F.struct(F.lit(j).alias("var"), F.col(f"c{j}").alias("n_obs"),
                               F.col(f"m{j}").alias("mean"), F.col(f"s{j}").alias("sd"))
                      for j in range(len(xs))])
    return agg.select(*groups, "n", F.inline(cells))


def observed_counts(df: DataFrame, groups: list[str], xs: list[str]) -> DataFrame:
    """(groups, var, n, n_obs) from plain counts."""
    agg = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(x).alias(f"c{j}") for j, x in enumerate(xs)])
    cells = F.array(*[F.struct(F.lit(j).alias("var"), F.col(f"c{j}").alias("n_obs"))
                      for j in range(len(xs))])
    return agg.select(*groups, "n", F.inline(cells))


def site_schema(df: DataFrame, site: str, xs: list[str],
                threshold: float = SCHEMA_THRESHOLD) -> DataFrame:
    """(site, var, n, n_obs) for the variables at least ``threshold`` of a site's rows have."""
    return observed_counts(df, [site], xs).where(
        F.col("n_obs") / F.col("n") >= threshold)


def informative_columns(df: DataFrame, xs: list[str]) -> DataFrame:
    """(var, name, keep): a column is kept if it is ever seen and not constant.

    Minimum and maximum decide constancy, so no distinct set is built.
    """
    agg = df.agg(*[e for j, x in enumerate(xs) for e in (
        F.min(x).alias(f"a{j}"), F.max(x).alias(f"b{j}"))])
    cells = F.array(*[F.struct(
        F.lit(j).alias("var"), F.lit(x).alias("name"),
        F.coalesce(F.col(f"a{j}") < F.col(f"b{j}"), F.lit(False)).alias("keep"))
        for j, x in enumerate(xs)])
    return agg.select(F.inline(cells))


def _stat_row(stats: DataFrame, groups: list[str], d: int) -> DataFrame:
    """Column statistics of each group as arrays, ready to join back to rows."""
    pick = lambda f, j: F.max(F.when(F.col("var") == j, F.col(f)))
    return stats.groupBy(*groups).agg(
        F.array(*[pick("mean", j) for j in range(d)]).alias("__mean"),
        F.array(*[pick("sd", j) for j in range(d)]).alias("__sd"))


def with_stats(df: DataFrame, groups: list[str], xs: list[str]) -> DataFrame:
    """Attach ``__mean`` and ``__sd`` arrays of the row's group (whole table if no groups)."""
    row = _stat_row(column_stats(df, groups, xs), groups, len(xs))
    if groups:
        return df.join(row, groups)
    return df.join(F.broadcast(row))  # exactly one row


def standardise(df: DataFrame, groups: list[str], xs: list[str], fill: bool = False) -> DataFrame:
    """Population-sd scaling that leaves NULL alone, or puts 0 in its place."""
    s = with_stats(df, groups, xs)
    out = []
    for j, x in enumerate(xs):
        sd = F.col("__sd")[j]
        z = (F.col(x) - F.col("__mean")[j]) / F.when(sd > 0, sd).otherwise(1.0)
        out.append((F.coalesce(z, F.lit(0.0)) if fill else z).alias(x))
    return s.select(*[c for c in df.columns if c not in xs], *out)


def impute_mean(df: DataFrame, groups: list[str], xs: list[str]) -> DataFrame:
    """Group mean for a missing cell; 0 for a column nobody in the group has."""
    s = with_stats(df, groups, xs)
    return s.select(*[c for c in df.columns if c not in xs],
                    *[F.coalesce(x, F.col("__mean")[j], F.lit(0.0)).alias(x)
                      for j, x in enumerate(xs)])


def indicator_design(df: DataFrame, xs: list[str], means_of: DataFrame | None = None) -> DataFrame:
    """Imputed values beside the raw mask: ``x0.. , m0..``. The means are those of ``means_of``, if given."""
    flags = df.select("*", *[F.col(x).isNotNull().cast("double").alias(f"m{j}")
                             for j, x in enumerate(xs)])
    if means_of is None:
        return impute_mean(flags, [], xs)
    mean = means_of.agg(*[F.avg(x).alias(x) for x in xs]).first()
    return flags.withColumns({x: F.coalesce(x, F.lit(mean[x]), F.lit(0.0)) for x in xs})


def interaction_design(df: DataFrame, xs: list[str], out: str = "features", means_of: DataFrame | None = None) -> DataFrame:
    """Sparse vector [x, m, m (x) x] of length d + d + d*d."""
    d = indicator_design(df, xs, means_of)
    ms = [f"m{j}" for j in range(len(xs))]
    d = VectorAssembler(inputCols=xs, outputCol="__x").transform(d)
    d = VectorAssembler(inputCols=ms, outputCol="__m").transform(d)
    d = Interaction(inputCols=["__m", "__x"], outputCol="__mx").transform(d)
    d = VectorAssembler(inputCols=["__x", "__m", "__mx"], outputCol=out).transform(d)
    return d.drop("__x", "__m", "__mx", *ms, *xs)


def vector_column_means(df: DataFrame, vector: str) -> DataFrame:
    """(idx, n_nonzero, mean) of a vector column by the JVM summarizer."""
    s = df.select(Summarizer.metrics("numNonZeros", "mean").summary(F.col(vector)).alias("s"))
    return s.select(F.posexplode(F.arrays_zip(
        vector_to_array("s.numNonZeros").alias("n_nonzero"),
        vector_to_array("s.mean").alias("mean")))).select(
        F.col("pos").alias("idx"), F.col("col.n_nonzero").cast("bigint").alias("n_nonzero"),
        F.col("col.mean").alias("mean"))


# --- masks -------------------------------------------------------------------------------

def missing_chances(rate: float, beta: float, n_neg: int, n_pos: int) -> tuple[float, float]:
    """Chances of a missing cell in the negative and the positive class: their odds differ by the
    factor exp(beta) and they average to ``rate``. The negative odds u solve
    exp(beta) (n - r) u^2 + (n_neg + n_pos exp(beta) - r (1 + exp(beta))) u - r = 0, r = rate n."""
    if not 0.0 <= rate < 1.0:
        raise ValueError(f"rate must be in [0, 1), got {rate}")
    n = n_neg + n_pos
    ratio, r = math.exp(beta), rate * n
    if r == 0.0:
        return 0.0, 0.0
    a, b = ratio * (n - r), n_neg + n_pos * ratio - r * (1 + ratio)
    root = math.sqrt(b * b + 4 * a * r)
    odds = 2 * r / (b + root) if b > 0 else (root - b) / (2 * a)
    return odds / (1 + odds), ratio * odds / (1 + ratio * odds)


def inject_missingness(df: DataFrame, xs: list[str], y: str, ids: list[str], seed,
                       rate: float, beta: float) -> DataFrame:
    """Null each cell with probability sigmoid(alpha + beta*y), alpha set by the overall rate."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p")).first()
    neg, pos = missing_chances(rate, beta, n["n"] - (n["p"] or 0), n["p"] or 0)
    chance = F.when(F.col(y) == 1, F.lit(pos)).otherwise(F.lit(neg))
    keep = [c for c in df.columns if c not in xs]
    return df.select(*keep, *[
        F.when(uniform(seed, *ids, F.lit(j)) >= chance, F.col(x)).alias(x)
        for j, x in enumerate(xs)])


def recorded_variables(sites: DataFrame, site_no: str, d: int, overlap: float) -> DataFrame:
    """(site_no, recorded): the variables each site records. All sites share the first
    ``d * overlap``; the others form a row of which a site has half, moving on with its number."""
    core = d if overlap >= 1.0 else max(1, min(d - 1, round(d * overlap)))
    optional = max(1, d - core)
    width = max(1, optional // 2)
    var = sites.select(site_no).distinct().withColumn("var", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
    place = F.col("var") - core - F.pmod(F.col(site_no) * width, F.lit(optional))
    return (var.where((F.col("var") < core) | place.between(0, width - 1))
            .groupBy(site_no).agg(F.collect_set("var").alias("recorded")))


def mask_by_site_block(df: DataFrame, xs: list[str], site_no: str, overlap: float) -> DataFrame:
    other = [c for c in df.columns if c not in xs]
    # a row without a site number stays, with nothing recorded
    seen = df.join(recorded_variables(df, site_no, len(xs), overlap), site_no, "left")
    return seen.select(*other, *[F.when(F.array_contains("recorded", j), F.col(x)).alias(x) for j, x in enumerate(xs)])


def _permuted(df: DataFrame, ids: list[str], payload: list[str], seed) -> DataFrame:
    """Rows of ``df`` with ``payload`` taken from another row by an exact permutation."""
    home = hash_row_number(df.drop(*payload), [], ids, f"{seed}/home", out="__k", total="__t1")
    away = hash_row_number(df.select(*ids, *payload), [], ids, f"{seed}/away",
                           out="__k", total="__t2").select("__k", *payload)
    return home.join(away, "__k").drop("__k", "__t1")


def permute_mask(df: DataFrame, xs: list[str], ids: list[str], seed) -> DataFrame:
    """Values untouched, mask indicators ``m0..`` taken from permuted rows."""
    moved = _permuted(df.select("*", *packed_words(xs)), ids, word_names(len(xs)), seed)
    flags = [F.shiftright(f"w{j // BITS}", j % BITS).bitwiseAND(F.lit(1)).cast("int").alias(f"m{j}") for j in range(len(xs))]
    return moved.select(*df.columns, *flags)


def permute_groups(df: DataFrame, group: str, ids: list[str], seed) -> DataFrame:
    """Random regrouping that keeps every group's size exactly."""
    return _permuted(df.select(*ids, group), ids, [group], seed)
