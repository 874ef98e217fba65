"""Cohort assembly from record and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelattice.functions.scalars import hours_between
from sitelattice.operators.ordered import quantile_columns


def first_per(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """First row of each key in the given order; a struct minimum combines on the map side."""
    lead = [*order, *[c for c in keep if c not in order]]
    return df.groupBy(key).agg(F.min(F.struct(*lead)).alias("__f")).select(
        key, *[F.col(f"__f.{c}").alias(c) for c in dict.fromkeys([*order, *keep])])


def above_floor(df: DataFrame, site: str, floor: int) -> DataFrame:
    """Rows of sites holding at least ``floor`` rows."""
    sizes = df.groupBy(site).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= floor)
    return df.join(sizes.select(site), site, "left_semi")


def in_window(events: DataFrame, anchors: DataFrame, key: str, anchor: str, ts: str,
              hours: float = 24.0) -> DataFrame:
    """Events of anchored keys with 0 <= hours since the anchor <= ``hours``."""
    j = events.join(anchors.select(key, anchor), key)
    h = hours_between(anchor, ts)
    return j.where((h >= 0) & (h <= hours))


def item_means(events: DataFrame, key: str, item: str, value: str) -> DataFrame:
    """Mean value per (entity, item)."""
    return events.where(F.col(value).isNotNull()).groupBy(key, item).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n"))


def top_items(events: DataFrame, item: str, n: int) -> DataFrame:
    """The ``n`` most measured items, ties by name."""
    return events.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), item).limit(n)


def pivot_items(means: DataFrame, key: str, item: str, items: list[str]) -> DataFrame:
    """Long means to one column per listed item; listing them avoids a distinct pass."""
    return means.groupBy(key).agg(
        *[F.max(F.when(F.col(item) == i, F.col("mean"))).alias(i) for i in items])


def site_profile(df: DataFrame, site: str, xs: list[str], y: str = "y",
                 numerator: str = "minority", denominator: str = "schema",
                 threshold: float = 0.5) -> DataFrame:
    """Rows, events, prevalence, schema size and events per variable of each site.

    The numerator is ``minority`` or ``positives``; the denominator ``schema`` or ``all``.
    One aggregate over the wide rows gives everything.
    """
    if numerator not in ("minority", "positives") or denominator not in ("schema", "all"):
        raise ValueError("unknown events-per-variable definition")
    agg = df.groupBy(site).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("events"),
        *[F.count(x).alias(f"c{j}") for j, x in enumerate(xs)])
    flags = [(F.col(f"c{j}") / F.col("n") >= threshold).cast("int") for j in range(len(xs))]
    pos = F.col("events")
    num = pos if numerator == "positives" else F.least(pos, F.col("n") - pos)
    den = F.greatest(F.col("schema_size"), F.lit(1)) if denominator == "schema" else F.lit(len(xs))
    return agg.withColumn("schema_size", sum(flags[1:], flags[0])).select(
        site, "n", "events", (pos / F.col("n")).alias("prevalence"), "schema_size",
        (num / den).alias("epv"))


def band(c: Column, edges: list[float]) -> Column:
    """Label of the half-open band [lo, hi) holding a value; the last one is open-ended."""
    out = F.lit(None).cast("string")
    for i in range(len(edges) - 1, -1, -1):
        label = f"{edges[i]:g}-{edges[i + 1]:g}" if i + 1 < len(edges) else f"{edges[i]:g}+"
        low = c >= edges[i]
        if i + 1 < len(edges):
            low = low & (c < edges[i + 1])
        out = F.when(low, F.lit(label)).otherwise(out)
    return out


def ever_bad(history: DataFrame, key: str, bad: Column) -> DataFrame:
    return history.groupBy(key).agg(F.max(bad.cast("int")).alias("bad"))


def availability_spread(counts: DataFrame, n: int) -> DataFrame:
    """Variables with the widest gap between sites' observation rates."""
    rate = F.col("n_obs") / F.col("n")
    return counts.groupBy("var").agg(
        F.min(rate).alias("lowest"), F.max(rate).alias("highest"),
        (F.max(rate) - F.min(rate)).alias("spread")).orderBy(F.desc("spread"), "var").limit(n)


def partition_survey(sizes: DataFrame, n: str = "n") -> DataFrame:
    """Count, extremes, median and size bands of a partition's groups."""
    med = quantile_columns(sizes, [], n, {"median_size": 0.5})
    c = F.col(n)
    row = sizes.agg(
        F.count(F.lit(1)).alias("n_groups"), F.min(c).alias("min_size"), F.max(c).alias("max_size"),
        (F.max(c) / F.min(c)).alias("spread"),
        *[F.count_if(c >= t).alias(f"ge_{t}") for t in (1000, 5000, 20000, 100000)])
    return row.join(F.broadcast(med))  # one row each


def spread_stations(features: DataFrame, station: str, feature: str, n_obs: str,
                    d: int) -> DataFrame:
    """One feature per station, stations evenly spaced over the visit-rate ranking.

    Works on column counts: one row per feature of the table.
    """
    best = features.groupBy(station).agg(
        F.max(F.col(n_obs)).alias("visits"),
        F.min(F.struct((-F.col(n_obs)).alias("o"), F.col(feature).alias("f"))).alias("b"))
    one = best.withColumn("__one", F.lit(0))
    ranked = one.select(
        station, "visits", F.col("b.f").alias(feature),
        F.row_number().over(Window.partitionBy("__one").orderBy(F.desc("visits"), station)).alias("r"),
        F.count(F.lit(1)).over(Window.partitionBy("__one")).alias("s"))
    i = F.explode(F.sequence(F.lit(0), F.least(F.lit(d), F.col("s")).cast("int") - 1))
    picks = ranked.where("r = 1").select("s", i.alias("i")).select(
        (F.rint(F.col("i") * (F.col("s") - 1) / float(max(d - 1, 1))) + 1).cast("int").alias("r"))
    return ranked.join(picks.distinct(), "r").select(station, feature, "visits")


def align_vocabulary(labels: DataFrame, source: str, code: str, label: Column) -> DataFrame:
    """Rename map (source, code, label, n_sources, shared): every code of every source with the
    normalised label that names it in all of them; ``shared`` labels occur in every source."""
    named = labels.select(F.col(source).alias("source"), F.col(code).alias("code"), label.alias("label")).distinct()
    where = named.groupBy("label").agg(F.count_distinct("source").alias("n_sources"))
    sources = named.agg(F.count_distinct("source").alias("__all"))
    return (named.join(where, "label").join(F.broadcast(sources))  # one row
            .select("source", "code", "label", "n_sources", (F.col("n_sources") == F.col("__all")).alias("shared")))


def stack_aligned(events: DataFrame, source: str, code: str, names: DataFrame, shared_only: bool) -> DataFrame:
    """Rows of all sources under the common labels: those that all share, or the union."""
    kept = names.where("shared") if shared_only else names
    renamed = kept.select(F.col("source").alias(source), F.col("code").alias(code), "label")
    return events.join(renamed, [source, code])
