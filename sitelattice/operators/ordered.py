"""Ranks, running sums and quantiles that never put one whole group in one task.

A window over a group that holds a third of all rows would sort that third in a single
task. Both tools here cut every group into slices: hash order uses the leading digits of the
digest, value order the ranges of a range partitioning by (group, value), which splits a large
group wherever its size asks for it. Rows are ordered inside a slice; a small table of slice
totals supplies the offsets. There is one way for every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelattice.functions.hashing import digest
from sitelattice.session import materialise, slices_for

_ALL = "__all"
_SLICE = "__slice"


def _same(keys: list[str], left: str, right: str) -> Column:
    """Null-safe equality on every key."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def hash_row_number(df: DataFrame, groups: list[str], ids: list[str], seed,
                    out: str = "rn", total: str = "group_n", digits: int | None = None) -> DataFrame:
    """Exact row number in digest order within each group, and the group's row count.

    ``ids`` must identify a row inside its group. ``16**digits`` slices bound the rows any
    one task sorts, whatever the group sizes; by default there are at least eight slices per
    shuffle task, so a single huge group still fills the cluster.
    """
    if digits is None:
        digits = 3
        while 16**digits < 4 * slices_for(df.sparkSession):
            digits += 1
    keys = groups or [_ALL]
    base = df if groups else df.withColumn(_ALL, F.lit(0))
    base = (base.withColumn("__h", digest(seed, *ids))
            .withColumn(_SLICE, F.substring("__h", 1, digits)))
    counts = base.groupBy(*keys, _SLICE).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        *keys, _SLICE, F.lit(0).alias("__row"),
        F.coalesce(F.sum("__n").over(_earlier(keys)), F.lit(0)).alias("__k"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias(total))
    rows = base.drop("__h").withColumn("__row", F.lit(1)).withColumn("__k", F.lit(1).cast("bigint"))
    # the digest is longer than most rows: it is worked out again where the rows arrive
    met = rows.unionByName(offsets, allowMissingColumns=True).repartition(*keys, _SLICE).withColumn("__h", digest(seed, *ids))
    local = (Window.partitionBy(*keys, _SLICE).orderBy("__row", "__h", *ids)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = met.select(
        *df.columns, "__row", F.sum("__k").over(local).alias(out), F.first(total).over(local).alias(total))
    return ranked.where("__row = 1").drop("__row")


def first_by_hash(df: DataFrame, groups: list[str], ids: list[str], seed, share: float, out: str) -> DataFrame:
    """Flag of the first round(share*n) rows of each group in digest order: those whose ``hash_row_number`` is at most that.

    No row moves. Counts of the digest's slices tell in which slice a group's last such row lies; only the rows of
    those slices are ordered, and every row is compared with its group's last. ``df`` is read three times.
    """
    digits = 3
    while 16**digits < 4 * slices_for(df.sparkSession):
        digits += 1
    keys = groups or [_ALL]
    base = df if groups else df.withColumn(_ALL, F.lit(0))
    base = base.withColumn("__h", digest(seed, *ids))
    sliced = base.select(*keys, *[c for c in ids if c not in keys], "__h", F.substring("__h", 1, digits).alias(_SLICE))
    counts = sliced.groupBy(*keys, _SLICE).agg(F.count(F.lit(1)).alias("__n")).select(
        *keys, _SLICE, "__n", F.coalesce(F.sum("__n").over(_earlier(keys)), F.lit(0)).alias("__b"),
        F.round(F.sum("__n").over(Window.partitionBy(*keys)) * share).alias("__want"))
    cut = materialise(counts.where("__b < __want AND __want <= __b + __n"))  # one slice a group
    near = sliced.alias("r").join(cut.alias("c"), _same([*keys, _SLICE], "r", "c")).select("r.*", "c.__b", "c.__want")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__h", *ids))
    last = materialise(near.withColumn("__at", F.col("__b") + place).where("__at = __want").select(
        *keys, F.struct("__h", *ids).alias("__last")))
    flagged = base.alias("r").join(last.alias("l"), _same(keys, "r", "l"), "left")
    first = F.struct("r.__h", *[F.col(f"r.{c}") for c in ids]) <= F.col("l.__last")
    return flagged.select(*[F.col(f"r.{c}") for c in df.columns], F.coalesce(first, F.lit(False)).alias(out))


def _earlier(keys: list[str]):
    """Slices of the same group before this one; at most one row per slice."""
    return Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)


def running_by_value(df: DataFrame, groups: list[str], value: str,
                     sums: dict[str, Column], slices: int | None = None) -> DataFrame:
    """One row per (group, distinct value) with running sums in ascending value order.

    For every measure ``m``: ``m`` (this value's own sum), ``m_before`` (sum over strictly
    smaller values) and ``m_total`` (group total).
    """
    keys = groups or [_ALL]
    base = df if groups else df.withColumn(_ALL, F.lit(0))
    base = base.where(F.col(value).isNotNull())
    names = list(sums)
    cells = base.groupBy(*keys, F.col(value).cast("double").alias(value)).agg(
        *[F.sum(sums[m]).alias(m) for m in names])
    # written once with the range it fell into: a slice is then the same for every later reader
    n = slices or slices_for(df.sparkSession)
    cells = materialise(cells.repartitionByRange(n, *keys, value).withColumn(_SLICE, F.spark_partition_id()))
    before = Window.unboundedPreceding, -1
    per_slice = cells.groupBy(*keys, _SLICE).agg(*[F.sum(m).alias(m) for m in names])
    whole = Window.partitionBy(*keys)
    offsets = per_slice.select(
        *keys, _SLICE, F.lit(0).alias("__row"),
        *[F.coalesce(F.sum(m).over(_earlier(keys)), F.lit(0)).alias(m) for m in names],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in names])
    # the offset row opens its slice, so one ordered window gives the running sums
    local = Window.partitionBy(*keys, _SLICE).orderBy("__row", value)
    rows = cells.withColumn("__row", F.lit(1)).unionByName(offsets, allowMissingColumns=True)
    run = rows.select(
        *groups, value, *names, "__row",
        *[F.sum(m).over(local.rowsBetween(*before)).alias(f"{m}_before") for m in names],
        *[F.first(f"{m}_total").over(local.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{m}_total")
          for m in names])
    return run.where("__row = 1").drop("__row")


def average_ranks(df: DataFrame, groups: list[str], value: str, out: str = "rank",
                  weight: Column | None = None, centred: bool = False) -> DataFrame:
    """(group, value, n, rank): tie-averaged ascending rank of each distinct value.

    ``centred`` subtracts the group's mean rank, (n+1)/2, which keeps power sums small.
    """
    cells = running_by_value(df, groups, value, {"n": weight if weight is not None else F.lit(1)})
    rank = F.col("n_before") + (F.col("n") + 1) / 2.0
    if centred:
        rank = rank - (F.col("n_total") + 1) / 2.0
    return cells.select(*groups, value, "n", rank.alias(out))


def quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float],
              weight: Column | None = None, below: dict[str, Column] | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles: one row per (group, k) with ``p`` and ``q``.

    ``k`` is the index into ``probs``. Values stay distributed; only the cells that hold a
    wanted order statistic are kept. For every measure ``m`` of ``below`` the row also has
    ``m_below`` (its sum over rows strictly below ``q``) and ``m_total``: no value lies between
    the two order statistics that ``q`` interpolates, so the same running sums tell.
    """
    sums = below or {}
    slim = df.select(*groups, F.col(value).cast("double").alias("__v"),
                     (weight if weight is not None else F.lit(1)).alias("__w"), *[c.alias(f"__m_{m}") for m, c in sums.items()])
    cells, value = running_by_value(slim, groups, "__v", {"n": F.col("__w"), **{m: F.col(f"__m_{m}") for m in sums}}), "__v"
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p"))
                       for k, p in enumerate(probs)])
    hit = F.filter(wanted, lambda w: (F.ceil(w.p * (F.col("n_total") - 1)) >= F.col("n_before"))
                   & (F.floor(w.p * (F.col("n_total") - 1)) < F.col("n_before") + F.col("n")))
    exploded = (cells.withColumn("__w", F.explode(hit))
                .withColumn("__pos", F.col("__w.p") * (F.col("n_total") - 1)))
    inside = lambda pos: (pos >= F.col("n_before")) & (pos < F.col("n_before") + F.col("n"))
    at = lambda pos, c: F.max(F.when(inside(pos(F.col("__pos"))), F.col(c)))
    picked = exploded.groupBy(*groups, F.col("__w.k").alias("k"), F.col("__w.p").alias("p")).agg(
        at(F.floor, value).alias("lo"), at(F.ceil, value).alias("hi"),
        F.max(F.col("__pos") - F.floor("__pos")).alias("frac"),
        *[x for m in sums for x in (at(F.floor, f"{m}_before").alias(f"__lo_{m}"), at(F.ceil, f"{m}_before").alias(f"__hi_{m}"),
                                    F.max(f"{m}_total").alias(f"{m}_total"))])
    q = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")
    return picked.select(*groups, "k", "p", q.alias("q"), *[x for m in sums for x in (
        F.when(q > F.col("lo"), F.col(f"__hi_{m}")).otherwise(F.col(f"__lo_{m}")).alias(f"{m}_below"), F.col(f"{m}_total"))])


def quantile_columns(df: DataFrame, groups: list[str], value: str,
                     named: dict[str, float], weight: Column | None = None) -> DataFrame:
    """Quantiles as named columns, one row per group."""
    names = list(named)
    long = quantiles(df, groups, value, [named[n] for n in names], weight)
    keys = groups or [_ALL]
    if not groups:
        long = long.withColumn(_ALL, F.lit(0))
    wide = long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("k") == i, F.col("q"))).alias(n) for i, n in enumerate(names)])
    return wide.select(*groups, *names)


def counts_below(df: DataFrame, groups: list[str], value: str, sums: dict[str, Column],
                 points: DataFrame, point: str, carry: list[str]) -> DataFrame:
    """Group sums strictly below given points, without pairing rows and points.

    ``points`` holds ``groups + [point] + carry``; its rows enter the value order with zero
    weight, so one running sum answers all of them. Returns ``points`` plus ``m_below`` and
    ``m_total`` for every measure.
    """
    data = df.where(F.col(value).isNotNull()).select(
        *groups, F.col(value).cast("double").alias("__v"), *[c.alias(m) for m, c in sums.items()],
        F.lit(0).alias("__pt"))
    zero = points.select(*groups, F.col(point).cast("double").alias("__v"),
                         *[F.lit(0).alias(m) for m in sums], F.lit(1).alias("__pt")).distinct()
    run = running_by_value(data.unionByName(zero), groups, "__v",
                           {**{m: F.col(m) for m in sums}, "__pt": F.col("__pt")}).where("__pt > 0")
    keys = [*groups, "__v"]
    looked = points.withColumn("__v", F.col(point).cast("double")).alias("p").join(
        run.alias("r"), _same(keys, "p", "r"))
    return looked.select(
        *[F.col(f"p.{c}") for c in [*groups, point, *carry]],
        *[F.col(f"r.{m}_before").alias(f"{m}_below") for m in sums],
        *[F.col(f"r.{m}_total") for m in sums])
