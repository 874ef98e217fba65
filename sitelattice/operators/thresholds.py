"""Threshold rules: best cuts, leave-one-site-out scoring, terciles, pool laws.

Accuracies are read off running counts. Neither rows x grid nor rows x sites is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelattice.operators.ordered import _same, quantile_columns, quantiles
from sitelattice.operators.ranktests import spearman, with_p
from sitelattice.session import materialise, slices_for

#: Cells of a block in which a cut looks up its place.
BLOCK = 1024


def linspace(lo: float, hi: float, k: int) -> list[float]:
    return [lo + (hi - lo) * i / (k - 1) for i in range(k)]


def _pick(correct_lt, total, order_k, directions, cut, extra):
    """Array of candidate structs, best one last under max()."""
    out = []
    for i, d in enumerate(directions):
        correct = correct_lt if d == "lt" else total - correct_lt
        out.append(F.struct(
            correct.alias("correct"), (-(order_k * len(directions) + i)).alias("order"),
            cut.alias("cut"), F.lit(d).alias("direction"), *extra(d)))
    return F.array_max(F.array(*out))


def best_cut(df: DataFrame, groups: list[str], value: str, label: str, probs: list[float],
             directions: tuple[str, ...] = ("lt",), min_rows: int = 1,
             both_classes: bool = True) -> DataFrame:
    """Most accurate quantile-grid threshold per group; the first of equals wins.

    ``lt`` predicts 1 below the cut, ``ge`` at or above it. Returns cut, direction, acc,
    majority, lift and n.
    """
    clean = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    at = quantiles(clean, groups, value, probs, below={"rows": F.lit(1), "pos": F.col(label)}).withColumnsRenamed(
        {"rows_below": "n_below", "rows_total": "n_total"})
    n, pos = F.col("n_total"), F.col("pos_total")
    correct = F.col("pos_below") + (n - pos) - (F.col("n_below") - F.col("pos_below"))
    cand = at.withColumn("__c", _pick(correct, n, F.col("k"), directions, F.col("q"), lambda d: []))
    best = cand.groupBy(*groups).agg(F.max("__c").alias("b"), F.max("n_total").alias("n"),
                                     F.max("pos_total").alias("pos"))
    ok = F.col("n") >= min_rows
    if both_classes:
        ok = ok & (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    share = F.col("pos") / F.col("n")
    acc = F.col("b.correct") / F.col("n")
    major = F.greatest(share, 1 - share)
    return best.where(ok).select(
        *groups, F.col("b.cut").alias("cut"), F.col("b.direction").alias("direction"),
        acc.alias("acc"), major.alias("majority"), (acc - major).alias("lift"), "n")


def _blocks(cells: DataFrame, feature: str, site: str, value: str, ranked: bool) -> DataFrame:
    """Cells (feature, site, value, n, pos), written in value order with their slice (range of values) and ``block`` of ``BLOCK``
    cells. ``ranked``: cells also have m and sy; c is twice the m of the slice's smaller values plus that of this value."""
    placed = cells.repartitionByRange(slices_for(cells.sparkSession), feature, value).withColumn("slice", F.spark_partition_id())
    local = Window.partitionBy(feature, "slice").orderBy(value)
    number = F.row_number().over(Window.partitionBy(feature, "slice").orderBy(value, site))
    out = placed.withColumn("block", F.floor((number - 1) / BLOCK).cast("int"))
    if ranked:
        up_to = F.sum("m").over(local.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumn("c", 2 * up_to - F.sum("m").over(Window.partitionBy(feature, "slice", value)))
    return materialise(out)


def _grid(blocks: DataFrame, feature: str, site: str, value: str) -> DataFrame:
    """One row per block and site of its feature: the block's own n, what lies before it (``a_`` all sites, ``o_`` this one),
    the totals, its least value ``lo`` (null for the first block) and the next block's, ``up``."""
    at = [feature, "slice", "block"]
    own = materialise(blocks.groupBy(*at, site).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.min(value).alias("lo")))
    order = Window.partitionBy(feature).orderBy("slice", "block")
    past, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(feature)
    zero = lambda c: F.coalesce(c, F.lit(0))
    every = own.groupBy(*at).agg(F.sum("n").alias("a_n"), F.sum("pos").alias("a_pos"), F.min("lo").alias("least")).select(
        *at, "a_n", F.when(F.row_number().over(order) > 1, F.col("least")).alias("lo"), F.lead("least").over(order).alias("up"),
        *[zero(F.sum(f"a_{c}").over(past)).alias(f"a_{c}_before") for c in ("n", "pos")],
        *[F.sum(f"a_{c}").over(whole).alias(f"a_{c}_total") for c in ("n", "pos")])
    sites = own.select(F.col(feature).alias("__f"), F.col(site).alias("__s")).distinct()
    dense = every.join(sites, F.col(feature) == F.col("__f")).withColumn(site, F.col("__s")).drop("__f", "__s")
    dense = dense.alias("d").join(own.select(*at, site, "n", "pos").alias("o"), _same([*at, site], "d", "o"), "left").select(
        "d.*", zero(F.col("o.n")).alias("n"), zero(F.col("o.pos")).alias("pos"))
    order = Window.partitionBy(feature, site).orderBy("slice", "block")
    past, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(feature, site)
    return materialise(dense.select("*", *[zero(F.sum(c).over(past)).alias(f"o_{c}_before") for c in ("n", "pos")],
                                    *[F.sum(c).over(whole).alias(f"o_{c}_total") for c in ("n", "pos")]))


def _loso(blocks: DataFrame, feature: str, site: str, value: str, probs: list[float], min_train: int,
          directions: tuple[str, ...]) -> DataFrame:
    """``loso_accuracy`` from ``_blocks``: a wanted order statistic or cut first finds its block, then its place inside it."""
    at, unit = [feature, "slice", "block"], [feature, site]
    grid = _grid(blocks, feature, site, value)
    cells = blocks.select(*at, F.col(site).alias("__by"), value, F.col("n").alias("__n"), F.col("pos").alias("__pos"))
    own = F.col("__by").eqNullSafe(F.col(site))
    # order statistics of the other sites' rows
    units = grid.groupBy(*unit).agg(F.max(F.col("a_n_total") - F.col("o_n_total")).alias("train"))
    pos = [F.lit(p) * (F.col("train") - 1) for p in probs]
    wanted = units.where(F.col("train") >= min_train).select(*unit, F.inline(F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), (p - F.floor(p)).alias("frac"), edge(p).alias("r"))
        for k, p in enumerate(pos) for side, edge in (("lo", F.floor), ("hi", F.ceil))])))
    start = F.col("g.a_n_before") - F.col("g.o_n_before")
    inside = (F.col("w.r") >= start) & (F.col("w.r") < start + F.col("g.a_n") - F.col("g.n"))
    asked = materialise(wanted.alias("w").join(grid.alias("g"), _same(unit, "w", "g") & inside).select(
        "w.*", "g.slice", "g.block", (F.col("w.r") - start).alias("left")))
    others = F.when(own, 0).otherwise(F.col("__n"))
    point = Window.partitionBy(*unit, "k", "side").orderBy(value, "__by").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.join(asked, at).withColumn("w", others).withColumn("upto", F.sum("w").over(point))
    found = run.where((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("w")))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col(value)))
    cuts = materialise(found.groupBy(*unit, "k").agg(side("lo").alias("lo"), side("hi").alias("hi"), F.max("frac").alias("frac")).select(
        *unit, "k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")).alias("t")))
    # counts below each cut: those before its block, and the block's cells below it
    holds = (F.col("g.lo").isNull() | (F.col("g.lo") < F.col("c.t"))) & (F.col("g.up").isNull() | (F.col("c.t") <= F.col("g.up")))
    asked = materialise(cuts.alias("c").join(grid.alias("g"), _same(unit, "c", "g") & holds).select(
        "c.*", "g.slice", "g.block", *[f"g.{s}_{c}_{e}" for s in "ao" for c in ("n", "pos") for e in ("before", "total")]))
    part = cells.join(asked.select(*unit, "k", "t", "slice", "block"), at).where(F.col(value) < F.col("t")).groupBy(*unit, "k").agg(
        *[F.sum(f"__{c}").alias(f"a_{c}") for c in ("n", "pos")],
        *[F.sum(F.when(own, F.col(f"__{c}"))).alias(f"o_{c}") for c in ("n", "pos")])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = asked.alias("p").join(part.alias("q"), _same([*unit, "k"], "p", "q"), "left").select("p.*", *[
        (F.col(f"p.{s}_{c}_before") + zero(f"q.{s}_{c}")).alias(f"{s}_{c}_below") for s in "ao" for c in ("n", "pos")])
    hit = lambda s: F.col(f"{s}_pos_below") + (F.col(f"{s}_n_total") - F.col(f"{s}_pos_total")) - (
        F.col(f"{s}_n_below") - F.col(f"{s}_pos_below"))
    train_n, train_pos = (F.col(f"a_{c}_total") - F.col(f"o_{c}_total") for c in ("n", "pos"))
    own_hit, own_n = hit("o"), F.col("o_n_total")
    pick = _pick(hit("a") - hit("o"), train_n, F.col("k"), directions, F.col("t"),
                 lambda d: [(own_hit if d == "lt" else own_n - own_hit).alias("own")])
    best = j.where((train_pos > 0) & (train_pos < train_n)).select(*unit, pick.alias("b"), own_n.alias("own_n")).groupBy(*unit).agg(
        F.max("b").alias("b"), F.max("own_n").alias("own_n"))
    return best.groupBy(feature).agg(
        (F.sum("b.own") / F.sum("own_n")).alias("loso_acc"), F.sum("own_n").alias("n_scored"))


def loso_accuracy(long: DataFrame, feature: str, site: str, value: str, label: str,
                  probs: list[float], min_train: int = 10,
                  directions: tuple[str, ...] = ("lt", "ge")) -> DataFrame:
    """(feature, loso_acc, n_scored): cut fitted on the other sites, scored on the held-out one.

    Cells (feature, site, value) are ordered and written once. The held-out site's own counts are subtracted from the overall
    ones in a table of blocks of cells, where the few wanted order statistics and cuts look up their places.
    """
    cells = long.where(F.col(value).isNotNull() & F.col(label).isNotNull()).groupBy(
        feature, site, F.col(value).cast("double").alias(value)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    return _loso(_blocks(cells, feature, site, value, False), feature, site, value, probs, min_train, directions)


def _ranks(rows: DataFrame, by: str, has: list[Column]) -> DataFrame:
    """(by, mask, r0, r1, ...): r_i is twice the centred, tie-averaged rank of a value of ``by`` among the rows where ``has[i]``;
    ``mask`` tells which of these a row has. One order of the rows serves all of them."""
    cells = rows.where(F.col(by).isNotNull()).groupBy(by, _mask(has).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    cells = materialise(cells.repartitionByRange(slices_for(rows.sparkSession), by).withColumn("slice", F.spark_partition_id()))
    n = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.col("n")).otherwise(0) for i in range(len(has))]
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    per = cells.groupBy("slice").agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(n)])
    off = materialise(per.select("slice", *[(2 * F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)) - F.sum(f"s{i}").over(
        Window.partitionBy())).alias(f"off{i}") for i in range(len(has))]))
    up_to = Window.partitionBy("slice").orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = Window.partitionBy("slice", by)
    run = cells.select("slice", by, "mask", *[(2 * F.sum(x).over(up_to) - F.sum(x).over(ties)).alias(f"c{i}") for i, x in enumerate(n)])
    return run.join(off, "slice").select(by, "mask", *[(F.col(f"c{i}") + F.col(f"off{i}")).alias(f"r{i}") for i in range(len(has))])


def _mask(has: list[Column]) -> Column:
    if len(has) > 62:
        raise ValueError("at most 62 features at a time")
    return sum((F.when(h, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, h in enumerate(has)), F.lit(0).cast("long"))


def _rho(blocks: DataFrame, feature: str) -> DataFrame:
    """(feature, n, rho): Spearman's from the sums of each slice; a rank is c and what the slices before hold."""
    m, c, sy = (F.col(x).cast("double") for x in ("m", "c", "sy"))
    per = blocks.groupBy(feature, "slice").agg(
        F.sum("m").alias("m"), F.sum("sy").cast("double").alias("sy"), F.sum(c * sy).alias("csy"), F.sum(m * c).alias("mc"),
        F.sum(m * c * c).alias("mcc"), F.sum("syy").alias("syy"))
    before = Window.partitionBy(feature).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    off = 2 * F.coalesce(F.sum("m").over(before), F.lit(0)) - F.sum("m").over(Window.partitionBy(feature))
    per = per.withColumn("off", off.cast("double"))
    o = F.col("off")
    out = per.groupBy(feature).agg(
        F.sum("m").alias("n"), F.sum(o * F.col("sy") + F.col("csy")).alias("sxy"), F.sum("syy").alias("syy"),
        F.sum(o * o * F.col("m") + 2 * o * F.col("mc") + F.col("mcc")).alias("sxx"))
    return out.select(feature, "n", F.when(F.col("sxx") * F.col("syy") > 0, F.col("sxy") / F.sqrt("sxx") / F.sqrt("syy")).alias("rho"))


def long_features(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                      for f in features])
    return df.select(*keep, F.inline(cells))


def evaluate_rules(decisions: DataFrame, features: list[str], site: str = "site",
                   min_rows: int = 20) -> DataFrame:
    """(feature, rho, p, loso_acc, majority) for decisions with ``helped`` and ``benefit``.

    Benefits are ranked once for all features and meet their rows once; everything else is read from one table of cells
    (feature, site, value).
    """
    has = [F.col(f).isNotNull() for f in features]
    ranks = _ranks(decisions, "benefit", has)
    rows = decisions.withColumn("mask", _mask(has))
    rows = rows.alias("l").join(ranks.alias("r"), (F.col("l.benefit") == F.col("r.benefit")) & (F.col("l.mask") == F.col("r.mask")), "left")
    long = rows.select(F.col(f"l.{site}").alias(site), "l.helped", F.inline(F.array(*[
        F.struct(F.lit(i).alias("feature"), F.col(f"l.{f}").cast("double").alias("value"), F.col(f"r.r{i}").alias("r"))
        for i, f in enumerate(features)])))
    r = F.col("r").cast("double")
    cells = long.where("value IS NOT NULL").groupBy("feature", site, "value").agg(
        F.count("helped").alias("n"), F.coalesce(F.sum("helped"), F.lit(0)).alias("pos"), F.count("r").alias("m"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("sy"), F.coalesce(F.sum(r * r), F.lit(0.0)).alias("syy"))
    blocks = _blocks(cells, "feature", site, "value", True)
    rho = with_p(_rho(blocks, "feature").where(F.col("n") >= min_rows))
    acc = _loso(blocks, "feature", site, "value", linspace(0.05, 0.95, 19), 10, ("lt", "ge"))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("feature") + 1)
    base = decisions.agg(F.greatest(F.avg("helped"), 1 - F.avg("helped")).alias("majority"))
    return (rho.drop("n").join(acc.drop("n_scored"), "feature", "left").withColumn("feature", name)
            .join(F.broadcast(base)))  # one row


def combiner_table(decisions: DataFrame, arms: list[str], epv: str = "epv_target",
                   min_rows: int = 30) -> DataFrame:
    """Per combiner: n, rho(EPV, benefit), best EPV cut, accuracy, majority, helped rate."""
    cells = F.array(*[F.struct(F.lit(a).alias("combiner"), F.col(a).cast("double").alias("gain"))
                      for a in arms])
    long = decisions.where(F.col(epv).isNotNull()).select(epv, F.inline(cells)).where(
        F.col("gain").isNotNull()).withColumn("h", (F.col("gain") > 0).cast("int"))
    rho = spearman(long, ["combiner"], epv, "gain").where(F.col("n") >= min_rows)
    cut = best_cut(long, ["combiner"], epv, "h", linspace(0.05, 0.95, 37), both_classes=False)
    rate = long.groupBy("combiner").agg(F.avg("h").alias("helped_rate"))
    return rho.join(cut.select("combiner", F.col("cut").alias("epv_cut"), "acc", "majority"),
                    "combiner").join(rate, "combiner")


def quantile_bins(df: DataFrame, groups: list[str], value: str, edges: list[float],
                  out: str = "bin") -> DataFrame:
    """Rows with their quantile bin; both ends are inclusive, so an edge value is in two bins."""
    named = {f"__e{i}": p for i, p in enumerate(edges)}
    q = quantile_columns(df.where(F.col(value).isNotNull()), groups, value, named)
    j = df.join(q, groups) if groups else df.join(F.broadcast(q))  # one row
    inside = F.array_compact(F.array(*[
        F.when((F.col(value) >= F.col(f"__e{i}")) & (F.col(value) <= F.col(f"__e{i + 1}")), F.lit(i))
        for i in range(len(edges) - 1)]))
    return j.withColumn(out, F.explode(inside)).drop(*named)


def boundary_by_tercile(decisions: DataFrame, pool: str, by: str = "i2_median",
                        value: str = "epv_target", label: str = "helped") -> DataFrame:
    """Best cut and lift inside each tercile of ``by``: (pool, tercile, median_by, cut, ...)."""
    ok = decisions.where(F.col(by).isNotNull())
    big = ok.groupBy(pool).agg(F.count(F.lit(1)).alias("__n")).where("__n >= 200").select(pool)
    cut3 = quantile_bins(ok.join(big, pool, "left_semi").select(pool, by, value, label),
                         [pool], by, [0.0, 1 / 3, 2 / 3, 1.0], "tercile")
    cut3 = materialise(cut3)
    med = quantile_columns(cut3, [pool, "tercile"], by, {"median_by": 0.5})
    cut = best_cut(cut3, [pool, "tercile"], value, label, linspace(0.05, 0.95, 49), min_rows=60)
    return med.join(cut.drop("direction", "majority"), [pool, "tercile"])


def boundary_verdicts(terciles: DataFrame, pool: str) -> DataFrame:
    """Low and high cut, whether it falls and whether lift rises, where all three exist."""
    at = lambda c, i: F.max(F.when(F.col("tercile") == i, F.col(c)))
    v = terciles.groupBy(pool).agg(
        F.count(F.lit(1)).alias("k"), at("cut", 0).alias("low_cut"), at("cut", 2).alias("high_cut"),
        at("lift", 0).alias("l0"), at("lift", 2).alias("l2"))
    return v.where("k = 3").select(pool, "low_cut", "high_cut",
                                   (F.col("high_cut") < F.col("low_cut")).alias("falls"),
                                   (F.col("l2") > F.col("l0")).alias("lift_rises"))


def pool_law(decisions: DataFrame, pool: str, harm_n: float = 5000.0) -> DataFrame:
    """Harm fraction, best lift over the trivial rule, helped share and crossing size."""
    base = decisions.groupBy(pool).agg(
        F.avg((F.col("n_target") > harm_n).cast("double")).alias("harm"),
        F.avg("helped").alias("helped"), F.count(F.lit(1)).alias("n"))
    long = long_features(decisions, [pool, "helped"], ["epv_target", "n_target"])
    cuts = best_cut(long, [pool, "feature"], "value", "helped", linspace(0.05, 0.95, 37), ("lt", "ge"),
                    min_rows=50, both_classes=False)
    acc = cuts.groupBy(pool).agg(F.max("acc").alias("best"))
    triv = F.greatest(F.col("helped"), 1 - F.col("helped"))
    return (base.join(acc, pool, "left").join(crossing_size(decisions, pool), pool, "left")
            .select(pool, "harm", (F.coalesce("best", F.lit(-1.0)) - triv).alias("lift"),
                    "helped", "n", "crossing"))


def crossing_size(decisions: DataFrame, pool: str) -> DataFrame:
    """Size where mean benefit changes sign: OLS over six quantile bins of log10 size.

    NULL unless the benefit takes both signs and the crossing lies in the observed range.
    """
    ok = decisions.where("n_target > 0 AND benefit IS NOT NULL").select(pool, "n_target", "benefit")
    span = ok.groupBy(pool).agg(F.count(F.lit(1)).alias("__n"), F.min("n_target").alias("lo"),
                                F.max("n_target").alias("hi")).where("__n > 300")
    bins = quantile_bins(ok.join(span.select(pool), pool, "left_semi"), [pool], "n_target",
                         linspace(0.0, 1.0, 7))
    bins = materialise(bins)
    med = quantile_columns(bins, [pool, "bin"], "n_target", {"m": 0.5})
    mean = bins.groupBy(pool, "bin").agg(F.avg("benefit").alias("b"), F.count(F.lit(1)).alias("k"))
    pts = mean.where("k >= 30").join(med, [pool, "bin"]).select(
        pool, F.log10("m").alias("x"), "b")
    fit = pts.groupBy(pool).agg(
        F.count(F.lit(1)).alias("k"), F.max("b").alias("up"), F.min("b").alias("down"),
        F.regr_slope("b", "x").alias("sl"), F.regr_intercept("b", "x").alias("ic"))
    c = F.pow(F.lit(10.0), -F.col("ic") / F.col("sl"))
    good = (F.col("k") >= 4) & (F.col("up") > 0) & (F.col("down") < 0) & (F.abs("sl") > 1e-9)
    return fit.where(good).withColumn("c", c).join(span, pool).select(
        pool, F.when((F.col("c") >= F.col("lo")) & (F.col("c") <= F.col("hi")), F.col("c"))
        .alias("crossing"))


def quadratic_sweep(decisions: DataFrame, law: DataFrame, pool: str,
                    thresholds: list[float]) -> DataFrame:
    """Quadratic fit of pool lift on harm fraction at each harm threshold.

    Returns (threshold, curvature, peak, r2); a threshold with fewer than three distinct
    harm fractions is left out. The fit uses power sums over pools, of distances from the mean
    fraction and the mean lift: fractions of large pools lie close together, and powers of the
    fractions themselves would cancel to a few digits.
    """
    frac = decisions.groupBy(pool).agg(*[
        F.avg((F.col("n_target") > t).cast("double")).alias(f"f{i}")
        for i, t in enumerate(thresholds)])
    pts = frac.join(law.select(pool, "lift"), pool).select("lift", F.inline(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"f{i}").alias("f"))
        for i, t in enumerate(thresholds)])))
    mean = pts.groupBy("threshold").agg(F.avg("f").alias("mf"), F.avg("lift").alias("ml"))
    pts = pts.join(mean, "threshold").select("threshold", "f", "mf", (F.col("f") - F.col("mf")).alias("v"),
                                             (F.col("lift") - F.col("ml")).alias("w"))
    s = lambda a, b=0: F.sum(F.pow("v", F.lit(a)) * (F.pow("w", F.lit(b)) if b else F.lit(1.0)))
    a = pts.groupBy("threshold", "mf").agg(
        F.count_distinct(F.round("f", 3)).alias("distinct_f"), s(0).alias("s0"), s(1).alias("s1"),
        s(2).alias("s2"), s(3).alias("s3"), s(4).alias("s4"), s(0, 1).alias("t0"),
        s(1, 1).alias("t1"), s(2, 1).alias("t2"), s(0, 2).alias("u"))
    e = F.expr
    det = e("s4*(s2*s0-s1*s1) - s3*(s3*s0-s1*s2) + s2*(s3*s1-s2*s2)")
    qa = e("t2*(s2*s0-s1*s1) - s3*(t1*s0-s1*t0) + s2*(t1*s1-s2*t0)") / det
    qb = e("s4*(t1*s0-s1*t0) - t2*(s3*s0-s1*s2) + s2*(s3*t0-t1*s2)") / det
    qc = e("s4*(s2*t0-t1*s1) - s3*(s3*t0-t1*s2) + t2*(s3*s1-s2*s2)") / det
    f = a.where("distinct_f >= 3").select("*", qa.alias("a"), qb.alias("b"), qc.alias("c"))
    sse = e("u - a*t2 - b*t1 - c*t0")
    sst = e("u - t0*t0/s0")
    return f.select("threshold", F.col("a").alias("curvature"),
                    F.when(F.col("a") < 0, F.col("mf") - F.col("b") / (2 * F.col("a"))).alias("peak"),
                    (1 - sse / F.greatest(sst, F.lit(1e-12))).alias("r2"))


def peak_range(sweep: DataFrame) -> DataFrame:
    ok = sweep.where("curvature < 0 AND peak BETWEEN 0 AND 1")
    return ok.agg(F.min("peak").alias("lowest_peak"), F.max("peak").alias("highest_peak"))
