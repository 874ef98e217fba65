"""One threshold for several model classes: learning curves of a site against the benefit of merging.

The curves here come from learners with a closed form, so that all sites, fractions and folds of a class
are fitted from one table of sums and scored in one pass; curves of fitted models (``tuning.learning_curve``)
have the same columns and can take their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelattice.operators import thresholds as T
from sitelattice.operators.blockmetrics import linear_metrics
from sitelattice.operators.metrics import score_metrics
from sitelattice.operators.ranktests import spearman
from sitelattice.operators.tuning import FOLDS, FRACTIONS
from sitelattice.session import materialise

STATISTICS = ["epv_target", "slope_last", "climb_half", "level"]
DECIMALS = 9


def _training_sums(rows: DataFrame, site: str, by: list[str], sums: dict[str, Column], steps: int) -> DataFrame:
    """Sums of the rows that the model of (site, i, f) is fitted on: not of fold f, and of the first fractions up to i."""
    cells = materialise(rows.groupBy(site, *by, "fold", "step").agg(*[F.sum(v).alias(k) for k, v in sums.items()]))
    models = cells.withColumn("i", F.explode(F.sequence("step", F.lit(steps - 1)))).withColumn(
        "f", F.explode(F.array(*[F.lit(f) for f in range(FOLDS)]))).where("f <> fold")
    return models.groupBy(site, *by, "i", "f").agg(*[F.sum(k).alias(k) for k in sums])


def slope_metrics(rows: DataFrame, site: str, y: str, xs: list[str], steps: int = len(FRACTIONS)) -> DataFrame:
    """Metrics by (site, i, f) of held-out rows scored by the sum of single-variable least-squares lines.

    A site's fold is scored by all its fractions' lines where it is read. ``rows`` carry fold and step (``tuning.nested_steps``). A missing cell, or a variable without spread, adds nothing.
    """
    sums = {}
    for j, x in enumerate(xs):
        v, t = F.col(x), F.when(F.col(x).isNotNull(), F.col(y))
        sums |= {f"n{j}": v.isNotNull().cast("long"), f"s{j}": v, f"t{j}": t, f"ss{j}": v * v, f"st{j}": v * t}
    m = _training_sums(rows, site, [], sums, steps)
    col = lambda k, j: F.coalesce(F.col(f"{k}{j}"), F.lit(0.0))
    lines = []
    for j in range(len(xs)):
        spread = col("n", j) * col("ss", j) - col("s", j) * col("s", j)
        lines += [F.when(spread > 1e-12, (col("n", j) * col("st", j) - col("s", j) * col("t", j)) / spread).alias(f"b{j}"),
                  F.when(col("n", j) > 0, col("s", j) / col("n", j)).alias(f"a{j}")]
    pick = lambda k: F.array(*[F.col(f"{k}{j}") for j in range(len(xs))])
    unit = lambda f: F.concat_ws("~", site, f)
    models = m.select(site, "i", "f", *lines).select(
        unit("f").alias("__unit"), site, "i", "f", F.lit(0.0).alias("intercept"), pick("b").alias("__coef"), pick("a").alias("__mu"),
        F.array(*[F.lit(1.0)] * len(xs)).alias("__sd"))
    return linear_metrics(rows.withColumn("__unit", unit("fold")), models, [site, "i", "f"], "__unit", y, xs, decimals=DECIMALS)


def band_metrics(rows: DataFrame, site: str, y: str, x: str, cuts: list[float], steps: int = len(FRACTIONS)) -> DataFrame:
    """Metrics by (site, i, f) of held-out rows scored by the event rate of their band, one event and one other row added.

    Rows of a band and outcome share their scores, so they collapse before they are scored.

    Missing values are a band of their own; a band without training rows has rate 0.5.
    """
    band = F.coalesce(sum(((F.col(x) > c).cast("int") for c in cuts), F.lit(0)), F.lit(-1))
    rows = rows.withColumn("band", band)
    m = _training_sums(rows, site, ["band"], {"n": F.lit(1), "pos": F.col(y)}, steps)
    m = m.select(site, "band", "i", F.col("f").alias("fold"), ((F.col("pos") + 1) / (F.col("n") + 2)).alias("rate"))
    alike = rows.groupBy(site, "band", "fold", y).agg(F.count(F.lit(1)).alias("n"))
    every = alike.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(steps)])))
    scored = every.join(m, [site, "band", "i", "fold"], "left")
    p = F.round(F.coalesce("rate", F.lit(0.5)), DECIMALS)
    return score_metrics(scored.select(site, "i", F.col("fold").alias("f"), y, p.alias("p"), "n"), [site, "i", "f"], y, weight="n")


def curves(m: DataFrame, site: str, steps: int = len(FRACTIONS)) -> DataFrame:
    """(site, c1.., slope_last, climb_half, level) from the average precision of every (site, i, f); sites with a fraction
    of which no fold can be scored have no curve."""
    c = m.groupBy(site).agg(*[F.avg(F.when(F.col("i") == i, F.col("auprc"))).alias(f"c{i + 1}") for i in range(steps)]).dropna()
    last = F.col(f"c{steps}")
    per = F.greatest(last, F.lit(1e-6))
    return c.select("*", ((last - F.col(f"c{steps - 1}")) / per).alias("slope_last"),
                    ((last - F.col("c2")) / per).alias("climb_half"), last.alias("level"))


def shared_threshold(decisions: DataFrame, curves: DataFrame, site: str = "site", statistics: list[str] = STATISTICS) -> DataFrame:
    """(statistic, kind, n, rho, cut, direction, acc, shared_acc, majority).

    ``decisions``: site, kind, epv_target, benefit, helped; ``curves``: site, kind and the statistics. A class has
    its own correlation and best cut. ``shared_acc`` is that of one cut for all classes, fitted without the
    site it is scored on.
    """
    known = decisions.join(curves.select(site, "kind", *[s for s in statistics if s not in decisions.columns]), [site, "kind"])
    long = materialise(T.long_features(known.where("benefit IS NOT NULL"), [site, "kind", "helped", "benefit"], statistics))
    both = ["feature", "kind"]
    probs = T.linspace(0.05, 0.95, 25)
    rho = spearman(long, both, "value", "benefit").select(*both, "n", "rho")
    own = T.best_cut(long, both, "value", "helped", probs, ("lt", "ge")).select(*both, "cut", "direction", "acc")
    shared = T.loso_accuracy(long, "feature", site, "value", "helped", probs).select("feature", F.col("loso_acc").alias("shared_acc"))
    base = long.where(F.col("value").isNotNull()).groupBy("feature").agg(F.greatest(F.avg("helped"), 1 - F.avg("helped")).alias("majority"))
    out = rho.join(own, both, "left").join(shared, "feature", "left").join(base, "feature")
    return out.withColumnRenamed("feature", "statistic")
