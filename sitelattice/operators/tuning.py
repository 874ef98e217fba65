"""Solo baselines of a site: penalty and feature choice by inner CV, and learning curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.operators import newton as N
from sitelattice.operators.memberships import anova_f, fit_bank, key_stats, score_bank
from sitelattice.operators.metrics import score_metrics
from sitelattice.operators.ordered import hash_row_number
from sitelattice.session import materialise

CS = [10 ** (-4 + 6 * i / 9) for i in range(10)]
FOLDS = 3
FRACTIONS = [0.25, 0.5, 0.75, 1.0]


def _with_folds(df: DataFrame, site: str, y: str, ids: list[str], seed, folds: int) -> DataFrame:
    r = hash_row_number(df, [site, y], ids, seed)
    fold = F.pmod(F.col("rn") - 1, F.lit(folds)).cast("int")
    pos = F.floor((F.col("rn") - 1) / folds) + 1
    size = F.ceil((F.col("group_n") - F.col("fold")) / folds)
    r = r.withColumn("fold", fold)
    return r.select(*df.columns, "fold", (pos / size).alias("__share"))


def local_variants(df: DataFrame, site: str, y: str, xs: list[str], ids: list[str], seed,
                   cs: list[float] = CS, fractions=(0.25, 0.5, 0.75)) -> DataFrame:
    """(site, variant, c, k, cv_auprc, chosen): default, tuned and selected solo models.

    Every (site, C, k, fold) model is fitted in the same scans; ties keep the earlier grid
    point, and the best variant is chosen by inner CV only.
    """
    rows = _with_folds(df, site, y, ids, seed, FOLDS)
    rows = materialise(rows.withColumn("__key", F.concat_ws("@", site, F.col("fold").cast("string"))))
    st = key_stats(rows, "__key", y, xs)
    sites = sorted({k.rsplit("@", 1)[0] for k in st.keys})
    d = len(xs)
    ks = sorted({max(2, round(d * f)) for f in fractions} | {d})
    train = {f"{s}~{f}": [f"{s}@{g}" for g in range(FOLDS) if g != f] for s in sites for f in range(FOLDS)}
    scored = None
    for part in _chunks(sites, FOLDS * len(ks) * len(cs), d):
        p = _grid_scores(rows, y, xs, part, train, ks, cs, st)
        scored = p if scored is None else scored.unionByName(p)
    return _best_variants(scored, site, cs, d)


def _chunks(sites: list[str], models_per_site: int, d: int) -> list[list[str]]:
    """Sites whose models together stay within the state bound."""
    per = max(1, N.STATE_BYTES // (8 * (4 * d + 8) * models_per_site))
    return [sites[i:i + per] for i in range(0, len(sites), per)]


def _grid_scores(rows: DataFrame, y: str, xs: list[str], sites: list[str], train: dict, ks: list[int],
                 cs: list[float], st) -> DataFrame:
    """(model, auprc, ...) of every (site, k, C, fold) of these sites, fitted in shared scans."""
    d = len(xs)
    score_f = anova_f(rows, "__key", y, xs, {n: v for n, v in train.items() if n.rsplit("~", 1)[0] in set(sites)})
    models, c_of, active, where = {}, {}, {}, {}
    for s in sites:
        for f in range(FOLDS):
            order = np.argsort(-score_f[f"{s}~{f}"], kind="stable")
            for k in ks:
                grid = cs if k == d else cs[::2]
                for i, c in enumerate(grid):
                    name = f"{s}~{k}~{cs.index(c)}~{f}"
                    models[name], c_of[name] = train[f"{s}~{f}"], c
                    act = np.zeros(d, bool)
                    act[order[:k]] = True
                    active[name] = act
                    where.setdefault(f"{s}@{f}", []).append(name)
    bank = fit_bank(rows, "__key", y, xs, models, c_of, active, stats=st)
    return score_metrics(materialise(score_bank(rows, "__key", [y], xs, bank, where)), ["model"], y)


def _best_variants(s: DataFrame, site: str, cs: list[float], d: int) -> DataFrame:
    parts = F.split("model", "~")
    cv = s.select(parts[0].alias(site), parts[1].cast("int").alias("k"), parts[2].cast("int").alias("ci"),
                  "auprc").groupBy(site, "k", "ci").agg(F.avg("auprc").alias("cv"))
    cv = materialise(cv)
    grid_c = F.element_at(F.array(*[F.lit(c) for c in cs]), F.col("ci") + 1)
    default_i = int(np.argmin([abs(np.log(c)) for c in cs]))
    pick = lambda variant, cond: cv.where(cond).groupBy(site).agg(F.max(F.struct(
        "cv", (-F.col("k")).alias("k"), (-F.col("ci")).alias("ci"))).alias("b")).select(
        site, F.lit(variant).alias("variant"), (-F.col("b.k")).alias("k"), (-F.col("b.ci")).alias("ci"), F.col("b.cv").alias("cv_auprc"))
    full = F.col("k") == d
    allv = (pick("default", full & (F.col("ci") == default_i)).unionByName(pick("tuned", full))
            .unionByName(pick("selected", F.col("ci") % 2 == 0)))
    order = F.when(F.col("variant") == "default", 2).when(F.col("variant") == "tuned", 1).otherwise(0)
    best = allv.groupBy(site).agg(F.max(F.struct("cv_auprc", order.alias("o"), "variant")).alias("b")).select(
        site, F.col("b.variant").alias("chosen"))
    return allv.withColumn("c", grid_c).drop("ci").join(best, site)


def nested_steps(df: DataFrame, site: str, y: str, ids: list[str], seed, fractions: list[float] = FRACTIONS) -> DataFrame:
    """Rows with their inner fold and the first of the nested fractions that holds them (``step``)."""
    rows = _with_folds(df, site, y, ids, seed, FOLDS)
    step = F.lit(len(fractions) - 1)
    for i in range(len(fractions) - 1, -1, -1):
        step = F.when(F.col("__share") <= fractions[i], F.lit(i)).otherwise(step)
    return rows.withColumn("step", step).drop("__share")


def learning_curve(df: DataFrame, site: str, y: str, xs: list[str], ids: list[str], seed,
                   fractions: list[float] = FRACTIONS) -> DataFrame:
    """(site, c1..c4, slope_last, climb_half, level): inner-CV AUPRC at nested fractions."""
    rows = nested_steps(df, site, y, ids, seed, fractions)
    rows = materialise(rows.withColumn("__key", F.concat_ws("@", site, F.col("fold").cast("string"), F.col("step").cast("string"))).drop("step"))
    st = key_stats(rows, "__key", y, xs)
    sites = sorted({k.rsplit("@", 2)[0] for k in st.keys})
    steps = range(len(fractions))
    s = None
    for group in _chunks(sites, FOLDS * len(fractions), len(xs)):
        models = {f"{k}~{i}~{f}": [f"{k}@{g}@{j}" for g in range(FOLDS) if g != f for j in steps if j <= i]
                  for k in group for i in steps for f in range(FOLDS)}
        where = {f"{k}@{f}@{j}": [f"{k}~{i}~{f}" for i in steps] for k in group for f in range(FOLDS) for j in steps}
        bank = fit_bank(rows, "__key", y, xs, models, 1.0, stats=st, threshold=0.5)
        m = score_metrics(materialise(score_bank(rows, "__key", [y], xs, bank, where)), ["model"], y)
        s = m if s is None else s.unionByName(m)
    parts = F.split("model", "~")
    c = s.select(parts[0].alias(site), parts[1].cast("int").alias("i"), "auprc").groupBy(site).agg(
        *[F.avg(F.when(F.col("i") == i, F.col("auprc"))).alias(f"c{i + 1}") for i in steps])
    last, den = F.col(f"c{len(fractions)}"), F.greatest(F.col(f"c{len(fractions)}"), F.lit(1e-6))
    return c.dropna().withColumn("slope_last", (last - F.col(f"c{len(fractions) - 1}")) / den).withColumn(
        "climb_half", (last - F.col("c2")) / den).withColumn("level", last)
