"""Merge decisions: split, fit each site once per seed, merge per partner set, score.

A model unit is a (seed, site) pair, named ``unit``. ``members``: decision, unit, is_target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.functions.scalars import logit
from sitelattice.operators import merging as MG
from sitelattice.operators.blockmetrics import linear_metrics
from sitelattice.operators.metrics import calibration_line, score_metrics
from sitelattice.operators.ordered import hash_row_number
from sitelattice.operators.partners import partner_subsets
from sitelattice.operators.sitemodels import fit_sites, mean_raw_score, model_rows, score_raw, score_std
from sitelattice.session import materialise

METRICS = ["auprc", "auroc", "brier"]


@dataclass
class Fitted:
    """Train and test rows with their unit, and one model per unit."""

    train: DataFrame
    test: DataFrame
    model: DataFrame
    coef: DataFrame
    sizes: DataFrame  # unit, n_train, minority, d_schema


def split_and_fit(df: DataFrame, site: str, y: str, xs: list[str], ids: list[str],
                  seeds: list[int], test: float = 0.3, min_schema: int = 2) -> Fitted:
    """Stratified split inside every (seed, site, class), then one model per unit.

    Each unit is fitted once, however many partner sets it appears in.
    """
    return fit_split(split_rows(df, site, y, xs, ids, seeds, test), y, xs, min_schema)


def split_rows(df: DataFrame, site: str, y: str, xs: list[str], ids: list[str], seeds: list[int], test: float = 0.3) -> DataFrame:
    """Rows with their unit and ``is_test``, written: the same split for every set of columns."""
    rep = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    r = hash_row_number(rep, ["seed", site, y], ["seed", *ids], "decision-split")
    return materialise(r.select(
        F.concat_ws("|", "seed", site).alias("unit"), "seed", site, y, *xs, *ids,
        (F.col("rn") <= F.round(F.col("group_n") * test)).alias("is_test")))


def fit_split(rows: DataFrame, y: str, xs: list[str], min_schema: int = 2) -> Fitted:
    """One model per unit of split rows over the named columns."""
    train = rows.where(~F.col("is_test"))
    model, coef = fit_sites(train, "unit", y, xs, min_schema=min_schema)
    sizes = train.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n_train"),
        F.least(F.sum(y), F.count(F.lit(1)) - F.sum(y)).alias("minority"))
    dims = coef.groupBy("unit").agg(F.count(F.lit(1)).alias("d_schema"))
    return Fitted(train, rows.where("is_test"), model, materialise(coef),
                  materialise(sizes.join(dims, "unit")))


def draw_members(sites: DataFrame, seeds: list[int], tag: str, draws: int = 12, most: int = 4,
                 subsets: DataFrame | None = None, extra: list[str] | None = None) -> DataFrame:
    """(decision, target, seed, n_partners, unit, is_target): target plus its drawn partners."""
    s = partner_subsets(sites, tag, draws, most) if subsets is None else subsets
    s = s.withColumn("seed", F.explode(F.array(*[F.lit(x) for x in seeds])))
    extra = extra or []
    name = F.concat_ws("/", *extra, F.col("seed").cast("string"), "target", F.array_join("members", "+"))
    d = s.select(*extra, name.alias("decision"), "target", "seed", F.size("members").alias("n_partners"),
                 F.explode(F.concat(F.array("target"), "members")).alias("site"))
    return d.select(*extra, "decision", "target", "seed", "n_partners",
                    F.concat_ws("|", "seed", "site").alias("unit"),
                    (F.col("site") == F.col("target")).alias("is_target"))


def complete(members: DataFrame, fit: Fitted) -> DataFrame:
    """Members of decisions whose every unit has a model."""
    added = [c for c in fit.sizes.columns if c != "unit"]
    j = members.drop(*added).join(fit.sizes, "unit", "left")
    ok = j.groupBy("decision").agg(F.min(F.col("n_train").isNotNull()).alias("ok")).where("ok")
    return j.join(ok.select("decision"), "decision", "left_semi")


def merged_rows(fit: Fitted, members: DataFrame, d: int, keys=("decision",)) -> DataFrame:
    """One row per decision with the merged standardised model as arrays."""
    keys = list(keys)
    m = members.select(*keys, "unit")
    coef = MG.coordinate_merge(fit.coef.join(m, "unit"), keys)
    icpt = MG.merged_intercept(fit.model.join(m, "unit"), keys).select(*keys, "intercept")
    return model_rows(coef, icpt, keys, d, ["coef", "mu", "sd"])


def local_metrics(fit: Fitted, y: str, xs: list[str]) -> DataFrame:
    """Test metrics of each unit's own model (raw units, mean fill)."""
    rows = model_rows(fit.coef, fit.model.select("unit", "raw_b"), ["unit"], len(xs), ["raw", "mu"])
    return linear_metrics(fit.test, rows, ["unit"], "unit", y, xs, "raw")


def merged_scores(fit: Fitted, members: DataFrame, models: DataFrame, y: str, xs: list[str],
                  keys=("decision",)) -> DataFrame:
    """Target test rows scored by every decision's merged model (standardised, zero fill).

    Models meet their targets in a small written table first, so no row moves to be scored.
    """
    keys = list(keys)
    targets = members.where("is_target").select(*keys, "unit")
    j = fit.test.join(materialise(targets.join(models, keys)), "unit")
    return j.select(*keys, "unit", y, score_std(j, xs, F.col("intercept")).alias("p"))


def merged_metrics(fit: Fitted, members: DataFrame, models: DataFrame, y: str, xs: list[str], keys=("decision",)) -> DataFrame:
    """Metrics of the scores of ``merged_scores``, without a row per score."""
    keys = list(keys)
    return linear_metrics(fit.test, members.where("is_target").select(*keys, "unit").join(models, keys), keys, "unit", y, xs)


def observations(df: DataFrame, site: str, y: str, xs: list[str], ids: list[str], seeds: list[int],
                 sites: DataFrame, dataset: str = "matrix", members: DataFrame | None = None,
                 fit: Fitted | None = None, draws: int = 12, extra: list[str] | None = None) -> DataFrame:
    """The decision table: sizes, adequacy, overlap, heterogeneity, local and merged metrics."""
    extra = extra or []
    fit = fit or split_and_fit(df, site, y, xs, ids, seeds)
    members = draw_members(sites, seeds, "decisions", draws) if members is None else members
    members = materialise(complete(members, fit))
    own = F.col("is_target")
    base = members.groupBy(*extra, "decision", "target", "seed", "n_partners").agg(
        F.max(F.when(own, F.col("unit"))).alias("unit"), F.max(F.when(own, F.col("n_train"))).alias("n_target"),
        F.min("n_train").alias("n_min"), F.sum(F.when(~own, F.col("n_train")).otherwise(0)).alias("n_partner_total"),
        F.max(F.when(own, F.col("d_schema"))).alias("d_target"), F.max(F.when(own, F.col("minority"))).alias("minority"))
    mc = materialise(fit.coef.join(members.select("decision", "unit"), "unit"))
    overlap = mc.groupBy("decision", "var").agg(F.count(F.lit(1)).alias("k")).join(
        base.select("decision", (F.col("n_partners") + 1).alias("all")), "decision").groupBy("decision").agg(
        (F.count_if(F.col("k") == F.col("all")) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("schema_jaccard"))
    het = MG.heterogeneity_summary(MG.cochran_q(mc, ["decision"]), ["decision"]).select(
        "decision", "q_median", "i2_median")
    events = df.groupBy(F.col(site).alias("target")).agg(F.sum(y).alias("events_target"))
    loc = local_metrics(fit, y, xs).select("unit", *[F.col(m).alias(f"loc_{m}") for m in METRICS])
    mrg = merged_metrics(fit, members, merged_rows(fit, members, len(xs)), y, xs).select("decision", *[F.col(m).alias(f"mrg_{m}") for m in METRICS])
    t = (base.join(overlap, "decision").join(het, "decision", "left").join(events, "target")
         .join(loc, "unit").join(mrg, "decision").where("loc_auprc IS NOT NULL AND mrg_auprc IS NOT NULL"))
    gain = F.col("mrg_auprc") - F.col("loc_auprc")
    return t.select(
        F.lit(dataset).alias("dataset"), *extra, "decision", "target", "seed", "n_partners", "n_target", "n_min",
        "n_partner_total", "d_target",
        (F.col("n_partner_total") / F.greatest("n_target", F.lit(1))).alias("ratio_partner_to_target"),
        "events_target", (F.col("minority") / F.greatest("d_target", F.lit(1))).alias("epv_target"),
        "schema_jaccard", "q_median", "i2_median", gain.alias("benefit"), (gain > 0).cast("int").alias("helped"),
        *[f"loc_{m}" for m in METRICS], *[f"mrg_{m}" for m in METRICS])


def own_weight_curve(fit: Fitted, members: DataFrame, y: str, xs: list[str], weights: list[float]) -> DataFrame:
    """(decision, n_partners, w, auprc): local-merge blends on a weight grid.

    The blend mixes coefficients, scalers and intercept; every weight is a model of its own, and all are
    scored in the same scans.
    """
    d = len(xs)
    members = materialise(complete(members, fit))
    m = members.select("decision", "unit")
    tgt = members.where("is_target").select("decision", "unit", "n_partners")
    grid = F.explode(F.array(*[F.lit(float(w)) for w in weights]))
    merged = MG.coordinate_merge(fit.coef.join(m, "unit"), ["decision"]).drop("n_sites").withColumn("w", grid)
    local = fit.coef.join(tgt, "unit").select("decision", "var", "coef", "mu", "sd").withColumn("w", grid)
    mixed = MG.blend(merged, local, ["decision", "w"], F.col("w"))
    b_m = MG.merged_intercept(fit.model.join(m, "unit"), ["decision"]).select("decision", F.col("intercept").alias("bm"))
    b_l = fit.model.join(tgt, "unit").select("decision", F.col("intercept").alias("bl"))
    icpt = b_m.join(b_l, "decision").withColumn("w", grid).select(
        "decision", "w", (F.col("w") * F.col("bl") + (1 - F.col("w")) * F.col("bm")).alias("intercept"))
    models = model_rows(mixed, icpt, ["decision", "w"], d, ["coef", "mu", "sd"])
    s = linear_metrics(fit.test, tgt.select("decision", "unit").join(models, "decision"), ["decision", "w"], "unit", y, xs)
    return s.join(tgt.select("decision", "unit", "n_partners"), "decision").select(
        "decision", "unit", "n_partners", "w", "auprc")


def method_scores(fit: Fitted, members: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Long scores (method, decision, unit, y, p) of local, merge, random effects and ensemble."""
    d = len(xs)
    members = materialise(complete(members, fit))
    tgt = members.where("is_target").select("decision", "unit")
    own = materialise(model_rows(fit.coef, fit.model.select("unit", "raw_b"), ["unit"], d, ["raw", "mu"]))
    j = fit.test.join(materialise(tgt.join(own, "unit")), "unit")
    local = j.select(F.lit("local").alias("method"), "decision", "unit", y, score_raw(j, xs, F.col("raw_b")).alias("p"))
    merge = merged_scores(fit, members, merged_rows(fit, members, d), y, xs).select(
        F.lit("merge").alias("method"), "decision", "unit", y, "p")
    m = members.select("decision", "unit")
    mc = materialise(fit.coef.join(m, "unit"))
    re = MG.random_effects(mc, ["decision"]).select("decision", "var", "raw").join(
        MG.coordinate_merge(mc, ["decision"], "raw", "fisher").select("decision", "var", "mu"), ["decision", "var"])
    icpt = MG.merged_intercept(fit.model.join(m, "unit"), ["decision"], "raw_b").select(
        "decision", F.col("intercept").alias("raw_b"))
    jr = fit.test.join(materialise(tgt.join(model_rows(re, icpt, ["decision"], d, ["raw", "mu"]), "decision")), "unit")
    rand = jr.select(F.lit("random_effects").alias("method"), "decision", "unit", y,
                     score_raw(jr, xs, F.col("raw_b")).alias("p"))
    sets = m.join(own, "unit").groupBy("decision").agg(
        F.array_sort(F.collect_list(F.struct("unit", "raw_b", "__raw", "__mu"))).alias("__members"))  # a decision's few models
    je = fit.test.join(materialise(tgt.join(sets, "decision")), "unit")
    ens = je.select(F.lit("ensemble").alias("method"), "decision", "unit", y, mean_raw_score(xs, "__members").alias("p"))
    return local.unionByName(merge).unionByName(rand).unionByName(ens)


def method_table(scores: DataFrame, y: str) -> DataFrame:
    """Per (method, decision) discrimination, Brier and calibration slope."""
    s = materialise(scores)
    m = score_metrics(s, ["method", "decision"], y)
    c = calibration_line(s, ["method", "decision"], y).drop("converged").withColumnRenamed("slope", "calibration_slope")
    return m.join(c.select("method", "decision", "calibration_slope"), ["method", "decision"], "left")


def with_local_intercept(scores: DataFrame, shifts: DataFrame, method: str) -> DataFrame:
    """A method's scores after adding each unit's refitted intercept shift."""
    j = scores.where(F.col("method") == method).join(shifts, ["decision"])
    p = 1 / (1 + F.exp(-(logit(F.col("p")) + F.col("shift"))))
    return j.select(F.lit(f"{method}+intercept").alias("method"), "decision", "unit", "y", p.alias("p"))


def repeated_cv(df: DataFrame, y: str, ids: list[str], fit_score, seeds: list[int], k: int = 5) -> DataFrame:
    """Fold metrics of a method: ``fit_score(train, test)`` returns test rows with ``p``.

    Anything fitted must be fitted on ``train``; a missing prediction is an error.
    """
    from sitelattice.operators.sampling import stratified_folds
    out = None
    for seed in seeds:
        rows = materialise(stratified_folds(df, ids, y, f"cv/{seed}", k))
        for fold in range(k):
            test = rows.where(F.col("fold") == fold)
            s = fit_score(rows.where(F.col("fold") != fold), test).select(
                F.lit(seed).alias("seed"), F.lit(fold).alias("fold"), y, "p")
            out = s if out is None else out.unionByName(s)
    scored = materialise(out)
    bad = scored.where("p IS NULL").limit(1).count()
    if bad:
        raise ValueError("a test row has no prediction")
    m = score_metrics(scored, ["seed", "fold"], y)
    c = calibration_line(scored, ["seed", "fold"], y).select(
        "seed", "fold", F.col("slope").alias("calibration_slope"), F.col("intercept").alias("calibration_intercept"))
    return m.join(c, ["seed", "fold"], "left")
