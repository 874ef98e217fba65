"""Registered queries of the heavier learners: imputers, tuning, blends, boosting."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelattice.operators import boosting as BO
from sitelattice.operators import grouped_trees as GT
from sitelattice.operators import imputation as IM
from sitelattice.operators import metrics as ME
from sitelattice.operators import neighbours as NB
from sitelattice.operators import patternblend as PB
from sitelattice.operators import patternmodels as PM
from sitelattice.operators import patterns as PT
from sitelattice.operators import sitemodels as SM
from sitelattice.operators import tuning as TU
from sitelattice.operators.sampling import stratified_folds
from sitelattice.session import materialise
from sitelattice.suite import inputs as I
from sitelattice.suite.inputs import DAY, XS, split, sql
from sitelattice.suite.patterns import fitted_patterns
from sitelattice.suite.registry import query


def r5(c, name):
    return F.round(c, 5).alias(name)


def _quality(df):
    """Metrics of scores that are written first: they are read twice and may be costly to work out."""
    return ME.score_metrics(materialise(df.select("y", "p")), []).select("n", *[r5(F.col(c), c) for c in ("auroc", "auprc", "brier")])


_A = ",".join(f"q.x{j} AS a{j}, r.x{j} AS b{j}" for j in range(5))
_COM = "+".join(f"(CASE WHEN q.x{j} IS NOT NULL AND r.x{j} IS NOT NULL THEN 1 ELSE 0 END)" for j in range(5))
_SQ = "+".join(f"coalesce((q.x{j}-r.x{j})*(q.x{j}-r.x{j}),0)" for j in range(5))
_KNN = f"""SELECT q.row_id, r.row_id AS donor, {_A}, round(sqrt(({_SQ})*5.0/({_COM})),9) AS dist FROM ud q JOIN ud r ON ({_COM})>0
 WHERE q.x0 IS NULL OR q.x1 IS NULL OR q.x2 IS NULL OR q.x3 IS NULL OR q.x4 IS NULL"""


@query("knn_impute", sql("SELECT u.row_id, " + ", ".join(f"round(coalesce(x{j}, f{j}, m{j}),5) AS x{j}" for j in range(5)) + " FROM ud u "
       + " ".join(f"LEFT JOIN (SELECT row_id, avg(b{j}) AS f{j} FROM (SELECT row_id, b{j} FROM pr WHERE a{j} IS NULL AND b{j} IS NOT NULL"
                  f" QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY dist, donor)<=5) GROUP BY 1) k{j} ON k{j}.row_id=u.row_id" for j in range(5))
       + " CROSS JOIN (SELECT " + ", ".join(f"avg(x{j}) AS m{j}" for j in range(5)) + " FROM ud)", "ud", extra={"pr": _KNN}).replace("pr AS (", "pr AS MATERIALIZED ("))
def knn_impute(spark, d):
    k = NB.knn_impute(materialise(I.user_day(spark, d)), DAY, "row_id", 5)
    return k.select("row_id", *[r5(F.col(x), x) for x in DAY])


@query("knn_impute_logistic")
def knn_impute_logistic(spark, d):
    """Donors are training rows for both parts."""
    train, test = split(I.user_day(spark, d))
    tr = materialise(NB.knn_impute(train, DAY, "row_id", 5))
    return _quality(SM.pooled_fit(tr, "y", DAY, indicators=False)[1](NB.knn_impute(test, DAY, "row_id", 5, donors=train)))


@query("chained_equations")
def chained_equations(spark, d):
    """Fitted on the training part, replayed on the held-out part, then a logistic."""
    train, test = split(I.site_matrix(spark, d))
    fill = IM.chained_equations(train, XS)
    tr = materialise(IM.mapped(train, XS, fill, XS))
    return _quality(SM.pooled_fit(tr, "y", XS, indicators=False)[1](IM.mapped(test, XS, fill, XS)))


@query("forest_impute")
def forest_impute(spark, d):
    train, test = split(I.user_day(spark, d))
    filled, apply = IM.fit_forest_imputer(train, DAY)
    return _quality(SM.pooled_fit(filled, "y", DAY, indicators=False)[1](apply(test)))


@query("residual_mask")
def residual_mask(spark, d):
    r = IM.residual_mask(materialise(I.site_matrix(spark, d).select("site", *XS)), XS)
    return r.groupBy("site").agg(*[r5(F.avg(f"r{j}"), f"r{j}") for j in range(8)])


@query("residual_mask_logistic")
def residual_mask_logistic(spark, d):
    train, test = split(I.site_matrix(spark, d))
    rs = [f"r{j}" for j in range(8)]
    residual = IM.residual_mask_model(train, XS)
    tr = materialise(IM.mapped(train, XS, residual, rs))
    return _quality(SM.pooled_fit(tr, "y", [*XS, *rs], indicators=False)[1](IM.mapped(test, XS, residual, rs)))


@query("mask_interaction_logistic")
def mask_interaction_logistic(spark, d):
    """[x, m, m (x) x] design, C = 1e-4 on the summed loss."""
    train, test = split(I.site_matrix(spark, d))
    return _quality(IM.mask_interaction_logistic(train, "y", XS)(test))


@query("reduced_feature_ensemble")
def reduced_feature_ensemble(spark, d):
    train, test = split(I.site_matrix(spark, d))
    return _quality(IM.reduced_feature_ensemble(train, test, "y", XS))


@query("reduced_feature_trees")
def reduced_feature_trees(spark, d):
    train, test = split(I.user_day(spark, d))
    return _quality(BO.reduced_feature_trees(train, test, "y", DAY, ["row_id"]))


@query("boosted_trees")
def boosted_trees(spark, d):
    """Every site's own boosted trees, the mean of all sites' and the pooled ones: scores by site on held-out rows."""
    train, test = split(I.site_matrix(spark, d))
    model = GT.fit_grouped(train, "site", "y", XS, ["row_id"])
    s = materialise(GT.score_grouped(test.select("site", "row_id", "y", *XS), "site", model))
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"p_{a}").alias("p")) for a in ("local", "ensemble", "pooled")])
    long = s.select("site", "y", F.inline(arms)).where("p IS NOT NULL")
    m = ME.score_metrics(long, ["site", "arm"])
    return m.select("site", "arm", "n", *[r5(F.col(c), c) for c in ("auroc", "auprc", "brier")])


_STUMP = {0: [5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0], 2: [0.015, 0.035, 0.055, 0.075], 6: [8.5, 16.5, 24.5, 32.5, 40.5]}


def _stump_sql() -> dict[str, str]:
    bins = " UNION ALL ".join(f"SELECT site, y, {i} AS var, CASE WHEN x{j} IS NOT NULL THEN {'+'.join(f'(x{j}>{e})::INT' for e in es)} END AS bin FROM sm"
                              for i, (j, es) in enumerate(_STUMP.items()))
    cuts = " UNION ALL ".join(f"SELECT {i} AS var, unnest(range({len(es) + 1}))::INT AS cut" for i, es in enumerate(_STUMP.values()))
    gain = lambda s: f"(n{s}*p-q{s})*(n{s}*p-q{s})/(n{s}*p*(1-p)+1)"
    return {"b": f"SELECT site, y, var, bin FROM ({bins}) UNION ALL SELECT 'all', y, var, bin FROM ({bins})",
            "t": "SELECT site, var, count(*) AS n, sum(y) AS q, avg(y) AS p FROM b GROUP BY 1,2",
            "l": f"""SELECT b.site, c.var, c.cut, m.ml, count(*) AS nl, sum(y) AS ql FROM b JOIN ({cuts}) c USING (var) CROSS JOIN (VALUES (false),(true)) m(ml)
             WHERE (bin IS NULL AND ml) OR bin<=c.cut GROUP BY 1,2,3,4""",
            "s": f"""SELECT *, {gain('l')}+{gain('r')}-{gain('')} AS gain FROM (SELECT l.*, t.n, t.q, t.p, n-nl AS nr, q-ql AS qr FROM l JOIN t USING (site, var))
             WHERE nl>=20 AND nr>=20"""}


@query("boosted_stumps", sql("""SELECT site, var AS feature, cut, ml AS missing_left, round((ql-nl*p)/(nl*p*(1-p)+1),6) AS left_value,
 round((qr-nr*p)/(nr*p*(1-p)+1),6) AS right_value FROM s WHERE gain>1e-9 QUALIFY row_number() OVER (PARTITION BY site ORDER BY round(gain,8) DESC, ml, var, cut)=1""",
                             "sm", extra=_stump_sql()))
def boosted_stumps(spark, d):
    """The first split of every site's trees and of the pooled ones, over fixed bins of three variables."""
    xs = [f"x{j}" for j in _STUMP]
    m = I.site_matrix(spark, d).select("site", "y", "row_id", *xs)
    model = GT.fit_grouped(m, "site", "y", xs, ["row_id"], iterations=1, leaves=2, rate=1.0, share=0.0, edges=list(_STUMP.values()))
    rows = [(name or "all", t.feature[0], t.cut[0], t.missing_left[0], float(t.value[1]), float(t.value[2]))
            for name, trees in zip(model.names, model.trees) for t in trees]
    out = spark.createDataFrame(rows, "site string, feature int, cut int, missing_left boolean, left_value double, right_value double")
    return out.select("site", "feature", "cut", "missing_left", F.round("left_value", 6).alias("left_value"), F.round("right_value", 6).alias("right_value"))


@query("mask_informativeness")
def mask_informativeness(spark, d):
    i = BO.mask_informativeness(I.site_matrix(spark, d), XS, "y", ["row_id"], folds=3, iterations=5)
    return i.select(r5(F.col("iota"), "iota"), "n")


@query("local_tuning")
def local_tuning(spark, d):
    m = materialise(I.site_matrix(spark, d))
    t = TU.local_variants(m, "site", "y", XS, ["row_id"], "tune")
    return t.select("site", "variant", "k", r5(F.col("c"), "c"), r5(F.col("cv_auprc"), "cv_auprc"), "chosen")


@query("learning_curve")
def learning_curve(spark, d):
    m = materialise(I.site_matrix(spark, d))
    c = TU.learning_curve(m, "site", "y", XS, ["row_id"], "curve")
    return c.select("site", *[r5(F.col(x), x) for x in ("c1", "c2", "c3", "c4", "slope_last", "climb_half", "level")])


@query("pattern_blend")
def pattern_blend(spark, d):
    """Pooled, local and cross-validated blend by missingness pattern, on held-out rows."""
    m = I.site_matrix(spark, d).withColumn("pattern", PM.pattern_key(XS))
    train, test = split(m)
    scored = materialise(PB.fit_blend(train, test, "pattern", "y", XS, ["row_id"])[0])
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), PB.arm_score(a).alias("p")) for a in ("pooled", "local", "blend_cv")])
    return ME.score_metrics(scored.select("y", F.inline(arms)), ["arm"]).select("arm", "n", *[r5(F.col(c), c) for c in ("auroc", "auprc", "brier")])


@query("kappa_by_cv")
def kappa_by_cv(spark, d):
    """Rooted shrinkage strength by inner CV: mean AUPRC of every kappa of the grid."""
    u = materialise(stratified_folds(I.user_day(spark, d), ["row_id"], "y", "kappa", 3))
    out = None
    for f in range(3):
        tr, va = u.where(F.col("fold") != f), u.where(F.col("fold") == f)
        real, fit = fitted_patterns(tr, DAY)
        _, score = SM.pooled_fit(tr, "y", DAY, indicators=False)
        theta = materialise(PM.fit_submodels(tr, DAY, "y", real, fit, score.mu, score.sd))
        edges = materialise(PT.immediate_ancestors(fit, 5))
        root = {PM.INTERCEPT: score.std_bias, **{j: float(w) for j, w in enumerate(score.std_weights)}}
        th = PM.shrink_rooted(theta, fit, edges, root, PM.KAPPA_GRID)
        s = PM.predict_at(va, DAY, th, fit, PM.KAPPA_GRID, ["fold", "y"], prior=0.5, mu=score.mu, sd=score.sd,
                          root=root, fill=score.fill)
        out = s if out is None else out.unionByName(s)
    k = PM.choose_kappa(materialise(out), "y")
    return k.select(F.col("kappa").cast("string").alias("kappa"), r5(F.col("mean_auprc"), "mean_auprc"))
