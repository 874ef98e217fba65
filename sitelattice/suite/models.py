"""Registered model queries: site models, merges, pattern models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sitelattice.operators import fused as FU
from sitelattice.operators import merging as MG
from sitelattice.operators import metrics as ME
from sitelattice.operators import patternmodels as PM
from sitelattice.operators import patterns as PT
from sitelattice.operators import sitemodels as SM
from sitelattice.operators.blockmetrics import linear_metrics
from sitelattice.session import materialise
from sitelattice.suite import inputs as I
from sitelattice.suite.inputs import DAY, XS, split, sql
from sitelattice.suite.patterns import fitted_patterns, pat_ctes
from sitelattice.suite.registry import query


def r6(c, name):
    return F.round(c, 6).alias(name)


def r5(c, name):
    return F.round(c, 5).alias(name)


# --- closed-form pattern parameters: slopes on the rows that realise the pattern ------------

_THETA = " UNION ALL ".join(
    f"""SELECT pattern, {j} AS var, coalesce(regr_slope(y,x{j}),0.0) AS value FROM ud2 JOIN fit USING (pattern)
    WHERE x{j} IS NOT NULL GROUP BY 1""" for j in range(5)) + """
    UNION ALL SELECT pattern, -1, avg(y)-0.5 FROM ud2 JOIN fit USING (pattern) GROUP BY 1"""
_UD2 = "SELECT *, array_to_string(list_sort(list_distinct([" + ",".join(
    f"CASE WHEN x{j} IS NOT NULL THEN {j} END" for j in range(5)) + "])),',') AS pattern FROM ud"
_PAT = {**pat_ctes("ud", 5, 30), "ud2": _UD2, "th": _THETA}


def closed_form_theta(u, fit):
    """One pass over the rows: per-pattern univariate slopes and a centred rate."""
    k = u.withColumn("pattern", PM.pattern_key(DAY)).join(fit.select("pattern"), "pattern", "left_semi")
    a = k.groupBy("pattern").agg(
        *[F.regr_slope("y", x).alias(f"b{j}") for j, x in enumerate(DAY)],
        *[F.count(x).alias(f"c{j}") for j, x in enumerate(DAY)], (F.avg("y") - 0.5).alias("b"))
    cells = [F.struct(F.lit(j).alias("var"), F.when(F.col(f"c{j}") > 0, F.coalesce(F.col(f"b{j}"), F.lit(0.0))).alias("value"))
             for j in range(5)]
    cells.append(F.struct(F.lit(-1).alias("var"), F.col("b").alias("value")))
    return a.select("pattern", F.inline(F.array(*cells))).where("value IS NOT NULL")


def _pattern_setup(spark, d):
    u = materialise(I.user_day(spark, d))
    real, fit = fitted_patterns(u, DAY)
    edges = materialise(PT.immediate_ancestors(fit, 5))
    return u, real, fit, edges, materialise(closed_form_theta(u, fit))


def _shrink_ctes(kappas: list[float], sizes=range(1, 6)) -> dict[str, str]:
    out, prev = {}, None
    ks = "[" + ",".join(map(repr, kappas)) + "]::DOUBLE[]"
    for s in sizes:
        cur = f"SELECT th.*, kappa, support FROM th JOIN fit USING (pattern), (SELECT unnest({ks}) AS kappa) WHERE size={s}"
        if prev is None:
            out[f"s{s}"] = f"SELECT pattern, var, kappa, value, support FROM ({cur})"
        else:
            out[f"s{s}"] = f"""SELECT * FROM {prev} UNION ALL SELECT c.pattern, c.var, c.kappa,
              CASE WHEN target IS NULL THEN value ELSE support/(support+c.kappa)*value+(1-support/(support+c.kappa))*target END AS value, support
              FROM ({cur}) c LEFT JOIN (SELECT child AS pattern, kappa, var, sum(support*value)/sum(support) AS target
                FROM edge JOIN {prev} ON pattern=parent GROUP BY 1,2,3) USING (pattern, kappa, var)"""
        prev = f"s{s}"
    return out


@query("shrink_levels", sql("SELECT pattern, var, kappa, round(value,6) AS value FROM s5", "ud", extra={**_PAT, **_shrink_ctes([1.0, 100.0, 1000.0])}))
def shrink_levels(spark, d):
    _, _, fit, edges, theta = _pattern_setup(spark, d)
    s = PM.shrink(theta, fit, edges, [1.0, 100.0, 1000.0])
    return s.select("pattern", "var", "kappa", r6(F.col("value"), "value"))


def _coordinate_ctes(kappa: float, sizes=range(1, 6)) -> dict[str, str]:
    """Levels with the prior's strength scaled by the ancestor support behind each variable."""
    out, prev = {}, None
    for s in sizes:
        cur = f"SELECT th.*, support FROM th JOIN fit USING (pattern) WHERE size={s}"
        if prev is None:
            out[f"s{s}"] = f"SELECT pattern, var, value, support FROM ({cur})"
        else:
            out[f"s{s}"] = f"""SELECT * FROM {prev} UNION ALL SELECT pattern, var, CASE WHEN target IS NULL THEN value ELSE
              support/(support+k)*value+(1-support/(support+k))*target END AS value, support FROM (
              SELECT *, CASE WHEN var>=0 AND mass>0 THEN {kappa}*mass/avg(CASE WHEN var>=0 THEN mass END) OVER (PARTITION BY pattern) ELSE {kappa} END AS k
              FROM ({cur}) LEFT JOIN (SELECT child AS pattern, var, sum(support*value)/sum(support) AS target, sum(support)::DOUBLE AS mass
                FROM edge JOIN {prev} ON pattern=parent GROUP BY 1,2) USING (pattern, var))"""
        prev = f"s{s}"
    return out


@query("shrink_coordinatewise", sql("SELECT pattern, var, 100.0::DOUBLE AS kappa, round(value,6) AS value FROM s5", "ud",
                                    extra={**_PAT, **_coordinate_ctes(100.0)}))
def shrink_coordinatewise(spark, d):
    _, _, fit, edges, theta = _pattern_setup(spark, d)
    s = PM.shrink(theta, fit, edges, [100.0], coordinatewise=True)
    return s.select("pattern", "var", "kappa", r6(F.col("value"), "value"))


_COVER = """SELECT row_id, round(least(greatest(coalesce(sum({w}*p)/sum(CASE WHEN p IS NOT NULL THEN {w} END),0.5),1e-6),1-1e-6),6) AS p, count(p) AS n_models FROM (
 SELECT row_id, support, 1/(1+exp(-(b+{z}))) AS p FROM ud2 LEFT JOIN (SELECT o.pattern, e.pattern AS member FROM pat o JOIN fit e ON e.bits & o.bits = e.bits) USING (pattern)
 LEFT JOIN (SELECT pattern AS member, any_value(support) AS support, """ + ", ".join(
    f"max(CASE WHEN var={j} THEN value END) AS t{j}" for j in range(5)) + """, max(CASE WHEN var=-1 THEN value END) AS b FROM {src} GROUP BY 1) USING (member)
 CROSS JOIN (SELECT """ + ", ".join(f"avg(x{j}) AS m{j}, stddev_pop(x{j}) AS d{j}" for j in range(5)) + " FROM ud)) GROUP BY 1"
_ZED = "+".join(f"coalesce(t{j}*(x{j}-m{j})/d{j},0)" for j in range(5))


def _cover_query(spark, d, theta, u, fit, weighted):
    mu, sd = PM.observed_scaler(u, DAY)
    p = PM.cover_predict(u, DAY, theta, fit, 0.5, mu, sd, weighted)
    return p.select("row_id", r6(F.col("p"), "p"), F.col("n_models").cast("bigint").alias("n_models"))


@query("cover_predict", sql(_COVER.format(w="support", z=_ZED, src="(SELECT * FROM s5 WHERE kappa=100)"), "ud", extra={**_PAT, **_shrink_ctes([100.0])}))
def cover_predict(spark, d):
    u, _, fit, edges, theta = _pattern_setup(spark, d)
    return _cover_query(spark, d, PM.shrink(theta, fit, edges, [100.0]), u, fit, True)


@query("cover_vote", sql(_COVER.format(w="1.0", z=_ZED, src="(SELECT * FROM th JOIN fit USING (pattern))"), "ud", extra=_PAT))
def cover_vote(spark, d):
    u, _, fit, _, theta = _pattern_setup(spark, d)
    return _cover_query(spark, d, theta, u, fit, False)


@query("global_shrink", sql("""SELECT t.pattern, t.var, round(CASE WHEN g.value IS NULL THEN t.value ELSE support/(support+100.0)*t.value+(1-support/(support+100.0))*g.value END,6) AS value
 FROM th t JOIN fit USING (pattern) LEFT JOIN (SELECT * FROM th WHERE pattern=(SELECT pattern FROM fit ORDER BY size, pattern LIMIT 1)) g ON g.var=t.var""", "ud", extra=_PAT))
def global_shrink(spark, d):
    _, _, fit, _, theta = _pattern_setup(spark, d)
    return PM.toward_global(theta, fit, 100.0).select("pattern", "var", r6(F.col("value"), "value"))


@query("ancestor_discrepancy", sql("""SELECT child, parent, n_shared, round(m,6) AS mean_abs_diff, c.size AS pattern_size, p.size AS ancestor_size FROM (
 SELECT child, parent, count(*) AS n_shared, avg(abs(a.value-b.value)) AS m FROM edge JOIN th a ON a.pattern=child JOIN th b ON b.pattern=parent AND a.var=b.var
 WHERE a.var>=0 GROUP BY 1,2) JOIN fit c ON c.pattern=child JOIN fit p ON p.pattern=parent""", "ud", extra=_PAT))
def ancestor_discrepancy(spark, d):
    _, _, fit, edges, theta = _pattern_setup(spark, d)
    a = PM.ancestor_discrepancy(theta, edges, fit)
    return a.select("child", "parent", "n_shared", r6(F.col("mean_abs_diff"), "mean_abs_diff"), "pattern_size", "ancestor_size")


# --- fitted pattern models -----------------------------------------------------------------

def _fit_patterns(u, floor=30):
    real, fit = fitted_patterns(u, DAY, floor)
    mu, sd = PM.observed_scaler(u, DAY)
    theta = materialise(PM.fit_submodels(u, DAY, "y", real, fit, mu, sd))
    return real, fit, mu, sd, theta


@query("pattern_submodels")
def pattern_submodels(spark, d):
    return _fit_patterns(materialise(I.user_day(spark, d)))[-1].select("pattern", "var", r5(F.col("value"), "value"))


@query("hierarchical_shrinkage")
def hierarchical_shrinkage(spark, d):
    """kappa = median support; metrics of the cover prediction of held-out rows and their no-match rate."""
    train, test = split(I.user_day(spark, d))
    _, fit, mu, sd, theta = _fit_patterns(train)
    edges = PT.immediate_ancestors(fit, 5)
    kappa = PM.median_support(fit)
    prior = train.agg(F.avg("y").alias("m")).first()["m"]
    p = materialise(PM.cover_predict(test, DAY, PM.shrink(theta, fit, edges, [kappa]), fit, prior, mu, sd))
    m = ME.score_metrics(p, [])
    miss = p.agg(F.avg((F.col("n_models") == 0).cast("double")).alias("no_match_rate"))
    return m.join(F.broadcast(miss)).select(  # one row each
        F.lit(kappa).alias("kappa"), "n", *[r5(F.col(c), c) for c in ("auroc", "auprc", "brier", "no_match_rate")])


def _root_of(score) -> dict[int, float]:
    return {PM.INTERCEPT: score.std_bias, **{j: float(w) for j, w in enumerate(score.std_weights)}}


@query("rooted_shrinkage")
def rooted_shrinkage(spark, d):
    """Rooted at the mean-imputed pooled model; infinite kappa must equal that model. Scored on held-out rows."""
    train, test = split(I.user_day(spark, d))
    real, fit = fitted_patterns(train, DAY, 30)
    _, score = SM.pooled_fit(train, "y", DAY, indicators=False)
    theta = materialise(PM.fit_submodels(train, DAY, "y", real, fit, score.mu, score.sd))
    edges = materialise(PT.immediate_ancestors(fit, 5))
    root = _root_of(score)
    base = materialise(score(test).select("row_id", F.col("p").alias("root_p")))
    out = None
    for k in (0.0, 500.0, float("inf")):
        th = PM.shrink_rooted(theta, fit, edges, root, [k])
        p = PM.cover_predict(test, DAY, th, fit, 0.5, score.mu, score.sd, root=root, fill=score.fill)
        p = materialise(p.join(base, "row_id"))
        gap = p.agg(F.max(F.abs(F.col("p") - F.col("root_p"))).alias("g"))
        row = ME.score_metrics(p, []).join(F.broadcast(gap)).select(  # one row each
            F.lit(str(k)).alias("kappa"), "n", r5(F.col("auroc"), "auroc"), r5(F.col("auprc"), "auprc"),
            (F.col("g") < 1e-6).alias("equals_root"))
        out = row if out is None else out.unionByName(row)
    return out


@query("fused_patterns")
def fused_patterns(spark, d):
    """Fitted on the training part with the fusion penalty, scored on the held-out part."""
    train, test = split(I.user_day(spark, d))
    real, fit = fitted_patterns(train, DAY)
    mu, sd = PM.observed_scaler(train, DAY)
    edges = materialise(PT.immediate_ancestors(fit, 5))
    theta = materialise(FU.fit_fused(train, DAY, "y", PM.pattern_key(DAY), PT.most_specific(fit, real, 5), fit, edges, mu, sd, lam=5.0))
    prior = train.agg(F.avg("y").alias("m")).first()["m"]
    every = materialise(PT.pattern_counts(test, DAY))
    p = PM.predict_fused(test, DAY, theta, PT.most_specific(fit, every, 5), prior, mu, sd)
    return (ME.score_metrics(p, []).join(F.broadcast(theta.agg(F.bool_and("converged").alias("converged"))))  # one row each
            .select("n", *[r5(F.col(c), c) for c in ("auroc", "auprc", "brier")], "converged"))


def _fused_ctes(lam: float, ridge: float, steps: int) -> dict[str, str]:
    """Two variables, three tied patterns: every weight goes down its own curvature until nothing moves."""
    z = ", ".join(f"(x{j}-(SELECT avg(x{j}) FROM ud))/(SELECT stddev_pop(x{j}) FROM ud) AS z{j}" for j in (0, 1))
    e = "a0+coalesce(b0*z0,0)", "a1+coalesce(b1*z1,0)", "a2+b20*z0+b21*z1"
    eta = f"CASE k WHEN 0 THEN {e[0]} WHEN 1 THEN {e[1]} ELSE {e[2]} END"
    cells = [("a0", 0, "1", None), ("b0", 0, "z0", "b20"), ("a1", 1, "1", None), ("b1", 1, "z1", "b21"),
             ("a2", 2, "1", None), ("b20", 2, "z0", "b0"), ("b21", 2, "z1", "b1")]
    names = [c[0] for c in cells]
    new = []
    for w, k, x, tied in cells:
        pull = f"-2*{ridge}*{w}-2*{lam}*({w}-{tied})" if tied else ""
        more = f"+2*{ridge}+2*{lam}" if tied else ""
        new.append(f"{w}+0.6*(sum(CASE WHEN k={k} THEN (y-q)*{x} ELSE 0 END){pull})/(sum(CASE WHEN k={k} THEN q*(1-q)*{x}*{x} ELSE 0 END){more}) AS {w}")
    return {"z": f"SELECT y, {z}, CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN 2 WHEN x0 IS NOT NULL THEN 0 WHEN x1 IS NOT NULL THEN 1 END AS k "
                 "FROM ud WHERE x0 IS NOT NULL OR x1 IS NOT NULL",
            "it": "SELECT 0 AS step, " + ", ".join(f"0.0::DOUBLE AS {w}" for w in names) + f""" UNION ALL
             SELECT step+1, {', '.join(new)} FROM (SELECT *, 1/(1+exp(-({eta}))) AS q FROM it CROSS JOIN z WHERE step<{steps})
             GROUP BY step, {', '.join(names)}"""}


_FUSED = [("0", -1, "a0"), ("0", 0, "b0"), ("1", -1, "a1"), ("1", 1, "b1"), ("0,1", -1, "a2"), ("0,1", 0, "b20"), ("0,1", 1, "b21")]


@query("fused_two_variables", sql(" UNION ALL ".join(
    f"SELECT '{p}' AS pattern, {v} AS var, round({w},4) AS value, true AS converged FROM it WHERE step=120" for p, v, w in _FUSED),
    "ud", extra=_fused_ctes(5.0, 0.01, 120), recursive=True))
def fused_two_variables(spark, d):
    u, xs = materialise(I.user_day(spark, d)), DAY[:2]
    real, fit = fitted_patterns(u, xs, 1)
    mu, sd = PM.observed_scaler(u, xs)
    theta = FU.fit_fused(u, xs, "y", PM.pattern_key(xs), PT.most_specific(fit, real, 2), fit, PT.immediate_ancestors(fit, 2), mu, sd, lam=5.0)
    return theta.select("pattern", "var", F.round("value", 4).alias("value"), "converged")


# --- site models ---------------------------------------------------------------------------

def _site_fit(spark, d):
    m = materialise(I.site_matrix(spark, d))
    model, coef = SM.fit_sites(m, "site", "y", XS)
    return m, model, coef


@query("site_models")
def site_models(spark, d):
    _, model, coef = _site_fit(spark, d)
    return coef.join(model.select("site", "raw_b"), "site").select(
        "site", "var", "n", *[r5(F.col(c), c) for c in ("mu", "sd", "coef", "raw", "raw_b")], F.round("info", 3).alias("info"))


def _one_variable_ctes(steps: int) -> dict[str, str]:
    """Penalised Newton of y on one standardised, mean-filled variable, unrolled."""
    out = {"z": """SELECT site, y, coalesce((x0-m)/s,0.0) AS z FROM sm JOIN (SELECT site, avg(x0) AS m,
             stddev_pop(x0)*sqrt(count(x0)/count(*)::DOUBLE) AS s FROM sm GROUP BY 1) USING (site)""",
           "t0": "SELECT site, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM z GROUP BY 1"}
    for i in range(steps):
        out[f"t{i + 1}"] = f"""SELECT site, a+(g0*h2-g1*h1)/(h0*h2-h1*h1) AS a, b+(g1*h0-g0*h1)/(h0*h2-h1*h1) AS b FROM (
          SELECT site, any_value(a) AS a, any_value(b) AS b, sum(y-q) AS g0, sum((y-q)*z)-any_value(b) AS g1, sum(q*(1-q)) AS h0,
          sum(q*(1-q)*z) AS h1, sum(q*(1-q)*z*z)+1 AS h2 FROM (SELECT z.*, a, b, 1/(1+exp(-(a+b*z))) AS q FROM z JOIN t{i} USING (site)) GROUP BY 1)"""
    return out


@query("site_models_one_variable", sql("SELECT site, round(b,6) AS coef, round(a,6) AS intercept FROM t7", "sm", extra=_one_variable_ctes(7)))
def site_models_one_variable(spark, d):
    m = materialise(I.site_matrix(spark, d).select("site", "y", "x0"))
    model, coef = SM.fit_sites(m, "site", "y", ["x0"])
    return coef.join(model.select("site", "intercept"), "site").select(
        "site", r6(F.col("coef"), "coef"), r6(F.col("intercept"), "intercept"))


def _fed_ctes(rounds: int, epochs: int) -> dict[str, str]:
    out = {"z": _one_variable_ctes(0)["z"], "w0": "SELECT site, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, count(*) AS n FROM z GROUP BY 1"}
    k = 0
    for _ in range(rounds):
        for _ in range(epochs):
            out[f"w{k + 1}"] = f"""SELECT site, any_value(a)-avg(q-y) AS a, any_value(b)-avg((q-y)*z) AS b, count(*) AS n FROM (
              SELECT z.*, a, b, 1/(1+exp(-(a+b*z))) AS q FROM z JOIN w{k} USING (site)) GROUP BY 1"""
            k += 1
        out[f"w{k + 1}"] = f"SELECT site, (SELECT sum(n*a)/sum(n) FROM w{k}) AS a, (SELECT sum(n*b)/sum(n) FROM w{k}) AS b, n FROM w{k}"
        k += 1
    return {c: f"{v}" for c, v in out.items()}


@query("fedavg_one_variable", sql("SELECT 0 AS var, round(any_value(b),6) AS value FROM w8 UNION ALL SELECT 1, round(any_value(a),6) FROM w8",
                                  "sm", extra=_fed_ctes(2, 3)))
def fedavg_one_variable(spark, d):
    m = materialise(I.site_matrix(spark, d).select("site", "y", "x0"))
    _, snaps = SM.fedavg(m, "site", "y", ["x0"], rounds=2, checkpoints=(2,), local_epochs=3)
    return spark.createDataFrame([(j, float(snaps[2][j])) for j in range(2)], "var int, value double").withColumn(
        "value", F.round("value", 6))


@query("local_scores")
def local_scores(spark, d):
    train, test = split(I.site_matrix(spark, d), "site")
    model, coef = SM.fit_sites(train, "site", "y", XS)
    own = SM.model_rows(coef, model.select("site", "raw_b"), ["site"], len(XS), ["raw", "mu"])
    return linear_metrics(test, own, ["site"], "site", "y", XS, "raw").select(
        "site", "n", *[r5(F.col(c), c) for c in ("auroc", "auprc", "brier")])


_LIN = "+".join(f"coalesce(coef{j}*(x{j}-mu{j})/sd{j},0)" for j in range(8))
_WIDE = ", ".join(f"max(CASE WHEN var={j} THEN {f} END) AS {f}{j}" for j in range(8) for f in ("coef", "mu", "sd"))


@query("score_merged", sql(f"SELECT row_id, round(1/(1+exp(-(-0.7::DOUBLE+{_LIN}))),6) AS p FROM sm CROSS JOIN (SELECT {_WIDE} FROM mg)", "cf",
                           extra={"mg": "SELECT var, sum(n*coef)/sum(n) AS coef, sum(n*mu)/sum(n) AS mu, greatest(sum(n*sd)/sum(n),1e-9) AS sd FROM cf GROUP BY 1"}))
def score_merged(spark, d):
    m = I.site_matrix(spark, d)
    c = MG.coordinate_merge(I.site_coefficients(spark, d), []).withColumn("k", F.lit(1))
    row = SM.model_rows(c, c.select("k").distinct(), ["k"], 8, ["coef", "mu", "sd"]).drop("k")
    j = m.join(F.broadcast(row))  # one row
    return j.select("row_id", r6(SM.score_std(j, XS, F.lit(-0.7)), "p"))


_LINR = "+".join(f"coalesce(raw{j}*coalesce(x{j},mu{j}),0)" for j in range(8))
_WIDER = ", ".join(f"max(CASE WHEN var={j} THEN {f} END) AS {f}{j}" for j in range(8) for f in ("raw", "mu"))
_ENS = {"md": f"SELECT site AS member, {_WIDER} FROM cf GROUP BY 1",
        "pr": """SELECT a.site, b.site AS member FROM (SELECT DISTINCT site_no, site FROM sm) a JOIN (SELECT DISTINCT site_no, site FROM sm) b
           ON (b.site_no-a.site_no+25)%25 IN (0,1,2)"""}


@query("ensemble", sql(f"SELECT row_id, round(avg(1/(1+exp(-(-0.7::DOUBLE+{_LINR})))),6) AS p FROM sm JOIN pr USING (site) JOIN md USING (member) GROUP BY 1", "cf", extra=_ENS))
def ensemble(spark, d):
    m = materialise(I.site_matrix(spark, d).select("row_id", "site", "site_no", "y", *XS))
    coef = materialise(I.site_coefficients(spark, d, m))
    model = coef.select("site").distinct().withColumn("raw_b", F.lit(-0.7))
    sites = m.select("site", "site_no").distinct()
    near = sites.select("site", F.explode(F.array(*[(F.col("site_no") + i) % 25 for i in range(3)])).alias("site_no"))
    pairs = near.join(sites.withColumnRenamed("site", "member"), "site_no").select("site", "member")
    s = SM.score_by_all(m, "site", XS, model, coef, pairs)
    return SM.ensemble(s, ["row_id"], "y").select("row_id", r6(F.col("p"), "p"))


@query("random_effects_merge")
def random_effects_merge(spark, d):
    _, _, coef = _site_fit(spark, d)
    c = materialise(coef)
    return MG.random_effects(c, []).join(MG.cochran_q(c, []).select("var", "q", "df", "i2"), "var").select(
        "var", "n_sites", F.round("tau2", 5).alias("tau2"), r5(F.col("raw"), "raw"), F.round("q", 3).alias("q"), "df", r5(F.col("i2"), "i2"))


@query("pooled_logistic")
def pooled_logistic(spark, d):
    train, test = split(I.site_matrix(spark, d), "site")
    _, score = SM.pooled_fit(train, "y", XS)
    return ME.score_metrics(score(test), ["site"]).select("site", "n", *[r5(F.col(c), c) for c in ("auroc", "auprc", "brier")])


@query("mean_impute_logistic")
def mean_impute_logistic(spark, d):
    train, test = split(I.site_matrix(spark, d))
    _, score = SM.pooled_fit(train, "y", XS, indicators=False)
    return ME.score_metrics(score(test), []).select("n", *[r5(F.col(c), c) for c in ("auroc", "auprc", "brier")])


@query("aggregated_newton")
def aggregated_newton(spark, d):
    """Merged start, then aggregated Newton snapshots: coefficients at 1, 2 and 5 steps."""
    from sitelattice.operators import newton as N
    m, model, coef = _site_fit(spark, d)
    merged = MG.coordinate_merge(coef, [], "raw", "fisher").orderBy("var").toPandas()  # one row per variable
    b = MG.merged_intercept(model, [], "raw_b").first()["intercept"]
    g = coef.toPandas()  # sites x variables
    sites = sorted(g["site"].unique())
    fill, act = np.zeros((len(sites), 8)), np.zeros((len(sites), 8), bool)
    for s, v, mu in zip(g["site"], g["var"], g["mu"]):
        fill[sites.index(s), v], act[sites.index(s), v] = mu, True
    mu, sd = np.zeros((1, 8)), np.ones((1, 8))
    mu[0, merged["var"]], sd[0, merged["var"]] = merged["mu"], merged["sd"]
    design = N.Design(sites, fill, act, mu, sd, np.ones((1, 8), bool), np.ones(1), [np.array([0])] * len(sites))
    start = np.zeros(9)
    start[merged["var"]] = merged["coef"] * sd[0, merged["var"]]
    start[8] = b + float((merged["coef"] * mu[0, merged["var"]]).sum())
    snaps = N.aggregated_newton(m, "site", "y", XS, design, start, (1, 2, 5))
    rows = [(k, j, float(t[j])) for k, t in snaps.items() for j in range(9)]
    return spark.createDataFrame(rows, "steps int, var int, value double").withColumn("value", F.round("value", 5))


@query("intercept_recalibration")
def intercept_recalibration(spark, d):
    """Intercept shift of the merged model at each site, from the site's own rows."""
    m, model, coef = _site_fit(spark, d)
    c = MG.coordinate_merge(coef, []).withColumn("k", F.lit(1))
    row = SM.model_rows(c, c.select("k").distinct(), ["k"], 8, ["coef", "mu", "sd"]).drop("k")
    b = MG.merged_intercept(model, []).first()["intercept"]
    j = m.join(F.broadcast(row))  # one row
    s = j.withColumn("p", SM.score_std(j, XS, F.lit(float(b))))
    return SM.recalibrated(s, "site", "y", "p").select("site", r5(F.col("shift"), "shift"))


@query("fedavg")
def fedavg(spark, d):
    m = materialise(I.site_matrix(spark, d))
    _, snaps = SM.fedavg(m, "site", "y", XS, rounds=30)
    rows = [(r, j, float(w[j])) for r, w in snaps.items() for j in range(9)]
    return spark.createDataFrame(rows, "round int, var int, value double").withColumn("value", F.round("value", 5))


@query("private_fedavg")
def private_fedavg(spark, d):
    """Every round's release perturbed at its share of the budget, unit-ball rows, rate 0.5."""
    m = materialise(I.site_matrix(spark, d))
    budgets = [1.0, float("inf")]
    _, snaps = SM.fedavg_budgets(m, "site", "y", XS, 30, budgets, checkpoints=(30,), lr=0.5, unit=True)
    rows = [(str(eps), j, float(s[30][j])) for eps, s in zip(budgets, snaps) for j in range(9)]
    return spark.createDataFrame(rows, "eps string, var int, value double").withColumn("value", F.round("value", 5))


@query("private_merge")
def private_merge(spark, d):
    """Site models perturbed at several privacy budgets, merged by rows and by rows squared."""
    m = materialise(I.site_matrix(spark, d))
    _, coef = SM.private_sites(m, "site", "y", XS, [1.0, 5.0, float("inf")])
    c = coef.withColumn("power", F.explode(F.array(F.lit(1), F.lit(2))))
    g = MG.weighted_merge(c, ["eps", "power"], F.pow(F.col("n").cast("double"), F.col("power")))
    return g.select(F.col("eps").cast("string").alias("eps"), "power", "var", r5(F.col("coef"), "coef"))


# --- decision plans ------------------------------------------------------------------------

from sitelattice.operators.ranktests import paired_test_table, signed_rank, spearman  # noqa: E402
from sitelattice.operators.weights import best_weight  # noqa: E402
from sitelattice.plans import decision_table as DT  # noqa: E402
from sitelattice.suite.patterns import site_table  # noqa: E402


def _decision_setup(spark, d, seeds=(0, 1), xs=XS):
    m = materialise(I.site_matrix(spark, d))
    return m, materialise(site_table(spark, d)), DT.split_and_fit(m, "site", "y", list(xs), ["row_id"], list(seeds))


_R = {"benefit": 5, "q_median": 3}


def _rounded(df):
    return df.select(*[F.round(c, _R.get(c, 5)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("merge_decisions")
def merge_decisions(spark, d):
    m, sites, fit = _decision_setup(spark, d)
    return _rounded(DT.observations(m, "site", "y", XS, ["row_id"], [0, 1], sites, fit=fit))


@query("strategy_comparison")
def strategy_comparison(spark, d):
    """Mean benefit and helped share by partner strategy."""
    from sitelattice.operators import partners as PA
    m, sites, fit = _decision_setup(spark, d, (0,))
    pools = PA.candidates(PA.site_pairs(sites), prefix=2)
    sub = PA.strategy_subsets(pools, "strategies", 12)
    mem = DT.draw_members(sites, [0], "s", subsets=sub, extra=["strategy"])
    o = DT.observations(m, "site", "y", XS, ["row_id"], [0], sites, members=mem, fit=fit, extra=["strategy"])
    return o.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), r5(F.avg("helped"), "helped"),
                                     r5(F.avg("benefit"), "mean_benefit"))


@query("dimension_ladder")
def dimension_ladder(spark, d):
    """Same rows with nested feature sets: decisions and mean benefit by dimension."""
    m = materialise(I.site_matrix(spark, d))
    sites = materialise(site_table(spark, d))
    rows = DT.split_rows(m, "site", "y", XS[:6], ["row_id"], [0])  # split once for both
    out = None
    for k in (3, 6):
        fit = DT.fit_split(rows, "y", XS[:k])
        o = DT.observations(m, "site", "y", XS[:k], ["row_id"], [0], sites, dataset=f"d{k}", fit=fit)
        row = o.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), r5(F.avg("epv_target"), "mean_epv"),
                                       r5(F.avg("benefit"), "mean_benefit"))
        out = row if out is None else out.unionByName(row)
    return out


@query("own_weight_curve")
def own_weight_curve(spark, d):
    """AUPRC by own-weight and partner count; best weight and share of merges that help."""
    _, sites, fit = _decision_setup(spark, d, (0,))
    mem = DT.draw_members(sites, [0], "weights")
    c = materialise(DT.own_weight_curve(fit, mem, "y", XS, [i / 10 for i in range(11)]))
    best = best_weight(c, ["decision", "n_partners"], "w", "auprc")
    return best.groupBy("n_partners").agg(F.count(F.lit(1)).alias("n"), r5(F.avg("w"), "mean_oracle_w"),
                                          r5(F.avg("auprc"), "oracle_auprc")).join(
        c.groupBy("n_partners").agg(r5(F.avg(F.when(F.col("w") == 0, F.col("auprc"))), "merge_auprc"),
                                    r5(F.avg(F.when(F.col("w") == 1, F.col("auprc"))), "local_auprc")), "n_partners")


@query("multi_method_benchmark")
def multi_method_benchmark(spark, d):
    """Local, merged, random-effects and ensemble scores per decision, averaged by method."""
    _, sites, fit = _decision_setup(spark, d, (0,))
    mem = DT.draw_members(sites, [0], "methods")
    t = DT.method_table(DT.method_scores(fit, mem, "y", XS), "y")
    return t.groupBy("method").agg(F.count(F.lit(1)).alias("n"), *[
        r5(F.avg(c), c) for c in ("auroc", "auprc", "brier", "calibration_slope")])


@query("heterogeneity_comparison")
def heterogeneity_comparison(spark, d):
    """Methods with and without a locally refitted intercept, paired against the merge."""
    _, sites, fit = _decision_setup(spark, d, (0,))
    mem = DT.draw_members(sites, [0], "het")
    s = materialise(DT.method_scores(fit, mem, "y", XS))
    tr = DT.Fitted(fit.test, fit.train, fit.model, fit.coef, fit.sizes)  # score the training side
    mm = materialise(DT.complete(mem, fit))
    own = DT.merged_scores(tr, mm, DT.merged_rows(fit, mm, 8), "y", XS)
    shifts = SM.recalibrated(own, "decision", "y", "p")
    both = s.unionByName(DT.with_local_intercept(s, shifts, "merge"))
    t = materialise(ME.score_metrics(both, ["method", "decision"]).where("auprc IS NOT NULL"))
    folds = t.select("method", F.lit(0).alias("seed"), F.col("decision").alias("fold"), "auprc")
    test = paired_test_table(folds, "merge", "auprc")
    mean = t.groupBy("method").agg(r5(F.avg("auprc"), "auprc"), r5(F.avg("brier"), "brier"))
    return mean.join(test.select("method", r5(F.col("median_diff"), "median_diff"), r5(F.col("p_raw"), "p_raw"),
                                 r5(F.col("p_holm"), "p_holm"), "n_pairs"), "method", "left")


@query("repeated_cv")
def repeated_cv(spark, d):
    """One repeat of stratified CV of the mean-imputed logistic on user-days, in three folds."""
    u = materialise(I.user_day(spark, d))

    def method(train, test):
        return SM.pooled_fit(train, "y", DAY, indicators=False)[1](test)
    m = DT.repeated_cv(u, "y", ["row_id"], method, [0], 3)
    return m.select("seed", "fold", "n", "n_positive", *[r5(F.col(c), c) for c in (
        "auroc", "auprc", "prevalence", "accuracy", "brier", "calibration_slope", "calibration_intercept")])


@query("combiner_comparison")
def combiner_comparison(spark, d):
    """Merge, ensemble and pooled gains over local per decision: rho, best cut, accuracy."""
    from sitelattice.operators.thresholds import combiner_table
    from sitelattice.plans.combiners import combiner_gains
    _, sites, fit = _decision_setup(spark, d, (0,))
    g = materialise(combiner_gains(fit, DT.draw_members(sites, [0], "combiners", 4), "y", XS))
    return _rounded(combiner_table(g, ["lr_merge", "lr_ensemble", "lr_pooled", "lr_fedavg5"]))


@query("privacy_sweep")
def privacy_sweep(spark, d):
    from sitelattice.plans.combiners import privacy_summary, privacy_sweep as sweep
    _, sites, fit = _decision_setup(spark, d, (0,))
    cells = sweep(fit, DT.draw_members(sites, [0], "privacy", 3, 3), "y", XS, [1.0, 5.0, float("inf")])
    return _rounded(privacy_summary(cells).withColumn("eps", F.col("eps").cast("string")))
