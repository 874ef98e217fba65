"""Registered decision analytics: rules, boundaries, pool laws, policies, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelattice.operators import curverule as CR
from sitelattice.operators import decisions as D
from sitelattice.operators import merging as MG
from sitelattice.operators import thresholds as T
from sitelattice.operators import tuning as TU
from sitelattice.operators.cohort import band
from sitelattice.operators.ranktests import signed_rank
from sitelattice.session import materialise
from sitelattice.suite import inputs as I
from sitelattice.suite.inputs import md5_sql, sql, table, u_sql
from sitelattice.suite.metrics import cut_ctes, rank_sql, tail_sql
from sitelattice.suite.registry import query


def r6(c, name):
    return F.round(c, 6).alias(name)


FEATURES = ["epv_target", "n_target", "n_min", "n_partner_total", "ratio_partner_to_target",
            "n_partners", "schema_jaccard", "q_median", "i2_median"]


# --- leave-one-site-out rules --------------------------------------------------------------

def loso_ctes(features: list[str], src: str, site: str, probs: list[float], dirs=("lt", "ge")) -> dict[str, str]:
    """Brute force: for every held-out site, fit on all other rows and score its own."""
    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, {site} AS site, {f}::DOUBLE AS value, helped, benefit FROM {src} WHERE {f} IS NOT NULL"
                              for f in features)
    ps = "[" + ",".join(repr(p) for p in probs) + "]::DOUBLE[]"
    case = " ".join(f"WHEN o%{len(dirs)}={i} THEN (value {'<' if x == 'lt' else '>='} t)" for i, x in enumerate(dirs))
    return {
        "lo": long,
        "tr": "SELECT h.site AS held, l.feature, l.value, l.helped FROM lo l JOIN (SELECT DISTINCT site FROM lo) h ON l.site<>h.site",
        "gr": f"""SELECT held, feature, unnest(q) AS t, generate_subscripts(q,1)-1 AS k FROM (
            SELECT held, feature, quantile_cont(value, {ps}) AS q FROM tr GROUP BY 1,2
            HAVING count(*)>=10 AND sum(helped)>0 AND sum(helped)<count(*))""",
        "ac": f"""SELECT held, feature, o, t, count(CASE WHEN (CASE {case} END)=(helped=1) THEN 1 END) AS correct FROM (
            SELECT tr.*, t, k*{len(dirs)}+d AS o FROM tr JOIN gr USING (held, feature), (SELECT unnest(range({len(dirs)})) AS d)) GROUP BY 1,2,3,4""",
        "bs": "SELECT * FROM ac QUALIFY row_number() OVER (PARTITION BY held, feature ORDER BY correct DESC, o)=1",
        "ls": f"""SELECT feature, count(*) AS n_scored, count(CASE WHEN (CASE {case} END)=(helped=1) THEN 1 END)/count(*)::DOUBLE AS loso_acc
            FROM lo JOIN bs USING (feature) WHERE lo.site=bs.held GROUP BY 1"""}


@query("loso_accuracy", sql("SELECT feature, n_scored, round(loso_acc,6) AS loso_acc FROM ls", "dec",
                            extra=loso_ctes(["epv_target", "i2_median"], "dec", "pool", T.linspace(0.05, 0.95, 19))))
def loso_accuracy(spark, d):
    dec = I.decisions(spark, d).drop("site").withColumnRenamed("pool", "site")
    long = T.long_features(dec, ["site", "helped"], ["epv_target", "i2_median"])
    a = T.loso_accuracy(long, "feature", "site", "value", "helped", T.linspace(0.05, 0.95, 19))
    return a.select("feature", "n_scored", r6(F.col("loso_acc"), "loso_acc"))


_RHO = "SELECT feature, count(*) AS n, corr(a,b) AS rho FROM (SELECT feature, " + rank_sql("value", "feature") + " AS a, " + rank_sql(
    "benefit", "feature") + " AS b FROM lo) GROUP BY 1 HAVING count(*)>=20"


@query("rule_loso", sql(f"""SELECT feature, round(rho,6) AS rho, round({tail_sql('rho*sqrt((n-2)/(1-rho*rho))')},6) AS p, round(loso_acc,6) AS loso_acc,
 round(m,6) AS majority FROM rh LEFT JOIN ls USING (feature) CROSS JOIN (SELECT greatest(avg(helped),1-avg(helped)) AS m FROM dec)""", "dec",
                        extra={**loso_ctes(FEATURES, "dec", "site", T.linspace(0.05, 0.95, 19)), "rh": _RHO}))
def rule_loso(spark, d):
    r = T.evaluate_rules(materialise(I.decisions(spark, d).select("site", "helped", "benefit", *FEATURES)), FEATURES)
    return r.select("feature", *[r6(F.col(c), c) for c in ("rho", "p", "loso_acc", "majority")])


_CUTS = [0.2, 0.4, 0.6, 0.8]
_SLOPE = "+".join(f"coalesce(b{j}*(x{j}-a{j}),0)" for j in range(8))
_LINE = ", ".join(f"regr_slope(y,x{j}) AS b{j}, avg(x{j}) AS a{j}" for j in range(8))
_BAND = "CASE WHEN x0 IS NULL THEN -1 ELSE " + "+".join(f"(x0>{c})::INT" for c in _CUTS) + " END"
_MODELS = "fr JOIN (SELECT unnest(range(4))::INT AS i) ON step<=i JOIN (SELECT unnest(range(3))::INT AS f) ON fold<>f"
_CURVE = {
    "nr": f"""SELECT *, row_number() OVER (PARTITION BY site, y ORDER BY {md5_sql('curve', 'row_id')}, row_id)-1 AS r,
     count(*) OVER (PARTITION BY site, y) AS n FROM sm""",
    "sh": "SELECT *, (r%3)::INT AS fold, (r//3+1)/ceil((n-r%3)/3.0::DOUBLE) AS share FROM nr",
    "fr": f"SELECT *, CASE WHEN share<=0.25 THEN 0 WHEN share<=0.5 THEN 1 WHEN share<=0.75 THEN 2 ELSE 3 END AS step, {_BAND} AS band FROM sh",
    "ln": f"SELECT site, i, f, {_LINE} FROM {_MODELS} GROUP BY 1,2,3",
    "bn": f"SELECT site, i, f, band, (sum(y)+1)/(count(*)+2)::DOUBLE AS rate FROM {_MODELS} GROUP BY 1,2,3,4",
    "cs": f"""SELECT 'slopes' AS kind, fr.site, i, f, y, round(1/(1+exp(-({_SLOPE}))),9) AS p FROM fr JOIN ln ON ln.site=fr.site AND f=fold UNION ALL
     SELECT 'bands', fr.site, e.i, fold, y, round(coalesce(rate,0.5),9) FROM fr CROSS JOIN (SELECT unnest(range(4))::INT AS i) e
     LEFT JOIN bn ON bn.site=fr.site AND bn.band=fr.band AND bn.i=e.i AND bn.f=fold""",
    "cr": """SELECT kind, site, i, f, y, count(*) OVER w AS cn, sum(y) OVER w AS cp FROM (SELECT * REPLACE (least(greatest(p,1e-6),1-1e-6) AS p) FROM cs)
     WINDOW w AS (PARTITION BY kind, site, i, f ORDER BY p DESC RANGE UNBOUNDED PRECEDING)""",
    "ap": "SELECT kind, site, i, CASE WHEN sum(y)<count(*) THEN sum(y*cp::DOUBLE/cn)/nullif(sum(y),0) END AS ap FROM cr GROUP BY kind, site, i, f",
    "cv": "SELECT kind, site, " + ", ".join(f"avg(CASE WHEN i={i} THEN ap END) AS c{i + 1}" for i in range(4)) + " FROM ap GROUP BY 1,2",
    "st": """SELECT *, (c4-c3)/greatest(c4,1e-6) AS slope_last, (c4-c2)/greatest(c4,1e-6) AS climb_half, c4 AS level FROM cv
     WHERE c1+c2+c3+c4 IS NOT NULL"""}


def _curve_rows(spark, d):
    """(site, kind, c1..c4, slope_last, climb_half, level) of the two classes of closed-form learners."""
    m = materialise(I.site_matrix(spark, d).select("row_id", "site", "y", *I.XS))
    rows = materialise(TU.nested_steps(m, "site", "y", ["row_id"], "curve").drop("row_id"))
    slopes = CR.curves(CR.slope_metrics(rows, "site", "y", I.XS), "site").withColumn("kind", F.lit("slopes"))
    bands = CR.curves(CR.band_metrics(rows, "site", "y", "x0", _CUTS), "site").withColumn("kind", F.lit("bands"))
    return materialise(slopes.unionByName(bands))


@query("closed_form_curves", sql("SELECT kind, site, " + ", ".join(f"round({c},6) AS {c}" for c in ("c1", "c2", "c3", "c4", "slope_last", "climb_half", "level"))
                                 + " FROM st", "sm", extra=_CURVE))
def closed_form_curves(spark, d):
    return _curve_rows(spark, d).select("kind", "site", *[r6(F.col(c), c) for c in ("c1", "c2", "c3", "c4", "slope_last", "climb_half", "level")])


_ASKED = "SELECT 'S'||lpad(CAST(o_orderkey%25 AS VARCHAR),2,'0') AS site, '{kind}' AS kind, epv_target, {arm} AS benefit, ({arm}>0)::INT AS helped FROM dec WHERE {arm} IS NOT NULL"


@query("learning_curve_rule", sql(f"""SELECT feature AS statistic, kind, r.n, round(rho,6) AS rho, round(t,6) AS cut, dir AS direction,
 round(correct/b.n::DOUBLE,6) AS acc, round(loso_acc,6) AS shared_acc, round(m,6) AS majority FROM rh r JOIN best b USING (key) JOIN ls USING (feature)
 JOIN (SELECT feature, greatest(avg(helped),1-avg(helped)) AS m FROM lo GROUP BY 1) USING (feature)""", "sm", "dec", extra={
    **_CURVE, "asked": " UNION ALL ".join(_ASKED.format(kind=k, arm=a) for k, a in (("slopes", "lr_merge"), ("bands", "gb_pooled"))),
    "lc": "SELECT asked.*, slope_last, climb_half, level FROM asked JOIN st USING (site, kind)", **loso_ctes(CR.STATISTICS, "lc", "site", T.linspace(0.05, 0.95, 25)),
    "own": " UNION ALL ".join(f"SELECT '{s}/'||kind AS key, '{s}' AS feature, kind, {s}::DOUBLE AS value, helped, benefit FROM lc" for s in CR.STATISTICS),
    "rh": "SELECT key, feature, kind, count(*) AS n, corr(a,b) AS rho FROM (SELECT key, feature, kind, " + rank_sql("value", "key") + " AS a, "
          + rank_sql("benefit", "key") + " AS b FROM own) GROUP BY 1,2,3",
    **cut_ctes("own", "key", "value", "helped", T.linspace(0.05, 0.95, 25), ("lt", "ge"))}))
def learning_curve_rule(spark, d):
    """Curves of every site and class joined to the decisions of that site and class; one threshold for both classes."""
    dec = I.decisions(spark, d)
    arms = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(a).alias("benefit")) for k, a in (("slopes", "lr_merge"), ("bands", "gb_pooled"))])
    site = F.concat(F.lit("S"), F.lpad((F.col("o_orderkey") % 25).cast("string"), 2, "0"))
    asked = dec.select(site.alias("site"), "epv_target", F.inline(arms)).withColumn("helped", (F.col("benefit") > 0).cast("int"))
    r = CR.shared_threshold(asked, _curve_rows(spark, d))
    return r.select("statistic", "kind", "n", "direction", *[r6(F.col(c), c) for c in ("rho", "cut", "acc", "shared_acc", "majority")])


# --- combiners, terciles, laws -------------------------------------------------------------

ARMS = ["lr_merge", "lr_ensemble", "gb_pooled"]
_ARMS = " UNION ALL ".join(f"SELECT '{a}' AS combiner, epv_target, {a} AS gain, CASE WHEN {a}>0 THEN 1 ELSE 0 END AS h FROM dec WHERE {a} IS NOT NULL" for a in ARMS)


@query("combiner_table", sql("""SELECT combiner, n, round(rho,6) AS rho, round(t,6) AS epv_cut, round(correct/n::DOUBLE,6) AS acc,
 round(greatest(pos/n::DOUBLE,1-pos/n::DOUBLE),6) AS majority, round(pos/n::DOUBLE,6) AS helped_rate FROM best JOIN (
 SELECT combiner, corr(a,b) AS rho FROM (SELECT combiner, """ + rank_sql("epv_target", "combiner") + " AS a, " + rank_sql("gain", "combiner")
    + " AS b FROM arms) GROUP BY 1) USING (combiner)", "dec",
    extra={"arms": _ARMS, **cut_ctes("arms", "combiner", "epv_target", "h", T.linspace(0.05, 0.95, 37))}))
def combiner_table(spark, d):
    c = T.combiner_table(materialise(I.decisions(spark, d).select("epv_target", *ARMS)), ARMS)
    return c.select("combiner", "n", *[r6(F.col(x), x) for x in ("rho", "epv_cut", "acc", "majority", "helped_rate")])


_TERC = {
    "big": "SELECT pool FROM dec WHERE i2_median IS NOT NULL GROUP BY 1 HAVING count(*)>=200",
    "tq": "SELECT pool, quantile_cont(i2_median,[0.0,0.3333333333333333,0.6666666666666666,1.0]::DOUBLE[]) AS q FROM dec JOIN big USING (pool) WHERE i2_median IS NOT NULL GROUP BY 1",
    "tr3": """SELECT pool||'/'||i AS cell, pool, i::INT AS tercile, i2_median, epv_target, helped FROM dec JOIN tq USING (pool), (SELECT unnest(range(3)) AS i)
       WHERE i2_median>=q[i+1] AND i2_median<=q[i+2]""",
    **cut_ctes("tr3", "cell", "epv_target", "helped", T.linspace(0.05, 0.95, 49), tag="3"),
    "res3": """SELECT pool, tercile, m AS median_by, t AS cut, correct/n::DOUBLE AS acc, correct/n::DOUBLE-greatest(pos/n::DOUBLE,1-pos/n::DOUBLE) AS lift, n
       FROM best3 JOIN (SELECT cell, any_value(pool) AS pool, any_value(tercile) AS tercile, median(i2_median) AS m FROM tr3 GROUP BY 1) USING (cell)
       WHERE n>=60 AND pos>0 AND pos<n"""}


def _terciles(spark, d):
    dec = materialise(I.decisions(spark, d).select("pool", "i2_median", "epv_target", "helped"))
    return T.boundary_by_tercile(dec, "pool")


@query("boundary_terciles", sql("""SELECT pool, tercile, round(median_by,6) AS median_by, round(cut,6) AS cut, round(acc,6) AS acc, round(lift,6) AS lift, n FROM res3""",
                                "dec", extra=_TERC))
def boundary_terciles(spark, d):
    return _terciles(spark, d).select("pool", "tercile", "n", *[r6(F.col(x), x) for x in ("median_by", "cut", "acc", "lift")])


@query("boundary_verdicts", sql("""SELECT pool, round(max(CASE WHEN tercile=0 THEN cut END),6) AS low_cut, round(max(CASE WHEN tercile=2 THEN cut END),6) AS high_cut,
 max(CASE WHEN tercile=2 THEN cut END)<max(CASE WHEN tercile=0 THEN cut END) AS falls,
 max(CASE WHEN tercile=2 THEN lift END)>max(CASE WHEN tercile=0 THEN lift END) AS lift_rises FROM res3 GROUP BY 1 HAVING count(*)=3""", "dec", extra=_TERC))
def boundary_verdicts(spark, d):
    v = T.boundary_verdicts(materialise(_terciles(spark, d)), "pool")
    return v.select("pool", r6(F.col("low_cut"), "low_cut"), r6(F.col("high_cut"), "high_cut"), "falls", "lift_rises")


_LAW = {
    "d5": "SELECT site AS pool, n_target, epv_target, benefit, helped FROM dec",
    **cut_ctes("d5", "pool", "epv_target", "helped", T.linspace(0.05, 0.95, 37), ("lt", "ge"), tag="e"),
    **cut_ctes("d5", "pool", "n_target", "helped", T.linspace(0.05, 0.95, 37), ("lt", "ge"), tag="n"),
    "cq": "SELECT pool, quantile_cont(n_target::DOUBLE,[" + ",".join(repr(p) for p in T.linspace(0.0, 1.0, 7)) + """]::DOUBLE[]) AS q, min(n_target) AS lo, max(n_target) AS hi
       FROM d5 GROUP BY 1 HAVING count(*)>300""",
    "cb": """SELECT pool, i, log10(median(n_target)) AS x, avg(benefit) AS b FROM d5 JOIN cq USING (pool), (SELECT unnest(range(6)) AS i)
       WHERE n_target>=q[i+1] AND n_target<=q[i+2] GROUP BY 1,2 HAVING count(*)>=30""",
    "cr": """SELECT pool, CASE WHEN c BETWEEN lo AND hi THEN c END AS crossing FROM (SELECT pool, pow(10.0,-regr_intercept(b,x)/regr_slope(b,x)) AS c FROM cb GROUP BY 1
       HAVING count(*)>=4 AND max(b)>0 AND min(b)<0 AND abs(regr_slope(b,x))>1e-9) JOIN cq USING (pool)""",
    "law": """SELECT b.*, greatest(coalesce(CASE WHEN e.n>=50 THEN e.correct/e.n::DOUBLE END,-1),coalesce(CASE WHEN t.n>=50 THEN t.correct/t.n::DOUBLE END,-1))
        -greatest(b.helped,1-b.helped) AS lift FROM (SELECT pool, avg(CASE WHEN n_target>5000 THEN 1.0 ELSE 0 END) AS harm, avg(helped) AS helped, count(*) AS n FROM d5 GROUP BY 1) b
        LEFT JOIN beste e USING (pool) LEFT JOIN bestn t USING (pool)"""}


def _law(spark, d):
    dec = materialise(I.decisions(spark, d).select(
        F.col("site").alias("pool"), "n_target", "epv_target", "benefit", "helped"))
    return dec, T.pool_law(dec, "pool")


@query("pool_law", sql("""SELECT pool, n, round(harm,6) AS harm, round(lift,6) AS lift, round(helped,6) AS helped, round(crossing,3) AS crossing
 FROM law LEFT JOIN cr USING (pool)""", "dec", extra=_LAW))
def pool_law(spark, d):
    _, law = _law(spark, d)
    return law.select("pool", "n", *[r6(F.col(x), x) for x in ("harm", "lift", "helped")], F.round("crossing", 3).alias("crossing"))


_TS = T.linspace(1000, 20000, 20)
_SWEEP = {
    "sf": "SELECT t AS threshold, pool, avg(CASE WHEN n_target>t THEN 1.0 ELSE 0 END) AS f FROM d5, (SELECT unnest([" + ",".join(map(repr, _TS)) + "]::DOUBLE[]) AS t) GROUP BY 1,2",
    "ss": """SELECT threshold, count(*)::DOUBLE AS s0, sum(f) AS s1, sum(f*f) AS s2, sum(f*f*f) AS s3, sum(f*f*f*f) AS s4, sum(lift) AS t0, sum(f*lift) AS t1,
       sum(f*f*lift) AS t2, sum(lift*lift) AS u FROM sf JOIN law USING (pool) GROUP BY 1 HAVING count(DISTINCT round(f,3))>=3""",
    "sd": "SELECT *, s4*(s2*s0-s1*s1)-s3*(s3*s0-s1*s2)+s2*(s3*s1-s2*s2) AS det FROM ss",
    "sw": """SELECT threshold, a, CASE WHEN a<0 THEN -b/(2*a) END AS peak, 1-(u-a*t2-b*t1-c*t0)/greatest(u-t0*t0/s0,1e-12) AS r2 FROM (
       SELECT *, (t2*(s2*s0-s1*s1)-s3*(t1*s0-s1*t0)+s2*(t1*s1-s2*t0))/det AS a, (s4*(t1*s0-s1*t0)-t2*(s3*s0-s1*s2)+s2*(s3*t0-t1*s2))/det AS b,
       (s4*(s2*t0-t1*s1)-s3*(s3*t0-t1*s2)+t2*(s3*s1-s2*s2))/det AS c FROM sd)"""}


@query("quadratic_law", sql("SELECT threshold, round(a,4) AS curvature, round(peak,4) AS peak, round(r2,4) AS r2 FROM sw", "dec", extra={**_LAW, **_SWEEP}))
def quadratic_law(spark, d):
    dec, law = _law(spark, d)
    s = T.quadratic_sweep(dec, law, "pool", _TS)
    return s.select("threshold", *[F.round(x, 4).alias(x) for x in ("curvature", "peak", "r2")])


@query("peak_range", sql("SELECT round(min(peak),4) AS lowest_peak, round(max(peak),4) AS highest_peak FROM sw WHERE a<0 AND peak BETWEEN 0 AND 1 AND threshold<=7500",
                         "dec", extra={**_LAW, **_SWEEP}))
def peak_range(spark, d):
    dec, law = _law(spark, d)
    p = T.peak_range(T.quadratic_sweep(dec, law, "pool", [t for t in _TS if t <= 7500]))
    return p.select(F.round("lowest_peak", 4).alias("lowest_peak"), F.round("highest_peak", 4).alias("highest_peak"))


# --- bands and gradients -------------------------------------------------------------------

_BAND = "CASE WHEN epv_target<2 THEN '0-2' WHEN epv_target<5 THEN '2-5' WHEN epv_target<10 THEN '5-10' WHEN epv_target<20 THEN '10-20' ELSE '20+' END"


@query("benefit_by_band", sql(f"""SELECT pool, {_BAND} AS band, n_partners, count(*) AS n, CASE WHEN count(*)>=15 THEN round(avg(benefit),6) END AS mean_benefit
 FROM dec GROUP BY 1,2,3""", "dec"))
def benefit_by_band(spark, d):
    dec = I.decisions(spark, d).withColumn("band", band(F.col("epv_target"), [0, 2, 5, 10, 20]))
    b = D.benefit_by_band(dec, ["pool", "band", "n_partners"], "benefit", 15)
    return b.withColumn("mean_benefit", F.round("mean_benefit", 6))


_MIX = "CASE WHEN frac_cross=0 THEN 'within' WHEN frac_cross=1 THEN 'cross' ELSE 'mixed' END"


@query("cross_source_benefit", sql(f"""SELECT CASE WHEN epv_target<5 THEN '0-5' WHEN epv_target<10 THEN '5-10' WHEN epv_target<20 THEN '10-20' ELSE '20+' END AS band,
 {_MIX} AS mix, count(*) AS n, round(avg(CASE WHEN benefit>0 THEN 1.0 ELSE 0 END),6) AS helped, round(avg(benefit),6) AS mean_benefit
 FROM dec GROUP BY 1,2 HAVING count(*)>=8""", "dec"))
def cross_source_benefit(spark, d):
    c = D.cross_source(I.decisions(spark, d), [])
    return c.select("band", "mix", "n", r6(F.col("helped"), "helped"), r6(F.col("mean_benefit"), "mean_benefit"))


@query("gradient_table", sql("""SELECT site, n, round(rho,6) AS rho, CASE WHEN rho< -0.05 THEN 'starved gain' WHEN rho>0.05 THEN 'wrong sign' ELSE 'no gradient' END AS sign
 FROM (SELECT site, count(*) AS n, corr(a,b) AS rho FROM (SELECT site, """ + rank_sql("epv_target", "site") + " AS a, " + rank_sql("benefit", "site")
    + " AS b FROM dec) GROUP BY 1)", "dec"))
def gradient_table(spark, d):
    g = D.gradient_table(I.decisions(spark, d), ["site"])
    return g.select("site", "n", r6(F.col("rho"), "rho"), "sign")


@query("dimension_sweep", sql("""SELECT d_target, n, round(rho,6) AS rho, round(b,6) AS mean_benefit FROM (SELECT d_target, count(*) AS n, corr(x,z) AS rho, avg(benefit) AS b FROM (
 SELECT d_target, benefit, """ + rank_sql("epv_target", "d_target") + " AS x, " + rank_sql("benefit", "d_target") + " AS z FROM dec) GROUP BY 1)", "dec"))
def dimension_sweep(spark, d):
    dec = materialise(I.decisions(spark, d).select("d_target", "epv_target", "benefit"))
    g = D.gradient_table(dec, ["d_target"])
    m = dec.groupBy("d_target").agg(F.avg("benefit").alias("b"))
    return g.join(m, "d_target").select("d_target", "n", r6(F.col("rho"), "rho"), r6(F.col("b"), "mean_benefit"))


# --- policies ------------------------------------------------------------------------------

_SHARE = " UNION ALL ".join(f"""SELECT pool, '{p}' AS policy, 100*(avg(ap_{p})-avg(ap_never_merge))/(avg(ap_oracle_lambda)-avg(ap_never_merge)) AS share
 FROM pol GROUP BY 1 HAVING avg(ap_oracle_lambda)-avg(ap_never_merge)>1e-9""" for p in I.POLICIES)


@query("policy_share", sql("SELECT pool, policy, round(share,5) AS share FROM sh", "pol", extra={"sh": _SHARE}))
def policy_share(spark, d):
    s = D.policy_share(I.policy_scores(spark, d), "pool", I.POLICIES)
    return s.withColumn("share", F.round("share", 5))


@query("policy_rollup", sql("""SELECT policy, round(avg(share),5) AS mean_share, round(median(share),5) AS median_share, round(min(share),5) AS worst_share,
 count(CASE WHEN share<0 THEN 1 END) AS n_negative FROM sh GROUP BY 1""", "pol", extra={"sh": _SHARE}))
def policy_rollup(spark, d):
    r = D.policy_rollup(D.policy_share(I.policy_scores(spark, d), "pool", I.POLICIES))
    return r.select("policy", *[F.round(c, 5).alias(c) for c in ("mean_share", "median_share", "worst_share")], "n_negative")


@query("harmful_pools", sql("""SELECT pool, round(avg(ap_always_merge-ap_never_merge),6) AS mean_benefit FROM pol GROUP BY 1
 HAVING avg(ap_always_merge-ap_never_merge)<-0.002""", "pol"))
def harmful_pools(spark, d):
    return D.harmful_pools(I.policy_scores(spark, d), "pool").withColumn("mean_benefit", F.round("mean_benefit", 6))


_MODES = {
    "per": """SELECT mode, pool, avg(ap_never_merge) AS nev, avg(ap_always_merge) AS alw, avg(ap_blend) AS bl, avg(ap_oracle_lambda) AS orc FROM pol GROUP BY 1,2""",
    "com": "SELECT pool FROM per GROUP BY 1 HAVING count(DISTINCT mode)=(SELECT count(DISTINCT mode) FROM per)",
    "cls": "SELECT pool, bool_or(alw<nev) AS harmful, bool_and(orc-nev>=0.002) AS above FROM per JOIN com USING (pool) GROUP BY 1"}


@query("mode_compare", sql("""SELECT mode, round(m,6) AS merged_ap, round(b,6) AS blend_ap, round(o,6) AS oracle_ap, round(o-v,6) AS attainable,
 CASE WHEN o>v THEN round(100*(b-v)/(o-v),4) END AS blend_share, CASE WHEN o>v THEN round(100*(m-v)/(o-v),4) END AS merged_share, n_blend_negative, negative_pools,
 n_harmful, n_above, n_harmful=0 AS warn_no_harmful, n_above<8 AS provisional FROM (SELECT mode, avg(alw) AS m, avg(bl) AS b, avg(orc) AS o, avg(nev) AS v,
 count(CASE WHEN bl<nev THEN 1 END) AS n_blend_negative, coalesce(string_agg(CASE WHEN bl<nev THEN pool END, ',' ORDER BY pool),'') AS negative_pools
 FROM per JOIN cls USING (pool) WHERE above GROUP BY 1)
CROSS JOIN (SELECT count(CASE WHEN harmful THEN 1 END) AS n_harmful, count(CASE WHEN above THEN 1 END) AS n_above FROM cls)""", "pol", extra=_MODES))
def mode_compare(spark, d):
    m = D.mode_comparison(I.policy_scores(spark, d))
    six = [r6(F.col(c), c) for c in ("merged_ap", "blend_ap", "oracle_ap", "attainable")]
    four = [F.round(c, 4).alias(c) for c in ("blend_share", "merged_share")]
    return m.select("mode", *six, *four, "n_blend_negative", "negative_pools", "n_harmful", "n_above",
                    "warn_no_harmful", "provisional")


@query("pool_floor_sets", sql("SELECT pool, harmful, above FROM cls", "pol", extra=_MODES))
def pool_floor_sets(spark, d):
    arms = ["never_merge", "always_merge", "oracle_lambda"]
    per = D.mode_pools(I.policy_scores(spark, d), "mode", "pool", arms)
    c = D.classify_pools(per, "mode", "pool")
    return c.select("pool", (F.col("harmful") == 1).alias("harmful"), (F.col("above") == 1).alias("above"))


# --- censuses and audits -------------------------------------------------------------------

_FILE = """CASE WHEN o_orderkey%11 IN (0,1) THEN 'gate_'||{k} WHEN o_orderkey%11=2 THEN 'lam_'||{k} WHEN o_orderkey%11 IN (3,4) THEN 'cut_'||{k}
 WHEN o_orderkey%11=5 THEN 'dp_'||{k} ELSE 'site_rules_'||{k} END"""
_FILES = f"""SELECT file, count(*) AS n FROM (SELECT {_FILE.format(k="CAST(o_custkey%4 AS VARCHAR)||'.csv'")} AS file FROM orders) GROUP BY 1"""
# Prefixes of the files that one condition of the census covers.
COND = r"^(dp_|calib_|gate_|lam_|cut_|local_tuning|site_rules_ext|site_rules_recalib)"


def decision_files(spark, d):
    k = F.concat((F.col("o_custkey") % 4).cast("string"), F.lit(".csv"))
    m = F.col("o_orderkey") % 11
    stem = (F.when(m.isin(0, 1), "gate_").when(m == 2, "lam_").when(m.isin(3, 4), "cut_").when(m == 5, "dp_")
            .otherwise("site_rules_"))
    return table(spark, d, "orders").groupBy(F.concat(stem, k).alias("file")).agg(F.count(F.lit(1)).alias("n"))


_SUP = """SELECT a.file, a.n, regexp_replace(a.file,'^(gate|lam)_','cut_') AS twin, b.n AS twin_n, coalesce(a.n=b.n,false) AS superseded
 FROM fl a LEFT JOIN fl b ON b.file=regexp_replace(a.file,'^(gate|lam)_','cut_') WHERE regexp_matches(a.file,'^(gate|lam)_')"""


@query("supersession", sql(_SUP, extra={"fl": _FILES}))
def supersession(spark, d):
    return D.supersession(decision_files(spark, d))


@query("decision_census", sql(f"""SELECT n_files, n_primary_files, primary_rows, conditioned_rows, n_removed, superseded_rows, n_unmatched,
 primary_rows-n_removed AS headline, conditioned_rows-superseded_rows AS conditioned_kept FROM (
 SELECT count(*) AS n_files, count(CASE WHEN NOT c THEN 1 END) AS n_primary_files, sum(CASE WHEN NOT c THEN n ELSE 0 END)::BIGINT AS primary_rows,
 sum(CASE WHEN c THEN n ELSE 0 END)::BIGINT AS conditioned_rows FROM (SELECT *, regexp_matches(file,'{COND}') AS c FROM fl))
CROSS JOIN (SELECT coalesce(sum(CASE WHEN superseded THEN n END),0)::BIGINT AS superseded_rows, count(CASE WHEN NOT superseded THEN 1 END) AS n_unmatched FROM sp2)
CROSS JOIN (SELECT count(*) AS n_removed FROM orders WHERE o_orderpriority='1-URGENT')""", extra={"fl": _FILES, "sp2": _SUP}))
def decision_census(spark, d):
    _, removed = D.drop_arm(table(spark, d, "orders"), "o_orderpriority", "1-URGENT")
    return D.census(materialise(decision_files(spark, d)), COND, removed)


_JOBS = """SELECT event_id, coalesce(v,'UNJUDGED') AS verdict FROM (SELECT event_id, CAST(json_extract(props,'$.k') AS INT) AS k FROM events)
 LEFT JOIN (SELECT DISTINCT CAST(json_extract(props,'$.k') AS INT) AS k, CASE CAST(json_extract(props,'$.k') AS INT)%5 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'PARTLY'
  WHEN 2 THEN 'REFUTED' ELSE 'NOT TESTED' END AS v FROM events WHERE CAST(json_extract(props,'$.k') AS INT)%5<4) USING (k)"""


def _jobs(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("j")).select(
        "event_id", F.col("j.k").alias("k"))
    k5 = F.col("k") % 5
    v = e.select("k").distinct().where(k5 < 4).select(
        "k", F.when(k5 == 0, "CONFIRMED").when(k5 == 1, "PARTLY").when(k5 == 2, "REFUTED")
        .otherwise("NOT TESTED").alias("verdict"))
    return D.judged(e, v, "k")


@query("job_verdicts", sql("SELECT event_id, verdict FROM j", extra={"j": _JOBS}))
def job_verdicts(spark, d):
    return _jobs(spark, d).select("event_id", "verdict")


@query("verdict_tally", sql("SELECT verdict, count(*) AS n FROM j GROUP BY 1", extra={"j": _JOBS}))
def verdict_tally(spark, d):
    return D.verdict_tally(_jobs(spark, d))


@query("failure_rates", sql("""SELECT n_failed, n_judged, n_all, round(n_failed/greatest(n_judged,1)::DOUBLE,6) AS rate_judged,
 round(n_failed/greatest(n_all,1)::DOUBLE,6) AS rate_recorded FROM (SELECT count(CASE WHEN verdict IN ('REFUTED','PARTLY') THEN 1 END) AS n_failed,
 count(CASE WHEN verdict NOT IN ('UNJUDGED','NOT TESTED') THEN 1 END) AS n_judged, count(*) AS n_all FROM j)""", extra={"j": _JOBS}))
def failure_rates(spark, d):
    f = D.failure_rates(D.verdict_tally(_jobs(spark, d)))
    return f.select("n_failed", "n_judged", "n_all", r6(F.col("rate_judged"), "rate_judged"), r6(F.col("rate_recorded"), "rate_recorded"))


@query("claim_check", sql("""SELECT n_name AS id, round(quoted,4) AS quoted, round(derived,6) AS derived, CASE WHEN derived IS NULL THEN 'UNVERIFIABLE'
 WHEN abs(quoted-derived)<=0.05 THEN 'VERIFIED' ELSE 'MISMATCH' END AS verdict FROM (
 SELECT n_name, n_nationkey%6*0.1::DOUBLE AS quoted FROM nation) LEFT JOIN (SELECT n_name, avg(CASE WHEN c_acctbal>4000 THEN 1.0 ELSE 0 END)-0.3 AS derived
 FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE n_nationkey%8<>7 GROUP BY 1) USING (n_name)"""))
def claim_check(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    claims = n.select(F.col("n_name").alias("id"), (F.col("n_nationkey") % 6 * 0.1).alias("quoted"))
    derived = c.join(n.where("n_nationkey % 8 <> 7"), c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("id")).agg(
        (F.avg((F.col("c_acctbal") > 4000).cast("double")) - 0.3).alias("derived"))
    r = D.check_claims(claims, derived, "id", F.lit(0.05))
    return r.select("id", F.round("quoted", 4).alias("quoted"), r6(F.col("derived"), "derived"), "verdict")


# --- merging and heterogeneity on closed-form coefficients ---------------------------------

@query("coord_merge", sql("""SELECT var, count(*) AS n_sites, round(sum(n*coef)/sum(n),6) AS coef, round(sum(n*mu)/sum(n),6) AS mu,
 round(greatest(sum(n*sd)/sum(n),1e-9),6) AS sd FROM cf GROUP BY 1""", "cf"))
def coord_merge(spark, d):
    m = MG.coordinate_merge(I.site_coefficients(spark, d), [])
    return m.select("var", "n_sites", *[r6(F.col(c), c) for c in ("coef", "mu", "sd")])


@query("coord_merge_fisher", sql("SELECT var, count(*) AS n_sites, round(sum(info*raw)/sum(info),6) AS coef FROM cf GROUP BY 1", "cf"))
def coord_merge_fisher(spark, d):
    m = MG.coordinate_merge(I.site_coefficients(spark, d), [], "raw", "fisher")
    return m.select("var", "n_sites", r6(F.col("coef"), "coef"))


@query("weighted_merge_powers", sql(" UNION ALL ".join(
    f"SELECT {p} AS power, var, round(sum(pow(n,{p})*coef)/sum(pow(n,{p})),6) AS coef FROM cf GROUP BY 2" for p in (0, 1, 2)), "cf"))
def weighted_merge_powers(spark, d):
    c = I.site_coefficients(spark, d).withColumn("power", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    m = MG.weighted_merge(c, ["power"], F.pow(F.col("n").cast("double"), F.col("power")))
    return m.select("power", "var", r6(F.col("coef"), "coef"))


@query("own_weight_merge", sql("""SELECT var, round(sum(w*coef)/sum(w),6) AS coef FROM (SELECT *, CASE WHEN site='S00' THEN 0.5 ELSE
 0.5/greatest((SELECT count(DISTINCT site) FROM cf)-1,1) END AS w FROM cf) GROUP BY 1""", "cf"))
def own_weight_merge(spark, d):
    c = materialise(I.site_coefficients(spark, d))
    n = c.select("site").distinct().count()
    m = MG.weighted_merge(c, [], MG.own_weight(F.col("site") == "S00", 0.5, F.lit(n)))
    return m.select("var", r6(F.col("coef"), "coef"))


_MRG = "SELECT var, sum(n*coef)/sum(n) AS coef, sum(n*mu)/sum(n) AS mu, greatest(sum(n*sd)/sum(n),1e-9) AS sd FROM cf GROUP BY 1"


@query("blend_coef", sql("""SELECT site, var, w, round(CASE WHEN l.coef IS NULL THEN m.coef ELSE w*l.coef+(1-w)*m.coef END,6) AS coef,
 round(CASE WHEN l.mu IS NULL THEN m.mu ELSE w*l.mu+(1-w)*m.mu END,6) AS mu, round(CASE WHEN l.sd IS NULL THEN m.sd ELSE w*l.sd+(1-w)*m.sd END,6) AS sd
 FROM (SELECT DISTINCT site FROM cf) CROSS JOIN mg m CROSS JOIN (SELECT unnest([0.0,0.3,1.0])::DOUBLE AS w) LEFT JOIN cf l USING (site, var)""", "cf", extra={"mg": _MRG}))
def blend_coef(spark, d):
    c = materialise(I.site_coefficients(spark, d))
    grid = F.explode(F.array(*[F.lit(w) for w in (0.0, 0.3, 1.0)]))
    # every site is a target of the same merge here: pair each site with the merged vector
    merged = materialise(MG.coordinate_merge(c, []).drop("n_sites")).withColumn("w", grid)
    sites = c.select("site").distinct()
    per_site = sites.withColumn("__k", F.lit(1)).join(merged.withColumn("__k", F.lit(1)), "__k").drop("__k")
    local = c.withColumn("w", grid)
    b = MG.blend(per_site, local, ["site", "w"], F.col("w"))
    return b.select("site", "var", "w", *[r6(F.col(x), x) for x in ("coef", "mu", "sd")])


_CQ = {"fe": "SELECT var, sum(info*raw)/sum(info) AS f FROM cf GROUP BY 1",
       "cq": """SELECT var, sum(info*(raw-f)*(raw-f)) AS q, count(*)-1 AS df, any_value(f) AS f, sum(info) AS sw, sum(info*info) AS sww
          FROM cf JOIN fe USING (var) GROUP BY 1 HAVING count(*)>1"""}


@query("cochran_q", sql("SELECT var, round(q,5) AS q, df, round(CASE WHEN q>0 THEN greatest(0,(q-df)/q) ELSE 0 END,6) AS i2 FROM cq", "cf", extra=_CQ))
def cochran_q(spark, d):
    q = MG.cochran_q(materialise(I.site_coefficients(spark, d)), [])
    return q.select("var", F.round("q", 5).alias("q"), "df", r6(F.col("i2"), "i2"))


# 5 % chi-square cuts for 1 to 24 degrees of freedom, as printed in tables.
_CHI2 = ("3.841,5.991,7.815,9.488,11.070,12.592,14.067,15.507,16.919,18.307,19.675,21.026,22.362,23.685,24.996,26.296,"
         "27.587,28.869,30.144,31.410,32.671,33.924,35.172,36.415")


@query("heterogeneity_summary", sql(f"""SELECT round(median(q),5) AS q_median, round(avg(q),5) AS q_mean,
 round(median(CASE WHEN q>0 THEN greatest(0,(q-df)/q) ELSE 0 END),6) AS i2_median, round(avg(CASE WHEN q>[{_CHI2}][df] THEN 1.0 ELSE 0 END),6) AS share_over FROM cq""", "cf", extra=_CQ))
def heterogeneity_summary(spark, d):
    h = MG.heterogeneity_summary(MG.cochran_q(materialise(I.site_coefficients(spark, d)), []), [])
    return h.select(F.round("q_median", 5).alias("q_median"), F.round("q_mean", 5).alias("q_mean"),
                    r6(F.col("i2_median"), "i2_median"), r6(F.col("share_over"), "share_over"))


@query("dl_tau2", sql("""SELECT var, round(tau2,6) AS tau2, round(sum(raw/(1/info+tau2))/sum(1/(1/info+tau2)),6) AS raw, count(*) AS n_sites FROM cf JOIN (
 SELECT var, CASE WHEN sw-sww/sw>0 THEN greatest(0,(q-df)/(sw-sww/sw)) ELSE 0 END AS tau2 FROM cq) USING (var) GROUP BY 1, tau2""", "cf", extra=_CQ))
def dl_tau2(spark, d):
    r = MG.random_effects(materialise(I.site_coefficients(spark, d)), [])
    return r.select("var", r6(F.col("tau2"), "tau2"), r6(F.col("raw"), "raw"), "n_sites")


_DRAW = f"""SELECT k, draw, var, sum(n*coef)/sum(n) AS coef FROM (SELECT *, row_number() OVER (PARTITION BY draw, var ORDER BY {md5_sql('bv', 'draw', 'site')}, site) AS r
 FROM cf, (SELECT unnest(range(1,25)) AS draw)), (SELECT unnest(range(1,5)) AS k) WHERE r<=k GROUP BY 1,2,3"""


@query("bias_variance", sql("""SELECT k, round(sum((m-f)*(m-f)),8) AS bias2, round(sum(v),8) AS variance, max(nd) AS n_draws FROM (
 SELECT k, var, avg(coef) AS m, var_pop(coef) AS v, count(*) AS nd FROM dw GROUP BY 1,2 HAVING count(*)>=8) JOIN (
 SELECT var, sum(n*coef)/sum(n) AS f FROM cf GROUP BY 1) USING (var) GROUP BY 1""", "cf", extra={"dw": _DRAW}))
def bias_variance(spark, d):
    from pyspark.sql import Window
    from sitelattice.functions.hashing import digest
    c = materialise(I.site_coefficients(spark, d))
    w = Window.partitionBy("draw", "var").orderBy(digest("bv", "draw", "site"), "site")  # one row per site
    draws = c.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(24)))).withColumn("r", F.row_number().over(w))
    draws = draws.where("r <= 4").withColumn("k", F.explode(F.sequence(F.col("r"), F.lit(4))))
    merged = MG.coordinate_merge(draws, ["k", "draw"])
    ref = MG.coordinate_merge(c, []).select("var", F.col("coef").alias("ref"))
    b = MG.bias_variance(merged, ref, ["k"])
    return b.select("k", F.round("bias2", 8).alias("bias2"), F.round("variance", 8).alias("variance"), "n_draws")


@query("own_weight_sweep", sql("SELECT n_partners, n_pairs, w_plus, w_minus, CASE WHEN nz>0 THEN round((least(w_plus,w_minus)-n_pairs*(n_pairs+1)/4.0)/"
                               "sqrt(n_pairs::DOUBLE*(n_pairs+1)*(2*n_pairs+1)/24.0-ties/48.0),6) END AS z FROM (SELECT n_partners, count(*) AS n_pairs,"
                               " sum(CASE WHEN d>0 THEN r WHEN d=0 THEN r/2 ELSE 0 END) AS w_plus, sum(CASE WHEN d<0 THEN r WHEN d=0 THEN r/2 ELSE 0 END) AS w_minus,"
                               " sum(t*t-1)::DOUBLE AS ties, count(CASE WHEN d<>0 THEN 1 END) AS nz FROM (SELECT n_partners, d, "
                               + rank_sql("abs(d)", "n_partners") + " AS r, count(*) OVER (PARTITION BY n_partners, abs(d)) AS t FROM"
                               " (SELECT n_partners, round(lr_ensemble-lr_merge,6) AS d FROM dec)) GROUP BY 1)", "dec"))
def own_weight_sweep(spark, d):
    """Signed-rank test by partner count of one arm against another over all decisions."""
    dec = I.decisions(spark, d).select("n_partners", F.round(F.col("lr_ensemble") - F.col("lr_merge"), 6).alias("d"))
    return signed_rank(dec, ["n_partners"], "d").select("n_partners", "n_pairs", "w_plus", "w_minus", r6(F.col("z"), "z"))
