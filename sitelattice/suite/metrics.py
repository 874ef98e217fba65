"""Registered metric and test-statistic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelattice.operators import metrics as ME
from sitelattice.operators import ranktests as RT
from sitelattice.operators.thresholds import best_cut, linspace
from sitelattice.suite import inputs as I
from sitelattice.suite.inputs import sql
from sitelattice.suite.registry import query


def r6(c, name):
    return F.round(c, 6).alias(name)


_RANKED = """SELECT site, y, p, rank() OVER (PARTITION BY site ORDER BY p)+(count(*) OVER (PARTITION BY site, p)-1)/2.0 AS r,
 count(*) OVER (PARTITION BY site ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS cn,
 sum(y) OVER (PARTITION BY site ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS cp
 FROM (SELECT site, y, least(greatest(p,1e-6),1-1e-6) AS p FROM sc)"""


@query("auroc", sql("""SELECT site, round((sum(y*r)-sum(y)*(sum(y)+1)/2.0)/(sum(y)*sum(1-y)),6) AS auroc FROM k GROUP BY 1""",
                    "sc", extra={"k": _RANKED}))
def auroc(spark, d):
    return ME.score_metrics(I.scores(spark, d), ["site"]).select("site", r6(F.col("auroc"), "auroc"))


@query("average_precision", sql("""SELECT site, round(sum(y*cp::DOUBLE/cn)/sum(y),6) AS auprc FROM k GROUP BY 1""", "sc", extra={"k": _RANKED}))
def average_precision(spark, d):
    return ME.score_metrics(I.scores(spark, d), ["site"]).select("site", r6(F.col("auprc"), "auprc"))


@query("fold_evaluation", sql("""SELECT site, count(*) AS n, sum(y)::BIGINT AS n_positive, round(avg(y),6) AS prevalence,
 round(avg(CASE WHEN (p>=0.5)=(y=1) THEN 1.0 ELSE 0 END),6) AS accuracy, round(avg((y-p)*(y-p)),6) AS brier,
 round((sum(y*r)-sum(y)*(sum(y)+1)/2.0)/(sum(y)*sum(1-y)),6) AS auroc, round(sum(y*cp::DOUBLE/cn)/sum(y),6) AS auprc FROM k GROUP BY 1""",
                              "sc", extra={"k": _RANKED}))
def fold_evaluation(spark, d):
    m = ME.score_metrics(I.scores(spark, d), ["site"])
    return m.select("site", "n", "n_positive", *[r6(F.col(c), c) for c in (
        "prevalence", "accuracy", "brier", "auroc", "auprc")])


@query("pooled_metrics", sql("""SELECT count(*) AS n, round((sum(y*r)-sum(y)*(sum(y)+1)/2.0)/(sum(y)*sum(1-y)),6) AS auroc,
 round(sum(y*cp::DOUBLE/cn)/sum(y),6) AS auprc FROM k""", "sc", extra={"k": _RANKED.replace("SELECT site, y, least", "SELECT 'all' AS site, y, least")}))
def pooled_metrics(spark, d):
    m = ME.score_metrics(I.scores(spark, d), [])
    return m.select("n", r6(F.col("auroc"), "auroc"), r6(F.col("auprc"), "auprc"))


_LP = "SELECT site, y, ln(q/(1-q)) AS l FROM (SELECT site, y, least(greatest(p,1e-6),1-1e-6) AS q FROM sc)"


def _calib_ctes(steps: int, ridge: str) -> dict[str, str]:
    out = {"cell": f"SELECT site, l, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM ({_LP}) GROUP BY 1,2",
           "t0": "SELECT site, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM cell GROUP BY 1"}
    for i in range(steps):
        out[f"t{i + 1}"] = f"""SELECT site, a+(g0*h2-g1*h1)/(h0*h2-h1*h1) AS a, b+(g1*h0-g0*h1)/(h0*h2-h1*h1) AS b FROM (
          SELECT site, any_value(a) AS a, any_value(b) AS b, sum(pos-n*q) AS g0, sum((pos-n*q)*l)-{ridge}*any_value(b) AS g1,
          sum(n*q*(1-q)) AS h0, sum(n*q*(1-q)*l) AS h1, sum(n*q*(1-q)*l*l)+{ridge} AS h2 FROM (
          SELECT cell.*, a, b, 1/(1+exp(-(a+b*l))) AS q FROM cell JOIN t{i} USING (site)) GROUP BY 1)"""
    return out


@query("calibration_line", sql("SELECT site, round(b,5) AS slope, round(a,5) AS intercept FROM t8", "sc", extra=_calib_ctes(8, "0.0")))
def calibration_line(spark, d):
    c = ME.calibration_line(I.scores(spark, d), ["site"])
    return c.select("site", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query("calibration_line_ridge", sql("SELECT site, round(b,5) AS slope FROM t8", "sc", extra=_calib_ctes(8, "1.0")))
def calibration_line_ridge(spark, d):
    c = ME.calibration_line(I.scores(spark, d), ["site"], c=1.0)
    return c.select("site", F.round("slope", 5).alias("slope"))


def _citl_ctes(steps: int) -> dict[str, str]:
    out = {"cell": f"SELECT site, l, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM ({_LP}) GROUP BY 1,2",
           "t0": "SELECT site, 0.0::DOUBLE AS s FROM cell GROUP BY 1"}
    for i in range(steps):
        out[f"t{i + 1}"] = f"""SELECT site, least(greatest(any_value(s)+least(greatest(sum(pos-n*q)/sum(n*q*(1-q)),-1.0),1.0),-20.0),20.0) AS s
          FROM (SELECT cell.*, s, 1/(1+exp(-(l+s))) AS q FROM cell JOIN t{i} USING (site)) GROUP BY 1"""
    return out


@query("calibration_in_the_large", sql("SELECT site, round(s,5) AS shift FROM t8", "sc", extra=_citl_ctes(8)))
def calibration_in_the_large(spark, d):
    c = ME.calibration_in_the_large(I.scores(spark, d), ["site"])
    return c.select("site", F.round("shift", 5).alias("shift"))


@query("expected_calibration_error", sql("""SELECT site, n, round(e/n,6) AS ece FROM (SELECT site, sum(n)::BIGINT AS n, sum(abs(sy-sp)) AS e FROM (
 SELECT site, least(floor(p*10),9) AS b, count(*) AS n, sum(y) AS sy, sum(p) AS sp FROM sc GROUP BY 1,2) GROUP BY 1)""", "sc"))
def expected_calibration_error(spark, d):
    e = ME.expected_calibration_error(I.scores(spark, d), ["site"])
    return e.select("site", "n", r6(F.col("ece"), "ece"))


_T975 = "[" + ",".join(str(t) for t in ME.T975) + "]"
_TQ = f"""CASE WHEN n-1<=30 THEN ({_T975}::DOUBLE[])[greatest(n-1,1)] ELSE 1.959963984540054::DOUBLE
 + (pow(1.959963984540054::DOUBLE,3)+1.959963984540054::DOUBLE)/(4*(n-1))
 + (5*pow(1.959963984540054::DOUBLE,5)+16*pow(1.959963984540054::DOUBLE,3)+3*1.959963984540054::DOUBLE)/(96*(n-1)*(n-1))
 + (3*pow(1.959963984540054::DOUBLE,7)+19*pow(1.959963984540054::DOUBLE,5)+17*pow(1.959963984540054::DOUBLE,3)-15*1.959963984540054::DOUBLE)/(384.0::DOUBLE*(n-1)*(n-1)*(n-1)) END"""


@query("logit_interval", sql(f"""SELECT method, n, round(1/(1+exp(-(m-{_TQ}*s/sqrt(n)))),6) AS lo, round(1/(1+exp(-(m+{_TQ}*s/sqrt(n)))),6) AS hi
 FROM (SELECT method, avg(z) AS m, stddev_samp(z) AS s, count(z) AS n FROM (SELECT method,
  ln(least(greatest(metric,1e-6),1-1e-6)/(1-least(greatest(metric,1e-6),1-1e-6))) AS z FROM fo WHERE metric IS NOT NULL) GROUP BY 1) WHERE n>=2""", "fo"))
def logit_interval(spark, d):
    i = ME.logit_interval(I.fold_metrics(spark, d).where("metric IS NOT NULL"), ["method"], "metric")
    return i.select("method", "n", r6(F.col("lo"), "lo"), r6(F.col("hi"), "hi"))


def rank_sql(value: str, part: str) -> str:
    p = f"PARTITION BY {part}" if part else ""
    pv = f"PARTITION BY {part}, {value}" if part else f"PARTITION BY {value}"
    return f"(rank() OVER ({p} ORDER BY {value})+(count(*) OVER ({pv})-1)/2.0::DOUBLE)"


def tail_sql(z: str) -> str:
    """Two-sided normal tail by the same rational form as the operator, in SQL."""
    t = f"(1.0::DOUBLE/(1.0+0.5*abs({z})/1.4142135623730951::DOUBLE))"
    poly = "0.17087277::DOUBLE"
    for c in ("-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806", "0.09678418",
              "0.37409196", "1.00002368", "-1.26551223"):
        poly = f"({poly}*{t}+({c}::DOUBLE))"
    return f"{t}*exp(-({z})*({z})/2.0+{poly})"


@query("spearman", sql("""SELECT pool, n, round(rho,6) AS rho FROM (SELECT pool, count(*) AS n, corr(a,b) AS rho FROM (
 SELECT pool, """ + rank_sql("epv_target", "pool") + " AS a, " + rank_sql("benefit", "pool") + " AS b FROM dec) GROUP BY 1)", "dec"))
def spearman(spark, d):
    s = RT.spearman(I.decisions(spark, d), ["pool"], "epv_target", "benefit")
    return s.select("pool", "n", r6(F.col("rho"), "rho"))


@query("average_rank_table", sql("SELECT pool, epv_target, round(any_value(r),6) AS rank, count(*) AS n FROM (SELECT pool, epv_target, "
                                 + rank_sql("epv_target", "pool") + " AS r FROM dec) GROUP BY 1,2", "dec"))
def average_rank_table(spark, d):
    from sitelattice.operators.ordered import average_ranks
    return average_ranks(I.decisions(spark, d), ["pool"], "epv_target")


@query("partial_spearman", sql("""SELECT pool, n, round((xy-xz*yz)/sqrt((1-xz*xz)*(1-yz*yz)),6) AS partial_rho FROM (
 SELECT pool, count(*) AS n, corr(x,y) AS xy, corr(x,z) AS xz, corr(y,z) AS yz FROM (SELECT pool, """
    + rank_sql("frac_cross", "pool") + " AS x, " + rank_sql("benefit", "pool") + " AS y, " + rank_sql("epv_target", "pool")
    + " AS z FROM dec) GROUP BY 1)", "dec"))
def partial_spearman(spark, d):
    s = RT.partial_spearman(I.decisions(spark, d), ["pool"], "frac_cross", "benefit", "epv_target")
    return s.select("pool", "n", r6(F.col("partial_rho"), "partial_rho"))


_PAIRS = """SELECT o.method, o.seed, o.fold, r.metric-o.metric AS diff FROM fo o JOIN fo r USING (seed, fold) WHERE r.method='m0' AND o.method<>'m0'"""
_SIGNED = f"""SELECT method, count(*) AS n_pairs, sum(CASE WHEN diff>0 THEN r WHEN diff=0 THEN r/2 ELSE 0 END) AS w_plus,
 sum(CASE WHEN diff<0 THEN r WHEN diff=0 THEN r/2 ELSE 0 END) AS w_minus, sum(t*t-1)::DOUBLE AS ties, count(CASE WHEN diff<>0 THEN 1 END) AS nz
 FROM (SELECT method, diff, {rank_sql('abs(diff)', 'method')} AS r, count(*) OVER (PARTITION BY method, abs(diff)) AS t
 FROM pairs WHERE diff IS NOT NULL) GROUP BY 1"""
_Z = "(least(w_plus,w_minus)-n_pairs*(n_pairs+1)/4.0)/sqrt(n_pairs::DOUBLE*(n_pairs+1)*(2*n_pairs+1)/24.0-ties/48.0)"


def _null_ctes(most: int) -> dict[str, str]:
    """Subsets of 1..n by their sum, and twice the share of those at or below a sum."""
    return {"sub": f"""SELECT 0 AS n, 0 AS w, 1.0::DOUBLE AS c UNION ALL
             SELECT n+1, w+s*(n+1), sum(c) FROM sub CROSS JOIN (VALUES (0),(1)) v(s) WHERE n<{most} GROUP BY n, w+s*(n+1)""",
            "nul": "SELECT n, w, least(1.0, 2*sum(c) OVER (PARTITION BY n ORDER BY w)/pow(2.0,n)) AS p FROM sub"}


_SIGNED_P = f"""SELECT {{keys}}, n_pairs, w_plus, w_minus, CASE WHEN nz>0 THEN round({_Z},6) END AS z,
 round(CASE WHEN nz=0 THEN 1.0 WHEN exact THEN p ELSE {tail_sql(_Z)} END,6) AS p, exact FROM (
 SELECT *, n_pairs<={RT.EXACT_PAIRS} AND ties=0 AND nz=n_pairs AS exact FROM {{src}}) LEFT JOIN nul ON exact AND n=n_pairs AND w=least(w_plus,w_minus)"""


@query("signed_rank", sql(_SIGNED_P.format(keys="method", src="sg"), "fo", extra={"pairs": _PAIRS, "sg": _SIGNED, **_null_ctes(RT.EXACT_PAIRS)}, recursive=True))
def signed_rank(spark, d):
    p = RT.paired_differences(I.fold_metrics(spark, d), "m0", "metric")
    t = RT.signed_rank(p, ["method"], "diff")
    return t.select("method", "n_pairs", "w_plus", "w_minus", r6(F.col("z"), "z"), r6(F.col("p"), "p"), "exact")


_BY_FOLD = _SIGNED.replace("method,", "method, fold,").replace("PARTITION BY method", "PARTITION BY method, fold").replace("GROUP BY 1", "GROUP BY 1,2")


@query("signed_rank_by_fold", sql(_SIGNED_P.format(keys="method, fold", src="sg"), "fo", extra={"pairs": _PAIRS, "sg": _BY_FOLD, **_null_ctes(RT.EXACT_PAIRS)}, recursive=True))
def signed_rank_by_fold(spark, d):
    """Few pairs a group: the exact distribution, but where differences tie."""
    p = RT.paired_differences(I.fold_metrics(spark, d), "m0", "metric")
    t = RT.signed_rank(p, ["method", "fold"], "diff")
    return t.select("method", "fold", "n_pairs", "w_plus", "w_minus", r6(F.col("z"), "z"), r6(F.col("p"), "p"), "exact")


@query("paired_join", sql("SELECT method, seed, fold, round(diff,6) AS diff FROM pairs", "fo", extra={"pairs": _PAIRS}))
def paired_join(spark, d):
    p = RT.paired_differences(I.fold_metrics(spark, d), "m0", "metric")
    return p.select("method", "seed", "fold", r6(F.col("diff"), "diff"))


_HOLM = """SELECT *, max(least((m-i+1)*p,1.0)) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING) AS p_holm FROM (
 SELECT *, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS m FROM ({src}))"""


@query("holm", sql("SELECT k AS site, round(p,6) AS p, round(p_holm,6) AS p_holm FROM (" + _HOLM.format(
    src="SELECT site AS k, avg(y)*0.05 AS p FROM sc GROUP BY 1") + ")", "sc"))
def holm(spark, d):
    p = I.scores(spark, d).groupBy("site").agg((F.avg("y") * 0.05).alias("p"))
    return RT.holm(p, [], "p", "site").select("site", r6(F.col("p"), "p"), r6(F.col("p_holm"), "p_holm"))


@query("paired_test_table", sql("SELECT k AS method, round(md,6) AS median_diff, n_pairs, n_dropped, round(p,5) AS p_raw, round(p_holm,5) AS p_holm FROM ("
                                + _HOLM.format(src=f"""SELECT method AS k, md, n_pairs, n_dropped, CASE WHEN nz=0 THEN 1.0 ELSE {tail_sql(_Z)} END AS p
  FROM sg JOIN (SELECT method, median(diff) AS md, count(*)-count(diff) AS n_dropped FROM pairs GROUP BY 1) USING (method)""") + ")",
                                "fo", extra={"pairs": _PAIRS, "sg": _SIGNED}))
def paired_test_table(spark, d):
    t = RT.paired_test_table(I.fold_metrics(spark, d), "m0", "metric")
    return t.select("method", r6(F.col("median_diff"), "median_diff"), "n_pairs", "n_dropped",
                    F.round("p_raw", 5).alias("p_raw"), F.round("p_holm", 5).alias("p_holm"))


def cut_ctes(src: str, group: str, value: str, label: str, probs: list[float], dirs=("lt",), tag: str = "") -> dict[str, str]:
    """Best threshold by brute force over every grid point: ``best{tag}``."""
    grid = " UNION ALL ".join(f"SELECT {group}, {k} AS k, quantile_cont({value}::DOUBLE, {p!r}) AS t FROM {src} WHERE {value} IS NOT NULL GROUP BY ALL"
                              for k, p in enumerate(probs))
    acc = " UNION ALL ".join(
        f"""SELECT {group}, t, k*{len(dirs)}+{i} AS o, '{dr}' AS dir, count(*) AS n, sum({label})::BIGINT AS pos,
        count(CASE WHEN ({value} {'<' if dr == 'lt' else '>='} t)=({label}=1) THEN 1 END) AS correct
        FROM {src} JOIN grid{tag} USING ({group}) WHERE {value} IS NOT NULL GROUP BY ALL""" for i, dr in enumerate(dirs))
    return {f"grid{tag}": grid, f"acc{tag}": acc,
            f"best{tag}": f"SELECT * FROM acc{tag} QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY correct DESC, o)=1"}


@query("best_threshold", sql("""SELECT pool, n, round(t,6) AS cut, dir AS direction, round(correct/n::DOUBLE,6) AS acc,
 round(greatest(pos/n::DOUBLE,1-pos/n::DOUBLE),6) AS majority, round(correct/n::DOUBLE-greatest(pos/n::DOUBLE,1-pos/n::DOUBLE),6) AS lift FROM best""",
                             "dec", extra=cut_ctes("dec", "pool", "epv_target", "helped", linspace(0.05, 0.95, 37), ("lt", "ge"))))
def best_threshold(spark, d):
    b = best_cut(I.decisions(spark, d), ["pool"], "epv_target", "helped", linspace(0.05, 0.95, 37), ("lt", "ge"))
    return b.select("pool", "n", r6(F.col("cut"), "cut"), "direction", *[r6(F.col(c), c) for c in ("acc", "majority", "lift")])


@query("argmax_weight", sql("""SELECT pool, w, round(v,6) AS best_value FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY v DESC, w) AS r FROM (
 SELECT pool, 0.0::DOUBLE AS w, round(avg(ap_always_merge),6) AS v FROM pol GROUP BY 1 UNION ALL SELECT pool, 0.5, round(avg(ap_fix_050),6) FROM pol GROUP BY 1
 UNION ALL SELECT pool, 0.75, round(avg(ap_fix_075),6) FROM pol GROUP BY 1 UNION ALL SELECT pool, 1.0, round(avg(ap_never_merge),6) FROM pol GROUP BY 1)) WHERE r=1""", "pol"))
def argmax_weight(spark, d):
    from sitelattice.operators.weights import best_weight
    arms = {0.0: "ap_always_merge", 0.5: "ap_fix_050", 0.75: "ap_fix_075", 1.0: "ap_never_merge"}
    means = I.policy_scores(spark, d).groupBy("pool").agg(
        *[F.round(F.avg(c), 6).alias(f"v{i}") for i, c in enumerate(arms.values())])
    long = means.select("pool", F.inline(F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"v{i}").alias("value"))
                                                   for i, w in enumerate(arms)])))
    return best_weight(long, ["pool"], "w", "value").select("pool", "w", r6(F.col("value"), "best_value"))


@query("sorted_report", sql("""SELECT pool, round(m,6) AS mean_i2 FROM (SELECT pool, avg(CASE WHEN n_partners>1 THEN i2_median END) AS m FROM dec GROUP BY 1)
 ORDER BY m DESC NULLS LAST, pool""", "dec"))
def sorted_report(spark, d):
    a = I.decisions(spark, d).groupBy("pool").agg(F.avg(F.when(F.col("n_partners") > 1, F.col("i2_median"))).alias("m"))
    return a.orderBy(F.desc_nulls_last("m"), "pool").select("pool", r6(F.col("m"), "mean_i2"))
