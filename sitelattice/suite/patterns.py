"""Registered pattern work: counts, support, containment order, partners."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelattice.operators import leakage as L
from sitelattice.operators import matrix as M
from sitelattice.operators import partners as PA
from sitelattice.operators import patterns as PT
from sitelattice.operators.ordered import quantile_columns
from sitelattice.session import materialise
from sitelattice.suite import inputs as I
from sitelattice.suite.inputs import DAY, XS, md5_sql, sql, u_sql
from sitelattice.suite.registry import query


def r6(c, name):
    return F.round(c, 6).alias(name)


def _set_sql(d: int) -> str:
    return "list_sort(list_distinct([" + ",".join(f"CASE WHEN x{j} IS NOT NULL THEN {j} END" for j in range(d)) + "]))"


def _bits_sql(d: int) -> str:
    return "+".join(f"(CASE WHEN x{j} IS NOT NULL THEN {1 << j} ELSE 0 END)" for j in range(d))


def pat_ctes(source: str, d: int, floor: int) -> dict[str, str]:
    """Realised patterns, fitted patterns (support at least ``floor``, not empty)."""
    return {
        "pat": f"""SELECT bits, array_to_string(any_value(v),',') AS pattern, any_value(v) AS vars, len(any_value(v))::INT AS size,
            count(*) AS n, sum(y)::BIGINT AS pos FROM (SELECT {_bits_sql(d)} AS bits, {_set_sql(d)} AS v, y FROM {source}) GROUP BY 1""",
        "sup": "SELECT e.pattern, sum(o.n)::BIGINT AS support FROM pat e JOIN pat o ON e.bits & o.bits = e.bits GROUP BY 1",
        "fit": f"SELECT pat.*, support FROM pat JOIN sup USING (pattern) WHERE support>={floor} AND size>0",
        "strict": "SELECT o.pattern AS child, e.pattern AS parent FROM fit e JOIN fit o ON e.bits & o.bits = e.bits AND e.bits<>o.bits",
        "edge": """SELECT * FROM strict s WHERE NOT EXISTS (SELECT 1 FROM strict a JOIN strict b ON a.parent=b.child
            WHERE a.child=s.child AND b.parent=s.parent)""",
    }


def fitted_patterns(df, xs, floor: int = 30):
    """(realised, fitted): fitted ones are non-empty with support of at least ``floor``."""
    real = materialise(PT.pattern_counts(df, xs, {"pos": F.col("y")}))
    fit = PT.with_support(real, len(xs)).where((F.col("support") >= floor) & (F.col("size") > 0))
    return real, materialise(fit)


@query("pattern_counts", sql("SELECT pattern, size, n FROM pat", "sm", extra=pat_ctes("sm", 8, 30)))
def pattern_counts(spark, d):
    return PT.pattern_counts(I.site_matrix(spark, d), XS).select("pattern", "size", "n")


@query("observed_sets", sql(f"SELECT row_id, array_to_string({_set_sql(5)},',') AS observed, {_bits_sql(5)} AS w0 FROM ud", "ud"))
def observed_sets(spark, d):
    u = I.user_day(spark, d)
    return u.select("row_id", F.concat_ws(",", PT.observed_set(DAY).cast("array<string>")).alias("observed"),
                    *PT.packed_words(DAY))


@query("pattern_support", sql("SELECT pattern, n, support FROM pat JOIN sup USING (pattern)", "sm", extra=pat_ctes("sm", 8, 30)))
def pattern_support(spark, d):
    real = materialise(PT.pattern_counts(I.site_matrix(spark, d), XS))
    return PT.with_support(real, 8).select("pattern", "n", "support")


@query("superset_pairs", sql("SELECT e.pattern AS small, o.pattern AS large FROM pat e JOIN pat o ON e.bits & o.bits = e.bits",
                             "ud", extra=pat_ctes("ud", 5, 30)))
def superset_pairs(spark, d):
    real = materialise(PT.pattern_counts(I.user_day(spark, d), DAY))
    return PT.containment(real, real, 5).select(F.col("e.pattern").alias("small"), F.col("o.pattern").alias("large"))


@query("pattern_ancestors", sql("SELECT child, parent FROM edge", "sm", extra=pat_ctes("sm", 8, 30)))
def pattern_ancestors(spark, d):
    _, fit = fitted_patterns(I.site_matrix(spark, d), XS)
    return PT.immediate_ancestors(fit, 8)


@query("row_assignment", sql("""SELECT pattern, n, assigned FROM pat LEFT JOIN (
 SELECT o.pattern, first(e.pattern ORDER BY e.size DESC, e.vars) AS assigned FROM pat o JOIN fit e ON e.bits & o.bits = e.bits
 GROUP BY 1) USING (pattern)""", "sm", extra=pat_ctes("sm", 8, 400)))
def row_assignment(spark, d):
    real, fit = fitted_patterns(I.site_matrix(spark, d), XS, 400)
    return PT.most_specific(fit, real, 8).select("pattern", "n", "assigned")


@query("pattern_cover", sql("""SELECT o.pattern, e.pattern AS member FROM pat o JOIN fit e ON e.bits & o.bits = e.bits""",
                            "ud", extra=pat_ctes("ud", 5, 100)))
def pattern_cover(spark, d):
    real, fit = fitted_patterns(I.user_day(spark, d), DAY, 100)
    return PT.cover(fit, real, 5)


@query("cohort_gate_profile", sql("""
SELECT n, 8 AS d, round(prevalence,6) AS prevalence, round(missing_rate,6) AS missing_rate, n_patterns, round(msr,6) AS median_support_ratio,
 round(fa,6) AS frac_with_ancestor FROM (SELECT count(*) AS n, avg(y) AS prevalence, 1-("""
    + "+".join(f"count(x{j})" for j in range(8)) + """)/(8.0*count(*)) AS missing_rate FROM sm)
CROSS JOIN (SELECT count(*) AS n_patterns FROM pat)
CROSS JOIN (SELECT median(support/n::DOUBLE) AS msr FROM pat JOIN sup USING (pattern))
CROSS JOIN (SELECT count(DISTINCT child)/(SELECT count(*) FROM fit)::DOUBLE AS fa FROM strict)""",
    "sm", extra=pat_ctes("sm", 8, 30)))
def cohort_gate_profile(spark, d):
    """Size, prevalence, missing rate, patterns, median support ratio, share with an ancestor."""
    real, fit = fitted_patterns(I.site_matrix(spark, d), XS)
    # rows are read for the patterns only, which hold all that the totals need
    base = real.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), r6(F.sum("pos") / F.sum("n"), "prevalence"),
                    r6(1 - F.sum(F.col("n") * F.col("size")) / (8.0 * F.sum("n")), "missing_rate"))
    ratio = quantile_columns(PT.with_support(real, 8).select((F.col("support") / F.col("n")).alias("r")),
                             [], "r", {"median_support_ratio": 0.5})
    edges = PT.immediate_ancestors(fit, 8)
    frac = edges.agg(F.count_distinct("child").alias("c"))
    one = F.broadcast  # every side below is one row
    return (base.join(one(real.agg(F.count(F.lit(1)).alias("n_patterns")))).join(one(ratio)).join(one(frac))
            .join(one(fit.agg(F.count(F.lit(1)).alias("f"))))
            .select("n", F.lit(8).alias("d"), "prevalence", "missing_rate", "n_patterns",
                    r6(F.col("median_support_ratio"), "median_support_ratio"),
                    r6(F.col("c") / F.col("f"), "frac_with_ancestor")))


# --- leakage screens -----------------------------------------------------------------------

def _rates_sql(group: str) -> str:
    g, by = (f"{group}, ", " GROUP BY 1") if group else ("", "")
    return " UNION ALL ".join(
        f"SELECT {g}{j} AS var, count(*) AS n, count(CASE WHEN y=1 THEN x{j} END)/nullif(sum(y),0)::DOUBLE AS rate_pos, "
        f"count(CASE WHEN y=0 THEN x{j} END)/nullif(sum(1-y),0)::DOUBLE AS rate_neg FROM sm{by}" for j in range(8))


@query("obs_rate_by_class", sql("""SELECT var, round(rate_pos,6) AS rate_pos, round(rate_neg,6) AS rate_neg,
 round(abs(rate_pos-rate_neg),6) AS gap FROM r""", "sm", extra={"r": _rates_sql("")}))
def obs_rate_by_class(spark, d):
    r = L.observation_rate_by_class(I.site_matrix(spark, d), XS)
    return r.select("var", *[r6(F.col(c), c) for c in ("rate_pos", "rate_neg", "gap")])


@query("missingness_leakage_guard", sql("""SELECT site, var, n, round(abs(rate_pos-rate_neg),6) AS gap FROM r
 WHERE n>=100 AND abs(rate_pos-rate_neg)>=0.08""", "sm", extra={"r": _rates_sql("site")}))
def missingness_leakage_guard(spark, d):
    r = L.missingness_leaks(I.site_matrix(spark, d), XS, "y", ["site"], max_gap=0.08)
    return r.select("site", "var", "n", r6(F.col("gap"), "gap"))


_VAL = """SELECT v.var, coalesce(n,0) AS n_observed, coalesce(n,0)<30 OR coalesce(pos,0)=0 OR coalesce(pos,0)=n AS skipped,
 (rs-pos*(pos+1)/2.0)/nullif(pos*(n-pos),0) AS a FROM (SELECT unnest(range(9))::INT AS var) v LEFT JOIN (
 SELECT var, count(*) AS n, sum(y)::BIGINT AS pos, sum(CASE WHEN y=1 THEN r ELSE 0 END) AS rs FROM (
  SELECT var, y, rank() OVER (PARTITION BY var ORDER BY value)+(count(*) OVER (PARTITION BY var, value)-1)/2.0 AS r
  FROM (SELECT var, y, value FROM sl UNION ALL SELECT 8, y, y+x2*0.001::DOUBLE FROM sm WHERE x2 IS NOT NULL)) GROUP BY 1) USING (var)"""


def _with_leak(spark, d):
    m = I.site_matrix(spark, d)
    return m.withColumn("x8", F.col("y") + F.col("x2") * 0.001), [*XS, "x8"]


@query("value_leakage", sql("""SELECT var, CASE WHEN NOT skipped THEN round(greatest(a,1-a),6) END AS auroc, n_observed, skipped FROM v""",
                            "sl", extra={"v": _VAL}))
def value_leakage(spark, d):
    m, xs = _with_leak(spark, d)
    return L.value_leakage_report(m, xs).select("var", r6(F.col("auroc"), "auroc"), "n_observed", "skipped")


@query("value_leakage_guard", sql("""SELECT var, round(greatest(a,1-a),6) AS auroc FROM v WHERE NOT skipped AND greatest(a,1-a)>=0.9""",
                                  "sl", extra={"v": _VAL}))
def value_leakage_guard(spark, d):
    m, xs = _with_leak(spark, d)
    return L.value_leaks(m, xs).select("var", r6(F.col("auroc"), "auroc"))


# --- sites and partners --------------------------------------------------------------------

_SITES = {"si": "SELECT site, any_value(n)::BIGINT AS n, list(var ORDER BY var) AS vars FROM sp WHERE n_obs/n>=0.7 GROUP BY 1",
          "pr": """SELECT a.site AS target, b.site AS partner, a.n AS n_target, b.n AS n_partner,
  len(list_intersect(a.vars,b.vars))::INT AS n_shared, len(list_distinct(list_concat(a.vars,b.vars)))::INT AS n_union,
  len(list_intersect(a.vars,b.vars))/greatest(len(list_distinct(list_concat(a.vars,b.vars))),1)::DOUBLE AS jaccard
  FROM si a JOIN si b ON a.site<>b.site"""}


def site_table(spark, d):
    s = M.site_schema(I.site_matrix(spark, d), "site", XS, 0.7)
    return s.groupBy("site").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("var")).alias("vars"))


@query("schema_pairs", sql("SELECT target, partner, n_shared, n_union, round(jaccard,6) AS jaccard FROM pr", "sp", extra=_SITES))
def schema_pairs(spark, d):
    return PA.site_pairs(site_table(spark, d)).select("target", "partner", "n_shared", "n_union",
                                                      r6(F.col("jaccard"), "jaccard"))


@query("schema_overlap", sql("""SELECT n_shared, n_union, count(*) AS n_pairs FROM pr GROUP BY 1,2""", "sp", extra=_SITES))
def schema_overlap(spark, d):
    return PA.site_pairs(site_table(spark, d)).groupBy("n_shared", "n_union").agg(F.count(F.lit(1)).alias("n_pairs"))


def _cand(name: str, order: str, width: int | None, source: str = "pr") -> str:
    cut = f" WHERE pos<{width}" if width else ""
    order = (order + ", ") if order else ""
    return (f"SELECT target, '{name}' AS strategy, partner, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY target ORDER BY {order}partner)-1 AS pos FROM {source}){cut}")


_CANDS = " UNION ALL ".join([
    _cand("random", "", None), _cand("size_similar", "round(abs(ln(n_partner+1.0)-ln(n_target+1.0)),12)", 12),
    _cand("size_largest", "n_partner DESC", 12), _cand("schema_complement", "jaccard", 12),
    _cand("schema_similar", "jaccard DESC", 12),
    _cand("large_complement", "jaccard", 12, "(SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY target ORDER BY n_partner DESC, partner)<=24)"),
    _cand("same_prefix", "", None, "(SELECT * FROM pr WHERE substr(target,1,2)=substr(partner,1,2))"),
    _cand("cross_prefix", "", None, "(SELECT * FROM pr WHERE substr(target,1,2)<>substr(partner,1,2))")])


@query("partner_candidates", sql(_CANDS, "sp", extra=_SITES))
def partner_candidates(spark, d):
    return PA.candidates(PA.site_pairs(site_table(spark, d)), prefix=2)


@query("prefix_containment", sql("""SELECT count(*) AS n_prefixes, count(CASE WHEN n>1 THEN 1 END) AS n_multi,
 count(CASE WHEN n>1 THEN 1 END)>=3 AND count(*)>=2 AS groups FROM (SELECT substr(site,1,2) AS p, count(*) AS n FROM si GROUP BY 1)""",
                                 "sp", extra=_SITES))
def prefix_containment(spark, d):
    return PA.prefix_groups(site_table(spark, d), 2)


def draw_ctes(pool: str, ids: list[str], seed: str) -> dict[str, str]:
    """Subset draws by position: ``pool`` has the id columns and ``size``."""
    key = ids + ["draw"]
    u = lambda tag: u_sql(md5_sql(f"{seed}/{tag}", *key))
    cols = ", ".join(f"CAST(floor({u(str(i))}*(size-{i})) AS BIGINT) AS r{i}" for i in range(4))

    def step(i, prev):
        e = f"r{i}"
        for j in range(i):
            e = f"(CASE WHEN {e}>=s[{j + 1}] THEN {e}+1 ELSE {e} END)"
        return f"SELECT *, list_sort(list_append(s,{e})) AS s2, {e} AS p{i} FROM {prev}"
    q = "d0"
    chain = {"d0": f"SELECT *, CAST([] AS BIGINT[]) AS s FROM (SELECT *, CAST(floor({u('m')}*least(size,4)) AS INT)+1 AS m, {cols} "
                   f"FROM {pool}, (SELECT unnest(range(1,13))::INT AS draw))"}
    for i in range(4):
        chain[f"d{i + 1}"] = f"SELECT * EXCLUDE (s, s2), s2 AS s FROM ({step(i, q)})"
        q = f"d{i + 1}"
    chain["dr"] = f"SELECT {', '.join(key)}, unnest(list_slice([p0,p1,p2,p3],1,m)) AS pos FROM d4"
    return chain


_IX = {"ix": f"""SELECT site, row_number() OVER (ORDER BY {md5_sql('subsets/index', 'site')}, site)-1 AS ix, count(*) OVER ()-1 AS size FROM si"""}


@query("partner_subsets", sql("""
SELECT DISTINCT target, array_to_string(members,'+') AS members FROM (
 SELECT dr.site AS target, draw, list(i.site ORDER BY i.site) AS members FROM dr JOIN ix i
  ON i.ix = CASE WHEN pos>=dr.ix THEN pos+1 ELSE pos END GROUP BY 1,2)""", "sp",
                              extra={**_SITES, **_IX, **draw_ctes("ix", ["site", "ix"], "subsets")}))
def partner_subsets(spark, d):
    s = PA.partner_subsets(site_table(spark, d), "subsets")
    return s.select("target", F.array_join("members", "+").alias("members"))


@query("strategy_subsets", sql("""
SELECT DISTINCT strategy, target, array_to_string(members,'+') AS members FROM (
 SELECT dr.strategy, dr.target, draw, list(c.partner ORDER BY c.partner) AS members FROM dr JOIN ca c
  USING (strategy, target, pos) GROUP BY 1,2,3)""", "sp",
                               extra={**_SITES, "ca": _CANDS, "po": "SELECT strategy, target, count(*) AS size FROM ca GROUP BY 1,2",
                                      **draw_ctes("po", ["strategy", "target"], "strat")}))
def strategy_subsets(spark, d):
    pools = PA.candidates(PA.site_pairs(site_table(spark, d)), prefix=2)
    s = PA.strategy_subsets(pools, "strat")
    return s.select("strategy", "target", F.array_join("members", "+").alias("members"))
