"""Registered table work: cleaning, cohort joins, windows, pivots, sampling, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.functions import scalars as S
from sitelattice.functions.hashing import uniform
from sitelattice.operators import cohort as C
from sitelattice.operators import matrix as M
from sitelattice.operators import sampling as P
from sitelattice.operators.ordered import quantile_columns
from sitelattice.sources import readers as R
from sitelattice.session import materialise
from sitelattice.suite import inputs as I
from sitelattice.suite.inputs import DAY, TYPES, XS, md5_sql, sql, table, u_sql
from sitelattice.suite.registry import query


def r6(c, name):
    return F.round(c, 6).alias(name)


# --- cleaning ------------------------------------------------------------------------------

@query("numeric_coercion", sql("""
SELECT doc_id, TRY_CAST(split_part(text,' ',1) AS DOUBLE) AS a, TRY_CAST(CAST(n_chars AS VARCHAR) AS DOUBLE) AS b
FROM documents"""))
def numeric_coercion(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", S.as_number(F.split_part("text", F.lit(" "), F.lit(1))).alias("a"),
                    S.as_number(F.col("n_chars").cast("string")).alias("b"))


@query("percent_numeric", sql("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(CASE WHEN l_linenumber=4 THEN NULL ELSE l_discount*100 END,6) AS rate,
  CASE WHEN l_linenumber<>4 THEN l_quantity END AS qty FROM lineitem"""))
def percent_numeric(spark, d):
    li = table(spark, d, "lineitem")
    text = F.when(F.col("l_linenumber") == 4, F.lit("  ")).otherwise(
        F.concat(F.lit(" "), F.round(F.col("l_discount") * 100, 6).cast("string"), F.lit("% ")))
    qty = F.when(F.col("l_linenumber") == 4, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.round(S.percent_number(text), 6).alias("rate"),
                     S.percent_number(qty).alias("qty"))


@query("sentinel_to_missing", sql("""
SELECT site, count(*) AS n, count(CASE WHEN l_quantity NOT IN (9,99) THEN 1 END) AS n_seen,
 round(avg(CASE WHEN l_quantity NOT IN (9,99) THEN l_quantity END),6) AS mean_seen
FROM (SELECT l_suppkey%7 AS site, l_quantity FROM lineitem) GROUP BY 1"""))
def sentinel_to_missing(spark, d):
    li = table(spark, d, "lineitem")
    v = S.without_sentinels(F.col("l_quantity").cast("int"), ["999", "9999", "99", "9", "NA", "Unknown", ""])
    t = li.select((F.col("l_suppkey") % 7).alias("site"), v.alias("v"))
    return t.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_seen"),
                                 r6(F.avg("v"), "mean_seen"))


@query("age_derivation", sql("""
SELECT o_orderkey, CASE WHEN year(o_orderdate)-(1700+o_custkey%300) > 120 THEN 90.0
  ELSE (year(o_orderdate)-(1700+o_custkey%300))::DOUBLE END AS age,
 CASE WHEN o_custkey%120 > 89 THEN 90.0 ELSE (o_custkey%120)::DOUBLE END AS text_age FROM orders"""))
def age_derivation(spark, d):
    o = table(spark, d, "orders")
    birth = F.make_date((1700 + F.col("o_custkey") % 300).cast("int"), F.lit(1), F.lit(1))
    a = F.col("o_custkey") % 120
    text = F.when(a > 89, F.lit("> 89")).otherwise(a.cast("string"))
    return o.select("o_orderkey", S.age_in_years(birth, F.col("o_orderdate")).alias("age"),
                    S.age_from_text(text).alias("text_age"))


@query("horizon_outcome", sql("""
SELECT o_orderkey, CASE WHEN days>1826 THEN 0 WHEN stat=1 AND days<=1826 THEN 1 END AS y FROM (
 SELECT o_orderkey, o_custkey%4+1 AS stat, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days
 FROM orders) WHERE days>1826 OR (stat=1 AND days<=1826)"""))
def horizon_outcome(spark, d):
    o = table(spark, d, "orders")
    days = F.date_diff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    return o.select("o_orderkey", S.horizon_outcome(F.col("o_custkey") % 4 + 1, days).alias("y")).where(
        "y IS NOT NULL")


@query("status_label", sql("""
SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS y,
 CASE WHEN o_custkey%9<7 THEN (o_custkey%9)::DOUBLE END AS grade,
 CASE WHEN o_custkey%3=0 THEN 36.0 WHEN o_custkey%3=1 THEN 60.0 END AS term
FROM orders WHERE o_orderstatus IN ('F','O')"""))
def status_label(spark, d):
    o = table(spark, d, "orders")
    prefix = "Does not meet the credit policy. Status:"
    name = F.when(F.col("o_orderstatus") == "F", "Charged Off").when(
        F.col("o_orderstatus") == "O", "Fully Paid").otherwise("Current")
    text = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit(prefix), name)).otherwise(name)
    clean = F.trim(F.regexp_replace(text, r"^Does not meet the credit policy\. Status:", ""))
    grade = F.substring(F.lit("ABCDEFGHI"), (F.col("o_custkey") % 9 + 1).cast("int"), F.lit(1))
    term = F.when(F.col("o_custkey") % 3 == 0, " 36 months").when(
        F.col("o_custkey") % 3 == 1, " 60 months").otherwise("")
    t = o.withColumn("status", clean).where(F.col("status").isin("Fully Paid", "Charged Off"))
    return t.select("o_orderkey", (F.col("status") == "Charged Off").cast("int").alias("y"),
                    S.ordinal_letter(grade).alias("grade"),
                    F.when(term.contains("60"), 60.0).when(term.contains("36"), 36.0).alias("term"))


# Name fragments of columns recorded after, or derived from, the outcome.
EXCLUDED = ["gleason", "stage", "grade", "morphology", "topography", "behavior", "curative",
            "neoadjuvant", "primary_trt", "dx_psa", "num_heslide", "has_deliv", "exitstat",
            "exitage", "cancer_first", "intstat", "annyr", "reasfoll", "reassymp", "reassurv",
            "reasoth", "mortality", "dth", "is_dead", "histtype", "carcinoid", "cancer_site",
            "cancersite", "diagdays", "seer", "death", "exitdays", "num_canc", "ccsub",
            "case_study", "caseset", "25k", "eligible_population", "pros_cancer", "lung_cancer",
            "colo_cancer", "ovar_cancer", "appendix_cancer", "fstcan", "_dqx", "_dhq", "_sqx", "_muq",
            "psa_level3", "psa_level4", "psa_level5", "psa_days3", "psa_days4", "psa_days5", "dre_days3",
            "ca125_level5", "ca125ii_level5", "ca125_days5", "reconsent", "iaden", "gwas"]
# Digit endings that mark a follow-up screening round.
FOLLOWUP_ROUNDS = ["1", "2", "3", "4", "5", "35"]


_FRAGMENTS = ", ".join(f"'{f}'" for f in EXCLUDED)


@query("name_exclusion", sql(f"""
WITH named AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name
 ELSE upper('x' || [{_FRAGMENTS}][1 + p_partkey % {len(EXCLUDED)}]) || '_' || p_name END AS label FROM part)
SELECT p_partkey, label, len(list_filter([{_FRAGMENTS}], lambda f: contains(lower(label), f))) > 0 AS excluded FROM named"""))
def name_exclusion(spark, d):
    p = table(spark, d, "part")
    picked = F.element_at(F.array(*map(F.lit, EXCLUDED)), (1 + F.col("p_partkey") % len(EXCLUDED)).cast("int"))
    label = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(
        F.concat(F.upper(F.concat(F.lit("x"), picked)), F.lit("_"), F.col("p_name")))
    return p.select("p_partkey", label.alias("label")).withColumn("excluded", excluded_name(F.col("label")))


def excluded_name(name, fragments=EXCLUDED):
    hits = [F.contains(F.lower(name), F.lit(f)) for f in fragments]
    return reduce(lambda a, b: a | b, hits)


def is_followup(name):
    return S.trailing_digits(name).isin(FOLLOWUP_ROUNDS)


@query("followup_suffix", sql("""
SELECT c_custkey, label, regexp_extract(label,'([0-9]+)$',1) IN ('1','2','3','4','5','35') AS followup FROM (
 SELECT c_custkey, 'bmi_'||CASE WHEN c_custkey%3=0 THEN '' ELSE CAST(c_custkey%40 AS VARCHAR) END AS label FROM customer)"""))
def followup_suffix(spark, d):
    c = table(spark, d, "customer")
    label = F.concat(F.lit("bmi_"), F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(
        (F.col("c_custkey") % 40).cast("string")))
    t = c.select("c_custkey", label.alias("label"))
    return t.select("c_custkey", "label", is_followup(F.col("label")).alias("followup"))


@query("informative_columns", sql("""
SELECT 0 AS var,'a' AS name, count(DISTINCT l_quantity)>1 AS keep FROM lineitem UNION ALL
SELECT 1,'b', count(DISTINCT CASE WHEN l_quantity<0 THEN 1.0 END)>1 FROM lineitem UNION ALL
SELECT 2,'c', count(DISTINCT CASE WHEN l_quantity>0 THEN 5.0 END)>1 FROM lineitem UNION ALL
SELECT 3,'d', count(DISTINCT l_tax)>1 FROM lineitem"""))
def informative_columns(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("a"), F.when(F.col("l_quantity") < 0, 1.0).alias("b"),
        F.when(F.col("l_quantity") > 0, 5.0).alias("c"), F.col("l_tax").alias("d"))
    return M.informative_columns(li, ["a", "b", "c", "d"])


@query("site_key", sql("""
SELECT key, count(*) AS n FROM (SELECT c_mktsegment||'-'||substr(o_orderpriority,1,4) AS key
 FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_mktsegment<>'MACHINERY') GROUP BY 1"""))
def site_key(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    seg = F.when(F.col("c_mktsegment") == "MACHINERY", "OTHER").otherwise(F.trim("c_mktsegment"))
    j = o.join(c, o.o_custkey == c.c_custkey).select(seg.alias("seg"), "o_orderpriority")
    j = j.where((F.col("seg") != "") & (F.col("seg") != "OTHER"))
    return j.select(F.concat_ws("-", "seg", F.substring("o_orderpriority", 1, 4)).alias("key")).groupBy(
        "key").agg(F.count(F.lit(1)).alias("n"))


@query("station_name", sql("""
SELECT station, count(*) AS n FROM (SELECT nullif(regexp_extract(f,'^([^_]+_[^_]+)_',1),'') AS station FROM (
 SELECT CASE WHEN l_linenumber=7 THEN 'Id' ELSE 'L'||CAST(l_linenumber AS VARCHAR)||'_S'||CAST(l_suppkey%13 AS VARCHAR)
  ||'_F'||CAST(l_partkey AS VARCHAR) END AS f FROM lineitem)) GROUP BY 1"""))
def station_name(spark, d):
    li = table(spark, d, "lineitem")
    f = F.when(F.col("l_linenumber") == 7, F.lit("Id")).otherwise(F.concat(
        F.lit("L"), F.col("l_linenumber").cast("string"), F.lit("_S"),
        (F.col("l_suppkey") % 13).cast("string"), F.lit("_F"), F.col("l_partkey").cast("string")))
    s = li.select(F.nullif(S.station_of(f), F.lit("")).alias("station"))
    return s.groupBy("station").agg(F.count(F.lit(1)).alias("n"))


@query("label_normalise", sql("""
SELECT label, count(*) AS n FROM (SELECT trim(regexp_replace(translate(lower(x),',.()-/','      '),'\\s+',' ','g')) AS label
 FROM (SELECT p_name||', ('||p_brand||')-'||p_type||'/' AS x FROM part)) GROUP BY 1"""))
def label_normalise(spark, d):
    p = table(spark, d, "part")
    x = F.concat("p_name", F.lit(", ("), "p_brand", F.lit(")-"), "p_type", F.lit("/"))
    return p.select(S.normalised_label(x).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("binary_outcome", sql("""
SELECT c_nationkey, sum(CASE WHEN o_totalprice>250000 THEN 1 ELSE 0 END)::BIGINT AS events, count(*) AS n,
 sum(CASE WHEN c_mktsegment='BUILDING' THEN 1 ELSE 0 END)::BIGINT AS n_building
FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_acctbal>0 GROUP BY 1"""))
def binary_outcome(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c.where("c_acctbal > 0"), o.o_custkey == c.c_custkey)
    return j.groupBy("c_nationkey").agg(
        F.sum((F.col("o_totalprice") > 250000).cast("int")).alias("events"), F.count(F.lit(1)).alias("n"),
        F.sum((F.col("c_mktsegment") == "BUILDING").cast("int")).alias("n_building"))


@query("one_hot", sql("""
SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS is_f,
 CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END AS urgent FROM orders"""))
def one_hot(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("is_f"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"))


@query("unit_ball", sql("""
SELECT site, round(avg(a/greatest(nrm,1)),6) AS a, round(avg(b/greatest(nrm,1)),6) AS b, round(max(least(nrm,1.0)),6) AS top
FROM (SELECT site, x0*2 AS a, x2 AS b, sqrt(x0*2*x0*2+x2*x2) AS nrm FROM smraw) GROUP BY 1""", "smraw"))
def unit_ball(spark, d):
    m = I.site_matrix(spark, d, masked=False).select("site", (F.col("x0") * 2).alias("a"), F.col("x2").alias("b"))
    a, b = S.unit_ball([F.col("a"), F.col("b")])
    t = m.select("site", a.alias("a"), b.alias("b"))
    return t.groupBy("site").agg(r6(F.avg("a"), "a"), r6(F.avg("b"), "b"),
                                 r6(F.max(F.sqrt(F.col("a") ** 2 + F.col("b") ** 2)), "top"))


def _std_sql(fill: bool) -> str:
    z = ", ".join(
        (f"round(coalesce((x{j}-m{j})/CASE WHEN s{j}>0 THEN s{j} ELSE 1 END,0.0),6) AS x{j}" if fill else
         f"round((x{j}-m{j})/CASE WHEN s{j}>0 THEN s{j} ELSE 1 END,6) AS x{j}") for j in range(8))
    st = ", ".join(f"avg(x{j}) AS m{j}, stddev_pop(x{j}) AS s{j}" for j in range(8))
    return sql(f"SELECT row_id, {z} FROM sm JOIN (SELECT site, {st} FROM sm GROUP BY 1) USING (site)", "sm")


@query("standardise", _std_sql(True))
def standardise(spark, d):
    z = M.standardise(I.site_matrix(spark, d), ["site"], XS, fill=True)
    return z.select("row_id", *[r6(F.col(x), x) for x in XS])


@query("standardise_null_through", _std_sql(False))
def standardise_null_through(spark, d):
    z = M.standardise(I.site_matrix(spark, d), ["site"], XS)
    return z.select("row_id", *[r6(F.col(x), x) for x in XS])


_MEANS = ", ".join(f"avg(x{j}) AS m{j}" for j in range(8))


@query("mean_impute", sql(
    "SELECT row_id, " + ", ".join(f"round(coalesce(x{j},m{j},0.0),6) AS x{j}" for j in range(8))
    + f" FROM sm CROSS JOIN (SELECT {_MEANS} FROM sm)", "sm"))
def mean_impute(spark, d):
    z = M.impute_mean(I.site_matrix(spark, d), [], XS)
    return z.select("row_id", *[r6(F.col(x), x) for x in XS])


@query("indicator_design", sql(
    "SELECT row_id, " + ", ".join(f"round(coalesce(x{j},m{j},0.0),6) AS x{j}, "
                                  f"CASE WHEN x{j} IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS m{j}" for j in range(8))
    + f" FROM sm CROSS JOIN (SELECT {', '.join(f'avg(x{j}) AS m{j}' for j in range(8))} FROM sm)", "sm").replace(
        "coalesce(x", "coalesce(sm.x").replace("WHEN x", "WHEN sm.x").replace("avg(sm.x", "avg(x"))
def indicator_design(spark, d):
    z = M.indicator_design(I.site_matrix(spark, d), XS)
    return z.select("row_id", *[r6(F.col(x), x) for x in XS], *[f"m{j}" for j in range(8)])


def _interaction_sql() -> str:
    imp = [f"coalesce(x{j},m{j},0.0)" for j in range(8)]
    flag = [f"(CASE WHEN x{j} IS NULL THEN 0.0 ELSE 1.0 END)" for j in range(8)]
    terms = imp + flag + [f"{flag[i]}*{imp[j]}" for i in range(8) for j in range(8)]
    agg = ", ".join(f"count(CASE WHEN {t}<>0 THEN 1 END) AS n{i}, avg({t}) AS s{i}" for i, t in enumerate(terms))
    out = " UNION ALL ".join(f"SELECT {i} AS idx, n{i} AS n_nonzero, round(s{i},6) AS mean FROM a" for i in range(len(terms)))
    return sql(out, "sm", extra={"a": f"SELECT {agg} FROM sm CROSS JOIN (SELECT {_MEANS} FROM sm)"})


@query("interaction_design", _interaction_sql())
def interaction_design(spark, d):
    v = M.interaction_design(I.site_matrix(spark, d), XS)
    return M.vector_column_means(v, "features").select("idx", "n_nonzero", r6(F.col("mean"), "mean"))


# --- masks ---------------------------------------------------------------------------------

def _bisect_sql() -> str:
    """alpha by 200 bisection steps on the two class counts, then the draws."""
    cells = ", ".join(
        f"CASE WHEN {u_sql(md5_sql('inject', 'row_id', str(j)), 1)} >= 1.0/(1.0+exp(-(alpha+0.8::DOUBLE*y))) THEN x{j} END AS x{j}"
        for j in range(8))
    step = ("SELECT i+1, CASE WHEN g<0.25 THEN mid ELSE lo END, CASE WHEN g<0.25 THEN hi ELSE mid END, nn, np FROM ("
            "SELECT *, (nn/(1.0+exp(-mid))+np/(1.0+exp(-(mid+0.8::DOUBLE))))/(nn+np) AS g FROM ("
            "SELECT *, (lo+hi)/2 AS mid FROM b)) WHERE i<200")
    return sql("SELECT site, y, count(*) AS n, " + ", ".join(
        f"count(x{j}) AS n{j}, round(avg(x{j}),6) AS m{j}" for j in range(8))
        + f" FROM (SELECT site, y, {cells} FROM smraw CROSS JOIN (SELECT (lo+hi)/2 AS alpha FROM b WHERE i=200)) GROUP BY 1,2",
        "smraw", recursive=True, extra={"b(i,lo,hi,nn,np)":
            "SELECT 0, -50.0::DOUBLE, 50.0::DOUBLE, sum(1-y)::DOUBLE, sum(y)::DOUBLE FROM smraw UNION ALL " + step})


@query("inject_missingness", _bisect_sql())
def inject_missingness(spark, d):
    m = M.inject_missingness(I.site_matrix(spark, d, masked=False), XS, "y", ["row_id"], "inject", 0.25, 0.8)
    return m.groupBy("site", "y").agg(F.count(F.lit(1)).alias("n"), *[e for j, x in enumerate(XS) for e in (
        F.count(x).alias(f"n{j}"), r6(F.avg(x), f"m{j}"))])


@query("block_schema_mask", sql(
    "SELECT site, count(*) AS n, " + ", ".join(f"count(x{j}) AS n{j}" for j in range(4)) + ", "
    + ", ".join(f"count(CASE WHEN {j}>=4+(site_no*2)%4 AND {j}<4+(site_no*2)%4+2 THEN x{j} END) AS n{j}" for j in range(4, 8))
    + " FROM smraw GROUP BY 1", "smraw"))
def block_schema_mask(spark, d):
    m = M.mask_by_site_block(I.site_matrix(spark, d, masked=False), XS, "site_no", 0.5)
    return m.groupBy("site").agg(F.count(F.lit(1)).alias("n"),
                                 *[F.count(x).alias(f"n{j}") for j, x in enumerate(XS)])


_PERM = """SELECT h.row_id, {out} FROM
 (SELECT *, row_number() OVER (ORDER BY {a}, row_id) AS k FROM {t}) h JOIN
 (SELECT *, row_number() OVER (ORDER BY {b}, row_id) AS k FROM {t}) w USING (k)"""


@query("permute_mask", sql(_PERM.format(
    t="sm", a=md5_sql("perm/home", "row_id"), b=md5_sql("perm/away", "row_id"),
    out="round(h.x0,6) AS x0, round(h.x5,6) AS x5, " + ", ".join(
        f"CASE WHEN w.x{j} IS NULL THEN 0 ELSE 1 END AS m{j}" for j in range(8))), "sm"))
def permute_mask(spark, d):
    m = M.permute_mask(materialise(I.site_matrix(spark, d).select("row_id", *XS)), XS, ["row_id"], "perm")
    return m.select("row_id", r6(F.col("x0"), "x0"), r6(F.col("x5"), "x5"), *[f"m{j}" for j in range(8)])


@query("permute_groups", sql(_PERM.format(t="smraw", a=md5_sql("regroup/home", "row_id"),
                                          b=md5_sql("regroup/away", "row_id"), out="w.site AS site"), "smraw"))
def permute_groups(spark, d):
    return M.permute_groups(I.site_matrix(spark, d, masked=False), "site", ["row_id"], "regroup")


# --- cohort joins and windows --------------------------------------------------------------

@query("cohort_join", sql("""
SELECT r_name, n_name, count(*) AS n, round(avg(o_totalprice/1000),6) AS mean_price
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
JOIN region ON n_regionkey=r_regionkey WHERE c_acctbal>=0 GROUP BY 1,2"""))
def cohort_join(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = (o.join(c.where("c_acctbal >= 0"), o.o_custkey == c.c_custkey)
         .join(n, F.col("c_nationkey") == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey))
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"),
                                             r6(F.avg(F.col("o_totalprice") / 1000), "mean_price"))


_ANCHOR = "SELECT user_id, min(ts) AS anchor FROM events GROUP BY 1"


@query("event_scan", sql("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(sum(value),4) AS total FROM events GROUP BY 1"))
def event_scan(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"),
        F.round(F.sum("value"), 4).alias("total"))


@query("cohort_restrict", sql("""
SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING') GROUP BY 1"""))
def cohort_restrict(spark, d):
    e, c = table(spark, d, "events"), table(spark, d, "customer")
    return e.join(c.where("c_mktsegment = 'BUILDING'"), e.user_id == c.c_custkey, "left_semi").groupBy(
        "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("first_stay", sql("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r=1"""))
def first_stay(spark, d):
    f = C.first_per(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type"])
    return f.select("user_id", "event_id", "event_type")


def _anchored(spark, d):
    e = table(spark, d, "events")
    anchors = C.first_per(e, "user_id", ["ts", "event_id"], []).select("user_id", F.col("ts").alias("anchor"))
    return C.in_window(e, anchors, "user_id", "anchor", "ts", 24.0)


@query("in_window", sql("""
SELECT event_id, user_id FROM events JOIN a USING (user_id)
WHERE (epoch_us(ts)-epoch_us(anchor))/3.6e9 BETWEEN 0 AND 24""", extra={"a": _ANCHOR}))
def in_window(spark, d):
    return _anchored(spark, d).select("event_id", "user_id")


@query("anchor_interval_join", sql("""
SELECT event_id, user_id, round((epoch_us(ts)-epoch_us(anchor))/3.6e9,6) AS hours FROM events JOIN a USING (user_id)""",
    extra={"a": _ANCHOR}))
def anchor_interval_join(spark, d):
    e = table(spark, d, "events")
    anchors = C.first_per(e, "user_id", ["ts"], []).select("user_id", F.col("ts").alias("anchor"))
    return e.join(anchors, "user_id").select("event_id", "user_id", r6(S.hours_between("anchor", "ts"), "hours"))


@query("first_event_window_mean", sql("""
SELECT user_id, event_type, count(value) AS n, round(avg(value),6) AS mean FROM events JOIN a USING (user_id)
WHERE (epoch_us(ts)-epoch_us(anchor))/3.6e9 BETWEEN 0 AND 24 GROUP BY 1,2""", extra={"a": _ANCHOR}))
def first_event_window_mean(spark, d):
    m = C.item_means(_anchored(spark, d), "user_id", "event_type", "value")
    return m.select("user_id", "event_type", "n", r6(F.col("mean"), "mean"))


@query("event_pivot", sql("SELECT user_id, " + ", ".join(
    f"round(avg(CASE WHEN event_type='{t}' THEN value END),6) AS {t}" for t in TYPES)
    + """ FROM events JOIN a USING (user_id) WHERE (epoch_us(ts)-epoch_us(anchor))/3.6e9 BETWEEN 0 AND 24 GROUP BY 1""",
    extra={"a": _ANCHOR}))
def event_pivot(spark, d):
    p = C.pivot_items(C.item_means(_anchored(spark, d), "user_id", "event_type", "value"),
                      "user_id", "event_type", TYPES)
    return p.select("user_id", *[r6(F.col(t), t) for t in TYPES])


@query("top_items", sql("""
SELECT l_partkey, n FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, l_partkey LIMIT 40"""))
def top_items(spark, d):
    return C.top_items(table(spark, d, "lineitem"), "l_partkey", 40)


@query("site_floor", sql("""
SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= (SELECT count(*)/25 FROM customer)"""))
def site_floor(spark, d):
    c = table(spark, d, "customer")
    floor = c.count() // 25 + (c.count() % 25 > 0)
    return C.above_floor(c, "c_nationkey", floor).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("dimension_lookup", sql("""
SELECT n_name, r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1,2"""))
def dimension_lookup(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("profile_with_metadata", sql("""
SELECT s_nationkey, n, n_name FROM (SELECT c_nationkey AS s_nationkey, count(*) AS n FROM customer GROUP BY 1)
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey<>2) ON s_nationkey=n_nationkey"""))
def profile_with_metadata(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(
        F.count(F.lit(1)).alias("n"))
    n = table(spark, d, "nation").where("n_regionkey <> 2")
    return c.join(n, c.s_nationkey == n.n_nationkey, "left").select("s_nationkey", "n", "n_name")


@query("ever_bad", sql("""
SELECT l_orderkey, max(CASE WHEN (l_returnflag='R' AND l_linestatus='F') OR l_linenumber>=6 THEN 1 ELSE 0 END) AS bad FROM lineitem GROUP BY 1"""))
def ever_bad(spark, d):
    bad = ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")) | (F.col("l_linenumber") >= 6)
    return C.ever_bad(table(spark, d, "lineitem"), "l_orderkey", bad)


@query("default_flag", sql("""
SELECT c_nationkey, count(*) AS n, sum(coalesce(bad,0))::BIGINT AS bad FROM orders JOIN customer ON o_custkey=c_custkey
LEFT JOIN (SELECT l_orderkey, 1 AS bad FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag='R' AND l_linestatus='F'))
 ON o_orderkey=l_orderkey GROUP BY 1"""))
def default_flag(spark, d):
    li, o, c = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    flag = C.ever_bad(li, "l_orderkey", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
    j = o.join(flag, o.o_orderkey == flag.l_orderkey, "left").join(c, o.o_custkey == c.c_custkey)
    return j.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"),
                                        F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))


@query("file_routing", sql("""
SELECT file, (contains(lower(file),'_time_') OR starts_with(lower(file),'perf')) AS is_performance FROM (
SELECT DISTINCT CASE o_orderkey%3 WHEN 0 THEN 'perf_' WHEN 1 THEN 'orig_' ELSE 'historical_data_time_' END
 ||CAST(year(o_orderdate) AS VARCHAR)||'Q'||CAST(quarter(o_orderdate) AS VARCHAR)||'.txt' AS file FROM orders)"""))
def file_routing(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 3
    stem = F.when(k == 0, "perf_").when(k == 1, "orig_").otherwise("historical_data_time_")
    f = F.concat(stem, F.year("o_orderdate").cast("string"), F.lit("Q"),
                 F.quarter("o_orderdate").cast("string"), F.lit(".txt"))
    return o.select(f.alias("file")).distinct().select(
        "file", R.is_performance_file(F.col("file")).alias("is_performance"))


@query("json_records", sql("""
SELECT event_id, CAST(json_extract(props,'$.k') AS INT) AS k, CASE WHEN CAST(json_extract(props,'$.k') AS INT)%2=0 THEN 'even' ELSE 'odd' END AS predicted FROM events"""))
def json_records(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("j"))
    return e.select("event_id", F.col("j.k").alias("k"),
                    F.when(F.col("j.k") % 2 == 0, "even").otherwise("odd").alias("predicted"))


_LABELS = """SELECT DISTINCT p_partkey, CAST(p_size%3 AS VARCHAR) AS source,
 trim(regexp_replace(translate(lower(p_type||' ('||p_brand||')'),',.()-/','      '),'\\s+',' ','g')) AS label FROM part"""


def _rename_map(spark, d):
    p = table(spark, d, "part").withColumn("source", (F.col("p_size") % 3).cast("string"))
    lab = S.normalised_label(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")")))
    return C.align_vocabulary(p, "source", "p_partkey", lab)


@query("vocabulary_alignment", sql(f"""
SELECT source, p_partkey AS code, label, n_sources, n_sources=(SELECT count(DISTINCT source) FROM l) AS shared FROM l JOIN (
 SELECT label, count(DISTINCT source) AS n_sources FROM l GROUP BY 1) USING (label)""", extra={"l": _LABELS}))
def vocabulary_alignment(spark, d):
    return _rename_map(spark, d)


@query("vocabulary_stack", sql(f"""
SELECT label, count(*) AS n, count(DISTINCT source) AS n_sources FROM lineitem JOIN l ON l_partkey=p_partkey
 WHERE label IN (SELECT label FROM l GROUP BY 1 HAVING count(DISTINCT source)=(SELECT count(DISTINCT source) FROM l)) GROUP BY 1""",
                                 extra={"l": _LABELS}))
def vocabulary_stack(spark, d):
    """Order lines of all sources under the labels that every source has."""
    names = _rename_map(spark, d)
    part = table(spark, d, "part").select(F.col("p_partkey").alias("code"), (F.col("p_size") % 3).cast("string").alias("source"))
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("code")).join(part, "code")
    return C.stack_aligned(lines, "source", "code", names, True).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"))


# --- profiles ------------------------------------------------------------------------------

_PROFILE = """SELECT site, count(*) AS n, sum(y)::BIGINT AS events, """ + "+".join(
    f"CASE WHEN count(x{j})/count(*)>=0.5 THEN 1 ELSE 0 END" for j in range(8)) + " AS schema_size FROM sm GROUP BY 1"


@query("site_profile", sql("""
SELECT site, n, events, round(events/n,6) AS prevalence, schema_size,
 round(least(events,n-events)/greatest(schema_size,1),6) AS epv FROM p""", "sm", extra={"p": _PROFILE}))
def site_profile(spark, d):
    p = C.site_profile(I.site_matrix(spark, d), "site", XS)
    return p.select("site", "n", "events", r6(F.col("prevalence"), "prevalence"), "schema_size", r6(F.col("epv"), "epv"))


@query("site_profile_bands", sql("""
SELECT band, count(*) AS n_sites, sum(n)::BIGINT AS n_rows, round(avg(events/n),6) AS mean_prevalence, round(median(e),6) AS median_epv FROM (
 SELECT *, CASE WHEN e<10 THEN '0-10' WHEN e<50 THEN '10-50' WHEN e<100 THEN '50-100' ELSE '100+' END AS band
 FROM (SELECT *, events/8.0 AS e FROM p)) GROUP BY 1""", "sm", extra={"p": _PROFILE}))
def site_profile_bands(spark, d):
    p = C.site_profile(I.site_matrix(spark, d), "site", XS, numerator="positives", denominator="all")
    b = p.withColumn("band", C.band(F.col("epv"), [0, 10, 50, 100]))
    med = quantile_columns(b, ["band"], "epv", {"m": 0.5})
    a = b.groupBy("band").agg(F.count(F.lit(1)).alias("n_sites"), F.sum("n").alias("n_rows"),
                              r6(F.avg("prevalence"), "mean_prevalence"))
    return a.join(med, "band").select("band", "n_sites", "n_rows", "mean_prevalence", r6(F.col("m"), "median_epv"))


@query("schema_threshold", sql("SELECT site, var, n, n_obs FROM sp WHERE n_obs/n >= 0.8", "sp"))
def schema_threshold(spark, d):
    return M.site_schema(I.site_matrix(spark, d), "site", XS, 0.8)


@query("availability_spread", sql("""
SELECT var, round(min(n_obs/n),6) AS lowest, round(max(n_obs/n),6) AS highest, round(max(n_obs/n)-min(n_obs/n),6) AS spread
FROM (SELECT s.site, v.var, s.n, coalesce(p.n_obs,0) AS n_obs FROM (SELECT site, count(*) AS n FROM sm GROUP BY 1) s
 CROSS JOIN (SELECT unnest(range(8))::INT AS var) v LEFT JOIN sp p ON p.site=s.site AND p.var=v.var)
GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 6""", "sp"))
def availability_spread(spark, d):
    c = M.observed_counts(I.site_matrix(spark, d), ["site"], XS)
    a = C.availability_spread(c, 6)
    return a.select("var", *[r6(F.col(x), x) for x in ("lowest", "highest", "spread")])


@query("column_counts", sql(" UNION ALL ".join(
    f"SELECT {j} AS var, count(x{j}) AS n_obs, count(*) AS n FROM sm" for j in range(8)), "sm"))
def column_counts(spark, d):
    return M.observed_counts(I.site_matrix(spark, d), [], XS).select("var", "n_obs", "n")


@query("top_features", sql("""
SELECT var, n_obs FROM (SELECT var, count(*) AS n_obs FROM sl GROUP BY 1) ORDER BY n_obs DESC, var LIMIT 3""", "sl"))
def top_features(spark, d):
    c = M.observed_counts(I.site_matrix(spark, d), [], XS)
    return c.orderBy(F.desc("n_obs"), "var").limit(3).select("var", "n_obs")


@query("route_signature", sql("""
SELECT route, count(*) AS n FROM (SELECT (CASE WHEN x0 IS NOT NULL OR x1 IS NOT NULL THEN 1 ELSE 0 END)
 + (CASE WHEN x2 IS NOT NULL OR x3 IS NOT NULL THEN 2 ELSE 0 END) + (CASE WHEN x4 IS NOT NULL THEN 4 ELSE 0 END) AS route FROM ud) GROUP BY 1""", "ud"))
def route_signature(spark, d):
    u = I.user_day(spark, d)
    r = route_bits({"a": ["x0", "x1"], "b": ["x2", "x3"], "c": ["x4"]})
    return u.select(r.alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def route_bits(stations: dict[str, list[str]]):
    """One bit per station: set when any of its features is observed."""
    bits = [F.shiftleft(F.coalesce(*cols).isNotNull().cast("int"), i)
            for i, cols in enumerate([[F.col(c) for c in v] for v in stations.values()])]
    return sum(bits[1:], bits[0])


@query("partition_survey", sql("""
SELECT count(*) AS n_groups, min(n) AS min_size, max(n) AS max_size, round(max(n)/min(n),6) AS spread, median(n) AS median_size,
 count(CASE WHEN n>=1000 THEN 1 END) AS ge_1000, count(CASE WHEN n>=5000 THEN 1 END) AS ge_5000,
 count(CASE WHEN n>=20000 THEN 1 END) AS ge_20000, count(CASE WHEN n>=100000 THEN 1 END) AS ge_100000
FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)"""))
def partition_survey(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return C.partition_survey(s).withColumn("spread", F.round("spread", 6))


def _stations_sql() -> str:
    return sql("""SELECT station, feature, visits FROM r JOIN (
      SELECT DISTINCT CAST(round_even(i*(s-1)/5.0,0) AS INT)+1 AS k FROM (SELECT max(s) AS s FROM r), range(0,6) t(i) WHERE i<s) ON rn=k""",
               extra={"f": """SELECT 'L'||CAST(p_size%4 AS VARCHAR)||'_S'||p_brand AS station, CAST(l_partkey AS VARCHAR) AS feature, count(*) AS n_obs
        FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2""",
                      "r": """SELECT *, row_number() OVER (ORDER BY visits DESC, station) AS rn, count(*) OVER () AS s FROM (
        SELECT station, max(n_obs) AS visits, first(feature ORDER BY n_obs DESC, feature) AS feature FROM f GROUP BY 1)"""})


@query("spread_stations", _stations_sql())
def spread_stations(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    f = li.join(p, li.l_partkey == p.p_partkey).groupBy(
        F.concat(F.lit("L"), (F.col("p_size") % 4).cast("string"), F.lit("_S"), "p_brand").alias("station"),
        F.col("l_partkey").cast("string").alias("feature")).agg(F.count(F.lit(1)).alias("n_obs"))
    return C.spread_stations(f, "station", "feature", "n_obs", 6)


# --- sampling ------------------------------------------------------------------------------

def _rn(seed: str, part: str) -> str:
    return f"row_number() OVER (PARTITION BY {part} ORDER BY {md5_sql(seed, 'row_id')}, row_id)"


@query("stratified_folds", sql(f"SELECT row_id, y, CAST(({_rn('cv', 'y')}-1)%5 AS INT) AS fold FROM smraw", "smraw"))
def stratified_folds(spark, d):
    m = I.site_matrix(spark, d, masked=False).select("row_id", "y")
    return P.stratified_folds(m, ["row_id"], "y", "cv", 5)


@query("strat_split", sql(f"""
SELECT row_id, site, y, rn <= round(0.3::DOUBLE*n) AS is_test FROM (SELECT row_id, site, y, {_rn('split', 'site,y')} AS rn,
 count(*) OVER (PARTITION BY site,y) AS n FROM smraw)""", "smraw"))
def strat_split(spark, d):
    m = I.site_matrix(spark, d, masked=False).select("row_id", "site", "y")
    return P.stratified_split(m, "site", "y", ["row_id"], "split")


@query("site_cap", sql(f"""
SELECT row_id, site, y FROM (SELECT row_id, site, y, {_rn('cap', 'site')} AS rn FROM smraw
 WHERE site IN (SELECT site FROM smraw GROUP BY 1 HAVING count(*)>=150)) WHERE rn<=150""", "smraw"))
def site_cap(spark, d):
    m = I.site_matrix(spark, d, masked=False).select("row_id", "site", "y")
    return P.cap_sites(m, "site", "y", ["row_id"], "cap", 150)


@query("site_cap_prevalence", sql(f"""
SELECT row_id, site, y FROM (SELECT row_id, site, y, {_rn('cap2', 'site,y')} AS rn FROM smraw WHERE site IN (
 SELECT site FROM (SELECT site, row_number() OVER (ORDER BY {md5_sql('cap2/sites', 'site')}, site) AS k FROM smraw
  GROUP BY site HAVING sum(y)>=40 AND count(*)-sum(y)>=60) WHERE k<=10))
WHERE rn <= CASE WHEN y=1 THEN 40 ELSE 60 END""", "smraw"))
def site_cap_prevalence(spark, d):
    m = I.site_matrix(spark, d, masked=False).select("row_id", "site", "y")
    return P.cap_sites(m, "site", "y", ["row_id"], "cap2", 100, prevalence=0.4, max_sites=10)


@query("log_uniform_sites", sql(f"""
SELECT site, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM (
 SELECT row_id, site, {_rn('logu', 'site')} AS rn, count(*) OVER (PARTITION BY site) AS gn,
  {u_sql(md5_sql('logu/size', 'site'))} AS u FROM smraw)
WHERE gn<=50 OR rn <= floor(exp(ln(50.0::DOUBLE)+u*(ln(gn::DOUBLE)-ln(50.0::DOUBLE)))) GROUP BY 1""", "smraw"))
def log_uniform_sites(spark, d):
    m = I.site_matrix(spark, d, masked=False).select("row_id", "site")
    k = P.log_uniform_sites(m, "site", ["row_id"], "logu", 50)
    return k.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"),
                                 F.max("row_id").alias("last_row"))


@query("nested_fractions", sql(f"""
SELECT row_id, site, y, CASE WHEN rn<=round(n*0.25::DOUBLE) THEN 0.25 WHEN rn<=round(n*0.5::DOUBLE) THEN 0.5
 WHEN rn<=round(n*0.75::DOUBLE) THEN 0.75 ELSE 1.0 END::DOUBLE AS min_fraction FROM (
 SELECT row_id, site, y, {_rn('frac', 'site,y')} AS rn, count(*) OVER (PARTITION BY site,y) AS n FROM smraw)""", "smraw"))
def nested_fractions(spark, d):
    m = I.site_matrix(spark, d, masked=False).select("row_id", "site", "y")
    return P.nested_fraction(m, ["site", "y"], ["row_id"], "frac", [0.25, 0.5, 0.75, 1.0])


@query("quantile_edges", sql("SELECT pool, k, round(q,6) AS q FROM (" + " UNION ALL ".join(
    f"SELECT pool, {k} AS k, quantile_cont(epv_target, {p!r}) AS q FROM dec GROUP BY 1"
    for k, p in enumerate([0.0, 1 / 3, 2 / 3, 1.0])) + ")", "dec"))
def quantile_edges(spark, d):
    from sitelattice.operators.ordered import quantiles
    q = quantiles(I.decisions(spark, d), ["pool"], "epv_target", [0.0, 1 / 3, 2 / 3, 1.0])
    return q.select("pool", "k", r6(F.col("q"), "q"))


# --- sets ----------------------------------------------------------------------------------

@query("stack_union_schema", sql("""
SELECT site, var, n_obs, n FROM (
SELECT 'a' AS site, 0 AS var, count(x0) AS n_obs, count(*) AS n FROM ud WHERE site<'U10' UNION ALL
SELECT 'a', 1, count(x1), count(*) FROM ud WHERE site<'U10' UNION ALL SELECT 'a', 2, 0, count(*) FROM ud WHERE site<'U10' UNION ALL
SELECT 'b', 0, 0, count(*) FROM ud WHERE site>='U10' UNION ALL SELECT 'b', 1, count(x1), count(*) FROM ud WHERE site>='U10' UNION ALL
SELECT 'b', 2, count(x2), count(*) FROM ud WHERE site>='U10')""", "ud"))
def stack_union_schema(spark, d):
    u = I.user_day(spark, d)
    a = u.where("site < 'U10'").select(F.lit("a").alias("site"), "x0", "x1")
    b = u.where("site >= 'U10'").select(F.lit("b").alias("site"), "x1", "x2")
    return M.observed_counts(a.unionByName(b, allowMissingColumns=True), ["site"], ["x0", "x1", "x2"])


@query("pools_in_every_mode", sql("""
SELECT pool FROM pol GROUP BY 1 HAVING count(DISTINCT mode)=(SELECT count(DISTINCT mode) FROM pol)""", "pol"))
def pools_in_every_mode(spark, d):
    from sitelattice.operators.decisions import common_pools
    return common_pools(I.policy_scores(spark, d).select("mode", "pool").distinct(), "mode", "pool")


@query("remove_duplicate_arm", sql("SELECT pool, count(*) AS n FROM dec WHERE n_partners<>3 GROUP BY 1", "dec"))
def remove_duplicate_arm(spark, d):
    from sitelattice.operators.decisions import drop_arm
    dec = I.decisions(spark, d).withColumn("strategy", F.concat(F.lit("s"), F.col("n_partners").cast("string")))
    kept, _ = drop_arm(dec, "strategy", "s3")
    return kept.groupBy("pool").agg(F.count(F.lit(1)).alias("n"))
