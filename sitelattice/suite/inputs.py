"""Stand-in inputs derived from the given tables, each as a DataFrame and as DuckDB SQL.

Everything is a function of the tables' own rows (hash draws use their ids), so the work of
every query grows with the tables. The SQL twins are used by the correctness check only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelattice.functions.hashing import digest, hex_fraction
from sitelattice.functions.scalars import clip, expit
from sitelattice.operators.sampling import stratified_split
from sitelattice.session import prepare

XS = [f"x{j}" for j in range(8)]
TYPES = ["click", "error", "purchase", "signup", "view"]
DAY = [f"x{j}" for j in range(5)]
# Share of missing cells per variable for the negative and positive class.
MISS_NEG = [0.05, 0.08, 0.10, 0.15, 0.10, 0.20, 0.12, 0.18]
MISS_POS = [0.05, 0.14, 0.10, 0.21, 0.10, 0.26, 0.12, 0.24]
ROW_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read as it is; the registered queries reckon times in UTC."""
    prepare(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_id() -> F.Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in ROW_ID],
                       F.col("l_quantity").cast("int").cast("string"))


def site_matrix(spark: SparkSession, sf_dir: str, masked: bool = True) -> DataFrame:
    """row_id, site, site_no, y, x0..x7: order lines as records, customer nations as sites."""
    li, o, c, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    bought = o.join(c, o.o_custkey == c.c_custkey)  # orders meet customers before lines, which are four times as many, meet either
    j = li.join(bought, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    m = j.select(
        _row_id().alias("row_id"),
        F.concat(F.lit("S"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("site"),
        F.col("c_nationkey").alias("site_no"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_quantity") / 50.0).alias("x0"), (F.col("l_extendedprice") / 10000.0).alias("x1"),
        (F.col("l_discount") * 10.0).alias("x2"), (F.col("l_tax") * 10.0).alias("x3"),
        (F.col("o_totalprice") / 10000.0).alias("x4"), (F.col("c_acctbal") / 10000.0).alias("x5"),
        (F.col("p_size") / 50.0).alias("x6"), (F.col("p_retailprice") / 2000.0).alias("x7"))
    if not masked:
        return m
    m = m.withColumn("__h", digest("mask", "row_id"))
    out = []
    for k, x in enumerate(XS):
        miss = F.when(F.col("y") == 1, F.lit(MISS_POS[k])).otherwise(F.lit(MISS_NEG[k]))
        keep = hex_fraction(F.col("__h"), 4 * k + 1, 4) >= miss
        if k >= 4:
            keep = keep & (F.col("site_no") % 4 != k - 4)
        out.append(F.when(keep, F.col(x)).alias(x))
    return m.select("row_id", "site", "site_no", "y", *out)


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, site, y, x0..x4: mean event value per user, day and type; naturally incomplete."""
    e = table(spark, sf_dir, "events")
    d = F.to_date("ts")
    w = e.groupBy("user_id", d.alias("day")).agg(
        *[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(f"x{j}")
          for j, t in enumerate(TYPES)])
    return w.select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("row_id"),
        F.concat(F.lit("U"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("site"),
        ((F.col("user_id") + F.dayofmonth("day")) % 3 == 0).cast("int").alias("y"), *DAY)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, site, y, p: tied scores with real signal, one per order line."""
    li = table(spark, sf_dir, "lineitem")
    s = li.select(_row_id().alias("row_id"), "l_suppkey", "l_quantity", "l_discount").withColumn(
        "h", digest("score", "row_id"))
    z = (F.lit(-0.6) + 1.5 * (F.col("l_quantity") / 50.0 - 0.5) - 8.0 * (F.col("l_discount") - 0.05)
         + 2.0 * (hex_fraction(F.col("h"), 1) - 0.5))
    s = s.withColumn("p", F.round(expit(z), 3))
    return s.select(
        "row_id", F.concat(F.lit("P"), F.lpad((F.col("l_suppkey") % 12).cast("string"), 2, "0")).alias("site"),
        (hex_fraction(F.col("h"), 9) < F.col("p") * 0.9).cast("int").alias("y"), "p")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One merge decision per order: site adequacy, overlap, heterogeneity and benefit."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    h, g = digest("dec", "o_orderkey"), digest("dec2", "o_orderkey")
    u = [hex_fraction(h, 8 * i + 1) for i in range(4)]
    v = [hex_fraction(g, 8 * i + 1) for i in range(2)]
    b = j.select(
        "o_orderkey", F.col("n_name").alias("site"), F.col("r_name").alias("pool"),
        (F.col("o_orderkey") % 10).alias("seed"),
        F.floor(F.exp(4.0943445622221 + u[0] * 6.907755278982137)).alias("n_target"),
        (4 + F.col("o_orderkey") % 5).alias("d_target"),
        (1 + F.col("o_custkey") % 4).alias("n_partners"),
        (200 + F.floor(u[2] * 20000)).alias("partner_n"), u[1].alias("u2"), u[2].alias("u3"),
        u[3].alias("u4"), v[0].alias("u5"), v[1].alias("u6"),
        (F.col("o_custkey") % 3 / 2.0).alias("frac_cross"))
    b = b.withColumn("benefit", 0.02 - 0.008 * F.log10(F.col("n_target").cast("double"))
                     + 0.03 * (F.col("u5") - 0.5))
    known = F.col("u3") >= 0.04
    return b.select(
        "o_orderkey", "site", "pool", "seed", "n_target", "d_target", "n_partners",
        (F.col("n_partners") * F.col("partner_n")).alias("n_partner_total"),
        F.least("n_target", "partner_n").alias("n_min"),
        (F.col("n_partners") * F.col("partner_n") / F.col("n_target")).alias("ratio_partner_to_target"),
        F.round(F.col("n_target") * 0.12 / F.col("d_target") * (0.6 + 0.8 * F.col("u2")), 3).alias("epv_target"),
        F.round(0.3 + 0.7 * F.col("u4"), 2).alias("schema_jaccard"),
        F.when(known, F.round(F.exp(3.0 * F.col("u4")), 4)).alias("q_median"),
        F.when(known, F.round(0.9 * F.col("u2"), 4)).alias("i2_median"),
        "frac_cross", "benefit", (F.col("benefit") > 0).cast("int").alias("helped"),
        F.col("benefit").alias("lr_merge"),
        F.round(0.8 * F.col("benefit") + 0.01 * (F.col("u6") - 0.5), 6).alias("lr_ensemble"),
        F.when(F.col("u6") >= 0.3, F.round(0.02 * (F.col("u6") - 0.6), 6)).alias("gb_pooled"))


POLICIES = ["blend", "always_merge", "fix_075", "fix_050"]


def policy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy row per order: never, always, oracle and blended scores by mode and pool."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    h = digest("pol", "o_orderkey")
    u = [hex_fraction(h, 8 * i + 1) for i in range(4)]
    tilt = (F.col("c_nationkey") % 7 - 3) * 0.004
    b = j.select("o_orderkey", F.col("n_name").alias("pool"), "c_nationkey",
                 F.concat(F.lit("m"), (F.col("o_orderkey") % 5).cast("string")).alias("mode"),
                 (0.1 + 0.4 * u[0]).alias("ap_never_merge"), tilt.alias("t"),
                 *[x.alias(f"u{i + 1}") for i, x in enumerate(u)])
    b = b.where("NOT (c_nationkey = 3 AND mode = 'm4')")
    nev = F.col("ap_never_merge")
    return b.select(
        "o_orderkey", "pool", "mode", nev,
        (nev + F.col("t") + 0.02 * (F.col("u2") - 0.5)).alias("ap_always_merge"),
        (nev + 0.001 + 0.012 * F.col("u2")).alias("ap_oracle_lambda"),
        (nev + F.col("t") * 0.3 + 0.01 * (F.col("u3") - 0.4)).alias("ap_blend"),
        (nev + F.col("t") * 0.5 + 0.02 * (F.col("u3") - 0.5)).alias("ap_fix_075"),
        (nev + F.col("t") * 0.7 + 0.02 * (F.col("u4") - 0.5)).alias("ap_fix_050"))


def site_coefficients(spark: SparkSession, sf_dir: str, matrix: DataFrame | None = None) -> DataFrame:
    """Closed-form univariate site models: site, var, n, mu, sd, coef, raw, info; of ``matrix`` where it is at hand."""
    m = site_matrix(spark, sf_dir) if matrix is None else matrix
    agg = m.groupBy("site").agg(*[e for j, x in enumerate(XS) for e in (
        F.count(x).alias(f"n{j}"), F.avg(x).alias(f"m{j}"), F.stddev_pop(x).alias(f"s{j}"),
        F.regr_slope("y", x).alias(f"b{j}"), F.regr_sxx("y", x).alias(f"i{j}"))])
    long = agg.select("site", F.inline(F.array(*[F.struct(
        F.lit(j).alias("var"), F.col(f"n{j}").alias("n"), F.col(f"m{j}").alias("mu"),
        F.col(f"s{j}").alias("sd"), (F.col(f"b{j}") * F.col(f"s{j}")).alias("coef"),
        F.col(f"b{j}").alias("raw"), F.col(f"i{j}").alias("info")) for j in range(len(XS))])))
    return long.where("n > 0 AND raw IS NOT NULL")


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, seed, fold, metric with a few missing values, aggregated from order lines."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 6).cast("string")).alias("method"),
        (F.col("l_orderkey") % 10).cast("int").alias("seed"),
        (F.floor(F.col("l_orderkey") / 10) % 5).cast("int").alias("fold")).agg(
        F.avg("l_discount").alias("a"), F.count(F.lit(1)).alias("n"))
    return g.select("method", "seed", "fold", F.when(
        F.col("n") % 17 != 0, F.floor(F.col("a") * 10000 + 1e-6) / 10000.0).alias("metric"))


# --- the same inputs in SQL ----------------------------------------------------------------

_H = "('0x'||substr({h},{s},{k}))::BIGINT::DOUBLE/{d}.0"


def u_sql(h: str, start: int = 1, digits: int = 8) -> str:
    return _H.format(h=h, s=start, k=digits, d=16**digits)


def md5_sql(seed: str, *ids: str) -> str:
    return "md5(concat_ws('|','" + seed + "'," + ",".join(f"CAST({i} AS VARCHAR)" for i in ids) + "))"


_ROW = ("concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
        "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR))")

_MASK = ", ".join(
    f"CASE WHEN {u_sql('h', 4 * k + 1, 4)} >= CASE WHEN y=1 THEN {MISS_POS[k]}::DOUBLE ELSE {MISS_NEG[k]}::DOUBLE END"
    + (f" AND site_no % 4 <> {k - 4}" if k >= 4 else "") + f" THEN x{k} END AS x{k}"
    for k in range(8))

CTES = {
    "smraw": f"""SELECT {_ROW} AS row_id, 'S'||lpad(CAST(c_nationkey AS VARCHAR),2,'0') AS site,
        c_nationkey AS site_no, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS y,
        l_quantity/50.0::DOUBLE AS x0, l_extendedprice/10000.0::DOUBLE AS x1, l_discount*10.0::DOUBLE AS x2,
        l_tax*10.0::DOUBLE AS x3, o_totalprice/10000.0::DOUBLE AS x4, c_acctbal/10000.0::DOUBLE AS x5,
        p_size/50.0::DOUBLE AS x6, p_retailprice/2000.0::DOUBLE AS x7
        FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
        JOIN part ON l_partkey=p_partkey""",
    "sm": f"""SELECT row_id, site, site_no, y, {_MASK}
        FROM (SELECT *, {md5_sql('mask', 'row_id')} AS h FROM smraw)""",
    "ud": """SELECT concat_ws('|', CAST(user_id AS VARCHAR), CAST(day AS VARCHAR)) AS row_id,
        'U'||lpad(CAST(user_id%20 AS VARCHAR),2,'0') AS site,
        CASE WHEN (user_id + day(day))%3=0 THEN 1 ELSE 0 END AS y, x0,x1,x2,x3,x4 FROM (
        SELECT user_id, CAST(ts AS DATE) AS day, """ + ", ".join(
        f"avg(CASE WHEN event_type='{t}' THEN value END) AS x{j}" for j, t in enumerate(TYPES))
        + " FROM events GROUP BY 1,2)",
    "sc": f"""SELECT row_id, site, CASE WHEN {u_sql('h', 9)} < p*0.9::DOUBLE THEN 1 ELSE 0 END AS y, p FROM (
        SELECT row_id, h, 'P'||lpad(CAST(l_suppkey%12 AS VARCHAR),2,'0') AS site,
        round(1.0::DOUBLE/(1.0+exp(-(-0.6::DOUBLE+1.5::DOUBLE*(l_quantity/50.0::DOUBLE-0.5)
          -8.0::DOUBLE*(l_discount-0.05::DOUBLE)+2.0::DOUBLE*({u_sql('h', 1)}-0.5)))),3) AS p
        FROM (SELECT *, {md5_sql('score', 'row_id')} AS h FROM (SELECT *, {_ROW} AS row_id FROM lineitem)))""",
    "dec0": f"""SELECT o_orderkey, n_name AS site, r_name AS pool, o_orderkey%10 AS seed,
        CAST(floor(exp(4.0943445622221::DOUBLE+{u_sql('h', 1)}*6.907755278982137::DOUBLE)) AS BIGINT) AS n_target,
        4+o_orderkey%5 AS d_target, 1+o_custkey%4 AS n_partners,
        200+CAST(floor({u_sql('h', 17)}*20000) AS BIGINT) AS partner_n, {u_sql('h', 9)} AS u2,
        {u_sql('h', 17)} AS u3, {u_sql('h', 25)} AS u4, {u_sql('g', 1)} AS u5, {u_sql('g', 9)} AS u6,
        (o_custkey%3)/2.0::DOUBLE AS frac_cross
        FROM (SELECT *, {md5_sql('dec', 'o_orderkey')} AS h, {md5_sql('dec2', 'o_orderkey')} AS g FROM orders)
        JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
        JOIN region ON n_regionkey=r_regionkey""",
    "dec1": """SELECT *, 0.02::DOUBLE-0.008::DOUBLE*log10(n_target::DOUBLE)+0.03::DOUBLE*(u5-0.5) AS benefit
        FROM dec0""",
    "dec": """SELECT o_orderkey, site, pool, seed, n_target, d_target, n_partners,
        n_partners*partner_n AS n_partner_total, least(n_target,partner_n) AS n_min,
        (n_partners*partner_n)::DOUBLE/n_target AS ratio_partner_to_target,
        round(n_target*0.12::DOUBLE/d_target*(0.6::DOUBLE+0.8::DOUBLE*u2),3) AS epv_target,
        round(0.3::DOUBLE+0.7::DOUBLE*u4,2) AS schema_jaccard,
        CASE WHEN u3>=0.04 THEN round(exp(3.0::DOUBLE*u4),4) END AS q_median,
        CASE WHEN u3>=0.04 THEN round(0.9::DOUBLE*u2,4) END AS i2_median, frac_cross, benefit,
        CASE WHEN benefit>0 THEN 1 ELSE 0 END AS helped, benefit AS lr_merge,
        round(0.8::DOUBLE*benefit+0.01::DOUBLE*(u6-0.5),6) AS lr_ensemble,
        CASE WHEN u6>=0.3 THEN round(0.02::DOUBLE*(u6-0.6::DOUBLE),6) END AS gb_pooled FROM dec1""",
    "pol": f"""SELECT o_orderkey, pool, mode, ap_never_merge,
        ap_never_merge+t+0.02::DOUBLE*(u2-0.5) AS ap_always_merge,
        ap_never_merge+0.001::DOUBLE+0.012::DOUBLE*u2 AS ap_oracle_lambda,
        ap_never_merge+t*0.3::DOUBLE+0.01::DOUBLE*(u3-0.4::DOUBLE) AS ap_blend,
        ap_never_merge+t*0.5::DOUBLE+0.02::DOUBLE*(u3-0.5) AS ap_fix_075,
        ap_never_merge+t*0.7::DOUBLE+0.02::DOUBLE*(u4-0.5) AS ap_fix_050 FROM (
        SELECT o_orderkey, n_name AS pool, c_nationkey, 'm'||CAST(o_orderkey%5 AS VARCHAR) AS mode,
        0.1::DOUBLE+0.4::DOUBLE*{u_sql('h', 1)} AS ap_never_merge, (c_nationkey%7-3)*0.004::DOUBLE AS t,
        {u_sql('h', 9)} AS u2, {u_sql('h', 17)} AS u3, {u_sql('h', 25)} AS u4
        FROM (SELECT *, {md5_sql('pol', 'o_orderkey')} AS h FROM orders)
        JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey)
        WHERE NOT (c_nationkey=3 AND mode='m4')""",
    "cf": " UNION ALL ".join(
        f"""SELECT site, {j} AS var, count(x{j}) AS n, avg(x{j}) AS mu, stddev_pop(x{j}) AS sd,
        regr_slope(y,x{j})*stddev_pop(x{j}) AS coef, regr_slope(y,x{j}) AS raw, regr_sxx(y,x{j}) AS info
        FROM sm GROUP BY site HAVING count(x{j})>0 AND regr_slope(y,x{j}) IS NOT NULL""" for j in range(8)),
    "fo": """SELECT method, seed, fold, CASE WHEN n%17<>0 THEN floor(a*10000+1e-6)/10000.0::DOUBLE END AS metric
        FROM (SELECT 'm'||CAST(l_suppkey%6 AS VARCHAR) AS method, CAST(l_orderkey%10 AS INT) AS seed,
        CAST((l_orderkey//10)%5 AS INT) AS fold, avg(l_discount) AS a, count(*) AS n
        FROM lineitem GROUP BY 1,2,3)""",
    "sl": " UNION ALL ".join(f"SELECT row_id, site, y, {j} AS var, x{j} AS value FROM sm WHERE x{j} IS NOT NULL"
                             for j in range(8)),
    "sp": """SELECT site, var, count(*)::BIGINT AS n_obs, any_value(n)::BIGINT AS n FROM sl
        JOIN (SELECT site, count(*) AS n FROM sm GROUP BY 1) USING (site) GROUP BY 1,2""",
}
NEEDS = {"sm": ["smraw"], "cf": ["sm"], "dec1": ["dec0"], "dec": ["dec1"], "sl": ["sm"], "sp": ["sl", "sm"]}


def split(df: DataFrame, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(training, held-out) rows, 70 to 30, stratified by outcome, and within a column's groups if named."""
    s = stratified_split(df.withColumn("all", F.col(by) if by else F.lit(0)), "all", "y", ["row_id"], "holdout").drop("all")
    return s.where("NOT is_test"), s.where("is_test")


def sql(body: str, *ctes: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``body`` preceded by the named inputs (with what they need) and any extra CTEs."""
    order: list[str] = []

    def add(c):
        for n in NEEDS.get(c, []):
            add(n)
        if c not in order:
            order.append(c)
    for c in ctes:
        add(c)
    parts = [f"{c} AS MATERIALIZED ({CTES[c]})" for c in order]
    parts += [f"{k} AS {'' if recursive else 'MATERIALIZED '}({v})" for k, v in (extra or {}).items()]
    if not parts:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body
