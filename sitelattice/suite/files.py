"""Registered file work: tables written to the shared folder in the source's format, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitelattice.operators.decisions import union_of_keys
from sitelattice.session import ensure_checkpoint_dir
from sitelattice.sources import readers as R
from sitelattice.streaming.running_mean import running_item_means
from sitelattice.suite import inputs as I
from sitelattice.suite.inputs import sql, table
from sitelattice.suite.registry import query


def _scratch(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files/{uuid.uuid4().hex}"


@query("csv_declared_columns", sql("""SELECT event_type, count(*) AS n, round(avg(value),6) AS mean_value, min(ts) AS first_ts FROM events GROUP BY 1"""))
def csv_declared_columns(spark, d):
    path = _scratch(spark)
    table(spark, d, "events").write.option("header", True).option("compression", "gzip").option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    e = R.read_csv(spark, path, {"ts": "timestamp_ntz", "event_type": "string", "value": "double"})
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"),
                                       F.min("ts").alias("first_ts"))


@query("csv_stacked_files", sql("""SELECT l_returnflag, count(*) AS n, round(avg(l_discount),6) AS mean_discount FROM lineitem GROUP BY 1"""))
def csv_stacked_files(spark, d):
    """Files of one schema, half of them with a notes line above the header."""
    path = _scratch(spark)
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_discount")
    li.where("l_orderkey % 2 = 0").write.option("header", True).csv(f"{path}/a")
    rows = li.where("l_orderkey % 2 = 1").select(F.concat_ws(",", "l_orderkey", "l_returnflag", "l_discount").alias("value"))
    head = spark.createDataFrame([("Notes offered by Prospectus",), ("l_orderkey,l_returnflag,l_discount",)], "value string")
    head.unionByName(rows).write.text(f"{path}/b")
    s = R.read_csv_with_banner(spark, [f"{path}/a", f"{path}/b"], ["l_orderkey", "l_returnflag", "l_discount"])
    return s.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"),
                                         F.round(F.avg(F.col("l_discount").try_cast("double")), 6).alias("mean_discount"))


@query("csv_glob_union", sql("""SELECT CASE WHEN o_custkey % 3 < 2 THEN o_orderstatus END AS o_orderstatus, count(*) AS n,
 round(sum(o_totalprice/1000),4) AS total FROM orders GROUP BY 1"""))
def csv_glob_union(spark, d):
    """Parts whose headers differ: another order, an extra column, an absent one."""
    path = _scratch(spark)
    o = table(spark, d, "orders")
    for y, columns in enumerate((["o_orderkey", "o_orderstatus", "o_totalprice"],
                                 ["o_totalprice", "o_clerk_note", "o_orderstatus"], ["o_totalprice", "o_orderkey"])):
        part = o.where(f"o_custkey % 3 = {y}").withColumn("o_clerk_note", F.lit("a, b"))
        part.select(*columns).write.option("header", True).csv(f"{path}/part_{y}")
    g = R.read_csv_union(spark, f"{path}/part_*", lambda c: c in ("o_orderstatus", "o_totalprice"))
    return g.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"),
                                          F.round(F.sum(F.col("o_totalprice").try_cast("double") / 1000), 4).alias("total"))


@query("delimited_short_rows", sql("""SELECT c_mktsegment, count(*) AS n, count(CASE WHEN c_custkey%5<>0 THEN 1 END) AS n_seen FROM customer
 WHERE c_custkey%7<>0 GROUP BY 1"""))
def delimited_short_rows(spark, d):
    """Pipe-delimited rows without a header; short rows are skipped, blanks become missing."""
    path = _scratch(spark)
    bal = F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.col("c_acctbal").cast("string"))
    full = F.concat_ws("|", "c_custkey", "c_mktsegment", bal)
    table(spark, d, "customer").select(F.when(F.col("c_custkey") % 7 == 0, F.concat_ws("|", "c_custkey", "c_mktsegment"))
                                       .otherwise(full).alias("value")).write.text(path)
    r = R.read_delimited(spark, path, ["key", "c_mktsegment", "balance"], 3)
    return r.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count("balance").alias("n_seen"))


@query("wide_csv", sql(" UNION ALL ".join(f"SELECT {j} AS var, count(x{j}) AS n_obs FROM ud" for j in range(5)), "ud"))
def wide_csv(spark, d):
    path = _scratch(spark)
    I.user_day(spark, d).drop("site").write.option("header", True).csv(path)
    w = R.read_wide_csv(spark, path, ["row_id", "y"])
    a = w.agg(*[F.count(c).alias(c) for c in I.DAY])
    return a.select(F.inline(F.array(*[F.struct(F.lit(j).alias("var"), F.col(c).alias("n_obs")) for j, c in enumerate(I.DAY)])))


@query("site_matrix_roundtrip", sql("SELECT site, count(*) AS n, sum(y)::BIGINT AS events, round(avg(x0),6) AS m0 FROM sm GROUP BY 1", "sm"))
def site_matrix_roundtrip(spark, d):
    root, params = _scratch(spark), {"floor": 0, "mask": "default", "columns": I.XS}
    R.write_site_matrix(I.site_matrix(spark, d), root, "order_lines", params)
    m = R.load_site_matrix(spark, root, "order_lines", params)
    return m.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"), F.round(F.avg("x0"), 6).alias("m0"))


@query("decision_rows_union", sql("""SELECT pool, count(*) AS n, count(a) AS n_a, count(b) AS n_b FROM (
 SELECT pool, benefit AS a, NULL AS b FROM dec UNION ALL SELECT pool, NULL, q_median FROM dec) GROUP BY 1""", "dec"))
def decision_rows_union(spark, d):
    path = _scratch(spark)
    dec = I.decisions(spark, d)
    both = union_of_keys([dec.select("pool", F.col("benefit").alias("a")), dec.select("pool", F.col("q_median").alias("b"))])
    R.write_rows(both, path, "csv")
    r = R.read_csv(spark, path, {"pool": "string", "a": "double", "b": "double"})
    return r.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("n_a"), F.count("b").alias("n_b"))


@query("job_records", sql("SELECT k, count(*) AS n FROM (SELECT CAST(json_extract(props,'$.k') AS INT) AS k FROM events) GROUP BY 1"))
def job_records(spark, d):
    path = _scratch(spark)
    table(spark, d, "events").select("props").write.text(path)
    return R.read_jobs(spark, path, {"k": "int"}).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("chunked_item_means", sql("""SELECT user_id, event_type AS item, count(value) AS n, round(avg(value),6) AS mean FROM events GROUP BY 1,2"""))
def chunked_item_means(spark, d):
    """Running sums over event files as they arrive, equal to the batch means."""
    path = _scratch(spark)
    table(spark, d, "events").select("user_id", "event_type", "value").write.parquet(f"{path}/in")
    m = running_item_means(spark, f"{path}/in", f"{path}/state", "user_id", "event_type", "value",
                           "user_id bigint, event_type string, value double")
    return m.select("user_id", F.col("event_type").alias("item"), "n", F.round("mean", 6).alias("mean"))
