"""Errors, sources, sampling properties and small functions."""

import math

import pytest
from pyspark.sql import functions as F

from sitelattice.functions import scalars as S
from sitelattice.operators import decisions as D
from sitelattice.operators import leakage as L
from sitelattice.operators import matrix as M
from sitelattice.operators import merging as MG
from sitelattice.operators import partners as PA
from sitelattice.operators import ranktests as RT
from sitelattice.operators import sampling as P
from sitelattice.sources import readers as R


def test_leakage_guards_raise(spark):
    rows = [(i, int(i % 2), float(i % 2) + i * 1e-6, 1.0 if i % 2 else None) for i in range(400)]
    d = spark.createDataFrame(rows, "id int, y int, a double, b double")
    with pytest.raises(L.LeakageError, match="b"):
        L.assert_no_missingness_leak(d, ["a", "b"])
    with pytest.raises(L.LeakageError, match="a"):
        L.assert_no_value_leak(d, ["a"])
    with pytest.raises(ValueError):
        L.assert_no_missingness_leak(d.where("y = 1"), ["a"])


def test_leak_inside_one_stratum_is_found(spark):
    rows = [(i, int(i % 2), "s" if i < 300 else "t", 1.0 if (i >= 300 or i % 2) else None) for i in range(1000)]
    d = spark.createDataFrame(rows, "id int, y int, arm string, b double")
    assert L.missingness_leaks(d, ["b"]).count() == 0
    with pytest.raises(L.LeakageError):
        L.assert_no_missingness_leak(d, ["b"], strata=["arm"])


def test_value_report_skips_openly(spark):
    rows = [(i, int(i % 2), float(i) if i < 10 else None) for i in range(100)]
    r = L.value_leakage_report(spark.createDataFrame(rows, "id int, y int, a double"), ["a"]).first()
    assert r["skipped"] and r["auroc"] is None and r["n_observed"] == 10


def test_paired_table_refuses_bad_input(spark):
    f = spark.createDataFrame([("a", 0, 0, 0.5), ("b", 0, 0, 0.4), ("b", 0, 0, 0.3)], "method string, seed int, fold int, v double")
    with pytest.raises(RT.DuplicateKeyError):
        RT.paired_test_table(f, "a", "v")
    with pytest.raises(ValueError):
        RT.paired_test_table(f.dropDuplicates(["method"]), "a", "v")
    with pytest.raises(ValueError):
        RT.paired_test_table(f.where("method = 'a'"), "a", "v")


def test_equal_pairs_have_p_one(spark):
    f = spark.createDataFrame([(m, s, 0, 0.5) for m in "ab" for s in range(4)], "method string, seed int, fold int, v double")
    assert RT.paired_test_table(f, "a", "v").first()["p_raw"] == 1.0


def test_row_count_lock(spark):
    with pytest.raises(D.RowCountDrift):
        D.check_row_count(spark.range(3), 4)


def test_matrix_store_keys_every_parameter(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.0), ("b", None)], "site string, x0 double")
    R.write_site_matrix(d, str(tmp_path), "m", {"floor": 1})
    assert R.load_site_matrix(spark, str(tmp_path), "m", {"floor": 1}).count() == 2
    with pytest.raises(FileNotFoundError, match="m"):
        R.load_site_matrix(spark, str(tmp_path), "m", {"floor": 2})


@pytest.mark.parametrize("rate, beta, neg, pos", [(0.3, 1.5, 70, 30), (0.9, -2.0, 10, 90), (0.01, 0.0, 5, 5), (0.5, 6.0, 99, 1),
                                                  (0.2, 1.0, 0, 8), (0.2, 1.0, 8, 0)])
def test_chances_reach_the_rate_and_differ_by_beta(rate, beta, neg, pos):
    a, b = M.missing_chances(rate, beta, neg, pos)
    assert (neg * a + pos * b) / (neg + pos) == pytest.approx(rate, abs=1e-12)
    logit = lambda v: math.log(v / (1 - v))
    assert logit(b) - logit(a) == pytest.approx(beta, abs=1e-9)


def test_chance_corners():
    assert M.missing_chances(0.0, 2.0, 3, 4) == (0.0, 0.0)
    with pytest.raises(ValueError):
        M.missing_chances(1.0, 0.0, 1, 1)


def test_recorded_variables_share_a_core_and_rotate(spark):
    sites = spark.range(7).select(F.col("id").cast("int").alias("no"))
    got = {r["no"]: set(r["recorded"]) for r in M.recorded_variables(sites, "no", 10, 0.4).collect()}
    for no, seen in got.items():
        start = 4 + (no * 3) % 6
        assert seen == {j for j in range(10) if j < 4 or start <= j < start + 3}
    assert all(len(r["recorded"]) == 5 for r in M.recorded_variables(sites, "no", 5, 1.0).collect())


def test_chi_square_cuts(spark):
    want = {1: 3.841459, 2: 5.991465, 5: 11.070498, 24: 36.415029, 100: 124.342113, 101: 125.458419, 500: 553.126810}
    df = spark.createDataFrame([(k,) for k in want], "k long")
    for r in df.select("k", MG.chi2_cut(F.col("k")).alias("c")).collect():
        assert r["c"] == pytest.approx(want[r["k"]], rel=1e-4)


def test_csv_matches_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2,3\n")
    (tmp_path / "b.csv").write_text('c,x,a\n30,"9,9",10\n31,,\n')
    got = R.read_csv(spark, str(tmp_path), {"a": "int", "b": "int", "c": "int"}).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 2, 3), (10, None, 30), (None, None, 31)], key=repr)
    got = R.read_csv_union(spark, f"{tmp_path}/*.csv", lambda c: c in ("a", "x")).select("a", "x").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("1", None), ("10", "9,9"), (None, None)], key=repr)


def test_banner_is_told_by_its_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Notes offered\nk,v,w\n1,,\n2,"x, y",3\n')
    got = R.read_csv_with_banner(spark, str(tmp_path), ["k", "v", "w"]).collect()
    assert sorted(map(tuple, got)) == [("1", None, None), ("2", "x, y", "3")]


def test_privacy_budgets():
    assert S.gaussian_sigma(1.0, math.inf) == 0.0
    assert S.per_round_epsilon(1.0, 2) == 0.5            # basic wins at few rounds
    assert S.per_round_epsilon(1.0, 1000) > 1.0 / 1000   # advanced wins at many


def test_subsets_are_distinct_members(spark):
    sites = spark.createDataFrame([(f"s{i}",) for i in range(7)], "site string")
    for r in PA.partner_subsets(sites, "t").collect():
        assert len(set(r["members"])) == len(r["members"]) <= 4 and r["target"] not in r["members"]
    two = PA.partner_subsets(sites.limit(2), "t").collect()
    assert all(len(r["members"]) == 1 for r in two)


def test_containment_needs_listing_and_grouping(spark):
    s = spark.createDataFrame([(f"{a}{b}", 1, [1]) for a in "xyz" for b in "12"], "site string, n int, vars array<int>")
    found = lambda name, listed: [tuple(r) for r in PA.nestings(s, name, listed).collect()]
    assert found("m", {"m": 1, "n": 2}) == [("m", 1, 3, 3)]
    assert found("other", {"m": 1}) == []
    assert found("m", {"m": 2}) == []


def test_permutation_keeps_sizes(spark):
    d = spark.range(500).select("id", (F.col("id") % 7).alias("g"))
    p = M.permute_groups(d, "g", ["id"], "s")
    size = lambda x: sorted(map(tuple, x.groupBy("g").count().collect()))
    assert size(p) == size(d)
    assert p.join(d.withColumnRenamed("g", "h"), "id").where("g <> h").count() > 300


def test_nested_fractions_nest(spark):
    d = spark.range(101).select("id", (F.col("id") % 2).alias("y"))
    f = P.nested_fraction(d, ["y"], ["id"], "s", [0.25, 0.5, 1.0])
    n = {r["min_fraction"]: r["count"] for r in f.groupBy("min_fraction").count().collect()}
    assert n[0.25] == 26 and sum(n.values()) == 101


def test_symmetric_log(spark):
    r = spark.createDataFrame([(-455.0,), (10.0,), (20.0,)], "v double").select(S.symmetric_log(F.col("v")).alias("s")).collect()
    assert r[0]["s"] == pytest.approx(-(1 + math.log10(455 / 20))) and r[1]["s"] == 0.5 and r[2]["s"] == 1.0
