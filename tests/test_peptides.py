"""Chances of rank correlations at known points, and the tables of peptides on a small frame."""

import pytest
from pyspark.sql import functions as F

from stepwright.operators import peptides as B
from stepwright.operators import stats as T


def test_chance_of_a_correlation(spark):
    # by hand from the closed form of Student's t
    want = {(0.5, 3): 2 / 3, (0.5, 4): 0.5, (0.5, 5): 0.3910022, (0.5, 6): 0.3125, (-0.5, 10): 0.1411133, (1.0, 7): 0.0, (1.0, 8): 0.0, (0.0, 9): 1.0}
    rows = spark.createDataFrame([(r, n) for r, n in want] + [(0.5, 2), (None, 9)], "rho double, n bigint")
    got = {(r["rho"], r["n"]): r["p"] for r in rows.withColumn("p", T.rank_correlation_p(F.col("rho"), F.col("n"))).collect()}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6), k
    assert got[(0.5, 2)] is None and got[(None, 9)] is None


def test_performance_table(spark):
    metrics = spark.createDataFrame([("1", "AK", 0.2, 0.4, 0.3, 10.0), ("2", "AK", 0.4, 0.8, 0.5, 30.0), ("1", "123", 1.0, 1.0, 1.0, 1.0)], "scenario string, class string, precision double, recall double, f1 double, support double")
    counts = spark.createDataFrame([("AK", 9), ("other", 4)], "class string, total_count bigint")
    got = {r["class"]: r for r in B.performance_table(metrics, counts).collect()}
    assert set(got) == {"AK", "123"}
    ak = got["AK"]
    assert (round(ak["precision"], 9), round(ak["recall"], 9), ak["support"]) == (0.3, 0.6, 20.0)
    assert ak["total_count"] == 9 and ak["log_count"] == 1.0 and ak["length"] == 2.0 and ak["mass"] == 235.28
    assert got["123"]["total_count"] == 0 and got["123"]["mass"] is None


def test_correlations_need_three_classes(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 4.0)], "class string, m double, q double")
    r = B.correlation_table(rows, ["m"], ["q"]).collect()
    assert [(x["n"], x["rho"], x["p"], x["passed"]) for x in r] == [(2, None, None, False)]
