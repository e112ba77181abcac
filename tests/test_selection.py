"""Feature selection and importance on small frames whose results are plain."""

import math

import numpy as np
from pyspark.sql import functions as F

from stepwright.operators import selection as S


def test_repeated_and_constant_features_go(spark):
    rows = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 3.0 + 1).alias("b"), F.lit(2.0).alias("c"), (F.col("id") % 3).cast("double").alias("d"))
    got = {r["feature"]: r for r in S.uncorrelated(rows, ["a", "b", "c", "d"]).collect()}
    assert set(got) == {"a", "b", "d"}  # c doesn't vary
    assert got["b"]["place"] == 1 and got["b"]["kept"] and got["d"]["kept"]
    assert not got["a"]["kept"] and got["a"]["partner"] == "b" and abs(got["a"]["corr_abs"] - 1) < 1e-9


def test_missing_values_become_the_median(spark):
    rows = spark.createDataFrame([("r1", 1.0, None), ("r2", None, None), ("r3", 3.0, None), ("r4", float("nan"), None), ("r5", float("inf"), None)], "id string, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in S.filled(rows, ["id"], ["a", "b"]).collect()}
    assert got == {"r1": (1.0, 0.0), "r2": (2.0, 0.0), "r3": (3.0, 0.0), "r4": (2.0, 0.0), "r5": (2.0, 0.0)}
    assert S.filled(rows.limit(0), ["id"], ["a", "b"]).count() == 0


def test_empty_and_single_rows(spark):
    none = spark.createDataFrame([], "class string, a double, b double")
    assert [r["kept"] for r in S.variances(none, ["a", "b"]).collect()] == [False, False]
    assert S.correlations(none, ["a", "b"]).count() == 0
    assert S.by_anova(none, ["a", "b"]).count() == 0
    assert [r["feature"] for r in S.uncorrelated(none, ["a", "b"]).collect()] == ["a", "b"]  # none varies: all stay


def test_information_of_a_feature_that_names_the_class(spark):
    rows = spark.range(400).select(F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("class"), F.lit("sure").alias("feature"), (F.col("id") % 2).cast("double").alias("v"))
    rows = rows.unionByName(spark.range(400).select(F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("class"), F.lit("flat").alias("feature"), F.lit(1.0).alias("v")))
    got = {r["feature"]: r["mi"] for r in S.mutual_information(rows).collect()}
    assert abs(got["sure"] - math.log(2)) < 1e-9 and got["flat"] == 0


def test_rotation_uses_every_value_once(spark):
    rows = spark.range(500).select(F.concat(F.lit("r"), "id").alias("read_id"), F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"))
    got = S.rotated(rows, "read_id", ["a", "b"], block=60).collect()
    assert sorted(r["r_a"] for r in got) == [float(i) for i in range(500)]
    assert all(r["r_a"] == -r["r_b"] for r in got) and sum(r["r_a"] == r["a"] for r in got) < 5
    swapped = S.permuted(rows, "read_id", ["a", "b"])
    assert swapped.count() == 1500 and swapped.where("changed = 'a' and b <> -cast(substring(read_id, 2) as double)").count() == 0


def test_occlusion_hides_one_window(spark):
    x = np.arange(11.0).tolist()
    rows = spark.createDataFrame([("r", x), ("none", [])], "read_id string, x array<double>")
    got = {r["start"]: r for r in S.occluded(rows, 4, 3).collect()}
    assert set(got) == {None, 0, 3, 6, 9} and got[None]["x"] == x
    for s in (0, 3, 6, 9):
        want = list(x)
        want[s : s + 4] = [5.0] * len(want[s : s + 4])
        assert got[s]["x"] == want and got[s]["center"] == (s + min(s + 4, 11)) / 2


def test_importance_scaled_by_read_and_group(spark):
    rows = spark.createDataFrame([("r", "c", 0.5, 0.2), ("r", "c", 1.5, -0.4), ("q", "c", 0.5, 0.8), ("o", "d", 0.5, 0.0)], "read_id string, class string, center double, drop double")
    got = {(r["read_id"], r["center"]): (r["local"], r["of_group"], r["highlighted"]) for r in S.scaled_importance(rows, "class").collect()}
    assert got == {("r", 0.5): (0.5, 0.25, True), ("r", 1.5): (1.0, 0.5, True), ("q", 0.5): (1.0, 1.0, True), ("o", 0.5): (0.0, 0.0, False)}
