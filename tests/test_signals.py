"""Kernels and detectors against plain versions and planted cases."""

import math
import random

import numpy as np

from stepwright.functions import kernels as K
from stepwright.operators import detector as D
from stepwright.operators import distance, silhouette
from stepwright.operators import physchem as P
from stepwright.operators.ranks import average_ranks, group_quantiles, sum_before
from pyspark.sql import functions as F


def plain_warp(x, y, band):
    n, m = len(x), len(y)
    w = max(min(max(math.ceil(band * max(n, m)), 8), 500), abs(n - m))
    best = {(0, 0): (0.0, 0)}
    for i in range(1, n + 1):
        for j in range(max(1, i - w), min(m, i + w) + 1):
            ways = [best.get(k) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1))]
            ways = [v for v in ways if v is not None]
            if ways:
                c = min(v[0] for v in ways)
                steps = next(v[1] for v in ways if v[0] == c)
                best[i, j] = (c + abs(x[i - 1] - y[j - 1]), steps + 1)
    c, k = best[n, m]
    return c / k


def test_warping_equals_plain_version():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 9), (16, 16), (30, 7), (60, 55)):
        x, y = rng.normal(size=(4, n)).round(1), rng.normal(size=(4, m)).round(1)
        got = K.warp_distances(x, y, 0.2)
        assert np.allclose(got, [plain_warp(a, b, 0.2) for a, b in zip(x, y)])
    assert np.isinf(K.warp_distances(np.zeros((2, 0)), np.zeros((2, 3)))).all()


def test_filters():
    b, a = K.second_order(0.05, "butterworth")
    assert math.isclose(b[0], 0.0200834, abs_tol=1e-6) and math.isclose(b.sum(), a.sum())
    x = np.full(40, 3.0)
    assert np.allclose(K.zero_phase(x, *K.second_order(0.2, "bessel")), 3.0)
    assert (K.zero_phase(x[:9], b, a) == x[:9]).all()
    t = np.arange(200)
    wave = np.sin(2 * np.pi * t / 50)
    assert np.abs(K.zero_phase(wave, *K.second_order(0.2, "bessel")) - wave)[20:-20].max() < 0.1


def test_resampling_keeps_a_wave():
    t = np.arange(64)
    up = K.polyphase(np.sin(2 * np.pi * t / 32), 128)
    assert np.abs(up - np.sin(2 * np.pi * np.arange(128) / 64))[30:-30].max() < 5e-3
    assert len(K.polyphase(np.zeros(0), 5)) == 0 and (K.polyphase(t * 1.0, 64) == t).all()


def test_segments_tile_and_find_steps(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, 60), rng.normal(8, 1, 40), rng.normal(-5, 1, 50)]
    cut = K.split_segments(x)
    assert [a for a, _ in cut[1:]] == [b for _, b in cut[:-1]] and cut[0][0] == 0 and cut[-1][1] == len(x)
    assert any(abs(a - 60) <= 1 for a, _ in cut) and any(abs(a - 100) <= 1 for a, _ in cut)
    df = spark.createDataFrame([(1, [float(v) for v in x]), (2, []), (3, [2.0])], "i int, x array<double>")
    got = {r["i"]: r["g"] for r in df.select("i", K.segments("x").alias("g")).collect()}
    assert len(got[1]) == len(cut) and got[2] == [] and [tuple(g) for g in got[3]] == [(0, 1, 2.0, 0.0, 1)]


def test_regions_are_recovered(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        a, n = rng.randint(20, 30), rng.randint(8, 14)
        x = [100 + rng.gauss(0, 1) if not a <= k < a + n else 60 + rng.gauss(0, 1) for k in range(60)]
        rows.append((f"r{i}", "c", x, a, a + n))
    rows += [("empty", "c", [], 0, 0), ("flat", "c", [100.0] * 60, 0, 0), ("late", "c", [100.0] * 50 + [50.0] * 10, 0, 0), ("long", "c", [1.0] * 15_001, 0, 0)]
    df = spark.createDataFrame(rows, "read_id string, class string, x array<double>, a int, b int")
    got = {r["read_id"]: r for r in D.verdicts(df).collect()}
    hit = sum(got[f"r{i}"]["reason"] == "valid" and abs(got[f"r{i}"]["region_start"] - rows[i][3]) <= 3 and abs(got[f"r{i}"]["region_end"] - rows[i][4]) <= 3 for i in range(60))
    assert hit >= 57
    assert [got[k]["reason"] for k in ("empty", "flat", "late", "long")] == ["signal-missing", "no-drop", "region-late", "signal-long"]
    assert D.verdicts(df.limit(0)).count() == 0
    assert {r["reason"]: r["n"] for r in D.verdict_summary(D.verdicts(df)).collect()}["valid"] >= 57


def test_templates_and_thresholds(spark):
    rows = [(f"r{i}", "a" if i < 6 else "b", [float(k + i % 2) for k in range(20)]) for i in range(9)] + [("n", None, [1.0]), ("e", "a", [])]
    df = spark.createDataFrame(rows, "read_id string, class string, x array<double>")
    dist = distance.to_template(df)
    assert dist.count() == 9
    limits = {r["class"]: r["threshold"] for r in distance.thresholds(dist).collect()}
    assert limits["a"] is not None and limits["b"] is None


def test_ranks_and_quantiles_in_blocks(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), float(rng.choice([1, 2, 2, 3, 50, -7]) if rng.random() < 0.5 else rng.gauss(0, 1))) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v double")
    q = {r["g"]: r for r in group_quantiles(df, ["g"], "v", {"m": 0.5, "p": 0.9}).collect()}
    for g in ("a", "b", None):
        mine = [v for k, v in rows if k == g]
        assert math.isclose(q[g]["m"], np.quantile(mine, 0.5)) and math.isclose(q[g]["p"], np.quantile(mine, 0.9))
    ranks = average_ranks(df.withColumn("i", F.monotonically_increasing_id()), ["g"], "v", "rank").collect()
    for g in ("a", None):
        mine = sorted(v for k, v in rows if k == g)
        for r in ranks:
            if r["g"] == g:
                at = [i + 1 for i, v in enumerate(mine) if v == r["v"]]
                assert r["rank"] == sum(at) / len(at)
    whole = sum_before(df.select("v").distinct().withColumn("w", F.lit(1)), [], "v", "w").orderBy("v").collect()
    assert [r["before"] for r in whole] == list(range(len(whole)))
    assert group_quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def test_silhouettes_of_one_class(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 2.0), (2, "a", 3.0, 2.0), (3, "a", None, 1.0)], "id int, class string, x double, y double")
    rows = silhouette.silhouettes(silhouette.standardised(df, ["x", "y"]), "id", ["x", "y"]).collect()
    assert len(rows) == 2 and all(r["silhouette"] is None for r in rows)


def test_peptide_properties(spark):
    df = spark.createDataFrame([("KKDDE",), ("GAV",), ("",), (None,), ("ß12",)], "s string")
    rows = df.select(P.length(F.col("s")).alias("n"), P.net_charge(F.col("s")).alias("q"), P.isoelectric_point(F.col("s")).alias("pi"), P.mean_hydropathy(F.col("s")).alias("h")).collect()
    assert rows[0]["n"] == 5 and -1.2 < rows[0]["q"] < -0.8 and 3.5 < rows[0]["pi"] < 5
    assert math.isclose(rows[1]["h"], (-0.4 + 1.8 + 4.2) / 3) and rows[2]["pi"] is None and rows[3]["q"] is None and rows[4]["n"] == 0
