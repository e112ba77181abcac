"""Features of distances against a plain computation, and blended distances by hand."""

import numpy as np
import pytest

from stepwright.operators import distance_features as DF


def test_features_of_distances(spark):
    rng = np.random.default_rng(5)
    d = rng.gamma(2.0, 3.0, (40, 5))
    rows = spark.createDataFrame([(f"r{i:02d}", "c", list("abcde"), v.tolist()) for i, v in enumerate(d)] + [("none", "c", [], [])], "read_id string, class string, names array<string>, ds array<double>")
    got = {r["read_id"]: r for r in DF.features(rows).collect()}
    assert len(got) == 40
    med = np.median(d, axis=0)
    z = (d - med) / (np.median(np.abs(d - med), axis=0) + 1e-12)
    w = np.median(np.median(d, axis=1)) + 1e-12
    for i, v in enumerate(d):
        r, s = got[f"r{i:02d}"], np.sort(v)
        p = np.exp(-v / w**2) / (np.exp(-v / w**2).sum() + 1e-12)
        m = v - v.mean()
        skew = (m**3).mean() / v.std() ** 3 * np.sqrt(20) / 3
        kurt = (6 * ((m**4).mean() / v.std() ** 4 - 3) + 6) * 4 / 6
        want = {
            "d_min": s[0], "d_second": s[1], "d_min_margin": s[1] - s[0], "d_median": np.median(v), "d_std": v.std(), "d_mad": np.median(np.abs(v - np.median(v))), "d_p90": np.percentile(v, 90), "d_iqr": np.percentile(v, 75) - np.percentile(v, 25),
            "d_skew": skew, "d_kurt": kurt, "d_count_near": (v <= 1.5 * np.median(v)).sum(), "d_mean_z": z[i].mean(), "d_max_z": z[i].max(), "d_min_z": z[i].min(),
            "d_softmax_entropy": -(p * np.log(p + 1e-12)).sum(), "d_softmax_max": p.max(), "d_rbf_mean": np.exp(-((v / w) ** 2)).mean(), "d_rbf_max": np.exp(-((v / w) ** 2)).max(),
        }
        assert r["nearest"] == "abcde"[int(v.argmin())]
        for k, x in want.items():
            assert r[k] == pytest.approx(x, rel=1e-6, abs=1e-9), k


def test_one_distance_and_none(spark):
    rows = spark.createDataFrame([("r", None, ["a"], [2.0])], "read_id string, class string, names array<string>, ds array<double>")
    r = DF.features(rows).first()
    assert (r["nearest"], r["d_min"], r["d_second"], r["d_skew"], r["d_kurt"]) == ("a", 2.0, None, None, None)
    assert DF.features(rows.limit(0)).count() == 0


def test_blended(spark):
    pairs = spark.createDataFrame([("p", "c", "q", "c", 1.0), ("p", "c", "r", "c", 3.0), ("q", "c", "r", "c", 2.0), ("q", "c", "lost", "c", 9.0)], "id_a string, class_a string, id_b string, class_b string, distance double")
    vectors = spark.createDataFrame([("p", [0.0, 0.0]), ("q", [3.0, 4.0]), ("r", [0.0, 0.0])], "read_id string, v array<double>")
    got = {(r["id_a"], r["id_b"]): (r["feature_distance"], r["combined"]) for r in DF.blended(pairs, vectors, 0.25).collect()}
    assert got == {("p", "q"): (5.0, 0.75), ("p", "r"): (0.0, 0.25), ("q", "r"): (5.0, 0.875)}
