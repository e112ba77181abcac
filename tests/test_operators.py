"""Operators on small tables: nulls, empty tables, ties, repeated rows, clashing names."""

import math

from pyspark.sql import functions as F

from stepwright.functions import arrays as A
from stepwright.functions.names import dataset_key, file_key, run_key
from stepwright.operators import evaluation as E
from stepwright.operators.skew import heavy_candidates, skew_aggregate, skew_distinct, skew_join
from stepwright.sources import signals as S


def one(spark, value, expr, kind="array<double>"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_run_key_ignores_spelling(spark):
    same = ["QAR-2030_03-ssQ-0001739", "qar 2030 3 ssq 1739", "Qar.2030.03.Ssq.1739", "  QAR--2030_03--ssQ__0001739\t", "QAR-２０３０_０３-ssQ-０００１７３９"]
    assert len({one(spark, v, run_key, "string") for v in same}) == 1
    assert one(spark, "QAR-2030_03-ssQ-0001738", run_key, "string") != one(spark, same[0], run_key, "string")
    assert one(spark, " -- ", run_key, "string") is None and one(spark, None, run_key, "string") is None
    assert one(spark, "A-000", run_key, "string") == "a 0"


def test_file_key_ignores_mounts(spark):
    a = "out/QAR-2030_03-ssQ-0001739/lead_fwd/plr/signals.tsv"
    same = [a, "./" + a, "/mnt/seqstore/" + a, "file:///srv/archive7/out/./" + a[4:], "D:\\seq\\" + a.replace("/", "\\"), a + " ", a.replace("/", "//")]
    assert len({one(spark, v, file_key, "string") for v in same}) == 1
    assert one(spark, "", file_key, "string") is None and one(spark, "signals.tsv", file_key, "string") == "signals.tsv"
    assert one(spark, " TRAIN ", dataset_key, "string") == "train" and one(spark, "  ", dataset_key, "string") is None


def test_heavy_keys(spark):
    rows = spark.createDataFrame([("a",)] * 50 + [("b",)] * 5 + [(f"k{i}",) for i in range(35)] + [(None,)] * 10, "k string")
    assert {"a", "b"} <= {r[0] for r in heavy_candidates(rows, "k").collect()}
    got = {r["key_value"]: (r["heavy"], r["n_rows"]) for r in skew_aggregate(rows, "k", []).collect()}
    assert got["a"] == (True, 50) and got["b"] == (True, 5) and got["k1"] == (False, 1) and None not in got and len(got) == 37
    empty = rows.limit(0)
    assert skew_aggregate(empty, "k", []).count() == 0 and skew_distinct(empty, "k", "k").count() == 0


def test_skew_join_and_distinct(spark):
    rows = spark.createDataFrame([("a", i % 7, "x") for i in range(40)] + [("b", 1, "y"), ("c", None, "z"), (None, 3, "w")], "k string, v int, note string")
    got = {r[0]: r[1] for r in skew_distinct(rows, "k", "v").collect()}
    assert got == {"a": 7, "b": 1, "c": 0} or got == {"a": 7, "b": 1}
    dim = spark.createDataFrame([("a", 1.0, "d"), ("b", 2.0, "e")], "k string, w double, note string")
    joined = skew_join(rows, dim, "k")
    assert joined.count() == 41 and set(joined.columns) == {"k", "v", "note", "w", "note_dim"}


def test_arrays_at_the_edges(spark):
    for x in ([], [1.0], [1.0, 2.0], [3.0] * 9):
        assert len(one(spark, x, A.a_diff)) == max(0, len(x) - 1)
        assert len(one(spark, x, lambda c: A.moving_mean(c, 5))) == len(x)
        assert len(one(spark, x, lambda c: A.resample_lerp(c, 4))) == (4 if x else 0)
        assert len(one(spark, x, lambda c: A.pad_or_cut(c, 3))) == 3
    assert one(spark, [], A.a_median) is None and one(spark, [4.0, 1.0], A.a_median) == 2.5
    assert one(spark, [0.0, 0.0, 1.0, 2.0, 0.0], A.trim_pad) == [1.0, 2.0] and one(spark, [0.0], A.trim_pad) == []
    got = one(spark, [True, True, False, True], A.islands, "array<boolean>")
    assert [(i["s"], i["e"]) for i in got] == [(0, 2), (3, 4)]
    assert one(spark, [], A.islands, "array<boolean>") == []


def test_signal_text(spark):
    assert one(spark, " 1.5  2 nan x 3.1.2 inf -4 ", S.parse_signal, "string") == [1.5, 2.0, -4.0]
    assert one(spark, None, S.parse_signal, "string") == [] and one(spark, "", S.parse_signal, "string") == []
    assert one(spark, "10M2I3D5=1X4S", S.cigar_span, "string") == 19


def test_signal_tsv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 1, 2, 1.0, 2.0, None, None, 3.0, 4.0, "1 2 3")], S.SIGNAL_SCHEMA)
    S.write_signal_tsv(rows, str(tmp_path / "t"))
    assert S.read_signal_tsv(spark, str(tmp_path / "t")).collect() == rows.collect()
    S.write_signal_tsv(rows.limit(0), str(tmp_path / "e"))
    assert S.read_signal_tsv(spark, str(tmp_path / "e")).count() == 0


def test_probabilities_are_made_valid(spark):
    assert one(spark, [float("nan"), -1.0, None], E.sanitize) == [1 / 3] * 3
    got = one(spark, [2.0, float("inf"), 2.0], E.sanitize)
    assert got == [0.5, 0.0, 0.5] and math.isclose(sum(got), 1.0)


def test_evaluation_of_a_label_never_true(spark):
    preds = spark.createDataFrame([(1, "a", "a", 0.9), (2, "a", "c", 0.8), (3, "b", "b", 0.7)], "id int, y_true string, y_pred string, confidence double")
    cells = E.confusion(preds)
    labels = {r["label"]: r for r in E.per_class(cells).collect()}
    assert set(labels) == {"a", "b"} and labels["a"]["recall"] == 0.5
    s = E.summary(E.per_class(cells), cells).first()
    assert math.isclose(s["accuracy"], 2 / 3) and s["micro_precision"] == 1.0
    assert E.confusion_grid(cells).count() == 6
