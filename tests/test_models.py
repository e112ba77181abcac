"""Models are judged on all held-out rows and on these only."""

from pyspark.sql import functions as F

from stepwright.plans import models


def test_classes_without_training_rows_count_as_wrong(spark, monkeypatch):
    part = F.pmod(F.xxhash64("read_id", F.lit(1)), F.lit(10))
    rows = spark.range(200).select(F.concat(F.lit("r"), "id").alias("read_id"), (F.col("id") % 2).alias("odd"), *[(F.col("id") % 2 + F.lit(0.01) * F.col("id")).alias(c) for c in models.FEATURES])
    held = F.col("read_id").isin([r[0] for r in rows.where(part <= 1).select("read_id").orderBy("read_id").limit(5).collect()])
    rows = rows.withColumn("class", F.when(held, "rare").when(F.col("odd") == 1, "a").otherwise("b")).drop("odd").localCheckpoint()
    n = rows.where(part <= 1).count()
    monkeypatch.setattr(models, "features", lambda s, d: rows)
    got = models.model_forest_predictions(spark, "").collect()
    assert len(got) == n and sum(r["y_true"] == "rare" for r in got) == 5 and {r["y_pred"] for r in got} <= {"a", "b"}
    top = models.model_forest_top_k(spark, "").first()
    assert top["n"] == n and abs(top["top3"] - (n - 5) / n) < 1e-9
