"""Evaluation of predictions: rows of (id, y_true, y_pred, confidence), metrics as tidy rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranks import sum_before


def confusion(preds: DataFrame) -> DataFrame:
    """Counts per true and predicted label, those that occur."""
    return preds.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_grid(cells: DataFrame) -> DataFrame:
    """The confusion of all true with all predicted labels, with 0 where none fell, and each row's shares.

    The grid has a row for each pair of labels; labels are few whatever the number of predictions.
    """
    rows = cells.groupBy("y_true").agg(F.sum("n").alias("row_n"))
    cols = cells.select("y_pred").distinct()
    grid = rows.join(F.broadcast(cols), how="cross").join(cells, ["y_true", "y_pred"], "left")
    n = F.coalesce("n", F.lit(0))
    return grid.select("y_true", "y_pred", n.alias("n"), F.when(F.col("row_n") > 0, n / F.col("row_n")).otherwise(F.lit(0.0)).alias("row_share"))


def per_class(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of the true labels; 0 where a denominator is 0.

    A label that is only ever predicted has no row, but its predictions count against recall.
    """
    true = cells.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred = cells.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    both = true.join(pred, "label", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    p = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("predicted") + F.col("support")), F.lit(0.0))
    return both.select("label", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support", "tp", "predicted")


def summary(classes: DataFrame, cells: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, micro (over true labels), macro and weighted averages, and the correlation coefficient.

    Of one row: all sums are over labels. The coefficient is 0 where its denominator is.
    """
    s = F.sum("support")
    sums = classes.agg(
        s.alias("n"),
        F.sum("tp").alias("tp"),
        F.sum("predicted").alias("predicted"),
        F.avg("recall").alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), s).alias("weighted_f1"),
    )
    t = cells.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("t"), F.lit(0).cast("bigint").alias("p"))
    p = cells.groupBy(F.col("y_pred").alias("label")).agg(F.lit(0).cast("bigint").alias("t"), F.sum("n").alias("p"))
    tp = t.unionByName(p).groupBy("label").agg(F.sum("t").cast("double").alias("t"), F.sum("p").cast("double").alias("p"))
    cross = tp.agg(F.sum(F.col("t") * F.col("p")).alias("pt"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    n = F.col("n").cast("double")
    mcc = F.try_divide(F.col("tp") * n - F.col("pt"), F.sqrt(n * n - F.col("pp")) * F.sqrt(n * n - F.col("tt")))
    return sums.crossJoin(cross).select(
        "n",
        F.try_divide("tp", "n").alias("accuracy"),
        "balanced_accuracy",
        F.try_divide("tp", "predicted").alias("micro_precision"),
        "macro_precision",
        "macro_f1",
        "weighted_f1",
        F.coalesce(mcc, F.lit(0.0)).alias("mcc"),
    )


def coverage(preds: DataFrame, thresholds: list[float]) -> DataFrame:
    """Share of predictions at least as sure as each threshold, and their accuracy; null where there are none."""
    right = F.col("y_true") == F.col("y_pred")
    sums = [F.count("*").alias("total")]
    for i, t in enumerate(thresholds):
        sure = F.col("confidence") >= t
        sums += [F.count_if(sure).alias(f"kept{i}"), F.count_if(sure & right).alias(f"hits{i}")]
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"kept{i}").alias("kept"), F.col(f"hits{i}").alias("hits")) for i, t in enumerate(thresholds)])
    kept = preds.agg(*sums).select("total", F.explode(rows).alias("r")).select("total", "r.*")
    return kept.select("threshold", F.try_divide("kept", "total").alias("coverage"), F.try_divide("hits", "kept").alias("accuracy"))


def _points(preds: DataFrame) -> DataFrame:
    """Per predicted label, its points of precision and recall by falling confidence, ties together.

    Points are counted per label and confidence first, so the running sums go over different
    confidences, not over predictions.
    """
    right = (F.col("y_true") == F.col("y_pred")).cast("long")
    points = preds.groupBy(F.col("y_pred").alias("label"), "confidence").agg(F.count("*").alias("n"), F.sum(right).alias("hit"))
    support = preds.groupBy(F.col("y_true").alias("label")).agg(F.count("*").alias("support"))
    surest_first = points.withColumn("key", -F.col("confidence"))
    run = sum_before(surest_first, ["label"], "key", "n").withColumn("seen", F.col("before") + F.col("n")).drop("before")
    run = sum_before(run, ["label"], "key", "hit").withColumn("hits", F.col("before") + F.col("hit")).join(support, "label")
    return run.select("label", "confidence", "hit", "support", (F.col("hits") / F.col("seen")).alias("precision"), (F.col("hits") / F.col("support")).alias("recall"))


def precision_recall(preds: DataFrame) -> DataFrame:
    """The points of precision and recall of each predicted label: (label, confidence, precision, recall)."""
    return _points(preds).drop("hit", "support")


def average_precision(preds: DataFrame) -> DataFrame:
    """Sum over a label's points of the gain in recall, which is its own hits over the support, times the precision."""
    part = F.col("hit") / F.col("support") * F.col("precision")
    return _points(preds).groupBy("label").agg(F.sum(part).alias("average_precision"))


def calibration_bins(preds: DataFrame, bins: int = 10) -> DataFrame:
    """Predictions in bins of confidence, from the surest down: accuracy and coverage of each bin and all surer ones."""
    right = (F.col("y_true") == F.col("y_pred")).cast("long")
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    counts = preds.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum(right).alias("hit"))
    down = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("n").over(W.partitionBy())
    run = counts.select("bin", "n", F.sum("hit").over(down).alias("hits"), F.sum("n").over(down).alias("seen"), total.alias("total"), (F.col("hit") / F.col("n")).alias("accuracy"))
    return run.select("bin", "n", "accuracy", (F.col("hits") / F.col("seen")).alias("accuracy_down"), (F.col("seen") / F.col("total")).alias("coverage"))


def error_summary(preds: DataFrame) -> DataFrame:
    """Right and wrong predictions per true label."""
    right = F.count_if(F.col("y_true") == F.col("y_pred"))
    return preds.groupBy("y_true").agg(F.count("*").alias("n"), right.alias("n_correct")).select("y_true", "n", "n_correct", (F.col("n") - F.col("n_correct")).alias("n_incorrect"), (1 - F.col("n_correct") / F.col("n")).alias("error_rate"))


def surest_examples(preds: DataFrame, k: int, right: bool) -> DataFrame:
    """The k surest right (or wrong) predictions per true label; ties by id."""
    ok = (F.col("y_true") == F.col("y_pred")) == F.lit(right)
    place = F.row_number().over(W.partitionBy("y_true").orderBy(F.desc("confidence"), "id"))
    return preds.where(ok).withColumn("place", place).where(F.col("place") <= k).select("y_true", "place", "id", "y_pred", "confidence")


def sanitize(probs: Column) -> Column:
    """Probabilities made valid: missing, infinite and negative ones are 0, a row of zeros is uniform, the sum is 1."""
    clean = F.transform(probs, lambda p: F.when(p.isNull() | F.isnan(p) | (p < 0) | (p == float("inf")), F.lit(0.0)).otherwise(p))
    total = F.aggregate(clean, F.lit(0.0), lambda a, p: a + p)
    return F.when(total > 0, F.transform(clean, lambda p: p / total)).otherwise(F.transform(clean, lambda p: F.lit(1.0) / F.size(clean)))


def top_k_accuracy(ranked: DataFrame, ks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Share of rows whose true label is among the first k of the array ranked, for each k."""
    at = F.array_position("ranked", F.col("y_true"))
    return ranked.agg(*[F.avg(((at > 0) & (at <= k)).cast("double")).alias(f"top{k}") for k in ks], F.count("*").alias("n"))
