"""Evaluation by subsets of labels, from class probabilities, of mixtures, and over repeated runs.

Predictions are rows (id, y_true, y_pred, confidence), probabilities rows (id, y_true, label, p).
Labels, subsets and runs are few whatever the number of rows; all sums over rows come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import materialize
from .manifest import label_group
from .ranks import group_quantiles, sum_before

SUBSETS = ("all", "known", "known_no_mixture", "unknown")


def subsets_of(label: Column) -> Column:
    """The subsets that a true label belongs to, see SUBSETS."""
    group = label_group(label)
    return F.array_compact(F.array(F.lit("all"), F.when(group != "unknown", "known"), F.when(group == "known", "known_no_mixture"), F.when(group == "unknown", "unknown")))


def subset_cells(preds: DataFrame) -> DataFrame:
    """Counts per subset, true and predicted label."""
    cells = preds.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    return cells.select(F.explode(subsets_of(F.col("y_true"))).alias("subset"), "y_true", "y_pred", "n")


def label_scores(cells: DataFrame) -> DataFrame:
    """Per subset and true label: support, tp, predicted, precision, recall and F1; 0 where a denominator is 0."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    true = cells.groupBy("subset", F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    pred = cells.groupBy("subset", F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    both = true.join(pred, ["subset", "label"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.withColumns({
        "precision": zero(F.try_divide("tp", "predicted")),
        "recall": zero(F.try_divide("tp", "support")),
        "f1": zero(F.try_divide(F.col("tp") * 2.0, F.col("predicted") + F.col("support"))),
    })


def subset_summaries(cells: DataFrame) -> DataFrame:
    """One row per subset with rows: accuracy, balanced accuracy, correlation, and micro, macro and weighted precision,
    recall and F1 over its true labels."""
    cells = materialize(cells, "cells")
    s = F.sum("support")
    mean = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    weighted = [F.try_divide(F.sum(F.col(c) * F.col("support")), s).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    sums = label_scores(cells).groupBy("subset").agg(s.alias("n"), F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), *mean, *weighted)
    t = cells.groupBy("subset", F.col("y_true").alias("label")).agg(F.sum("n").cast("double").alias("t"), F.lit(0.0).alias("p"))
    p = cells.groupBy("subset", F.col("y_pred").alias("label")).agg(F.lit(0.0).alias("t"), F.sum("n").cast("double").alias("p"))
    both = t.unionByName(p).groupBy("subset", "label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    cross = both.groupBy("subset").agg(F.sum(F.col("t") * F.col("p")).alias("pt"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    n = F.col("n").cast("double")
    mcc = F.try_divide(F.col("tp") * n - F.col("pt"), F.sqrt(n * n - F.col("pp")) * F.sqrt(n * n - F.col("tt")))
    return sums.join(cross, "subset").select(
        "subset", "n", (F.col("tp") / n).alias("accuracy"), F.col("macro_recall").alias("balanced_accuracy"), F.coalesce(mcc, F.lit(0.0)).alias("mcc"),
        F.try_divide("tp", "predicted").alias("micro_precision"), (F.col("tp") / n).alias("micro_recall"), F.try_divide(F.col("tp") * 2.0, F.col("predicted") + F.col("n")).alias("micro_f1"),
        *[f"{k}_{c}" for k in ("macro", "weighted") for c in ("precision", "recall", "f1")],
    )


def report(cells: DataFrame) -> DataFrame:
    """Classification report as text: a row per subset and label, then macro avg and weighted avg; numbers with six decimals."""
    scores = label_scores(cells)
    s = F.sum("support")
    names = ("precision", "recall", "f1")
    macro = scores.groupBy("subset").agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in names], s.alias("support"))
    weighted = scores.groupBy("subset").agg(F.lit("weighted avg").alias("label"), *[F.try_divide(F.sum(F.col(c) * F.col("support")), s).alias(c) for c in names], s.alias("support"))
    rows = scores.select("subset", "label", *names, "support").unionByName(macro).unionByName(weighted)
    return rows.select("subset", "label", *[F.format_string("%.6f", F.col(c) + 1e-9).alias(c) for c in names], "support")


def confusion_notes(cells: DataFrame, share: float = 0.1, top: int = 2) -> DataFrame:
    """The cells of a confusion that get a number: the diagonal, the top of each row and all above a share of it."""
    row = W.partitionBy("subset", "y_true")
    placed = cells.withColumn("row_share", F.col("n") / F.sum("n").over(row)).withColumn("place", F.row_number().over(row.orderBy(F.desc("n"), "y_pred")))
    return placed.where((F.col("y_true") == F.col("y_pred")) | (F.col("place") <= top) | (F.col("row_share") > share)).drop("place")


def micro_curve(probs: DataFrame) -> DataFrame:
    """Precision and recall of all (row, label) pairs together by falling probability, ties together: (p, n, hit, precision, recall)."""
    right = (F.col("y_true") == F.col("label")).cast("long")
    points = probs.groupBy((-F.col("p")).alias("key")).agg(F.count("*").alias("n"), F.sum(right).alias("hit"))
    total = probs.agg(F.sum(right).alias("total"))
    run = sum_before(points, [], "key", "n").withColumn("seen", F.col("before") + F.col("n")).drop("before")
    run = sum_before(run, [], "key", "hit").withColumn("hits", F.col("before") + F.col("hit")).crossJoin(F.broadcast(total))
    return run.where("total > 0").select((-F.col("key")).alias("p"), "n", "hit", (F.col("hits") / F.col("seen")).alias("precision"), (F.col("hits") / F.col("total")).alias("recall"))


def average_precisions(probs: DataFrame) -> DataFrame:
    """One-vs-rest average precision of every label that is true somewhere, with the micro and macro average: (label, average_precision).

    A point's gain in recall is its own hits over the label's rows, so no row has to look at the one before.
    """
    probs = probs.select("y_true", "label", "p")
    right = (F.col("y_true") == F.col("label")).cast("long")
    points = probs.groupBy("label", (-F.col("p")).alias("key")).agg(F.count("*").alias("n"), F.sum(right).alias("hit"))
    support = points.groupBy("label").agg(F.sum("hit").alias("support")).where("support > 0")
    run = sum_before(points, ["label"], "key", "n").withColumn("seen", F.col("before") + F.col("n")).drop("before")
    run = sum_before(run, ["label"], "key", "hit").withColumn("hits", F.col("before") + F.col("hit")).join(support, "label")
    part = F.col("hit") / F.col("support") * F.col("hits") / F.col("seen")
    per = materialize(run.groupBy("label").agg(F.sum(part).alias("average_precision")), "precisions")
    micro = micro_curve(probs)
    total = micro.agg(F.sum("hit").alias("total"))
    micro = micro.crossJoin(F.broadcast(total)).agg(F.sum(F.col("hit") / F.col("total") * F.col("precision")).alias("average_precision"))
    return per.unionByName(micro.select(F.lit("micro").alias("label"), "average_precision")).unionByName(per.agg(F.avg("average_precision").alias("average_precision")).select(F.lit("macro").alias("label"), "average_precision"))


def macro_curve(probs: DataFrame, grid: int = 50) -> DataFrame:
    """The mean over labels of precision at evenly spaced recalls, interpolated between a label's points: (recall, precision, n_labels).

    Points are first brought down to the first and last of each grid cell, so a label has two rows per cell at most.
    """
    right = (F.col("y_true") == F.col("label")).cast("long")
    points = probs.groupBy("label", (-F.col("p")).alias("key")).agg(F.count("*").alias("n"), F.sum(right).alias("hit"))
    support = points.groupBy("label").agg(F.sum("hit").alias("support")).where("support > 0")
    run = sum_before(points, ["label"], "key", "n").withColumn("seen", F.col("before") + F.col("n")).drop("before")
    run = sum_before(run, ["label"], "key", "hit").withColumn("hits", F.col("before") + F.col("hit")).join(support, "label")
    at = run.select("label", (F.col("hits") / F.col("support")).alias("r"), (F.col("hits") / F.col("seen")).alias("v"))
    # Of points of one recall the surest counts: it has the greatest precision.
    best = at.groupBy("label", "r").agg(F.max("v").alias("v"))
    cell = F.ceil(F.col("r") * grid - 1e-9).cast("int")
    ends = best.groupBy("label", cell.alias("cell")).agg(F.min(F.struct("r", "v")).alias("first"), F.max(F.struct("r", "v")).alias("last"))
    cells = ends.select("label").distinct().select("label", F.explode(F.sequence(F.lit(0), F.lit(grid))).alias("cell"))
    up, down = W.partitionBy("label").orderBy("cell"), W.partitionBy("label").orderBy(F.desc("cell"))
    filled = cells.join(ends, ["label", "cell"], "left").select(
        "label", "cell",
        # At recall cell / grid: the last point of this cell and those before, the first of the cells after.
        F.last("last", ignorenulls=True).over(up).alias("a"), F.last("first", ignorenulls=True).over(down.rowsBetween(W.unboundedPreceding, -1)).alias("b"),
    )
    g = F.col("cell") / F.lit(float(grid))
    part = F.try_divide(g - F.col("a.r"), F.col("b.r") - F.col("a.r"))
    v = F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull(), F.col("a.v")).otherwise(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * part)
    return filled.withColumn("v", v).groupBy("cell").agg(F.avg("v").alias("precision"), F.count("v").alias("n_labels")).select((F.col("cell") / F.lit(float(grid))).alias("recall"), "precision", "n_labels")


def quantile_bins(preds: DataFrame, bins: int = 100) -> DataFrame:
    """Predictions in bins between the quantiles of confidence, from the surest down: (bin, n, accuracy, accuracy_down, coverage).

    Equal quantiles are one, so there are fewer bins where many predictions are equally sure.
    """
    edges = group_quantiles(preds, [], "confidence", {f"e{i}": i / bins for i in range(1, bins)})
    edges = edges.select(F.array_sort(F.array_distinct(F.array(*edges.columns))).alias("edges"))
    right = (F.col("y_true") == F.col("y_pred")).cast("long")
    b = F.size(F.filter("edges", lambda e: e <= F.col("confidence")))
    counts = preds.crossJoin(F.broadcast(edges)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum(right).alias("hit"))
    down = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    run = counts.select("bin", "n", "hit", F.sum("hit").over(down).alias("hits"), F.sum("n").over(down).alias("seen"), F.sum("n").over(W.partitionBy()).alias("total"))
    return run.select("bin", "n", (F.col("hit") / F.col("n")).alias("accuracy"), (F.col("hits") / F.col("seen")).alias("accuracy_down"), (F.col("seen") / F.col("total")).alias("coverage"))


def top_k(probs: DataFrame, ks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Share of rows of each subset whose true label is among the k likeliest; of equally likely labels the later name is first.

    Null for rows of labels that the model doesn't know, which then don't count; a row's rank is the
    number of its labels that stand above the true one.
    """
    mine = F.max(F.when(F.col("label") == F.col("y_true"), F.struct("p", "label")))
    above = probs.groupBy("id", "y_true").agg(mine.alias("mine"), F.collect_list(F.struct("p", "label")).alias("every"))
    ranked = above.where("mine is not null").select("y_true", F.size(F.filter("every", lambda e: e > F.col("mine"))).alias("above"))
    return (
        ranked.groupBy("y_true", "above").agg(F.count("*").alias("n"))
        .select(F.explode(subsets_of(F.col("y_true"))).alias("subset"), "above", "n")
        .groupBy("subset")
        .agg(F.sum("n").alias("n"), *[(F.sum(F.when(F.col("above") < k, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"top{k}") for k in ks])
    )


def mixture_shares(preds: DataFrame, components: dict[str, list[str]], top: int = 5) -> DataFrame:
    """What the records of each mixture were taken for: (mixture, label, n, share, place, in_set, expected).

    The top labels of each mixture, and its components whether predicted or not; expected is 1 / k for
    one of k components and 0 for others. Mixtures without records have no rows.
    """
    sets = F.create_map(*[x for m, c in components.items() for x in (F.lit(m), F.array(*[F.lit(v) for v in c]))])
    rows = preds.where(F.col("y_true").isin(list(components))).groupBy(F.col("y_true").alias("mixture"), F.col("y_pred").alias("label")).agg(F.count("*").alias("n"))
    all_labels = rows.select("mixture").distinct().select("mixture", F.explode(F.try_element_at(sets, F.col("mixture"))).alias("label"), F.lit(0).cast("long").alias("n"))
    rows = rows.unionByName(all_labels).groupBy("mixture", "label").agg(F.sum("n").alias("n"))
    group = W.partitionBy("mixture")
    inside = F.array_contains(F.try_element_at(sets, F.col("mixture")), F.col("label"))
    placed = rows.select("mixture", "label", "n", (F.col("n") / F.sum("n").over(group)).alias("share"), F.row_number().over(group.orderBy(F.desc("n"), "label")).alias("place"), inside.alias("in_set"))
    expected = F.when(F.col("in_set"), 1.0 / F.size(F.try_element_at(sets, F.col("mixture")))).otherwise(0.0)
    return placed.where((F.col("place") <= top) | F.col("in_set")).withColumn("expected", expected)


def mixture_scores(preds: DataFrame, components: dict[str, list[str]]) -> DataFrame:
    """Per mixture the share of its records that were taken for one of its components, and per component the share of
    what was taken for it, in all mixtures, that is right: (kind, name, n, score), with one row of kind overall."""
    pairs = F.create_map(*[x for m, c in components.items() for x in (F.lit(m), F.array(*[F.lit(v) for v in c]))])
    ok = F.array_contains(F.try_element_at(pairs, F.col("y_true")), F.col("y_pred")).cast("long")
    cells = preds.where(F.col("y_true").isin(list(components))).groupBy("y_true", "y_pred").agg(F.count("*").alias("n"), F.sum(ok).alias("hit"))
    score = (F.sum("hit") / F.sum("n")).alias("score")
    named = {v for c in components.values() for v in c}
    rows = cells.groupBy(F.col("y_true").alias("name")).agg(F.sum("n").alias("n"), score).select(F.lit("recall").alias("kind"), "*")
    cols = cells.where(F.col("y_pred").isin(sorted(named))).groupBy(F.col("y_pred").alias("name")).agg(F.sum("n").alias("n"), score).select(F.lit("precision").alias("kind"), "*")
    whole = cells.agg(F.sum("n").alias("n"), score).where("n is not null").select(F.lit("overall").alias("kind"), F.lit("all").alias("name"), "n", "score")
    return rows.unionByName(cols).unionByName(whole)


def flat_metrics(frame: DataFrame, ids: list[str]) -> DataFrame:
    """The numeric columns of a frame as rows (ids…, metric, value), finite ones only."""
    numbers = [c for c, t in frame.dtypes if c not in ids and t in ("double", "float", "int", "bigint")]
    long = frame.select(*ids, *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(ids, numbers, "metric", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def repeated_runs(metrics: DataFrame, select_by: str) -> DataFrame:
    """Summary of metrics (run_index, metric, value) over repeated runs: n, mean, sd (0 for one run), median, min, max,
    and the run whose select_by lies nearest to its median; ties go to the first run. Runs are few."""
    every = metrics.groupBy("metric").agg(F.count("*").alias("n_runs"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.median("value").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"))
    chosen = metrics.where(F.col("metric") == select_by)
    middle = chosen.agg(F.median("value").alias("middle"))
    near = chosen.crossJoin(F.broadcast(middle)).agg(F.min(F.struct(F.round(F.abs(F.col("value") - F.col("middle")), 12).alias("far"), "run_index")).alias("best"))
    return every.crossJoin(F.broadcast(near.select(F.col("best.run_index").alias("median_run_index"))))
