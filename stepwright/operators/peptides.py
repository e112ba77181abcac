"""Tables of peptides: how well each is told apart, or where its features lie, against the properties of its residues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import physchem as P
from .evaluation_sets import label_scores
from .ranks import group_quantiles
from .stats import benjamini_hochberg, long_features, rank_correlation_p, spearman

METRICS = ["precision", "recall", "f1", "support"]
PROPERTIES = ["length", "mean_hydropathy", "mass", "net_charge", "aromatic_share"]


def r6(c):
    """Six decimals; the shift keeps exact halves on one side in every engine."""
    return F.round(c + F.lit(1e-8), 6)


def properties(classes: DataFrame, ph: float = 7.0) -> DataFrame:
    """(class, PROPERTIES...) of the classes whose name spells residues, each once; to six decimals, so equal ones tie."""
    c = F.col("class")
    some = classes.select("class").where(c.isNotNull()).distinct().where(P.length(c) > 0)
    return some.select("class", P.length(c).cast("double").alias("length"), r6(P.mean_hydropathy(c)).alias("mean_hydropathy"), r6(P.mass(c)).alias("mass"), r6(P.net_charge(c, ph)).alias("net_charge"), r6(P.share_of(c, "FWY")).alias("aromatic_share"))


def scenario_metrics(preds: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class in every scenario. preds is (scenario, y_true, y_pred)."""
    cells = preds.where("y_true is not null").groupBy(F.col("scenario").alias("subset"), "y_true", "y_pred").agg(F.count("*").alias("n"))
    return label_scores(cells).select(F.col("subset").alias("scenario"), F.col("label").alias("class"), "precision", "recall", "f1", F.col("support").cast("double").alias("support"))


def median_metrics(metrics: DataFrame) -> DataFrame:
    """(class, METRICS...): the median of each metric over the scenarios."""
    long = metrics.unpivot(["class"], METRICS, "metric", "v")
    middle = group_quantiles(long, ["class", "metric"], "v", {"m": 0.5})
    return middle.groupBy("class").agg(*[F.max(F.when(F.col("metric") == m, F.col("m"))).alias(m) for m in METRICS])


def performance_table(metrics: DataFrame, counts: DataFrame) -> DataFrame:
    """Each class's median metrics with its number of records, log10(n + 1) of it and its properties.

    counts is (class, total_count); classes without records have 0, classes that spell no residues null properties.
    """
    joined = median_metrics(metrics).join(counts, "class", "left").withColumn("total_count", F.coalesce("total_count", F.lit(0)))
    return joined.withColumn("log_count", F.log10(F.col("total_count") + 1.0)).join(properties(joined), "class", "left")


def feature_medians(frame: DataFrame, features: list[str]) -> DataFrame:
    """(class, features...): the median of every feature over all reads of a class, with the class's properties."""
    middle = group_quantiles(long_features(frame.where("class is not null"), ["class"], features), ["class", "feature"], "v", {"m": 0.5})
    wide = middle.groupBy("class").agg(*[F.max(F.when(F.col("feature") == f, F.col("m"))).alias(f) for f in features])
    return wide.join(properties(wide), "class", "left")


def correlation_table(table: DataFrame, left: list[str], right: list[str], alpha: float = 0.05) -> DataFrame:
    """Rank correlations of left with right columns over the classes: (a, b, n, rho, p, passed).

    Pairs with fewer than three classes, or a constant side, have no rho and no p; passed tells which stand
    after the correction for the number of tests.
    """
    rho = spearman(table, "class", [(a, b) for a in left for b in right])
    return benjamini_hochberg(rho.withColumn("p", rank_correlation_p(F.col("rho"), F.col("n"))).withColumn("p", F.when(F.col("rho").isNotNull(), r6(F.col("p")))), "p", alpha)
