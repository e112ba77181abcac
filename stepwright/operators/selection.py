"""Which features to keep: by variance, by correlation with those kept already, by what they say about the class.

Moments, correlations and counts are aggregated by Spark over all rows; the greedy choice, which goes through
the features one after the other, runs on their table of correlations, of one row per pair of features.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import arrays as A
from .ranks import group_quantiles, sum_before
from .stats import anova, long_features

LEAST_VARIANCE, MOST_CORRELATION = 1e-10, 0.95


def filled(frame: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """(ids..., features...) with missing, NaN and infinite values replaced by the feature's median.

    A feature without values is 0 throughout.
    """
    middle = group_quantiles(long_features(frame, [], features), ["feature"], "v", {"m": 0.5})
    one = middle.agg(*[F.coalesce(F.max(F.when(F.col("feature") == c, F.col("m"))), F.lit(0.0)).alias(f"_m_{c}") for c in features])
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return frame.crossJoin(F.broadcast(one)).select(*ids, *[F.when(ok(c), F.col(c).cast("double")).otherwise(F.col(f"_m_{c}")).alias(c) for c in features])


def variances(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, variance, kept): the sample variance, 0 of fewer than two rows, and whether it is above LEAST_VARIANCE."""
    one = rows.agg(*[F.coalesce(F.var_samp(c), F.lit(0.0)).alias(c) for c in features])
    return one.unpivot([], features, "feature", "variance").withColumn("kept", F.col("variance") > LEAST_VARIANCE)


def correlations(rows: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of features, either way; 0 where one of them is constant. rows has no missing values.

    One pass over the rows: Spark adds up the products of all features, a square matrix of their number.
    """
    names = list(features)
    found: list[tuple[str, str, float]] = []
    if len(names) > 1 and len(rows.take(2)) > 1:
        vectors = VectorAssembler(inputCols=names, outputCol="_raw").transform(rows).select("_raw")
        r = np.nan_to_num(Correlation.corr(vectors, "_raw").first()[0].toArray())
        found = [(a, b, float(r[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
    return rows.sparkSession.createDataFrame(found, "a string, b string, r double")


def greedy(order: DataFrame, pairs: DataFrame, most: float = MOST_CORRELATION, take: int | None = None) -> DataFrame:
    """Features in the order of their score, falling, each kept if it correlates by at most `most` with all kept before.

    order is (feature, score), ties by name; pairs as from correlations. Result: (place, feature, score, kept,
    partner, corr_abs), place from 1, partner the kept one that a feature correlates with most, ties to the one
    kept first. With take the choice ends after so many; those behind have no row.
    """
    known = {(r["a"], r["b"]): abs(r["r"]) for r in pairs.collect()}
    ranked = sorted(((r["feature"], r["score"]) for r in order.collect()), key=lambda f: (-(f[1] if f[1] is not None else float("-inf")), f[0]))
    kept: list[str] = []
    rows = []
    for place, (f, score) in enumerate(ranked, 1):
        if take is not None and len(kept) >= take:
            break
        near = max(((known.get((f, k), 0.0), -i) for i, k in enumerate(kept)), default=None)
        partner = None if near is None else kept[-near[1]]
        stays = near is None or near[0] <= most
        rows.append((place, f, score, stays, partner, None if near is None else near[0]))
        if stays:
            kept.append(f)
    return order.sparkSession.createDataFrame(rows, "place int, feature string, score double, kept boolean, partner string, corr_abs double")


def uncorrelated(rows: DataFrame, features: list[str], most: float = MOST_CORRELATION) -> DataFrame:
    """The greedy choice among features that vary, those of the greatest variance first; all if none varies."""
    v = variances(rows, features).collect()
    varying = [r["feature"] for r in v if r["kept"]] or list(features)
    order = rows.sparkSession.createDataFrame([(r["feature"], r["variance"]) for r in v if r["feature"] in varying], "feature string, score double")
    return greedy(order, correlations(rows, varying), most)


def by_anova(rows: DataFrame, features: list[str], take: int = 5, most: float = MOST_CORRELATION) -> DataFrame:
    """The greedy choice of `take` features, those first whose means differ most between classes. rows has class."""
    varying = [r["feature"] for r in variances(rows, features).collect() if r["variance"] > 1e-12]
    if not varying:
        return greedy(rows.sparkSession.createDataFrame([], "feature string, score double"), rows.sparkSession.createDataFrame([], "a string, b string, r double"), most, take)
    f = anova(long_features(rows.where("class is not null"), ["class"], varying)).select("feature", F.round("f", 9).alias("score"))
    return greedy(f, correlations(rows, varying), most, take)


def mutual_information(long: DataFrame, bins: int = 10) -> DataFrame:
    """What each feature tells about the class, in nats: (feature, n, mi), from counts in bins of equal size.

    A value's bin is that of the rows below it, so equal values share a bin. All rows count; long is
    (feature, class, v), rows without a class are left out.
    """
    long = long.where("class is not null")
    values = long.groupBy("feature", "v").agg(F.count("*").alias("c"))
    total = long.groupBy("feature").agg(F.count("*").alias("n"))
    placed = sum_before(values, ["feature"], "v", "c").join(total, "feature").select("feature", "v", F.floor(F.col("before") * bins / F.col("n")).cast("int").alias("bin"))
    cells = long.groupBy("feature", "class", "v").agg(F.count("*").alias("c")).join(placed, ["feature", "v"]).groupBy("feature", "class", "bin").agg(F.sum("c").alias("c"))
    by_class, by_bin = cells.groupBy("feature", "class").agg(F.sum("c").alias("nc")), cells.groupBy("feature", "bin").agg(F.sum("c").alias("nb"))
    joined = cells.join(by_class, ["feature", "class"]).join(by_bin, ["feature", "bin"]).join(total, "feature")
    part = F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n").cast("double") / (F.col("nc").cast("double") * F.col("nb")))
    return joined.groupBy("feature").agg(F.max("n").alias("n"), F.greatest(F.sum(part), F.lit(0.0)).alias("mi"))


def combined_scores(mi: DataFrame, gain: DataFrame, weight: float = 0.6) -> DataFrame:
    """(feature, mi, gain, score): both over their greatest, weighted; a feature that either lacks has 0 there."""
    both = mi.select("feature", "mi").join(gain, "feature", "full").select("feature", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mi", "gain")])
    top = both.agg(F.max("mi").alias("_mi"), F.max("gain").alias("_gain"))
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.col(f"_{c}")), F.lit(0.0))
    return both.crossJoin(F.broadcast(top)).select("feature", "mi", "gain", (weight * part("mi") + (1 - weight) * part("gain")).alias("score"))


def rotated(rows: DataFrame, ids: str, features: list[str], seed: int = 0, block: int = 100_000) -> DataFrame:
    """rows with, beside each feature c, r_c: the feature's value in another row.

    Rows fall into blocks of about `block` by a hash and take the features of the next one in a second hash's
    order, the last one those of the first: every value is used once, and no task holds more than a block.
    """
    n = max(1, -(-rows.count() // block))
    placed = rows.withColumn("_b", F.pmod(F.xxhash64(ids, F.lit(seed)), F.lit(n))).withColumn("_f", F.struct(*features))
    order = W.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + 1), ids), ids)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    other = F.coalesce(F.lead("_f").over(order), F.first("_f").over(whole))
    return placed.withColumn("_o", other).select(*rows.columns, *[F.col(f"_o.{c}").alias(f"r_{c}") for c in features])


def permuted(rows: DataFrame, ids: str, features: list[str], seed: int = 0) -> DataFrame:
    """Every row once as it is and once per feature with that feature's value from another row, told apart by `changed`."""
    both = rotated(rows, ids, features, seed)
    swapped = [F.struct(F.lit(f).alias("changed"), *[(F.col(f"r_{c}") if c == f else F.col(c)).alias(c) for c in features]) for f in ["", *features]]
    kept = [c for c in rows.columns if c not in features]
    return both.select(*kept, F.explode(F.array(*swapped)).alias("_s")).select(*kept, "_s.*")


def occluded(reads: DataFrame, window: int = 15, step: int = 2) -> DataFrame:
    """Every read once as it is (start null) and once per window, whose samples are replaced by the read's median.

    reads is (read_id, x); windows begin at every step-th sample and the last ones end with the read. Result:
    (read_id, start, center, x). A read of n samples has n / step + 1 rows: give the reads that are to be looked at.
    """
    n = F.size("x")
    starts = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda s: s.cast("int"))
    base = reads.where(n > 0).withColumn("_m", A.a_median(F.col("x"))).withColumn("_s", F.explode(F.concat(F.array(F.lit(None).cast("int")), starts)))
    end = F.least(F.col("_s") + window, n)
    hidden = F.transform("x", lambda v, i: F.when((i >= F.col("_s")) & (i < end), F.col("_m")).otherwise(v))
    return base.select("read_id", F.col("_s").alias("start"), ((F.col("_s") + end) / 2.0).alias("center"), F.when(F.col("_s").isNull(), F.col("x")).otherwise(hidden).alias("x"))


def scaled_importance(drops: DataFrame, by: str, highlight: float = 0.5) -> DataFrame:
    """drops with their size over the read's and over the group's greatest, and whether the read's part is at least highlight.

    drops is (read_id, by, center, drop); where the greatest is 0 the parts are 0.
    """
    size = F.abs("drop")
    local = drops.groupBy("read_id").agg(F.max(size).alias("_l"))
    whole = drops.groupBy(by).agg(F.max(size).alias("_g"))
    part = lambda top: F.coalesce(F.try_divide(size, F.col(top)), F.lit(0.0))
    return drops.join(local, "read_id").join(whole, by).select(*drops.columns, part("_l").alias("local"), part("_g").alias("of_group"), (part("_l") >= highlight).alias("highlighted"))
