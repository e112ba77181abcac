"""Statistics of features against classes and against each other, from sums that Spark aggregates in two steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .ranks import average_ranks, group_quantiles, join_groups, sum_before


def long_features(frame: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """One row per id and feature with a finite value: (ids..., feature, v)."""
    long = frame.unpivot(ids, features, "feature", "v")
    return long.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))


def class_summary(long: DataFrame) -> DataFrame:
    """Per class and feature: n, median, mean, sample deviation (null for one value) and extreme quantiles."""
    by = ["class", "feature"]
    moments = long.groupBy(*by).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    places = group_quantiles(long, by, "v", {"median": 0.5, "q90": 0.9, "q99": 0.99})
    return join_groups(moments, places, by)


def anova(long: DataFrame) -> DataFrame:
    """F of a one-way analysis of variance per feature, from each class's n, mean and squares about it.

    Classes without values don't count; null with fewer than two classes or no freedom left within.
    """
    per = long.groupBy("feature", "class").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("vp"))
    grand = per.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    sums = per.join(grand, "feature").groupBy("feature").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"), F.sum(F.col("n") * F.col("vp")).alias("within")
    )
    f = F.try_divide(F.try_divide(F.col("between"), F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k")))
    return sums.select("feature", "k", "n", f.alias("f"))


def spearman(frame: DataFrame, id_col: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rank correlation of pairs of columns over the rows where both are finite: (a, b, n, rho).

    Null with fewer than three rows or a constant column.
    """
    cells = []
    for a, b in pairs:
        ok = F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)
        cells.append(F.when(ok, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))))
    long = frame.select(F.col(id_col).alias("id"), F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select("id", "c.*")
    long = materialize(long, "pairs")
    both = average_ranks(average_ranks(long, ["a", "b"], "x", "rx"), ["a", "b"], "y", "ry")
    sums = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_pop("rx", "ry").alias("cov"), F.var_pop("rx").alias("vx"), F.var_pop("ry").alias("vy"))
    rho = F.when((F.col("n") >= 3) & (F.col("vx") > 0) & (F.col("vy") > 0), F.col("cov") / F.sqrt(F.col("vx") * F.col("vy")))
    return sums.select("a", "b", "n", rho.alias("rho"))


def mann_whitney(long: DataFrame, reference: str, least: int = 5) -> DataFrame:
    """U of each class against a reference class per feature, with its normal score (ties and continuity corrected).

    Classes with fewer than `least` values on either side have no row. Ranks are those of the two
    classes together, computed from counts of different values.
    """
    long = materialize(long.where("class is not null"), "values")
    mine = long.where(F.col("class") == reference).select("feature", "v")
    others = long.where((F.col("class") != reference) & F.col("class").isNotNull()).select("feature", "class", "v")
    a = mine.groupBy("feature", "v").agg(F.count("*").alias("ca"))
    b = others.groupBy("feature", "class", "v").agg(F.count("*").alias("cb"))
    classes = b.select("feature", "class").distinct()
    counts = (
        a.join(classes, "feature").select("feature", "class", "v", "ca", F.lit(0).cast("bigint").alias("cb")).unionByName(b.select("feature", "class", "v", F.lit(0).cast("bigint").alias("ca"), "cb"))
        .groupBy("feature", "class", "v")
        .agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    )
    t = F.col("ca") + F.col("cb")
    run = sum_before(counts.withColumn("t", t), ["feature", "class"], "v", "t")
    ranked = run.withColumn("rank", F.col("before") + (t + 1) / 2).withColumn("tie", (t * t * t - t).cast("double"))
    s = ranked.groupBy("feature", "class").agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"), F.sum(F.col("ca") * F.col("rank")).alias("ra"), F.sum("tie").alias("ties")).where((F.col("na") >= least) & (F.col("nb") >= least))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    n = na + nb
    u = F.col("ra") - na * (na + 1) / 2
    sigma = F.sqrt(na * nb / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - na * nb / 2) - 0.5, F.lit(0.0)), sigma)
    return s.select("feature", "class", "na", "nb", u.alias("u"), z.alias("z"))


def two_sided(z):
    """The chance of a normal score at least as far from 0, to seven decimals, by a published polynomial."""
    # Coefficients of the polynomial for the complementary error function.
    c = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = F.lit(0.0)
    for k in reversed(c):
        poly = (poly + k) * t
    return F.least(F.exp(-x * x) * poly, F.lit(1.0))


def rank_correlation_p(rho, n):
    """Two-sided chance of a correlation at least as strong among n rows without any, by Student's t with n - 2 degrees.

    The finite series for whole degrees of freedom in the angle whose sine is rho, one term per two rows: meant for
    tables of groups, not of records. Null with fewer than three rows.
    """
    v, r = n.cast("int") - 2, F.least(F.abs(rho), F.lit(1.0))
    cos2 = 1 - r * r
    odd = v % 2 == 1
    terms = F.sequence(F.lit(1), F.greatest(F.floor((v - F.when(odd, 1).otherwise(0)) / 2).cast("int"), F.lit(1)))
    first = F.when(odd & (v == 1), 0.0).when(odd, F.sqrt(cos2)).otherwise(1.0)
    start = F.struct(first.alias("t"), first.alias("s"))
    shift = F.when(odd, 1).otherwise(0)
    # every term is the one before times (2k - 1 + shift) / (2k + shift) cos^2
    step = lambda a, k: F.struct((a["t"] * (2 * k - 1 + shift) / (2 * k + shift) * cos2).alias("t"), (a["s"] + F.when(k < F.size(terms), a["t"] * (2 * k - 1 + shift) / (2 * k + shift) * cos2).otherwise(0.0)).alias("s"))
    total = F.aggregate(terms, start, step, lambda a: a["s"])
    inside = F.when(odd, (F.asin(r) + r * total) * (2 / math.pi)).otherwise(r * total)
    return F.when((v >= 1) & rho.isNotNull(), F.greatest(1 - inside, F.lit(0.0)))


def benjamini_hochberg(tests: DataFrame, p_col: str, alpha: float = 0.05) -> DataFrame:
    """tests with passed: whether p is at most the greatest p that lies below its rank's part of alpha."""
    known = tests.where(F.col(p_col).isNotNull())
    n = known.agg(F.count("*").alias("n_tests"))
    counts = known.groupBy(F.col(p_col).alias("p")).agg(F.count("*").alias("c"))
    rank = F.col("before") + F.col("c")
    limit = sum_before(counts, [], "p", "c").crossJoin(F.broadcast(n)).where(F.col("p") <= rank / F.col("n_tests") * alpha).agg(F.max("p").alias("limit"))
    return tests.crossJoin(F.broadcast(limit)).withColumn("passed", F.coalesce(F.col(p_col) <= F.col("limit"), F.lit(False))).drop("limit")


def least_squares(frame: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """The line of y on x per group with its R squared; null for fewer than two different x."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    rows = frame.where(ok)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.avg(x).alias("mx"), F.avg(y).alias("my")).select(
        by, "n", F.when(F.col("vx") > 0, F.col("c") / F.col("vx")).alias("slope"), F.when(F.col("vx") > 0, F.col("my") - F.col("c") / F.col("vx") * F.col("mx")).alias("intercept"),
        F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") * F.col("c") / (F.col("vx") * F.col("vy"))).alias("r2"),
    )
