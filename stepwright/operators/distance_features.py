"""Features of reads from their distances to the classes' templates, and distances blended from two kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .ranks import group_quantiles

TINY = 1e-12
NAMES = (
    "d_min", "d_second", "d_min_ratio", "d_min_margin", "d_max", "d_mean", "d_median", "d_std", "d_mad", "d_iqr", "d_p25", "d_p75", "d_p90", "d_p99", "d_skew", "d_kurt",
    "d_count_near", "d_share_near", "d_mean_z", "d_max_z", "d_min_z", "d_softmax_entropy", "d_softmax_max", "d_rbf_mean", "d_rbf_max",
)


def from_map(to_all: DataFrame) -> DataFrame:
    """(read_id, class, names, ds) from (read_id, class, distances), a map by class; without the classes that have no distance."""
    known = F.array_sort(F.filter(F.map_entries("distances"), lambda e: e["value"].isNotNull()))
    return to_all.select("read_id", "class", known.alias("_k")).select("read_id", "class", F.transform("_k", lambda e: e["key"]).alias("names"), F.transform("_k", lambda e: e["value"]).alias("ds"))


def straight(reads: DataFrame, templates: DataFrame, length: int) -> DataFrame:
    """Every read's straight distance to each of the templates (class, template), of `length` samples as the read is brought to.

    Templates are one short series per class: one row, which is broadcast. Result as from_map gives it.
    """
    one = templates.agg(F.array_sort(F.collect_list(F.struct("class", "template"))).alias("_t"))
    y = A.resample_lerp(F.col("x"), length)
    met = reads.where("size(x) > 0").select("read_id", "class", y.alias("_y")).crossJoin(F.broadcast(one))
    far = F.transform("_t", lambda t: F.sqrt(F.aggregate(F.zip_with("_y", t["template"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)))
    return met.select("read_id", "class", F.transform("_t", lambda t: t["class"]).alias("names"), far.alias("ds"))


def features(rows: DataFrame) -> DataFrame:
    """(read_id, class, nearest, NAMES...) of (read_id, class, names, ds): order, spread, shape and nearness of a read's distances.

    Columns of the same name are first scaled by their median and absolute deviation over all reads for the z features;
    softmax and kernel take their width from the median of the reads' medians. Skewness needs three and kurtosis four
    distances that differ; a second one is null where there is one only. Reads without distances are left out.
    """
    st = rows.where("size(ds) > 0").withColumns({"_s": F.array_sort("ds"), "_n": F.size("ds"), "_mean": A.a_mean(F.col("ds"))})
    st = st.withColumns({"_med": A.q_lerp(F.col("_s"), 0.5), "_std": A.a_std(F.col("ds"), F.col("_mean"))})
    long = st.select(F.explode(F.arrays_zip("names", "ds")).alias("_c")).select(F.col("_c.names").alias("name"), F.col("_c.ds").alias("v"))
    middle = group_quantiles(long, ["name"], "v", {"m": 0.5})
    spread = group_quantiles(long.join(F.broadcast(middle), "name").select("name", F.abs(F.col("v") - F.col("m")).alias("v")), ["name"], "v", {"k": 0.5})
    columns = middle.join(spread, "name").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("m", (F.col("k") + TINY).alias("k"))))).alias("_cols"))
    width = group_quantiles(st.select("_med"), [], "_med", {"w": 0.5}).select((F.col("w") + TINY).alias("_w"))
    st = st.crossJoin(F.broadcast(columns)).crossJoin(F.broadcast(width)).withColumns({
        "_z": F.zip_with("names", "ds", lambda k, d: (d - F.col("_cols")[k]["m"]) / F.col("_cols")[k]["k"]),
        "_e": F.transform("ds", lambda d: F.exp(-d / (F.col("_w") * F.col("_w")))),
        "_g": F.transform("ds", lambda d: F.exp(-d * d / (F.col("_w") * F.col("_w")))),
    }).withColumn("_se", A.a_sum(F.col("_e")) + TINY).withColumn("_p", F.transform("_e", lambda e: e / F.col("_se")))
    s, n, mean = F.col("_s"), F.col("_n").cast("double"), F.col("_mean")
    power = lambda k: F.aggregate("ds", F.lit(0.0), lambda a, d: a + F.pow(d - mean, F.lit(float(k)))) / n
    varies = F.col("_std") > 1e-9
    g1 = power(3) / F.pow("_std", F.lit(3.0))
    g2 = power(4) / F.pow("_std", F.lit(4.0)) - 3
    near = F.size(F.filter("ds", lambda d: d <= F.col("_med") * 1.5))
    least, second = F.get(s, F.lit(0)), F.get(s, F.lit(1))
    p25, p75 = A.q_lerp(s, 0.25), A.q_lerp(s, 0.75)
    values = [
        least, second, least / (second + TINY), second - least, F.array_max("ds"), mean, F.col("_med"), F.col("_std"), A.a_mad(F.col("ds"), F.col("_med")), p75 - p25, p25, p75, A.q_lerp(s, 0.9), A.q_lerp(s, 0.99),
        F.when(varies & (n > 2), g1 * F.sqrt(n * (n - 1)) / (n - 2)), F.when(varies & (n > 3), ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))),
        near, near / n, A.a_mean(F.col("_z")), F.array_max("_z"), F.array_min("_z"),
        -F.aggregate("_p", F.lit(0.0), lambda a, p: a + p * F.log(p + TINY)), F.array_max("_p"), A.a_mean(F.col("_g")), F.array_max("_g"),
    ]
    nearest = F.get(F.col("names"), (F.array_position("ds", least) - 1).cast("int"))
    return st.select("read_id", "class", nearest.alias("nearest"), *[v.alias(k) for k, v in zip(NAMES, values)])


def blended(pairs: DataFrame, vectors: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Distances of pairs of a sample blended with those of the reads' feature vectors, both brought to 0..1: pairs with
    feature_distance and combined.

    pairs is (id_a, class_a, id_b, class_b, distance), vectors (read_id, v), an array of scaled features. Each kind is
    scaled by its own range over the pairs, and is 0 where that is empty; pairs without both vectors are left out.
    """
    far = F.sqrt(F.aggregate(F.zip_with("_va", "_vb", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    a = vectors.select(F.col("read_id").alias("id_a"), F.col("v").alias("_va"))
    b = vectors.select(F.col("read_id").alias("id_b"), F.col("v").alias("_vb"))
    both = pairs.join(a, "id_a").join(b, "id_b").withColumn("feature_distance", far)
    ends = both.agg(*[f(c).alias(f"_{k}_{c}") for c in ("distance", "feature_distance") for k, f in (("lo", F.min), ("hi", F.max))])
    part = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0))
    return both.crossJoin(F.broadcast(ends)).select(*pairs.columns, "feature_distance", (alpha * part("distance") + (1 - alpha) * part("feature_distance")).alias("combined"))


def standardised(rows: DataFrame, features: list[str]) -> DataFrame:
    """(read_id, v): the features less their mean over their deviation, as an array; constant ones are 0. rows has no missing values."""
    one = rows.agg(*[f(c).alias(f"_{k}_{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    each = [F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in features]
    return rows.crossJoin(F.broadcast(one)).select("read_id", F.array(*each).alias("v"))
