"""Queries of segmentation, smoothing, distances, peptide properties and models; SQL where it can say it."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import distance as D
from ..operators import evaluation as E
from ..operators import physchem as P
from ..operators.manifest import clean_entries
from ..runtime import materialize, ship, table
from ..sources.signals import reads_once
from .evaluation import FEATURES, features
from .reach import r6
from .signals import _long, _rounded


def _reads(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return reads_once(table(spark, d, "peptide_signals"))


def smooth_bessel(spark, d):
    return _long(_reads(spark, d), K.low_pass(F.col("x"), 0.2, "bessel"))


def smooth_butterworth(spark, d):
    return _long(_reads(spark, d), K.low_pass(F.col("x"), 0.1, "butterworth"))


def resample_polyphase(spark, d):
    return _long(_reads(spark, d), K.resample_polyphase(F.col("x"), 24))


def resample_fourier(spark, d):
    return _long(_reads(spark, d), K.resample_fourier(F.col("x"), 24))


def segments_cut(spark, d):
    """The signals cut into steps, one row per step."""
    cut = _reads(spark, d).select("read_id", F.explode(K.segments(F.col("x"), 8.0, 4)).alias("g"))
    return _rounded(cut.select("read_id", "g.s", "g.e", "g.mean", "g.std", "g.len"))


def segments_features(spark, d):
    """Features of the steps of each signal: number, lengths, means, heights and spread."""
    cut = _reads(spark, d).select("read_id", K.segments(F.col("x"), 8.0, 4).alias("g"))
    lens, means = F.transform("g", lambda s: s["len"].cast("double")), F.transform("g", lambda s: s["mean"])
    st = cut.where("size(g) > 0").select("read_id", F.size("g").alias("n_steps"), lens.alias("lens"), means.alias("means"))
    from ..functions import arrays as A

    h = F.transform(A.a_diff(F.col("means")), lambda v: F.abs(v))
    out = st.select("read_id", "n_steps", A.a_mean(F.col("lens")).alias("mean_step_len"), F.array_min("lens").alias("min_step_len"), F.array_max("lens").alias("max_step_len"), A.a_mean(F.col("means")).alias("mean_level"), A.a_mean(h).alias("mean_step_height"), F.array_max(h).alias("max_step_height"))
    return _rounded(out)


def distance_to_template(spark, d):
    return _rounded(D.to_template(_reads(spark, d)))


def distance_thresholds(spark, d):
    return _rounded(D.thresholds(D.to_template(_reads(spark, d))))


def distance_outliers(spark, d):
    dist = materialize(D.to_template(_reads(spark, d)), "distances")
    return _rounded(D.outliers(dist, D.thresholds(dist)))


def distance_whisker_outliers(spark, d):
    dist = materialize(D.to_template(_reads(spark, d)), "distances")
    return _rounded(D.whisker_outliers(dist))


def physchem_properties(spark, d):
    """Properties of the residues that the class names spell, with the entries of each class."""
    classes = clean_entries(table(spark, d, "templaterc")).where("class is not null").groupBy("class").agg(F.count("*").alias("n_entries"))
    c = F.col("class")
    return classes.select(
        "class", "n_entries", P.length(c).alias("length"), r6(P.mean_hydropathy(c)).alias("mean_hydropathy"), r6(P.mass(c)).alias("mass"), P.count_of(c, "FWY").alias("n_aromatic"), P.count_of(c, "KRH").alias("n_positive"), P.count_of(c, "DE").alias("n_negative"), r6(P.net_charge(c)).alias("net_charge")
    )


def physchem_isoelectric(spark, d):
    classes = clean_entries(table(spark, d, "templaterc")).where("class is not null").select("class").distinct()
    return classes.select("class", P.isoelectric_point(F.col("class")).alias("isoelectric_point"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).where("class is not null")


def _stages():
    filled = [f"{c}_in" for c in FEATURES]
    return [Imputer(strategy="median", inputCols=FEATURES, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw")]


def _held_out(rows: DataFrame, seed: int) -> tuple[DataFrame, list[str]]:
    """The held-out fifth of rows with a forest's probabilities, and the labels they stand for; rows of classes that only it has stay."""
    part = F.pmod(F.xxhash64("read_id", F.lit(seed)), F.lit(10))
    train, test = rows.where(part > 1), rows.where(part <= 1)
    forest = RandomForestClassifier(featuresCol="raw", labelCol="label", numTrees=20, maxDepth=6, seed=seed)
    label = StringIndexer(inputCol="class", outputCol="label", stringOrderType="alphabetAsc").fit(train)
    fitted = Pipeline(stages=[*_stages(), forest]).fit(label.transform(train))
    return fitted.transform(test), label.labels


def model_forest_predictions(spark, d, seed: int = 1):
    """Held-out predictions of a random forest on the features, with the confidence of each."""
    out, labels = _held_out(_vectors(spark, d), seed)
    names = F.array(*[F.lit(v) for v in labels])
    return out.select(F.col("read_id").alias("id"), F.col("class").alias("y_true"), F.get(names, F.col("prediction").cast("int")).alias("y_pred"), F.array_max(vector_to_array("probability")).alias("confidence"))


def model_forest_metrics(spark, d):
    preds = materialize(model_forest_predictions(spark, d), "predictions")
    cells = E.confusion(preds)
    return _rounded(E.summary(E.per_class(cells), cells))


def model_forest_top_k(spark, d, seed: int = 1):
    """How often the true class of held-out rows is among the first 1, 2 and 3 of a forest fitted to the others."""
    out, labels = _held_out(_vectors(spark, d), seed)
    names = F.array(*[F.lit(v) for v in labels])
    probs = F.transform(vector_to_array("probability"), lambda p, i: F.struct((-p).alias("p"), i.alias("i")))
    ranked = F.transform(F.slice(F.array_sort(probs), 1, 3), lambda s: F.get(names, s["i"]))
    return E.top_k_accuracy(out.select(F.col("class").alias("y_true"), ranked.alias("ranked")))


def model_kmeans(spark, d, k: int = 8):
    """K-means of the standardised features: the size and centre of each cluster."""
    rows = _vectors(spark, d)
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)
    means = KMeans(featuresCol="scaled", predictionCol="cluster", k=k, seed=1, maxIter=20)
    out = Pipeline(stages=[*_stages(), scaled, means]).fit(rows).transform(rows)
    return _rounded(out.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(f"{c}_in").alias(c) for c in FEATURES]))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith(("smooth_", "resample_", "segments_", "distance_", "physchem_", "model_")) and callable(f)}

_LETTERS = "".join(P.HYDROPATHY)


def _n(letters: str) -> str:
    return f"len(regexp_replace(upper(regexp_replace(class, '[^A-Za-z]', '', 'g')), '[^{letters}]', '', 'g'))"


def _case(values: dict) -> str:
    return "case r " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"


_SEQ = f"string_split(regexp_replace(upper(regexp_replace(class, '[^A-Za-z]', '', 'g')), '[^{_LETTERS}]', '', 'g'), '')"
_PLUS = " + ".join(f"{_n(k)} / {1 + 10 ** (7.0 - pk)!r}::double" for k, pk in P.BASIC.items()) + f" + {1 / (1 + 10 ** (7.0 - P.END_AMINO))!r}::double"
_MINUS = " + ".join(f"{_n(k)} / {1 + 10 ** (pk - 7.0)!r}::double" for k, pk in P.ACIDIC.items()) + f" + {1 / (1 + 10 ** (P.END_ACID - 7.0))!r}::double"

SQL = {
    "physchem_properties": f"""select class, count(*) as n_entries, cast({_n(_LETTERS)} as integer) as length,
      round(list_sum(list_transform({_SEQ}, lambda r: cast({_case(P.HYDROPATHY)} as double))) / nullif({_n(_LETTERS)}, 0) + 1e-8, 6) as mean_hydropathy,
      round(coalesce(list_sum(list_transform({_SEQ}, lambda r: cast({_case(P.MASS)} as double))), 0) + 1e-8, 6) as mass,
      cast({_n('FWY')} as integer) as n_aromatic, cast({_n('KRH')} as integer) as n_positive, cast({_n('DE')} as integer) as n_negative,
      round(case when {_n(_LETTERS)} > 0 then ({_PLUS}) - ({_MINUS}) end + 1e-8, 6) as net_charge
      from templaterc where class is not null group by class""",
}
