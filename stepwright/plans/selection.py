"""Queries of feature selection and of what a model looks at, with their SQL."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import features as X
from ..operators import selection as S
from ..operators import stats as T
from ..runtime import materialize, ship
from .evaluation import _F, FEATURES, _r, features
from .signals import _reads, _rounded


def _filled(spark, d):
    return materialize(S.filled(features(spark, d), ["read_id", "class"], FEATURES), "filled")


def select_by_variance(spark, d):
    return _rounded(S.variances(_filled(spark, d), FEATURES))


def select_uncorrelated(spark, d):
    """The features of greatest variance that don't repeat one kept before."""
    return _rounded(S.uncorrelated(_filled(spark, d), FEATURES))


def select_uncorrelated_strictly(spark, d):
    return _rounded(S.uncorrelated(_filled(spark, d), FEATURES, 0.02))


def select_by_anova(spark, d):
    return _rounded(S.by_anova(_filled(spark, d), FEATURES, 4, 0.5))


def select_by_information(spark, d):
    """Mutual information of each feature, in ten bins of equal size, and the class."""
    return _rounded(S.mutual_information(T.long_features(features(spark, d), ["class"], FEATURES)))


def _forest(train: DataFrame, columns: list[str], seed: int = 1):
    """A forest on columns of train, with medians for what is missing, and the labels it knows."""
    label = StringIndexer(inputCol="class", outputCol="label", stringOrderType="alphabetAsc").fit(train)
    names = [f"{c}_in" for c in columns]
    stages = [Imputer(strategy="median", inputCols=columns, outputCols=names), VectorAssembler(inputCols=names, outputCol="raw", handleInvalid="keep"), RandomForestClassifier(featuresCol="raw", labelCol="label", numTrees=20, maxDepth=6, seed=seed)]
    return Pipeline(stages=stages).fit(label.transform(train)), label.labels


def _parts(rows: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Eight tenths to fit and two to judge, by a hash of the read."""
    part = F.pmod(F.xxhash64("read_id", F.lit(seed)), F.lit(10))
    return rows.where(part > 1), rows.where(part <= 1)


def _named(labels: list[str]):
    return F.get(F.array(*[F.lit(v) for v in labels]), F.col("prediction").cast("int"))


def select_by_score(spark, d):
    """Features that vary and don't repeat others, by information (0.6) and a forest's gain (0.4)."""
    rows = materialize(_filled(spark, d).where("class is not null"), "labelled")
    kept = [r["feature"] for r in S.uncorrelated(rows, FEATURES).where("kept").collect()]
    model, _ = _forest(_parts(rows)[0], kept)
    gain = spark.createDataFrame(list(zip(kept, map(float, model.stages[-1].featureImportances.toArray()))), "feature string, gain double")
    return _rounded(S.combined_scores(S.mutual_information(T.long_features(rows, ["class"], kept)), gain))


def select_subset_scores(spark, d):
    """Held-out scores of a forest on all features, on those kept, and on the best few of them."""
    rows = materialize(_filled(spark, d).where("class is not null"), "labelled")
    ranked = [r["feature"] for r in select_by_score(spark, d).orderBy(F.desc("score"), "feature").collect()]
    train, test = _parts(rows)
    sets = {"all": FEATURES, "filtered": ranked, **{f"top_{k}": ranked[:k] for k in (4, 2) if k < len(ranked)}}
    out = None
    for name, columns in sets.items():
        model, labels = _forest(train, columns)
        preds = model.transform(test).select(F.col("read_id").alias("id"), F.col("class").alias("y_true"), _named(labels).alias("y_pred"))
        cells = materialize(E.confusion(preds), "cells")
        one = E.summary(E.per_class(cells), cells).select(F.lit(name).alias("subset"), F.lit(len(columns)).alias("n_features"), "accuracy", "balanced_accuracy", "weighted_f1")
        out = one if out is None else out.unionByName(one)
    return _rounded(out)


def explain_permutation(spark, d):
    """How much accuracy a forest loses on held-out reads if one feature's values are those of other reads."""
    rows = materialize(_filled(spark, d).where("class is not null"), "labelled")
    train, test = _parts(rows)
    model, labels = _forest(train, FEATURES)
    scored = model.transform(S.permuted(test, "read_id", FEATURES)).groupBy("changed").agg(F.avg((_named(labels) == F.col("class")).cast("double")).alias("accuracy"))
    scored = materialize(scored, "scored")
    base = scored.where("changed = ''").select(F.col("accuracy").alias("base"))
    return _rounded(scored.where("changed <> ''").crossJoin(F.broadcast(base)).select(F.col("changed").alias("feature"), "base", "accuracy", (F.col("base") - F.col("accuracy")).alias("importance")))


#: Blocks that the model of the signals uses, and how many reads of each class are looked at.
BLOCKS, LOOKED_AT = ["basic", "slopes"], 2


def explain_occlusion(spark, d):
    """Of the surest reads of each class, how much of the class's probability each window of samples carries."""
    ship(spark)
    reads = materialize(_reads(spark, d).where("class is not null and size(x) > 0").select("read_id", "class", "x"), "reads")
    frame = X.frame(reads, BLOCKS)
    columns = [c for c, t in frame.dtypes if c != "read_id"]
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    rows = materialize(frame.select("read_id", *doubles).join(reads.select("read_id", "class"), "read_id"), "frame")
    train, test = _parts(rows)
    known = train.agg(*[F.count(F.nanvl(c, F.lit(None))).alias(c) for c in columns]).first().asDict()
    model, labels = _forest(train, [c for c in columns if known[c]])
    at = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("class"))
    chance = F.get(vector_to_array("probability"), (at - 1).cast("int"))
    sure = model.transform(test).select(F.col("read_id").alias("id"), F.col("class").alias("y_true"), _named(labels).alias("y_pred"), chance.alias("confidence"))
    chosen = E.surest_examples(sure, LOOKED_AT, True).select(F.col("id").alias("read_id"))
    # a window is one series of its own to the feature blocks
    hidden = materialize(S.occluded(reads.join(chosen, "read_id").select("read_id", "x")).withColumn("key", F.concat_ws("|", F.coalesce(F.col("start").cast("string"), F.lit("")), "read_id")), "occluded")
    parts = X.frame(hidden, BLOCKS, "key").select("key", *doubles).join(hidden.select("key", "read_id", "start", "center"), "key").join(reads.select("read_id", "class"), "read_id")
    scored = materialize(model.transform(parts).select("read_id", "class", "start", "center", chance.alias("p")), "scored")
    base = scored.where("start is null").select("read_id", F.col("p").alias("base"))
    drops = scored.where("start is not null").join(base, "read_id").select("read_id", "class", "start", "center", (F.col("base") - F.col("p")).alias("drop"))
    return _rounded(S.scaled_importance(materialize(drops, "drops"), "class"))


def embed_components(spark, d):
    """The two main components of the standardised features: each read's place, with the sign that makes the largest loading positive."""
    rows = _filled(spark, d)
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PCA(k=2, inputCol="scaled", outputCol="pc")]
    model = Pipeline(stages=stages).fit(rows)
    loadings = model.stages[-1].pc.toArray()
    signs = [1.0 if max(loadings[:, k], key=abs) >= 0 else -1.0 for k in range(2)]
    pc = vector_to_array("pc")
    return _rounded(model.transform(rows).select("read_id", "class", *[(F.get(pc, k) * s).alias(f"pc{k + 1}") for k, s in enumerate(signs)]))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith(("select_", "explain_", "embed_")) and callable(f)}

_FILL = _F + ", fl as (select read_id, class, " + ", ".join(f"case when isfinite({c}) then {c} else (select coalesce(quantile_cont({c}, 0.5) filter (isfinite({c})), 0) from f) end as {c}" for c in FEATURES) + " from f),\n var as (" + " union all ".join(f"select '{c}' as feature, coalesce(var_samp({c}), 0) as variance from fl" for c in FEATURES) + "),\n cor as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, " + (f"abs(coalesce(case when var_pop({a}) > 0 and var_pop({b}) > 0 then corr({a}, {b}) end, 0))" if a != b else "max(1.0)") + " as r from fl" for a in FEATURES for b in FEATURES) + ")"


def _greedy(order: str, most: float, take: int) -> str:
    """The choice as a recursion over the places: kept is the list of names so far, cs a feature's correlations."""
    query = _FILL.replace("with ", "with recursive ", 1)
    near = "list_transform(g.kept, lambda b: o.cs[b])"
    return query + f""", {order}, csm as (select a, map_from_entries(list((b, r))) as cs from cor group by a),
      ord as (select feature, score, row_number() over (order by score desc, feature) as place, cs from scores join csm on csm.a = feature),
      g as (select 0::bigint as place, []::varchar[] as kept, null::varchar as feature, null::double as score, null::boolean as stays, null::varchar as partner, null::double as near
        union all select o.place, case when coalesce(list_max({near}), 0) <= {most} then list_append(g.kept, o.feature) else g.kept end, o.feature, o.score, coalesce(list_max({near}), 0) <= {most},
          g.kept[list_position({near}, list_max({near}))], list_max({near}) from g join ord o on o.place = g.place + 1 where len(g.kept) < {take})
      select cast(place as integer) as place, feature, {_r('score', 'score')}, stays as kept, partner, {_r('near', 'corr_abs')} from g where place > 0"""


_BY_VARIANCE = "scores as (select feature, variance as score from var where variance > 1e-10)"
_BY_ANOVA = "lf as (" + " union all ".join(f"select class, '{c}' as feature, {c} as v from fl where class is not null" for c in FEATURES) + """),
      per as (select feature, class, count(*) as n, avg(v) as m, var_pop(v) as vp from lf group by all), gr as (select feature, sum(n * m) / sum(n) as grand from per group by 1),
      scores as (select feature, round((sum(n * pow(m - grand, 2)) / (count(*) - 1)) / (sum(n * vp) / (sum(n) - count(*))), 9) as score from per join gr using (feature) join var using (feature) where variance > 1e-12 group by feature)"""

SQL = {
    "select_by_variance": _FILL + f" select feature, {_r('variance', 'variance')}, variance > 1e-10 as kept from var",
    "select_uncorrelated": _greedy(_BY_VARIANCE, 0.95, 99),
    "select_uncorrelated_strictly": _greedy(_BY_VARIANCE, 0.02, 99),
    "select_by_anova": _greedy(_BY_ANOVA, 0.5, 4),
    "select_by_information": _F + f""", l as (select * from long where class is not null), b as (select feature, class, cast(floor((rank() over (partition by feature order by v) - 1) * 10 / cast(count(*) over (partition by feature) as double)) as integer) as bin from l),
      c as (select feature, class, bin, count(*) as c from b group by all), m as (select *, sum(c) over (partition by feature, class) as nc, sum(c) over (partition by feature, bin) as nb, sum(c) over (partition by feature) as n from c)
      select feature, cast(max(n) as bigint) as n, {_r('greatest(sum(c / cast(n as double) * ln(c * cast(n as double) / (cast(nc as double) * nb))), 0)', 'mi')} from m group by feature""",
}
