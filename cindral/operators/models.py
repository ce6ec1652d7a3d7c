"""Learned models on Spark ML and their leakage-aware evaluation."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindral.operators.features import assert_allowed
from cindral.operators.quantiles import exact_quantiles
from cindral.operators.scores import average_precision, probability_scores
from cindral.session import checked, cut


def fitted(train: DataFrame, features: list[str], label: str = "label", depth: int = 4, rounds: int = 20, seed: int = 0):
    """A function that adds `p`, the probability by boosted trees fitted on train, to a frame; missing values are set to the medians of train."""
    assert_allowed(features)
    as_double = lambda d: d.withColumns({f: F.col(f).cast("double") for f in features})
    train = as_double(train)
    fill = Imputer(strategy="median", inputCols=features, outputCols=[f"_{f}" for f in features]).fit(train)
    join = VectorAssembler(inputCols=[f"_{f}" for f in features], outputCol="_x", handleInvalid="keep")
    model = GBTClassifier(featuresCol="_x", labelCol=label, maxDepth=depth, maxIter=rounds, seed=seed).fit(join.transform(fill.transform(train)))

    def predict(d: DataFrame) -> DataFrame:
        out = model.transform(join.transform(fill.transform(as_double(d))))
        return out.withColumn("p", vector_to_array("probability")[1]).select(*d.columns, "p")

    return predict


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], label: str = "label", **kw) -> DataFrame:
    return fitted(train, features, label, **kw)(test)


def out_of_fold(df: DataFrame, folds: DataFrame, features: list[str], label: str = "label", uid: str = "uid", **kw) -> DataFrame:
    """Predictions of every unit by the model of the fold that tests it. folds: fold, split_name, uid. Units meet their folds in one join; each fold is one fit."""
    d = cut(df.join(folds.select("fold", "split_name", uid), uid).repartition("fold"))
    out = None
    for k in sorted(r["fold"] for r in d.select("fold").distinct().collect()):  # one number for each fold
        part = d.where(F.col("fold") == k)
        p = fitted(part.where("split_name = 'train'"), features, label, **kw)(part.where("split_name = 'test'")).select(*df.columns, "fold", "p")
        out = p if out is None else out.unionByName(p)
    return out


def scorecard(pred: DataFrame, label: str = "label", prob: str = "p") -> DataFrame:
    """One row: average precision, Brier, log loss, base rate."""
    return average_precision(pred, label, prob).crossJoin(probability_scores(pred, label, prob))


def permutation_importance(train: DataFrame, test: DataFrame, features: list[str], label: str = "label", seed: int = 0, **kw) -> list[tuple[str, float]]:
    """Loss of average precision when a feature's values are exchanged between rows (turned by one place in hash order). One fit."""
    from pyspark.sql.window import Window as W

    predict = fitted(train, features, label, seed=seed, **kw)
    base = average_precision(predict(test), label, "p").first()[0]
    part = F.pmod(F.xxhash64(*features), F.lit(64))
    w = W.partitionBy(part).orderBy(F.xxhash64(*features, F.lit(seed)))
    first, last = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), F.lead(F.lit(1)).over(w).isNull()
    turned = cut(test.withColumns({f"_t_{f}": F.when(last, F.first(f).over(first)).otherwise(F.lead(f).over(w)) for f in features}))
    out = []
    for f in features:
        mixed = turned.withColumn(f, F.col(f"_t_{f}")).select(*test.columns)
        out.append((f, base - average_precision(predict(mixed), label, "p").first()[0]))
    return sorted(out, key=lambda x: -x[1])


def conditional_quantiles(df: DataFrame, by: list[str], value: str, taus: list[float], pooled_from: int = 30, within: list[str] | None = None) -> DataFrame:
    """(by, n, q): quantiles of log(1 + value) in each cell of binned covariates, of all rows (of the same `within`, some of by) where a cell is thin; back on the value's scale."""
    d = df.withColumn("_y", F.log1p(F.col(value).cast("double")))
    every = exact_quantiles(d, "_y", taus, within, name="_all").select(*(within or []), "_all")
    g = exact_quantiles(d, "_y", taus, by, name="_own")
    g = g.join(checked(cut(every), 128), within) if within else g.crossJoin(F.broadcast(every))
    return g.select(*by, "n", F.transform(F.when(F.col("n") >= pooled_from, F.col("_own")).otherwise(F.col("_all")), lambda v: F.expm1(v)).alias("q"))
