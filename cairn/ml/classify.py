"""Classifier factory: Spark ML estimators by short names, without prompts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Binarizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.ml.extra import ExtraTrees
from cairn.plans.materialize import materialize


def make_classifier(name: str, **params) -> Estimator:
    """svm, rf, erf, nb or sgd, reading the vector column `features` and `label`.

    erf are extremely randomised trees, see ExtraTrees.
    sgd has hinge loss and elasticNetParam (0: L2, 1: L1); loss="log" gives logistic loss instead. nb works on features above 0, or with
    embedding=True on the leaves of a forest that rows fall into (its parameters: trees, depth, seed).
    """
    if name == "svm":
        return OneVsRest(classifier=LinearSVC(**params))
    if name == "rf":
        return RandomForestClassifier(**({"numTrees": 30, "seed": 1} | params))
    if name == "erf":
        return ExtraTrees(**params)
    if name == "nb" and params.pop("embedding", False):
        own = {p: params.pop(p) for p in ("trees", "depth", "seed") if p in params}
        return Pipeline(stages=[*random_trees_embedding(**own), NaiveBayes(modelType="bernoulli", featuresCol="_on", **params)])
    if name == "nb":
        return Pipeline(stages=[Binarizer(inputCol="features", outputCol="_on", threshold=0.0), NaiveBayes(modelType="bernoulli", featuresCol="_on", **params)])
    if name == "sgd":
        return LogisticRegression(**params) if params.pop("loss", "hinge") == "log" else HingeClassifier(**params)
    raise ValueError(f"unknown classifier: {name}")


class HingeClassifier(Estimator):
    """One-vs-rest hinge loss with L2, L1 or both, by proximal subgradient steps on the vector column `features`. It is
    fitted on at most about fit_rows rows, whose hashes of content fall below their share of all rows."""

    def __init__(self, regParam: float = 1e-4, elasticNetParam: float = 0.0, maxIter: int = 300, fit_rows: int = 100_000):
        super().__init__()
        self.regParam, self.elasticNetParam, self.maxIter, self.fit_rows = regParam, elasticNetParam, maxIter, fit_rows

    def _fit(self, dataset: DataFrame) -> HingeModel:
        rows = dataset.where("label is not null").select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))
        n = rows.count()
        if not n:
            raise ValueError("no labelled rows")
        some = rows.where(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 30)) < int(min(1.0, self.fit_rows / n) * (1 << 30))).toArrow()
        y = some.column("y").to_numpy()
        x = np.nan_to_num(some.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1))
        order = np.lexsort((*x.T, y))  # the order in which rows arrive must not matter
        x, y = x[order], y[order]
        mean, scale = x.mean(0), 1 / (x.std(0) + 1e-9)
        z = (x - mean) * scale
        sign = np.where(y[:, None] == np.arange(y.max() + 1)[None, :], 1.0, -1.0)
        w, b = np.zeros((z.shape[1], sign.shape[1])), np.zeros(sign.shape[1])
        for step in range(1, self.maxIter + 1):
            wrong = sign * (sign * (z @ w + b) < 1) / len(z)
            rate = 1 / np.sqrt(step)
            w = w + rate * (z.T @ wrong - self.regParam * (1 - self.elasticNetParam) * w)
            w = np.sign(w) * np.maximum(np.abs(w) - rate * self.regParam * self.elasticNetParam, 0)
            b = b + rate * wrong.sum(0)
        return HingeModel(w * scale[:, None], b - (mean * scale) @ w)


class HingeModel(Model):
    """Adds margins (an array, one entry a label) and prediction, the label of the largest, ties to the smallest."""

    def __init__(self, weights: np.ndarray, intercepts: np.ndarray):
        super().__init__()
        self.weights, self.intercepts = weights, intercepts

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, intercepts = self.weights, self.intercepts

        def margins(feats: pd.Series) -> pd.Series:
            return pd.Series(list(np.nan_to_num(np.stack(feats.to_numpy()).astype(float)) @ weights + intercepts) if len(feats) else [], dtype=object)

        out = dataset.withColumn("margins", F.pandas_udf(margins, "array<double>")(vector_to_array("features")))
        return out.withColumn("prediction", (F.array_position("margins", F.array_max("margins")) - 1).cast("double"))


class LeafIndicators(Transformer):
    """Which leaf of each tree of a forest a row falls into: the leaf numbers in _leaf as a vector of zeros and ones."""

    def __init__(self, leaves: int):
        super().__init__()
        self.leaves = leaves

    def _transform(self, dataset: DataFrame) -> DataFrame:
        each = F.transform(vector_to_array("_leaf"), lambda v: F.transform(F.sequence(F.lit(0), F.lit(self.leaves - 1)), lambda j: (v == j).cast("double")))
        return dataset.withColumn("_on", array_to_vector(F.flatten(each))).drop("prediction", "probability", "rawPrediction")


def random_trees_embedding(trees: int = 10, depth: int = 5, seed: int = 1) -> list:
    """Stages that turn features into leaf indicators of a forest on random feature subsets."""
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, leafCol="_leaf", bootstrap=False, featureSubsetStrategy="sqrt", seed=seed)
    return [forest, LeafIndicators(2**depth)]


def as_features(df: DataFrame) -> DataFrame:
    """Adds the vector column `features` from the array column feats, NaN and null as 0."""
    return df.withColumn("features", array_to_vector(F.transform("feats", lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))))


def _nearest(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    ids, labels, feats = shared.value
    for batch in batches:
        x = batch.column("feats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for lo in range(0, len(x), 64):
            some = x[lo : lo + 64]
            d2 = np.concatenate([((some[:, None, :] - feats[None, a : a + 2048, :]) ** 2).sum(-1) for a in range(0, len(feats), 2048)], axis=1)
            best = np.lexsort((np.broadcast_to(ids, d2.shape), d2), axis=1)[:, :k]
            n = best.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(lo, len(some)).take(np.repeat(np.arange(len(some)), n)), pa.array(ids[best].ravel()), pa.array(labels[best].ravel()), pa.array(np.take_along_axis(d2, best, 1).ravel())],
                names=["id", "tid", "label", "d2"],
            )


def knn(train: DataFrame, rows: DataFrame, k: int = 5, block_bytes: int = 64_000_000) -> DataFrame:
    """train(id, label, feats), rows(id, feats) -> (id, label): the majority among the k nearest by Euclidean distance,
    ties to the smaller id, then the smaller label. All feats have one length; null or non-finite entries count as 0.

    The training side is counted and searched in blocks of about block_bytes, one after another: what is broadcast is
    bounded, each row keeps k candidates a block, and there is no limit to the training rows.
    """
    spark = rows.sparkSession
    clean = F.transform("feats", lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v).cast("double")).alias("feats")
    known = train.where("label is not null").select("id", F.col("label").cast("int").alias("label"), clean)
    size = known.agg(F.count("*").alias("n"), F.max(F.size("feats")).alias("w")).first()
    blocks = max(1, -(-8 * size["n"] * (size["w"] or 0) // block_bytes))
    near = None
    for b in range(blocks):
        got = known.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if not got.num_rows:
            continue
        feats = got.column("feats").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, -1)
        shared = spark.sparkContext.broadcast((got.column("id").to_numpy(), got.column("label").to_numpy(), feats))
        one = rows.select("id", clean).mapInArrow(partial(_nearest, shared=shared, k=k), "id long, tid long, label int, d2 double")
        if blocks > 1:
            one = materialize(one)
            shared.unpersist()
        near = one if near is None else near.union(one)
    if near is None:
        return spark.createDataFrame([], "id long, label int")
    w = Window.partitionBy("id").orderBy("d2", "tid")
    votes = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy("id", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b")).select("id", (-F.col("b.l")).cast("int").alias("label"))


def importance_by_scale(importances: list[float], per_scale: int) -> list[float]:
    """Sums of consecutive feature importances, one for each scale."""
    return [sum(importances[i : i + per_scale]) for i in range(0, len(importances), per_scale)]


def scaler() -> StandardScaler:
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)


def probabilities(predicted: DataFrame) -> DataFrame:
    """Adds prob, the probability of the predicted label, where the model tells one."""
    if "probability" not in predicted.columns:
        return predicted.withColumn("prob", F.lit(1.0))
    return predicted.withColumn("prob", F.get(vector_to_array("probability"), F.col("prediction").cast("int")))
