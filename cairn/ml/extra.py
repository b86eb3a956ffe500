"""Extremely randomised trees: splits at random thresholds of random features, the best of a few at each node."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "tree int, child array<int>, feature array<int>, split array<double>, props array<double>, gain array<double>"


def grow(x: np.ndarray, y: np.ndarray, labels: int, max_depth: int, min_obs: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(left child, feature, threshold, label shares of each node, impurity decrease of each feature); the right child
    follows the left one; a leaf has child -1. At each node the square root of the features that vary are tried, each at
    one threshold drawn between its smallest and largest value, and the split of least Gini impurity is taken."""
    child, feature, split, props, gain = [-1], [0], [0.0], [None], np.zeros(x.shape[1])
    tried = max(1, int(np.sqrt(x.shape[1])))
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        count = np.bincount(y[rows], minlength=labels)
        props[node] = count / max(1, len(rows))
        own = x[rows]
        low, high = own.min(0), own.max(0)
        varied = np.flatnonzero(high > low)
        if depth >= max_depth or len(rows) < 2 * min_obs or count.max() == len(rows) or not len(varied):
            continue
        best = None
        for f in rng.choice(varied, min(tried, len(varied)), replace=False):
            at = rng.uniform(low[f], high[f])
            left = own[:, f] <= at
            n = int(left.sum())
            if not 0 < n < len(rows):
                continue
            a = np.bincount(y[rows[left]], minlength=labels)
            rest = n - (a**2).sum() / n + (len(rows) - n) - ((count - a) ** 2).sum() / (len(rows) - n)
            if best is None or rest < best[0]:
                best = rest, f, at, left
        if best is None:
            continue
        rest, f, at, left = best
        gain[f] += len(rows) - (count**2).sum() / len(rows) - rest
        child[node], feature[node], split[node] = len(child), int(f), float(at)
        for mine in (rows[left], rows[~left]):
            todo.append((len(child), mine, depth + 1))
            for values, new in ((child, -1), (feature, 0), (split, 0.0), (props, None)):
                values.append(new)
    return np.array(child), np.array(feature), np.array(split), np.stack(props), gain


class ExtraTrees(Estimator):
    """Reads the vector column `features` and `label`. A tree is grown on all rows, or on a random part of at most about
    tree_rows of them: each row enters a tree if a hash of seed, tree and row falls below the share."""

    def __init__(self, numTrees: int = 30, maxDepth: int = 12, minObs: int = 1, tree_rows: int = 200_000, seed: int = 1):
        super().__init__()
        self.numTrees, self.maxDepth, self.minObs, self.tree_rows, self.seed = numTrees, maxDepth, minObs, tree_rows, seed

    def _fit(self, dataset: DataFrame) -> ExtraTreesModel:
        rows = dataset.where("label is not null").select(vector_to_array("features").alias("feats"), F.col("label").cast("int").alias("label"))
        size = rows.agg(F.count("*").alias("n"), F.max("label").alias("m")).first()
        if not size["n"]:
            raise ValueError("no labelled rows")
        labels, depth, least, seed = size["m"] + 1, self.maxDepth, self.minObs, self.seed
        share = int(min(1.0, self.tree_rows / size["n"]) * (1 << 30))
        dealt = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.numTrees - 1))))
        dealt = dealt.where(F.pmod(F.xxhash64("feats", "label", "tree", F.lit(seed)), F.lit(1 << 30)) < share)

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            x = np.nan_to_num(np.stack(pdf["feats"].to_numpy()).astype(float))
            child, feature, split, props, gain = grow(x, pdf["label"].to_numpy(int), labels, depth, least, np.random.default_rng([seed, tree]))
            return pd.DataFrame([(tree, child, feature, split, props.ravel(), gain)], columns=["tree", "child", "feature", "split", "props", "gain"])

        grown = dealt.groupBy("tree").applyInPandas(one, SCHEMA).collect()  # one row a tree, of bounded size
        trees = [(np.array(r.child), np.array(r.feature), np.array(r.split), np.array(r.props).reshape(-1, labels)) for r in sorted(grown, key=lambda r: r.tree)]
        return ExtraTreesModel(trees, np.sum([r.gain for r in grown], axis=0))


class ExtraTreesModel(Model):
    """Adds probability (the mean of the trees' leaf shares) and prediction (the likeliest label, ties to the smallest)."""

    def __init__(self, trees: list[tuple], gain: np.ndarray):
        super().__init__()
        self.trees, self.numFeatures = trees, len(gain)
        self.featureImportances: DenseVector = Vectors.dense(gain / gain.sum() if gain.sum() > 0 else gain)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(self.trees)

        def shares(feats: pd.Series) -> pd.Series:
            if not len(feats):
                return pd.Series([], dtype=object)
            x = np.nan_to_num(np.stack(feats.to_numpy()).astype(float))
            total, rows = 0.0, np.arange(len(x))
            for child, feature, split, props in shared.value:
                at = np.zeros(len(x), int)
                while (inner := child[at] >= 0).any():
                    right = x[rows, feature[at]] > split[at]
                    at = np.where(inner, child[at] + right, at)
                total = total + props[at]
            return pd.Series(list(total / len(shared.value)))

        udf = F.pandas_udf(shares, "array<double>")
        out = dataset.withColumn("_p", udf(vector_to_array("features")))
        return out.withColumns({"probability": array_to_vector("_p"), "prediction": (F.array_position("_p", F.array_max("_p")) - 1).cast("double")}).drop("_p")
