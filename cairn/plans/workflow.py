"""Train, validate, label: the classification workflows over a feature set (id, label, feats)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.ml.classify import as_features, importance_by_scale, make_classifier, probabilities
from cairn.operators.assets import drop_features
from cairn.operators.color import color_by_class, color_by_probability
from cairn.operators.metrics import confusion_matrix, resampled_confusion
from cairn.operators.sampling import balanced_split, one_vs_rest, sized_split
from cairn.sources.readers import export_colored
from cairn.sources.store import CloudStore


def train_validate(df: DataFrame, classifier: str = "rf", seed: int = 1, sizes: dict | None = None, positive: int | None = None, **params):
    """(model, confusion matrix of the validation fold); positive: one label against the rest; sizes: rows per label."""
    if positive is not None:
        df = one_vs_rest(df, positive)
    folds = sized_split(df, sizes, seed) if sizes else balanced_split(df, seed)
    model = make_classifier(classifier, **params).fit(as_features(folds.where("fold = 0")))
    checked = model.transform(as_features(folds.where("fold = 1"))).select(F.col("prediction").cast("int").alias("assigned"), F.col("label").alias("known"))
    return model, confusion_matrix(checked)


def train_blind(df: DataFrame, classifier: str = "erf", seed: int = 1, **params):
    """A model from one balanced fold as large as the rarest label allows, without validation."""
    return make_classifier(classifier, **params).fit(as_features(balanced_split(df, seed, folds=1)))


def refit_without_scales(df: DataFrame, per_scale: int, drop: list[int], classifier: str = "rf", seed: int = 1, **params):
    """(importance of each scale, model and confusion matrix of a refit without the scales in drop); feats are laid out
    scale by scale, per_scale features each. The classifier must tell importances (rf, erf)."""
    full, _ = train_validate(df, classifier, seed, **params)
    shares = importance_by_scale(full.featureImportances.toArray().tolist(), per_scale)
    gone = [s * per_scale + i for s in drop for i in range(per_scale)]
    model, conf = train_validate(drop_features(df, gone), classifier, seed, **params)
    return shares, model, conf


def apply_model(model, df: DataFrame, action: str = "label", trials: int = 5, seed: int = 1) -> DataFrame:
    """label: df with the assigned label and its probability; evaluate: mean and deviation of the confusion matrices of
    balanced resamples."""
    done = probabilities(model.transform(as_features(df)))
    if action == "label":
        return done.select("id", "feats", F.col("prediction").cast("int").alias("label"), "prob")
    if action != "evaluate":
        raise ValueError(f"unknown action: {action}")
    rows = None
    for trial in range(trials):
        fold = balanced_split(done.select("id", "label", F.col("prediction").cast("int").alias("assigned")), seed + trial).where("fold = 1")
        one = fold.select(F.lit(trial).alias("trial"), "assigned", F.col("label").alias("known"))
        rows = one if rows is None else rows.unionByName(one)
    return resampled_confusion(rows)


def save_predictions(model, store: CloudStore, tag: str, save_as: str, what: str = "labels") -> DataFrame:
    """Applies a model to a stored set and stores (id, label, feats) as a new one. what: "labels" keeps the features,
    "probabilities" has the probabilities of all labels in their place."""
    done = model.transform(as_features(store.feats(tag)))
    if what == "probabilities":
        feats = vector_to_array("probability")
    elif what == "labels":
        feats = F.col("feats")
    else:
        raise ValueError(f"unknown result: {what}")
    store.add_set(save_as, done.select("id", F.col("prediction").cast("int").alias("label"), feats.alias("feats")))
    return store.index(save_as)


def export_predictions(model, df: DataFrame, path: str, precision: int = 3) -> None:
    """Predicts df(id, x, y, z, feats) and writes the points as coloured text, by probability where the model tells it."""
    done = probabilities(model.transform(as_features(df))).withColumn("label", F.col("prediction").cast("int"))
    export_colored(color_by_probability(done) if "probability" in done.columns else color_by_class(done), path, precision)
