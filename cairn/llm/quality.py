"""Quality scores by positive-unlabelled learning."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import common as C

#: Trusted positives and unlabelled documents that a model is fitted on at most, the ones with the smallest hashes.
POSITIVE_ROWS, UNLABELLED_ROWS = 8_000, 12_000
THRESHOLD = 0.3
#: Confidence of the share estimates and slack of the bound that the class prior is read off.
DELTA, SLACK = 0.1, 0.01
SCORE = "_cairn_score"
#: Kinds of bytes: other control, upper, lower, digit, space, line feed, punctuation, non-ASCII.
_KIND = np.array(
    [1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 if 48 <= c <= 57 else 4 if c in (32, 9, 13) else 5 if c == 10 else 7 if c > 127 else 6 if c > 32 and c != 127 else 0 for c in range(256)], np.uint8
)
N_KINDS = 8
N_FEATURES = 256 + N_KINDS * N_KINDS + 9


def _ratio(items: list) -> float:
    return len(set(items)) / len(items) if items else 1.0


def features(text: str | None) -> np.ndarray:
    """What a text looks like, whatever its length: byte and byte-kind frequencies (square roots) and repetition."""
    raw = C.encode(text)
    out = np.zeros(N_FEATURES, np.float32)
    if not raw:
        return out
    b = np.frombuffer(raw, np.uint8)
    out[:256] = np.sqrt(np.bincount(b, minlength=256) / len(b))
    kind = _KIND[b]
    if len(b) > 1:
        out[256 : 256 + N_KINDS**2] = np.sqrt(np.bincount(kind[:-1] * np.uint8(N_KINDS) + kind[1:], minlength=N_KINDS**2) / (len(b) - 1))
    words = raw.split()
    n = max(1, len(words))
    sentences = raw.replace(b"\n", b".").split(b".")
    lines = raw.split(b"\n")
    out[-9:] = (
        np.log1p(len(words)), len(raw) / n / 10, _ratio(words), _ratio(list(zip(words, words[1:]))), _ratio(sentences), _ratio(lines), np.log1p(len(raw) / len(lines)), np.log1p(len(words) / len(sentences)), 1.0,
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    prior: float
    #: Steps in which the estimated risk of the negatives was below zero.
    turned: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -6, 6)
        return np.maximum(z @ self.hidden + self.bias, 0) @ self.out + self.out_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x.astype(np.float64)), -40, 40)))


def share_bound(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Upper bound of the share of positives in the unlabelled scores, both sets being scored by a model that saw neither.

    Above any score, unlabelled text holds at least the prior times the share of positives above it; the ratio of the two
    shares is smallest where hardly any negatives are. The score is taken where the ratio plus its sampling error is
    smallest.
    """
    cuts = np.unique(positive)
    above_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    error = sum(np.sqrt(np.log(4 / DELTA) / (2 * len(x))) for x in (positive, unlabelled))
    best = np.argmin((above_u + (1 + SLACK) * error) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray, steps: int = 150) -> float:
    """Class prior of the unlabelled rows, from positives and unlabelled rows alone: the mean of two share bounds, each
    on the half of the rows that its model was not fitted on; a second round fits with the prior of the first."""
    prior = 0.5
    if min(len(positives), len(unlabelled)) < 4:
        return prior
    for _ in range(2):
        bounds = []
        for half in (0, 1):
            model = fit(positives[half::2], unlabelled[half::2], prior, steps=steps)
            bounds.append(share_bound(model.score(positives[1 - half :: 2]), model.score(unlabelled[1 - half :: 2])))
        prior = float(np.mean(bounds))
    return prior


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, steps: int = 300, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Model:
    """Minimises prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]) with the logistic loss, by Adam on all rows.

    Where the bracket is negative, the step goes up its gradient instead, as the non-negative estimator prescribes.
    """
    everything = np.concatenate([positives, unlabelled]).astype(np.float64)
    mean, scale = unlabelled.mean(0, dtype=np.float64), 1 / (unlabelled.std(0, dtype=np.float64) + 1e-3)
    z = everything  # in place: this is most of what the driver holds
    z -= mean
    z *= scale
    np.clip(z, -6, 6, out=z)
    n_p, n_u, turned = len(positives), len(unlabelled), 0
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, np.sqrt(1 / z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pre = z @ params[0] + params[1]
        act = np.maximum(pre, 0)
        s = 1 / (1 + np.exp(-np.clip(act @ params[2] + params[3][0], -40, 40)))
        log1 = -np.log(np.maximum(1 - s, 1e-15))
        negative = log1[n_p:].mean() - prior * log1[:n_p].mean()
        g = np.empty(n_p + n_u)
        if negative >= 0:
            g[:n_p] = prior * ((s[:n_p] - 1) - s[:n_p]) / n_p
            g[n_p:] = s[n_p:] / n_u
        else:
            turned += 1
            g[:n_p] = prior * s[:n_p] / n_p
            g[n_p:] = -s[n_p:] / n_u
        back = np.outer(g, params[2]) * (pre > 0)
        grads = [z.T @ back + decay * params[0], back.sum(0), act.T @ g + decay * params[2], np.array([g.sum()])]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, params[0], params[1], params[2], float(params[3][0]), prior, turned)


def _feature_rows(batches):
    for batch in C.chunks(batches):
        x = [features(t) for t in batch.column("text").to_pylist()]
        flat = np.concatenate(x) if x else np.empty(0, np.float32)
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(flat), N_FEATURES).cast(pa.list_(pa.float32()))], names=["y", "x"])


def _score_rows(batches, shared):
    model = shared.value
    for batch in C.chunks(batches):
        x = np.stack([features(t) for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(model.score(x))], names=[*batch.schema.names, SCORE])


def held_out_remainder():
    """crc32 of doc_id as text modulo 5; null doc_id: of the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model:
    """A model from trusted positives and unlabelled documents.

    The positives are labelled doc_ids of quality 1 outside the held-out fifth, at most positive_rows; no other label is
    read, so rows of quality 0 change nothing. The unlabelled text is a sample of docs whatever their labels, at most
    unlabelled_rows doc_ids outside the held-out fifth. Both are those with the smallest hashes of doc_id, one text for
    each doc_id, however often it occurs. The class prior is estimated from these two alone. Without positives nothing
    can be told apart: a model that scores everything 1.
    """
    key = F.xxhash64("doc_id")
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").where(held_out_remainder() != 0).select("doc_id").distinct()
    trusted = trusted.orderBy(key, "doc_id").limit(positive_rows)
    n_ids = docs.agg(F.approx_count_distinct("doc_id")).first()[0]
    rate = min(1.0, 2 * unlabelled_rows / max(1, n_ids))  # more than are taken, but few enough that the sort stays small
    some = docs.where(F.pmod(key, F.lit(1 << 30)) < int(rate * (1 << 30))).where("doc_id IS NOT NULL").where(held_out_remainder() != 0)
    some = some.select("doc_id").distinct().orderBy(F.pmod(key, F.lit(1 << 30)), "doc_id").limit(unlabelled_rows)
    known = trusted.select("doc_id", F.lit(1).alias("y")).union(some.select("doc_id", F.lit(2))).groupBy("doc_id").agg(F.sum("y").cast("int").alias("y"))
    table = C.labelled_texts(docs, known).select("y", "text").mapInArrow(_feature_rows, "y int, x array<float>").toArrow()
    y = table.column("y").to_numpy() if table.num_rows else np.empty(0, int)
    if not (y % 2 == 1).any():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), 40.0, 1.0)
    x = np.concatenate([c.values.to_numpy(zero_copy_only=False) for c in table.column("x").chunks]).reshape(len(y), N_FEATURES)
    order = np.lexsort((*x.T[-3:], x[:, -9], y))  # the order in which rows arrive must not matter
    x, y = x[order], y[order]
    positives, unlabelled = x[y % 2 == 1], x[y >= 2]
    if not len(unlabelled):
        unlabelled = positives
    return fit(positives, unlabelled, estimate_prior(positives, unlabelled))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus a column SCORE: how likely the whole text is of quality 1. Null and empty texts get the score of no
    features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())])
    return docs.mapInArrow(partial(_score_rows, shared=shared), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, score, predicted), one row for each input row.

    held_out: crc32 of doc_id as text is a multiple of 5; such rows' labels are never read. predicted: score >=
    threshold. Only the text is an input of a score. Null text is an empty one; rows of null doc_id are scored; repeated
    rows get equal scores; texts of any length are read whole. Empty tables give no rows.
    """
    rows = score(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("doc_id", (held_out_remainder() == 0).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those whose score is below the threshold; the same columns."""
    columns = docs.columns
    return score(docs, train(docs, labels)).where(F.col(SCORE) >= threshold).select(*columns)
