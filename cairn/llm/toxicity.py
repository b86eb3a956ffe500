"""Severity grades by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import common as C

#: Labelled rows that a model is fitted on at most, the ones with the smallest hashes.
FIT_ROWS = 12_000
#: Features that a model keeps at most, and documents of the fit that must hold one.
MAX_FEATURES = 30_000
MIN_DOCS = 8
#: Features of all fitted documents together at most; documents of the largest hashes go first.
FIT_ENTRIES = 12_000_000
#: Lengths in characters of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: Saturation of counts, and the number of words at which length counts as usual.
SATURATION, USUAL_WORDS = 1.0, 300.0


@dataclass
class Model:
    """P(grade > j) = sigmoid(w . x - theta[j]): one weight vector for all thresholds, theta ascending."""

    weights: dict[int, float]
    theta: np.ndarray

    def above(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.theta[None, :], -40, 40)))


def keys_of(word: bytes) -> list[int]:
    """Hashes of a word's features: itself and its beginnings, where it is longer."""
    text = word.decode("utf-8", "replace")
    parts = [word, *(b"^" + text[:n].encode() for n in BEGINNINGS if len(text) > n)]
    return [xxhash.xxh3_64_intdigest(p) for p in parts]


def weight_of_count(count, n_words):
    """Between 0 and 1: grows with the count, the slower the longer the text."""
    return count / (count + SATURATION * (0.5 + n_words / USUAL_WORDS))


def _theta(raw: np.ndarray) -> np.ndarray:
    """First threshold free, the others by positive steps, so that they stay ordered."""
    return np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))]) if len(raw) else raw


def frequent(rows: list[np.ndarray]) -> np.ndarray:
    """Ascending hashes of the features that a fit on these documents keeps: held by MIN_DOCS of them, the most frequent
    first up to MAX_FEATURES, ties by smaller hash."""
    keys, n = np.unique(np.concatenate([*rows, np.empty(0, np.uint64)]), return_counts=True)
    keep = np.flatnonzero(n >= min(MIN_DOCS, len(rows)))
    return np.sort(keys[keep][np.lexsort((C.signed(keys[keep]), -n[keep]))][:MAX_FEATURES])


def fit(rows: list[np.ndarray], values: list[np.ndarray], grade: np.ndarray, grades: int, **how) -> Model:
    """A model from the feature hashes and values of each document; see fit_entries."""
    if not len(rows):
        return Model({}, np.full(max(0, grades - 1), 0.0))
    words = frequent(rows)
    flat, val = np.concatenate(rows), np.concatenate(values)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.searchsorted(words, flat)
    known = np.append(words, np.uint64(0))[col] == flat
    return fit_entries(doc[known], col[known], val[known], words, grade, grades, **how)


def fit_entries(doc: np.ndarray, col: np.ndarray, val: np.ndarray, words: np.ndarray, grade: np.ndarray, grades: int, steps: int = 300, rate: float = 0.1, decay: float = 4e-4) -> Model:
    """Ordinal logistic regression by proximal Adam: the sum over thresholds of the log losses of [grade > j].

    doc, col, val: document, feature (a place in words) and value of each entry; decay is an L1 penalty, which leaves
    weight only on what tells.
    """
    n = len(grade)
    if grades < 2 or not n:
        return Model({}, np.full(max(0, grades - 1), 0.0))
    target = (grade[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    share = np.clip(target.mean(0), 1e-4, 1 - 1e-4)
    start = np.log((1 - share) / share)
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    w = np.zeros(len(words))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, raw)]
    for step in range(1, steps + 1):
        score = np.bincount(doc, weights=w[col] * val, minlength=n)
        theta = _theta(raw)
        err = (1 / (1 + np.exp(-np.clip(score[:, None] - theta, -40, 40))) - target) / n
        g_theta = -err.sum(0)
        g_raw = np.concatenate([[g_theta.sum()], np.exp(raw[1:]) * np.cumsum(g_theta[::-1])[::-1][1:]])
        g_w = np.bincount(col, weights=err.sum(1)[doc] * val, minlength=len(w))
        moved = []
        for value, g, st in ((w, g_w, state[0]), (raw, g_raw, state[1])):
            st[0] = 0.9 * st[0] + 0.1 * g
            st[1] = 0.999 * st[1] + 0.001 * g * g
            slope = np.sqrt(st[1] / (1 - 0.999**step)) + 1e-6
            moved.append((value - rate * (st[0] / (1 - 0.9**step)) / slope, rate / slope))
        w = np.sign(moved[0][0]) * np.maximum(np.abs(moved[0][0]) - decay * moved[0][1], 0)
        raw = moved[1][0]
    told = np.flatnonzero(w)
    return Model(dict(zip(words[told].tolist(), w[told].tolist())), _theta(raw))


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct feature hashes of a text, ascending, how often each occurs, and the number of words."""
    words = C.plain_words(text)
    count: Counter = Counter()
    for word, n in Counter(words).items():
        for key in keys_of(word):
            count[key] += n
    keys = np.array(sorted(count), np.uint64)
    return keys, np.array([count[k] for k in keys.tolist()], np.int32), len(words)


def _count_rows(batches):
    for batch in C.chunks(batches):
        rows = [counts_of(t) for t in batch.column("text").to_pylist()]
        keys = C.ragged(C.signed(np.concatenate([k for k, _, _ in rows])), [len(k) for k, _, _ in rows])
        counts = pa.ListArray.from_arrays(keys.offsets, pa.array(np.concatenate([c for _, c, _ in rows]), pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), keys, counts, pa.array([n for _, _, n in rows], pa.int64())], names=["doc_id", "y", "x", "c", "n"]
        )


def _known_rows(batches, shared):
    """Of each document the features of the vocabulary, as places in it."""
    words = shared.value
    for batch in batches:
        x = batch.column("x")
        sizes = np.diff(x.offsets.to_numpy())
        flat = x.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        col = np.searchsorted(words, flat)
        known = np.append(words, np.uint64(0))[col] == flat if len(words) else np.zeros(len(flat), bool)
        held = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes))
        offsets = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
        parts = [pa.ListArray.from_arrays(offsets, pa.array(v[known].astype(np.int32))) for v in (col, batch.column("c").flatten().to_numpy(zero_copy_only=False))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("n"), *parts], names=["doc_id", "y", "n", "col", "c"])


class Known(dict):
    """word -> the features of it that a model gives weight to; most words have none."""

    def __init__(self, weights: dict[int, float]):
        self.weights = weights

    def __missing__(self, word: bytes) -> tuple:
        if len(self) > C.MEMO_WORDS:
            self.clear()
        found = self[word] = tuple(k for k in keys_of(word) if k in self.weights)
        return found


def _score_rows(batches, shared):
    model = shared.value
    known = Known(model.weights)
    for batch in C.chunks(batches):
        x = np.zeros(batch.num_rows)
        for i, text in enumerate(batch.column("text").to_pylist()):
            words = C.plain_words(text)
            count = Counter(k for keys in map(known.__getitem__, words) if keys for k in keys)
            x[i] = sum(model.weights[k] * weight_of_count(n, len(words)) for k, n in count.items())
        above = model.above(x)
        severity = above.sum(1)
        grade = (above >= 0.5).sum(1)
        top = max(1, len(model.theta))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(batch.num_columns)), pa.array(severity), pa.array(grade.astype(np.int32)), pa.array(np.clip(severity / top, 0, 1))],
            names=[*batch.schema.names, "expected_severity", "grade", "score"],
        )


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", fit_rows: int = FIT_ROWS, fit_entries_: int = FIT_ENTRIES, held_out: bool = True) -> Model:
    """A model from labelled rows; grades are 0 up to the largest label (at least 1), so labels of 0 and 1 give a single
    threshold, and more grades as many thresholds as there are steps.

    At most fit_rows rows are used, those with the smallest hashes of doc_id, one for each doc_id, however often it
    occurs in docs, and of these the first that together have at most fit_entries_ distinct features. A doc_id with
    several labels has the largest. held_out: leave out the rows whose crc32 of doc_id as text is a multiple of 5. No
    labels: a model of severity one half for all.

    Documents holding a feature are counted on the executors; the driver gets the vocabulary (MAX_FEATURES) and, of each
    document, the places and counts of its features in it.
    """
    from cairn.llm.quality import held_out_remainder

    spark = docs.sparkSession
    known = labels.select("doc_id", F.col(column).cast("int").alias("y")).where("doc_id is not null and y >= 0")
    if held_out:
        known = known.where(held_out_remainder() != 0)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    stashed = C.stash(C.labelled_texts(docs, known).mapInArrow(_count_rows, "doc_id long, y int, x array<long>, c array<int>, n long"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # at most fit_rows thin rows
    taken = stashed.select("doc_id", F.sum(F.size("x").cast("long")).over(order).alias("s")).where(F.col("s") <= fit_entries_).select("doc_id")
    rows = stashed.join(F.broadcast(taken), "doc_id")
    n_rows = rows.count()
    held = rows.select(F.explode("x").alias("k")).groupBy("k").agg(F.count("*").alias("d")).where(F.col("d") >= min(MIN_DOCS, n_rows))
    top = held.orderBy(F.desc("d"), "k").limit(MAX_FEATURES).select("k").toArrow().column("k").to_numpy()
    words = np.sort(top.astype(np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(words)
    got = rows.mapInArrow(partial(_known_rows, shared=shared), "doc_id long, y int, n long, col array<int>, c array<int>").toArrow()
    shared.unpersist()
    C.discard(stashed)
    if not got.num_rows:
        return Model({}, np.zeros(1))
    got = got.sort_by("doc_id").combine_chunks()
    col, count = (got.column(name).combine_chunks() for name in ("col", "c"))
    sizes = np.diff(col.offsets.to_numpy())
    doc, y, n = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), got.column("y").to_numpy(), got.column("n").to_numpy()
    val = weight_of_count(count.flatten().to_numpy(zero_copy_only=False), n[doc])
    return fit_entries(doc, col.flatten().to_numpy(zero_copy_only=False), val, words, y, max(2, int(y.max(initial=1)) + 1))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.4) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, expected_severity, grade, score, predicted), one row for each input row.

    expected_severity is the sum over thresholds of P(grade > j), 0 to the highest grade; grade counts the thresholds
    passed with probability 0.5 or more; score is the severity over the highest grade, predicted says score >=
    threshold. Null text is an empty one: it has no words and gets the intercept's severity. Whole texts are read;
    repeated rows get equal scores; null doc_ids are scored. Empty tables give no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    base = docs.select("doc_id", "text")
    schema = T.StructType(
        [*base.schema.fields, T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("score", T.DoubleType())]
    )
    rows = base.mapInArrow(partial(_score_rows, shared=shared), schema)
    return rows.select("doc_id", "expected_severity", "grade", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
