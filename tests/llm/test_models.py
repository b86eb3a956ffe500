import random
import zlib

import brute
import numpy as np
import pytest
from conftest import passage
from pyspark.sql import functions as F

from cairn.llm import common, mixing, quality, sharding, toxicity


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(700):
        good, toxic = rng.random() < 0.8, rng.random() < 0.2
        text = passage(rng, rng.randrange(20, 120))
        if not good:
            text = " ".join(w + rng.choice(["$$$", "###"]) for w in text.split())
        if toxic:
            text += " nasty1 mean2"
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(labelled):
    docs, labels, d, y = labelled
    got = {r.doc_id: r for r in quality.quality_scores(d, y).collect()}
    assert len(got) == len(docs) and all(got[i].held_out == held_out(i) for i, _ in docs)
    right = [got[i].predicted == q for i, q, _ in labels if held_out(i)]
    assert sum(right) / len(right) > 0.95
    assert {r.doc_id for r in quality.keep_good(d, y).collect()} == {i for i, r in got.items() if r.predicted}


def test_quality_never_reads_held_out_labels(labelled, spark):
    docs, labels, d, y = labelled
    turned = spark.createDataFrame([(i, 1 - q if held_out(i) else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(d, z).collect()} for z in (y, turned))
    assert a == b


def test_quality_edges(docs, empty, labelled):
    y = labelled[3]
    assert quality.quality_scores(empty, y).count() == 0
    assert all(r.predicted == 1 for r in quality.quality_scores(docs, y.limit(0)).collect())
    assert all(r.predicted == 1 for r in quality.quality_scores(docs, y.selectExpr("doc_id", "0 AS quality")).collect())  # nothing is trusted, nothing rejected
    assert quality.keep_good(docs, y.limit(0)).columns == docs.columns


def test_risk_is_non_negative_and_separates():
    rng = np.random.default_rng(1)
    pos, unl = rng.normal(1, 1, (300, 4)), np.concatenate([rng.normal(1, 1, (300, 4)), rng.normal(-2, 1, (300, 4))])
    model = quality.fit(pos, unl, 0.5)
    s = model.score(unl)
    assert (s[:300] > 0.5).mean() > 0.9 and (s[300:] < 0.5).mean() > 0.9
    tight = quality.fit(pos, unl, 0.7, hidden=64, steps=600)  # a prior that the rows exceed drives the negatives' risk below zero
    assert tight.turned > 0 and np.isfinite(tight.score(unl)).all()


def test_labels_of_zero_are_never_read(labelled):
    _, _, d, y = labelled
    rows = [sorted(map(tuple, quality.quality_scores(d, z).select("doc_id", "score").collect())) for z in (y, y.where("quality = 1"), y.withColumn("quality", F.when(F.col("quality") == 1, 1)))]
    assert rows[0] == rows[1] == rows[2]


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_of_known_mixtures(share):
    rng = np.random.default_rng(7)
    n = 4000
    positives, k = rng.normal(1.5, 1, (2000, 6)), int(n * share)
    unlabelled = np.concatenate([rng.normal(1.5, 1, (k, 6)), rng.normal(-1.5, 1, (n - k, 6))])[rng.permutation(n)]
    assert abs(quality.estimate_prior(positives, unlabelled) - share) < 0.06


def test_quality_scores_match_the_model_text_by_text(labelled, spark):
    docs, _, d, y = labelled
    model = quality.train(d, y)
    extra = [(None, "good"), (5000, None), (5001, ""), (5002, "w " * 60_000), (5003, docs[3][1]), (5003, docs[3][1])]
    more = spark.createDataFrame([(i, t, 0.5, "x") for i, t in extra], "doc_id long, text string, score double, predicted string")
    got = sorted(((r.doc_id, r.score, r.predicted) for r in quality.score(more, model).selectExpr("doc_id", f"{quality.SCORE} AS score", f"int({quality.SCORE} >= 0.3) AS predicted").collect()), key=str)
    want = [(i, float(model.score(quality.features(t)[None])[0])) for i, t in extra]
    assert [(i, pytest.approx(x), int(x >= 0.3)) for i, x in sorted(want, key=str)] == got
    assert quality.quality_scores(more, y.limit(0)).count() == len(extra)


def grades_table(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(1500):
        g = rng.randrange(4)
        docs.append((i, passage(rng, 25) + " rude1" * g))
        labels.append((i, g))
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_four_grades_end_to_end(spark):
    docs, labels, d, y = grades_table(spark)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(d, y).collect()}
    means = [np.mean([got[i].expected_severity for i, g in labels if g == k and held_out(i)]) for k in range(4)]
    assert means == sorted(means) and means[0] < 0.7 and means[3] > 2.3
    assert np.mean([abs(got[i].grade - g) for i, g in labels if held_out(i)]) < 0.4
    assert {r.grade for r in got.values()} == {0, 1, 2, 3} and all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_matches_a_fit_and_scores_in_plain_python(spark):
    """The model of train() is that of fit() on the same rows; scores, of odd texts too, follow from it."""
    docs, labels, d, y = grades_table(spark)
    extra = [(None, "rude1 rude1"), (9000, None), (9001, ""), (9002, "rude1 " * 40_000), (9003, docs[5][1]), (9003, docs[5][1])]
    model = toxicity.train(d, y)
    used = [(i, t, g) for (i, t), (_, g) in zip(docs, labels) if not held_out(i)]
    counts = [toxicity.counts_of(t) for _, t, _ in used]
    own = toxicity.fit([k for k, _, _ in counts], [toxicity.weight_of_count(c, n) for _, c, n in counts], np.array([g for _, _, g in used]), 4)
    assert model.weights == pytest.approx(own.weights) and np.allclose(model.theta, own.theta)
    more = spark.createDataFrame([(i, t, 1, "y") for i, t in docs[:50] + extra], "doc_id long, text string, grade int, score string")
    got = sorted(((r.doc_id, r.expected_severity, r.grade, r.score) for r in toxicity.toxicity_scores(more.union(d.where("doc_id >= 50").selectExpr("*", "1", "'y'")), y).collect() if r.doc_id is None or r.doc_id < 50 or r.doc_id >= 9000), key=str)
    want = []
    for i, t in docs[:50] + extra:
        keys, c, n = toxicity.counts_of(t)
        x = sum(own.weights.get(k, 0) * toxicity.weight_of_count(v, n) for k, v in zip(keys.tolist(), c.tolist()))
        above = own.above(np.array([x]))[0]
        want.append((i, pytest.approx(above.sum(), abs=1e-6), int((above >= 0.5).sum()), pytest.approx(above.sum() / 3, abs=1e-6)))
    assert got == sorted(want, key=lambda r: str((r[0], r[1].expected, r[2], r[3].expected)))


def test_toxicity_takes_the_largest_of_several_labels_and_bounds_the_fit(spark):
    _, _, d, y = grades_table(spark)
    twice = y.union(y.withColumn("toxic", F.lit(0)))
    one, two = toxicity.train(d, y), toxicity.train(d, twice)
    assert one.weights == two.weights
    few = toxicity.train(d, y, fit_entries_=4000)
    assert few.weights != one.weights and len(few.theta) in (1, 2, 3)


def test_toxicity_on_held_out_rows(labelled, docs, empty):
    _, labels, d, y = labelled
    got = {r.doc_id: r for r in toxicity.toxicity_scores(d, y).collect()}
    right = [got[i].predicted == t for i, _, t in labels if held_out(i)]
    assert sum(right) / len(right) > 0.97
    assert toxicity.toxicity_scores(empty, y).count() == 0
    assert toxicity.toxicity_scores(docs, y.limit(0)).count() == docs.count()


def test_a_recurring_document_counts_once(spark):
    """40 labelled documents, one of them on most rows: the models are those of the 40 documents, in any row order."""
    texts = [(i, ("good prose and words " if i % 2 else "bad 0x7f junk ##") * 3 + str(i)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(texts, "doc_id long, text string")
    hot = spark.createDataFrame([texts[1]] * 400 + texts, "doc_id long, text string").repartition(3)
    one, two = (quality.train(d, labels, positive_rows=50, unlabelled_rows=50) for d in (once, hot))
    assert one.prior == two.prior and np.array_equal(one.mean, two.mean) and np.allclose(one.hidden, two.hidden)
    one, two = (toxicity.train(d, labels, fit_rows=50) for d in (once, hot))
    assert one.weights.keys() == two.weights.keys() and np.allclose(one.theta, two.theta)
    known = labels.selectExpr("doc_id", "toxic AS y")
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (2, None), (99, "c")], "doc_id long, text string")
    got, again = (sorted(map(tuple, common.labelled_texts(d, known).collect())) for d in (pairs, pairs.orderBy(F.desc("text"))))
    assert got == again and [r[0] for r in got] == [1, 2] and got[1][2] is None


def test_thresholds_share_weights_and_stay_ordered():
    rng = np.random.default_rng(4)
    rows, grade = [], []
    for _ in range(600):
        n = int(rng.integers(0, 4))
        grade.append(n)
        rows.append(np.array(sorted({1, *range(10, 10 + n), int(rng.integers(100, 130))}), np.uint64))
    model = toxicity.fit(rows, [np.ones(len(r)) for r in rows], np.array(grade), 4)
    assert (np.diff(model.theta) > 0).all()
    severity = [model.above(np.array([sum(model.weights.get(k, 0) for k in r.tolist())])).sum() for r in rows]
    means = [np.mean([s for s, g in zip(severity, grade) if g == k]) for k in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 2


def test_shards_are_minimax(docs, texts, empty):
    rows = sharding.shard_documents(docs.drop("size"), 4).collect()
    assert len(rows) == len(texts)
    order, groups = [], {}
    for i, t in texts:
        if t not in groups:
            order.append(t)
            groups[t] = 0
        groups[t] += len((t or "").encode()) + 1
    loads = [sum(r.size for r in rows if r.shard == s) for s in range(4)]
    assert max(loads) == brute.minimax(tuple(groups[t] for t in order), 4)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    where = {}
    for r in rows:
        assert where.setdefault(r.text, r.shard) == r.shard
        assert r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.law == "bytes" and r.grown_shard is None
    assert sharding.shard_documents(empty, 4).count() == 0


def test_narrowing_passes_agree_with_the_driver_search(spark, monkeypatch):
    rng = random.Random(6)
    sizes = [rng.randrange(1, 50) for _ in range(60)]
    ends = spark.createDataFrame([(sum(sizes[: i + 1]),) for i in range(60)], "end long")
    want = sharding.minimax_cuts(ends, sum(sizes), max(sizes), 5)
    monkeypatch.setattr(sharding, "DRIVER_ENDS", 3)
    assert sharding.minimax_cuts(ends, sum(sizes), max(sizes), 5) == want
    assert max(b - a for a, b in zip([0, *want], want)) == brute.minimax(tuple(sizes), 5)


def test_mix_targets_and_copies(docs, texts, empty):
    sizes, by_source = {}, {}
    for r in docs.collect():
        sizes[r.doc_id] = len(brute.space_words(r.text))
        by_source[r.source] = by_source.get(r.source, 0) + sizes[r.doc_id]
    want = brute.mix_targets(by_source)
    source = {r.doc_id: r.source for r in docs.collect()}
    got = mixing.mix_counts(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.size, r.source_size) == (sizes[r.doc_id], by_source[source[r.doc_id]])
        assert r.target == pytest.approx(want[source[r.doc_id]])
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + 1) and r.taken == r.copies * r.size <= 3 * r.size
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mix_counts(empty).count() == 0 == mixing.mix(empty).count()
    assert sorted(map(str, mixing.mix_counts(docs).collect())) == sorted(map(str, got))
