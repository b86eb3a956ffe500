"""Assets, samples, metrics, learning, sources, store and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.ml import kernels, rpt
from cairn.ml.classify import as_features, importance_by_scale, knn, make_classifier
from cairn.ml.embed import affinities, embed_plane, tsne
from cairn.operators import assets as A
from cairn.operators import color, metrics, sampling
from cairn.plans import workflow
from cairn.sources import readers
from cairn.sources.store import CloudStore


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, (rng.normal(0, 0.4, 4) + np.eye(4)[i % 3] * 3).tolist()) for i in range(240)]
    return spark.createDataFrame(rows, "id long, label int, feats array<double>").cache()


def test_assets(spark):
    a = spark.createDataFrame([(i, i % 100, [float(i % 100), 1.0]) for i in range(200)], "pos long, id long, value array<double>")
    one = A.unique_first(a)
    assert one.count() == 100
    two = spark.createDataFrame([(i, i) for i in range(50, 150)], "id long, value long")
    got = A.intersection([one, two]).orderBy("id").collect()
    assert [r.id for r in got] == list(range(50, 100)) and all(len(r.value) == 3 and r.value[2] == r.id for r in got)
    with pytest.raises(ValueError):
        A.intersection([])
    first = spark.createDataFrame([(1, 10), (0, 20)], "pos long, value long").withColumn("id", F.lit(3))
    assert A.unique_first(first).first().value == 20


def test_labels(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 3, [3.0, 4.0]), (3, None, [5.0, 6.0])], "id long, label int, feats array<double>")
    assert {r.label: r.n for r in A.label_population(df).collect()} == {0: 1, 1: 0, 2: 0, 3: 1}
    assert A.collapse_labels(df, [0, 3]).where("label = 0").count() == 2
    assert [r.feats for r in A.drop_features(df, [0]).orderBy("id").collect()] == [[2.0], [4.0], [6.0]]
    marked = df.withColumn("label", A.label_to_file())
    assert marked.where("label = 999").count() == 1 and readers.from_labelled_file(marked).where("label IS NULL").count() == 1


def test_samples(spark, blobs):
    split = sampling.balanced_split(blobs, 4)
    assert {(r.label, r.fold): r["count"] for r in split.groupBy("label", "fold").count().collect()} == {(k, f): 40 for k in range(3) for f in range(2)}
    assert split.select("id").distinct().count() == 240
    again = sampling.balanced_split(blobs.repartition(7), 4)
    assert split.select("id", "fold").exceptAll(again.select("id", "fold")).count() == 0
    assert sampling.balanced_split(blobs.limit(0), 4).count() == 0
    trees = sampling.disjoint_balanced(blobs, 5, 1)
    assert trees.count() == 240 and trees.select("tree").distinct().count() == 5
    some = blobs.withColumn("label", F.when(F.col("id") < 40, F.col("label")))
    assert sampling.skip_sample(some, 7, 1).count() == 40 + 200 // 7
    assert sampling.skip_sample(some, 0, 1).count() == 40 and sampling.skip_sample(some, 1, 1).count() == 240


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(3, 1)], "assigned int, known int")
    conf = metrics.confusion_matrix(df)
    assert conf.count() == 16 and conf.agg(F.sum("n")).first()[0] == 7
    got = {r.label: (r.user, r.producer) for r in metrics.user_producer(conf).collect()}
    assert got[0] == (75.0, 100.0) and got[1] == (100.0, 50.0) and got[2] == (None, None) and got[3] == (0.0, None)
    assert metrics.dilate(conf, 2).count() == 64
    assert "3" in metrics.format_confusion(conf)
    assert metrics.confusion_matrix(df.limit(0)).count() == 0


def test_colors(spark):
    df = spark.createDataFrame([(0, 1.0), (8, 0.0), (8, 0.5), (11, 1.0)], "label int, prob double")
    rows = [(r.r, r.g, r.b) for r in color.color_by_probability(df).coalesce(1).collect()]
    assert rows == [(255.0, 20.0, 147.0), (255.0, 255.0, 255.0), (127.5, 127.5, 191.5), (None, None, None)]


def test_random_projection_trees(blobs):
    book = rpt.fit(blobs, trees=5, min_obs=5)
    rules = {(r.tree, r.tag): r for r in book.collect()}
    assert len({t for t, _ in rules}) == 5 and all((t, tag >> 1) in rules for t, tag in rules if tag > 1)
    for how in ("wmean", "wmax"):
        got = rpt.predict(rpt.walk(blobs, book), how).join(blobs.select("id", F.col("label").alias("y")), "id")
        assert got.where("label = y").count() / 240 > 0.85
    with pytest.raises(ValueError):
        rpt.decide(rpt.walk(blobs, book), "other")


def test_bounded_trees_stay_balanced(spark):
    """Ids follow labels: the smallest ids of a sample are all of one label."""
    rng = np.random.default_rng(6)
    rows = [(i, i // 200, (rng.normal(0, 0.4, 4) + np.eye(4)[i // 200] * 3).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, label int, feats array<double>")
    some = sampling.disjoint_balanced(df, 2, 1, 60)
    assert {(r.tree, r.label): r["count"] for r in some.groupBy("tree", "label").count().collect()} == {(t, k): 20 for t in range(2) for k in range(3)}
    assert some.select("id").distinct().count() == 120
    book = rpt.fit(df, trees=2, min_obs=5, rows=60)
    roots = {r.tree: r.props for r in book.where("tag = 1").collect()}
    assert len(roots) == 2 and all(p == pytest.approx([1 / 3] * 3) for p in roots.values())
    assert {r.label for r in rpt.predict(rpt.walk(df, book)).select("label").distinct().collect()} == {0, 1, 2}
    few = sampling.disjoint_balanced(df, 2, 1, 2)
    assert few.groupBy("tree", "label").count().where("count = 1").count() == 6


@pytest.mark.parametrize("name", ["svm", "rf", "erf", "nb", "sgd"])
def test_classifiers(blobs, name):
    model = make_classifier(name).fit(as_features(blobs))
    assert model.transform(as_features(blobs)).where("prediction = label").count() / 240 > (0.5 if name == "nb" else 0.9)


def test_workflow(blobs):
    model, conf = workflow.train_validate(blobs, "rf", numTrees=5)
    assert conf.where("assigned = known").agg(F.sum("n")).first()[0] > 100
    assert workflow.apply_model(model, blobs).where("prob IS NULL").count() == 0
    assert workflow.apply_model(model, blobs, "evaluate", trials=2).where("assigned = known").agg(F.min("mean")).first()[0] > 30
    assert workflow.train_validate(blobs, "rf", positive=1, numTrees=5)[1].count() == 4
    assert workflow.train_blind(blobs, "rf", numTrees=3) is not None
    assert knn(blobs.where("id < 120"), blobs.where("id >= 120")).join(blobs.select("id", F.col("label").alias("y")), "id").where("label = y").count() > 110
    assert importance_by_scale([1, 2, 3, 4], 2) == [3, 7]
    with pytest.raises(ValueError):
        make_classifier("other")


def test_kernels_and_factors(blobs):
    x = {r.id: np.array(r.feats) for r in blobs.collect()}
    for mapped, gamma in ((kernels.random_fourier(blobs, 4, 0.05, 4000), 0.05), (kernels.nystroem(blobs, 0.05, 60), 0.05)):
        z = {r.id: np.array(r.feats) for r in mapped.where("id < 10").collect()}
        for i in range(9):
            assert z[i] @ z[i + 1] == pytest.approx(np.exp(-gamma * ((x[i] - x[i + 1]) ** 2).sum()), abs=0.08)
    cov = np.cov(np.stack(list(x.values())), rowvar=False, ddof=0)
    load, noise = kernels.factor_model(cov, 2)
    assert np.abs(load.T @ load + np.diag(noise) - cov).max() < 0.2
    assert len(kernels.factor_analysis(blobs, 4, 2).first().feats) == 2


def test_covariance_of_wide_rows(spark):
    x = np.random.default_rng(4).normal(0, 1, (300, 64)) @ np.random.default_rng(5).normal(0, 1, (64, 64)) + 1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, feats array<double>").repartition(5)
    mean, cov = kernels.covariance_matrix(df, 64)
    assert np.allclose(mean, x.mean(0), rtol=1e-12) and np.allclose(cov, np.cov(x, rowvar=False, ddof=0), atol=1e-7)
    gaps = spark.createDataFrame([(0, [1.0, None, float("nan")]), (1, [3.0]), (2, None)], "id long, feats array<double>")
    mean, cov = kernels.covariance_matrix(gaps, 3)
    assert np.allclose(mean, [4 / 3, 0, 0]) and np.allclose(cov, np.diag([14 / 9, 0, 0]))
    assert not kernels.covariance_matrix(gaps.limit(0), 3)[1].any()


def test_factor_scores_read_every_component(spark):
    from cairn import queries as Q

    sf_dir = "/root/testdata/sf0.001"
    got = {r.id: r.feats for r in Q.queries()["factor_scores"](spark, sf_dir).collect()}
    rows = {r.id: np.array(r.feats) for r in Q.emb(spark, sf_dir).collect()}
    x = np.stack([rows[i] for i in got])
    load, noise = kernels.factor_model(np.cov(x, rowvar=False, ddof=0), 4)
    beta = np.linalg.solve(np.eye(4) + (load / noise) @ load.T, load / noise)
    assert load.shape == (4, 64) and np.allclose(np.stack(list(got.values())), (x - x.mean(0)) @ beta.T, atol=1e-6)


def test_model_queries_use_the_defaults(spark, monkeypatch):
    from cairn import queries as Q

    fit, trees, params, sf_dir = rpt.fit, [], [], "/root/testdata/sf0.001"
    monkeypatch.setattr(rpt, "fit", lambda *a, **k: trees.append((a[1:], k)) or fit(*a, **k))
    monkeypatch.setattr(workflow, "make_classifier", lambda name, **k: params.append(k) or make_classifier(name, **k))
    assert len(Q.queries()["fourier_features"](spark, sf_dir).first().feats) == 100
    for name in ("rpt_ensemble", "forest_confusion"):
        Q.queries()[name](spark, sf_dir)
    assert trees == [((), {})] and params == [{}]


def test_sources_and_store(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2,3,9\n4,5,6,8\n")
    (tmp_path / "b.txt").write_text("1 2 3\n")
    np.save(tmp_path / "c.npy", np.arange(10.0).reshape(2, 5))
    assert sorted((r.x, r.feats) for r in readers.read_cloud(spark, f"{tmp_path}/a.csv", columns=4).collect()) == [(1.0, [9.0]), (4.0, [8.0])]
    both = readers.labelled_cloud(spark, [(2, [f"{tmp_path}/b.txt"], [f"{tmp_path}/c.npy"])])
    assert sorted((r.label is None, r.x) for r in both.collect()) == [(False, 1.0), (True, 0.0), (True, 5.0)]
    with pytest.raises(ValueError):
        readers.read_cloud(spark, "x.unknown")
    store = CloudStore(spark, f"file://{tmp_path}/cloud")
    store.ingest(both.select("id", "x", "y", "z"), voxel_edge=1.0)
    assert store.points().count() == 3
    p, schema = store.points().first().id, "pos long, id long, label int, feats array<double>"
    store.add_set("s", spark.createDataFrame([(0, p, 5, [1.0, float("nan"), float("inf")]), (1, p, 6, [0.0, 0.0, 0.0])], schema))
    for bad in ([(0, 1, 5, [1.0])], [(0, None, 5, [1.0])]):  # an id outside the cloud, a null one
        with pytest.raises(ValueError):
            store.add_set("bad", spark.createDataFrame(bad, schema))
    for bad in ([(p, 5, [1.0]), (p, 6, [1.0])], [(r.id, 1, [1.0] * (i + 1)) for i, r in enumerate(store.points().collect())]):  # repeated ids, ragged feats
        with pytest.raises(ValueError):
            store.add_set("bad", spark.createDataFrame(bad, "id long, label int, feats array<double>"))
    assert store.tags() == ["s"]
    assert store.feats("s").first().feats == [1.0, 0.0, 1.7976931348623157e308] and store.index("s").first().label == 5
    assert [tuple(r) for r in store.describe_sets().collect()] == [("s", 1, True, False, 3)]
    with pytest.raises(ValueError):
        store.add_set("s", store.index("s"))
    with pytest.raises(KeyError):
        store.index("none")
    store.drop_set("none")
    store.drop_set(None)
    assert store.tags() == []
    with pytest.raises(ValueError):
        store.drop_cloud()
    readers.export_colored(spark.createDataFrame([(1.0, 2.0, 3.0, 4, 5, 6)], "x double, y double, z double, r int, g int, b int"), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").first()[0] == "1.000,2.000,3.000,4.000,5.000,6.000"


def test_npy_files_are_read_in_runs(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(250, 5))
    np.save(tmp_path / "c.npy", m)
    np.save(tmp_path / "f.npy", np.asfortranarray(m.astype(np.float32)))
    for name, want in (("c", m), ("f", m.astype(np.float32).astype(float))):
        got = sorted((r.x, r.y, r.z, *r.feats) for r in readers.read_npy(spark, f"{tmp_path}/{name}.npy", rows=33).collect())
        assert got == sorted(map(tuple, want.tolist()))
    np.save(tmp_path / "bad.npy", m[:, :2])
    with pytest.raises(Exception, match="three columns"):
        readers.read_npy(spark, f"{tmp_path}/bad.npy").collect()


def test_far_clouds_are_recentred_on_ingest(spark, tmp_path):
    df = spark.createDataFrame([(0, 100.0, 0.0, 0.0), (1, 102.0, 0.0, 0.0)], "id long, x double, y double, z double")
    store = CloudStore(spark, f"file://{tmp_path}/far")
    assert store.ingest(df, far=200.0) == (0.0, 0.0, 0.0) and store.ingest(df, far=50.0) == (101.0, 0.0, 0.0)
    assert sorted(r.x for r in store.points().collect()) == [-1.0, 1.0]
    labelled = df.withColumn("label", F.when(F.col("id") == 1, 4)).withColumn("feats", F.array(F.lit(1.0)))
    store.add_labelled(labelled)
    assert [(r.id, r.label) for r in store.index("hand labeled").collect()] == [(1, 4)]


def test_archive_features(spark, tmp_path):
    from cairn.plans.archive import archive_features
    from cairn.plans.multiscale import multi_radius, vector_multiscale

    rng = np.random.default_rng(6)
    rows = [(i, *map(float, p), i % 4 if i % 3 == 0 else None, [float(i), float(i % 7)]) for i, p in enumerate(rng.random((90, 3)))]
    cloud = spark.createDataFrame(rows, "id long, x double, y double, z double, label int, feats array<double>")
    points, store = cloud.select("id", "x", "y", "z"), CloudStore(spark, f"file://{tmp_path}/archive")
    store.ingest(points)
    store.add_set("all", cloud.select("id", "label", "feats"))
    scales = [(0.1, [0.5, 0.3]), (0.2, [0.6])]
    got = {r.id: r for r in archive_features(store, "all", scales, skip=4, seed=2, save_as="f").collect()}
    assert len(got) == 30 + 15 and sum(r.label is not None for r in got.values()) == 30 and len(got[0].feats) == 12
    first, second = ({r.qid: list(r)[1:] for r in multi_radius(points, points, e, radii).collect()} for e, radii in scales)
    assert all(r.feats == pytest.approx(first[i] + second[i]) for i, r in got.items())
    assert {r.id for r in archive_features(store, "all", scales[:1], "cov", skip=0).collect()} == set(range(0, 90, 3))
    valued = cloud.select("id", "x", "y", "z", F.col("feats")[0].alias("v0"), F.col("feats")[1].alias("v1"))
    means = {r.qid: list(r)[1:] for r in vector_multiscale(points, valued.where("id % 3 <> 0"), ["v0", "v1"], 0.2, [0.5]).collect()}
    got = archive_features(store, "all", [(0.2, [0.5])], "vector", search="unlabelled", columns=2).collect()
    assert len(got) == 90 and all(r.feats == pytest.approx(means[r.id]) for r in got)
    with pytest.raises(ValueError):
        archive_features(store, "all", scales, search="some")


def test_predictions_are_stored_and_exported(spark, blobs, tmp_path):
    model = make_classifier("rf", numTrees=5).fit(as_features(blobs))
    points = blobs.select("id", *(F.col("feats")[k].alias(c) for k, c in enumerate("xyz")))
    store = CloudStore(spark, f"file://{tmp_path}/predicted")
    store.ingest(points)
    store.add_set("all", blobs)
    assert workflow.save_predictions(model, store, "all", "labels").join(blobs.select("id", F.col("label").alias("y")), "id").where("label = y").count() > 230
    assert all(len(r.feats) == 3 and sum(r.feats) == pytest.approx(1) for r in workflow.save_predictions(model, store, "all", "p", "probabilities").collect())
    workflow.export_predictions(model, points.join(blobs.select("id", "feats"), "id"), f"{tmp_path}/colored")
    assert spark.read.csv(f"{tmp_path}/colored").count() == 240 and len(spark.read.csv(f"{tmp_path}/colored").columns) == 6


def test_refit_without_scales_and_leaf_embedding(blobs):
    wide = blobs.withColumn("feats", F.concat("feats", F.array(F.lit(0.0), F.lit(0.0))))
    shares, model, conf = workflow.refit_without_scales(wide, 2, [2], numTrees=5)
    assert shares[2] == 0 and sum(shares) == pytest.approx(1) and model.numFeatures == 4 and conf.count() == 9
    nb = make_classifier("nb", embedding=True, trees=5, depth=3).fit(as_features(blobs))
    assert nb.transform(as_features(blobs)).where("prediction = label").count() > 220


def test_hinge_loss_with_l1(spark, blobs):
    noisy = blobs.withColumn("feats", F.concat("feats", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(100)) / 100.0)))
    plain = make_classifier("sgd").fit(as_features(noisy))
    sparse = make_classifier("sgd", regParam=0.05, elasticNetParam=1.0).fit(as_features(noisy.repartition(5)))
    assert all(m.transform(as_features(noisy)).where("prediction = label").count() > 225 for m in (plain, sparse))
    assert (sparse.weights[4:] == 0).mean() > 0.8 > (plain.weights[4:] == 0).mean()
    assert make_classifier("sgd", loss="log").fit(as_features(blobs)).transform(as_features(blobs)).where("prediction = label").count() > 225
    assert workflow.apply_model(plain, noisy).where("prob = 1").count() == 240


def test_extremely_randomised_trees(spark, blobs):
    from cairn.ml.extra import ExtraTrees, grow

    rng = np.random.default_rng(0)
    x, y = rng.random((200, 3)), rng.integers(0, 3, 200)
    child, feature, split, props, gain = grow(x, y, 3, 50, 1, rng)
    for row, label in zip(x, y):  # grown out, every training row has a leaf of its own label
        at = 0
        while child[at] >= 0:
            at = child[at] + (row[feature[at]] > split[at])
        assert props[at][label] == 1
    assert gain.sum() == pytest.approx(200 - (np.bincount(y) ** 2).sum() / 200)
    model = ExtraTrees(numTrees=5, tree_rows=120).fit(as_features(blobs))
    done = model.transform(as_features(blobs.limit(0).union(blobs)))
    again = ExtraTrees(numTrees=5, tree_rows=120).fit(as_features(blobs.repartition(7)))
    assert done.where("prediction = label").count() > 220 and model.featureImportances == again.featureImportances
    assert model.featureImportances[3] < 0.1 and sum(model.featureImportances) == pytest.approx(1)
    with pytest.raises(ValueError):
        ExtraTrees().fit(as_features(blobs.limit(0)))


@pytest.mark.parametrize("block", [64_000_000, 1500])
def test_knn_matches_brute_force(spark, block):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (120, 3)).astype(float)
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, label int, feats array<double>")
    got = {r.id: r.label for r in knn(df.where("id < 80"), df, 5, block).collect()}
    for i in range(120):
        near = sorted(range(80), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:5]
        votes = [sum(j % 3 == c for j in near) for c in range(3)]
        assert got[i] == votes.index(max(votes))
    assert knn(df.limit(0), df).count() == 0


@pytest.mark.parametrize("init", ["pca", "random"])
def test_groups_stay_together_in_the_plane(init):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.3, (40, 5)) + 4 * np.eye(5)[k] for k in range(3)])
    y = tsne(x, perplexity=10, steps=400, init=init)
    assert np.array_equal(y, tsne(x, perplexity=10, steps=400, init=init))
    d = np.linalg.norm(y[:, None] - y[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert (d.argmin(1) // 40 == np.arange(120) // 40).mean() > 0.95


def test_affinities_have_the_perplexity_that_is_asked_for():
    x = np.random.default_rng(4).normal(size=(60, 3))
    x[50:] = x[49]  # equal rows
    p = affinities(x, 8.0)
    assert np.allclose(p, p.T) and abs(p.sum() - 1) < 1e-6
    d2 = ((x[:1] - x[1:50]) ** 2).sum(1)
    near = np.argsort(d2)[:20]
    assert p[0, 1 + near[0]] > p[0, 1 + near[-1]]


def test_plane_of_odd_sets(spark, blobs):
    for n in (0, 1):
        assert np.array_equal(tsne(np.ones((n, 3))), np.zeros((n, 2)))
    assert not tsne(np.ones((5, 3))).any() and np.isfinite(tsne(np.array([[0.0], [1.0], [5.0]]), steps=50)).all()
    with pytest.raises(ValueError):
        tsne(np.ones((3, 2)), init="other")
    assert embed_plane(blobs.limit(0)).count() == 0
    some = embed_plane(blobs, {0: 6, 2: 3}, steps=20)
    assert {r.label: r["count"] for r in some.groupBy("label").count().collect()} == {0: 6, 2: 3}
    even = embed_plane(blobs, rows=12, steps=20)
    assert {r.label: r["count"] for r in even.groupBy("label").count().collect()} == {0: 4, 1: 4, 2: 4}
    with pytest.raises(ValueError):
        embed_plane(blobs, {0: 13}, rows=12)
    odd = spark.createDataFrame([(1, 0, [float("nan"), 1.0]), (2, 0, [None, 2.0]), (3, 1, [1.0, 5.0]), (4, 1, [2.0, 1.0]), (5, None, [0.0, 0.0])], "id long, label int, feats array<double>")
    assert embed_plane(odd, steps=20).where("x is not null and not isnan(x)").count() == 4


def test_formatted_metrics(spark):
    conf = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 0, 1), (1, 1, 3)], "assigned int, known int, n long")
    assert metrics.format_three(metrics.three_metrics(conf)).splitlines()[0].split() == ["0", "75.00", "25.00", "25.00"]


def test_streaming_matches_batch(spark, tmp_path):
    from cairn.plans.multiscale import one_scale
    from cairn.streaming.incremental import stream_features

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.random((30, 3)))], "id long, x double, y double, z double")
    df.write.parquet(f"{tmp_path}/in")
    q = stream_features(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), df, 0.2, 0.4, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    want = one_scale(df, df, 0.2, 0.4)
    assert sorted((r.qid, r.population) for r in got.collect()) == sorted((r.qid, r.population) for r in want.collect())
