"""Golden facts and brute force for grids, neighbourhoods and features."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.cloud import PointCloud
from cairn.functions.geometry import with_eigenvalues
from cairn.operators import neighbors, regions
from cairn.operators import voxel as V
from cairn.operators.features import REGISTERED, register_feature
from cairn.operators.neighbors import distance_matrix, radius_join
from cairn.plans import multiscale as M


def cloud(spark, points, start=0):
    return spark.createDataFrame([(start + i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double")


def test_grid_facts(spark):
    box = cloud(spark, [(0, 0, 0), (100, 100, 100)])
    grid = V.VoxelGrid.fit(box, 0.001)
    assert grid.widths == (17, 17, 17) and grid.shifts == (0, 17, 34)
    with pytest.raises(ValueError):
        V.VoxelGrid.fit(box, 1e-5)
    with pytest.raises(ValueError):
        V.VoxelGrid.fit(box, 1e-8, ("x", "y"))
    grid = V.VoxelGrid.fit(box, 1.0)
    assert grid.min_corner == (-0.5,) * 3 and grid.max_corner == (100.5,) * 3
    assert grid.widths == (7, 7, 7) and grid.masks == (0b1111111, 0b1111111 << 7, 0b1111111 << 14)
    row = cloud(spark, [(10, 11, 12)]).select(grid.address().alias("a")).select("a", *grid.centers(F.col("a"))).first()
    assert tuple(row) == (198026, 10.0, 11.0, 12.0)
    assert grid.check_bounds(cloud(spark, [(-0.5, 0, 0), (100.5, 0, 0)])).count() == 2
    for bad in (-1.5, 101.5):
        with pytest.raises(ValueError):
            grid.check_bounds(cloud(spark, [(bad, 0, 0)]))


def test_grid_rejects(spark):
    with pytest.raises(ValueError):
        V.VoxelGrid.fit(cloud(spark, [(0, 0, 0)]), 1.0)
    with pytest.raises(ValueError):
        V.VoxelGrid.fit(cloud(spark, [(0, 0, 0), (1, 1, 1)]), 1.0, ("x",))
    flat = V.VoxelGrid.fit(cloud(spark, [(0, 0, 5), (9, 9, 5)]), 1.0)
    assert flat.widths[2] == 1


def test_even_diagonal(spark):
    points = cloud(spark, [(k, k, k) for k in range(0, 20, 2) for _ in (0, 1)])
    got = sorted(tuple(r) for r in V.unique_voxels(points, 0.5).collect())
    assert got == [(float(k),) * 3 for k in range(0, 20, 2)]
    assert sorted(r.id for r in V.first_points(points, 0.5).collect()) == list(range(0, 20, 2))
    assert V.unique_voxels(points.limit(0), 0.5).count() == 0
    assert len(V.neighbor_offsets()) == 26 and len(V.neighbor_offsets(3, True)) == 6 and len(V.neighbor_offsets(2)) == 8


def features(q, points, r):
    near = points[((points - q) ** 2).sum(1) <= r * r]
    n = len(near)
    centroid = np.linalg.norm(q - near.mean(0)) if n else 0.0
    eig = np.zeros(2)
    if n > 1:
        w = np.linalg.eigvalsh(np.cov(near, rowvar=False))
        if w.sum() > 0:
            eig = (w / w.sum())[[2, 1]]
    return n, centroid, *eig


def test_one_scale_matches_brute_force(spark):
    rng = np.random.default_rng(10)
    q, s = rng.random((150, 3)), rng.random((400, 3))
    far = np.vstack([q, [[9, 9, 9]]])
    voxels = np.array([tuple(r) for r in V.unique_voxels(cloud(spark, s), 0.1).collect()])
    got = {r.qid: tuple(r)[1:] for r in M.one_scale(cloud(spark, far), cloud(spark, s), 0.1, 0.2).collect()}
    assert len(got) == 151
    for i, p in enumerate(far):
        assert got[i] == pytest.approx(features(p, voxels, 0.2), abs=1e-7)
    parts = [M.one_scale(cloud(spark, far[a:b], a), cloud(spark, s), 0.1, 0.2).collect() for a, b in ((0, 70), (70, 151))]
    assert {r.qid: r.population for part in parts for r in part} == {i: v[0] for i, v in got.items()}


def test_small_neighbourhoods(spark):
    axes = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    row = M.one_scale(cloud(spark, [(0, 0, 0)]), cloud(spark, axes), 0, 1.0).first()
    assert row.population == 6 and (row.eig1, row.eig2) == pytest.approx((1 / 3, 1 / 3))
    same = M.one_scale(cloud(spark, [(5, 5, 5)]), cloud(spark, [(5, 5, 5)] * 3), 0, 1.0).first()
    assert (same.population, same.centroid, same.eig1, same.eig2) == (3, 0.0, 0.0, 0.0)
    one = M.one_scale(cloud(spark, [(0, 0, 0)]), cloud(spark, [(0.5, 0, 0)]), 0, 1.0).first()
    assert (one.population, one.centroid, one.eig1) == (1, 0.5, 0.0)
    line = M.one_scale(cloud(spark, [(0, 0, 0)]), cloud(spark, [(0.1, 0, 0), (0.2, 0, 0)]), 0, 1.0).first()
    assert (line.eig1, line.eig2) == pytest.approx((1.0, 0.0), abs=1e-8)


def test_profiles_and_radii(spark):
    rng = np.random.default_rng(3)
    q = cloud(spark, rng.random((60, 3)))
    many = {r.qid: r for r in M.multi_radius(q, q, 0, [0.2, 0.4]).collect()}
    for k, radius in enumerate((0.4, 0.2)):
        for r in M.one_scale(q, q, 0, radius, "gpu").collect():
            assert many[r.qid][f"s{k}_density"] == pytest.approx(r.density) and many[r.qid][f"s{k}_eig1"] == pytest.approx(r.eig1, abs=1e-9)
    low, high = ({r.qid: r.population for r in M.one_scale(q, q, 0, x).collect()} for x in (0.2, 0.4))
    assert all(low[i] <= high[i] for i in low)
    with pytest.raises(ValueError):
        M.multiscale(q, q, [0.1], [0.2, 0.3])


def test_radius_is_inclusive_only_where_asked(spark):
    q, s = cloud(spark, [(0, 0, 0)]), cloud(spark, [(1, 0, 0), (0, 0, 0)])
    assert radius_join(q, s, 1.0).count() == 2
    assert radius_join(q, s, 1.0, inclusive=False).count() == 1
    assert radius_join(q, s, 1.0, exclude_coincident=True).count() == 1
    with pytest.raises(ValueError):
        radius_join(q, s, 1.0, "taxi")
    with pytest.raises(ValueError):
        distance_matrix(q, s, max_search=1)


@pytest.mark.parametrize("metric,order", [("euclid", 2), ("cheby", np.inf)])
def test_distance_matrix_takes_every_pair(spark, monkeypatch, metric, order):
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    a, b = rng.random((30, 3)), rng.random((50, 3))
    for threshold in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = {(r.qid, r.sid): r.dist for r in distance_matrix(cloud(spark, a), cloud(spark, b), metric).collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert len(got) == 1500 and all(d == pytest.approx(np.linalg.norm(b[j] - a[i], order)) for (i, j), d in got.items())
    assert distance_matrix(cloud(spark, a).limit(0), cloud(spark, b), metric).count() == 0


def test_distance_matrix_has_no_largest_search_side(spark):
    many = spark.range(100_001).select("id", *(F.col("id").cast("double").alias(c) for c in "xyz"))
    got = distance_matrix(cloud(spark, [(0, 0, 0)]), many, "cheby")
    assert tuple(got.agg(F.count("*"), F.max("dist")).first()) == (100_001, 100_000.0)


def test_eigenvectors(spark):
    rng = np.random.default_rng(5)
    pts = rng.random((40, 3)) * [3, 2, 1]
    row = M.multi_radius(cloud(spark, [pts.mean(0)]), cloud(spark, pts), 0, [10.0], "eigvec").first()
    w, v = np.linalg.eigh(np.cov(pts, rowvar=False))
    for k, name in ((2, "v1"), (1, "v2")):
        vec = v[:, k] * np.sign(v[np.abs(v[:, k]).argmax(), k])
        assert (row[f"s0_{name}x"], row[f"s0_{name}y"]) == pytest.approx(tuple(vec[:2]), abs=1e-6)


def test_closed_form_eigenvalues(spark):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(200):
        c = np.cov(rng.normal(0, rng.random(3), (8, 3)), rowvar=False)
        rows.append((c, [*map(float, (c[0, 0], c[0, 1], c[0, 2], c[1, 1], c[1, 2], c[2, 2])), 8]))
    names = ["xx", "xy", "xz", "yy", "yz", "zz", "n"]
    df = spark.createDataFrame([r[1] for r in rows], names).coalesce(1)
    got = with_eigenvalues(df, {n: n for n in names[:-1]}, "n", ("a", "b", "c")).select("a", "b", "c").collect()
    for (c, _), g in zip(rows, got):
        w = np.linalg.eigvalsh(c)[::-1]
        assert tuple(g) == pytest.approx(tuple(w / w.sum()), abs=1e-8)


def test_regions(spark):
    rng = np.random.default_rng(7)
    q, s = cloud(spark, rng.random((500, 3))), cloud(spark, rng.random((900, 3)) * 3 - 1)
    a, b = regions.nested_regions(q, s, 0.5, (0.25,) * 3, (0.75,) * 3)
    assert a.where("x < 0.25 OR x > 0.75").count() == 0 and b.where("x < -0.25 OR x > 1.25").count() == 0
    assert [x.count() for x in regions.nested_regions(q, s, 0.5, (100.0,) * 3, (110.0,) * 3)] == [0, 0]
    with pytest.raises(ValueError):
        regions.nested_regions(q, s, -1.0, (0,) * 3, (1,) * 3)
    oq, os_ = regions.octants(q, s, (0.0, 0.0, 0.0), 0.5, 0.1)
    assert oq.count() == 500 and oq.select("octant").distinct().count() == 8
    for n, o in enumerate(itertools.product((0, 1), repeat=3)):
        box = oq.where(F.col("octant") == n).agg(F.min("x"), F.max("x")).first()
        assert box[0] >= o[0] * 0.5 and box[1] <= o[0] * 0.5 + 0.5
    assert regions.region_population(q, s, (0.0,) * 3, (1.0,) * 3, 0.01, 1000).first().fits
    leaves = regions.octree_leaves(q, 60, 1, 5)
    assert leaves.agg(F.sum("n")).first()[0] == 500 and leaves.where("n > 60 AND level < 5").count() == 0
    got = regions.batches(q.select("id"), 170, ["id"]).groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in got) == [(0, 170), (1, 170), (2, 160)]
    assert sorted(r.id for r in regions.every_kth(q.select("id"), 200, ["id"]).collect()) == [0, 200, 400]


def test_cloud(spark):
    c = PointCloud(cloud(spark, [(3, 4, 5), (4, 4, 5)])).validate().recenter()
    assert c.corner == (3.0, 4.0, 5.0)
    order = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "pos long, id long")
    assert [r.x for r in c.take(order).orderBy("pos").collect()] == [4.0, 3.0, 4.0]
    assert [r.x for r in c.take(order, False).orderBy("pos").collect()] == [1.0, 0.0, 1.0]
    assert PointCloud(c.df).recenter("centroid", threshold=1e5).corner == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        PointCloud(cloud(spark, [(float("nan"), 0, 0)])).validate()


def test_registered_features():
    register_feature("test_reach", lambda r: F.max("dx"))
    try:
        with pytest.raises(ValueError):
            register_feature("test_reach", lambda r: F.max("dx"))
    finally:
        REGISTERED.pop("test_reach")


def test_registered_features_are_computed(spark):
    q, s = cloud(spark, [(0, 0, 0), (50, 0, 0)]), cloud(spark, [(1, 0, 0), (2, 0, 0), (-3, 0, 0)])
    register_feature("test_reach", lambda r: F.max("dx") / r)
    try:
        one = {r.qid: r.test_reach for r in M.one_scale(q, s, 0, 4.0).collect()}
        two = {r.qid: r for r in M.multiscale(q, s, [0, 0], [4.0, 1.5]).collect()}
        many = {r.qid: r for r in M.multi_radius(q, s, 0, [1.5, 4.0]).collect()}
    finally:
        REGISTERED.pop("test_reach")
    assert one == {0: 0.5, 1: None}
    for got in (two, many):
        assert got[0].s0_test_reach == 0.5 and got[0].s1_test_reach == pytest.approx(1 / 1.5)
        assert got[1].s0_test_reach is None and got[1].s1_test_reach is None


def test_octree_partition_accept_and_split(spark):
    """A cloud that fits is one level of octants; more search points in the buffered boxes split it further."""
    from cairn.operators import regions as R

    rng = np.random.default_rng(10)
    q = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.random((400, 3)))], "id long, x double, y double, z double")
    s = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.random((900, 3)) * 1.4 - 0.2)], "id long, x double, y double, z double")
    root, buffer = R.OctreeRoot.of(q), 0.05
    assert {r.level for r in R.octree_leaves(q, 900, max_level=5, search=s, buffer=buffer, root=root).collect()} == {1}
    leaves = R.octree_leaves(q, 18, max_level=5, search=s, buffer=buffer, root=root)
    rows = leaves.collect()
    assert len({r.level for r in rows}) > 1 and sum(r.n for r in rows) == 400 and all(r.population <= 18 or r.level == 5 for r in rows)
    assert {r.level for r in R.octree_leaves(q, 18, max_level=5, search=s, buffer=buffer, root=root, min_radius=root.radius / 3).collect()} == {1}
    own, near = R.partition_rows(q, s, leaves, root, buffer)
    mine, around = own.collect(), near.collect()
    assert sorted(r.id for r in mine) == list(range(400)) and own.columns == [*q.columns, "level", "ix", "iy", "iz"]
    for r in rows:
        edge = 2 * root.radius / 2**r.level
        a = [v + i * edge for v, i in zip(root.low, (r.ix, r.iy, r.iz))]
        cell = (r.level, r.ix, r.iy, r.iz)
        assert all(all(lo <= p[c] < lo + edge for c, lo in zip("xyz", a)) for p in mine if (p.level, p.ix, p.iy, p.iz) == cell)
        want = {p.id for p in s.collect() if all(lo - buffer <= p[c] < lo + edge + buffer for c, lo in zip("xyz", a))}
        assert {p.id for p in around if (p.level, p.ix, p.iy, p.iz) == cell} == want and len(want) == r.population
    nothing = R.partition_rows(q, s, leaves.limit(0), root, buffer)
    assert nothing[0].count() == 0 == nothing[1].count()
    with pytest.raises(ValueError):
        R.partition_rows(q, s, leaves, root, -1.0)


def test_rigid_edge_shrinks_until_all_fit(spark):
    from cairn.operators import regions as R

    df = spark.range(1000).selectExpr("id", "double(id % 10) AS x", "double(int(id / 10) % 10) AS y", "double(int(id / 100)) AS z")
    edge = R.rigid_edge(df, 30, 20.0)
    assert edge < 20 and R.rigid_leaves(df, edge).agg(F.max("n")).first()[0] <= 30
    assert R.rigid_edge(df, 1000, 20.0) == 20.0
    with pytest.raises(ValueError):
        R.rigid_edge(df, 30, 20.0, min_edge=10.0)


def test_points_between_voxels(spark):
    from cairn.operators import voxel as V

    df = spark.createDataFrame([(i, i / 2, 0.0, 0.0) for i in range(6)], "id long, x double, y double, z double")
    assert sorted(r.x for r in V.unique_voxels(df, 1.0).collect()) == [0, 1, 2, 3]
    assert sorted(r.x for r in V.unique_voxels(df, 1.0, ties="even").collect()) == [0, 1, 2]


def test_scales_share_one_join(spark):
    from cairn.plans import multiscale as M

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.random((60, 3)))], "id long, x double, y double, z double")
    far = df.union(spark.createDataFrame([(99, 50.0, 50.0, 50.0)], df.schema))
    for profile in ("minimal", "gpu"):
        got = {r.qid: list(r)[1:] for r in M.multiscale(far, df, [0.1, 0.0, 0.1], [0.3, 0.2, 0.5], profile).collect()}
        each = [{r.qid: list(r)[1:] for r in M.one_scale(far, df, e, r0, profile).collect()} for e, r0 in ((0.1, 0.3), (0.0, 0.2), (0.1, 0.5))]
        assert len(got) == 61 and all(v == pytest.approx([x for one in each for x in one[i]]) for i, v in got.items())
