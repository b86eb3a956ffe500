"""One query for each point-cloud operator over whole tables, each with the same query in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.cloud import XYZ, PointCloud
from cairn.functions.geometry import UPPER, ball_volume_cm3
from cairn.ml import rpt
from cairn.operators import assets as A
from cairn.operators import color, metrics, regions, sampling
from cairn.operators import features as G
from cairn.operators import voxel as V
from cairn.operators.neighbors import distance_matrix, radius_join
from cairn.plans import multiscale as M
from cairn.plans.archive import archive_features
from cairn.plans.materialize import scratch
from cairn.sources.readers import export_colored, read_text
from cairn.sources.store import CloudStore

Query = Callable[[SparkSession, str], DataFrame]

#: Added before a value is rounded.
TIE = 1e-9

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Voxel edge and radius on the cloud of the first three embedding components.
EDGE, RADIUS = 0.05, 0.15
RADII = (0.15, 0.1)
#: Voxel edge and radius on the line items.
LI_EDGE, LI_RADIUS = 4.0, 6.0


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip().replace("round(", f"round({TIE} + ").replace(f"{TIE} + {TIE} + ", f"{TIE} + ")  # once, also in the SQL of another query
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a cloud: first three components, label, all components as feats."""
    e = _read(spark, sf_dir, "embeddings")
    at = [F.col("embedding")[i] for i in range(3)]
    return PointCloud.of(e, "vec_id", *at, "label", F.col("embedding").cast("array<double>").alias("feats")).df


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return PointCloud.of(e, "event_id", F.col("value"), F.col("user_id"), F.pmod(F.col("event_id"), F.lit(97))).df


def li_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


def prt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return PointCloud.of(p, "p_partkey", F.pmod("p_partkey", F.lit(50)), F.col("p_retailprice") / 20, F.pmod("p_partkey", F.lit(11))).df


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with what a rule on the length of the text assigns: (id, assigned, known)."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 600, 1).otherwise(0).alias("assigned"), F.col("quality").alias("known"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten classes: the label of an embedding and what a rule on its first component assigns."""
    step = F.least(F.greatest(F.floor((F.col("x") + 0.4) * 12.5), F.lit(0)), F.lit(9)).cast("int")
    return emb(spark, sf_dir).select("id", step.alias("assigned"), F.col("label").alias("known"))


P = "WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label, embedding FROM embeddings)"
EV = "WITH p AS (SELECT event_id AS id, CAST(value AS DOUBLE) AS x, CAST(user_id AS DOUBLE) AS y, CAST(event_id % 97 AS DOUBLE) AS z FROM events)"
KN = "WITH k AS (SELECT doc_id AS id, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS assigned, quality AS known FROM documents JOIN labels USING (doc_id))"
AS = "WITH k AS (SELECT vec_id AS id, CAST(least(greatest(floor((CAST(embedding[1] AS DOUBLE) + 0.4) * 12.5), 0), 9) AS INTEGER) AS assigned, label AS known FROM embeddings)"


def _cells(edge: float) -> str:
    """CTEs: o (lowest corner) and v (voxel indices of each point)."""
    idx = ", ".join(f"CAST(floor(({c} - (lo{c} - {edge} / 2)) / {edge}) AS BIGINT) AS i{c}" for c in XYZ)
    return f"o AS (SELECT {', '.join(f'min({c}) AS lo{c}' for c in XYZ)} FROM p), v AS (SELECT id, x, y, z, {idx}, {', '.join(f'lo{c}' for c in XYZ)} FROM p, o)"


def _voxels(edge: float) -> str:
    return f"{_cells(edge)}, u AS (SELECT DISTINCT {', '.join(f'lo{c} + i{c} * {edge} AS {c}' for c in XYZ)} FROM v)"


def _pairs(radius: float, search: str = "u", rule: str = "d2 <= {r} * {r}") -> str:
    rule = rule.format(r=radius)
    d = ", ".join(f"s.{c} - q.{c} AS d{c}" for c in XYZ)
    return f"n0 AS (SELECT q.id AS qid, {d} FROM p q, {search} s WHERE " + " AND ".join(f"s.{c} BETWEEN q.{c} - {radius} AND q.{c} + {radius}" for c in XYZ) + f"), n1 AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM n0), n AS (SELECT * FROM n1 WHERE {rule})"


_SUMS = "count(*) AS n, avg(dx) AS mx, avg(dy) AS my, avg(dz) AS mz, " + ", ".join(f"CASE WHEN count(*) > 1 THEN covar_samp(d{a}, d{b}) ELSE 0 END AS c{a}{b}" for a, b in UPPER)
_GROUPED = f"g AS (SELECT qid, {_SUMS} FROM n GROUP BY qid)"


def _eigen(source: str = "g") -> str:
    """CTE w: source plus eigenvalues w1, w2, w3 of its covariances."""
    return (
        f"e0 AS (SELECT *, cxx + cyy + czz AS tr, (cxx + cyy + czz) / 3.0 AS q FROM {source}), "
        "e1 AS (SELECT *, sqrt(((cxx-q)*(cxx-q) + (cyy-q)*(cyy-q) + (czz-q)*(czz-q) + 2.0*(cxy*cxy + cxz*cxz + cyz*cyz)) / 6.0) AS pp FROM e0), "
        "e2 AS (SELECT *, CASE WHEN pp > 0 THEN least(greatest(((cxx-q)*((cyy-q)*(czz-q) - cyz*cyz) - cxy*(cxy*(czz-q) - cyz*cxz) + cxz*(cxy*cyz - (cyy-q)*cxz)) / (2.0*pp*pp*pp), -1.0), 1.0) ELSE 0.0 END AS rr FROM e1), "
        "e3 AS (SELECT *, q + 2.0*pp*cos(acos(rr)/3.0) AS top, q + 2.0*pp*cos(acos(rr)/3.0 + 2.0943951023931953) AS low FROM e2), "
        "w AS (SELECT *, CASE WHEN n >= 2 AND tr > 0 THEN CASE WHEN pp > 0 THEN top/tr ELSE 1.0/3.0 END ELSE 0.0 END AS w1, "
        "CASE WHEN n >= 2 AND tr > 0 THEN CASE WHEN pp > 0 THEN (tr-top-low)/tr ELSE 1.0/3.0 END ELSE 0.0 END AS w2, "
        "CASE WHEN n >= 2 AND tr > 0 THEN CASE WHEN pp > 0 THEN low/tr ELSE 1.0/3.0 END ELSE 0.0 END AS w3 FROM e3)"
    )


def _r(column, places: int = 6):
    """Rounded, and never minus zero, off the ties that grids lead to, so that engines which sum in another order agree;
    register() moves the SQL's values in the same way."""
    return F.round(column + F.lit(TIE), places) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: _r(F.col(c), places) for c in columns})


# Bounds and voxels


@register(P + " SELECT " + ", ".join(f"{f}({c}) AS {f}_{c}" for f in ("min", "max") for c in XYZ) + " FROM p")
def bbox(spark, sf_dir):
    return PointCloud(emb(spark, sf_dir)).bounding_box()


@register(
    P + ", o AS (SELECT " + ", ".join(f"min({c}) - {EDGE}/2 AS lo_{c}, max({c}) + {EDGE}/2 AS hi_{c}" for c in XYZ) + " FROM p), l AS (SELECT "
    + ", ".join(f"greatest(1, CAST(ceil(log2((hi_{c} - lo_{c}) / {EDGE})) AS INTEGER)) AS w{c}" for c in XYZ) + " FROM o) SELECT wx AS width_x, wy AS width_y, wz AS width_z, 0 AS shift_x, wx AS shift_y, wx + wy AS shift_z FROM l"
)
def voxel_grid_params(spark, sf_dir):
    grid = V.VoxelGrid.fit(emb(spark, sf_dir), EDGE)
    named = {f"{k}_{c}": v for k, vs in (("width", grid.widths), ("shift", grid.shifts)) for c, v in zip(XYZ, vs)}
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in named.items()))


_ADDRESS = P + f", {_cells(EDGE)}, b AS (SELECT " + ", ".join(f"greatest(1, CAST(ceil(log2((max({c}) + {EDGE}/2 - (min({c}) - {EDGE}/2)) / {EDGE})) AS INTEGER)) AS w{c}" for c in XYZ) + " FROM p)"


@register(_ADDRESS + " SELECT id, ix + (iy << wx) + (iz << (wx + wy)) AS address FROM v, b")
def voxel_address(spark, sf_dir):
    points = emb(spark, sf_dir)
    return points.select("id", V.VoxelGrid.fit(points, EDGE).address().alias("address"))


@register(P + f", {_cells(EDGE)} SELECT id, " + ", ".join(f"round(i{c} * {EDGE} + lo{c}, 6) AS {c}" for c in XYZ) + " FROM v")
def voxel_roundtrip(spark, sf_dir):
    points = emb(spark, sf_dir)
    grid = V.VoxelGrid.fit(points, EDGE)
    return rounded(points.select("id", grid.address().alias("a")).select("id", *grid.centers(F.col("a"))), *XYZ)


@register(P + f", {_voxels(EDGE)} SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM u")
def voxel_unique(spark, sf_dir):
    return rounded(V.unique_voxels(emb(spark, sf_dir), EDGE), *XYZ)


@register(P + f", {_cells(EDGE)} SELECT min(id) AS id FROM v GROUP BY ix, iy, iz")
def voxel_first_point(spark, sf_dir):
    return V.first_points(emb(spark, sf_dir), EDGE).select("id")


_EDGES = (5.0, 20.0, 80.0)
_CURVE = EV + ", o AS (SELECT min(x) AS lox, min(y) AS loy, min(z) AS loz FROM p), c AS (SELECT edge, " + ", ".join(f"CAST(floor(({c} - (lo{c} - edge / 2)) / edge) AS BIGINT) AS i{c}" for c in XYZ) + " FROM p, o, (VALUES " + ", ".join(f"(CAST({e} AS DOUBLE))" for e in _EDGES) + ") e(edge)), d AS (SELECT edge, count(*) AS voxels, CAST(sum(n) AS BIGINT) AS points FROM (SELECT edge, ix, iy, iz, count(*) AS n FROM c GROUP BY ALL) GROUP BY edge)"


@register(_CURVE + " SELECT edge, voxels, points FROM d")
def voxel_population_curve(spark, sf_dir):
    return V.population_curve(evt(spark, sf_dir), list(_EDGES)).select("edge", "voxels", "points")


@register(_CURVE + " SELECT edge, round(CAST(voxels AS DOUBLE) / points * 100.0, 6) AS percent FROM d")
def voxel_percent(spark, sf_dir):
    return rounded(V.population_curve(evt(spark, sf_dir), list(_EDGES)).select("edge", "percent"), "percent")


@register(P + f", {_cells(EDGE)}, k AS (SELECT DISTINCT ix, iy, iz FROM v) SELECT a.ix, a.iy, a.iz, count(*) AS n FROM k a JOIN k b ON abs(a.ix-b.ix) <= 1 AND abs(a.iy-b.iy) <= 1 AND abs(a.iz-b.iz) <= 1 AND (a.ix <> b.ix OR a.iy <> b.iy OR a.iz <> b.iz) GROUP BY ALL")
def voxel_neighbors(spark, sf_dir):
    points = emb(spark, sf_dir)
    cells = V.with_cells(points, EDGE, V.corner_of(points))
    return V.voxel_neighbors(cells).groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"))


# Neighbours


@register(P + f", {_pairs(RADIUS, 'p')} SELECT qid, count(*) AS n, round(sum(d2), 6) AS d2 FROM n GROUP BY qid")
def radius_pairs_euclid(spark, sf_dir):
    points = emb(spark, sf_dir)
    pairs = radius_join(points, points, RADIUS)
    return rounded(pairs.groupBy("qid").agg(F.count("*").alias("n"), F.sum(F.expr("dx*dx + dy*dy + dz*dz")).alias("d2")), "d2")


@register(P + f", {_pairs(RADIUS, 'p', 'd2 < {r} * {r} AND d2 > 0.0001 * 0.0001')} SELECT qid, count(*) AS n, round(sum(dx), 6) + 0.0 AS dx FROM n GROUP BY qid")
def radius_pairs_strict(spark, sf_dir):
    points = emb(spark, sf_dir)
    pairs = radius_join(points, points, RADIUS, inclusive=False, exclude_coincident=True)
    return rounded(pairs.groupBy("qid").agg(F.count("*").alias("n"), F.sum("dx").alias("dx")), "dx")


_ASKED = " FROM p q, p s WHERE q.id % 50 = 0"


@register(P + " SELECT q.id AS qid, s.id AS sid, round(greatest(abs(s.x-q.x), abs(s.y-q.y), abs(s.z-q.z)), 6) AS dist" + _ASKED)
def distance_matrix_cheby(spark, sf_dir):
    """The points whose ids are divisible by 50 against all points."""
    points = emb(spark, sf_dir)
    return rounded(distance_matrix(points.where("id % 50 = 0"), points, "cheby"), "dist")


@register(P + " SELECT q.id AS qid, s.id AS sid, round(sqrt((s.x-q.x)*(s.x-q.x) + (s.y-q.y)*(s.y-q.y) + (s.z-q.z)*(s.z-q.z)), 6) AS dist" + _ASKED)
def distance_matrix_euclid(spark, sf_dir):
    points = emb(spark, sf_dir)
    return rounded(distance_matrix(points.where("id % 50 = 0"), points), "dist")


_ONE = P + f", {_voxels(EDGE)}, {_pairs(RADIUS)}, {_GROUPED}"


def _grouped(spark, sf_dir):
    points = emb(spark, sf_dir)
    pairs = radius_join(points, V.unique_voxels(points, EDGE), RADIUS)
    return G.every_point(points, pairs).groupBy("qid").agg(*G.neighborhood_sums(pairs))


@register(_ONE + " SELECT p.id AS qid, coalesce(n, 0) AS population FROM p LEFT JOIN g ON p.id = qid")
def population(spark, sf_dir):
    return _grouped(spark, sf_dir).select("qid", G.population().alias("population"))


@register(_ONE + f" SELECT p.id AS qid, round(coalesce(n, 0) / {ball_volume_cm3(RADIUS)!r} * 1e6, 6) AS density FROM p LEFT JOIN g ON p.id = qid")
def density(spark, sf_dir):
    return _grouped(spark, sf_dir).select("qid", _r(G.density(RADIUS) * 1e6).alias("density"))


@register(_ONE + " SELECT p.id AS qid, round(coalesce(sqrt(mx*mx + my*my + mz*mz), 0), 6) AS centroid FROM p LEFT JOIN g ON p.id = qid")
def centroid_distance(spark, sf_dir):
    return _grouped(spark, sf_dir).select("qid", _r(G.centroid_distance()).alias("centroid"))


@register(_ONE + " SELECT p.id AS qid, " + ", ".join(f"round(coalesce(c{a}{b}, 0) * 1000, 6) + 0.0 AS cov_{a}{b}" for a, b in UPPER) + " FROM p LEFT JOIN g ON p.id = qid")
def covariance(spark, sf_dir):
    return _grouped(spark, sf_dir).select("qid", *(_r(G.covariance(a, b) * 1000).alias(f"cov_{a}{b}") for a, b in UPPER))


@register(P + f", {_voxels(EDGE)}, {_pairs(RADIUS)}, g AS (SELECT qid, max(dz) AS top, min(dz) AS low FROM n GROUP BY qid) SELECT p.id AS qid, round(coalesce(CASE WHEN top >= -low THEN top ELSE low END, 0), 6) + 0.0 AS offset_z FROM p LEFT JOIN g ON p.id = qid")
def signed_z_offset(spark, sf_dir):
    points = emb(spark, sf_dir)
    pairs = radius_join(points, V.unique_voxels(points, EDGE), RADIUS)
    return rounded(G.every_point(points, pairs).groupBy("qid").agg(G.signed_z_offset().alias("offset_z")), "offset_z")


@register(_ONE + f", {_eigen()} SELECT qid, round(w1, 6) AS eig1, round(w2, 6) AS eig2, round(w3, 6) + 0.0 AS eig3 FROM w")
def pca_eigenvalues(spark, sf_dir):
    return rounded(G.with_pca(_grouped(spark, sf_dir), ("eig1", "eig2", "eig3")).select("qid", "eig1", "eig2", "eig3"), "eig1", "eig2", "eig3")


_ONE_COLS = "p.id AS qid, coalesce(n, 0) AS {k}population, round(coalesce(sqrt(mx*mx + my*my + mz*mz), 0), 6) AS {k}centroid, round(coalesce(w1, 0), 6) AS {k}eig1, round(coalesce(w2, 0), 6) AS {k}eig2"


@register(_ONE + f", {_eigen()} SELECT {_ONE_COLS.format(k='')} FROM p LEFT JOIN w ON p.id = qid")
def one_scale(spark, sf_dir):
    points = emb(spark, sf_dir)
    return rounded(M.one_scale(points, points, EDGE, RADIUS), "centroid", "eig1", "eig2")


_LI = "WITH p AS (SELECT p_partkey AS id, CAST(p_partkey % 50 AS DOUBLE) AS x, p_retailprice / 20 AS y, CAST(p_partkey % 11 AS DOUBLE) AS z FROM part), li AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem)"
_LI += ", o AS (SELECT " + ", ".join(f"min({c}) AS lo{c}" for c in XYZ) + " FROM li), v AS (SELECT DISTINCT " + ", ".join(f"CAST(floor(({c} - (lo{c} - {LI_EDGE} / 2)) / {LI_EDGE}) AS BIGINT) AS i{c}, lo{c}" for c in XYZ) + f" FROM li, o), u AS (SELECT {', '.join(f'lo{c} + i{c} * {LI_EDGE} AS {c}' for c in XYZ)} FROM v)"


@register(f"{_LI}, {_pairs(LI_RADIUS)} SELECT p.id AS qid, count(n.qid) AS population, round(coalesce(sqrt(avg(dx)*avg(dx) + avg(dy)*avg(dy) + avg(dz)*avg(dz)), 0), 4) AS centroid FROM p LEFT JOIN n ON p.id = n.qid GROUP BY p.id")
def one_scale_lineitem(spark, sf_dir):
    """Parts among the resampled line items: the throughput query."""
    return rounded(M.one_scale(prt(spark, sf_dir), li_search(spark, sf_dir), LI_EDGE, LI_RADIUS).select("qid", "population", "centroid"), "centroid", places=4)


_ORD = _LI.replace("SELECT p_partkey AS id, CAST(p_partkey % 50 AS DOUBLE) AS x, p_retailprice / 20 AS y, CAST(p_partkey % 11 AS DOUBLE) AS z FROM part", "SELECT o_orderkey AS id, CAST(o_custkey % 50 AS DOUBLE) AS x, o_totalprice / 5000 AS y, CAST(o_orderkey % 11 AS DOUBLE) AS z FROM orders")


@register(f"{_ORD}, {_pairs(LI_RADIUS)}, {_GROUPED}, {_eigen()} SELECT {_ONE_COLS.format(k='').replace(', 6)', ', 4)')} FROM p LEFT JOIN w ON p.id = qid")
def one_scale_orders(spark, sf_dir):
    """Orders among the resampled line items: throughput on a larger cloud."""
    o = _read(spark, sf_dir, "orders")
    points = PointCloud.of(o, "o_orderkey", F.pmod("o_custkey", F.lit(50)), F.col("o_totalprice") / 5000, F.pmod("o_orderkey", F.lit(11))).df
    return rounded(M.one_scale(points, li_search(spark, sf_dir), LI_EDGE, LI_RADIUS), "centroid", "eig1", "eig2", places=4)


_SECOND = "WITH a AS ({a}), b AS ({b}) SELECT a.*, b.* EXCLUDE (qid) FROM a JOIN b USING (qid)"


def _scale_sql(k: int, edge: float, radius: float) -> str:
    return P + f", {_voxels(edge)}, {_pairs(radius)}, {_GROUPED}, {_eigen()} SELECT {_ONE_COLS.format(k=f's{k}_')} FROM p LEFT JOIN w ON p.id = qid"


@register(_SECOND.format(a=_scale_sql(0, 0.05, 0.15), b=_scale_sql(1, 0.08, 0.2)))
def multiscale(spark, sf_dir):
    points = emb(spark, sf_dir)
    df = M.multiscale(points, points, [0.05, 0.08], [0.15, 0.2])
    return rounded(df, *(c for c in df.columns if c != "qid" and "population" not in c))


_GPU = "d2 < {r} * {r} AND d2 > 0.0001 * 0.0001"
_GPU_COLS = "p.id AS qid, round(coalesce(n, 0) / {v!r} * 1e6, 6) AS s{k}_density, round(coalesce(sqrt(mx*mx + my*my + mz*mz), 0), 6) AS s{k}_centroid, "


def _gpu_sql(k: int, radius: float, cols: str) -> str:
    return P + f", {_voxels(EDGE)}, {_pairs(radius, rule=_GPU)}, {_GROUPED}, {_eigen()} SELECT {_GPU_COLS.format(v=ball_volume_cm3(radius), k=k)}{cols.format(k=k)} FROM p LEFT JOIN w ON p.id = qid"


def _gpu(spark, sf_dir, kind):
    points = emb(spark, sf_dir)
    df = M.multi_radius(points, points, EDGE, list(RADII), kind)
    df = df.withColumns({c: F.col(c) * 1e6 for c in df.columns if c.endswith("density")})
    return rounded(df, *(c for c in df.columns if c != "qid"))


_EIG = "round(coalesce(w1, 0), 6) AS s{k}_eig1, round(coalesce(w2, 0), 6) AS s{k}_eig2"


@register(_SECOND.format(a=_gpu_sql(0, RADII[0], _EIG), b=_gpu_sql(1, RADII[1], _EIG)))
def multi_radius(spark, sf_dir):
    return _gpu(spark, sf_dir, "eig")


_COV = ", ".join(f"round(coalesce(c{a}{b} * (n - 1), 0), 6) + 0.0 AS s{{k}}_cov_{a}{b}" for a, b in UPPER)


@register(_SECOND.format(a=_gpu_sql(0, RADII[0], _COV), b=_gpu_sql(1, RADII[1], _COV)))
def cov_features(spark, sf_dir):
    return _gpu(spark, sf_dir, "cov")


@register()
def eigenvector_features(spark, sf_dir):
    return _gpu(spark, sf_dir, "eigvec")


@register(P + f", {_voxels(EDGE)}, {_pairs(RADII[0], rule=_GPU.format(r=RADII[0]))}, {_GROUPED}, {_eigen()} SELECT p.id AS qid, coalesce(n >= 2 AND tr > 0, FALSE) AS defined, 0.0::DOUBLE AS residual1, 0.0::DOUBLE AS residual2, 0.0::DOUBLE AS dot FROM p LEFT JOIN w ON p.id = qid")
def eigenvector_residuals(spark, sf_dir):
    """Whether the vectors v of a neighbourhood's covariance m have unit length, fulfil m v = w v for their eigenvalues w
    and are normal to each other. All three parts are the operator's own: where eigenvalues coincide, length and residual
    leave the sign of the z part open."""
    points = emb(spark, sf_dir)
    pairs = radius_join(points, V.unique_voxels(points, EDGE, ties="even"), RADII[0], **M.RULES["gpu"])
    rows = G.attach(points, pairs.groupBy("qid").agg(*G.neighborhood_sums(pairs)))
    rows = G.with_eigenvectors(G.with_pca(rows, ("w1", "w2", "w3")), names=("v1x", "v1y", "v2x", "v2y", "v1z", "v2z"))
    cov = {f"{a}{b}": G.covariance(a, b) for a, b in UPPER}
    rows = rows.withColumns({f"k{k}": v for k, v in cov.items()}).withColumn("tr", F.col("kxx") + F.col("kyy") + F.col("kzz"))

    def error(k: int):
        v = [F.col(f"v{k}{c}") for c in XYZ]
        m = [("kxx", "kxy", "kxz"), ("kxy", "kyy", "kyz"), ("kxz", "kyz", "kzz")]
        off = F.sqrt(sum((sum(F.col(c) * x for c, x in zip(row, v)) - F.col(f"w{k}") * F.col("tr") * y) ** 2 for row, y in zip(m, v))) / F.col("tr")
        return F.greatest(off, F.abs(sum(x * x for x in v) - 1))

    known = (F.col("n") >= 2) & (F.col("tr") > 0)
    dot = F.abs(sum(F.col(f"v1{c}") * F.col(f"v2{c}") for c in XYZ))
    out = {"residual1": error(1), "residual2": error(2), "dot": dot}
    return rows.select("qid", F.coalesce(known, F.lit(False)).alias("defined"), *(F.round(F.coalesce(F.when(known, v), F.lit(0.0)), 4).alias(c) for c, v in out.items()))


_SKIP = "s AS (SELECT id, label FROM p WHERE label < 5 UNION ALL SELECT id, NULL FROM (SELECT id, row_number() OVER (ORDER BY (id % 2147483647 * 48271 + 5) % 2147483647, id) AS r, count(*) OVER () AS n FROM p WHERE label >= 5) WHERE r <= n // 3)"


def _archive(spark, sf_dir, kind, feats=None, **how):
    """The features of a stored set: points of labels 0 to 4 are labelled, a third of the others takes part."""
    store = CloudStore(spark, scratch(spark))
    points = emb(spark, sf_dir)
    store.ingest(points.select("id", *XYZ))
    store.add_set("all", points.select("id", F.when(F.col("label") < 5, F.col("label")).alias("label"), F.col("feats") if feats is None else feats.alias("feats")))
    return archive_features(store, "all", [(EDGE, list(RADII))], kind, skip=3, seed=5, save_as="features", **how)


_ARCHIVE = "WITH a AS ({a}), b AS ({b}), c AS ({c}) SELECT c.id, c.label, a.* EXCLUDE (qid), b.* EXCLUDE (qid) FROM c JOIN a ON a.qid = c.id JOIN b ON b.qid = c.id"
_SAMPLE = P + f", {_SKIP} SELECT id, label FROM s"
_PARTS = {"eig": ("density", "centroid", "eig1", "eig2"), "cov": ("density", "centroid", *(f"cov_{a}{b}" for a, b in UPPER))}


def _archive_query(spark, sf_dir, kind):
    names = [f"s{k}_{c}" for k in range(len(RADII)) for c in _PARTS[kind]]
    df = _archive(spark, sf_dir, kind)
    values = [F.col("feats")[i] * (1e6 if n.endswith("density") else 1.0) for i, n in enumerate(names)]
    return df.select("id", "label", *(_r(v).alias(n) for v, n in zip(values, names)))


@register(_ARCHIVE.format(a=_gpu_sql(0, RADII[0], _EIG), b=_gpu_sql(1, RADII[1], _EIG), c=_SAMPLE))
def archive_features_eig(spark, sf_dir):
    return _archive_query(spark, sf_dir, "eig")


@register(_ARCHIVE.format(a=_gpu_sql(0, RADII[0], _COV), b=_gpu_sql(1, RADII[1], _COV), c=_SAMPLE))
def archive_features_cov(spark, sf_dir):
    return _archive_query(spark, sf_dir, "cov")


_VALUES = ("f3", "f4")


def _valued(spark, sf_dir):
    return emb(spark, sf_dir).withColumns({c: F.col("feats")[i + 3] for i, c in enumerate(_VALUES)})


_PV = P.replace(", label, embedding FROM", ", label, CAST(embedding[4] AS DOUBLE) AS f3, CAST(embedding[5] AS DOUBLE) AS f4 FROM")


def _means(source: str, radius: float, rule: str, target: str = "p") -> str:
    return f"SELECT q.id AS qid, avg(s.f3) AS f3, avg(s.f4) AS f4 FROM {target} q JOIN {source} s ON {rule} GROUP BY q.id"


_D2 = "(s.x-q.x)*(s.x-q.x) + (s.y-q.y)*(s.y-q.y) + (s.z-q.z)*(s.z-q.z)"


@register(_PV + f", m AS ({_means('p', RADIUS, f'{_D2} < {RADIUS} * {RADIUS}')}) SELECT id AS qid, round(coalesce(f3, 0), 6) + 0.0 AS f3, round(coalesce(f4, 0), 6) + 0.0 AS f4 FROM (SELECT id FROM p) LEFT JOIN m ON id = qid")
def radius_mean(spark, sf_dir):
    points = _valued(spark, sf_dir)
    pairs = radius_join(points, points, RADIUS, inclusive=False, carry=_VALUES)
    return rounded(G.radius_mean(points, pairs, list(_VALUES)), *_VALUES)


_INTERP = _PV + f", {_voxels(EDGE)}, m AS (SELECT q.x, q.y, q.z, avg(s.f3) AS f3, avg(s.f4) AS f4 FROM u q LEFT JOIN p s ON greatest(abs(s.x-q.x), abs(s.y-q.y), abs(s.z-q.z)) < {EDGE} GROUP BY ALL), i AS (SELECT x, y, z, coalesce(f3, 0) AS f3, coalesce(f4, 0) AS f4 FROM m)"


@register(_INTERP + " SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(f3, 6) + 0.0 AS f3, round(f4, 6) + 0.0 AS f4 FROM i")
def voxel_interpolate(spark, sf_dir):
    points = _valued(spark, sf_dir)
    voxels = V.unique_voxels(points, EDGE).withColumn("id", F.xxhash64(*XYZ))
    return rounded(M.voxel_interpolate(points, voxels, list(_VALUES), EDGE).drop("id"), *XYZ, *_VALUES)


@register(
    _INTERP
    + f", a AS ({_means('i', RADII[0], f'{_D2} < {RADII[0]} * {RADII[0]}')}), b AS ({_means('i', RADII[1], f'{_D2} < {RADII[1]} * {RADII[1]}')})"
    + " SELECT id AS qid, "
    + ", ".join(f"round(coalesce({t}.{c}, 0), 6) + 0.0 AS s{k}_{c}" for k, t in enumerate("ab") for c in _VALUES)
    + " FROM (SELECT id FROM p) p LEFT JOIN a ON id = a.qid LEFT JOIN b ON id = b.qid"
)
def vector_multiscale(spark, sf_dir):
    points = _valued(spark, sf_dir)
    df = M.vector_multiscale(points, points, list(_VALUES), EDGE, list(RADII))
    return rounded(df, *df.columns[1:])


@register("WITH a AS (" + SQL["vector_multiscale"] + f"), c AS ({_SAMPLE}) SELECT c.id, c.label, a.* EXCLUDE (qid) FROM c JOIN a ON a.qid = c.id")
def archive_features_vector(spark, sf_dir):
    df = _archive(spark, sf_dir, "vector", F.array(*(F.col("feats")[i + 3] for i in range(len(_VALUES)))), columns=len(_VALUES))
    names = [f"s{k}_{c}" for k in range(len(RADII)) for c in _VALUES]
    return df.select("id", "label", *(_r(F.col("feats")[i]).alias(n) for i, n in enumerate(names)))


# Projections, regions, partitions


@register(P + " SELECT CAST(pos AS BIGINT) AS pos, p.id, round(x, 6) AS x FROM (SELECT row_number() OVER (ORDER BY (vec_id * 48271 % 1009), vec_id) - 1 AS pos, vec_id AS id FROM embeddings) JOIN p USING (id)")
def take(spark, sf_dir):
    from cairn.plans.materialize import ranked

    cloud = PointCloud(emb(spark, sf_dir)).recenter()
    wanted = ranked(cloud.df.select("id").withColumn("k", F.col("id") * 48271 % 1009), [], ["k", "id"], "pos")
    return rounded(cloud.take(wanted).select("pos", "id", "x"), "x")


_BOX = ((-0.1, -0.1, -0.1), (0.1, 0.1, 0.1))
_IN = "x {a} {lo} AND x {b} {hi} AND y {a} {lo} AND y {b} {hi} AND z {a} {lo} AND z {b} {hi}"


@register("SELECT vec_id AS id FROM embeddings")
def checked_points(spark, sf_dir):
    points = emb(spark, sf_dir)
    return V.VoxelGrid.fit(points, EDGE).check_bounds(points).select("id")


@register(P + f" SELECT id FROM p WHERE {_IN.format(a='>', b='<', lo=-0.1, hi=0.1)}")
def box_filter(spark, sf_dir):
    return emb(spark, sf_dir).where(regions.in_box(*_BOX, bounds="open")).select("id")


@register(P + f" SELECT id, 'query' AS side FROM p WHERE {_IN.format(a='>=', b='<=', lo=-0.1, hi=0.1)} UNION ALL SELECT id, 'search' FROM p WHERE {_IN.format(a='>=', b='<=', lo=-0.15, hi=0.15)}")
def nested_regions(spark, sf_dir):
    points = emb(spark, sf_dir)
    q, s = regions.nested_regions(points, points, 0.05, *_BOX)
    return q.select("id", F.lit("query").alias("side")).union(s.select("id", F.lit("search")))


@register(P + " SELECT id, 'euclid' AS metric FROM p WHERE x*x + y*y + z*z < 0.2 * 0.2 UNION ALL SELECT id, 'cheby' FROM p WHERE greatest(abs(x), abs(y), abs(z)) < 0.2")
def ball_query(spark, sf_dir):
    points = emb(spark, sf_dir)
    parts = [regions.ball_query(points, (0.0, 0.0, 0.0), 0.2, m).select("id", F.lit(m).alias("metric")) for m in ("euclid", "cheby")]
    return parts[0].union(parts[1])


@register(P + ", s AS (SELECT id FROM p WHERE label < 5) SELECT id, 'query' AS side FROM p JOIN s USING (id) WHERE greatest(abs(x), abs(y), abs(z)) < 0.1 UNION ALL SELECT id, 'search' FROM p JOIN s USING (id) WHERE greatest(abs(x), abs(y), abs(z)) < 0.15")
def partition_query(spark, sf_dir):
    points = emb(spark, sf_dir)
    q, s = regions.partition_query(points, (0.0, 0.0, 0.0), 0.1, 0.05, points.where("label < 5"))
    return q.select("id", F.lit("query").alias("side")).union(s.select("id", F.lit("search")))


@register(P + " SELECT id, CAST((CASE WHEN x >= 0 THEN 4 ELSE 0 END) + (CASE WHEN y >= 0 THEN 2 ELSE 0 END) + (CASE WHEN z >= 0 THEN 1 ELSE 0 END) AS INTEGER) AS octant FROM p WHERE x BETWEEN -0.5 AND 0.5 AND y BETWEEN -0.5 AND 0.5 AND z BETWEEN -0.5 AND 0.5")
def octants(spark, sf_dir):
    points = emb(spark, sf_dir)
    return regions.octants(points, points, (-0.5, -0.5, -0.5), 0.5, 0.05)[0].select("id", "octant")


@register(
    EV + ", o AS (SELECT avg(x) AS ax, avg(y) AS ay, avg(z) AS az FROM p), r AS (SELECT greatest(max(abs(x-ax)), max(abs(y-ay)), max(abs(z-az))) * (1 + 1e-9) + 1e-12 AS r FROM p, o), f AS (SELECT "
    + ", ".join(f"CAST(floor(({c} - (a{c} - r)) / (2 * r / 64)) AS BIGINT) AS i{c}" for c in XYZ) + " FROM p, o, r), c AS (SELECT CAST(level AS INTEGER) AS level, ix >> (6 - level) AS ix, iy >> (6 - level) AS iy, iz >> (6 - level) AS iz, count(*) AS n FROM f, (VALUES (1),(2),(3),(4),(5),(6)) l(level) GROUP BY ALL)"
    " SELECT c.level, c.ix, c.iy, c.iz, c.n FROM c LEFT JOIN c a ON a.level = c.level - 1 AND a.ix = c.ix >> 1 AND a.iy = c.iy >> 1 AND a.iz = c.iz >> 1 WHERE (c.n <= 200 OR c.level = 6) AND (a.n IS NULL OR a.n > 200) AND c.n >= 3"
)
def octree_leaves(spark, sf_dir):
    return regions.octree_leaves(evt(spark, sf_dir), 200, 3, 6)


def _octree_sql(max_points: int, levels: int, buffer: float) -> str:
    """CTEs o, r (mean, radius), e (levels), t (cells by buffered population) and leaf of the events' octree."""
    own = ", ".join(f"CAST(floor(({c} - (a{c} - r)) / (2 * r / (1 << level))) AS BIGINT) AS i{c}" for c in XYZ)
    near = " AND ".join(f"CAST(floor(({c} - {buffer} - (a{c} - r)) / (2 * r / (1 << c.level))) AS BIGINT) <= i{c} AND CAST(floor(({c} + {buffer} - (a{c} - r)) / (2 * r / (1 << c.level))) AS BIGINT) >= i{c}" for c in XYZ)
    return (
        EV + ", o AS (SELECT avg(x) AS ax, avg(y) AS ay, avg(z) AS az FROM p), r AS (SELECT greatest(max(abs(x-ax)), max(abs(y-ay)), max(abs(z-az))) * (1 + 1e-9) + 1e-12 AS r FROM p, o), "
        f"e AS (SELECT CAST(g AS INTEGER) AS level FROM range(1, {levels + 1}) t(g)), f AS (SELECT id, level, {own} FROM p, o, r, e), c AS (SELECT level, ix, iy, iz, count(*) AS n FROM f GROUP BY ALL), "
        f"t AS (SELECT c.level, ix, iy, iz, any_value(n) AS n, count(*) AS population FROM c, p, o, r WHERE {near} GROUP BY ALL), w AS (SELECT *, population <= {max_points} OR level = {levels} AS whole FROM t), "
        "leaf AS (SELECT w.level, w.ix, w.iy, w.iz, w.n, w.population FROM w LEFT JOIN w a ON a.level = w.level - 1 AND a.ix = w.ix >> 1 AND a.iy = w.iy >> 1 AND a.iz = w.iz >> 1 WHERE w.whole AND NOT coalesce(a.whole, FALSE))"
    )


@register(_octree_sql(400, 3, 10.0) + " SELECT * FROM leaf")
def octree_buffered(spark, sf_dir):
    points = evt(spark, sf_dir)
    return regions.octree_leaves(points, 400, 1, 3, points, 10.0)


@register(_octree_sql(400, 3, 10.0) + " SELECT level, ix, iy, iz, n AS n_query, population AS n_search FROM leaf")
def partition_rows(spark, sf_dir):
    """Query and buffered search points of each leaf."""
    points = evt(spark, sf_dir)
    root = regions.OctreeRoot.of(points)
    q, s = regions.partition_rows(points, points, regions.octree_leaves(points, 400, 1, 3, points, 10.0, root=root), root, 10.0)
    key = ["level", "ix", "iy", "iz"]
    return q.groupBy(*key).agg(F.count("*").alias("n_query")).join(s.groupBy(*key).agg(F.count("*").alias("n_search")), key)


@register()
def rigid_edge(spark, sf_dir):
    """The edge at which no cube of the events holds more than 300."""
    edge = regions.rigid_edge(evt(spark, sf_dir), 300, 200.0)
    return regions.rigid_leaves(evt(spark, sf_dir), edge).select(F.lit(round(edge, 9)).alias("edge"), "ix", "iy", "iz", "n")


@register(EV + " SELECT CAST(floor(x / 50.0) AS BIGINT) AS ix, CAST(floor(y / 50.0) AS BIGINT) AS iy, CAST(floor(z / 50.0) AS BIGINT) AS iz, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 5")
def rigid_leaves(spark, sf_dir):
    return regions.rigid_leaves(evt(spark, sf_dir), 50.0, 5)


@register(P + f" SELECT count(*) FILTER ({_IN.format(a='>=', b='<=', lo=-0.1, hi=0.1)}) AS query_population, count(*) FILTER ({_IN.format(a='>=', b='<=', lo=-0.15, hi=0.15)}) AS search_population, count(*) FILTER ({_IN.format(a='>=', b='<=', lo=-0.15, hi=0.15)}) <= 1000 AS fits FROM p")
def region_population(spark, sf_dir):
    points = emb(spark, sf_dir)
    return regions.region_population(points, points, *_BOX, 0.05, 1000)


@register("SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS batch, o_orderkey AS id FROM orders")
def batches(spark, sf_dir):
    ids = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return regions.batches(ids, 1000, ["id"]).select("batch", "id")


@register("SELECT id FROM (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events) WHERE r % 7 = 0")
def every_kth(spark, sf_dir):
    return regions.every_kth(evt(spark, sf_dir).select("id"), 7, ["id"])


@register(P + ", c AS (SELECT arg_min(x, id) AS cx, arg_min(y, id) AS cy, arg_min(z, id) AS cz FROM p) SELECT id, round(x - cx, 6) + 0.0 AS x, round(y - cy, 6) + 0.0 AS y, round(z - cz, 6) + 0.0 AS z FROM p, c")
def recenter(spark, sf_dir):
    return rounded(PointCloud(emb(spark, sf_dir)).recenter().df.select("id", *XYZ), *XYZ)


# Labels and assets


def _lbl(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return A.scatter_labels(docs.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("n")), known)


_LBL = "WITH l AS (SELECT d.doc_id AS id, quality AS label FROM documents d LEFT JOIN labels USING (doc_id))"


@register(_LBL + " SELECT id, label IS NOT NULL AS labelled FROM l")
def split_labelled(spark, sf_dir):
    known, free = A.split_labelled(_lbl(spark, sf_dir))
    return known.select("id", F.lit(True).alias("labelled")).union(free.select("id", F.lit(False)))


@register("SELECT vec_id AS id, CASE WHEN label IN (5, 7) THEN 3 ELSE label END AS label FROM embeddings")
def collapse_labels(spark, sf_dir):
    return A.collapse_labels(emb(spark, sf_dir).select("id", "label"), [3, 5, 7])


@register(_LBL + " SELECT id, label FROM l")
def scatter_labels(spark, sf_dir):
    return _lbl(spark, sf_dir).select("id", "label")


@register("SELECT CAST(g AS INTEGER) AS label, count(v.label) AS n FROM range(0, (SELECT max(label) + 1 FROM embeddings)) t(g) LEFT JOIN (SELECT label FROM embeddings) v ON v.label = g GROUP BY g")
def label_population(spark, sf_dir):
    return A.label_population(emb(spark, sf_dir))


@register("SELECT CAST(i - 1 AS INTEGER) AS feature, round(stddev_pop(CAST(embedding[i] AS DOUBLE)), 6) AS std FROM embeddings, range(1, 65) t(i) GROUP BY i")
def feature_std(spark, sf_dir):
    return rounded(A.feature_std(emb(spark, sf_dir)), "std")


@register("SELECT vec_id AS id, len(embedding) - 2 AS width, round(CAST(embedding[2] AS DOUBLE), 6) AS f0, round(CAST(embedding[4] AS DOUBLE), 6) AS f1 FROM embeddings")
def drop_features(spark, sf_dir):
    df = A.drop_features(emb(spark, sf_dir), [0, 2])
    return rounded(df.select("id", F.size("feats").cast("long").alias("width"), F.col("feats")[0].alias("f0"), F.col("feats")[1].alias("f1")), "f0", "f1")


@register("SELECT d.doc_id AS id, CAST(n_chars AS DOUBLE) AS v0, CAST(quality AS DOUBLE) AS v1, CAST(toxic AS DOUBLE) AS v2 FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def asset_intersection(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    one = docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("value"))
    two = labels.select(F.col("doc_id").alias("id"), F.array("quality", "toxic").alias("value"))
    return A.intersection([one, two]).select("id", *(F.col("value")[i].alias(f"v{i}") for i in range(3)))


@register("SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS f0, CAST(embedding[64] AS DOUBLE) AS f1, len(embedding) + 1 AS width FROM embeddings JOIN labels ON vec_id = doc_id")
def merge_features(spark, sf_dir):
    points, labels = emb(spark, sf_dir), _read(spark, sf_dir, "labels")
    second = labels.select(F.col("doc_id").alias("id"), F.array(F.col("toxic").cast("double")).alias("feats"))
    df = A.merge_features(points.select("id", "label", "feats"), second)
    return df.select("id", "label", F.col("feats")[0].alias("f0"), F.col("feats")[63].alias("f1"), F.size("feats").cast("long").alias("width"))


@register("SELECT vec_id AS id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def restrict(spark, sf_dir):
    return A.restrict(emb(spark, sf_dir), _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))).select("id")


@register("SELECT l_orderkey AS id, arg_min(l_extendedprice, pos) AS value FROM (SELECT l_orderkey, l_extendedprice, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS pos FROM lineitem) GROUP BY l_orderkey")
def unique_first(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem")
    pos = F.col("l_linenumber") * F.lit(10000000).cast("long") + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    return A.unique_first(li.select(F.col("l_orderkey").alias("id"), pos.alias("pos"), F.col("l_extendedprice").alias("value")))


# Stored and written clouds


@register("SELECT 'all' AS tag, count(*) AS n, TRUE AS has_labels, FALSE AS has_clusters, CAST(max(len(embedding)) AS INTEGER) AS n_features FROM embeddings UNION ALL SELECT 'unlabelled', count(*), FALSE, FALSE, 0 FROM embeddings")
def store_sets(spark, sf_dir):
    """What a store tells about two sets of one cloud."""
    store = CloudStore(spark, scratch(spark))
    points = emb(spark, sf_dir)
    store.ingest(points.select("id", *XYZ))
    store.add_set("all", points.select("id", "label", "feats"))
    store.add_set("unlabelled", points.select("id"))
    return store.describe_sets()


@register("SELECT l_orderkey AS id, arg_min(l_quantity, pos) AS f0, arg_min(l_extendedprice, pos) AS f1 FROM (SELECT *, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS pos FROM lineitem) GROUP BY l_orderkey")
def stored_set(spark, sf_dir):
    """A set of repeated ids, written and read again: the row of the smallest pos of each id."""
    li = _read(spark, sf_dir, "lineitem")
    pos = F.col("l_linenumber") * F.lit(10000000).cast("long") + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    store = CloudStore(spark, scratch(spark))
    store.add_set("items", li.select(F.col("l_orderkey").alias("id"), pos.alias("pos"), F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")).alias("feats")))
    return store.feats("items").select("id", F.col("feats")[0].alias("f0"), F.col("feats")[1].alias("f1"))


# Sampling


_KEY = "((id % 2147483647) * 48271 + {seed}) % 2147483647"
_RANK = "SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY " + _KEY + ", id) - 1 AS r FROM {t} WHERE label IS NOT NULL"


@register(P + ", r AS (" + _RANK.format(seed=7, t="p") + "), m AS (SELECT min(c) // 2 AS n FROM (SELECT count(*) AS c FROM p GROUP BY label)) SELECT id, label, CAST(r // n AS INTEGER) AS fold FROM r, m WHERE r < 2 * n")
def balanced_split(spark, sf_dir):
    return sampling.balanced_split(emb(spark, sf_dir).select("id", "label"), 7)


@register(P + ", r AS (" + _RANK.format(seed=7, t="p") + "), m AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM p GROUP BY label)) SELECT id, label FROM r, m WHERE r < n")
def balanced_train(spark, sf_dir):
    """The one fold of a training without validation."""
    return sampling.balanced_split(emb(spark, sf_dir).select("id", "label"), 7, folds=1).select("id", "label")


@register(P + ", r AS (" + _RANK.format(seed=9, t="p") + "), m AS (SELECT min(c) // 10 AS n FROM (SELECT count(*) AS c FROM p GROUP BY label)) SELECT id, label, CAST(r // n AS INTEGER) AS tree FROM r, m WHERE r < 10 * n")
def tree_samples(spark, sf_dir):
    return sampling.disjoint_balanced(emb(spark, sf_dir).select("id", "label"), 10, 9)


@register(P + ", r AS (" + _RANK.format(seed=7, t="p") + ") SELECT id, label, CASE WHEN r < 5 * (label + 1) THEN 0 ELSE 1 END AS fold FROM r WHERE label < 2 AND r < 5 * (label + 1) + 4")
def sized_split(spark, sf_dir):
    return sampling.sized_split(emb(spark, sf_dir).select("id", "label"), {0: (5, 4), 1: (10, 4)}, 7)


@register("SELECT vec_id AS id, CASE WHEN label = 3 THEN 1 WHEN label IS NOT NULL THEN 0 END AS label FROM embeddings")
def one_vs_rest(spark, sf_dir):
    return sampling.one_vs_rest(emb(spark, sf_dir).select("id", "label"), 3)


@register(_LBL + ", u AS (SELECT id, row_number() OVER (ORDER BY " + _KEY.format(seed=3) + ", id) AS r, count(*) OVER () AS n FROM l WHERE label IS NULL) SELECT id, label FROM l WHERE label IS NOT NULL UNION ALL SELECT id, NULL FROM u WHERE r <= n // 3")
def skip_sample(spark, sf_dir):
    return sampling.skip_sample(_lbl(spark, sf_dir).select("id", "label"), 3, 3)


def _trial_sql(k: int) -> str:
    return f"SELECT {k} AS trial, k.assigned, r.label AS known FROM (" + _RANK.format(seed=11 + k, t="q") + ") r JOIN k USING (id), m WHERE r.r < n"


@register(
    AS + ", q AS (SELECT id, known AS label FROM k), m AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM q GROUP BY label)), t AS (" + " UNION ALL ".join(_trial_sql(k) for k in range(3)) + "), g AS (SELECT CAST(t.i AS INTEGER) AS trial, CAST(a.i AS INTEGER) AS assigned, CAST(b.i AS INTEGER) AS known FROM range(0, 3) t(i), range(0, 10) a(i), range(0, 10) b(i)), c AS (SELECT g.trial, g.assigned, g.known, count(t.trial) AS n FROM g LEFT JOIN t USING (trial, assigned, known) GROUP BY ALL) SELECT assigned, known, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std FROM c GROUP BY ALL"
)
def resampled_confusion(spark, sf_dir):
    rows, out = _assigned(spark, sf_dir), None
    for k in range(3):
        fold = sampling.balanced_split(rows.select("id", "assigned", F.col("known").alias("label")), 11 + k, folds=1)
        one = fold.select(F.lit(k).alias("trial"), "assigned", F.col("label").alias("known"))
        out = one if out is None else out.union(one)
    return rounded(metrics.resampled_confusion(out), "mean", "std")


# Learning, metrics, colours

#: A fixed rulebook of two trees over the first two features: (tree, tag, split, vec, gini, props).
RULES = (
    (0, 1, 0.0, (1.0, 0.0), 0.6, (0.4, 0.3, 0.3)),
    (0, 2, float("inf"), (0.0, 0.0), 0.3, (0.8, 0.1, 0.1)),
    (0, 3, 0.05, (0.0, 1.0), 0.5, (0.2, 0.4, 0.4)),
    (0, 6, float("inf"), (0.0, 0.0), 0.2, (0.1, 0.85, 0.05)),
    (1, 1, 0.02, (0.0, 1.0), 0.6, (0.3, 0.3, 0.4)),
    (1, 3, float("inf"), (0.0, 0.0), 0.1, (0.02, 0.03, 0.95)),
)
_LEAVES = (
    "WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), l AS ("
    "SELECT id, CASE WHEN a <= 0 THEN 0.3 WHEN b <= 0.05 THEN 0.2 ELSE 0.5 END AS gini, CASE WHEN a <= 0 THEN [0.8, 0.1, 0.1] WHEN b <= 0.05 THEN [0.1, 0.85, 0.05] ELSE [0.2, 0.4, 0.4] END AS props FROM p "
    "UNION ALL SELECT id, CASE WHEN b <= 0.02 THEN 0.6 ELSE 0.1 END, CASE WHEN b <= 0.02 THEN [0.3, 0.3, 0.4] ELSE [0.02, 0.03, 0.95] END FROM p), "
    "x AS (SELECT id, CAST(i - 1 AS INTEGER) AS label, 1.0 - CAST(gini AS DOUBLE) AS w, CAST(props[i] AS DOUBLE) AS pr FROM l, range(1, 4) t(i))"
)


def _leaves(spark, sf_dir):
    book = spark.createDataFrame([(t, g, s, list(v), i, list(p)) for t, g, s, v, i, p in RULES], rpt.SCHEMA)
    return rpt.walk(emb(spark, sf_dir).select("id", F.slice("feats", 1, 2).alias("feats")), book)


@register(_LEAVES + " SELECT id, label, round(sum(w * pr) / sum(w), 6) AS p FROM x GROUP BY id, label")
def rpt_decide_wmean(spark, sf_dir):
    return rounded(rpt.decide(_leaves(spark, sf_dir), "wmean").select("id", F.col("label").cast("int").alias("label"), "p"), "p")


@register(_LEAVES + " SELECT id, label, round(max(w * pr), 6) AS p FROM x GROUP BY id, label")
def rpt_decide_wmax(spark, sf_dir):
    return rounded(rpt.decide(_leaves(spark, sf_dir), "wmax").select("id", F.col("label").cast("int").alias("label"), "p"), "p")


@register()
def rpt_ensemble(spark, sf_dir):
    points = emb(spark, sf_dir).select("id", "label", "feats")
    return rpt.predict(rpt.walk(points, rpt.fit(points)))


_CONF = AS + ", m AS (SELECT max(greatest(assigned, known)) AS m FROM k), g AS (SELECT CAST(a.i AS INTEGER) AS assigned, CAST(b.i AS INTEGER) AS known FROM range(0, (SELECT m + 1 FROM m)) a(i), range(0, (SELECT m + 1 FROM m)) b(i)), c AS (SELECT g.assigned, g.known, count(k.id) AS n FROM g LEFT JOIN k USING (assigned, known) GROUP BY ALL), s AS (SELECT a.assigned AS label, CAST(p AS BIGINT) AS p, CAST(r AS BIGINT) AS r, CAST(h AS BIGINT) AS h FROM (SELECT assigned, sum(n) AS p, sum(CASE WHEN assigned = known THEN n ELSE 0 END) AS h FROM c GROUP BY assigned) a JOIN (SELECT known, sum(n) AS r FROM c GROUP BY known) b ON a.assigned = b.known)"


@register(_CONF + " SELECT assigned, known, n FROM c")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_assigned(spark, sf_dir))


@register(_CONF + " SELECT label, round(100.0 * h / nullif(p, 0), 6) AS user, round(100.0 * h / nullif(r, 0), 6) AS producer FROM s")
def user_producer(spark, sf_dir):
    return rounded(metrics.user_producer(metrics.confusion_matrix(_assigned(spark, sf_dir))), "user", "producer")


@register(_CONF + ", z AS (SELECT CAST(sum(n) AS BIGINT) AS size FROM c WHERE known = 0) SELECT label, round(h / CAST(nullif(size, 0) AS DOUBLE), 6) AS tp, round((size - h) / CAST(nullif(size, 0) AS DOUBLE), 6) AS miss_rate, round((p - h) / CAST(nullif(p, 0) AS DOUBLE), 6) AS false_discovery FROM s, z")
def three_metrics(spark, sf_dir):
    return rounded(metrics.three_metrics(metrics.confusion_matrix(_assigned(spark, sf_dir))), "tp", "miss_rate", "false_discovery")


_BIN = KN + ", c AS (SELECT " + ", ".join(f"count(*) FILTER (assigned = {a} AND known = {k}) AS {'ab'[a]}{'ab'[k]}" for a in (0, 1) for k in (0, 1)) + " FROM k) SELECT "
_BIN += ", ".join(f"round(100.0 * {n} / nullif({d}, 0), 6) AS {c}" for c, n, d in (("a_comp", "aa", "aa + ba"), ("a_corr", "aa", "aa + ab"), ("a_qual", "aa", "aa + ab + ba"), ("b_comp", "bb", "bb + ab"), ("b_corr", "bb", "bb + ba"), ("b_qual", "bb", "bb + ab + ba"))) + " FROM c"


@register(_BIN)
def binary_quality(spark, sf_dir):
    df = metrics.binary_quality(_known(spark, sf_dir))
    return rounded(df, *df.columns)


@register(_CONF + " SELECT CAST(assigned * 2 + i.i AS BIGINT) AS row, CAST(known * 2 + j.i AS BIGINT) AS col, round(n / CAST((SELECT max(n) FROM c) AS DOUBLE), 6) AS value FROM c, range(0, 2) i(i), range(0, 2) j(i)")
def dilate(spark, sf_dir):
    df = metrics.dilate(metrics.confusion_matrix(_assigned(spark, sf_dir)), 2)
    return rounded(df.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"), "value")


_TABLE = "(VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(color.COLORS)) + ") t(l, r, g, b)"


@register(f"SELECT vec_id AS id, round(255.0 - (255.0 - r) * pr, 6) AS r, round(255.0 - (255.0 - g) * pr, 6) AS g, round(255.0 - (255.0 - b) * pr, 6) AS b FROM (SELECT vec_id, label, CAST(abs(CAST(embedding[1] AS DOUBLE)) AS DOUBLE) AS pr FROM embeddings) JOIN {_TABLE} ON label = l")
def color_probability(spark, sf_dir):
    df = color.color_by_probability(emb(spark, sf_dir).withColumn("prob", F.abs("x")))
    return rounded(df.select("id", "r", "g", "b"), "r", "g", "b")


@register(f"SELECT vec_id AS id, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b FROM embeddings JOIN {_TABLE} ON label = l")
def color_class(spark, sf_dir):
    return color.color_by_class(emb(spark, sf_dir)).select("id", "r", "g", "b")


@register(f"SELECT round(CAST(embedding[1] AS DOUBLE), 3) + 0.0 AS x, round(CAST(embedding[2] AS DOUBLE), 3) + 0.0 AS y, round(CAST(embedding[3] AS DOUBLE), 3) + 0.0 AS z, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM embeddings JOIN {_TABLE} ON label = l")
def colored_text(spark, sf_dir):
    """Points written as coloured text and read again."""
    path = scratch(spark)
    export_colored(color.color_by_class(emb(spark, sf_dir)), path)
    back = read_text(spark, path, ",", 6)
    return rounded(back.select(*XYZ, *(F.col("feats")[i].alias(c) for i, c in enumerate("rgb"))), *XYZ, places=3)


@register()
def forest_confusion(spark, sf_dir):
    """Train on one balanced fold of the embeddings, validate on the other."""
    from cairn.plans.workflow import train_validate

    return train_validate(emb(spark, sf_dir).select("id", "label", "feats"), "rf")[1]


@register()
def factor_scores(spark, sf_dir):
    from cairn.ml.kernels import factor_analysis

    return factor_analysis(emb(spark, sf_dir).select("id", "feats"), 64, 4)


@register(
    "WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT q.id, t.label, row_number() OVER (PARTITION BY q.id ORDER BY list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (t.v[i] - q.v[i]) * (t.v[i] - q.v[i]))), t.id) AS r FROM e q JOIN e t ON t.label IS NOT NULL), "
    "c AS (SELECT id, label, count(*) AS n FROM d WHERE r <= 5 GROUP BY ALL) SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM c) WHERE r = 1"
)
def knn_labels(spark, sf_dir):
    """Each embedding by the labels of its five nearest ones, itself included."""
    from cairn.ml.classify import knn

    points = emb(spark, sf_dir)
    return knn(points.select("id", "label", "feats"), points.select("id", "feats"))


@register("WITH s AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS a, stddev_samp(CAST(embedding[i] AS DOUBLE)) AS d FROM embeddings, range(1, 65) t(i) GROUP BY i) SELECT vec_id AS id, CAST(i - 1 AS INTEGER) AS feature, round((CAST(embedding[i] AS DOUBLE) - a) / d, 6) + 0.0 AS value FROM embeddings, s")
def scaled_features(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    from cairn.ml.classify import as_features, scaler

    rows = as_features(emb(spark, sf_dir).select("id", "feats"))
    scaled = scaler().fit(rows).transform(rows)
    return rounded(scaled.select("id", F.posexplode(vector_to_array("scaled")).alias("feature", "value")), "value")


@register()
def embedding_plane(spark, sf_dir):
    """The embeddings of all labels in the plane: a balanced sample of the operator's default size."""
    from cairn.ml.embed import embed_plane

    return embed_plane(emb(spark, sf_dir).select("id", "label", "feats"))


@register()
def nystroem_features(spark, sf_dir):
    from cairn.ml.kernels import nystroem

    return nystroem(emb(spark, sf_dir).select("id", "feats"))


@register()
def fourier_features(spark, sf_dir):
    from cairn.ml.kernels import random_fourier

    return random_fourier(emb(spark, sf_dir).select("id", "feats"), 64)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["oracle_sql", "queries"]
