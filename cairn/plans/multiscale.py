"""Feature plans over one or several scales.

Profiles: "minimal" counts neighbours at distance <= r, coincident ones too, and tells their number; "gpu" takes
distances strictly between 0.0001 and r and tells the density. Query points without neighbours are never dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.cloud import XYZ
from cairn.functions.geometry import UPPER, ball_volume_cm3, squared_norm
from cairn.operators import features as G
from cairn.operators.neighbors import COINCIDENT, radius_join, scales_join
from cairn.operators.voxel import corner_of, unique_voxels

#: Where the profiles put points just between two voxels.
TIES = {"minimal": "up", "gpu": "even"}
RULES = {"minimal": dict(inclusive=True, exclude_coincident=False), "gpu": dict(inclusive=False, exclude_coincident=True)}


def resample(search: DataFrame, edge: float, low: tuple | None = None, ties: str = "up") -> DataFrame:
    """Voxel centres, which bound the neighbours of a point; edge 0: the points themselves."""
    return unique_voxels(search, edge, low, ties) if edge else search.select(*XYZ)


def one_scale(query: DataFrame, search: DataFrame, edge: float, radius: float, profile: str = "minimal") -> DataFrame:
    """(qid, population or density, centroid, eig1, eig2) for each query point."""
    pairs = radius_join(query, resample(search, edge, ties=TIES[profile]), radius, **RULES[profile])
    grouped = G.every_point(query, pairs).groupBy("qid").agg(*G.neighborhood_sums(pairs))
    if G.REGISTERED:  # any aggregate, which null rows might change
        grouped = grouped.join(pairs.groupBy("qid").agg(*G.registered_sums(radius)), "qid", "left")
    first = G.population().alias("population") if profile == "minimal" else G.density(radius).alias("density")
    rows = G.with_pca(grouped, ("eig1", "eig2", "eig3"))
    return rows.select("qid", first, G.centroid_distance().alias("centroid"), "eig1", "eig2", *G.REGISTERED)


def multiscale(query: DataFrame, search: DataFrame, edges: list[float], radii: list[float], profile: str = "minimal") -> DataFrame:
    """one_scale for each (edge, radius), side by side: s0_population, s0_centroid, s0_eig1, s0_eig2, s1_... in order.

    All scales share one join and one aggregate; each distinct edge is resampled once, from one corner.
    """
    if len(edges) != len(radii):
        raise ValueError("as many edges as radii are needed")
    low = corner_of(search) if any(edges) else None
    sides = [(resample(search, edge, low, TIES[profile]), radius) for edge, radius in zip(edges, radii)]
    pairs = scales_join(query, sides, **RULES[profile])
    own = [c for k, r in enumerate(radii) for c in G.registered_sums(r, f"s{k}_")]
    kept = pairs if own else G.every_point(query, pairs)  # null rows might change aggregates of one's own
    rows = G.with_pca(kept.groupBy("qid", "scale").agg(*G.neighborhood_sums(pairs), *own), ("eig1", "eig2", "eig3"))
    rows = rows.withColumns({"centroid": G.centroid_distance(), "population": G.population()})
    last = ["population", "centroid", "eig1", "eig2"]
    wide = {f"s{k}_{c}": F.max(F.when(F.col("scale") == k, F.col(c))) for k in range(len(radii)) for c in last}
    wide |= {f"s{k}_{c}": F.max(F.when(F.col("scale") == k, F.col(f"s{k}_{c}"))) for k in range(len(radii)) for c in G.REGISTERED}
    grouped = rows.groupBy("qid").agg(*(v.alias(k) for k, v in wide.items()))
    grouped = G.attach(query, grouped) if own else grouped
    out = []
    for k, r in enumerate(radii):
        n = F.coalesce(F.col(f"s{k}_population"), F.lit(0)).cast("long")
        out.append(n.alias(f"s{k}_population") if profile == "minimal" else (n / F.lit(ball_volume_cm3(r))).alias(f"s{k}_density"))
        out += [F.coalesce(F.col(f"s{k}_{c}"), F.lit(0.0)).alias(f"s{k}_{c}") for c in last[1:]]
        out += [F.col(f"s{k}_{c}") for c in G.REGISTERED]
    return grouped.select("qid", *out)


def multi_radius(query: DataFrame, search: DataFrame, edge: float, radii: list[float], kind: str = "eig", profile: str = "gpu") -> DataFrame:
    """Features of several radii over one resampling, radii descending: one join at the largest, aggregates for each.

    kind: "eig" gives density, centroid, eig1, eig2; "eigvec" adds the x and y parts of two eigenvectors; "cov" gives
    density, centroid and the six covariances (scatter sums).
    """
    radii = sorted(radii, reverse=True)
    pairs = radius_join(query, resample(search, edge, ties=TIES[profile]), radii[0], **RULES[profile])
    d2 = squared_norm(*(F.col(f"d{c}") for c in XYZ))
    inside = [d2 <= r * r if profile == "minimal" else d2 < r * r for r in radii]
    sums = []
    for k, within in enumerate(inside):
        sums += G.neighborhood_sums(pairs, within, f"s{k}_")
    rows = G.every_point(query, pairs).groupBy("qid").agg(*sums)
    if G.REGISTERED:  # any aggregate, so that only a filter before it restricts it to a radius
        for k, (r, within) in enumerate(zip(radii, inside)):
            rows = rows.join(pairs.where(within).groupBy("qid").agg(*G.registered_sums(r, f"s{k}_")), "qid", "left")
    out = ["qid"]
    for k, r in enumerate(radii):
        p = f"s{k}_"
        if kind in ("eig", "eigvec"):
            rows = G.with_pca(rows, (f"{p}eig1", f"{p}eig2", f"{p}eig3"), p)
            last = [f"{p}eig1", f"{p}eig2"]
            if kind == "eigvec":
                last += [f"{p}v1x", f"{p}v1y", f"{p}v2x", f"{p}v2y"]
                rows = G.with_eigenvectors(rows, p, tuple(last[2:]))
        elif kind == "cov":
            last = [G.covariance(a, b, p, scatter=True).alias(f"{p}cov_{a}{b}") for a, b in UPPER]
        else:
            raise ValueError(f"unknown kind: {kind}")
        out += [(G.density(r, p) if profile == "gpu" else G.population(p)).alias(f"{p}{'density' if profile == 'gpu' else 'population'}"), G.centroid_distance(p).alias(f"{p}centroid"), *last, *(f"{p}{name}" for name in G.REGISTERED)]
    return rows.select(*out)


def voxel_interpolate(search: DataFrame, voxels: DataFrame, columns: list[str], edge: float) -> DataFrame:
    """voxels(id, x, y, z) with the mean of the search points' columns within Chebyshev distance below edge; none: 0."""
    pairs = radius_join(voxels, search, edge, metric="cheby", inclusive=False, carry=tuple(columns))
    means = G.radius_mean(voxels, pairs, columns).withColumnRenamed("qid", "id")
    return voxels.select("id", *XYZ).join(means, "id")


def vector_multiscale(query: DataFrame, search: DataFrame, columns: list[str], edge: float, radii: list[float]) -> DataFrame:
    """Means of attached values around each query point for each radius, descending: s0_<column>, ...

    The search cloud is resampled and its values interpolated on the voxels first (edge 0: neither).
    """
    radii = sorted(radii, reverse=True)
    if edge:
        voxels = unique_voxels(search, edge).withColumn("id", F.xxhash64(*XYZ))
        search = voxel_interpolate(search, voxels, columns, edge)
    pairs = radius_join(query, search, radii[0], inclusive=False, carry=tuple(columns))
    d2 = squared_norm(*(F.col(f"d{c}") for c in XYZ))
    named = {f"s{k}_{c}": F.avg(F.when(d2 < r * r, F.col(c))) for k, r in enumerate(radii) for c in columns}
    grouped = G.every_point(query, pairs).groupBy("qid").agg(*(v.alias(k) for k, v in named.items()))
    return grouped.select("qid", *(F.coalesce(F.col(k), F.lit(0.0)).alias(k) for k in named))


__all__ = ["COINCIDENT", "multi_radius", "multiscale", "one_scale", "resample", "vector_multiscale", "voxel_interpolate"]
