"""Aggregates over neighbourhoods: the pairs of a radius join, grouped by query point."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.cloud import XYZ
from cairn.functions.geometry import UPPER, ball_volume_cm3, squared_norm, with_eigenvalues

#: Features added by register_feature: name -> function of a radius that gives an aggregate over dx, dy, dz.
REGISTERED: dict[str, Callable[[float], Column]] = {}


def register_feature(name: str, aggregate: Callable[[float], Column]) -> None:
    """Makes an aggregate over the offsets dx, dy, dz of a neighbourhood available as a feature: a column of that name
    at the end of one_scale, and of each scale of multiscale and multi_radius."""
    if name in REGISTERED:
        raise ValueError(f"feature {name} exists")
    REGISTERED[name] = aggregate


def registered_sums(radius: float, prefix: str = "") -> list[Column]:
    """The registered aggregates for a radius, named as they are registered; points without neighbours get null."""
    return [aggregate(radius).alias(f"{prefix}{name}") for name, aggregate in REGISTERED.items()]


def neighborhood_sums(pairs: DataFrame, within: Column | None = None, prefix: str = "") -> list[Column]:
    """Aggregates that all features derive from: n, mean offsets, covariances (of the sample); algebraic, so that they
    are combined before the shuffle."""
    pick = (lambda c: F.when(within, F.col(c))) if within is not None else F.col
    out = [F.count(pick("dx")).alias(f"{prefix}n"), *(F.avg(pick(f"d{c}")).alias(f"{prefix}m{c}") for c in XYZ)]
    return out + [F.covar_samp(pick(f"d{a}"), pick(f"d{b}")).alias(f"{prefix}c{a}{b}") for a, b in UPPER]


def attach(query: DataFrame, grouped: DataFrame) -> DataFrame:
    """Every query id with its aggregates; points without neighbours stay, with n = 0."""
    return query.select(F.col("id").alias("qid")).join(grouped, "qid", "left")


def every_point(query: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs and a row of nulls for each query point: grouped by qid, points without neighbours stay, and no join is
    needed for it. Aggregates of columns do not count the nulls."""
    rest = {f.name: F.lit(None).cast(f.dataType) for f in pairs.schema.fields} | {"qid": F.col("id")}
    return pairs.union(query.select(*(rest[c].alias(c) for c in pairs.columns)))


def population(prefix: str = "") -> Column:
    return F.coalesce(F.col(f"{prefix}n"), F.lit(0)).cast("long")


def density(radius: float, prefix: str = "") -> Column:
    """Points per cubic centimetre, the radius being in metres."""
    return population(prefix) / F.lit(ball_volume_cm3(radius))


def centroid_distance(prefix: str = "") -> Column:
    """From the query point to the mean of its neighbours; none: 0."""
    return F.coalesce(F.sqrt(squared_norm(*(F.col(f"{prefix}m{c}") for c in XYZ))), F.lit(0.0))


def signed_z_offset() -> Column:
    """Aggregate over a neighbourhood: the offset dz of largest size with its sign, ties to the positive one; none: 0."""
    top, low = F.max("dz"), F.min("dz")
    return F.coalesce(F.when(top >= -low, top).otherwise(low), F.lit(0.0))


def covariance(a: str, b: str, prefix: str = "", scatter: bool = False) -> Column:
    """Sample covariance, or the scatter sum; fewer than two neighbours: 0."""
    value = F.col(f"{prefix}c{a}{b}")
    if scatter:
        value = value * (F.col(f"{prefix}n") - 1)
    return F.when(F.col(f"{prefix}n") >= 2, value).otherwise(0.0)


def with_pca(df: DataFrame, out: tuple[str, str, str], prefix: str = "") -> DataFrame:
    """Adds the three normalised eigenvalues of the covariance, largest first."""
    df = df.withColumns({f"_{a}{b}": covariance(a, b, prefix) for a, b in UPPER} | {"_n": population(prefix)})
    df = with_eigenvalues(df, {f"{a}{b}": f"_{a}{b}" for a, b in UPPER}, "_n", out)
    return df.drop("_n", *(f"_{a}{b}" for a, b in UPPER))


def _vectors(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    m = np.zeros((len(xx), 3, 3))
    for value, (i, j) in zip((xx, xy, xz, yy, yz, zz), ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
        m[:, i, j] = m[:, j, i] = np.nan_to_num(value.to_numpy(float))
    w, v = np.linalg.eigh(m)
    out = np.zeros((len(m), 6))
    for k in (0, 1):
        vec = v[:, :, 2 - k]
        big = np.take_along_axis(vec, np.abs(vec).argmax(1)[:, None], 1)
        vec = vec * np.where(big < 0, -1.0, 1.0)
        vec[w.sum(1) <= 0] = 0.0
        out[:, 2 * k : 2 * k + 2] = vec[:, :2]
        out[:, 4 + k] = vec[:, 2]
    return pd.DataFrame(out, columns=list("abcdef"))


def with_eigenvectors(df: DataFrame, prefix: str = "", names: tuple[str, ...] = ("v1x", "v1y", "v2x", "v2y")) -> DataFrame:
    """Adds the x and y parts of the eigenvectors of the two largest eigenvalues; a fifth and sixth name: their z parts.

    The sign is the one that makes the component of largest size positive; undefined: zeros. Batches of matrices go
    through numpy in one call each.
    """
    udf = F.pandas_udf(_vectors, "a double, b double, c double, d double, e double, f double")
    df = df.withColumn("_v", udf(*(covariance(a, b, prefix) for a, b in UPPER)))
    return df.withColumns({n: F.col(f"_v.{k}") for n, k in zip(names, "abcdef")}).drop("_v")


def radius_mean(query: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of carried columns over each neighbourhood; none: 0."""
    grouped = every_point(query, pairs).groupBy("qid").agg(*(F.avg(c).alias(c) for c in columns))
    return grouped.select("qid", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns))
