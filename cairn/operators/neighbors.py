"""Fixed-radius neighbour joins and distance matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.cloud import XYZ
from cairn.functions.geometry import chebyshev, squared_norm

#: Offsets below this do not count as neighbours where coincident points are excluded.
COINCIDENT = 0.0001
#: Query rows of a distance matrix that meet a partition of the search side at a time.
QUERY_BLOCK = 4096


def _within(radius: float, metric: str, inclusive: bool, exclude_coincident: bool) -> Column:
    d = [F.col(f"d{c}") for c in XYZ]
    if metric == "euclid":
        value, limit, least = squared_norm(*d), F.lit(radius) * F.lit(radius), COINCIDENT * COINCIDENT
    elif metric == "cheby":
        value, limit, least = chebyshev(*d), F.lit(radius), COINCIDENT
    else:
        raise ValueError(f"unknown metric: {metric}")
    near = value <= limit if inclusive else value < limit
    return near & (value > least) if exclude_coincident else near


def radius_join(
    query: DataFrame, search: DataFrame, radius: float, metric: str = "euclid", inclusive: bool = True, exclude_coincident: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """query(id, x, y, z), search(x, y, z, carried columns) -> (qid, dx, dy, dz, carried columns) of the pairs in reach.

    dx, dy, dz lead from the query point to its neighbour. Both sides get the cell of edge `radius` that they lie in; the
    search side is copied to the 27 cells around its own, so an equi-join on the cell produces each pair once and the
    distance is its residual. The search side is the resampled one, whose points per cell are bounded, and AQE splits
    cells that are skewed on the query side.
    """
    cell = lambda df: {f"g{c}": F.floor(F.col(c) / F.lit(radius)).cast("long") for c in XYZ}
    q = query.select(F.col("id").alias("qid"), *(F.col(c).alias(f"q{c}") for c in XYZ)).withColumns({f"g{c}": F.floor(F.col(f"q{c}") / F.lit(radius)).cast("long") for c in XYZ})
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    s = search.select(*(F.col(c).alias(f"s{c}") for c in XYZ), *carry, *(v.alias(k) for k, v in cell(search).items()))
    for c in XYZ:
        s = s.withColumn("_o", F.explode(step)).withColumn(f"g{c}", F.col(f"g{c}") + F.col("_o")).drop("_o")
    pairs = q.join(s, ["gx", "gy", "gz"]).select("qid", *((F.col(f"s{c}") - F.col(f"q{c}")).alias(f"d{c}") for c in XYZ), *carry)
    return pairs.where(_within(radius, metric, inclusive, exclude_coincident))


def scales_join(query: DataFrame, searches: list[tuple[DataFrame, float]], inclusive: bool = True, exclude_coincident: bool = False) -> DataFrame:
    """query(id, x, y, z) with several search sides (x, y, z), each of its own radius -> (qid, scale, dx, dy, dz).

    The sides are one table with the scale's number as part of the join key, so that all scales share one shuffle; cells
    and distances follow each row's radius.
    """
    radii = F.array(*(F.lit(float(r)) for _, r in searches))
    q = query.select(F.col("id").alias("qid"), *(F.col(c).alias(f"q{c}") for c in XYZ), F.posexplode(radii).alias("scale", "r"))
    q = q.withColumns({f"g{c}": F.floor(F.col(f"q{c}") / F.col("r")).cast("long") for c in XYZ})
    s = None
    for k, (search, r) in enumerate(searches):
        one = search.select(F.lit(k).alias("scale"), *(F.col(c).alias(f"s{c}") for c in XYZ), *(F.floor(F.col(c) / F.lit(float(r))).cast("long").alias(f"g{c}") for c in XYZ))
        s = one if s is None else s.union(one)
    for c in XYZ:
        s = s.withColumn("_o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"g{c}", F.col(f"g{c}") + F.col("_o")).drop("_o")
    pairs = q.join(s, ["scale", "gx", "gy", "gz"]).select("qid", "scale", "r", *((F.col(f"s{c}") - F.col(f"q{c}")).alias(f"d{c}") for c in XYZ))
    d2, limit = squared_norm(*(F.col(f"d{c}") for c in XYZ)), F.col("r") * F.col("r")
    near = d2 <= limit if inclusive else d2 < limit
    return pairs.where(near & (d2 > COINCIDENT * COINCIDENT) if exclude_coincident else near).drop("r")


def distance_matrix(query: DataFrame, search: DataFrame, metric: str = "euclid", max_search: int | None = None) -> DataFrame:
    """(qid, sid, dist) of every query row with every search row, as a stated set against all rows.

    The query rows are counted and dealt into blocks of about QUERY_BLOCK rows; each block meets each partition of the
    search side, which stays where it is, so neither side has to fit one machine. Where a side is small enough, Spark
    broadcasts it. Only a caller who names max_search is refused (ValueError) if there are more search rows. For the
    pairs in reach alone use radius_join.
    """
    if max_search is not None and search.limit(max_search + 1).count() > max_search:
        raise ValueError(f"this distance matrix was to take at most {max_search} search points; use radius_join")
    if metric not in ("euclid", "cheby"):
        raise ValueError(f"unknown metric: {metric}")
    q = query.select(F.col("id").alias("qid"), *(F.col(c).alias(f"q{c}") for c in XYZ))
    s = search.select(F.col("id").alias("sid"), *(F.col(c).alias(f"s{c}") for c in XYZ))
    d = [F.col(f"s{c}") - F.col(f"q{c}") for c in XYZ]
    dist = F.sqrt(squared_norm(*d)) if metric == "euclid" else chebyshev(*d)
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    return s.crossJoin(q.repartition(blocks)).select("qid", "sid", dist.alias("dist"))
